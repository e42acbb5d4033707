import random

import numpy as np
import pyarrow as pa

from codeloom.llm import lines as L
from codeloom.llm.words import text_buffer


def chunks_of(text):
    _, start, end, line, line_end, *_ = L.chunk_lines(*text_buffer(pa.array([text], pa.string())))
    return list(zip(start.tolist(), end.tolist(), line.tolist(), line_end.tolist(), strict=True))


def brute(rows):
    """rows: distinct (id, text). Removes by comparing bytes of all chunks with a dictionary of what came before."""
    seen, out = set(), {}
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0])
    for i, t in order:
        raw = (t or "").encode()
        gone, keep, lines = 0, bytearray(b"\1" * len(raw)), set()
        for a, b, x, y in chunks_of(t or ""):
            piece = raw[a:b]
            if piece in seen:
                gone += 1
                lines.update(range(x, y))
                # With the line's newline.
                keep[a : b + 1] = b"\0" * (min(b + 1, len(raw)) - a)
            seen.add(piece)
        kept = bytes(c for c, k in zip(raw, keep, strict=True) if k)
        out[(i, t)] = (kept.decode() if t is not None else None, gone, len(lines))
    return out


def test_blocks_between_other_lines_are_found():
    rng = random.Random(8)
    for k, least_found, least_lines in ((2, 0.3, 0.3), (3, 0.7, 0.6), (4, 0.88, 0.75), (6, 0.97, 0.85), (12, 0.99, 0.9)):
        found = lines = 0
        for _ in range(400):
            block = [f"b {rng.random()}" for _ in range(k)]
            sides = [[f"x {rng.random()}" for _ in range(5)] + block + [f"y {rng.random()}" for _ in range(5)] for _ in range(2)]
            seen = {"\n".join(sides[0])[a:b] for a, b, *_ in chunks_of("\n".join(sides[0]))}
            got = {n for a, b, x, y in chunks_of("\n".join(sides[1])) if "\n".join(sides[1])[a:b] in seen for n in range(x, y)}
            found += bool(got)
            lines += len(got)
        assert found / 400 >= least_found and lines / 400 / k >= least_lines, (k, found, lines)


def corpus(seed):
    rng = random.Random(seed)
    pool = [f"line {i} é {'x' * (i % 7)}" for i in range(40)]
    passages = [[rng.choice(pool) + str(rng.randrange(3)) for _ in range(rng.randrange(2, 9))] for _ in range(6)]
    rows = []
    for d in range(60):
        x = []
        for _ in range(rng.randrange(0, 5)):
            x += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(pool)] * rng.randrange(1, 3)
            x += [""] * rng.randrange(0, 2)
        rows.append((d, "\n".join(x) + "\n" * rng.randrange(0, 2)))
    rows += [(70, None), (71, ""), (72, "\n\n \n"), (73, "one line"), (74, rows[5][1]), (75, "a\nb\n" * 5000), (None, rows[6][1])]
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1)
    extra = [rows[7], rows[7]]
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows + extra], "doc_id long, text string, source string, H1 int, cuts int")
    got = L.line_dedup(df).collect()
    want = brute(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        assert (r.kept_text, r.n_removed_chunks, r.n_removed_lines) == want[(r._row.doc_id, r._row.text)], r._row.doc_id
    assert sum(r.n_removed_chunks for r in got) > 20
    kept = L.without_repeats(df)
    assert kept.columns == df.columns
    assert 73 in [r.doc_id for r in kept.collect()] and 74 not in [r.doc_id for r in kept.collect()]


def test_unequal_bytes_stay(spark):
    def same_hash(batches):
        for b in L.scan_chunks(batches):
            zero = pa.array(np.zeros(b.num_rows, np.int64), mask=np.asarray(b.column(6).is_null()))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], zero, zero], names=b.schema.names)

    df = spark.createDataFrame([(1, "a\nb"), (2, "c\nd"), (3, "a\nb")], "doc_id long, text string")
    got = {r._row.doc_id: r.n_removed_chunks for r in L.line_dedup(df, scan=same_hash).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_borders_resist_shifts():
    rng = random.Random(4)
    body = [f"row {rng.random()}" for _ in range(300)]
    a = {"\n".join(body).encode()[x:y] for x, y, *_ in chunks_of("\n".join(body))}
    moved = "\n".join([*(f"new {i}" for i in range(5)), *body])
    b = {moved.encode()[x:y] for x, y, *_ in chunks_of(moved)}
    assert len(a & b) > 0.9 * len(a)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert L.line_dedup(df).count() == 0 and L.without_repeats(df).count() == 0
