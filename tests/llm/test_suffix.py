import hashlib
import random

import numpy as np
import pytest

from codeloom.llm import suffix as S


def brute(rows, n=100):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: -1 << 70 if rows[i][0] is None else rows[i][0])
    for i in order:
        raw = (rows[i][1] or "").encode()
        for at in range(len(raw) - n + 1):
            first.setdefault(raw[at : at + n], (rows[i][0], at))
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - n + 1):
            if first[raw[at : at + n]] != (rows[i][0], at):
                gone[at : at + n] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((rows[i][0], len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randrange(1, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [line(rng.choice([15, 25, 60, 200])) for _ in range(8)]
    hot = line(14)
    rows = []
    for d in range(110):
        x = []
        for _ in range(rng.randrange(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                x.append(line(rng.randrange(1, 40)))
            elif kind < 0.6:
                x.append(hot)
            else:
                p = rng.choice(passages)
                a = rng.randrange(len(p)) if rng.random() < 0.4 else 0
                p = p[a:]
                if rng.random() < 0.4 and p:
                    b = rng.randrange(len(p))
                    p = p[:b] + "#" + p[b + 1 :]
                x.append(p)
        rows.append((d * 3, "\n".join(x)))
    rows += [(1, None), (2, ""), (4, "a" * 99), (5, "a" * 100), (7, "a" * 3000), (8, "ab" * 800 + "x" + "ab" * 800), (None, rows[9][1]), (400, rows[5][1]), (401, rows[5][1] + "tail"), (402, "\0" * 150 + "ab" + "\0" * 120)]
    return rows


@pytest.mark.parametrize("limit", [1024, 4, 2])
def test_matches_brute_force(spark, limit):
    rows = corpus(limit)
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, kind string, h int").repartition(3)
    got = S.substring_dedup(df, limit=limit, with_text=True).collect()
    have = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str)
    assert have == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert sum(r.n_removed for r in got) > 10_000


def test_repeated_rows_and_empty_table(spark):
    t = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (3, "short")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in S.substring_dedup(df).collect())
    assert got == [(1, 0), (1, 0), (2, len(t)), (3, 0)]
    assert S.substring_dedup(df.limit(0)).count() == 0


def test_texts_that_share_an_id(spark):
    fresh = lambda c: " ".join(f"{c}{i}" for i in range(80))
    x, y, z = fresh("x"), fresh("y"), fresh("z")
    rows = [(5, x + x), (5, y + " " * 400), (5, y + " " * 400), (None, z), (None, None), (None, "other " + z), (8, y)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5, 2 * len(x)] == len(x) and got[8, len(y)] == len(y) and got[None, 0] == 0
    # Of the two texts without an id that share z one keeps it.
    assert sorted((got[None, len(z)], got[None, len(z) + 6])) in ([0, len(z)], [0, len(z) + 1])
    assert got[5, len(y) + 400] == 399  # all but the first byte of the run of blanks


def test_groups_are_maximal_repeats():
    rng = random.Random(2)
    n = 100
    anchor = "".join(rng.choice("xyz") for _ in range(S.K))
    base_l, base_r = ["".join(rng.choice("ab") for _ in range(68)) for _ in range(2)]
    rows = []
    for _ in range(40):
        i, j = rng.randrange(0, 68), rng.randrange(0, 68)
        left = "".join(rng.choice("ab") for _ in range(i)) + base_l[i:]
        rows.append((left, base_r[:j] + "".join(rng.choice("ab") for _ in range(68 - j))))
    raw = np.frombuffer("".join(a + anchor + b for a, b in rows).encode(), np.uint8)
    off = np.arange(len(rows) + 1) * (68 + 68 + S.K)
    zero = np.zeros(len(rows), np.int64)
    got = {(l, r, frozenset(m)) for l, r, m in S.maximal_repeats(zero, zero, zero, zero + 68, off, raw, n)}
    want = set()
    lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), 68)
    for a in range(len(rows)):
        for b in range(a):
            l, r = lcp(rows[a][0][::-1], rows[b][0][::-1]), lcp(rows[a][1], rows[b][1])
            if l + r >= 68:
                s = (rows[a][0][68 - l :], rows[a][1][:r])
                want.add((l, r, frozenset(i for i, (x, y) in enumerate(rows) if x.endswith(s[0]) and y.startswith(s[1]))))
    assert got == want


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_settle_does_not_depend_on_batches(size):
    rng = random.Random(size)
    rows = sorted((rng.randrange(12), rng.randrange(3), rng.randrange(6), rng.randrange(500)) for _ in range(150))
    cols = [np.array(c) for c in zip(*rows, strict=True)]

    def run(k):
        parts = [S.anchor_rows(0, *(c[i : i + k] for c in cols), cols[3][i : i + k], cols[3][i : i + k]) for i in range(0, len(rows), k)]
        return sorted(tuple(r.values()) for b in S.settle(iter(parts)) for r in b.to_pylist())

    whole = run(1000)
    assert run(size) == whole
    several = {h for h in range(12) if len({r[1] for r in rows if r[0] == h}) > 1}
    assert {r[1] for r in whole if r[0] == 0} == several
    assert sum(r[0] for r in whole) == sum(r[2] > min(x[2] for x in rows if x[:2] == r[:2]) for r in rows)
