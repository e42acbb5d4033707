import hashlib
import random
import re

from codeloom.llm import contamination as C

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(UPPER))


def brute(docs, bench):
    out = []
    for d, t in docs:
        w = words(t)
        hit, items = set(), set()
        for i, b in bench:
            x = words(b)
            n = min(10, len(x))
            for q in range(len(x) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[q : q + n]:
                        hit |= set(range(p, p + n))
                        items.add(str(i))
        ids = sorted(items)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def tables(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["Été", "straße", "日本", "a1b2"]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 9, 10, 11, 25, 40])))) for i in range(25)]
    bench += [(100, None), (101, "  ... "), (102, bench[5][1]), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (103, "a a a a a a a a a a a a")]
    docs = []
    for d in range(80):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            parts.append(" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40))))
            x = words(rng.choice(bench)[1])
            if x:
                s = rng.randrange(len(x))
                parts.append("-".join(x[s : s + rng.randrange(5, 30)]).upper() if rng.random() < 0.3 else ", ".join(x[s:]))
        docs.append((d, "\n".join(parts)))
    docs += [(90, None), (91, ""), (92, "... !!"), (93, "a " * 50), (94, docs[3][1]), (94, docs[3][1]), (95, (docs[7][1] + " ") * 300)]
    return docs, bench


def run(spark, docs, bench, **more):
    d = spark.createDataFrame([(a, t, 1, "x") for a, t in docs], "doc_id long, text string, N_hit int, items string")
    b = spark.createDataFrame([(a, t) for a, t in bench], "item_id long, text string")
    got = C.find_contamination(d, b, **more)
    return got, sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect())


def test_matches_brute_force(spark):
    docs, bench = tables()
    assert run(spark, docs, bench)[1] == brute(docs, bench)


def test_blocks_give_the_same(spark):
    docs, bench = tables(4)
    assert run(spark, docs, bench, block_bytes=300)[1] == brute(docs, bench)


def test_only_long_items_and_longest(spark):
    docs, bench = tables(6)
    bench = [(i, t) for i, t in bench if len(words(t)) >= 10]
    got, rows = run(spark, docs, bench)
    assert rows == brute(docs, bench)
    w = [f"q{i}" for i in range(30)]
    got, _ = run(spark, [(1, "x " + " ".join(w[3:24]) + " y")], [(7, " ".join(w))])
    r = got.collect()[0]
    assert r.longest_match == 21 and [(s.start, s.end) for s in r.spans] == [(1, 22)] and r["items"] == ["7"]


def longest(w, bench):
    """The longest run of words of ``w`` in any item, by brute force; 0 below three words."""
    best = 0
    for _, t in bench:
        x = words(t)
        row = [0] * (len(x) + 1)
        for a in w:
            row = [0] + [row[j] + 1 if a == b else 0 for j, b in enumerate(x)]
            best = max(best, *row)
    return best if best >= 3 else 0


def test_longest_match_equals_brute_force(spark):
    docs, bench = tables(8)
    docs = [(i, t) for i, t in docs if len(t or "") < 3000]
    want = sorted((i, longest(words(t), bench)) for i, t in docs)
    for more in ({}, {"block_bytes": 300}):
        got, _ = run(spark, docs, bench, **more)
        assert sorted((r.doc_id, r.longest_match) for r in got.collect()) == want
    assert len({n for _, n in want}) > 8


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")])[1] == []
    assert run(spark, [(1, "a b c")], [])[1] == brute([(1, "a b c")], [])


def test_items_without_id_are_searched(spark):
    w = " ".join(f"q{i}" for i in range(12))
    got, _ = run(spark, [(1, "x " + w), (2, "clean words")], [(None, w), (7, "other words here")])
    assert [(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in sorted(got.collect())] == [(1, 12, 0, True), (2, 0, 0, False)]
