import random
import re

import pytest

from codeloom.llm import near as N
from codeloom.llm.graph import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_set(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    adj = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    cls = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for y in adj[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        cls[i] = min(rows[k][0] for k in seen)
    return sorted((rows[i][0], cls[i], len(adj[i])) for i in range(n))


def corpus(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)] + ["été", "日本"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([6, 30, 120, 400]))] for _ in range(60)]
    rows = []
    for b in base:
        rows.append(" ".join(b))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            x = list(b)
            for _ in range(rng.choice([0, 0, 1, 2])):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            rows.append((" " if rng.random() < 0.5 else ", ").join(x).upper() if rng.random() < 0.3 else " ".join(x))
    rows += ["a b c", "A-b  c", "a b", "x", "X", None, "", "...", None]
    long = [rng.choice(vocab) for _ in range(30000)]
    rows += [" ".join(long), " ".join(long[:-3])]
    rng.shuffle(rows)
    return list(enumerate(rows))


def pairs_without_band(rows):
    """Links that no band has: the recall that the bands are chosen for leaves out 1 in 1000."""
    import numpy as np

    bands, size = N.plan_bands()
    raw = [(t or "").encode() for _, t in rows]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h, first, _ = N.shingles(data, off)
    keys = N.band_hashes(h, first, bands, size)
    sets = [shingle_set(t) for _, t in rows]
    return [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and not (keys[i] == keys[j]).any()]


@pytest.mark.parametrize("block", [4096, 40, 3])
def test_equals_brute_force(spark, block):
    rows = corpus()
    assert not pairs_without_band(rows)  # so that nothing may be missed here
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, Copies int")
    got = N.near_duplicates(df, block_docs=block).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_bands_of_all_forms_are_not_broadcast(spark, monkeypatch):
    # Spark takes exploded lists for as small as their file; the driver had to hold the bands of the whole corpus.
    plans = []

    def watched(df, name, cut=N.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    monkeypatch.setattr(N, "cut", watched)
    monkeypatch.setattr("codeloom.llm.graph.cut", watched)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in N.near_duplicates(df, block_docs=3).collect()) == brute(rows)
    laid_out = [p for p in plans if "explode(" in p and "Join" in p]
    bad = [line for p in laid_out for line in p.split("\n") if "BroadcastHashJoin [key#" in line or "BroadcastHashJoin [rep#" in line]
    assert len(laid_out) >= 2 and not bad


def test_chained_unlike_documents(spark):
    # Each shares half its words with the next: one component of bands, no links but the planted ones.
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60 * 40)]
    rows = [" ".join(words[30 * i : 30 * i + 60]) for i in range(75)]
    rows += [rows[7] + " tail", rows[8] + " tail", rows[7]]
    rows = list(enumerate(rows))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999, block_docs=4).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_repeated_rows_nulls_and_keep_one(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(1, t), (1, t), (2, t), (3, "other words entirely here now ok"), (None, "null id text with words"), (4, None), (5, ""), (3, "same id but another text to see what happens")]
    rows += [(None, t), (None, "a third text without an id"), (6, "same id but another text to see what happens")]
    df = spark.createDataFrame([(i, x, "s", 1) for i, x in rows], "doc_id long, text string, row string, rep int")
    got = N.near_duplicates(df).collect()
    want = [("1", "None", 3), ("1", "None", 3), ("2", "None", 3), ("3", "3", 0), ("3", "3", 1), ("6", "3", 1), ("None", "None", 0), ("None", "None", 0), ("None", "None", 3), ("4", "4", 0), ("5", "5", 0)]
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == sorted(want)
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == sorted((str(i), x) for i, x in [rows[8], rows[3], rows[4], rows[7], rows[9]])
    assert kept.where("text IS NULL OR text = ''").count() == 2
    assert N.near_duplicates(df.limit(0)).count() == 0 and N.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_plan_reaches_recall():
    b, r = N.plan_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= 128


def test_pipeline_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline

    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (5, texts[2] + " more"), (3, texts[3]), (3, texts[4]), (4, texts[4]), (6, None), (7, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.ngram_jaccard(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([rows[i] for i in (0, 1, 3, 5, 6, 8, 9)], key=str)
