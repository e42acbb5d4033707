import re

import pytest
from pyspark.sql import types as T

from codeloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    hit = {i + j for i, w in enumerate(windows) if w in twice for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n)


TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b c a b c", "a a a a a", "x y z\nx y z\n\nx y z\n", "# * $ % & | < >",
    "é ü 😀 word next", "alpha beta gamma " * 30, " ".join(f"w{i}" for i in range(400)), "b a b a b a b",
    " ".join(f"w{i % 60}" for i in range(30000)), "clean words stay here. " + " ".join(f"tok{i}" for i in range(200)) + ".",
]


def test_signals_match_brute_force(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("N_words", T.StringType()), T.StructField("_w", T.IntegerType())])
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(1, TEXTS[9], "y", None)]
    got = quality.quality_rules(spark.createDataFrame(rows, schema)).collect()
    want = sorted((r[0], *brute(r[1])) for r in rows)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    kept = quality.keep_good(spark.createDataFrame(rows, schema))
    assert kept.columns == schema.names
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_rules(df).count() == 0
    assert quality.keep_good(df).count() == 0


def test_em_recovers_accuracies():
    import random

    rng = random.Random(5)
    true = [(0.95, 0.9), (0.8, 0.85), (0.9, 0.7), (0.97, 0.95)]
    counts = {}
    for _ in range(20000):
        good = rng.random() < 0.9
        vote = tuple(-1 if rng.random() < 0.2 else int((rng.random() < (g if good else b)) == good) for g, b in true)
        counts[vote] = counts.get(vote, 0) + 1
    prior, acc = quality.fit(sorted(counts.items()), 4)
    assert prior == pytest.approx(0.9, abs=0.03)
    for (g, b), (tg, tb) in zip(acc, true, strict=True):
        assert g == pytest.approx(tg, abs=0.04) and b == pytest.approx(tb, abs=0.12)


def vote_of(text):
    """The nine rules in plain Python."""
    n, chars, symbols, dup, repeat, _ = brute(text)
    text = text or ""
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    stops, digits = sum(c in ".!?" for c in text), sum(c in "0123456789" for c in text)
    short = sum(len(w) <= 3 and w.isalpha() for w in WORD.findall(text))
    words, ink = max(n, 1), max(chars, 1)

    def rule(x, good, bad):
        return 0 if bad(x) else 1 if good(x) else -1

    return (
        rule(n, lambda x: x >= 100, lambda x: x < 50), rule(chars / words, lambda x: 3 <= x <= 10, lambda x: x < 2 or x > 14),
        rule(symbols / words, lambda x: x <= 0.02, lambda x: x > 0.1), rule(symbols / ink, lambda x: x <= 0.005, lambda x: x > 0.03),
        rule(short / words, lambda x: x >= 0.1, lambda x: x < 0.04), rule(dup / max(lines, 1), lambda x: x <= 0.05, lambda x: x > 0.3),
        rule(repeat / words, lambda x: x <= 0.1, lambda x: x > 0.3), rule(stops / words, lambda x: 0.02 <= x <= 0.5, lambda x: x < 0.002),
        rule(digits / ink, lambda x: x <= 0.05, lambda x: x > 0.2),
    )


def em(votes, fenced=True):
    """Posteriors by expectation-maximisation over single documents, with arrays."""
    import numpy as np

    v = np.array(votes)
    prior, good, bad = quality.PRIOR, np.full(v.shape[1], quality.START[0]), np.full(v.shape[1], quality.START[1])
    pull = quality.STRENGTH * len(v) if fenced else 0.0

    def posteriors():
        odds = np.where(v == 1, np.log(good / (1 - bad)), np.where(v == 0, np.log((1 - good) / bad), 0.0)).sum(1) + np.log(prior / (1 - prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    for _ in range(300):
        p = posteriors()[:, None]
        old = np.concatenate([[prior], good, bad])
        prior = (p.sum() + quality.PRIOR * pull) / (len(v) + pull)
        good = (((v == 1) * p).sum(0) + quality.START[0] * pull) / np.maximum(((v >= 0) * p).sum(0) + pull, 1e-12)
        bad = (((v == 0) * (1 - p)).sum(0) + quality.START[1] * pull) / np.maximum(((v >= 0) * (1 - p)).sum(0) + pull, 1e-12)
        low, high = (0.55, 0.995) if fenced else (1e-6, 1 - 1e-6)
        prior, good = min(high, max(0.5 if fenced else 1e-6, prior)), np.clip(good, low, high)
        bad = np.minimum(high, np.maximum(1.005 - good, bad)) if fenced else np.clip(bad, 1e-6, high)
        if abs(np.concatenate([[prior], good, bad]) - old).max() < 1e-7:
            break
    return posteriors()


def test_verdicts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect() if len(r.text or "") < 30_000}
    df = docs.where("text IS NULL OR length(text) < 30000")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    ids = sorted(texts)
    votes = [vote_of(texts[i]) for i in ids]
    want, free = em(votes), em(votes, fenced=False)
    failed = [brute(texts[i])[-1] for i in ids]
    wrong = [i for i, p, f in zip(ids, want, failed, strict=True) if abs(got[i].quality_p - p) > 1e-4 or got[i].kept != (not f and p >= 0.5)]
    assert not wrong, wrong[:5]
    # What the bounds and the pull change: few verdicts.
    kept = [not f and p >= 0.5 for p, f in zip(want, failed, strict=True)]
    other = [not f and p >= 0.5 for p, f in zip(free, failed, strict=True)]
    assert sum(a != b for a, b in zip(kept, other, strict=True)) <= 0.01 * len(ids)
    # Junk goes and good documents stay, by the labels that none of this has seen.
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good, junk = ([got[i].kept for i in ids if labels.get(i) == q] for q in (1, 0))
    assert sum(good) >= 0.93 * len(good) and sum(junk) <= 0.05 * len(junk), (sum(good) / len(good), sum(junk) / len(junk))
