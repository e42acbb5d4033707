import random

import numpy as np
import pyarrow as pa

from codeloom.llm import language as L
from codeloom.llm.words import text_buffer

SYLLABLES = {"aa": ["ba", "ko", "mi", "tun"], "bb": ["ské", "řa", "vo", "dů"], "cc": ["ging", "the", "sch", "und"]}


def make(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 80)))
        rows.append((i, text, lang, "src"))
    return rows


def test_held_out_accuracy(spark):
    rows = make(600) + [(1000, None, "aa", ""), (1001, "", "aa", ""), (1002, "123 ... !", "bb", ""), (1003, "tun mi " * 50_000, None, ""), (5, "ské řa vo", "bb", "")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, source string, score double")
    got = L.identify(df).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[0] < 600 and r[0] != 5}
    checked = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(checked) > 60 and sum(r.lang_pred == truth[r.doc_id] for r in checked) / len(checked) > 0.98
    assert all(r.held_out == L.held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in got if r.doc_id >= 1000}
    assert [odd[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = make(300)
    a = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    b = spark.createDataFrame([(i, t, "zz" if L.held_out(i) else x, s) for i, t, x, s in rows], a.schema)
    assert sorted(L.identify(a).collect()) == sorted(L.identify(b).collect())


def test_folded_weights_equal_kernel_scores():
    rows = [(t, x) for _, t, x, _ in make(90)]
    m = L.fit(rows, landmarks=30, ridge=1e-2)
    d, o = text_buffer(pa.array([t for t, _ in rows]))
    grams = [{c for code, doc in L.gram_codes(d, o) for c in code[doc == i].tolist() if m.table[c]} for i in range(len(rows))]
    marks = [i for x in m.languages for i in [j for j, (_, y) in enumerate(rows) if y == x][:10]]
    k = np.array([[len(g & grams[j]) / max(1, len(g) * len(grams[j])) ** 0.5 for j in marks] for g in grams])
    x = L.presence(d, o, m.table, len(m.weights))
    lx = x[marks]
    assert np.allclose(k, x @ lx.T, atol=1e-5)


def test_scores_equal_brute_force(spark):
    """Kernel matrices of Python sets, the Nystroem features' ridge regression in its dual form, and the scores of the whole operator."""
    rows = make(260, seed=4) + [(900, "Tun MI ba", "aa", "")]
    train = [(i, t, x) for i, t, x, _ in rows if not L.held_out(i)]
    # All training rows are in the sample; the operator sorts them by language, then by hash.
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    sample = L.sample_rows(df.select("doc_id", "lang", df.text.alias("content")).where(df.doc_id.isin([i for i, _, _ in train])))
    assert sorted(sample) == sorted((t, x) for _, t, x in train)
    names = sorted({x for _, x in sample})
    marks = [t for x in names for t in [s for s, y in sample if y == x][: L.LANDMARKS // len(names)]]

    def grams(t):
        b = t.encode().lower() if t.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    seen = {}
    for m in marks:
        for g in grams(m):
            seen[g] = seen.get(g, 0) + 1
    known = {g for g, n in seen.items() if n >= 2}

    def kernel(xs, ys):
        a, b = [grams(x) & known for x in xs], [grams(y) & known for y in ys]
        return np.array([[len(x & y) / max(1, len(x) * len(y)) ** 0.5 for y in b] for x in a])

    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-6 * values[-1]
    project = vectors[:, good] / np.sqrt(values[good])
    texts = [t for t, _ in sample]
    z = kernel(texts, marks) @ project
    y = np.array([[1.0 if x == n else -1.0 for n in names] for _, x in sample])
    p = np.array([1 / sum(v == x for _, v in sample) for _, x in sample])
    p = p / p.sum()
    root = np.sqrt(p)[:, None]
    zc, yc = root * (z - p @ z), root * (y - p @ y)
    w = zc.T @ np.linalg.solve(zc @ zc.T + L.RIDGE * np.eye(len(zc)), yc)
    f = (kernel([t for _, t, _, _ in rows], marks) @ project - p @ z) @ w + p @ y
    e = np.exp(L.TEMPERATURE / 2 * f)
    want = {i: (names[k], v) for (i, *_), k, v in zip(rows, f.argmax(1), (e.max(1) / e.sum(1)), strict=True)}
    for r in L.identify(df).collect():
        assert abs(r.score - want[r.doc_id][1]) < 2e-3 and (r.lang_pred == want[r.doc_id][0] or r.score < 0.6)


def test_no_language_is_left_out(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i % 1300} " * 4, f"l{i % 1300}") for i in range(6500)]
    df = spark.createDataFrame(rows, "doc_id long, content string, lang string")
    assert len({x for _, x in L.sample_rows(df)}) == 1300


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.identify(df).collect()[0].lang_pred == "und"
    assert L.identify(df.limit(0)).count() == 0
