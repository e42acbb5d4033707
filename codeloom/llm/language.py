"""Language identification with string kernels (operator 8).

Kernel: blended spectrum of presence. phi(x) marks which byte n-grams of 1 to 3
bytes occur in the lower-cased text, over all those that two landmarks or more have
(one, with few landmarks), and k(x, y) = <phi(x), phi(y)> / sqrt(|phi(x)| |phi(y)|). The kernel is
approximated by Nystroem features on landmark documents, and one-versus-rest
ridge regressions are fitted on those features. The regression weights are folded
into the landmark matrix once (the product is associative), so that a batch of
documents is scored by one product of its presence matrix with a matrix of
n-grams by languages.

Fitting uses a bounded sample of labelled rows: FIT_ROWS in all, or four for each
language if that is more, alike for all languages, with the smallest hashes of ids
and texts, of texts of at most FIT_CHARS. Every language is learnt and every
document is predicted from its whole text.

Defined results: lang_pred is ``und`` with score 0 if the text is null, empty or
has no letter, or if nothing could be learnt; of equal scores the
language first by name is taken; repeated rows give a row each; rows without an id
are held out; an empty table gives no rows; other columns are never read. With one
language in the training rows, it is predicted everywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.shared import documents
from codeloom.llm.words import LOWER, slices, table_slices, text_buffer

FIT_ROWS = 1600
FIT_CHARS = 20_000
LANDMARKS = 400
RIDGE = 1e-3
#: Documents scored by one product.
SCORE_ROWS = 256
TEMPERATURE = 8.0
#: Languages whose sampling rates are broadcast; more are joined by shuffling.
MOST_BROADCAST = 100_000


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # sorted codes of the n-grams, a column each
    weights: np.ndarray  # columns x languages
    bias: np.ndarray

    @cached_property
    def table(self) -> np.ndarray:
        return column_table(self.grams)

    def __getstate__(self):
        # The table is made anew in each worker.
        return {k: v for k, v in self.__dict__.items() if k != "table"}


#: Where the codes of 1-, 2- and 3-grams begin.
_AT = (0, 1 << 8, (1 << 8) + (1 << 16))
_CODES = _AT[2] + (1 << 24)


def column_table(grams: np.ndarray) -> np.ndarray:
    """n-gram code -> column + 1, or 0."""
    table = np.zeros(_CODES, np.uint16 if len(grams) < 1 << 16 else np.uint32)
    table[grams] = np.arange(1, len(grams) + 1)
    return table


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(code, document) of all 1-, 2- and 3-grams of bytes inside documents."""
    low = LOWER[data].astype(np.int32)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    out = [(low, doc)]
    if len(low) > 1:
        same = doc[1:] == doc[:-1]
        out.append((((low[:-1] << 8) | low[1:])[same] + _AT[1], doc[1:][same]))
    if len(low) > 2:
        same = doc[2:] == doc[:-2]
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        out.append((code[same] + _AT[2], doc[2:][same]))
    return out


def presence(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, columns: int) -> np.ndarray:
    """Presence matrix of a slice, rows scaled to unit length."""
    x = np.zeros((len(offsets) - 1, columns), np.float32)
    flat = x.reshape(-1)
    for code, doc in gram_codes(data, offsets):
        col = table[code].astype(np.int64)
        inside = col > 0
        flat[doc[inside].astype(np.int64) * columns + col[inside] - 1] = 1
    norm = np.sqrt(x.sum(1))
    x /= np.maximum(norm, 1)[:, None]
    return x


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on (text, language) rows in the order given."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    by = {lang: [t for t, x in rows if x == lang] for lang in languages}
    share = max(1, landmarks // len(languages))
    marks = [t for lang in languages for t in by[lang][:share]]
    data, offsets = text_buffer(pa.array(marks, pa.string()))
    seen: dict[int, int] = {}
    for code, doc in gram_codes(data, offsets):
        pair = np.unique(code.astype(np.int64) * len(marks) + doc)
        values, n = np.unique(pair // len(marks), return_counts=True)
        seen |= dict(zip(values.tolist(), n.tolist(), strict=True))
    least = 2 if len(marks) > 8 else 1
    grams = np.array(sorted(g for g, n in seen.items() if n >= least), np.int64)
    table, columns = column_table(grams), len(grams)

    def features(texts: list[str]) -> Iterator[np.ndarray]:
        d, o = text_buffer(pa.array(texts, pa.string()))
        for lo, hi in slices(o, 1 << 20):
            yield presence(d[o[lo] : o[hi]], o[lo : hi + 1] - o[lo], table, columns)

    mark_x = np.concatenate(list(features(marks)))
    values, vectors = np.linalg.eigh((mark_x @ mark_x.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    project = vectors[:, good] / np.sqrt(values[good])
    texts = [t for t, _ in rows]
    z = np.concatenate([x @ mark_x.T for x in features(texts)]).astype(np.float64) @ project
    y = np.where(np.array([[lang == x for x in languages] for _, lang in rows]), 1.0, -1.0)
    weight = 1 / np.array([len(by[lang]) for _, lang in rows])  # each language counts alike
    weight = weight / weight.sum()
    mean, target = weight @ z, weight @ y
    zc = z - mean
    w = np.linalg.solve((zc * weight[:, None]).T @ zc + ridge * np.eye(z.shape[1]), (zc * weight[:, None]).T @ (y - target))
    return Model(languages, grams, (mark_x.T.astype(np.float64) @ (project @ w)).astype(np.float32), (target - mean @ w).astype(np.float32))


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Input columns: doc_id, held_out, text (null where there is no letter)."""
    m: Model | None = model.value
    for batch in batches:
        empty = np.asarray(batch.column(2).is_null())
        for lo, hi, data, offsets in table_slices(batch, "content", 1 << 20):
            n = hi - lo
            names = np.full(n, "und", object)
            score = np.zeros(n)
            if m is not None:
                for a in range(0, n, SCORE_ROWS):  # bounds the presence matrix where texts are short
                    b = min(n, a + SCORE_ROWS)
                    x = presence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], m.table, len(m.weights))
                    f = x @ m.weights + m.bias
                    e = np.exp(TEMPERATURE / 2 * (f - f.max(1, keepdims=True)))
                    best = f.argmax(1)
                    score[a:b] = e[np.arange(b - a), best] / e.sum(1)
                    names[a:b] = np.array(m.languages, object)[best]
                names[empty[lo:hi]], score[empty[lo:hi]] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


def sample_rows(labelled: DataFrame, rows: int = FIT_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` of (content, lang), alike for each language, in a fixed order; ``labelled`` has doc_id too."""
    eligible = labelled.where(F.col("content").isNotNull() & (F.char_length("content") <= FIT_CHARS))
    h = F.xxhash64("doc_id", "content")
    counts = eligible.groupBy("lang").count()
    n = counts.count()
    if not n:
        return []
    share = max(4, rows // n)
    # A hash threshold per language takes about one and a half times its share; the driver keeps the smallest hashes.
    small = F.broadcast if n <= MOST_BROADCAST else lambda x: x
    rates = counts.select("lang", F.least(F.lit(1.0), 1.5 * share / F.col("count")).alias("rate"))
    near = eligible.withColumn("h", h).withColumn("u", F.pmod(F.col("h"), F.lit(1 << 30)) / (1 << 30)).join(small(rates), "lang")
    got = near.where("u < rate OR rate = 1").select("h", "content", "lang").orderBy("h", "content", "lang").collect()
    out: dict[str, list] = {r.lang: [] for r in got}
    for r in got:
        if len(out[r.lang]) < share:
            out[r.lang].append((r.content, r.lang))
    return [x for lang in sorted(out) for x in out[lang]]


def identify(df: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    sc = df.sparkSession.sparkContext
    content = F.col(f"`{text}`")
    df = df.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.when(content.rlike(r"\p{L}"), content).alias("content"),
        F.col(f"`{lang}`").alias("lang"),
    ).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True)))
    model = fit(sample_rows(df.where(~F.col("held_out") & F.col("lang").isNotNull()), rows))
    sent = sc.broadcast(model)
    return df.select("doc_id", "held_out", "content").mapInArrow(lambda it: predict(it, sent), "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
