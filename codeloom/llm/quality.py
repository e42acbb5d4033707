"""Quality rules by weak supervision (operator 9), in DataFrame functions only.

Each rule votes good or bad, or abstains. Votes are counted by pattern (at most
3 ** rules rows, whatever the corpus), expectation-maximisation estimates every
rule's accuracy on each class from those counts, and a document's posterior
probability of being good is a sum of log odds over its votes.

Without labels, EM can also end where the classes stand for something else (long
and short, say). It is kept to its purpose by where it starts, by a weak pull
towards that, and by bounds: a rule is right about good documents in 55 % or more
of its votes, its vote for good is never evidence for bad, and half or more of the
documents are good. tests/llm/test_quality.py states what the bounds change.

Defined results: a null or empty text has no words and fails the base test;
repeated rows, and rows that share only the id or have none, are judged each on its
own; a posterior of exactly THRESHOLD keeps; an empty table gives no rows; texts of
any length are taken whole; other columns of the input, whatever their names, are
never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.shared import cut, documents, let

SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stops", "n_digits", "n_short")

MIN_WORDS = 50
#: A document with base_failed unset is dropped below this posterior.
THRESHOLD = 0.5


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows with equal 64-bit hashes are neighbours after a sort, and their words are compared."""
    same = lambda w, a, b: (F.get(w, a) == F.get(w, b)) & (F.get(w, a + 1) == F.get(w, b + 1)) & (F.get(w, a + 2) == F.get(w, b + 2))

    def of_windows(w: Column) -> Column:
        windows = F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )
        return let(F.sort_array(windows), lambda s: of_sorted(w, s))

    def of_sorted(w: Column, s: Column) -> Column:
        def equal(x: Column, j: Column) -> Column:
            y = F.get(s, j)
            return F.coalesce((y["h"] == x["h"]) & same(w, x["i"], y["i"]), F.lit(False))

        twice = F.filter(s, lambda x, j: equal(x, j + 1) | ((j > 0) & equal(x, F.greatest(j - 1, F.lit(0)))))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), of_starts)

    def of_starts(at: Column) -> Column:
        covered = F.transform(at, lambda x, j: F.least(F.coalesce(F.get(at, j + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(words, of_windows)


def signals(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` as the struct ``_row`` with the signals of its text beside it."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    raw = F.coalesce(F.col("_row")[text], F.lit(""))
    bare = F.btrim(raw, F.lit(SPACE_CHARS))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))
    rows = rows.select("_row", words.alias("_w"), lines.alias("_l"))
    return rows.select(
        "_row",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(raw, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(raw, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count(raw, F.lit(r"[.!?]")).cast("long").alias("n_stops"),
        F.regexp_count(raw, F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.size(F.filter("_w", lambda x: (F.length(x) <= 3) & x.rlike(r"^\p{L}+$"))).cast("long").alias("n_short"),
    )


def votes() -> dict[str, Column]:
    """Each rule as 1 (good), 0 (bad) or -1 (abstains), from the signals."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, F.lit(0)).when(good, F.lit(1)).otherwise(F.lit(-1))

    symbols, repeats = F.col("n_symbols") / words, F.col("n_repeat_words") / words
    symbol_share = F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))
    short = F.col("n_short") / words
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    stops, digits = F.col("n_stops") / words, F.col("n_digits") / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "v_length": rule(F.col("n_words") >= 100, F.col("n_words") < MIN_WORDS),
        "v_word_length": rule(mean.between(3, 10), (mean < 2) | (mean > 14)),
        "v_symbols": rule(symbols <= 0.02, symbols > 0.1),
        "v_symbol_share": rule(symbol_share <= 0.005, symbol_share > 0.03),
        "v_short_words": rule(short >= 0.1, short < 0.04),
        "v_dup_lines": rule(dup <= 0.05, dup > 0.3),
        "v_repeats": rule(repeats <= 0.1, repeats > 0.3),
        "v_stops": rule(stops.between(0.02, 0.5), stops < 0.002),
        "v_digits": rule(digits <= 0.05, digits > 0.2),
    }


#: Where expectation-maximisation starts, and what it is drawn to with the weight of STRENGTH * documents:
#: a rule seldom condemns a good document, and sees only some of the ways in which one can be bad.
PRIOR, START, STRENGTH = 0.9, (0.95, 0.4), 1e-3


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 300) -> tuple[float, list[tuple[float, float]]]:
    """Prior of good and (accuracy on good, accuracy on bad) per rule.

    The estimates depend on shares of patterns, not on how many documents there
    are. A vote for good never counts as evidence for bad, nor the other way
    round, which keeps the classes from changing places.
    """
    prior, acc = PRIOR, [START] * n_rules
    strength = STRENGTH * sum(n for _, n in patterns)
    for _ in range(rounds if strength else 0):
        good_mass = bad_mass = 0.0
        hit = [[0.0, 0.0, 0.0, 0.0] for _ in range(n_rules)]  # right and cast on good, on bad
        for vote, n in patterns:
            p = n * posterior(vote, prior, acc)
            q = n - p
            good_mass += p
            bad_mass += q
            for h, v in zip(hit, vote, strict=True):
                if v >= 0:
                    h[1] += p
                    h[3] += q
                    if v:
                        h[0] += p
                    else:
                        h[2] += q
        new_prior = min(0.995, max(0.5, (good_mass + PRIOR * strength) / (good_mass + bad_mass + strength)))
        new = []
        for g, gn, b, bn in hit:
            good = min(0.995, max(0.55, (g + START[0] * strength) / (gn + strength)))
            new.append((good, min(0.995, max(1.005 - good, (b + START[1] * strength) / (bn + strength)))))
        moved = max([abs(new_prior - prior), *(abs(x - y) for a, b in zip(new, acc, strict=True) for x, y in zip(a, b, strict=True))])
        prior, acc = new_prior, new
        if moved < 1e-7:
            break
    return prior, acc


def log_odds(vote: int, accuracy: tuple[float, float]) -> float:
    good, bad = accuracy
    return 0.0 if vote < 0 else math.log(good / (1 - bad)) if vote else math.log((1 - good) / bad)


def posterior(vote: tuple[int, ...], prior: float, acc: list[tuple[float, float]]) -> float:
    x = math.log(prior / (1 - prior)) + sum(log_odds(v, a) for v, a in zip(vote, acc, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def judge(scored: DataFrame) -> DataFrame:
    """Adds quality_p, base_failed and kept to a table of signals; reads it twice."""
    rules = votes()
    counted = scored.groupBy(*[v.alias(k) for k, v in rules.items()]).count().collect()  # at most 3 ** len(rules) rows
    patterns = sorted((tuple(int(x) for x in r[:-1]), r[-1]) for r in counted)
    prior, acc = fit(patterns, len(rules))
    x = F.lit(math.log(prior / (1 - prior)))
    for column, a in zip(rules.values(), acc, strict=True):
        x = x + F.when(column == 1, log_odds(1, a)).when(column == 0, log_odds(0, a)).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    p = 1 / (1 + F.exp(-x))
    return scored.withColumns({"base_failed": failed, "quality_p": p}).withColumn("kept", ~F.col("base_failed") & (F.col("quality_p") >= THRESHOLD))


def quality_rules(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: signals, posterior and verdict."""
    found = signals(df.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    found = cut(found.select(F.col("_row")["doc_id"].alias("doc_id"), *SIGNALS), "signals")
    return judge(found)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that pass, with its own columns; null and empty texts go, repeated rows are judged alike."""
    return judge(cut(signals(df, text), "quality")).where("kept").select("_row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
