"""Token counts through a digest cache (operator 7).

A document's content, normalised in a way that cannot change its tokens, and the
tokenizer's files each have a digest. Counts are stored under that pair; only
contents that the cache lacks are encoded, each once however many documents
carry it, and their counts are appended to the cache. Digest rows of about a
hundred bytes are what is grouped and joined; texts move once, and only those of
the misses' representatives.

Defined results: null counts as the empty text (0 bytes, 0 tokens); repeated rows
give a row each; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import importlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.keys import NULL_ID
from codeloom.llm.pieces import PieceCache, blanks_part, piece_starts
from codeloom.llm.shared import cut, documents, new_path, writing
from codeloom.llm.words import table_slices, text_buffer

LIMIT = 2048
#: Texts handed to the tokenizer at once, in bytes; encodings take some hundred bytes a token.
ENCODE_BYTES = 512 << 10

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_path(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file and of the library's version."""
    kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{kind} {importlib.import_module(kind).__version__}".encode()).hexdigest()


_loaded: dict = {}


def load(path: str):
    """A function from texts to lists of ids; kept for the life of the worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _loaded[path] = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def load_counter(path: str):
    """A function from texts to numbers of ids."""
    if blanks_part(path):  # words are encoded once while they stay in a table of bounded size
        if (key := (path, "pieces")) not in _loaded:
            _loaded[key] = PieceCache(load(path))
        pieces = _loaded[key]

        def count(texts: list[str]) -> list[int]:
            data, offsets = text_buffer(pa.array(texts, pa.string()))
            starts = piece_starts(data, offsets)
            _, counts = pieces(data, starts, np.append(starts[1:], len(data))) if len(starts) else (None, np.zeros(0, np.int64))
            total = np.concatenate([[0], np.cumsum(counts)])
            return np.diff(total[np.searchsorted(starts, offsets)]).tolist()

        return count
    if path.endswith(".model"):
        encode = load(path)
        return lambda texts: [len(x) for x in encode(texts)]
    load(path)
    if (key := (path, "count")) not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[key] = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[key]


def normalised(text: Column, path: str) -> Column:
    """Content without differences that the tokenizer cannot see.

    A .json tokenizer whose normaliser turns each run of white space into one
    blank counts the same after runs of ASCII white space are collapsed; any
    other tokenizer gets the text as it is.
    """
    text = F.coalesce(text, F.lit(""))
    if path.endswith(".json"):
        import json

        with open(path, encoding="utf-8") as f:
            parts = json.load(f).get("normalizer") or {}
        if any(p.get("type") == "Replace" and p.get("pattern") == {"Regex": r"\s+"} and p.get("content") == " " for p in parts.get("normalizers", [parts])):
            return F.regexp_replace(text, r"[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]", " ")
    return text


def encode_misses(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(path)
        for batch in batches:
            for lo, hi, _, _ in table_slices(batch, "content", ENCODE_BYTES):
                counts = count(batch.column(1).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version, a row for each content."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def digested(df: DataFrame, path: str, id_column: str, text: str) -> DataFrame:
    """(doc_id, n_bytes, content, digest) of every row."""
    content = normalised(F.col(f"`{text}`"), path)
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long").alias("n_bytes"), content.alias("content"))
    return rows.withColumn("digest", F.unhex(F.sha2("content", 256)))


def append_counts(df: DataFrame, path: str, cache: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of all contents that the table ``cache`` lacks go there; (doc_id, n_bytes, digest) of every row."""
    spark, version = df.sparkSession, tokenizer_digest(path)
    rows = digested(df, path, id_column, text)
    keys = cut(rows.select("doc_id", "n_bytes", "digest"), "digests")
    # A null id is a representative like any other: it is compared as the least one.
    least = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    if not keys.groupBy("digest", "doc_id").count().where("count > 1").isEmpty():
        # Repeated rows meet in map tasks first, so that each content is encoded once and none fills a task.
        rows = rows.groupBy("digest", "doc_id").agg(F.first("content").alias("content"))
    misses = keys.groupBy("digest").agg(F.min(least).alias("least")).join(read_cache(spark, cache, version), "digest", "left_anti")
    picked = rows.withColumn("least", least).join(misses, ["digest", "least"], "left_semi").select("digest", "content")
    encoded = picked.mapInArrow(encode_misses(path), "digest binary, n_tokens long")
    with writing(spark):
        encoded.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    return keys


def count_tokens(df: DataFrame, path: str, cache: str, id_column: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; appends what it had to encode to the table ``cache``."""
    spark = df.sparkSession
    keys = append_counts(df, path, cache, id_column, text)
    # Written first, so that the join's two sides are plain exchanges and a frequent text's rows can be split.
    joined = keys.join(cut(read_cache(spark, cache, tokenizer_digest(path)), "counts"), "digest")
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table in two deliveries over one cache, which is empty before: half of the documents (by the hash of
    their ids) come first, and when all of them come, theirs and their copies' counts are found in it."""
    docs, path, cache = documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), new_path(spark, "token-cache")
    append_counts(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), path, cache)
    return count_tokens(docs, path, cache)
