"""Benchmark decontamination with training suffix arrays (operator 10).

Each task turns its shard of documents into word ids and sorts the shard's
suffixes; every benchmark suffix is then binary-searched in that order, word by
word, until its interval of equal training suffixes is empty. The interval at
the item's window length gives all places of a verbatim match, the depth at
which it runs empty the longest match. Documents never move: the only thing
sent to executors is the benchmark, in blocks of a bounded size.

A suffix whose first words begin no benchmark suffix can match none, so it is
left out before the sort. Words are compared by 64-bit hashes in the search and
byte by byte on the windows that it finds; the lengths of longest matches rest on
the hashes.

Defined results: a null or empty document has no words and is clean; a null or
empty item occurs nowhere; longest_match is 0 below LEAST_MATCH words; an item without an id is searched like others and
counts in n_hit and contaminated, but not in n_items and the digest; items that
share an id count once; repeated
documents are judged each on its own; empty tables give no rows (documents) or
only clean rows (benchmark).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.shared import documents
from codeloom.llm.words import LOWER, scan_words, table_slices, text_buffer

WINDOW = 10
#: Shorter runs of common words are no longest match.
LEAST_MATCH = 3
#: One broadcast block of the benchmark holds at most this many bytes of text; more text makes more blocks.
BLOCK_BYTES = 4 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "longest_match long, spans array<struct<start:long,end:long>>, items array<string>"
)
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
        ("longest_match", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())),
    ]
)


@dataclass
class Block:
    """A block of items: their words as ids into a sorted vocabulary of word hashes."""

    items: list[str | None]
    texts: list[bytes]
    vocab: np.ndarray
    ids: np.ndarray  # of all words; 1-based, 0 is no word
    starts: np.ndarray
    ends: np.ndarray  # byte ranges of the words in b"".join(texts)
    stop: np.ndarray  # for each word, where its item ends
    item_of: np.ndarray
    need: np.ndarray  # for each word, the window length of its item
    depth: int
    heads: np.ndarray  # sorted keys of the first ``depth`` words of every suffix that has them


def make_block(rows: list[tuple[str | None, str]], window: int) -> Block | None:
    data, offsets = text_buffer(pa.array([t for _, t in rows], pa.string()))
    w = scan_words(data, offsets)
    if not len(w.hashes):
        return None
    vocab, ids = np.unique(w.hashes, return_inverse=True)
    counts = w.counts
    item_of = np.repeat(np.arange(len(rows)), counts)
    stop = np.repeat(w.first[1:], counts)
    need = np.repeat(np.minimum(counts, window), counts)
    ids = ids.astype(np.int64) + 1
    depth = int(min(3, need.min()))
    at = np.arange(len(ids))
    at = at[at + depth <= stop]
    heads = np.unique(head_keys(ids, at, depth, len(vocab) + 1))
    low = LOWER[data]
    texts = [low[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(rows))]
    return Block([i for i, _ in rows], texts, vocab, ids, w.starts, w.ends, stop, item_of, need, depth, heads)


def head_keys(ids: np.ndarray, at: np.ndarray, depth: int, base: int) -> np.ndarray:
    """The first ``depth`` ids at each position as one number; depth * log2(base) stays below 63 by BLOCK_BYTES."""
    key = np.zeros(len(at), np.int64)
    for j in range(depth):
        key = key * base + ids[at + j]
    return key


def contains(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def lookup(vocab: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """1-based ids of the hashes in the vocabulary, 0 for others; a table on 16 bits spares most searches."""
    seen = np.zeros(1 << 16, bool)
    seen[(vocab >> np.uint64(48)).astype(np.int64)] = True
    ids = np.zeros(len(hashes), np.int64)
    maybe = np.flatnonzero(seen[(hashes >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocab, hashes[maybe]), len(vocab) - 1)
    ids[maybe] = np.where(vocab[at] == hashes[maybe], at + 1, 0)
    return ids


def search(ids: np.ndarray, stop: np.ndarray, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary-search every suffix of the block in the suffix array of a shard.

    ids, stop: ids of the shard's words and where each one's document ends.
    Returns the pairs (shard position, block position) of matches as long as the
    item's window, and the longest match that starts at each shard position.
    """
    longest = np.zeros(len(ids), np.int64)
    base = len(b.vocab) + 1
    sa = np.flatnonzero(ids)
    sa = sa[sa + b.depth <= stop[sa]]
    for j in range(1, b.depth):
        sa = sa[ids[sa + j] > 0]
    sa = sa[contains(b.heads, head_keys(ids, sa, b.depth, base))]
    test = np.arange(len(b.ids))
    sa_rank, test_rank = np.zeros(len(sa), np.int64), np.zeros(len(test), np.int64)
    found_sa, found_test, t = [], [], 0
    while len(sa) and len(test):
        # One more word: suffixes are sorted within their intervals, tests find theirs by binary search.
        step = np.where(sa + t < stop[sa], ids[np.minimum(sa + t, len(ids) - 1)], 0)
        key = sa_rank * base + step
        order = np.argsort(key, kind="stable")
        sa, key = sa[order], key[order]
        test_key = test_rank * base + np.where(test + t < b.stop[test], b.ids[np.minimum(test + t, len(b.ids) - 1)], -1)
        test_key[test + t >= b.stop[test]] = -1
        lo, hi = np.searchsorted(key, test_key, "left"), np.searchsorted(key, test_key, "right")
        live = (hi > lo) & (test_key >= 0)
        test, lo, hi = test[live], lo[live], hi[live]
        t += 1
        whole = np.flatnonzero(b.need[test] == t)
        if len(whole):
            n = hi[whole] - lo[whole]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found_sa.append(sa[np.repeat(lo[whole], n) + offset])
            found_test.append(np.repeat(test[whole], n))
        inside = np.zeros(len(sa) + 1, np.int64)
        np.add.at(inside, lo, 1)
        np.add.at(inside, hi, -1)
        keep = np.cumsum(inside[:-1]) > 0
        longest[sa[keep]] = t
        rank = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        test_rank, sa, sa_rank = rank[lo], sa[keep], rank[keep]
        # Ranks stay below the number of suffixes, so the next keys cannot overflow.
        used, sa_rank = np.unique(sa_rank, return_inverse=True)
        test_rank = np.searchsorted(used, test_rank)
    none = np.zeros(0, np.int64)
    return np.concatenate(found_sa or [none]), np.concatenate(found_test or [none]), longest


def hits_of(data: np.ndarray, w, b: Block, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Verified matches as (first word, words, item), and longest matches."""
    stop = np.repeat(w.first[1:], w.counts)
    at, test, longest = search(lookup(b.vocab, w.hashes), stop, b)
    size = b.need[test]
    if len(at):
        raw = LOWER[data]
        whole = b"".join(b.texts)
        good = np.ones(len(at), bool)
        for i, (p, q, n) in enumerate(zip(at.tolist(), test.tolist(), size.tolist(), strict=True)):
            k = (raw[w.starts[p] : w.ends[p + n - 1]].tobytes(), whole[b.starts[q] : b.ends[q + n - 1]])
            if (same := cache.get(k)) is None:
                same = cache[k] = k[0] == k[1] or _WORD.findall(k[0]) == _WORD.findall(k[1])
                if len(cache) > 50_000:
                    cache.clear()
            good[i] = same
        at, test, size = at[good], test[good], size[good]
    return at, size, b.item_of[test], longest


def scan(batches: Iterator[pa.RecordBatch], blocks) -> Iterator[pa.RecordBatch]:
    cache: dict = {}
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in table_slices(batch, batch.schema.names[1]):
            w = scan_words(data, offsets)
            n = hi - lo
            spans: list[list] = [[] for _ in range(n)]
            items: list[set] = [set() for _ in range(n)]
            longest = np.zeros(n, np.int64)
            cover = np.zeros(len(w.hashes) + 1, np.int64)
            for block in blocks:
                b = block.value
                at, size, item, length = hits_of(data, w, b, cache)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size, -1)
                for d, i in set(zip(w.doc_of(at).tolist(), item.tolist(), strict=True)):
                    if b.items[i] is not None:
                        items[d].add(b.items[i])
                some = np.flatnonzero(length >= LEAST_MATCH)
                np.maximum.at(longest, w.doc_of(some), length[some])
                if len(blocks) > 1:
                    block.unpersist_local()
            hit = np.cumsum(cover)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[w.first[1:]] - total[w.first[:-1]]
            for d in np.flatnonzero(n_hit):
                part = np.diff(np.concatenate([[0], hit[w.first[d] : w.first[d + 1]].astype(np.int8), [0]]))
                spans[d] = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(part == 1), np.flatnonzero(part == -1), strict=True)]
            listed = [sorted(x) for x in items]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, n).cast(pa.int64()), pa.array(w.counts), pa.array(n_hit), pa.array([len(x) for x in listed], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() if x else nothing for x in listed]),
                    pa.array(n_hit > 0), pa.array(longest), pa.array(spans, ARROW.field("spans").type), pa.array(listed, pa.list_(pa.string())),
                ],
                schema=ARROW,
            )


class SharedBlock:
    """A broadcast that a worker can forget again, so that one block at a time is in memory."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @property
    def value(self) -> Block:
        return self.broadcast.value

    def unpersist_local(self) -> None:
        self.broadcast.__dict__.pop("_value", None)


def block_rows(benchmark: DataFrame, id_column: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of bounded size; the driver holds one at a time."""
    rows, held = [], 0
    ids = F.col(f"`{id_column}`").cast("string").alias("item_id")
    for r in benchmark.select(ids, F.col(f"`{text}`").alias("text")).where("text IS NOT NULL").toLocalIterator():
        if rows and held + len(r.text) * 2 > block_bytes:
            yield rows
            rows, held = [], 0
        rows.append((r.item_id, r.text))
        held += len(r.text) * 2
    if rows:
        yield rows


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: its hit words, the items found and the longest verbatim match."""
    sc = docs.sparkSession.sparkContext
    made = (make_block(rows, window) for rows in block_rows(benchmark, item_column, item_text, block_bytes))
    blocks = [SharedBlock(sc.broadcast(b)) for b in made if b is not None]
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(lambda it: scan(it, blocks), SCHEMA)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark; null and empty texts and all other columns pass through."""
    sc = docs.sparkSession.sparkContext
    made = (make_block(rows, window) for rows in block_rows(benchmark, item_column, item_text, block_bytes))
    blocks = [SharedBlock(sc.broadcast(b)) for b in made if b is not None]
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int64)), batch.column(at)], names=["doc_id", "text"])
            bad = np.concatenate([np.asarray(x.column(5)) for x in scan(iter([pair]), blocks)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(~bad.astype(bool)))

    return docs.mapInArrow(clean, docs.schema)


def benchmark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, the longest match, and the hit runs as text (first word-end word, comma-joined)."""
    places = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return find_contamination(documents(spark, sf_dir), benchmark_table(spark, sf_dir)).drop("items").withColumn("spans", places)
