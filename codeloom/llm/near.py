"""N-gram Jaccard join by MinHash banding (operator 6).

Sets are the five-word shingles of a text's lower-cased words. Rows and bands
come from the recall that is asked for at the threshold. Documents with equal
word sequences are one form and go on as one row. Band hashes of forms are
grouped, each group is tied to its least member, and connected components of
those ties tell which forms can be linked at all. The texts of a component of
up to one block move once, to one task, where pairs that share a band are
verified on their full shingle sets. A larger component (near copies, or unlike
documents chained by what they have in common) is taken apart into its band
groups: texts move once for each group of two or more that they are in, groups
beyond a block to the pairs of their blocks, and a pair is verified in the first
band it shares. So only documents with an equal band are ever compared. Links
are counted and merged where they are verified: no pair is ever written out.

Result, a row for each input row: doc_id; copy_of, the least doc_id of equal
word sequence; class_id, the least doc_id of its class of linked documents;
n_links, the other documents at or above the threshold, copies included.

Defined results: texts with 1 to 4 words have one shingle, all their words; a
text without words (null, empty) is alone in its class with no links; repeated
rows are copies of each other; rows that share only the id (or have none) are
different documents; an empty table gives no rows; texts of any length are taken
whole; pairs exactly at the threshold are linked; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.graph import components
from codeloom.llm.keys import Keyed, key_rows, real_id
from codeloom.llm.shared import cut, documents
from codeloom.llm.words import mix, ngrams, scan_words, table_slices

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
#: A task compares at most so many forms, or bytes of their texts, with each other; larger components are split into blocks.
BLOCK_DOCS = 256
BLOCK_BYTES = 16 << 20

SLICE = 1 << 20


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach ``recall`` at ``threshold`` within the hash budget."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 20):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS):
    """(hashes, offsets by document, words): shingles of a slice; short texts have one made of all their words."""
    w = scan_words(data, offsets)
    h, at = ngrams(w, n)
    first = np.searchsorted(at, w.first)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        extra = np.array([mix(np.array([np.bitwise_xor.reduce(w.hashes[w.first[d] : w.first[d + 1]] * (np.arange(w.counts[d]).astype(np.uint64) * np.uint64(2) + np.uint64(3)))]))[0] for d in short], np.uint64)
        h = np.insert(h, first[short], extra)
        first = first + np.concatenate([[0], np.cumsum((w.counts > 0) & (w.counts < n))])
    return h, first, w


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(977).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(h: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Documents x bands; documents without shingles get zeros."""
    out = np.zeros((len(first) - 1, bands), np.uint64)
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return out.view(np.int64)
    starts, mult = first[some], multipliers(bands * rows)
    for b in range(bands):
        acc = np.full(len(some), b + 1, np.uint64)
        for r in range(rows):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * mult[b * rows + r], starts))
        out[some, b] = acc
    return out.view(np.int64)


def forms_of(w) -> list[bytes | None]:
    """16 bytes that identify each document's word sequence; None without words."""
    n = len(w.hashes)
    total = []
    for base in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        x = np.full(n + 1, base, np.uint64)
        x[0] = 1
        up = np.multiply.accumulate(x)
        inverse = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        down = np.multiply.accumulate(inverse)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes * up[:n])])
        total.append(mix((sums[w.first[1:]] - sums[w.first[:-1]]) * down[w.first[:-1]] + w.counts.astype(np.uint64)))
    both = np.stack(total, 1).tobytes()
    return [both[16 * i : 16 * i + 16] if c else None for i, c in enumerate(w.counts.tolist())]


def sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in table_slices(batch, "content", SLICE):
            h, first, w = shingles(data, offsets)
            keys = band_hashes(h, first, bands, rows)
            flat = pa.array(keys.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), flat)
            size = pa.array(np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(forms_of(w), pa.binary()), size, lists], names=["doc_id", "form", "size", "bands"])


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def verify(texts: pa.Array, copies: np.ndarray, group: np.ndarray, band: np.ndarray, block: np.ndarray, cross: np.ndarray, bands: int, rows: int, threshold: float) -> tuple[np.ndarray, list[int]]:
    """Links of each form, weighted by the partner's copies, and each form's least linked member (by position).

    Forms are compared within their group; in the group of a band only if it is the
    first band they share (band -1: if they share any), and in a pair of blocks
    (``cross``) only across the two.
    """
    from codeloom.llm.words import text_buffer

    data, offsets = text_buffer(texts)
    h, first, _ = shingles(data, offsets)
    keys = band_hashes(h, first, bands, rows)
    m = len(first) - 1
    _, ids = np.unique(h, return_inverse=True)
    pair = np.unique(np.repeat(np.arange(m), np.diff(first)) * (ids.max(initial=0) + 1) + ids)
    doc, ids = np.divmod(pair, ids.max(initial=0) + 1)
    at = np.searchsorted(doc, np.arange(m + 1))
    size = np.diff(at)
    mark = np.zeros(int(ids.max(initial=0)) + 1, bool)
    links, forest = np.zeros(m, np.int64), Forest(m)
    for lo in range(0, m, 128):
        hi = min(m, lo + 128)
        near, seen = np.zeros((hi - lo, m - lo), bool), np.zeros((hi - lo, m - lo), bool)
        own = band[lo:hi, None]
        for b in range(bands):
            equal = keys[lo:hi, b, None] == keys[None, lo:, b]
            near |= equal & ((own < 0) | ((own == b) & ~seen))
            seen |= equal
        near &= group[lo:hi, None] == group[None, lo:]
        near &= ~((cross[lo:hi, None]) & (block[lo:hi, None] == block[None, lo:]))
        for p in range(lo, hi):
            q = np.flatnonzero(near[p - lo, p - lo + 1 :]) + p + 1
            # |A & B| / |A | B| cannot reach the threshold if the sizes are too far apart.
            q = q[(np.minimum(size[q], size[p]) >= threshold * np.maximum(size[q], size[p])) & (size[q] > 0)]
            if not len(q):
                continue
            mine = ids[at[p] : at[p + 1]]
            mark[mine] = True
            n = size[q]
            start = np.concatenate([[0], np.cumsum(n)])
            both = np.add.reduceat(mark[ids[np.arange(start[-1]) + np.repeat(at[q] - start[:-1], n)]].astype(np.int64), start[:-1])
            mark[mine] = False
            q = q[both >= threshold * (n + size[p] - both) - 1e-9]
            links[p] += copies[q].sum()
            links[q] += copies[p]
            for x in q.tolist():
                forest.join(p, x)
    return links, [forest.find(i) for i in range(m)]


def verify_groups(batches: Iterator[pa.RecordBatch], bands: int, rows: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (grp, band, i, j); whole groups are compared, small ones together."""

    def flush(parts: list[pa.RecordBatch], sizes: list[int]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        order = np.argsort(np.asarray(t["rep"]), kind="stable")
        group = np.repeat(np.arange(len(sizes)), sizes)[order]
        t = t.take(pa.array(order)).combine_chunks()
        i, j = np.asarray(t["i"]), np.asarray(t["j"])
        links, least = verify(t["content"], np.asarray(t["copies"]), group, np.asarray(t["band"]), np.asarray(t["block"]), i != j, bands, rows, threshold)
        rep = np.asarray(t["rep"])
        return pa.RecordBatch.from_arrays([t["form"].combine_chunks(), pa.array(rep), pa.array(links), pa.array(rep[np.array(least, np.int64)]), t["split"].combine_chunks()], names=["form", "rep", "links", "least", "split"])

    held: list[pa.RecordBatch] = []
    sizes: list[int] = []
    held_rows = held_bytes = 0
    last = None
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("grp", "band", "i", "j")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            key = tuple(keys[a])
            part = batch.slice(a, b - a)
            across = key[2] != key[3]
            if held and key != last and (held_rows + part.num_rows > 1024 or held_bytes > (4 << 20) or across):
                yield flush(held, sizes)
                held, sizes, held_rows, held_bytes = [], [], 0, 0
            held.append(part)
            if key == last and sizes:
                sizes[-1] += part.num_rows
            else:
                sizes.append(part.num_rows)
            held_rows += part.num_rows
            held_bytes += int(np.asarray(part.column(part.schema.get_field_index("size"))).sum())
            last = key
            if across:
                held_rows = 1 << 30  # a pair of blocks is compared by itself
    if held:
        yield flush(held, sizes)


def blocks_of(n, size, block_docs: int, block_bytes: int):
    return F.greatest(F.ceil(n / block_docs), F.ceil(size / block_bytes)).cast("int")


def near_classes(keyed: Keyed, threshold: float, recall: float, block_docs: int, block_bytes: int) -> DataFrame:
    """(doc_id, rep, copies, least, links) by row of ``keyed``: its form's least document, its class's least one, and links; nulls without words or links."""
    bands, rows = plan_bands(threshold, recall)
    signed = cut(keyed.rows.select("doc_id", "content").mapInArrow(lambda it: sign(it, bands, rows), "doc_id long, form binary, size long, bands array<long>"), "signed")
    forms = signed.where("form IS NOT NULL").groupBy("form").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.max("size").alias("size"))
    forms = cut(forms, "forms")

    # Spark judges a side's size before its lists are laid out: without the hint it broadcasts the bands of all forms.
    banded = forms.select("rep", F.explode("bands").alias("key")).hint("merge")
    groups = banded.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = banded.join(groups, "key").where("rep != lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    roots = components(ties)

    member = forms.join(roots.withColumnRenamed("node", "rep"), "rep")
    sizes = member.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    member = cut(member.join(sizes.select("root", (blocks_of(F.col("n"), F.col("bytes"), block_docs, block_bytes) > 1).alias("split")), "root"), "member")
    place = lambda grp, band, block, blocks: F.struct(F.col(grp).alias("grp"), band.cast("int").alias("band"), block.cast("int").alias("block"), blocks.cast("int").alias("blocks"))
    places = member.where("NOT split").select("rep", F.array(place("root", F.lit(-1), F.lit(0), F.lit(1))).alias("places"))
    large = member.where("split").select("rep", "form", "size", F.posexplode("bands").alias("band", "key")).hint("merge")
    if not large.isEmpty():
        sums = large.groupBy("key").agg(
            F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("band").alias("band"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y")
        )
        # Of bands' groups with the same members only the first can be the first band of a pair.
        sums = sums.where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("first"), F.first("bytes").alias("bytes"))
        sums = sums.select(F.col("first.key").alias("key"), blocks_of(F.col("n"), F.col("bytes"), block_docs, block_bytes).alias("blocks"))
        there = large.join(sums, "key").select("rep", place("key", F.col("band"), F.pmod(F.xxhash64("form"), F.col("blocks")), F.col("blocks")).alias("p"))
        places = places.union(there.groupBy("rep").agg(F.collect_list("p").alias("places")))
    texts = keyed.texts().withColumnRenamed("doc_id", "rep").hint("merge").join(member.select("rep", "form", "copies", "size", "split").join(places.hint("merge"), "rep"), "rep")
    # A pair of blocks (i, j) gets the forms of both; a block is compared within itself at (i, i).
    spread = texts.withColumn("p", F.explode("places")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)))
    spread = spread.select("p.grp", "p.band", F.least("p.block", "other").alias("i"), F.greatest("p.block", "other").alias("j"), "p.block", "rep", "copies", "size", "split", "content", "form")
    placed = spread.repartition("grp", "band", "i", "j").sortWithinPartitions("grp", "band", "i", "j")
    found = placed.mapInArrow(lambda it: verify_groups(it, bands, rows, threshold), "form binary, rep long, links long, least long, split boolean")
    found = cut(found, "links")

    links = found.groupBy("form").agg(F.sum("links").alias("links"), F.min("least").alias("least"))
    if not found.where("split").isEmpty():
        merged = components(found.where("split").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct())
        links = links.join(merged.withColumnRenamed("node", "least"), "least", "left").select("form", "links", F.coalesce("root", "least").alias("least"))
    # Written first, so that the join's two sides are plain exchanges and a frequent form's rows can be split.
    classes = cut(forms.select("form", "rep", "copies").join(links, "form", "left"), "classes")
    return signed.select("doc_id", "form").join(classes.hint("merge"), "form", "left").drop("form")


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL,
    block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, copy_of, class_id, n_links for every row of ``df``."""
    keyed = key_rows(df, id_column, text)
    out = near_classes(keyed, threshold, recall, block_docs, block_bytes).select(
        "doc_id", F.coalesce("rep", "doc_id").alias("copy_of"), F.coalesce("least", "rep", "doc_id").alias("class_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    for column in ("copy_of", "class_id", "doc_id"):
        out = real_id(out, keyed.names, column)
    return out.select("doc_id", "copy_of", "class_id", "n_links")


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each class the document with the least id stays.

    Rows that share id and text are one document, of which one row stays (that with
    the least hash of all its columns); rows that share only the id, or have none, are
    different documents; texts without words (null, empty) stay; an empty table gives
    no rows; other columns, whatever their names, pass through.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    keyed = key_rows(df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"), row), "id", "text", ("row",))
    classes = near_classes(keyed, THRESHOLD, RECALL, BLOCK_DOCS, BLOCK_BYTES)
    kept = classes.where(F.coalesce("least", "rep", "doc_id") == F.col("doc_id")).select("doc_id")
    rows = keyed.rows.select("doc_id", "row").join(kept.distinct() if keyed.repeated else kept, "doc_id", "left_semi")
    if keyed.repeated:
        plain = [F.col("row").getField(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        rows = rows.groupBy("doc_id").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return rows.select("row.*")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
