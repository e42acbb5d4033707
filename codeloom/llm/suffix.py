"""Exact substring dedup over common-prefix interval trees (operator 3).

Every string of ``length`` bytes holds an anchor, chosen by its own bytes alone:
its K-gram with the least hash. Strings that are equal therefore meet at equal
anchors, and a repeat is found inside the windows of bytes around them that
strings of that length can reach (its contexts); longer repeats come out as
overlapping pieces.

1. Anchors are grouped by their context's hash. In each class of equal contexts
   all but the first are repeats from end to end; the first one goes on if its
   anchor has other contexts too.
2. Per anchor, the contexts that are left form a sorted suffix array, of the
   suffixes that begin at the anchor, with the lengths of common prefixes
   between neighbours. A stack scan lists the tree of its intervals; inside an
   interval the same scan over the extensions to the left tells which of its
   subsets extend differently (left-extension diversity) and so are maximal
   repeats, with all their occurrences. All but the first occurrence of a group
   of ``length`` bytes or more are removed.
3. An anchor with more than LIMIT contexts is split: each occurrence goes to the
   groups of the longer strings around it that its windows can share (four
   ranges of offsets), and where even such a group is too large, to its single
   windows, for which a minimum per hash is enough.

First means the smallest document id, then the smallest start. Texts move twice:
to fetch contexts, and to cut what is removed.

Defined results: null is the empty text; nothing crosses documents; rows that
share id and text are one document and get the same result; rows that share only
the id (or have none) are different documents, in the order of their texts'
hashes; a null id comes before all others; an empty table gives no rows; texts
of any length are treated whole; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.keys import key_rows
from codeloom.llm.shared import cut, documents
from codeloom.llm.words import Prefix, mix, ragged, table_slices

LENGTH = 100
K = 32
#: Contexts of one anchor that are compared in one task.
LIMIT = 1024
RANGES = 4
SLICE = 2 << 20


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every window of ``width`` values, by doubling."""
    step = 1
    while step * 2 <= width:
        x = op(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position in the buffer, hash, left bytes, right bytes) of the anchors of a slice.

    left and right are the bytes of the context before the anchor and after its K bytes.
    """
    n, width = len(data), length - K + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, np.zeros(0, np.uint64), none, none
    p = Prefix(data)
    count = n - K + 1
    h = (p.sums[K:] - p.sums[:count]) * p.down[:count]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    # K-grams across documents get the greatest value, and windows across documents choose nothing.
    top = np.uint32(0xFFFFFFFF)
    short = np.minimum((h >> np.uint64(32)).astype(np.uint32), top - np.uint32(1))
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    for back in range(1, K):
        at = edge - back
        short[at[(at >= 0) & (at < count)]] = top
    least = sliding(short, width, np.minimum)
    for back in range(1, length):
        at = edge - back
        least[at[(at >= 0) & (at < len(least))]] = 0
    pad = np.zeros(width - 1, np.uint32)
    chosen = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero((short == chosen) & (short != top))
    doc = np.searchsorted(offsets, at, "right") - 1
    left = np.minimum(at - offsets[doc], width - 1)
    right = np.minimum(offsets[doc + 1] - at - K, width - 1)
    good = left + right + K >= length
    at, doc, left, right = at[good], doc[good], left[good], right[good]
    return doc, at, mix(h[at]), left, right


def context_hash(p: Prefix, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    shape = (left * 4096 + right).astype(np.uint64)
    return mix(p.ranges(at - left, at + K + right) + shape * np.uint64(0x9E3779B97F4A7C15))


#: kind 0: an anchor (h, ctx, doc_id, start = its position, a and b = context before and after); kind 1: bytes start..a of doc_id are repeats.
ANCHORS = "kind int, h long, ctx long, doc_id long, start long, a long, b long"
_ANCHORS = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("h", "ctx", "doc_id", "start", "a", "b")]])


def anchor_rows(kind: int, h, ctx, doc, start, a, b) -> pa.RecordBatch:
    signed = lambda x: np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), *(pa.array(signed(x)) for x in (h, ctx, doc, start, a, b))], schema=_ANCHORS)


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans by document, sorted."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new_doc = np.r_[True, doc[1:] != doc[:-1]]
    # A running maximum of ends that starts anew with each document.
    shift = (np.cumsum(new_doc) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = new_doc | np.r_[True, start[1:] + shift[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return doc[at], start[at], (reach - shift)[np.r_[at[1:] - 1, len(doc) - 1]]


def scan_anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Anchors of each slice; of equal contexts within it only the first is sent on."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for lo, hi, data, offsets in table_slices(batch, "content", SLICE):
            doc, at, h, left, right = anchors(data, offsets, length)
            if not len(doc):
                continue
            ctx = context_hash(Prefix(data), at, left, right)
            name = ids[lo:hi][doc]
            start = at - offsets[doc]
            order = np.lexsort((start, doc, name, ctx, h))
            same = (h[order][1:] == h[order][:-1]) & (ctx[order][1:] == ctx[order][:-1])
            first = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0))
            head = order[first]
            later = (name[order] > name[head]) | ((doc[order] == doc[head]) & (order != head))
            gone, stay = order[later], np.sort(order[~later])
            yield anchor_rows(0, h[stay], ctx[stay], name[stay], start[stay], left[stay], right[stay])
            d, s, e = merge_spans(name[gone], start[gone] - left[gone], start[gone] + K + right[gone])
            if len(d):
                spread = mix(d.astype(np.uint64) * np.uint64(31) + s.astype(np.uint64))
                yield anchor_rows(1, spread, np.zeros(len(d), np.int64), d, s, e, np.zeros(len(d), np.int64))


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, ctx, doc_id): spans of later members of a class, and firsts of classes whose anchor has several."""
    last_h = last_ctx = first_doc = None
    held = None  # the first class's row while its anchor has no other class
    for batch in batches:
        kind = np.asarray(batch.column(0))
        if (kind == 1).any():
            yield batch.filter(pa.array(kind == 1))
        cols = [np.asarray(batch.column(i))[kind == 0] for i in range(1, 7)]
        h, ctx, doc, start, a, b = cols
        if not len(h):
            continue
        new_h = np.r_[last_h is None or h[0] != last_h, h[1:] != h[:-1]]
        new_c = new_h | np.r_[last_ctx is None or ctx[0] != last_ctx, ctx[1:] != ctx[:-1]]
        cls = np.flatnonzero(new_c)
        if first_doc is None:
            first_doc = doc[0]
        firsts = np.concatenate([[first_doc], doc[cls]])[np.cumsum(new_c)]
        later = np.flatnonzero(doc > firsts)
        # Classes per anchor; the first group may have begun in an earlier batch.
        group = np.cumsum(new_h[cls])
        sizes = np.bincount(group, minlength=int(group.max(initial=0)) + 1)
        if held is not None and sizes[0]:
            yield held
        # All classes of a group that has two or more, or goes on from before (then it has others already).
        out = cls[(sizes[group] > 1) | (group == 0)]
        if new_h.any():
            held = None
        elif held is not None and sizes[0]:
            held = None
        if len(out):
            yield anchor_rows(0, *(x[out] for x in cols))
        if len(later):
            yield anchor_rows(1, h[later], ctx[later], doc[later], start[later] - a[later], start[later] + K + b[later], b[later])
        if len(group) and group[-1] > 0 and sizes[group[-1]] == 1:
            at = cls[-1:]
            held = anchor_rows(0, *(x[at] for x in cols))
        last_h, last_ctx, first_doc = h[-1], ctx[-1], firsts[-1]


CONTEXTS = "key long, doc_id long, start long, lo int, hi int, before int, context binary"
_CONTEXTS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("before", pa.int32()), ("context", pa.binary())])


def fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts of the listed anchors of each document; columns: doc_id, wanted, content."""
    reach = length - K
    ranges = [(reach + 1) * i // RANGES for i in range(RANGES + 1)]
    for batch in batches:
        wanted = batch.column(1)
        inner = wanted.flatten()
        counts = np.diff(np.asarray(wanted.offsets))
        h, at, hot = (np.asarray(inner.field(c)) for c in ("h", "start", "hot"))
        row = np.repeat(np.arange(batch.num_rows), counts)
        ids = np.asarray(batch.column(0))
        for lo, hi, data, offsets in table_slices(batch, "content", SLICE):
            sel = (row >= lo) & (row < hi)
            doc = row[sel] - lo
            begin, end = offsets[doc], offsets[doc + 1]
            pos = at[sel] + begin
            hh, hot_, name = h[sel], hot[sel], ids[lo:hi][doc]
            left, right = np.minimum(pos - begin, reach), np.minimum(end - pos - K, reach)
            p = Prefix(data)
            parts = [(np.flatnonzero(~hot_), 0, reach)]
            parts += [(np.flatnonzero(hot_ & (left >= a) & (right >= reach - b + 1)), a, b - 1) for a, b in zip(ranges, ranges[1:], strict=False)]
            for which, a, b in parts:
                if not len(which):
                    continue
                key = hh[which]
                if hot_[which[0]]:
                    x = pos[which]
                    key = mix(p.ranges(x - a, x + K + reach - b) + key.view(np.uint64) + np.uint64(a + 1)).view(np.int64)
                s, n = pos[which] - left[which], (left + right)[which] + K
                bytes_ = data[ragged(s, n)]
                off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                ctx = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(bytes_.tobytes())])
                full = lambda v, k=len(which): pa.array(np.full(k, v, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key)), pa.array(name[which]), pa.array((pos - begin)[which]), full(a), full(b), pa.array(left[which].astype(np.int32)), ctx], schema=_CONTEXTS)


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of all intervals of two or more suffixes whose common prefix is exactly ``depth``.

    lcp[i] is the common prefix of suffixes i - 1 and i; lcp[0] is not read.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        depth, first = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def common(m: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common prefixes of rows x and y of a matrix of padded strings."""
    differ = m[x] != m[y]
    at = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    return np.minimum(at, np.minimum(size[x], size[y]))


def maximal_repeats(keys: np.ndarray, doc: np.ndarray, start: np.ndarray, before: np.ndarray, off: np.ndarray, raw: np.ndarray, length: int):
    """Yields (left, right, members) of every maximal repeat of ``length`` bytes or more among contexts with equal keys.

    A repeat is members' bytes from ``left`` before the anchor to ``right`` after it.
    """
    reach, n = length - K, len(keys)
    after = np.diff(off) - before - K
    # Bytes plus one, 0 beyond the context's end; UTF-8 has no byte 255.
    wide = -(-reach // 8) * 8
    right_m, left_m = np.zeros((n, wide), np.uint8), np.zeros((n, wide), np.uint8)
    col = np.arange(wide)
    at = off[:-1] + before
    safe = len(raw) - 1
    right_m[:] = np.where(col < after[:, None], raw[np.minimum(at[:, None] + K + col, safe)] + np.uint8(1), 0)
    left_m[:] = np.where(col < before[:, None], raw[np.maximum(at[:, None] - 1 - col, 0)] + np.uint8(1), 0)
    words = lambda m: [m.view(">u8")[:, i] for i in reversed(range(wide // 8))]
    order = np.lexsort((*words(right_m), keys))
    rank = np.empty(n, np.int64)
    rank[np.lexsort((*words(left_m), keys))] = np.arange(n)
    x, y = order[:-1], order[1:]
    right = np.concatenate([[-1], np.where(keys[x] == keys[y], common(right_m, after, x, y), -1)])
    left = np.concatenate([[-1], common(left_m, before, x, y)]).tolist()
    bounds = [*np.flatnonzero(right < 0).tolist(), n]
    right_list, order_list = right.tolist(), order.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a < 2:
            continue
        for r, lo, hi in intervals(right_list[a:b]):
            lo, hi = lo + a, hi + a
            if hi == lo + 1:
                if left[hi] + r >= reach:
                    yield left[hi], r, order_list[lo : hi + 1]
                continue
            members = order[lo : hi + 1]
            members = members[np.argsort(rank[members], kind="stable")]
            ext = common(left_m, before, members[:-1], members[1:])
            if ext.max() < reach - r:
                continue
            # Which child of the interval each member lies in: a repeat inside one child is longer there.
            child = np.cumsum(right[lo : hi + 1] == r)
            place = dict(zip(order_list[lo : hi + 1], child.tolist(), strict=True))
            names = members.tolist()
            for depth, i, j in intervals([-1, *ext.tolist()]):
                if depth >= reach - r:
                    group = names[i : j + 1]
                    if len({place[g] for g in group}) > 1:
                        yield depth, r, group


def repeat_spans(batches: Iterator[pa.RecordBatch], length: int, most: int = 8192) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by key: spans of all but the first occurrence of each maximal repeat."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        keys, doc, start, before = (np.asarray(t[c]) for c in ("key", "doc_id", "start", "before"))
        before = before.astype(np.int64)
        ctx = t["context"].combine_chunks() if isinstance(t["context"], pa.ChunkedArray) else t["context"]
        _, o, d = ctx.buffers()
        off = np.frombuffer(o, np.int32)[ctx.offset : ctx.offset + len(ctx) + 1].astype(np.int64)
        raw = np.frombuffer(d, np.uint8)
        n = len(keys)
        place = np.empty(n, np.int64)
        place[np.lexsort((start, doc))] = np.arange(n)
        place_of = place.tolist()
        back, ahead = [-1] * n, [-1] * n
        for l, r, members in maximal_repeats(keys, doc, start, before, off, raw, length):
            first = min(members, key=place_of.__getitem__)
            for m in members:
                if m != first:
                    back[m] = max(back[m], l)
                    ahead[m] = max(ahead[m], r)
        back, ahead = np.array(back), np.array(ahead)
        some = np.flatnonzero(back >= 0)
        d, s, e = merge_spans(doc[some], start[some] - back[some], start[some] + K + ahead[some])
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], names=["doc_id", "start", "end"])

    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        key = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        if last is not None and len(key) and key[0] == last:
            held.append(batch.slice(0, cuts[1]))
            rows += cuts[1]
            cuts = cuts[1:]
        while len(cuts) > 1 and cuts[0] < len(key):
            if rows >= most:
                yield flush(held)
                held, rows = [], 0
            # As many whole groups as fit; the last one may go on in the next batch.
            j = max(1, int(np.searchsorted(cuts, cuts[0] + most - rows, "right")) - 1)
            held.append(batch.slice(cuts[0], cuts[j] - cuts[0]))
            rows += cuts[j] - cuts[0]
            cuts = cuts[j:]
        last = key[-1] if len(key) else last
    if held:
        yield flush(held)


def windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window of ``length`` bytes of contexts' ranges, by two hashes."""
    for batch in batches:
        doc, start, lo, hi, before = (np.asarray(batch.column(i)).astype(np.int64) for i in range(1, 6))
        ctx = batch.column(6)
        _, o, d = ctx.buffers()
        off = np.frombuffer(o, np.int32)[ctx.offset : ctx.offset + len(ctx) + 1].astype(np.int64)
        raw = np.frombuffer(d, np.uint8)
        p, q = Prefix(raw), Prefix(raw ^ np.uint8(0x55))
        for o in range(int(lo.min(initial=0)), int(hi.max(initial=-1)) + 1):
            a = off[:-1] + before - o
            ok = np.flatnonzero((lo <= o) & (o <= hi) & (before >= o) & (a + length <= off[1:]))
            if len(ok):
                s = a[ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.ranges(s, s + length).view(np.int64)), pa.array(q.ranges(s, s + length).view(np.int64)), pa.array(doc[ok]), pa.array(start[ok] - o)], names=["w1", "w2", "doc_id", "start"]
                )


def find_spans(df: DataFrame, length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """(doc_id, start, end) of removed bytes, overlapping; ``df`` has doc_id and content."""
    texts = df.where(F.octet_length("content") >= length)
    placed = texts.mapInArrow(lambda it: scan_anchors(it, length), ANCHORS).repartition("h").sortWithinPartitions("kind", "h", "ctx", "doc_id", "start")
    found = cut(placed.mapInArrow(settle, ANCHORS), "anchors")
    settled = found.where("kind = 1").select("doc_id", "start", F.col("a").alias("end"))
    open_ = found.where("kind = 0").select("h", "doc_id", "start")
    hot = cut(open_.groupBy("h").count().where(F.col("count") > limit).select("h", F.lit(True).alias("hot")), "hot")
    wanted = open_.join(hot, "h", "left").groupBy("doc_id").agg(F.collect_set(F.struct("h", "start", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    contexts = texts.join(wanted, "doc_id").select("doc_id", "wanted", "content").mapInArrow(lambda it: fetch(it, length), CONTEXTS)
    contexts = cut(contexts, "contexts")
    big = cut(contexts.groupBy("key").count().where(F.col("count") > limit).select("key"), "big")
    small = contexts if big.isEmpty() else contexts.join(big, "key", "left_anti")
    spans = small.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: repeat_spans(it, length), "doc_id long, start long, end long")
    spans = cut(spans, "spans")
    if not big.isEmpty():
        each = cut(contexts.join(big, "key", "left_semi").mapInArrow(lambda it: windows(it, length), "w1 long, w2 long, doc_id long, start long").distinct(), "windows")
        first = each.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
        # Written, so that the join's sides are plain exchanges and a frequent window's rows can be split.
        first = cut(first, "firsts")
        more = each.join(first, ["w1", "w2"]).where(F.struct("doc_id", "start") > F.col("first"))
        spans = spans.union(more.select("doc_id", "start", (F.col("start") + length).alias("end")))
    return settled.union(spans)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Columns: doc_id, spans (or null), content."""
    for batch in batches:
        spans = batch.column(1)
        counts = np.where(np.asarray(spans.is_null()), 0, np.diff(np.asarray(spans.offsets)))
        inner = spans.flatten()
        s, e = np.asarray(inner.field("start")), np.asarray(inner.field("end"))
        row = np.repeat(np.arange(batch.num_rows), counts)
        for lo, hi, data, offsets in table_slices(batch, "content"):
            n = hi - lo
            sel = slice(int(np.searchsorted(row, lo)), int(np.searchsorted(row, hi)))
            doc = row[sel] - lo
            size = offsets[doc + 1] - offsets[doc]
            d, a, b = merge_spans(doc, np.minimum(s[sel], size), np.minimum(e[sel], size))
            full = b > a
            d, a, b = d[full], a[full], b[full]
            mark = np.zeros(len(data) + 1, np.int8)
            mark[offsets[d] + a] += 1
            np.add.at(mark, offsets[d] + b, -1)
            keep = np.cumsum(mark[:-1], dtype=np.int8) == 0
            total = np.concatenate([[0], np.cumsum(~keep)])
            removed = total[offsets[1:]] - total[offsets[:-1]]
            kept = data[keep].tobytes()
            at = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).tolist()
            parts = [kept[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
            out = [batch.column(0).slice(lo, n), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.bincount(d, minlength=n).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in parts])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                out.append(pa.array(parts, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(out, names=names)


def substring_dedup(df: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text: str = "text", limit: int = LIMIT, with_text: bool = False) -> DataFrame:
    """Per row of ``df``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes ``kept``."""
    keyed = key_rows(df, id_column, text)
    docs = keyed.rows.withColumn("content", F.coalesce("content", F.lit("")))
    spans = find_spans(keyed.texts(), length, limit).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = docs.join(spans, "doc_id", "left").select(F.col("name").alias("doc_id"), "spans", "content")
    return joined.mapInArrow(lambda it: remove(it, with_text), RESULT + (", kept binary" if with_text else ""))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
