"""BPE encoding and decoding with reuse of content-defined chunks (operator 5).

A rolling hash over the text's bytes cuts documents into chunks whose borders
depend on nearby bytes only, so copies, near copies and shared passages fall
into equal chunks. A worker encodes each distinct chunk once while it stays in
a cache of bounded size, whichever document brought it; chunks that are new are
put together from their words, which have such a cache too (``pieces``), if the
tokenizer is known to allow it. Joining chunks can
change tokens near the border; every border is therefore encoded again inside
a window of whole words, and the window grows until its pieces agree with both
sides exactly (at worst it spans everything up to the chunk's end, which is an
encoding from scratch). No rows move between tasks.

Defined results: null is the empty text (no tokens, decoded as the empty text);
repeated rows give a row each; an empty table gives no rows; other columns are
never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.pieces import _BLANK, PieceCache, blanks_part, piece_starts
from codeloom.llm.shared import documents
from codeloom.llm.token_counts import load, tokenizer_path
from codeloom.llm.words import Prefix, table_slices

SLICE = 1 << 20
ROLL = 16
MEAN_CHUNK = 1024
MIN_CHUNK = 64
CACHE_BYTES = 24 << 20


def chunk_borders(data: np.ndarray, offsets: np.ndarray, mean: int = MEAN_CHUNK) -> list[list[int]]:
    """For each document the chunk borders within the buffer, its start and end included."""
    borders = [[int(a)] for a in offsets[:-1]]
    if len(data) > ROLL:
        p = Prefix(data)
        n = len(data) - ROLL + 1
        rolled = (p.sums[ROLL : ROLL + n] - p.sums[:n]) * p.down[:n]
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.flatnonzero(rolled >> np.uint64(32) < np.uint64((1 << 32) // mean)) + ROLL
        doc = np.searchsorted(offsets, at, "left") - 1
        # The rolled window must lie in one document, and a border never splits a code point.
        good = (at - ROLL >= offsets[doc]) & (at < offsets[doc + 1])
        at, doc = at[good], doc[good]
        good = (data[at] & 0xC0) != 0x80
        for d, x in zip(doc[good].tolist(), at[good].tolist(), strict=True):
            if x - borders[d][-1] >= MIN_CHUNK:
                borders[d].append(x)
    for b, end in zip(borders, offsets[1:].tolist(), strict=True):
        b.append(int(end))
    return borders


class Codec:
    """Encodes slices of documents; ``encode`` maps a list of texts to lists of ids."""

    def __init__(self, encode, mean: int = MEAN_CHUNK, cache_bytes: int = CACHE_BYTES, pieces: PieceCache | None = None):
        self.encode_texts, self.mean, self.cache_bytes, self.pieces = encode, mean, cache_bytes, pieces
        self.cache: dict[bytes, np.ndarray] = {}
        self.held = self.encoded = self.reused = 0

    def encode_all(self, pieces: list[bytes]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.encode_texts([p.decode() for p in pieces])]

    def encode_fresh(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Chunks that the cache lacks: from their words where the tokenizer allows it."""
        if self.pieces is None or not chunks:
            return self.encode_all(chunks)
        data = np.frombuffer(b"".join(chunks), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
        starts = piece_starts(data, first)
        ids, counts = self.pieces(data, starts, np.append(starts[1:], len(data)))
        total = np.concatenate([[0], np.cumsum(counts)])
        at = total[np.searchsorted(starts, first)]
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def chunks(self, pieces: list[bytes]) -> list[np.ndarray]:
        fresh = list(dict.fromkeys(p for p in pieces if p not in self.cache))
        made = dict(zip(fresh, self.encode_fresh(fresh), strict=True))
        self.encoded += len(fresh)
        self.reused += len(pieces) - len(fresh)
        out = [made[p] if p in made else self.cache[p] for p in pieces]
        self.cache |= made
        self.held += sum(len(k) + v.nbytes + 200 for k, v in made.items())
        while self.held > self.cache_bytes and self.cache:
            k = next(iter(self.cache))
            self.held -= len(k) + self.cache.pop(k).nbytes + 200
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        raw = data.tobytes()
        borders = chunk_borders(data, offsets, self.mean)
        pieces = [raw[a:b] for bs in borders for a, b in zip(bs, bs[1:], strict=False)]
        ids = self.chunks(pieces)
        blank = _BLANK[data]
        cuts = np.flatnonzero(blank[:-1] & ~blank[1:])  # before the last blank ahead of a word
        joins, at = [], 0
        for bs in borders:
            joins += [(bs[0], p, q) for p, q in zip(bs[1:-1], bs[2:], strict=True)]
        near = self.windows(raw, cuts, joins, 1)
        out, j = [], 0
        for bs in borders:
            parts = [ids[at]]
            for i in range(1, len(bs) - 1):
                self.join(parts, ids[at + i], raw, cuts, joins[j], near[j])
                j += 1
            at += len(bs) - 1
            out.append(np.concatenate(parts) if len(parts) > 1 else parts[0])
        return out

    def windows(self, raw: bytes, cuts: np.ndarray, joins: list[tuple[int, int, int]], words: int) -> list[tuple]:
        """For each border: encodings of the words before and after it, of both together, and of a wider window's parts."""
        if not joins:
            return []
        lo, at, hi = (np.array(x) for x in zip(*joins, strict=True))
        k = np.searchsorted(cuts, at)
        edges = np.concatenate([[0], cuts, [len(raw)]])

        def left(n: int) -> np.ndarray:
            return np.minimum(np.maximum(edges[np.maximum(k - n + 1, 0)], lo), at)

        def right(n: int) -> np.ndarray:
            return np.maximum(np.minimum(edges[np.minimum(k + n, len(edges) - 1)], hi), at)

        a, b = left(words), right(words)
        a2, b2 = left(2 * words), right(2 * words)
        spans = np.stack([a, at, at, b, a, b, a2, a, b, b2, a2, b2], 1).reshape(-1, 2).tolist()
        encoded = self.encode_all([raw[x:y] for x, y in spans])
        return [tuple(encoded[6 * i : 6 * i + 6]) + ((a[i] == lo[i]) and (b[i] == hi[i]),) for i in range(len(joins))]

    def join(self, parts: list[np.ndarray], right: np.ndarray, raw: bytes, cuts: np.ndarray, where: tuple[int, int, int], near: tuple) -> None:
        """Append the chunk ``right`` to the ids in ``parts``, repaired at the border."""
        words = 1
        while True:
            before, after, both, far_left, far_right, wide, everything = near
            if everything:
                parts[:] = [both]
                return
            if len(parts[-1]) < len(before) and len(parts) > 1:
                parts[:] = [np.concatenate(parts)]
            last = parts[-1]
            n, m = len(last) - len(before), len(after)
            if n >= 0 and m <= len(right) and (last[n:] == before).all() and (right[:m] == after).all() and len(wide) == len(far_left) + len(both) + len(far_right) and (wide == np.concatenate([far_left, both, far_right])).all():
                parts[-1] = last[:n]
                parts += [both, right[m:]]
                # The next border looks back into the last part, which must not be shorter than a word.
                if len(parts[-1]) < 64:
                    parts[-3:] = [np.concatenate(parts[-3:])]
                return
            words *= 2
            near = self.windows(raw, cuts, [where], words)[0]


_codecs: dict = {}


def codec_of(path: str) -> Codec:
    """One codec, with its cache, for the life of the worker."""
    if path not in _codecs:
        encode = load(path)
        _codecs[path] = Codec(encode, pieces=PieceCache(encode) if blanks_part(path) else None)
    return _codecs[path]


def decoder_of(path: str):
    if (key := (path, "decode")) not in _codecs:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _codecs[key] = lambda many: [model.decode(x) for x in many]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            _codecs[key] = lambda many: t.decode_batch(many, skip_special_tokens=False)
    return _codecs[key]


COLUMNS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
_ARROW = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def code(batches: Iterator[pa.RecordBatch], path: str, columns: tuple[str, ...], codec: Codec | None = None) -> Iterator[pa.RecordBatch]:
    codec, decode = codec or codec_of(path), decoder_of(path)
    for batch in batches:
        keys = batch.select(list(range(batch.num_columns - 1)))
        for lo, hi, data, offsets in table_slices(batch, batch.schema.names[-1], SLICE):
            ids = codec(data, offsets)
            out: dict[str, list] = {"ids": ids, "n_tokens": [len(x) for x in ids]}
            if {"decoded", "ids_sha256", "decoded_sha256"} & set(columns):
                lists = [x.tolist() for x in ids]
            if "ids_sha256" in columns:
                out["ids_sha256"] = [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in lists]
            if {"decoded", "decoded_sha256"} & set(columns):
                out["decoded"] = decode(lists)
                out["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in out["decoded"]]
            arrays = keys.slice(lo, hi - lo).columns + [pa.array(out[c], _ARROW[c]) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys.schema.names, *columns])


def encode_documents(df: DataFrame, path: str, columns: tuple[str, ...] = ("ids", "n_tokens"), keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with those of ``COLUMNS`` that are asked for; null texts have no tokens, an empty table gives no rows."""
    taken = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_content"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1]] + [f"`{c}` {COLUMNS[c]}" for c in columns]
    return taken.mapInArrow(lambda it: code(it, path, columns), ", ".join(fields))


def op5_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))
