"""The small content-defined chunks of a text: its words, each with the blank before it.

For tokenizers whose tokens never hold a blank nor depend on one, the ids of a
text are the ids of these pieces one after the other. A worker keeps pieces'
ids in a table of bounded size and looks up whole slices of text at once; what
is found is compared byte by byte.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np

from codeloom.llm.words import Prefix, ragged

MOST_PIECES = 800_000
MOST_BYTES = 24 << 20
LONGEST = 64

#: The splitting rule whose matches never hold a blank (fixed value of the tokenizer's file).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
HARMLESS_NORMALIZERS = ("NFC", "Lowercase", "Replace")


def blanks_part(path: str) -> bool:
    """Whether the tokenizer file is known to treat pieces independently."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    norm = t.get("normalizer") or {"normalizers": []}
    parts = norm.get("normalizers", [norm])
    if any(p["type"] not in HARMLESS_NORMALIZERS or p["type"] == "Replace" and (p["pattern"], p["content"]) != ({"Regex": r"\s+"}, " ") for p in parts):
        return False
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] or any(c.isspace() for c in a["content"]) for a in t.get("added_tokens", [])):
        return False
    if t["model"].get("type", "BPE") != "BPE" or t.get("post_processor") and t["post_processor"].get("type") != "ByteLevel":
        return False
    pre = t.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    return len(steps) == 2 and steps[0].get("type") == "Split" and steps[0]["pattern"] == {"Regex": WORD_PATTERN} and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and steps[1].get("type") == "ByteLevel" and not steps[1]["use_regex"] and not steps[1].get("add_prefix_space")


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at every document's start and at the last blank ahead of each word."""
    blank = _BLANK[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[: max(0, len(data) - 1)] = blank[:-1] & ~blank[1:]
    begins[offsets[:-1]] = True
    return np.flatnonzero(begins[: len(data)])


class Store:
    """An array that grows at its end."""

    def __init__(self, dtype, first=()):
        self.a, self.n = np.zeros(1024, dtype), 0
        self.add(np.asarray(first, dtype))

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.a):
            self.a = np.concatenate([self.a[: self.n], np.zeros(max(self.n, len(x)) + 1024, self.a.dtype)])
        self.a[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def view(self) -> np.ndarray:
        return self.a[: self.n]


class PieceCache:
    def __init__(self, encode, most: int = MOST_PIECES, most_bytes: int = MOST_BYTES):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.hits = Store(np.uint64), Store(np.int32)
        self.raw, self.raw_at = Store(np.uint8), Store(np.int64, [0])
        self.ids, self.ids_at = Store(np.int32), Store(np.int64, [0])
        self.small = Store(bool)
        self.slots = np.full(1 << 16, -1, np.int32)

    def trim(self) -> None:
        """Keep the half of the pieces that was used most when the table is full."""
        if self.keys.n <= self.most and self.raw.n <= self.most_bytes:
            return
        order = np.argsort(-self.hits.view, kind="stable")
        keep = np.sort(order[self.small.view[order]][: self.most // 2])
        keys, hits = self.keys.view[keep], self.hits.view[keep] // 2
        n, m = np.diff(self.raw_at.view)[keep], np.diff(self.ids_at.view)[keep]
        raw, ids = self.raw.view[ragged(self.raw_at.view[keep], n)], self.ids.view[ragged(self.ids_at.view[keep], m)]
        self.clear()
        if len(raw) <= self.most_bytes:
            self.append(keys, raw, n, ids, m, np.ones(len(keys), bool))
            self.hits.view[:] = hits

    def append(self, keys, raw, sizes, ids, counts, small) -> None:
        """Add entries; those that are ``small`` must have new and different keys."""
        base = self.keys.n
        self.keys.add(keys)
        self.hits.add(np.zeros(len(keys), np.int32))
        self.raw_at.add(self.raw.n + np.cumsum(sizes))
        self.raw.add(raw)
        self.ids_at.add(self.ids.n + np.cumsum(counts))
        self.ids.add(ids)
        self.small.add(small)
        if 2 * self.keys.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.keys.n).bit_length(), -1, np.int32)
            self.place(np.flatnonzero(self.small.view))
        else:
            self.place(base + np.flatnonzero(small))

    def place(self, entries: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (self.keys.view[entries] & np.uint64(mask)).astype(np.int64)
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]  # of several for one slot, one stays
            placed = self.slots[slot] == entries
            entries, slot = entries[~placed], (slot[~placed] + 1) & mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entries by key, -1 where there is none."""
        mask = len(self.slots) - 1
        out = np.full(len(keys), -1, np.int64)
        open_, slot = np.arange(len(keys)), (keys & np.uint64(mask)).astype(np.int64)
        known = self.keys.view
        while len(open_) and len(known):
            entry = self.slots[slot]
            same = (entry >= 0) & (known[np.maximum(entry, 0)] == keys[open_])
            out[open_[same]] = entry[same]
            go = (entry >= 0) & ~same
            open_, slot = open_[go], (slot[go] + 1) & mask
        return out

    def equal(self, entries: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether entries have exactly the bytes at ``starts``."""
        at = self.raw_at.view
        good = at[entries + 1] - at[entries] == sizes
        e, s, n = entries[good], starts[good], sizes[good]
        if len(e):
            differ = np.concatenate([[0], np.cumsum(self.raw.view[ragged(at[e], n)] != data[ragged(s, n)])])
            ends = np.cumsum(n)
            good[good] = differ[ends] == differ[ends - n]
        return good

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each piece has. Pieces are not empty."""
        self.trim()
        sizes = ends - starts
        keys = Prefix(data).ranges(starts, ends)
        entry = self.find(keys)
        entry[sizes > LONGEST] = -1
        found = np.flatnonzero(entry >= 0)
        entry[found[~self.equal(entry[found], data, starts[found], sizes[found])]] = -2
        new = np.flatnonzero((entry == -1) & (sizes <= LONGEST))
        _, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
        alone = np.flatnonzero((entry < 0) & ((sizes > LONGEST) | (entry == -2)))
        add = np.concatenate([new[first], alone])
        if len(add):
            base = self.keys.n
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[add].tolist(), ends[add].tolist(), strict=True)]
            ids = self.encode(texts)
            counts = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
            small = np.arange(len(add)) < len(first)
            self.append(keys[add], data[ragged(starts[add], sizes[add])], sizes[add], flat, counts, small)
            entry[new] = base + back
            wrong = new[~self.equal(entry[new], data, starts[new], sizes[new])]
            entry[alone] = base + len(first) + np.arange(len(alone))
            for i in wrong.tolist():  # another piece of this slice has the same 64 bits
                x = np.array(self.encode([raw[starts[i] : ends[i]].decode()])[0], np.int32)
                entry[i] = self.keys.n
                self.append(keys[i : i + 1], data[starts[i] : ends[i]], sizes[i : i + 1], x, np.array([len(x)]), np.zeros(1, bool))
        np.add.at(self.hits.view, entry, 1)
        at = self.ids_at.view
        counts = at[entry + 1] - at[entry]
        return self.ids.view[ragged(at[entry], counts)], counts
