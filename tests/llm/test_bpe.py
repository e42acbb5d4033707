import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codeloom.llm import bpe
from codeloom.llm.pieces import PieceCache, blanks_part
from codeloom.llm.token_counts import load, tokenizer_path
from codeloom.llm.words import text_buffer

PIECES = ["the", "quick", " ", " ", "\n", "\t", "é", "é", "́", "日本", "😀", "'s", "12", "!", "<|endoftext|>", "<|endof", "text|>", "Σ", "x" * 30, "...", "\x85", " ", "ing", "Re"]


def texts(seed, n=80):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 5, 60, 900]))) for _ in range(n)]
    out += ["", " ", "a" * 5000, "ab " * 3000, "é" * 3000, out[4] + out[5], out[5] + out[4], "x" + out[7], "word " * 9 + out[4] * 3]
    return out


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("mean", [16, 80, 1024])
@pytest.mark.parametrize("most", [0, 40, 100_000])
def test_repaired_chunks_equal_the_library(name, mean, most):
    path = tokenizer_path(name)
    t = Tokenizer.from_file(path)
    if most and not blanks_part(path):
        pytest.skip("words cannot stand alone with this tokenizer")
    codec = bpe.Codec(load(path), mean, cache_bytes=20_000, pieces=PieceCache(load(path), most) if most else None)
    for seed in range(3):
        ts = texts(seed)
        got = codec(*text_buffer(pa.array(ts)))
        for x, ids in zip(ts, got, strict=True):
            assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, x
    assert codec.reused > 0


def test_borders_resist_shifts():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 60_000).astype(np.uint8)
    a = bpe.chunk_borders(body, np.array([0, len(body)]))[0]
    b = bpe.chunk_borders(np.concatenate([body[:777] // 2, body]), np.array([0, len(body) + 777]))[0]
    assert len(a) > 30 and len({x + 777 for x in a[1:]} & set(b)) >= len(a) - 3


def test_query_columns(spark):
    ts = [None, *texts(9)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ts)] + [(1, ts[1], "y")], "doc_id long, text string, N_tokens string")
    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = bpe.encode_documents(df, path, ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")).collect()
    assert len(got) == len(ts) + 1
    for r in got:
        ids = t.encode(ts[r.doc_id] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, text)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), path).count() == 0


def test_pieces_and_collisions(monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    from codeloom.llm import pieces

    whole = pieces.Prefix.ranges
    monkeypatch.setattr(pieces.Prefix, "ranges", lambda self, a, b: whole(self, a, b) % np.uint64(50))
    codec = bpe.Codec(load(path), 64, pieces=PieceCache(load(path), 30))
    for seed in range(4):
        ts = texts(seed)
        for x, ids in zip(ts, codec(*text_buffer(pa.array(ts))), strict=True):
            assert ids.tolist() == t.encode(x, add_special_tokens=False).ids


def test_trimmed_table_still_finds():
    from codeloom.llm import pieces

    cache = pieces.PieceCache(lambda ts: [[len(t), ord(t[0])] for t in ts], most=150_000)
    words = [f"w{i}" for i in range(160_000)]
    for part in (words, words[:50], words):
        data, offsets = text_buffer(pa.array(part))
        ids, counts = cache(data, offsets[:-1], offsets[1:])
        assert (counts == 2).all() and ids[::2].tolist() == [len(w) for w in part]
