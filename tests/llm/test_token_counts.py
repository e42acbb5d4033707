import random

import pytest

from codeloom.llm import token_counts as K

TEXTS = [
    None, "", "   ", "Hello  world's <|endoftext|>foo\n bar, baz!! 123", "a\t\tb", "a b", " á ́b\n\ńc", "ΑΣ ΟΔΟΣ",
    "x \t y\x0b\x0cz\x85q  r", "<|startoftext|> \n <|endoftext|>", "日本語 テキスト 한국어", "😀\r\n😀", "I'm don't we'll", "word " * 40000,
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_equal_the_library(spark, tmp_path, name):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(["a", "B", " ", "\n", "\t", "\x0b", "é", "'s", "1", "!", "́"]) for _ in range(80)) for _ in range(60)]
    path, cache = K.tokenizer_path(name), str(tmp_path / "cache")
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(3, texts[3], 5), (3, texts[4], 6), (None, "null id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Digest int")
    encode = K.load(path)
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(encode([t or ""])[0]), len(encode([t or ""])[0]) > 2048) for i, t, _ in rows)
    for _ in range(2):
        got = K.count_tokens(df, path, cache)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()  # the second call encoded nothing


def test_only_misses_are_encoded(spark, tmp_path):
    path, cache = K.tokenizer_path("word_bpe_49k.json"), str(tmp_path / "cache")
    K.count_tokens(spark.createDataFrame([(1, "same text"), (2, "same \n text"), (3, "other")], "doc_id long, text string"), path, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    spark.createDataFrame([(K.tokenizer_digest(path), bytearray(__import__("hashlib").sha256(b"planted").digest()), 77)], K.CACHE_SCHEMA).write.mode("append").parquet(cache)
    got = K.count_tokens(spark.createDataFrame([(9, "planted"), (10, "other")], "doc_id long, text string"), path, cache)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {9: 77, 10: 1}
    assert spark.read.parquet(cache).count() == 3


def test_query_finds_hits(spark, tmp_path, monkeypatch):
    texts = [f"some text number {i % 7}" for i in range(40)] + [None, "", "Some  text"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    taken = []
    append = K.append_counts

    def spy(df, path, cache, *rest):
        keys = append(df, path, cache, *rest)
        taken.append(spark.read.parquet(cache).count())
        return keys

    monkeypatch.setattr(K, "append_counts", spy)
    got = {r.doc_id: r.n_tokens for r in K.op7_token_counts(spark, str(tmp_path)).collect()}
    encode = K.load(K.tokenizer_path("word_bpe_49k.json"))
    assert got == {i: len(encode([t or ""])[0]) for i, t in enumerate(texts)}
    # Most contents came with the first delivery; the second appended only what was new, each once.
    assert 0 < taken[0] <= taken[1] == len({"" if t is None else t.replace("  ", " ") for t in texts})


def test_repeated_rows_are_encoded_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "same text")] * 9 + [(None, "other")] * 3, "doc_id long, text string")
    assert K.count_tokens(df, K.tokenizer_path("word_bpe_49k.json"), str(tmp_path / "c")).count() == 12
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert K.count_tokens(df, K.tokenizer_path("word_bpe_49k.json"), str(tmp_path / "c")).count() == 0
