import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from codeloom.llm import quality
from codeloom.llm.token_counts import tokenizer_path

from . import test_contamination, test_lines, test_near


def brute(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {r.doc_id for r in quality.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect() if r.kept}
    docs = {i: t for i, t in docs.items() if i in kept}
    cut = test_lines.brute(sorted(docs.items()))
    docs = {i: new for (i, _), (new, gone, _) in cut.items() if not gone or (new or "").strip()}
    classes = test_near.brute(sorted(docs.items()))
    docs = {i: docs[i] for i, c, _ in classes if i == c}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r[0] for r in test_contamination.brute(sorted(docs.items()), bench) if not r[5]}
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = {}
    for i in clean:
        ids = t.encode(docs[i] or "", add_special_tokens=False).ids
        out[i] = (ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    return out


def test_equals_brute_force(spark, tmp_path):
    from pyspark.sql import functions as F

    src = "/root/testdata/sf0.01"
    # Short documents, so that the brute force ends soon; copies and benchmark passages are among them.
    spark.read.parquet(f"{src}/documents.parquet").where((F.col("n_chars") < 1500) & (F.col("doc_id") < 500)).write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.read.parquet(f"{src}/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute(spark, str(tmp_path))
    got = {r.doc_id: (r.ids, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 50


def test_odd_rows(spark):
    text = "The first line of it, with words. " + " ".join(f"word{i} {('of', 'and', 'the')[i % 3]}" for i in range(60)) + ".\nA second line stands here, too."
    rows = [(1, text, "en", "s", 5, "k", 1), (1, text, "en", "s", 5, "k", 1), (None, text.replace("word", "term"), None, None, None, None, None), (2, None, "en", "s", 0, "k", 1), (3, "", None, "s", 0, None, 2), (4, (text + "\n") * 900, "en", None, None, "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string, kept int")
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == df.columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "None"] and all(r.n_tokens for r in out)
    for _, stage in corpus_pipeline.STAGES:  # every stage takes such rows as they are, too
        assert stage(spark, df, "/root/testdata/sf0.001").count() <= len(rows)


def test_stages_keep_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "/root/testdata/sf0.001")
        assert out.columns == df.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() == 0
