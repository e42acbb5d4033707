from pyspark.sql import functions as F

from codeloom.plans.tables import Catalog
from codeloom.streaming import ingest


def test_ingest(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f():\n    return g()\ndef g(): pass\n")
    c = Catalog(spark, str(tmp_path / "catalog"))
    for text in (None, "def h(): return f()\n"):
        if text:
            (src / "b.py").write_text(text)
        ingest.ingest(c, str(src), str(tmp_path / "cp"), available_now=True).awaitTermination(120)
    assert sorted(r.name for r in c.table("nodes").collect()) == ["f", "g", "h"]
    assert {(r.from_id, r.to_id) for r in c.table("edges").collect()} == {(".:a.py:_:f", ".:a.py:_:g"), (".:b.py:_:h", ".:a.py:_:f")}


def test_events(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    (tmp_path / "in").mkdir()
    spark.read.parquet(src).repartition(2).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.keep_last(stream, str(tmp_path / "ring"), str(tmp_path / "cp"), 5)
    q.processAllAvailable()
    q.stop()
    last = sorted(p.name for p in (tmp_path / "ring").iterdir())[-1]
    got = spark.read.parquet(str(tmp_path / "ring" / last))
    want = spark.read.parquet(src).groupBy("event_type").agg(F.max("ts").alias("t"))
    assert got.groupBy("event_type").count().where("count != 5").count() == 0
    assert sorted(map(tuple, got.groupBy("event_type").agg(F.max("ts")).collect())) == sorted(map(tuple, want.collect()))
    q = ingest.event_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM counts").first().n == spark.read.parquet(src).count()
