"""Structured Streaming: incremental indexing and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.enrich import ring_buffer
from codeloom.plans.index import index
from codeloom.plans.tables import Catalog
from codeloom.sources.files import discoverable, language_of

FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, root: str, max_kb: int = 1024) -> DataFrame:
    """New and changed source files below ``root`` as a stream."""
    base = root.rstrip("/").split(":")[-1]
    raw = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), "^[a-z]+:(//[^/]*)?", ""), f"^/*{base.strip('/')}/", "")
    found = raw.select(rel.alias("path"), "length", "content").where(discoverable(F.col("path"), F.col("length"), max_kb))
    return found.select("path", language_of(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"))


def ingest(catalog: Catalog, root: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Index every micro-batch. A batch that runs twice merges the same keys again."""

    def batch(df: DataFrame, _epoch: int) -> None:
        changes = df.select("path", F.lit("Modified").alias("status"), F.lit(None).cast("string").alias("old_path"))
        index(catalog, df, changes=changes)

    writer = stream_files(catalog.spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_counts(events: DataFrame, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """O-88 on a stream: events by type and window; late ones beyond ``delay`` are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def keep_last(events: DataFrame, path: str, checkpoint: str, size: int = 100) -> StreamingQuery:
    """O-88: the ring buffer as a table that each micro-batch rewrites to a new version; ``path/v=<epoch>``."""
    spark = events.sparkSession

    def batch(df: DataFrame, epoch: int) -> None:
        old = f"{path}/v={epoch - 1}"
        jpath = spark._jvm.org.apache.hadoop.fs.Path(old)
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            df = df.unionByName(spark.read.schema(df.schema).parquet(old))
        ring_buffer(df, size).write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
