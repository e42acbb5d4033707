"""Catalog of Parquet tables: versions, keyed merges and cascades.

A table is a folder of versions; a write makes a new version and moves the
pointer last, so readers never see half a table and no plan reads the files it
replaces. Keyed merges are anti joins and unions; nothing is updated in place.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.search import Postings, occurrences_of, size_of
from codeloom.plans.textindex import exists, stored_postings, write_by_term
from codeloom.schemas import TABLES

#: Columns of nodes that full-text search reads.
TEXT_COLUMNS = ("name", "description")


def text_columns() -> dict[str, Column]:
    return {c: F.col(c) for c in TEXT_COLUMNS}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        named = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upsert(old: DataFrame, incoming: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """O-24, O-26, O-27: rows of ``incoming`` replace those of ``old`` with equal keys; of several the last by ``order`` wins."""
    if order is not None:
        values = [c for c in incoming.columns if c not in keys]
        last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v"))
        incoming = last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])
    return old.join(incoming.select(*keys).distinct(), keys, "left_anti").select(*incoming.columns).unionByName(incoming)


def merge_edges(old: DataFrame, incoming: DataFrame, nodes: DataFrame, order: Column) -> DataFrame:
    """O-25: incoming edges with both ends in ``nodes``; a known edge gets the new confidence."""
    ids = nodes.select("node_id")
    whole = incoming.join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi")
    latest = whole.groupBy("kind", "from_id", "to_id").agg(F.max_by("confidence", order).alias("confidence"))
    return upsert(old, latest, ["kind", "from_id", "to_id"])


def without_edges_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """O-28: edges with neither end in ``ids(node_id)``."""
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.select(F.col("node_id").alias(end)).distinct(), end, "left_anti")
    return edges


def delete_nodes(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """O-29: nodes, edges and embeddings without what belongs to ``ids(node_id)``."""
    gone = ids.select("node_id").distinct()
    return nodes.join(gone, "node_id", "left_anti"), without_edges_of(edges, ids), embeddings.join(gone, "node_id", "left_anti")


def delete_files(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, files: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """O-30 with the full cascade (Q36): everything of the files in ``paths(path)``."""
    gone = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("node_id")
    return *delete_nodes(nodes, edges, embeddings, gone), files.join(paths.select("path").distinct(), "path", "left_anti")


class Catalog:
    """O-35: the engine's tables under one folder, or empty ones before the first write.

    Without a folder the catalog is in memory only in so far as it ends with the
    session: it lies in the shared folder under a name of its own.

    ``read_only`` refuses writes. Nodes are sorted by id and edges partitioned by
    kind, with a copy sorted by target (O-34), so lookups skip files and row groups
    by their statistics.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, read_only: bool = False):
        self.spark, self.read_only = spark, read_only
        self.root = (root or f"{shared_dir(spark)}/codeloom-catalog-{uuid.uuid4().hex}").rstrip("/")
        if root is None:
            fs, jpath = self._fs(self.root)
            fs.deleteOnExit(jpath)

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def _pointer(self, name: str) -> str | None:
        """The version that the greatest pointer file names; each write adds one, so there is always a whole table."""
        fs, folder = self._fs(f"{self.root}/{name}")
        if not fs.exists(folder):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        pointers = sorted(n for n in names if n.startswith("CURRENT-"))
        return pointers[-1].split("-", 2)[2] if pointers else None

    def table(self, name: str) -> DataFrame:
        version = self._pointer(name)
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/{version}")

    def incoming(self) -> DataFrame:
        """Edges sorted by target, for walks against their direction."""
        version = self._pointer("edges")
        if version is None:
            return self.table("edges")
        return self.spark.read.schema(TABLES["edges"]).parquet(f"{self.root}/edges_by_target/{version}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        if self.read_only:
            raise PermissionError("the catalog is open for reading only")
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
        version = uuid.uuid4().hex
        path = f"{self.root}/{name}/{version}"
        if name == "edges":
            kept = df.persist()
            for sort, at in (("from_id", path), ("to_id", f"{self.root}/edges_by_target/{version}")):
                kept.repartitionByRange("kind", sort).sortWithinPartitions("kind", sort).write.partitionBy("kind").parquet(at)
            kept.unpersist()
        elif name == "nodes":
            df.repartitionByRange("node_id").sortWithinPartitions("node_id").write.parquet(path)
        else:
            df.write.parquet(path)
        # The version is in the pointer's name: creating it is the one step that readers can see.
        fs, folder = self._fs(f"{self.root}/{name}")
        old = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(folder)) if n.startswith("CURRENT-"))
        number = int(old[-1].split("-")[1]) + 1 if old else 1
        _, new = self._fs(f"{self.root}/{name}/CURRENT-{number:012d}-{version}")
        fs.create(new, False).close()
        for n in old[:-1]:
            fs.delete(self._fs(f"{self.root}/{name}/{n}")[1], False)
        return self.table(name)

    def search_path(self) -> str:
        """Where the search tables of this version of the nodes are; a read-only catalog without them keeps its own in the shared folder."""
        version = self._pointer("nodes") or "empty"
        path = f"{self.root}/search/{version}"
        if not self.read_only or exists(self.spark, f"{path}/weights"):
            return path
        return f"{shared_dir(self.spark)}/codeloom-search-{version}"

    def postings(self) -> Postings:
        """O-32: the full-text tables of this version of the nodes."""
        path = f"{self.root}/search/{self._pointer('nodes') or 'empty'}"
        if self.read_only and not exists(self.spark, f"{path}/occurrences"):
            path = f"{shared_dir(self.spark)}/codeloom-search-{self._pointer('nodes') or 'empty'}"
        return stored_postings(self.table("nodes"), "node_id", text_columns(), path)

    def refresh_postings(self, old: Postings, changed: DataFrame) -> Postings:
        """O-32: the tables of an earlier version without the rows of ``changed(node_id)``, and with the texts these have now."""
        nodes = self.table("nodes")
        path = f"{self.root}/search/{self._pointer('nodes')}"
        ids = changed.select("node_id").distinct()
        kept = old.occurrences.join(ids, "node_id", "left_anti")
        fresh = occurrences_of(nodes.join(ids, "node_id", "left_semi"), "node_id", text_columns())
        write_by_term(kept.unionByName(fresh), f"{path}/occurrences", "node_id")
        size_of(nodes, text_columns()).write.mode("overwrite").parquet(f"{path}/size")
        return self.postings()

    def views(self) -> None:
        """Temporary views of all tables, for O-21."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)

    def sql(self, query: str, **parameters) -> DataFrame:
        """O-21: a query over the views, with named parameters and never by building strings (Q46)."""
        self.views()
        return self.spark.sql(query, args=parameters)
