"""Indexing (O-50, O-51, O-76 to O-78): changed files in, new versions of all tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.extract.table import errors_of, extract_files, nodes_of, refs_of
from codeloom.operators.changes import apply_changes, files_to_index, node_delta, renamed_from
from codeloom.operators.resolve import resolve
from codeloom.plans.tables import Catalog, cut, delete_files, delete_nodes, merge_edges, upsert, without_edges_of
from codeloom.schemas import NODES
from codeloom.sources.manifests import dependency_nodes

NODE_COLUMNS = [f.name for f in NODES.fields]


def index(
    catalog: Catalog, scanned: DataFrame, changes: DataFrame | None = None, dirty: DataFrame | None = None, manifests: DataFrame | None = None,
    sha: str | None = None, is_dirty: bool = False, full: bool = False, compat: bool = False,
) -> dict[str, int]:
    """Index scanned(path, language, content, content_hash) and return counts.

    Every changed file is parsed once; its symbols and references come from the
    same pass. References are resolved against all symbols, old and new.
    """
    postings = catalog.postings()
    nodes, edges, files, embeddings = (cut(catalog.table(t), t) for t in ("nodes", "edges", "files", "embeddings"))
    old_nodes = nodes
    gone = None
    if changes is not None:
        actions = apply_changes(changes)
        gone = actions.where("action = 'drop'").select("path")
    elif not full:
        gone = files.join(scanned.select("path"), "path", "left_anti").select("path")
    if gone is not None:
        nodes, edges, embeddings, files = delete_files(nodes, edges, embeddings, files, gone)
    todo = scanned if full else files_to_index(scanned, files, changes, dirty)
    todo = cut(todo, "todo")
    rows = cut(extract_files(todo, compat), "extracted")
    fresh = nodes_of(rows).select(*NODE_COLUMNS)
    if changes is not None:
        fresh = renamed_from(fresh, old_nodes, changes)
    fresh = cut(fresh, "fresh")

    here = nodes.join(todo.select(F.col("path").alias("file_path")), "file_path", "left_semi").where("kind != 'dependency'")
    delta = cut(node_delta(here, fresh), "delta")
    stale = delta.where("action = 'delete'").select("node_id")
    nodes, edges, embeddings = delete_nodes(nodes, edges, embeddings, stale)
    edges = without_edges_of(edges, delta.where("action = 'update'").select("node_id"))
    nodes = upsert(nodes, fresh, ["node_id"])
    if manifests is not None:
        nodes = upsert(nodes.where("kind != 'dependency'"), dependency_nodes(manifests), ["node_id"])
    nodes = catalog.write("nodes", nodes)
    dependencies = old_nodes.where("kind = 'dependency'").union(nodes.where("kind = 'dependency'")).select("node_id")
    dropped = old_nodes.join(nodes, "node_id", "left_anti").select("node_id")
    catalog.refresh_postings(postings, delta.select("node_id").union(dropped).union(dependencies))

    refs = refs_of(rows)
    # A parsed file's references replace all edges that leave its symbols.
    sources = fresh.select(F.col("node_id").alias("from_id"))
    kept = edges.join(sources, "from_id", "left_anti")
    found = resolve(refs.select("kind", "from_id", "ref_name", "language"), nodes).withColumn("seq", F.lit(0))
    edges = catalog.write("edges", merge_edges(kept, found, nodes, F.struct("confidence", "seq")))
    catalog.write("embeddings", embeddings)
    record = todo.select("path", "language", "content_hash", F.current_timestamp().alias("last_indexed"), F.lit(sha).cast("string").alias("git_sha"))
    catalog.write("files", upsert(files, record, ["path"]))
    if sha is not None:
        meta = catalog.spark.createDataFrame([("last_git_sha", sha + ("+dirty" if is_dirty else ""))], "key string, value string")
        catalog.write("index_meta", upsert(cut(catalog.table("index_meta"), "meta"), meta, ["key"]))
    counts = {r.action: r["count"] for r in delta.groupBy("action").count().collect()}
    return {
        "files_parsed": todo.count(), "files_failed": errors_of(rows).count(), "nodes_inserted": counts.get("insert", 0), "nodes_updated": counts.get("update", 0),
        "nodes_deleted": counts.get("delete", 0), "nodes": nodes.count(), "edges": edges.count(),
    }


def revision_graph(files: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """O-51: files(ref, path, language, content) -> symbols and edges of each file at each revision, resolved within it."""
    rows = extract_files(files, compat)
    nodes = nodes_of(rows)
    scope = nodes.groupBy("ref", "file_path", F.col("name").alias("ref_name")).agg(F.count("*").alias("n"), F.min("node_id").alias("to_id"))
    confidence = F.when(F.col("n") == 1, 1.0).when(F.col("language") == "java", 0.5).otherwise(0.4)
    found = refs_of(rows).join(scope, ["ref", "file_path", "ref_name"])
    ids = nodes.select("ref", F.col("node_id").alias("from_id"))
    edges = found.join(ids, ["ref", "from_id"], "left_semi").groupBy("ref", "kind", "from_id", "to_id").agg(F.max(confidence).alias("confidence"))
    return nodes.select("ref", *NODE_COLUMNS), edges


def embed(catalog: Catalog, model: str = "local/tfidf", full: bool = True, parts: int = 1) -> DataFrame:
    """O-33, O-61b: embeddings of all nodes, or without ``full`` of those that have none of this model.

    The run's row says running, with the nodes done after each of ``parts`` shares of
    the nodes (by hash), and completed in the end (ids count up).
    """
    from codeloom.operators.search import model as find

    dim, build = find(model)
    spark, nodes = catalog.spark, catalog.table("nodes").select("node_id", "name", "description")
    if not full:
        nodes = nodes.join(catalog.table("embeddings").where(F.col("embedding_model") == model).select("node_id"), "node_id", "left_anti")
    nodes = cut(nodes, "nodes")
    runs = cut(catalog.table("runs"), "runs")
    number = (runs.agg(F.max("id").alias("m")).first().m or 0) + 1
    total, done = nodes.count(), 0
    start = spark.range(1).select(F.current_timestamp().alias("t")).first().t

    def note(status: str) -> None:
        row = spark.createDataFrame([(number, total, done, status)], "id long, total_nodes int, processed_nodes int, status string")
        end = F.current_timestamp() if status == "completed" else F.lit(None).cast("timestamp")
        catalog.write("runs", runs.unionByName(row.select("*", F.lit(start).alias("started_at"), end.alias("completed_at"))))

    text = F.concat_ws(" ", "name", F.coalesce("description", F.lit("")))
    for part in range(parts):
        note("running")
        share = nodes.where(F.pmod(F.xxhash64("node_id"), F.lit(parts)) == part)
        made = build(share, "node_id", text, dim)
        fresh = made.select("node_id", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(model).alias("embedding_model"), F.current_timestamp().alias("created_at"))
        fresh = cut(fresh, "fresh")
        done += fresh.count()
        catalog.write("embeddings", upsert(cut(catalog.table("embeddings"), "embeddings"), fresh, ["node_id"]))
    note("completed")
    return catalog.table("embeddings")
