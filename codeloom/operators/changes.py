"""Diff, change-set and incremental operators (O-31, O-71 to O-78)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def format_signature(signatures: Column) -> Column:
    """O-72: the first signature as ``(a: T, b) -> R``; ``()`` without one."""
    s = F.get(signatures, F.lit(0))
    params = F.transform(s["params"], lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["type"]), F.lit(""))))
    text = F.concat(F.lit("("), F.coalesce(F.array_join(params, ", "), F.lit("")), F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), s["returns"]), F.lit("")))
    return F.when(s.isNull(), F.lit("()")).otherwise(text)


def symbol_diff(old: DataFrame, new: DataFrame, key: str = "node_id", signature: str = "signature", body: str = "content_hash") -> DataFrame:
    """O-71: (key, change, old_signature, new_signature) of symbols that differ between two revisions."""
    a = old.select(F.col(key), F.col(signature).alias("old_signature"), F.col(body).alias("_old_body"), F.lit(True).alias("_a"))
    b = new.select(F.col(key), F.col(signature).alias("new_signature"), F.col(body).alias("_new_body"), F.lit(True).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "ADDED")
        .when(F.col("_b").isNull(), "DELETED")
        .when(~F.col("old_signature").eqNullSafe(F.col("new_signature")), "SIGNATURE_MODIFIED")
        .when(~F.col("_old_body").eqNullSafe(F.col("_new_body")), "BODY_MODIFIED")
    )
    return a.join(b, key, "full").select(key, change.alias("change"), "old_signature", "new_signature").where("change IS NOT NULL")


def revision_diff(revisions: DataFrame, changes: DataFrame, old: str, new: str, extract, rename_aware: bool = False) -> DataFrame:
    """O-73: symbols that differ between two revisions in changed files.

    revisions(ref, path, content, language); changes(path, status, old_path) between
    the two revisions (Q5). A renamed file is compared under its new path; with
    ``rename_aware`` its old content is taken from the old path (Q6).
    """
    paths = changes.select("path", "old_path").distinct()
    was = F.when(F.lit(rename_aware), F.coalesce("old_path", "path")).otherwise(F.col("path"))
    before = revisions.where(F.col("ref") == old).join(paths.select(was.alias("path"), F.col("path").alias("_as")), "path").withColumn("path", F.col("_as")).drop("_as")
    after = revisions.where(F.col("ref") == new).join(paths.select("path"), "path", "left_semi")
    symbols = lambda files: extract(files).withColumn("signature", format_signature(F.col("signatures")))
    out = symbol_diff(symbols(before), symbols(after))
    part = F.split("node_id", ":")
    return out.withColumns({"symbol_name": part[3], "file_name": part[1]})


def changed_since(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """O-74, O-75: nodes of the files in ``changes(path)``, which are relative to the repository (Q32)."""
    return nodes.join(changes.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")


def node_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """O-31: (node_id, action): insert, update (hash, first or last line differ), delete, or keep."""
    cols = ("content_hash", "start_line", "end_line")
    a = old.select("node_id", F.struct(*cols).alias("a"))
    b = new.select("node_id", F.struct(*cols).alias("b"))
    action = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(F.col("a") != F.col("b"), "update").otherwise("keep")
    return a.join(b, "node_id", "full").select("node_id", action.alias("action"))


def files_to_index(scanned: DataFrame, files: DataFrame, changes: DataFrame | None = None, dirty: DataFrame | None = None) -> DataFrame:
    """O-76: scanned files that are new or whose content differs.

    With a change set, only files in it or in the dirty list are looked at, and the
    content hash decides in the end (Q33).
    """
    if changes is not None:
        paths = changes.select("path")
        if dirty is not None:
            paths = paths.unionByName(dirty.select("path"))
        scanned = scanned.join(paths.distinct(), "path", "left_semi")
    known = files.select("path", F.col("content_hash").alias("_known"))
    return scanned.join(known, "path", "left").where(~F.col("_known").eqNullSafe(F.col("content_hash"))).drop("_known")


def apply_changes(changes: DataFrame) -> DataFrame:
    """O-77: (path, action): drop or parse. A rename drops the old path and parses the new one, a copy only adds (Q35)."""
    drops = changes.where("status = 'Deleted'").select("path").unionByName(changes.where("status = 'Renamed'").select(F.col("old_path").alias("path")))
    parses = changes.where("status IN ('Added', 'Modified', 'Renamed')").select("path")
    return drops.distinct().select("path", F.lit("drop").alias("action")).unionByName(parses.distinct().select("path", F.lit("parse").alias("action")))


def renamed_from(nodes: DataFrame, old_nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Q34: nodes of renamed files with the id that the same class and symbol had at the old path."""
    part = F.split("node_id", ":")
    moved = changes.where("status = 'Renamed'").select(F.col("path").alias("file_path"), "old_path")
    before = old_nodes.select(F.col("file_path").alias("old_path"), part[2].alias("_c"), part[3].alias("_s"), F.col("node_id").alias("_was"))
    before = before.groupBy("old_path", "_c", "_s").agg(F.min("_was").alias("_was"))
    named = nodes.withColumns({"_c": part[2], "_s": part[3]}).join(moved, "file_path", "left").join(before, ["old_path", "_c", "_s"], "left")
    return named.withColumn("renamed_from", F.coalesce("_was", "renamed_from")).select(*nodes.columns)


def stamp(sha: Column, dirty: Column) -> Column:
    """O-78: the revision, with +dirty where the tree is."""
    return F.concat(sha, F.when(dirty, "+dirty").otherwise(""))


def clean_stamp(stamped: Column) -> Column:
    return F.regexp_replace(stamped, r"\+dirty$", "")
