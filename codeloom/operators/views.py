"""Derived views of editors, as projections (O-91)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.changes import format_signature


def hover(nodes: DataFrame) -> DataFrame:
    """(node_id, text): kind, name and signature, then the description and the place."""
    head = F.concat(F.lit("**"), "kind", F.lit("** `"), "name", format_signature(F.col("signatures")), F.lit("`"))
    return nodes.select("node_id", hover_text(head, F.col("description"), F.col("file_path"), F.col("start_line")).alias("text"))


def hover_text(head: Column, description: Column, path: Column, line: Column) -> Column:
    place = F.concat(path, F.lit(":"), line.cast("string"))
    return F.concat_ws("\n\n", head, F.nullif(description, F.lit("")), place)


def code_lenses(nodes: DataFrame, edges: DataFrame, kind: str = "calls") -> DataFrame:
    """(node_id, callers, callees): edges are counted on each side before the join with nodes."""
    calls = edges.where(F.col("kind") == kind)
    into = calls.groupBy(F.col("to_id").alias("node_id")).agg(F.count("*").alias("callers"))
    out = calls.groupBy(F.col("from_id").alias("node_id")).agg(F.count("*").alias("callees"))
    joined = nodes.select("node_id").join(into, "node_id", "left").join(out, "node_id", "left")
    return joined.select("node_id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


def call_lines(tree: DataFrame) -> DataFrame:
    """A walk's edges as indented lines, in the order of depth and ids."""
    return tree.select("depth", "from_id", "to_id", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("-> "), F.col("to_id").cast("string")).alias("line"))
