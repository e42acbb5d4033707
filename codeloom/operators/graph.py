"""Graph operators over edges(kind, from_id, to_id, confidence) (O-62 to O-70)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.plans.tables import cut


def outgoing(edges: DataFrame, node, kind: str = "calls") -> DataFrame:
    """O-62"""
    return edges.where((F.col("kind") == kind) & (F.col("from_id") == F.lit(node)))


def incoming(edges: DataFrame, node, kind: str = "calls") -> DataFrame:
    """O-63"""
    return edges.where((F.col("kind") == kind) & (F.col("to_id") == F.lit(node)))


def walk_levels(edges: DataFrame, start, depth: int | None, backwards: bool = False, until=None) -> list[DataFrame]:
    """(node, parent, confidence, depth) by level, level 0 being the start itself.

    One join per level for all its nodes together. Each level is written, so plans
    stay short and an executor's loss costs a task; a level is broadcast only where
    Spark finds it small enough.
    """
    spark = edges.sparkSession
    near, far = ("to_id", "from_id") if backwards else ("from_id", "to_id")
    steps = edges.select(F.col(near).alias("near"), F.col(far).alias("far"), "confidence")
    node_type = steps.schema["near"].dataType
    seen = cut(spark.range(1).select(F.lit(start).cast(node_type).alias("node"), F.lit(None).cast(node_type).alias("parent"), F.lit(None).cast("double").alias("confidence"), F.lit(0).alias("depth")), "seen")
    frontier, levels = seen, [seen]
    while depth is None or len(levels) <= depth:
        reached = steps.join(frontier.select(F.col("node").alias("near")), "near").join(seen.select(F.col("node").alias("far")), "far", "left_anti")
        best = reached.groupBy("far").agg(F.min("near").alias("parent"), F.min_by("confidence", "near").alias("confidence"))
        frontier = cut(best.select(F.col("far").alias("node"), "parent", "confidence", F.lit(len(levels)).alias("depth")), "level")
        # One look at a level says whether it has rows and whether the goal is among them.
        met = frontier.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("node") == F.lit(until)), F.lit(False)).alias("met")).first()
        if not met.n:
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier)
        if met.met:
            break
    return levels


def walk(edges: DataFrame, start, depth: int | None, backwards: bool = False) -> DataFrame:
    """O-64, O-65: (from_id, to_id, confidence, depth), one edge for each node reached, of the least parent (Q9)."""
    levels = walk_levels(edges, start, depth, backwards)
    found = levels[0].where("depth > 0")
    for level in levels[1:]:
        found = found.unionByName(level)
    ends = (F.col("node"), F.col("parent")) if backwards else (F.col("parent"), F.col("node"))
    return found.select(ends[0].alias("from_id"), ends[1].alias("to_id"), "confidence", "depth")


def callees(edges: DataFrame, node, depth: int = 1, kind: str = "calls") -> DataFrame:
    """O-64"""
    return walk(edges.where(F.col("kind") == kind), node, depth)


def callers(edges: DataFrame, node, depth: int = 1, kind: str = "calls") -> DataFrame:
    """O-65"""
    return walk(edges.where(F.col("kind") == kind), node, depth, backwards=True)


def call_path(edges: DataFrame, source, target, kind: str = "calls") -> DataFrame:
    """O-66: (step, from_id, to_id, confidence) of a shortest path; empty if there is none or source is target (Q12).

    From the target back, one row picks up its parent at each level in a chain of
    joins, which is one plan.
    """
    levels = walk_levels(edges.where(F.col("kind") == kind), source, None, until=target)
    step = F.struct(F.col("depth").cast("int").alias("step"), F.col("parent").alias("from_id"), F.col("node").alias("to_id"), "confidence")
    row = levels[-1].where((F.col("node") == F.lit(target)) & (F.col("depth") > 0)).select(F.col("parent").alias("at"), F.array(step).alias("path"))
    for level in reversed(levels[1:-1]):
        row = row.join(level.withColumnRenamed("node", "at"), "at").withColumn("node", F.col("at")).select(F.col("parent").alias("at"), F.concat(F.array(step), "path").alias("path"))
    return row.select(F.inline("path"))


def impacted(edges: DataFrame, nodes: DataFrame, node, depth: int = 10, kind: str = "calls") -> DataFrame:
    """O-67: nodes that reach ``node`` by calls, each once."""
    ids = callers(edges, node, depth, kind).select(F.col("from_id").alias("node_id")).distinct()
    return nodes.join(ids, "node_id", "left_semi")


def impact_summary(edges: DataFrame, node, depth: int = 2, many: int = 10) -> DataFrame:
    """O-67b"""
    found = callers(edges, node, depth)
    return found.agg(F.count("*").alias("callers"), F.count_if(F.col("confidence") < 1).alias("uncertain"), (F.count("*") > many).alias("warn"))


def relatives(edges: DataFrame, nodes: DataFrame, node, derived: bool = False) -> DataFrame:
    """O-68: one hop of inherits_from and implements, out (bases) or in (derived); an end found by both comes twice."""
    near, far = ("to_id", "from_id") if derived else ("from_id", "to_id")
    ends = edges.where(F.col("kind").isin("inherits_from", "implements") & (F.col(near) == F.lit(node))).select(F.col(far).alias("node_id"), F.col("kind").alias("relation"))
    return ends.join(nodes, "node_id")


def induced(nodes: DataFrame, edges: DataFrame, file_path: str | None = None, kinds=None, languages=None, edge_kinds=None) -> tuple[DataFrame, DataFrame]:
    """O-69: filtered nodes, and edges of the asked kinds between them; no kinds, no edges; "all" for every kind (Q38)."""
    if file_path is not None:
        nodes = nodes.where(F.col("file_path").contains(file_path))
    if kinds:
        nodes = nodes.where(F.col("kind").isin(*kinds))
    if languages:
        nodes = nodes.where(F.col("language").isin(*languages))
    if edge_kinds != "all":
        edges = edges.where(F.col("kind").isin(*edge_kinds) if edge_kinds else F.lit(False))
    return nodes, between(edges, nodes)


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi")


def module_of(node_id: Column, marker: str = "crates/", root: str = "root") -> Column:
    """O-70: the folder after ``marker`` in the id's directory, ``root`` for src or '.', else null."""
    directory = F.split(node_id, ":")[0]
    after = F.split(F.substring_index(directory, marker, -1), "/")[0]
    return F.when(directory.contains(marker), after).when(directory.contains("src") | (directory == "."), F.lit(root))


def module_rollup(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """O-70: counts of edges between different modules; ``modules(node_id, module)``, null is unknown and dropped.

    Edges are counted by their ends before the modules are joined, so that what is
    joined are distinct pairs and not edges.
    """
    pairs = edges.groupBy("from_id", "to_id").agg(F.count("*").alias("n"))
    known = modules.where("module IS NOT NULL")
    named = pairs.join(known.select(F.col("node_id").alias("from_id"), F.col("module").alias("from_module")), "from_id").join(
        known.select(F.col("node_id").alias("to_id"), F.col("module").alias("to_module")), "to_id"
    )
    return named.where("from_module != to_module").groupBy("from_module", "to_module").agg(F.sum("n").alias("n_edges"))


def key_nodes(nodes: DataFrame) -> DataFrame:
    """O-70b: nodes without tests, fixtures and unknown modules; needs ``module``."""
    name, path = F.lower("name"), F.lower("file_path")
    return nodes.where("module IS NOT NULL").where(~(name.contains("test") | path.contains("test") | path.contains("fixture")))


def diagram(rollup: DataFrame) -> DataFrame:
    """O-70b: the rollup as lines of a diagram in one text, most edges first."""
    line = F.concat(F.lit("    "), "from_module", F.lit(" -->|"), F.col("n_edges").cast("string"), F.lit(" calls| "), "to_module")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n_edges")).alias("o"), "from_module", "to_module", line.alias("line"))))
    return rollup.agg(F.concat(F.lit("graph TD\n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("diagram"))


def folder(path: Column) -> Column:
    """O-70c: a path without its last segment, ``root`` if there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("root"))


def text_filter(nodes: DataFrame, edges: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """O-70c: nodes whose name or path holds ``text`` in any case, and edges between them; without state (Q53)."""
    want = text.lower()
    kept = nodes.where(F.lower("name").contains(want) | F.lower("file_path").contains(want))
    return kept, between(edges, kept)
