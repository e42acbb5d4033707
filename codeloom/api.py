"""The query surface: one method for each root field, each returning DataFrames (§2.11)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import changes as ch
from codeloom.operators import enrich, graph, search
from codeloom.plans.tables import Catalog, text_columns
from codeloom.plans.textindex import stored_weights


class CodeGraph:
    """A read-only view of a catalog (Q50). Depths are clamped to 1 and more here only (Q10)."""

    def __init__(self, catalog: Catalog):
        self.c = catalog

    @property
    def nodes(self) -> DataFrame:
        return self.c.table("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.c.table("edges")

    def _full_text(self):
        sigs = F.array_join(F.flatten(F.transform("signatures", lambda s: F.concat(F.flatten(F.transform(s["params"], lambda p: F.array(p["name"], F.coalesce(p["type"], F.lit(""))))), F.array(F.coalesce(s["returns"], F.lit("")))))), " ")
        return F.concat_ws(" ", "name", F.coalesce("description", F.lit("")), sigs)

    def _with_nodes(self, scored: DataFrame, descending: bool) -> DataFrame:
        order = F.desc("score") if descending else F.asc("score")
        return scored.join(self.nodes, "node_id").orderBy(order, "node_id")

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("node_id") == node_id)

    def nodes_for_files(self, paths: list[str]) -> DataFrame:
        """O-20"""
        return self.nodes.where(F.col("file_path").isin(*paths)) if paths else self.nodes.limit(0)

    def search(self, query: str, limit: int = 20, kind: str | None = None, prefilter: bool = False) -> DataFrame:
        """O-52, O-55: the kind filter comes after the limit, or before it with ``prefilter`` (Q4)."""
        if kind and prefilter:
            index = search.postings(self.nodes.where(F.col("kind") == kind), "node_id", text_columns())
        else:
            index = self.c.postings()
        found = self._with_nodes(search.full_text(index, query, limit), False)
        return found.where(F.col("kind") == kind) if kind else found

    def _weights(self) -> DataFrame:
        """O-60: the TF-IDF table of this version of the nodes; the first search makes it."""
        return stored_weights(self.nodes, "node_id", self._full_text(), self.c.search_path())

    def semantic_search(self, query: str, limit: int = 20) -> DataFrame:
        return self._with_nodes(search.tfidf_search(self._weights(), query, limit, "node_id"), True)

    def hybrid_search(self, query: str, limit: int = 20) -> DataFrame:
        return self._with_nodes(search.hybrid(self.c.postings(), self._weights(), query, limit), True)

    def semantic_search_embeddings(self, query: str, model: str = "local/tfidf", limit: int = 20) -> DataFrame:
        """O-61d"""
        dim, build = search.model(model)
        asked = self.c.spark.createDataFrame([("q", query)], "node_id string, text string")
        vector = build(asked, "node_id", F.col("text"), dim).select("embedding").scalar()
        stored = self.c.table("embeddings").where(F.col("embedding_model") == model)
        return self._with_nodes(search.nearest(stored, vector, limit, "node_id"), True)

    def embeddings_status(self) -> DataFrame:
        return search.embedding_status(self.c.table("runs"))

    def callers(self, node_id: str, depth: int = 1) -> DataFrame:
        return graph.callers(self.c.incoming(), node_id, max(1, depth))

    def callees(self, node_id: str, depth: int = 1) -> DataFrame:
        return graph.callees(self.edges, node_id, max(1, depth))

    def call_path(self, source: str, target: str) -> DataFrame:
        return graph.call_path(self.edges, source, target)

    def impacted_symbols(self, node_id: str, depth: int = 10) -> DataFrame:
        return graph.impacted(self.c.incoming(), self.nodes, node_id, max(1, depth))

    def impact_summary(self, node_id: str, depth: int = 2) -> DataFrame:
        return graph.impact_summary(self.c.incoming(), node_id, depth)

    def bases(self, node_id: str) -> DataFrame:
        return graph.relatives(self.edges, self.nodes, node_id)

    def derived(self, node_id: str) -> DataFrame:
        return graph.relatives(self.c.incoming(), self.nodes, node_id, derived=True)

    def graph_data(self, **filters) -> tuple[DataFrame, DataFrame]:
        return graph.induced(self.nodes, self.edges, **filters)

    def edge_nodes(self, edges: DataFrame) -> DataFrame:
        """Q47: edges with their ends' rows as ``from`` and ``to``."""
        row = F.struct(*self.nodes.columns)
        a = self.nodes.select(F.col("node_id").alias("from_id"), row.alias("from"))
        b = self.nodes.select(F.col("node_id").alias("to_id"), row.alias("to"))
        return edges.join(a, "from_id").join(b, "to_id")

    def stats(self) -> DataFrame:
        return enrich.stats(self.nodes, self.edges, self.c.table("files"), self.c.table("index_meta"))

    def files(self) -> DataFrame:
        return self.c.table("files").select("path").orderBy("path")

    def project_dependencies(self) -> DataFrame:
        """O-82 (Q1)"""
        return self.nodes.where("kind = 'dependency'")

    def changed_since(self, changes: DataFrame) -> DataFrame:
        return ch.changed_since(self.nodes, changes)

    def active_context(self, dirty: DataFrame) -> DataFrame:
        return ch.changed_since(self.nodes, dirty)

    def diff_symbols(self, revisions: DataFrame, changes: DataFrame, old: str, new: str, rename_aware: bool = False) -> DataFrame:
        from codeloom.extract.table import extract_files, nodes_of

        return ch.revision_diff(revisions, changes, old, new, lambda f: nodes_of(extract_files(f)), rename_aware)

    def file_skeleton(self, contents: DataFrame) -> DataFrame:
        """O-81: contents(path, language, content)"""
        spans = self.nodes.where("kind = 'function'").select(F.col("file_path").alias("path"), "start_line", "end_line")
        return enrich.skeleton(contents, spans)

    def source_code(self, contents: DataFrame) -> DataFrame:
        """O-17: contents(path, content)"""
        joined = self.nodes.join(contents.select(F.col("path").alias("file_path"), "content"), "file_path")
        return joined.select("node_id", enrich.snippet(F.col("content"), F.col("start_line"), F.col("end_line")).alias("source_code"))

    def tests(self, targets: list[str]) -> DataFrame:
        """O-79: (target_id, test_id) of stated targets."""
        return enrich.tests_of(self.nodes, targets)

    def node_fields(self, node_ids: list[str], contents: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
        """All fields of stated nodes in one row each: sourceCode, tests, coverage, bases and derived beside the columns."""
        out = self.nodes.where(F.col("node_id").isin(*node_ids))
        tests = self.tests(node_ids).groupBy(F.col("target_id").alias("node_id")).agg(F.array_sort(F.collect_set("test_id")).alias("tests"))
        kinds = F.col("kind").isin("inherits_from", "implements")
        up = self.edges.where(kinds & F.col("from_id").isin(*node_ids)).groupBy(F.col("from_id").alias("node_id")).agg(F.array_sort(F.collect_list("to_id")).alias("bases"))
        down = self.c.incoming().where(kinds & F.col("to_id").isin(*node_ids)).groupBy(F.col("to_id").alias("node_id")).agg(F.array_sort(F.collect_list("from_id")).alias("derived"))
        for part in (tests, up, down):
            out = out.join(part, "node_id", "left")
        none = F.array().cast("array<string>")
        out = out.withColumns({c: F.coalesce(c, none) for c in ("tests", "bases", "derived")})
        if contents is not None:
            out = out.join(contents.select(F.col("path").alias("file_path"), "content"), "file_path", "left")
            out = out.withColumn("source_code", enrich.snippet(F.col("content"), F.col("start_line"), F.col("end_line"))).drop("content")
        if lines is not None:
            asked = self.nodes.where(F.col("node_id").isin(*node_ids))
            out = out.join(enrich.line_coverage(asked, lines), "node_id", "left")
        return out

    def coverage(self, lines: DataFrame) -> DataFrame:
        return enrich.line_coverage(self.nodes, lines)

    def timeline(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        from codeloom.plans.index import revision_graph

        return revision_graph(files)

    def register(self, most: int = 5) -> None:
        """Views of all tables, and SQL table functions for walks: SELECT * FROM callees('id', 2).

        A row is a node reached, with the fewest steps to it, by up to ``most`` steps.
        """
        self.c.views()
        self.c.incoming().createOrReplaceTempView("edges_by_target")
        for name, table, near, far in (("callees", "edges", "from_id", "to_id"), ("callers", "edges_by_target", "to_id", "from_id")):
            hop = lambda i: f"SELECT DISTINCT e.{far} AS node, {i} AS depth FROM {table} AS e JOIN l{i - 1} ON e.{near} = l{i - 1}.node WHERE e.kind = 'calls' AND l{i - 1}.depth < {name}.depth"  # noqa: B023, E731
            steps = [f"l1 AS (SELECT DISTINCT {far} AS node, 1 AS depth FROM {table} WHERE kind = 'calls' AND {near} = {name}.node)", *(f"l{i} AS ({hop(i)})" for i in range(2, most + 1))]
            union = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, most + 1))
            self.c.spark.sql(
                f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(node STRING, depth INT DEFAULT 1) RETURNS TABLE (neighbour STRING, depth INT) "
                f"RETURN WITH {', '.join(steps)} SELECT node, min(depth) FROM ({union}) AS x GROUP BY node"
            )

    def resource(self, name: str, config=None) -> str:
        """The resources of the agent interface as text: schema, stats, config."""
        from dataclasses import asdict

        from codeloom.schemas import TABLES
        from codeloom.sources.files import Config

        if name == "schema":
            return "\n".join(f"{table}: {schema.simpleString()}" for table, schema in TABLES.items())
        if name == "stats":
            return self.stats().select("node_count", "edge_count", "file_count", "last_git_sha").toJSON().first()
        if name == "config":
            return json.dumps(asdict(config or Config()), indent=2)
        raise KeyError(f"unknown resource {name!r}")

    def call_tool(self, name: str, arguments: dict, root: str = ".", limit: int = 1000) -> str:
        """The agent tools as JSON text: a list of rows (Q52), at most ``limit`` of them."""
        from codeloom.plans.index import embed
        from codeloom.sources.vcs import Repository

        spark = self.c.spark

        def timeline(a: dict) -> DataFrame:
            nodes, edges = self.timeline(Repository(spark, root).blobs(a.get("git_ref") or "HEAD", [a["file_path"]]))
            return nodes.select(F.lit("node").alias("row"), F.to_json(F.struct(*nodes.columns)).alias("value")).union(edges.select(F.lit("edge"), F.to_json(F.struct(*edges.columns))))

        tools = {
            "get_node": lambda a: self.node(a["node_id"]),
            "search": lambda a: self.search(a["query"], a.get("limit", 20), a.get("kind")),
            "find_callers": lambda a: self.callers(a["node_id"], a.get("depth", 1)),
            "find_callees": lambda a: self.callees(a["node_id"], a.get("depth", 1)),
            "changed_since": lambda a: self.changed_since(Repository(spark, root).changed_paths(a["git_ref"])),
            "timeline": timeline,
            "stats": lambda a: self.stats(),
            "embed": lambda a: embed(self.c, full=a.get("full", False)).agg(F.count("*").alias("embedded")),
            "ask": lambda a: self.semantic_search_embeddings(a.get("query") or a["question"], limit=a.get("limit", 20)),
            "query_graph": lambda a: self.c.sql(a["query"], **(a.get("variables") or a.get("parameters") or {})),
        }
        if name not in tools:
            raise KeyError(f"unknown tool {name!r}")
        return json.dumps([json.loads(x) for x in tools[name](arguments).limit(limit).toJSON().collect()])
