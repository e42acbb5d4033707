"""Command line over a catalog: python -m codeloom --catalog DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.api import CodeGraph
from codeloom.operators import graph, search
from codeloom.plans.index import embed, index
from codeloom.plans.tables import Catalog
from codeloom.sources.files import Config, scan_files
from codeloom.sources.manifests import read_manifests
from codeloom.sources.vcs import Repository

NODE_COLUMNS = ("node_id", "kind", "name", "file_path", "start_line", "end_line")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom")
    p.add_argument("--catalog", default="codeloom-catalog", help="folder of the tables")
    p.add_argument("--path", default=".", help="root of the code")
    p.add_argument("--limit", type=int, default=100, help="rows printed at most")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str, **options) -> None:
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x)
        for k, v in options.items():
            c.add_argument(f"--{k}", **v)

    flag, depth = {"action": "store_true"}, lambda n: {"type": int, "default": n}
    add("init")
    add("index", full=flag)
    add("query", "sql")
    add("get", "node_id")
    add("search", "text", kind={}, semantic=flag, hybrid=flag)
    add("callers", "node_id", depth=depth(1))
    add("callees", "node_id", depth=depth(1))
    add("changed", "ref")
    add("stats")
    add("bases", "node_id")
    add("derived", "node_id")
    add("diff-symbols", "old", "new")
    add("call-path", "source", "target")
    add("impact", "node_id", depth=depth(3))
    add("dependencies")
    add("active-context")
    add("embed", full=flag, model={"default": "local/tfidf"})
    add("models")
    add("ask", "question")
    add("graph")
    add("timeline", "file", ref={"default": "HEAD"})
    add("resource", "name")
    return p


def show(df: DataFrame, limit: int) -> None:
    """Rows as JSON lines, no more than asked for."""
    for line in df.limit(limit).toJSON().collect():
        print(line)


def run_index(spark: SparkSession, catalog: Catalog, root: str, config: Config, full: bool) -> dict[str, int]:
    repo = Repository(spark, root)
    sha = repo.head_or_none()
    scanned = scan_files(spark, root, config.indexing.max_file_size_kb, tuple(config.indexing.ignore))
    return index(catalog, scanned, manifests=read_manifests(spark, root), sha=sha, is_dirty=sha is not None and repo.dirty(), full=full, compat=config.indexing.compat)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    config = Config.read(f"{a.path}/codeloom.json")
    if a.command == "init":
        with open(f"{a.path}/codeloom.json", "x", encoding="utf-8") as f:
            json.dump(asdict(config), f, indent=2)
        return 0
    if a.command == "models":
        for name, (dim, _) in search.MODELS.items():
            print(json.dumps({"model": name, "dimension": dim}))
        return 0
    spark = spark or SparkSession.builder.appName("codeloom").getOrCreate()
    catalog = Catalog(spark, a.catalog, read_only=a.command not in ("index", "embed"))
    g = CodeGraph(catalog)
    brief = lambda df: df.select(*[c for c in (*NODE_COLUMNS, "relation", "score") if c in df.columns])
    if a.command == "index":
        print(json.dumps(run_index(spark, catalog, a.path, config, a.full)))
    elif a.command == "query":
        show(catalog.sql(a.sql), a.limit)
    elif a.command == "get":
        show(g.node(a.node_id), a.limit)
    elif a.command == "search":
        found = g.hybrid_search(a.text) if a.hybrid else g.semantic_search(a.text) if a.semantic else g.search(a.text, kind=a.kind)
        show(brief(found), a.limit)
    elif a.command in ("callers", "callees"):
        show(getattr(g, a.command)(a.node_id, a.depth), a.limit)
    elif a.command == "changed":
        show(brief(g.changed_since(Repository(spark, a.path).changed_paths(a.ref))), a.limit)
    elif a.command == "stats":
        show(g.stats(), 1)
    elif a.command in ("bases", "derived"):
        show(brief(getattr(g, a.command)(a.node_id)), a.limit)
    elif a.command == "diff-symbols":
        repo = Repository(spark, a.path)
        show(g.diff_symbols(repo.changed_blobs(a.old, a.new), repo.changes(a.old, a.new), a.old, a.new), a.limit)
    elif a.command == "call-path":
        show(g.call_path(a.source, a.target).orderBy("step"), a.limit)
    elif a.command == "impact":
        show(brief(g.impacted_symbols(a.node_id, a.depth)), a.limit)
    elif a.command == "dependencies":
        show(g.project_dependencies().select("node_id", "name", "description"), a.limit)
    elif a.command == "active-context":
        show(brief(g.active_context(Repository(spark, a.path).active_files())), a.limit)
    elif a.command == "embed":
        print(json.dumps({"embedded": embed(catalog, a.model, a.full).where(F.col("embedding_model") == a.model).count()}))
    elif a.command == "ask":
        show(brief(g.semantic_search_embeddings(a.question)), a.limit)
    elif a.command == "graph":
        modules = g.nodes.select("node_id", graph.module_of(F.col("node_id")).alias("module"))
        show(graph.diagram(graph.module_rollup(g.edges, modules)), a.limit)
    elif a.command == "timeline":
        nodes, edges = g.timeline(Repository(spark, a.path).blobs(a.ref, [a.file]))
        show(brief(nodes), a.limit)
        show(edges, a.limit)
    elif a.command == "resource":
        print(g.resource(a.name, config))
    return 0


if __name__ == "__main__":
    sys.exit(main())
