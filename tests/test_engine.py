import json
import math
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.api import CodeGraph
from codeloom.functions.text import cosine
from codeloom.operators import changes as ch
from codeloom.operators import enrich, graph, search
from codeloom.plans import index as ix
from codeloom.plans.ftsquery import Leaf, QueryError, parse, terms_of
from codeloom.plans.tables import Catalog, merge_edges, upsert
from codeloom.sources import files as sf
from codeloom.sources.vcs import Repository

PY = "class Base:\n    def run(self):\n        return helper(1)\n\nclass Child(Base):\n    pass\n\ndef helper(a):\n    return a\n"
RS = "/// Adds numbers.\npub fn add(a: i32) -> i32 { helper(a) }\nfn helper(a: i32) -> i32 { a }\n"


def scanned(spark, files):
    rows = spark.createDataFrame(list(files.items()), "path string, content string")
    return rows.select("path", sf.language_of(F.col("path")).alias("language"), "content", F.sha2("content", 256).alias("content_hash"))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    c = Catalog(spark, str(tmp_path_factory.mktemp("catalog")))
    manifests = spark.createDataFrame([("requirements.txt", "numpy>=1\n")], "path string, content string")
    counts = ix.index(c, scanned(spark, {"src/a.py": PY, "src/b.rs": RS}), manifests=manifests, sha="abc", is_dirty=True)
    return c, counts


def test_index_and_fields(spark, built):
    c, counts = built
    assert counts["files_parsed"] == 2 and counts["nodes_inserted"] == 6 and counts["files_failed"] == 0
    g = CodeGraph(c)
    edges = {(r.kind, r.from_id, r.to_id, r.confidence) for r in g.edges.collect()}
    # helper exists twice: the least id is taken, with low confidence (Q15).
    assert ("calls", "src:a.py:Base:run", "src:a.py:_:helper", 0.4) in edges and ("calls", "src:b.rs:_:add", "src:a.py:_:helper", 0.4) in edges
    assert ("inherits_from", "src:a.py:_:Child", "src:a.py:_:Base", 1.0) in edges and len(edges) == 3
    assert g.node("src:b.rs:_:add").first().description == "Adds numbers."
    assert [r.from_id for r in g.callers("src:a.py:_:helper", 0).orderBy("from_id").collect()] == ["src:a.py:Base:run", "src:b.rs:_:add"]
    assert [r.to_id for r in g.callees("src:a.py:Base:run").collect()] == ["src:a.py:_:helper"]
    assert [r.node_id for r in g.search("adds").collect()] == ["src:b.rs:_:add"]
    assert {r.name for r in g.semantic_search("helper").collect()} >= {"helper"}
    assert g.hybrid_search("add").count() >= 1 and g.search("adds", kind="class").count() == 0
    assert [r.name for r in g.project_dependencies().collect()] == ["numpy"]
    s = g.stats().first()
    assert (s.node_count, s.edge_count, s.file_count, s.last_git_sha) == (7, 3, 2, "abc+dirty") and s.last_indexed is not None
    assert [r.path for r in g.files().collect()] == ["src/a.py", "src/b.rs"]
    assert [r.node_id for r in g.bases("src:a.py:_:Child").collect()] == ["src:a.py:_:Base"]
    assert g.derived("src:a.py:_:Base").count() == 1
    assert g.graph_data(languages=["python"])[1].count() == 0 and g.graph_data(languages=["python"], edge_kinds="all")[1].count() == 2
    assert g.edge_nodes(g.edges).select("from.name").count() == 3
    assert c.incoming().where("to_id = 'src:a.py:_:helper'").count() == 2
    contents = spark.createDataFrame([("src/b.rs", RS)], "path string, content string")
    assert g.source_code(contents).where("node_id = 'src:b.rs:_:helper'").first().source_code == "fn helper(a: i32) -> i32 { a }"


def test_sql_functions_and_tools(spark, built):
    g = CodeGraph(built[0])
    g.register()
    assert [r.neighbour for r in spark.sql("SELECT * FROM callees('src:a.py:Base:run')").collect()] == ["src:a.py:_:helper"]
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM callers('src:a.py:_:helper', 3)").collect()) == [("src:a.py:Base:run", 1), ("src:b.rs:_:add", 1)]
    fields = g.node_fields(["src:a.py:_:Child", "src:b.rs:_:add"], spark.createDataFrame([("src/b.rs", RS)], "path string, content string"), sf.parse_lcov(spark.createDataFrame([("SF:src/b.rs\nDA:2,1\n",)], "content string")))
    rows = {r.node_id: r for r in fields.collect()}
    assert rows["src:a.py:_:Child"].bases == ["src:a.py:_:Base"] and rows["src:b.rs:_:add"].coverage == 1.0 and "helper(a)" in rows["src:b.rs:_:add"].source_code
    assert "nodes" in g.resource("schema") and json.loads(g.resource("stats"))["node_count"] == 7 and "roots" in g.resource("config")
    assert built[0].sql("SELECT count(*) AS n FROM nodes WHERE kind = :k", k="class").first().n == 2
    assert json.loads(g.call_tool("get_node", {"node_id": "src:b.rs:_:add"}))[0]["name"] == "add"
    assert json.loads(g.call_tool("find_callers", {"node_id": "x' OR '1'='1"})) == []
    with pytest.raises(KeyError):
        g.call_tool("nope", {})


def test_embeddings(spark, built):
    c, _ = built
    ix.embed(c)
    g = CodeGraph(c)
    status = g.embeddings_status().first()
    assert (status.total_nodes, status.processed_nodes, status.status) == (7, 7, "completed")
    top = g.semantic_search_embeddings("add Adds numbers.").first()
    assert top.node_id == "src:b.rs:_:add" and top.score == pytest.approx(1.0, abs=1e-6)
    with pytest.raises(ValueError):
        g.semantic_search_embeddings("x", model="other")


def test_incremental(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    first = {"src/a.py": PY, "src/b.rs": RS}
    ix.index(c, scanned(spark, first))
    again = ix.index(c, scanned(spark, first))
    assert again["files_parsed"] == 0 and again["edges"] == 3 and again["nodes"] == 6
    second = {"src/a.py": PY, "src/c.rs": RS.replace("{ a }", "{ a + 1 }")}
    changes = spark.createDataFrame([("src/c.rs", "Renamed", "src/b.rs")], "path string, status string, old_path string")
    ix.index(c, scanned(spark, second), changes=changes)
    rows = {r.node_id: r for r in c.table("nodes").collect()}
    assert "src:b.rs:_:add" not in rows and rows["src:c.rs:_:add"].renamed_from == "src:b.rs:_:add"  # Q34
    assert [r.path for r in c.table("files").orderBy("path").collect()] == ["src/a.py", "src/c.rs"]  # Q36
    third = ix.index(c, scanned(spark, {"src/a.py": PY.replace("def helper", "def other")}), full=True)
    assert third["nodes_deleted"] == 1 and "src:a.py:_:helper" not in {r.node_id for r in c.table("nodes").collect()}
    with pytest.raises(PermissionError):
        Catalog(spark, str(tmp_path), read_only=True).write("nodes", c.table("nodes"))


def test_revision_diff_and_graph(spark):
    a, b = "def f(x): return g(x)\ndef g(x): return 1\ndef old(): pass\n", "def f(x, y): return g(x)\ndef g(x): return 2\ndef new(): pass\n"
    revs = spark.createDataFrame([("v1", "m.py", a, "python"), ("v2", "m.py", b, "python"), ("v1", "o.py", a, "python"), ("v2", "n.py", a, "python")], "ref string, path string, content string, language string")
    changes = spark.createDataFrame([("m.py", "Modified", None)], "path string, status string, old_path string")
    g = CodeGraph(Catalog(spark, "/tmp/none-such"))
    got = {(r.symbol_name, r.change) for r in g.diff_symbols(revs, changes, "v1", "v2").collect()}
    assert got == {("f", "SIGNATURE_MODIFIED"), ("g", "BODY_MODIFIED"), ("old", "DELETED"), ("new", "ADDED")}
    moved = spark.createDataFrame([("n.py", "Renamed", "o.py")], "path string, status string, old_path string")
    assert {r.change for r in g.diff_symbols(revs, moved, "v1", "v2").collect()} == {"ADDED"}  # Q6
    assert g.diff_symbols(revs, moved, "v1", "v2", rename_aware=True).count() == 0
    _, edges = ix.revision_graph(revs)
    assert edges.where("ref = 'v1' AND from_id = '.:m.py:_:f'").first().to_id == ".:m.py:_:g"


def test_walks(spark):
    rows = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "d"), ("x", "y"), ("a", "b")]
    edges = spark.createDataFrame([("calls", x, y, 1.0) for x, y in rows], "kind string, from_id string, to_id string, confidence double")
    assert sorted((r.from_id, r.to_id, r.depth) for r in graph.callees(edges, "a", 5).collect()) == [("a", "b", 1), ("a", "c", 1), ("b", "d", 2)]  # Q9
    assert graph.callees(edges, "a", 0).count() == 0
    assert [(r.step, r.from_id, r.to_id) for r in graph.call_path(edges, "a", "d").orderBy("step").collect()] == [(1, "a", "b"), (2, "b", "d")]
    assert graph.call_path(edges, "a", "a").count() == 0 and graph.call_path(edges, "a", "y").count() == 0  # Q12
    s = graph.impact_summary(edges, "d").first()
    assert (s.callers, s.uncertain, s.warn) == (3, 0, False)


def test_merges_are_idempotent(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    old = spark.createDataFrame([("calls", "a", "b", 0.4)], "kind string, from_id string, to_id string, confidence double")
    new = spark.createDataFrame([("calls", "a", "b", 0.5, 1), ("calls", "a", "b", 1.0, 2), ("calls", "a", "z", 1.0, 3)], "kind string, from_id string, to_id string, confidence double, seq int")
    once = merge_edges(old, new, nodes, F.col("seq"))
    twice = merge_edges(once, new, nodes, F.col("seq"))
    assert once.collect() == twice.collect() and once.first().confidence == 1.0
    t = upsert(spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (1, "z")], "k int, v string"), ["k"], F.col("v"))
    assert [tuple(r) for r in t.collect()] == [(1, "z")]


def test_query_language(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma", "x"), (2, "beta alpha", "gamma delta"), (3, "Élan alphabet", "Dvořák Ωμέγα Alpha"), (4, None, None)], "id int, name string, description string")
    index = search.postings(df, "id", {"name": F.col("name"), "description": F.col("description")})
    ids = lambda q: sorted(r.id for r in search.full_text(index, q, None).collect())
    assert ids("alpha beta") == [1, 2] and ids('"alpha beta"') == [1] and ids("alpha*") == [1, 2, 3] and ids("elan OR gamma") == [1, 2, 3]
    assert ids("alpha NOT gamma") == [3] and ids("(alpha OR elan) NOT beta") == [3]
    assert ids("name : gamma") == [1] and ids("description : (gamma OR alpha)") == [2, 3] and ids("{name description} : gamma") == [1, 2] and ids("- name : gamma") == [2]
    assert ids("beta + gamma") == [1] and ids('"beta gam" *') == [1] and ids("^beta") == [2] and ids("name : ^alpha*") == [1]
    assert ids("NEAR(alpha gamma)") == [1] and ids("NEAR(alpha gamma, 0)") == [] and ids("NEAR(alpha gamma, 1)") == [1] and ids("NEAR(gamma beta alpha, 1)") == [1]
    # No phrase spans two columns.
    assert ids('"alpha gamma"') == [] and ids("NEAR(alpha gamma, 1) OR dvorak") == [1, 3] and ids("dvořák ωμεγα") == [3]
    for bad in ("", "(", "AND", '"x', "a OR", "...", "nope : a", "NEAR(a b, x)", "{name : a"):
        with pytest.raises(QueryError):
            parse(bad, ("name", "description"))
    assert terms_of(parse("a b a NOT c")) == [("leaf", Leaf(("a",))), ("leaf", Leaf(("b",)))]


def test_bm25_is_the_known_formula(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c d e f")], "id int, text string")
    got = {r.id: r.score for r in search.full_text(search.postings(df, "id", {"text": F.col("text")}), "a", None).collect()}
    idf = math.log((3 - 1 + 0.5) / 1.5)
    assert got[1] == pytest.approx(-idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 3)))


def test_fusion_is_symmetric_and_cosine_bounded(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id int, rank int")
    b = spark.createDataFrame([(2, 0), (3, 1)], "id int, rank int")
    assert search.fuse(a, b, 9, "id").collect() == search.fuse(b, a, 9, "id").collect()
    v = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r.c, 9) for r in v.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0, -1.0]


def test_skeletons(spark):
    py = "def outer():\n    x = 1\n    def inner():\n        return 2\n    return 3\ny = 1\n"
    rs = "fn a() {\n    1;\n    2;\n}\nfn b() { 3 }\n"
    files = spark.createDataFrame([("a.py", "python", py), ("b.rs", "rust", rs), ("c.rs", "rust", "no functions\n")], "path string, language string, content string")
    spans = spark.createDataFrame([("a.py", 1, 5), ("a.py", 3, 4), ("b.rs", 1, 4), ("b.rs", 5, 5)], "path string, start_line int, end_line int")
    got = {r.path: r.skeleton for r in enrich.skeleton(files, spans).collect()}
    assert got == {"a.py": "def outer():\n    pass\ny = 1\n", "b.rs": "fn a() {\n    // ...\n}\nfn b() { 3 }\n", "c.rs": "no functions\n"}  # Q45


def test_ids_and_config(tmp_path):
    assert schemas.build_node_id("d", "", None, "x") == "d:_:_:x" and schemas.build_node_id("d", "f", "A<b::C>", "x").count(":") == 3  # Q14
    with pytest.raises(ValueError):
        schemas.build_node_id("d" * 600, "f", "", "x")
    p = tmp_path / "c.json"
    p.write_text('{"indexing": {"max_file_size_kb": 5}}')
    assert sf.Config.read(str(p)).indexing.max_file_size_kb == 5 and sf.Config.read(str(tmp_path / "no")).git.enabled
    p.write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        sf.Config.read(str(p))


def test_file_scan(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1\n", "target/b.rs": "fn", "c.txt": "no", "big.go": "x" * 3000, "l.go": "package é\n"}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r.content for r in sf.scan_files(spark, str(tmp_path), max_kb=2).collect()}
    assert got == {"src/a.py": "x = 1\n", "l.go": "package é\n"}


def test_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n" * 9)
    run("add", ".")
    run("commit", "-qm", "one")
    repo = Repository(spark, str(tmp_path))
    first = repo.head()
    run("mv", "a.py", "b.py")
    (tmp_path / "c.py").write_text("y\n")
    run("add", ".")
    run("commit", "-qm", "two")
    assert sorted(map(tuple, repo.changes(first).collect())) == [("b.py", "Renamed", "a.py"), ("c.py", "Added", None)]
    assert not repo.dirty() and sorted(r.path for r in repo.changed_paths(first).collect()) == ["b.py", "c.py"]
    (tmp_path / "d e.py").write_text("z\n")
    assert repo.dirty() and [r.path for r in repo.active_files().collect()] == ["d e.py"]
    assert [r.content for r in repo.blobs(first, ["a.py", "none"]).collect()] == ["x = 1\n" * 9]


def test_hooks(spark):
    df = spark.sql("SELECT array(named_struct('go', true, 'metadata', map('a', '1')), named_struct('go', false, 'metadata', map('a', '2')), named_struct('go', true, 'metadata', map('b', '3'))) AS r")
    out = df.select(enrich.hook_fold(F.col("r")).alias("o")).first().o
    assert out.go is False and out.metadata == {"a": "2"}


def test_dirty_and_hash_gate(spark):
    scan = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    known = spark.createDataFrame([("a", "1"), ("b", "0")], "path string, content_hash string")
    only = spark.createDataFrame([("a",), ("b",)], "path string")
    more = spark.createDataFrame([("c",)], "path string")
    assert sorted(r.path for r in ch.files_to_index(scan, known).collect()) == ["b", "c"]
    assert sorted(r.path for r in ch.files_to_index(scan, known, only).collect()) == ["b"]
    assert sorted(r.path for r in ch.files_to_index(scan, known, only, more).collect()) == ["b", "c"]  # Q33


def test_views(spark, built):
    from codeloom.operators import views

    g = CodeGraph(built[0])
    text = {r.node_id: r.text for r in views.hover(g.nodes).collect()}
    assert text["src:b.rs:_:add"] == "**function** `add(a: i32) -> i32`\n\nAdds numbers.\n\nsrc/b.rs:2"
    lens = {r.node_id: (r.callers, r.callees) for r in views.code_lenses(g.nodes, g.edges).collect()}
    assert lens["src:a.py:_:helper"] == (2, 0) and lens["src:b.rs:_:add"] == (0, 1)
    assert [r.line for r in views.call_lines(g.callees("src:b.rs:_:add")).collect()] == ["  -> src:a.py:_:helper"]


def test_module_rules(spark):
    df = spark.createDataFrame([("crates/core/src:a.rs:_:f",), ("src:m.rs:_:g",), (".:m.rs:_:g",), ("docs:x:_:y",)], "id string")
    assert [r.m for r in df.select(graph.module_of(F.col("id")).alias("m")).collect()] == ["core", "root", "root", None]
    paths = spark.createDataFrame([("a/b/c.py",), ("x.py",)], "p string")
    assert [r.f for r in paths.select(graph.folder(F.col("p")).alias("f")).collect()] == ["a/b", "root"]


def test_tests_of_nodes(spark, built):
    nodes = spark.createDataFrame([("f", "load", "function", "src/a.py"), ("t", "test_load_twice", "function", "src/b.py"), ("u", "test_other", "function", "tests/c.py"), ("v", "test_none", "class", "src/d.py")], "node_id string, name string, kind string, file_path string")
    got = {(r.target_id, r.test_id) for r in enrich.test_association(nodes, nodes.where("node_id = 'f'")).collect()}
    assert got == {("f", "t"), (None, "u")}  # Q43


def test_command_line(spark, tmp_path, capsys):
    from codeloom.__main__ import main

    root = tmp_path / "code"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.py").write_text(PY)
    (root / "requirements.txt").write_text("numpy>=1\n")
    git = lambda *x: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *x], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")

    def run(*args):
        capsys.readouterr()
        assert main(["--catalog", str(tmp_path / "catalog"), "--path", str(root), *args], spark) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    run("init")
    assert run("index")[0]["nodes"] == 5
    assert run("get", "src:a.py:_:helper")[0]["name"] == "helper" and run("search", "helper", "--hybrid")[0]["name"] == "helper"
    assert run("callers", "src:a.py:_:helper")[0]["from_id"] == "src:a.py:Base:run" and run("bases", "src:a.py:_:Child")[0]["relation"] == "inherits_from"
    assert run("call-path", "src:a.py:Base:run", "src:a.py:_:helper")[0]["step"] == 1 and run("dependencies")[0]["name"] == "numpy"
    assert run("query", "SELECT count(*) AS n FROM nodes")[0]["n"] == 5 and run("stats")[0]["file_count"] == 1
    assert run("embed", "--full")[0]["embedded"] == 5 and len(run("ask", "helper")) == 5
    (root / "src" / "a.py").write_text(PY.replace("def helper(a)", "def helper(a, b)"))
    git("commit", "-qam", "two")
    assert {r["name"] for r in run("changed", "HEAD~1")} == {"Base", "run", "Child", "helper"}
    assert [r["change"] for r in run("diff-symbols", "HEAD~1", "HEAD")] == ["SIGNATURE_MODIFIED"]
    assert {r.get("name") for r in run("timeline", "src/a.py", "--ref", "HEAD~1")} >= {"helper"} and run("models")[0]["dimension"] == 100
    tools = CodeGraph(Catalog(spark, str(tmp_path / "catalog")))
    assert len(json.loads(tools.call_tool("changed_since", {"git_ref": "HEAD~1"}, str(root)))) == 4
    assert {r["row"] for r in json.loads(tools.call_tool("timeline", {"file_path": "src/a.py"}, str(root)))} == {"node", "edge"}


def test_catalog_without_a_folder(spark):
    c = Catalog(spark)
    ix.index(c, scanned(spark, {"src/a.py": PY}))
    assert c.table("nodes").count() == 4 and CodeGraph(c).search("helper").count() == 1
    ix.index(c, scanned(spark, {"src/a.py": PY.replace("def helper", "def other")}))
    assert CodeGraph(c).search("helper").count() == 0 and CodeGraph(c).search("other").count() == 1
    ix.embed(c, parts=3)
    assert CodeGraph(c).embeddings_status().first().processed_nodes == 4 and c.table("embeddings").count() == 4
