"""Node enrichments and small aggregates (O-17, O-79 to O-89)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snippet(content: Column, start: Column, end: Column) -> Column:
    """O-17: lines start to end, counted from 1, both included."""
    lines = F.split(content, "\n")
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(F.least(end, F.size(lines)) - first + 1, F.lit(0))), "\n")


def test_association(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """O-79: (target_id, test_id): functions named like a test that name the target, or lie in a test path (Q43).

    Tests in test paths go with every target by definition, which one row with a
    null target says for all of them; the pairs by name are found by an equi-join on
    the substrings of a test's name that are some target's length, instead of
    comparing every test with every target.
    """
    tests = nodes.where((F.col("kind") == "function") & F.lower("name").contains("test")).select(F.col("node_id").alias("test_id"), F.lower("name").alias("tn"), F.lower("file_path").contains("test").alias("in_tests"))
    wanted = targets.select(F.col("node_id").alias("target_id"), F.lower("name").alias("n")).withColumn("len", F.length("n"))
    lengths = wanted.select("len").distinct().agg(F.collect_set("len").alias("l")).scalar()
    grams = tests.where("NOT in_tests").withColumn("len", F.explode(lengths)).where("len <= length(tn)")
    at = F.sequence(F.lit(1), F.length("tn") - F.col("len") + 1)
    grams = grams.select("test_id", "len", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring("tn", i, F.col("len"))))).alias("n"))
    by_name = wanted.join(grams, ["n", "len"]).select("target_id", "test_id")
    everywhere = tests.where("in_tests").select(F.lit(None).cast(targets.schema["node_id"].dataType).alias("target_id"), "test_id")
    return by_name.unionByName(everywhere)


def tests_of(nodes: DataFrame, targets: list[str]) -> DataFrame:
    """O-79: (target_id, test_id) of stated targets: one pass over the tests, each compared with these targets only."""
    asked = nodes.where(F.col("node_id").isin(*targets)).agg(F.collect_set(F.struct(F.col("node_id").alias("id"), F.lower("name").alias("name"))).alias("t")).scalar()
    tests = nodes.where((F.col("kind") == "function") & F.lower("name").contains("test"))
    pairs = tests.select(F.col("node_id").alias("test_id"), F.lower("name").alias("tn"), F.lower("file_path").contains("test").alias("in_tests"), F.explode(asked).alias("t"))
    return pairs.where(F.col("in_tests") | F.col("tn").contains(F.col("t.name"))).select(F.col("t.id").alias("target_id"), "test_id")


def substring_pairs(parts: DataFrame, part: str, wholes: DataFrame, whole: str) -> DataFrame:
    """(part, whole) of distinct strings one of which contains the other: an equi-join on the whole's substrings that are as long as some part."""
    named = parts.select(F.col(part).alias("part")).distinct().withColumn("len", F.length("part"))
    lengths = named.select("len").distinct().agg(F.collect_set("len").alias("l")).scalar()
    sized = wholes.select(F.col(whole).alias("whole")).distinct().withColumn("len", F.explode(lengths)).where("len <= length(whole) AND len > 0")
    at = F.sequence(F.lit(1), F.length("whole") - F.col("len") + 1)
    grams = sized.select("whole", "len", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring("whole", i, F.col("len"))))).alias("part"))
    return named.join(grams, ["part", "len"]).select(F.col("part").alias(part), F.col("whole").alias(whole))


def line_coverage(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """O-80: (node_id, coverage) of nodes whose file a record matches: hit lines / lines within the node; 0.0 if there is none (Q44).

    lines(record, source, line, hits); the first record whose path contains the
    node's path, or is contained in it, counts. Paths are matched once for each
    distinct pair, by equal substrings, before lines are joined.
    """
    paths = nodes.select("file_path").distinct()
    records = lines.select("record", "source").distinct()
    found = substring_pairs(paths, "file_path", records, "source").unionByName(substring_pairs(records, "source", paths, "file_path"))
    first = found.distinct().join(records, "source").groupBy("file_path").agg(F.min("record").alias("record"))
    spans = nodes.select("node_id", "file_path", "start_line", "end_line").join(first, "file_path")
    inside = spans.join(lines, "record", "left")
    hit = (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))
    total, covered = F.count_if(hit), F.count_if(hit & (F.col("hits") > 0))
    return inside.groupBy("node_id").agg(F.when(total == 0, 0.0).otherwise(covered / total).alias("coverage"))


def spread_spans(spans: DataFrame, width: int = 64) -> DataFrame:
    """Spans with one row for each bucket of ``width`` points they touch, for range joins by equality."""
    return spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))))


def range_coverage(spans: DataFrame, points: DataFrame, width: int = 64) -> DataFrame:
    """Coverage of spans(span_id, start_line, end_line) over points(line, hits) of one file: a range join by buckets."""
    hits = spread_spans(spans, width).join(points.withColumn("bucket", F.floor(F.col("line") / width)), "bucket").where("line BETWEEN start_line AND end_line")
    per = hits.groupBy("span_id").agg((F.count_if(F.col("hits") > 0) / F.count("*")).alias("coverage"))
    return spans.select("span_id").join(per, "span_id", "left").select("span_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def outermost(functions: DataFrame) -> DataFrame:
    """Function spans that lie in no other one of their file (Q45)."""
    w = Window.partitionBy("path").orderBy("start_line", F.desc("end_line")).rowsBetween(Window.unboundedPreceding, -1)
    return functions.withColumn("_reach", F.max("end_line").over(w)).where("_reach IS NULL OR start_line > _reach").drop("_reach")


def skeleton(files: DataFrame, functions: DataFrame) -> DataFrame:
    """O-81: (path, skeleton): bodies of outermost functions replaced by a placeholder.

    files(path, language, content), functions(path, start_line, end_line). Python keeps
    the first line, others the first and last line of functions of three lines or more.
    """
    spans = outermost(functions).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line"))).alias("spans"))
    rows = files.join(spans, "path", "left").select("path", "language", F.posexplode(F.split("content", "\n")).alias("i", "line"), "spans")
    n = F.col("i") + 1
    span = F.get(F.filter("spans", lambda s: (s["start_line"] <= n) & (n <= s["end_line"])), F.lit(0))
    python = F.col("language") == "python"
    body = F.coalesce(F.when(python, n > span["start_line"]).otherwise((span["end_line"] - span["start_line"] >= 2) & (n > span["start_line"]) & (n < span["end_line"])), F.lit(False))
    rows = rows.select("path", "i", "line", body.alias("body"), (body & (n == span["start_line"] + 1)).alias("first"), python.alias("python"), (span["start_line"] - 1).alias("head"))
    heads = rows.select("path", F.col("i").alias("head"), F.regexp_extract("line", r"^\s*", 0).alias("indent"))
    rows = rows.where("NOT body OR first").join(heads, ["path", "head"], "left")
    text = F.when(F.col("first"), F.concat(F.col("indent"), F.lit("    "), F.when(F.col("python"), "pass").otherwise("// ..."))).otherwise(F.col("line"))
    ordered = F.sort_array(F.collect_list(F.struct("i", text.alias("text"))))
    return rows.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("skeleton"))


def stats(nodes: DataFrame, edges: DataFrame, files: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """O-83: counts in one row, with the revision and the last indexing time (Q54)."""
    one = lambda df, *aggs: df.agg(*aggs)
    out = one(nodes, F.count("*").alias("node_count"))
    out = out.withColumn("edge_count", one(edges, F.count("*").alias("c")).scalar())
    out = out.withColumn("file_count", one(files, F.count("*").alias("c")).scalar())
    out = out.withColumn("last_indexed", one(files, F.max("last_indexed").alias("c")).scalar())
    if meta is not None:
        out = out.withColumn("last_git_sha", meta.where("key = 'last_git_sha'").agg(F.max("value").alias("v")).scalar())
    return out


def skill_score(message: Column, name: Column, criteria: Column, tools: Column, examples: Column, bonus: Column | None = None) -> Column:
    """O-86: 0.4 a criterion, 0.3 the name, 0.2 a tool, 0.1 * share of an example's words of more than 3 letters; at most 1."""
    text = F.lower(message)
    total = F.aggregate(criteria, F.lit(0.0), lambda a, x: a + F.when(text.contains(F.lower(x)), 0.4).otherwise(0.0))
    total = total + F.when(text.contains(F.lower(name)), 0.3).otherwise(0.0)
    total = total + F.aggregate(tools, F.lit(0.0), lambda a, x: a + F.when(text.contains(F.lower(x)), 0.2).otherwise(0.0))

    def example(a: Column, x: Column) -> Column:
        w = F.split(F.lower(x), r"\s+")
        return a + F.lit(0.1) * F.size(F.filter(w, lambda y: (F.length(y) > 3) & text.contains(y))) / F.greatest(F.size(w), F.lit(1))

    total = F.aggregate(examples, total, example)
    return F.least(total if bonus is None else total + bonus, F.lit(1.0))


def match_skills(skills: DataFrame, message: str, least: float = 0.3) -> DataFrame:
    """O-86: skills(id, name, when_to_use, tools, examples) with scores above ``least``, best first."""
    score = skill_score(F.lit(message), F.col("name"), F.col("when_to_use"), F.col("tools"), F.col("examples"))
    return skills.withColumn("score", score).where(F.col("score") > least).orderBy(F.desc("score"), "id")


def skills_with_tool(skills: DataFrame, tool: str) -> DataFrame:
    """O-87"""
    return skills.where(F.exists("tools", lambda x: x.contains(tool)))


def skills_of(skills: DataFrame, category: str) -> DataFrame:
    """O-87"""
    return skills.where(F.col("id").endswith(category))


def ring_buffer(events: DataFrame, size: int = 100, kind: str = "event_type", time: str = "ts", key: str = "event_id") -> DataFrame:
    """O-88: the last ``size`` events of each type.

    row_number with a bound below it becomes a window group limit: every task keeps
    ``size`` rows of each type before anything is shuffled.
    """
    w = Window.partitionBy(kind).orderBy(F.desc(time), F.desc(key))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n")


def event_stats(events: DataFrame, kind: str = "event_type", time: str = "ts") -> DataFrame:
    """O-88"""
    return events.groupBy(kind).agg(F.count("*").alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))


def cache_key(prefix: Column, payload: Column) -> Column:
    """O-89: prefix and 16 hex digits of the digest of prefix and payload."""
    return F.concat(prefix, F.lit(":"), F.substring(F.sha2(F.concat(prefix, payload), 256), 1, 16))


def live_entries(entries: DataFrame, now: Column, ttl_seconds: int = 300, most: int = 1000) -> DataFrame:
    """O-89: entries(key, used_at, stored_at) younger than their time to live, the ``most`` recently used."""
    alive = entries.where(F.col("stored_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds)) > now)
    return alive.orderBy(F.desc("used_at"), "key").limit(most)


def hook_fold(results: Column) -> Column:
    """O-90: results of handlers in order, as one: stops at the first that says so; metadata of later ones wins."""
    start = F.struct(F.lit(True).alias("go"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("metadata"))
    return F.aggregate(
        results, start,
        lambda a, r: F.when(~a["go"], a).otherwise(F.struct(r["go"].alias("go"), F.map_concat(F.map_filter(a["metadata"], lambda k, _: ~F.map_contains_key(r["metadata"], k)), r["metadata"]).alias("metadata"))),
    )
