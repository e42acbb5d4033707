"""Dependency manifests (O-04 to O-09): text columns to arrays of names, all in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\r\n"))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), strip)


def cargo(text: Column) -> Column:
    """O-04: names before ``=`` in sections whose header holds "dependencies"."""
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        name = strip(F.split(x, "=", 2)[0])
        keep = a["on"] & x.contains("=") & ~x.startswith("#")
        return F.when(x.startswith("["), F.struct(x.contains("dependencies").alias("on"), a["out"].alias("out"))).otherwise(
            F.struct(a["on"].alias("on"), F.when(keep, F.concat(a["out"], F.array(name))).otherwise(a["out"]).alias("out"))
        )

    return F.aggregate(_lines(text), start, step, lambda a: a["out"])


def package_json(text: Column) -> Column:
    """O-05: keys of dependencies, then of devDependencies; empty for text that is no JSON object."""
    doc = F.from_json(text, "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(F.map_keys(doc["dependencies"]), none), F.coalesce(F.map_keys(doc["devDependencies"]), none))


def requirements(text: Column) -> Column:
    """O-06: what stands before the first of = > < ~ @ in lines that are no comments."""
    names = F.transform(F.filter(_lines(text), lambda x: (x != "") & ~x.startswith("#")), lambda x: strip(F.split(x, "[=><~@]")[0]))
    return F.filter(names, lambda x: x != "")


def go_mod(text: Column) -> Column:
    """O-07: modules of ``require x`` lines and of ``require ( … )`` blocks."""
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out"))
    first = lambda x: F.btrim(F.split(strip(x), r"\s+")[0], F.lit('"'))

    def step(a: Column, x: Column) -> Column:
        add = lambda name: F.when(name != "", F.concat(a["out"], F.array(name))).otherwise(a["out"])
        return (
            F.when(x.rlike(r"^require\s*\("), F.struct(F.lit(True).alias("on"), a["out"].alias("out")))
            .when(a["on"] & x.startswith(")"), F.struct(F.lit(False).alias("on"), a["out"].alias("out")))
            .when(a["on"] & ~x.startswith("//"), F.struct(F.lit(True).alias("on"), add(first(x)).alias("out")))
            .when(~a["on"] & x.rlike(r"^require\s"), F.struct(F.lit(False).alias("on"), add(first(F.regexp_replace(x, r"^require\s+", ""))).alias("out")))
            .otherwise(a)
        )

    return F.aggregate(_lines(text), start, step, lambda a: a["out"])


PARSERS = {"Cargo.toml": cargo, "package.json": package_json, "requirements.txt": requirements, "go.mod": go_mod}


def dependency_nodes(manifests: DataFrame) -> DataFrame:
    """O-08, O-09: manifests(path, content) at the root -> nodes of kind dependency."""
    parsed = None
    for name, parse in PARSERS.items():
        part = manifests.where(F.col("path") == name).select("path", F.explode(parse(F.col("content"))).alias("name"))
        parsed = part if parsed is None else parsed.unionByName(part)
    return parsed.distinct().select(
        F.concat(F.lit("dependency:"), "path", F.lit(":_:"), F.regexp_replace("name", ":", ".")).alias("node_id"), F.lit("dependency").alias("kind"), "name",
        F.concat(F.lit("Dependency imported via "), "path").alias("description"), F.array().cast("array<struct<params:array<struct<name:string,type:string>>,returns:string>>").alias("signatures"),
        F.lit("rust").alias("language"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        F.sha2(F.concat_ws("|", "path", "name"), 256).alias("content_hash"), F.lit(None).cast("string").alias("git_sha"), F.lit(None).cast("string").alias("renamed_from"),
    )


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """O-09: (path, content) of the manifests that stand at the root itself."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(PARSERS) + "}").load(root.rstrip("/"))
    return files.select(F.substring_index("path", "/", -1).alias("path"), F.decode("content", "UTF-8").alias("content"))
