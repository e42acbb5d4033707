"""File sources: discovery, languages, hashes (O-01 to O-03, O-16, O-22, O-23)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.schemas import EXTENSIONS

#: Folders that are never scanned (fixed values).
IGNORED = ("target", ".git", "__pycache__", ".venv", "node_modules", ".mypy_cache", "dist", "build")


def language_of(path: Column) -> Column:
    """O-02: language by extension, in the given case; null for others."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    pairs = [x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), ext)


def discoverable(path: Column, length: Column, max_kb: int = 1024, ignored: tuple[str, ...] = IGNORED) -> Column:
    """O-01 as a predicate on paths below the root (Q31): no ignored folder, a known extension, not too large."""
    parents = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return ~F.arrays_overlap(parents, F.array(*map(F.lit, ignored))) & language_of(path).isNotNull() & (length <= max_kb * 1024)


def scan_files(spark: SparkSession, root: str, max_kb: int = 1024, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """O-01 to O-03: (path below root, language, content, content_hash) of source files.

    Spark reads file lists in parallel, skips files that are too large by their
    length before it reads them, and the content of no others.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(F.col("length") <= max_kb * 1024)
    bare = F.regexp_replace(F.col("path"), "^[a-z]+:(//[^/]*)?", "")
    rel = F.substring(F.regexp_replace(bare, "^/+", "/"), F.lit(len("/" + base.split(":")[-1].lstrip("/")) + 2), F.lit(1 << 20))
    files = files.select(rel.alias("path"), "length", "content").where(discoverable(F.col("path"), F.col("length"), max_kb, ignored))
    return files.select("path", language_of(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"))


def parse_lcov(text: DataFrame) -> DataFrame:
    """O-16: text(content[, path]) -> (record, source, line, hits). A record is what an SF line begins.

    Records are numbered in each file; without paths files are told apart by their
    content. Texts are cut at their SF lines, so each line is looked at once.
    """
    file = F.col("path") if "path" in text.columns else F.sha2("content", 256)
    # What comes before the first SF line belongs to no record.
    parts = text.select(file.alias("file"), F.posexplode(F.split("content", r"(?m)^[ \t]*SF:")).alias("number", "part")).where("number > 0")
    record = F.struct("file", F.col("number").alias("number")).alias("record")
    rows = parts.select(record, F.trim(F.substring_index("part", "\n", 1)).alias("source"), F.explode(F.split("part", "\n")).alias("x"))
    rows = rows.select("record", "source", F.trim("x").alias("x")).where(F.col("x").rlike(r"^DA:\d+,\d+"))
    return rows.select("record", F.regexp_replace("source", "\r$", "").alias("source"), F.regexp_extract("x", r"^DA:(\d+),", 1).cast("int").alias("line"), F.regexp_extract("x", r"^DA:\d+,(\d+)", 1).cast("long").alias("hits"))


def parse_skills(files: DataFrame) -> DataFrame:
    """O-22: files(path, content) -> (id, name, description, when_to_use, tools, steps, examples).

    ``# `` names the skill, ``## `` and ``### `` begin sections, ``- `` and ``1. `` are
    their items; a skill without a name or a when-to-use item is dropped.
    """
    lines = F.split("content", "\n")
    start = F.struct(F.lit("").alias("name"), F.lit("").alias("section"), F.array().cast("array<struct<section:string,item:string>>").alias("items"))

    def step(a: Column, raw: Column) -> Column:
        x = F.trim(raw)
        head = F.lower(F.trim(F.regexp_replace(x, r"^#+", "")))
        item = F.trim(F.regexp_replace(x, r"^(- |\d+\. )", ""))
        made = F.struct(a["section"].alias("section"), item.alias("item"))
        return (
            F.when(x.rlike(r"^#{2,3} "), F.struct(a["name"].alias("name"), head.alias("section"), a["items"].alias("items")))
            .when(x.rlike(r"^# "), F.struct(F.trim(F.substring(x, 3, 1 << 20)).alias("name"), F.lit("").alias("section"), a["items"].alias("items")))
            .when(x.rlike(r"^(- |\d+\. )"), F.struct(a["name"].alias("name"), a["section"].alias("section"), F.concat(a["items"], F.array(made)).alias("items")))
            .when((x != "") & (a["section"] == ""), F.struct(a["name"].alias("name"), a["section"].alias("section"), F.concat(a["items"], F.array(F.struct(F.lit("description").alias("section"), x.alias("item")))).alias("items")))
            .otherwise(a)
        )

    found = files.select("path", F.aggregate(lines, start, step).alias("s"))
    of = lambda *words: F.transform(F.filter("s.items", lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: x["section"].contains(w))), lambda x: x["item"])
    out = found.select(
        F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("id"), F.col("s.name").alias("name"), F.array_join(of("description"), " ").alias("description"),
        of("when").alias("when_to_use"), of("tool").alias("tools"), of("step", "workflow").alias("steps"), of("example").alias("examples"),
    )
    return out.where((F.col("name") != "") & (F.size("when_to_use") > 0))


class _Strict:
    @classmethod
    def load(cls, values: dict):
        """From a JSON object; unknown keys are errors."""
        known = {f.name: f for f in fields(cls)}
        if extra := sorted(set(values) - set(known)):
            raise ValueError(f"unknown keys: {', '.join(extra)}")
        kinds = {"indexing": IndexingConfig, "git": GitConfig, "embedding": EmbeddingConfig} if cls is Config else {}
        return cls(**{k: kinds[k].load(v) if k in kinds else v for k, v in values.items()})


@dataclass
class IndexingConfig(_Strict):
    roots: list[str] = field(default_factory=lambda: ["."])
    ignore: list[str] = field(default_factory=lambda: list(IGNORED))
    max_file_size_kb: int = 1024
    compat: bool = False


@dataclass
class GitConfig(_Strict):
    enabled: bool = True
    follow_symlinks: bool = False


@dataclass
class EmbeddingConfig(_Strict):
    model: str = "local/tfidf"
    dimension: int = 100


@dataclass
class Config(_Strict):
    """O-23: the configuration file, strict; a missing file gives the defaults."""

    indexing: IndexingConfig = field(default_factory=IndexingConfig)
    git: GitConfig = field(default_factory=GitConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)

    @classmethod
    def read(cls, path: str) -> Config:
        try:
            with open(path, encoding="utf-8") as f:
                return cls.load(json.load(f))
        except FileNotFoundError:
            return cls()
