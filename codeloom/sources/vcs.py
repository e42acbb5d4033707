"""Revision-control sources (O-10 to O-15): command output as text, parsed in expressions."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.files import language_of

CHANGES = "path string, status string, old_path string"


def parse_name_status(text: DataFrame) -> DataFrame:
    """O-11: text(content) -> (path, status, old_path). R* is a rename, C* adds its target (Q35), other letters than A, M, D are dropped."""
    f = F.split("l", "\t")
    lines = text.select(F.explode(F.split("content", "\n")).alias("l")).where(F.col("l") != "")
    code = F.substring(f[0], 1, 1)
    status = F.when(code.isin("A", "C"), "Added").when(code == "M", "Modified").when(code == "D", "Deleted").when(code == "R", "Renamed")
    two = code.isin("R", "C")
    return lines.where(status.isNotNull() & (F.size(f) >= F.when(two, 3).otherwise(2))).select(
        F.when(two, F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(1))).alias("path"), status.alias("status"), F.when(code == "R", F.get(f, F.lit(1))).alias("old_path")
    )


def parse_porcelain(text: DataFrame) -> DataFrame:
    """O-13: text(content) -> (path): from column 4 on; of ``a -> b`` the new side; quotes trimmed."""
    lines = text.select(F.explode(F.split("content", "\n")).alias("l")).where(F.length("l") > 3)
    path: Column = F.substring_index(F.substring("l", 4, 1 << 20), " -> ", -1)
    return lines.select(F.btrim(F.trim(path), F.lit('"')).alias("path"))


class Repository:
    """O-10, O-12 to O-15: the local command, run on the driver; its output becomes DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _git(self, *args: str) -> str:
        return subprocess.run(["git", "-C", self.root, *args], capture_output=True, text=True, check=True).stdout

    def _text(self, *args: str) -> DataFrame:
        return self.spark.createDataFrame([(self._git(*args),)], "content string")

    def head(self) -> str:
        return self._git("rev-parse", "HEAD").strip()

    def head_or_none(self) -> str | None:
        """The revision, or nothing outside a repository (O-15)."""
        try:
            return self.head()
        except (OSError, subprocess.CalledProcessError):
            return None

    def dirty(self) -> bool:
        return bool(self._git("status", "--porcelain").strip())

    def toplevel(self) -> str:
        return self._git("rev-parse", "--show-toplevel").strip()

    def changes(self, old: str, new: str = "HEAD") -> DataFrame:
        return parse_name_status(self._text("diff", "--name-status", f"{old}..{new}"))

    def changed_paths(self, ref: str) -> DataFrame:
        """O-12, relative to the repository (Q32)."""
        return self._text("diff", "--name-only", f"{ref}..HEAD").select(F.explode(F.split("content", "\n")).alias("path")).where(F.col("path") != "")

    def active_files(self) -> DataFrame:
        return parse_porcelain(self._text("status", "--porcelain"))

    def blobs(self, ref: str, paths: list[str]) -> DataFrame:
        """O-14: (ref, path, language, content) of paths that exist at a revision, all read by one command."""
        asked = "".join(f"{ref}:{p}\n" for p in paths).encode()
        out = subprocess.run(["git", "-C", self.root, "cat-file", "--batch"], input=asked, capture_output=True, check=True).stdout
        rows, at = [], 0
        for p in paths:
            end = out.index(b"\n", at)
            head, at = out[at:end].split(b" "), end + 1
            if head[-1] == b"missing":
                continue
            size = int(head[-1])
            if head[-2] == b"blob":
                rows.append((ref, p, out[at : at + size].decode("utf-8", "replace")))
            at += size + 1
        made = self.spark.createDataFrame(rows, "ref string, path string, content string")
        return made.select("ref", "path", language_of(F.col("path")).alias("language"), "content")

    def changed_blobs(self, old: str, new: str) -> DataFrame:
        """The files between two revisions that differ, at both."""
        names = [x for line in self._git("diff", "--name-status", f"{old}..{new}").splitlines() for x in line.split("\t")[1:]]
        found = self.blobs(old, names).union(self.blobs(new, names))
        return found.where("language IS NOT NULL")
