"""The extraction table function: files in, a tagged union of symbols and references out, in one parse."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.extract.languages import extract
from codeloom.schemas import NODES

_ROW = "tag string, path string, ref string, seq int, body string, error string"


#: Rows that a worker gives back at once.
PIECE = 4096


def rows_of(r: dict, compat: bool) -> Iterator[tuple]:
    """The rows of one file."""
    try:
        nodes, refs = extract(r["path"], r["language"], r["content"] or "", compat)
    except Exception as e:  # noqa: BLE001  a file that cannot be read is counted, and the others go on
        yield "error", r["path"], r["ref"], 0, None, repr(e)[:500]
        return
    for tag, found in (("node", nodes), ("ref", refs)):
        for n in found:
            yield tag, r["path"], r["ref"], n.pop("seq"), json.dumps(n), None


def run(batches: Iterator[pa.RecordBatch], compat: bool) -> Iterator[pa.RecordBatch]:
    """A file at a time, however many a batch has, and its rows in pieces."""
    rows = (row for batch in batches for i in range(batch.num_rows) for row in rows_of(batch.slice(i, 1).to_pylist()[0], compat))
    while out := list(itertools.islice(rows, PIECE)):
        cols = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 3 else pa.string()) for i, c in enumerate(cols)], names=["tag", "path", "ref", "seq", "body", "error"])


def extract_files(files: DataFrame, compat: bool = False) -> DataFrame:
    """files(path, language, content[, ref]) -> tagged rows; use ``nodes_of`` and ``refs_of`` on them."""
    ref = F.col("ref") if "ref" in files.columns else F.lit(None).cast("string").alias("ref")
    return files.select("path", "language", "content", ref).mapInArrow(lambda it: run(it, compat), _ROW)


def nodes_of(rows: DataFrame) -> DataFrame:
    """Symbols; of several with one id in a file the last wins, as in a keyed write (Q24)."""
    made = rows.where("tag = 'node'").select("ref", "path", "seq", F.from_json("body", NODES).alias("n"))
    last = made.groupBy("ref", "path", F.col("n.node_id").alias("_id")).agg(F.max_by("n", "seq").alias("n"), F.max("seq").alias("seq"))
    return last.select("ref", "seq", "n.*")


def refs_of(rows: DataFrame) -> DataFrame:
    return rows.where("tag = 'ref'").select("ref", "seq", F.from_json("body", "kind string, from_id string, ref_name string, language string, file_path string").alias("r")).select("ref", "seq", "r.*")


def errors_of(rows: DataFrame) -> DataFrame:
    return rows.where("tag = 'error'").select("path", "error")
