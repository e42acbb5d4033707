"""Table schemas, enumerations and node-id expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAM = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
SIGNATURE = T.StructType([T.StructField("params", T.ArrayType(PARAM)), T.StructField("returns", T.StringType())])

NODES = T.StructType(
    [
        T.StructField("node_id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("signatures", T.ArrayType(SIGNATURE), False),
        T.StructField("language", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("git_sha", T.StringType()),
        T.StructField("renamed_from", T.StringType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("from_id", T.StringType(), False),
        T.StructField("to_id", T.StringType(), False),
        T.StructField("confidence", T.DoubleType(), False),
    ]
)
FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("language", T.StringType(), False),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("last_indexed", T.TimestampType(), False),
        T.StructField("git_sha", T.StringType()),
    ]
)
META = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), False)])
EMBEDDINGS = T.StructType(
    [
        T.StructField("node_id", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), False),
        T.StructField("embedding_model", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)
RUNS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("total_nodes", T.IntegerType(), False),
        T.StructField("processed_nodes", T.IntegerType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("started_at", T.TimestampType(), False),
        T.StructField("completed_at", T.TimestampType()),
    ]
)
TABLES = {"nodes": NODES, "edges": EDGES, "files": FILES, "index_meta": META, "embeddings": EMBEDDINGS, "runs": RUNS}

NODE_KINDS = ("function", "class", "constant", "dependency")
EDGE_KINDS = ("calls", "imports", "inherits_from", "implements", "references", "depends_on")
LANGUAGES = ("rust", "python", "typescript", "javascript", "go", "java")

#: File extension -> language (fixed values).
EXTENSIONS = {
    "rs": "rust",
    "py": "python",
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "go": "go",
    "java": "java",
}

MAX_ID_BYTES = 512


def node_id(directory: Column, file: Column, cls: Column, symbol: Column) -> Column:
    """dir:file:class:symbol, each part ``_`` where it is empty or null (§1.1)."""
    part = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("_"))
    return F.concat_ws(":", part(directory), part(file), part(cls), part(symbol))


def valid_node_id(c: Column) -> Column:
    return (F.octet_length(c) <= MAX_ID_BYTES) & (F.size(F.split(c, ":")) == 4)


def build_node_id(directory: str | None, file: str | None, cls: str | None, symbol: str | None) -> str:
    """The same id in Python; ':' inside a part becomes '.', so that ids always have four parts (Q14)."""
    text = ":".join((p or "_").replace("::", ".").replace(":", ".") for p in (directory, file, cls, symbol))
    if len(text.encode()) > MAX_ID_BYTES:
        raise ValueError(f"node id exceeds {MAX_ID_BYTES} bytes")
    return text
