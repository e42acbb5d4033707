"""One number for each document: rows that share id and text are one, all others differ.

Ids are numbers already wherever each stands for one text; that is looked up
first, from ids and hashes of texts alone. Only where an id (or a missing one)
has several texts are all documents numbered anew, in the order of their ids and
their texts' hashes, by a range sort of these pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shared import cut

#: Stands for a missing id inside the operators; it is the least number.
NULL_ID = -(1 << 63)


@dataclass
class Keyed:
    """rows(doc_id, name, content, *keep): doc_id is unique for each pair of id and text and orders as the ids do; name is the row's own id."""

    rows: DataFrame
    #: (key, id) where doc_id is not the id itself (or NULL_ID).
    names: DataFrame | None
    #: Whether some id has several rows; else every row is a document of its own.
    repeated: bool

    def texts(self) -> DataFrame:
        """(doc_id, content), one row for each document."""
        texts = self.rows.select("doc_id", "content")
        # Repeats meet in map tasks first, so a much repeated row is one row of each before anything moves.
        return texts.dropDuplicates(["doc_id"]) if self.repeated else texts


def key_rows(df: DataFrame, id_column: str, text: str, keep: tuple[str, ...] = ()) -> Keyed:
    name = F.col(f"`{id_column}`").cast("long")
    rows = df.select(F.coalesce(name, F.lit(NULL_ID)).alias("doc_id"), name.alias("name"), F.col(f"`{text}`").alias("content"), *keep)
    text_key = F.xxhash64(F.coalesce("content", F.lit(""))).alias("text_key")
    pairs = rows.select("doc_id", text_key)
    ids = pairs.groupBy("doc_id").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"), F.count("*").alias("n"))
    found = ids.agg(F.bool_or(F.col("a") != F.col("b")).alias("several"), F.bool_or(F.col("n") > 1).alias("repeated")).first()
    if not found.several:
        return Keyed(rows, None, bool(found.repeated))
    names = cut(pairs.distinct().orderBy("doc_id", "text_key").withColumn("key", F.monotonically_increasing_id()), "names")
    keyed = rows.withColumn("text_key", text_key).join(names, ["doc_id", "text_key"])
    keyed = keyed.select(F.col("key").alias("doc_id"), "name", "content", *keep)
    return Keyed(keyed, names.select("key", F.nullif("doc_id", F.lit(NULL_ID)).alias("id")), True)


def real_id(df: DataFrame, names: DataFrame | None, column: str) -> DataFrame:
    """``df`` with the ids that keys in ``column`` stand for in their place."""
    if names is None:
        return df.withColumn(column, F.nullif(column, F.lit(NULL_ID)))
    other = [c for c in df.columns if c != column]
    named = names.select(F.col("key").alias(column), F.col("id").alias("_id"))
    return df.join(named, column, "left").select(*other, F.col("_id").alias(column))
