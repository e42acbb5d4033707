"""Name resolution of references (O-48) and the edges it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symbol_table(nodes: DataFrame) -> DataFrame:
    """Candidates by name, of any kind and language (Q16): how many, and the least id (Q15)."""
    return nodes.groupBy("name").agg(F.count("*").alias("candidates"), F.min("node_id").alias("to_id"))


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """O-48: refs(kind, from_id, ref_name, language) -> (kind, from_id, to_id, confidence), no row for unknown names.

    Symbols are one row per name before the join, so a frequent name meets one row
    and not all its candidates; whether that side is broadcast is left to its size.
    """
    confidence = F.when(F.col("candidates") == 1, 1.0).when(F.col("language") == "java", 0.5).otherwise(0.4)
    return refs.join(symbol_table(nodes).withColumnRenamed("name", "ref_name"), "ref_name").select("kind", "from_id", "to_id", confidence.alias("confidence"))
