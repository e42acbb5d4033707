"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.bpe import encode_documents
from codeloom.llm.contamination import benchmark_table, drop_contaminated
from codeloom.llm.lines import without_repeats
from codeloom.llm.near import keep_one
from codeloom.llm.quality import keep_good
from codeloom.llm.shared import cut, documents
from codeloom.llm.token_counts import tokenizer_path
from codeloom.ship import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that fail the base rules or the weak-supervision verdict go.

    Null and empty texts have no words and go; rows are judged each on its own, whatever
    their ids; an empty table gives no rows; other columns pass through.
    """
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: repeated chunks of lines are cut out; documents with nothing else go.

    Null and empty texts stay as they are; rows that share id and text get the same
    result, rows that share only the id (or have none) are different documents; ties in
    position are broken by the texts' hashes; an empty table gives no rows; n_chars is
    set anew where there is one, other columns pass through.
    """
    ship(spark)
    return without_repeats(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each class of near duplicates stays, the one with the least id.

    Texts without words stay; of rows that share id and text one stays, rows that share
    only the id (or have none) are different documents, in the order of their texts'
    hashes; an empty table gives no rows; other columns pass through.
    """
    ship(spark)
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents with a window of a benchmark item go.

    Null and empty texts stay; rows are judged each on its own, whatever their ids; an
    empty table gives no rows; other columns pass through.
    """
    ship(spark)
    return drop_contaminated(docs, benchmark_table(spark, sf_dir))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every document as token ids, with digests of the ids and of what they decode to.

    Null is the empty text and has no tokens; every row gives a row with its id, lang and
    source; an empty table gives no rows; other columns go.
    """
    ship(spark)
    return encode_documents(docs, tokenizer_path("word_bpe_49k.json"), ("ids", "n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no BPE; the other four stages' operators have SQL of their own, and tests/llm/test_pipeline.py has a brute-force version of the whole.
ORACLE_SQL = None
