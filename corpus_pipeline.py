"""A corpus pipeline over ``documents``: quality rules, line deduplication,
near-duplicate documents, mixing to target weights, tokens.

Each stage works on all that the one before it kept; its result is written as
Parquet to the shared folder and read again as the next one's documents.  All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm import bpe, common, line_dedup, mixing, ngram_join, quality_rules

#: Rows that go to a Python worker at a time: texts are long, so fewer than Spark's 10,000.
ARROW_ROWS = 1000


def _few_rows(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines of the others go."""
    _few_rows(spark)
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the first stays."""
    _few_rows(spark)
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    _few_rows(spark)
    return ngram_join.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    _few_rows(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix."""
    _few_rows(spark)
    return bpe.encoded(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram join", near_duplicates), ("mixing", mix), ("byte-level BPE", tokens)]

#: Near-duplicate classes and token ids are beyond SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs)
    return docs
