"""Table sources: the Parquet test tables and the corpus views built on them.

A corpus view is the working schema ``docs(doc_id LONG, text STRING,
label STRING)``; other columns are dropped so that Catalyst prunes them
from the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# conversations are keyed by (conv_id, turn); the single LONG key is
# Conversations are keyed by (conv_id, turn); the single LONG key is
# conv_id * TURN_BASE + turn.  A turn outside the base is an error, not a collision.
TURN_BASE = 1 << 20


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a small file dealt out to as many tasks as the session asks for
    (``spark.quill.minInputPartitions``); unset, nothing is shuffled."""
    n = df.sparkSession.conf.get("spark.quill.minInputPartitions", None)
    return df.repartition(int(n)) if n else df


def turn_key(conv_id: F.Column, turn: F.Column) -> F.Column:
    key = (conv_id * TURN_BASE + turn).cast("long")
    return F.when(turn.between(0, TURN_BASE - 1), key).otherwise(F.raise_error(F.lit("turn out of range")).cast("long"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_corpus(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """Long-text corpus.  ``label`` is a column of ``documents`` or ``'size_bucket'``
    (``'b' || n_chars div 2000``, a class with rare values)."""
    d = table(spark, sf_dir, "documents")
    if label == "size_bucket":
        lab = F.concat(F.lit("b"), F.floor(F.col("n_chars") / 2000).cast("long").cast("string"))
    else:
        lab = F.col(label).cast("string")
    return dealt(d.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("text"), lab.alias("label")))


def documents_label_sql(label: str = "lang") -> str:
    if label == "size_bucket":
        return "('b' || CAST(n_chars // 2000 AS VARCHAR))"
    return f"CAST({label} AS VARCHAR)"


def conversations_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-text corpus: one document per turn, class = role."""
    c = table(spark, sf_dir, "conversations")
    return dealt(c.select(
        turn_key(F.col("conv_id"), F.col("turn")).alias("doc_id"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("text"), F.col("role").cast("string").alias("label")))


def embeddings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("doc_id"),
                    F.col("embedding").cast("array<double>").alias("features"),
                    F.col("label").cast("string").alias("label"))
