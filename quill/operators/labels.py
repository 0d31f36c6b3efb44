"""Label encoding (A8, J7, J8): sorted distinct labels -> 0..C-1, strict lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.functions.ranking import dense_index


def fit_label_map(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``(label_id INT, label)``, ids in ascending label order."""
    labels = df.select(F.col(label_col).alias("label")).where(F.col("label").isNotNull()).distinct()
    return dense_index(labels, "label", out="label_id").select(
        F.col("label_id").cast("int"), "label")


def unseen_labels(df: DataFrame, label_map: DataFrame, label_col: str = "label") -> DataFrame:
    """J7 (anti-join form): labels of ``df`` missing from the map."""
    return (df.select(F.col(label_col).alias("label")).distinct()
              .join(label_map, on="label", how="left_anti"))


def encode_labels(df: DataFrame, label_map: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds ``label_id``; an unseen label fails the job (strict, like the
    reference's encoder)."""
    m = label_map.select(F.col("label").alias(label_col), "label_id")
    out = df.join(m, on=label_col, how="left")
    return out.withColumn("label_id", F.when(F.col("label_id").isNull(),
                                             F.raise_error(F.concat(F.lit("unseen label: "),
                                                                    F.coalesce(F.col(label_col), F.lit("NULL")))))
                          .otherwise(F.col("label_id")).cast("int"))


def decode_labels(df: DataFrame, label_map: DataFrame, id_col: str = "label_id", out: str = "label") -> DataFrame:
    """Id -> label."""
    m = label_map.select(F.col("label_id").alias(id_col), F.col("label").alias(out))
    return df.join(m, on=id_col, how="left")
