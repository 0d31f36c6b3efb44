"""Distributed ranks without a single-partition window.

A ``row_number() over (partition by g order by k)`` puts a whole group in one
task; a group may hold a third of all rows.  When the order key is a hex
digest (uniform), its first characters form an order-preserving *bucket*:

    rank = (rows of the group in earlier buckets) + row_number() within (group, bucket)

Bucket counts are a small table (groups x 16**chars); the window over it
is per group with at most 16**chars rows.  A global 0-based dense index over
distinct strings (vocabulary ids) takes the partitions of sampled splitters as
its buckets instead, since strings share prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, group_cols: list[str], hex_col: str, tie_col: str,
                out: str = "rank", bucket_chars: int = 3) -> DataFrame:
    """Add ``out`` = 1-based rank of each row inside ``group_cols`` ordered by
    ``(hex_col, tie_col)``; ``hex_col`` must be a lower-case hex string."""
    b = "_rk_bucket"
    x = df.withColumn(b, F.substring(F.col(hex_col), 1, bucket_chars))
    keys = list(group_cols) + [b]
    counts = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rk_n"))
    w = Window.partitionBy(*group_cols).orderBy(b) if group_cols else Window.orderBy(b)
    offsets = counts.select(
        *keys, (F.sum("_rk_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rk_n")).alias("_rk_off"))
    inner = Window.partitionBy(*keys).orderBy(F.col(hex_col), F.col(tie_col))
    return (x.join(offsets, on=keys, how="inner")
             .withColumn(out, (F.col("_rk_off") + F.row_number().over(inner)).cast("long"))
             .drop(b, "_rk_off"))


def dense_index(values: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """0-based position of every distinct value of ``col`` in ascending
    (UTF-8 byte) order.  ``values`` must already be distinct on ``col``; a null
    has no position.

    Sampled splitters range-partition the values, so no prefix that many of them
    share fills a task; a value's position is its index in the sorted partition
    plus the sizes of the partitions before, one row each."""
    from quill.session import materialize
    at, part = F.col("_dx_at"), F.shiftright("_dx_at", 33)
    placed = values.where(F.col(col).isNotNull()).repartitionByRange(F.col(col)).sortWithinPartitions(col)
    placed = materialize(placed.withColumn("_dx_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(part.alias("_dx_part")).agg(F.count(F.lit(1)).alias("_dx_n"))
    before = Window.orderBy("_dx_part").rowsBetween(Window.unboundedPreceding, 0)  # a row per partition
    offsets = sizes.select("_dx_part", (F.sum("_dx_n").over(before) - F.col("_dx_n")).alias("_dx_off"))
    return (placed.join(F.broadcast(offsets), part == F.col("_dx_part"))
            .withColumn(out, (F.col("_dx_off") + at.bitwiseAND((1 << 33) - 1)).cast("long"))
            .drop("_dx_at", "_dx_part", "_dx_off"))


def ceil_frac(frac: float, n: Column) -> Column:
    """``ceil(frac * n)`` in double precision, as the reference's splitter does."""
    return F.ceil(F.lit(float(frac)).cast("double") * n.cast("double")).cast("long")
