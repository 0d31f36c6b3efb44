"""Exact places of rows within their groups, without a window over a group.

Rows are range-partitioned by (group, order) and sorted inside their partition;
the place of a row is its index in the partition, less that of the first row of
its group there, plus the rows of its group in the partitions before.  What
meets in one task is a group's row counts by partition, never its rows, so a
group that holds a third of all rows is spread over as many tasks as any other
third."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.llm import common as C


def numbered(df: DataFrame, group: str, order: list[Column | str]) -> DataFrame:
    """``df`` (a written table) with ``pos`` (0, 1, ... by ``order`` within
    ``group``) and ``n`` (rows of the group), written.  ``group`` holds no
    nulls.  Rows equal in group and order are placed in any order among
    themselves; the last sort key deals them out to several partitions."""
    keys = [F.col(c) if isinstance(c, str) else c for c in (group, *order)]
    dealt = df.withColumn("__tie", F.monotonically_increasing_id())
    keys.append(F.col("__tie"))
    placed = C.cut(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    spans = placed.groupBy(F.col(group).alias("__g"), part).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    own = Window.partitionBy("__g")
    before = own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = C.cut(spans.select("*", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(own).alias("n")))
    joined = placed.join(spans, (F.col(group) == F.col("__g")) & (F.shiftright("__at", 33) == F.col("__part")))
    return joined.select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("pos"), "n")
