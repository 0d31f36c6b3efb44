"""File sources and sinks.

* CSV in and out with a header, quoted multi-line fields and an explicit
  schema (S1/S2); a large file is read by several tasks also if fields hold line
  breaks (``read_csv_parallel``); Parquet is the format between stages.
* ``read_csv_guarded`` (S3): a missing input is skipped with a message when
  asked to, otherwise the read fails like any Spark job.
* Matrices are stored as tables, never as dense files: a split-partitioned
  Parquet dataset of array columns (S6) and bag-of-words triples (S7).
* Vocabulary and label maps as JSON Lines (S8); topic report as text (S9);
  model parameters as a Parquet table per checkpoint (S10).
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

log = logging.getLogger(__name__)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """S1.  Fields with line breaks need ``multi_line``, which reads a file in
    one task (``read_csv_parallel`` does not); a large file without them is split
    when it is off."""
    r = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"'))
    if schema:
        r = r.schema(schema)
    return r.csv(path)


def read_csv_parallel(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S1 for large files whose fields hold line breaks: the rows of
    ``read_csv(..., multi_line=True)``, from as many tasks as the files have ranges.

    A line break ends a record if the number of quotes before it in the file is
    even (a doubled quote counts twice).  Each range of a file counts its quotes
    apart from the others; a running parity over the ranges, a row each, tells
    with which state a range begins and in which one its first record started.
    Lines are then joined to records and parsed by ``from_csv``.  The files are
    scanned twice, and each text is shuffled once for the order of its range's
    lines and once to its record.

    Quotes must enclose whole fields; those inside an unquoted field are not
    told apart.  The header is one line.  Records of white space only are left
    out, without ``schema`` every column is a string; an empty file has no rows.
    """
    columns = schema
    if columns is None:
        columns = ", ".join(f"`{c.replace('`', '``')}` string" for c in spark.read.option("header", True).option("escape", '"').csv(path).columns)
    # one row per line, in the order of its range
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line"))
             .withColumn("quotes", F.length("value") - F.length(F.translate("value", '"', ""))))
    own = Window.partitionBy("file", "block").orderBy("line")
    before = F.coalesce(F.sum("quotes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("before", before % 2)
    # of each range: its parity, and its last line that starts a record for both states at its begin
    ranges = lines.groupBy("file", "block").agg(
        (F.sum("quotes") % 2).alias("odd"), *[F.max(F.when(F.col("before") == k, F.col("line"))).alias(f"last{k}") for k in (0, 1)])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("state", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    last = F.when(F.col("state") == 0, F.col("last0")).otherwise(F.col("last1"))
    start = F.when(last.isNotNull(), F.struct(F.col("block").alias("block"), last.alias("line")))
    ranges = ranges.select(F.col("file").alias("f"), F.col("block").alias("b"), "state", F.last(start, ignorenulls=True).over(earlier).alias("open"))
    lines = lines.join(ranges, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    begins = F.when(F.col("before") == F.col("state"), F.struct("block", "line"))
    record = F.coalesce(F.last(begins, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("open"))
    lines = lines.select("file", record.alias("record"), "block", "line", "value")
    records = lines.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
    firsts = records.groupBy("file").agg(F.min("record").alias("header")).select(F.col("file").alias("f"), "header")
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["value"]), "\n"), r"\r$", "")
    rows = records.join(firsts, F.col("file") == F.col("f")).where(F.col("record") != F.col("header")).select(text.alias("text"))
    rows = rows.where(F.length(F.trim("text")) > 0)
    return rows.select(F.from_csv("text", columns, {"escape": '"', "multiLine": "true"}).alias("r")).select("r.*")


def write_csv(df: DataFrame, path: str) -> None:
    """S2.  Fields are kept as they are, white space at their ends too; an empty
    string comes back as null."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_csv_guarded(spark: SparkSession, path: str, schema: str | None = None,
                     skip_missing: bool = True) -> DataFrame | None:
    """S3: ``None`` (with a message) when the input is missing and
    ``skip_missing`` is set; otherwise the error propagates."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as exc:
        if skip_missing and "PATH_NOT_FOUND" in str(exc):
            log.warning("input not found, skipped: %s", path)
            return None
        raise


def require_column(df: DataFrame, col: str) -> DataFrame:
    """A missing text column is an error before any work is done."""
    if col not in df.columns:
        raise ValueError(f"column {col!r} not found; have {df.columns}")
    return df


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_sequences(seqs: DataFrame, path: str) -> None:
    """``(doc_id, split, input_ids, attention_mask, ...)`` partitioned by split."""
    write_table(seqs, path, partition_by="split")


def write_bow(bow: DataFrame, path: str) -> None:
    """Sparse triples, partitioned by split when present."""
    write_table(bow, path, partition_by="split" if "split" in bow.columns else None)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row, written in parallel."""
    df.write.mode("overwrite").json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, token_id int").json(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label_id int, label string").json(path)


def write_topic_report(report: DataFrame, path: str) -> None:
    """``Topic i: w1 ... wn`` lines (ordered by topic inside one small file set)."""
    report.orderBy("topic").select("line").write.mode("overwrite").text(path)


def save_params(params: DataFrame, root: str, tag: str) -> str:
    """A parameter checkpoint ``root/tag`` (e.g. ``epoch=3`` or ``best``)."""
    path = os.path.join(root, tag)
    params.write.mode("overwrite").parquet(path)
    return path


def load_params(spark: SparkSession, root: str, tag: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, tag)).select("layer", F.col("row").cast("int"), "values")
