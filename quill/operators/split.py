"""Class counts and reproducible stratified three-way splits.

Semantics of ``stratified_split`` (train / val / test, default .8/.1/.1):

* stage 1 cuts ``temp = ceil((val+test) * n)`` rows off; stage 2 cuts
  ``test = ceil(test/(val+test) * |temp|)`` rows off ``temp``; the rest is val;
* classes with fewer than 3 rows share the stratum ``Other_Rare`` (labels are
  kept); in stage 2 strata with fewer than 2 rows in temp become
  ``Other_Rare_Temp``;
* per stratum the train (stage 2: val) quota is the largest-remainder share,
  ties by stratum name; inside a stratum rows are taken in the order of
  ``md5('seed:stage:doc_id')`` then ``doc_id``;
* a stage falls back to one stratum (random split) when its smallest stratum
  has fewer than 2 rows or either side is smaller than the number of strata.

Everything is joins and aggregations over small per-stratum tables; ranks use
hash buckets (``functions.ranking``) so no stratum lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.hashing import hash_key
from quill.functions.ranking import ceil_frac, rank_within
from quill.session import materialize

RARE_STRATUM = "Other_Rare"
RARE_TEMP_STRATUM = "Other_Rare_Temp"
NULL_STRATUM = "__null__"
ALL_STRATUM = "__all__"


def class_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A1: ``(label, n)``; partial + final hash aggregation."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def _stratum(label_col: str) -> F.Column:
    return F.coalesce(F.col(label_col).cast("string"), F.lit(NULL_STRATUM))


def collapse_rare(df: DataFrame, label_col: str = "label", min_count: int = 3,
                  rare_name: str = RARE_STRATUM, in_col: str | None = None,
                  out_col: str = "stratum") -> DataFrame:
    """``out_col`` = the label, or ``rare_name`` for classes with
    fewer than ``min_count`` rows (counted by a group-by, joined back)."""
    src = in_col or "_st_src"
    x = df if in_col else df.withColumn(src, _stratum(label_col))
    counts = x.groupBy(src).agg(F.count(F.lit(1)).alias("_st_n"))
    return (x.join(counts, on=src, how="inner")
             .withColumn(out_col, F.when(F.col("_st_n") < min_count, F.lit(rare_name)).otherwise(F.col(src)))
             .drop("_st_n", *([] if in_col else [src])))


def _quota_table(df: DataFrame, stratum_col: str, side_frac: float) -> DataFrame:
    """Per stratum: ``n_c``, ``quota`` (rows of the *first* side), and the
    stage totals and feasibility repeated on every row.  ``side_frac`` is the
    share of the second side.  The table has one row per stratum, so the
    windows over all of it are small."""
    s = df.groupBy(stratum_col).agg(F.count(F.lit(1)).alias("n_c"))
    w_all = Window.partitionBy(F.lit(0))
    s = (s.withColumn("n", F.sum("n_c").over(w_all))
          .withColumn("n_strata", F.count(F.lit(1)).over(w_all))
          .withColumn("min_c", F.min("n_c").over(w_all)))
    s = s.withColumn("n_second", ceil_frac(side_frac, F.col("n")))
    s = s.withColumn("n_first", F.col("n") - F.col("n_second"))
    s = s.withColumn("feasible", (F.col("min_c") >= 2) & (F.col("n_first") >= F.col("n_strata"))
                     & (F.col("n_second") >= F.col("n_strata")))
    s = (s.withColumn("base", F.expr("(n_c * n_first) div n").cast("long"))
          .withColumn("rem", (F.col("n_c") * F.col("n_first")) % F.col("n")))
    s = s.withColumn("extra", F.col("n_first") - F.sum("base").over(w_all))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("rem").desc(), F.col(stratum_col))
    s = s.withColumn("quota", F.col("base") + F.when(F.row_number().over(w) <= F.col("extra"), 1).otherwise(0))
    return s.select(stratum_col, "n_c", "quota", "feasible", "n_first", "n", "n_strata", "min_c")


def _cut(df: DataFrame, stratum_col: str, side_frac: float, seed: int, stage: str,
         first: str, second: str, out_col: str) -> DataFrame:
    q = _quota_table(df, stratum_col, side_frac).select(
        stratum_col, F.col("quota").alias("_q_s"), F.col("feasible").alias("_feasible"),
        F.col("n_first").alias("_q_all"))
    x = df.join(q, on=stratum_col, how="inner")
    x = x.withColumn("_grp", F.when(F.col("_feasible"), F.col(stratum_col)).otherwise(F.lit(ALL_STRATUM)))
    x = x.withColumn("_quota", F.when(F.col("_feasible"), F.col("_q_s")).otherwise(F.col("_q_all")))
    x = x.withColumn("_hk", hash_key(seed, stage, F.col("doc_id")))
    x = rank_within(x, ["_grp"], "_hk", "doc_id", out="_rank")
    return (x.withColumn(out_col, F.when(F.col("_rank") <= F.col("_quota"), F.lit(first)).otherwise(F.lit(second)))
             .drop("_grp", "_hk", "_rank", "_quota", "_q_s", "_q_all", "_feasible"))


def stratified_split(docs: DataFrame, label_col: str = "label", train_frac: float = 0.8,
                     val_frac: float = 0.1, test_frac: float = 0.1, seed: int = 42,
                     rare_min: int = 3, stratify: bool = True) -> DataFrame:
    """``docs`` plus ``split`` in {train, val, test} (and ``stratum``)."""
    if abs(train_frac + val_frac + test_frac - 1.0) > 1e-9:
        raise ValueError("train, val and test fractions must sum to 1")
    x = docs
    if stratify:
        x = collapse_rare(x, label_col, rare_min, RARE_STRATUM)
    else:
        x = x.withColumn("stratum", F.lit(ALL_STRATUM))
    temp_frac = float(val_frac + test_frac)
    s1 = materialize(_cut(x, "stratum", temp_frac, seed, "s1", "train", "temp", "_s1"))
    train = s1.where(F.col("_s1") == "train").withColumn("split", F.lit("train")).drop("_s1")
    temp = s1.where(F.col("_s1") == "temp").drop("_s1")
    if stratify:
        temp = collapse_rare(temp, label_col, 2, RARE_TEMP_STRATUM, in_col="stratum", out_col="_stratum2")
    else:
        temp = temp.withColumn("_stratum2", F.lit(ALL_STRATUM))
    s2 = _cut(temp, "_stratum2", float(test_frac / temp_frac), seed, "s2", "val", "test", "split")
    s2 = s2.drop("_stratum2")
    return materialize(train.unionByName(s2))


def random_split(docs: DataFrame, **kw) -> DataFrame:
    """The same split with one stratum (uniform, exact sizes)."""
    return stratified_split(docs, stratify=False, **kw)


def split_feasibility(docs: DataFrame, label_col: str = "label", temp_frac: float = 0.2,
                      rare_min: int = 3) -> DataFrame:
    """One row describing whether stage 1 can stratify."""
    x = collapse_rare(docs, label_col, rare_min, RARE_STRATUM)
    q = _quota_table(x, "stratum", temp_frac)
    return q.agg(
        F.first("n").cast("long").alias("n_rows"),
        F.first("n_strata").cast("long").alias("n_strata"),
        F.first("min_c").cast("long").alias("min_stratum"),
        F.coalesce(F.sum(F.when(F.col("stratum") == RARE_STRATUM, F.col("n_c"))), F.lit(0)).cast("long").alias("n_rare_rows"),
        F.first("feasible").alias("stratified"),
        F.first("n_first").cast("long").alias("n_train"))


def split_sizes(splits: DataFrame) -> DataFrame:
    """A4: ``(split, n)``."""
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def presplit(docs: DataFrame, key_col: str, seed: int = 42, val_buckets=(8,), test_buckets=(9,),
             n_buckets: int = 10) -> DataFrame:
    """A corpus that arrives split: ``split`` follows a hash of ``key_col``
    (all turns of one conversation share a split)."""
    from quill.functions.hashing import hash_draw
    b = hash_draw(seed, "presplit", F.col(key_col)) % n_buckets
    return docs.withColumn("split", F.when(b.isin(*val_buckets), "val")
                           .when(b.isin(*test_buckets), "test").otherwise("train"))
