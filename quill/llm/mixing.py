"""Mixing sources to target weights with hash-threshold histograms.

Each document has a 60-bit hash of its ``doc_id``.  A source whose target is
``r`` times its words takes every document ``floor(r)`` times and once more the
documents whose hash is below the source's threshold.  The threshold comes from
nested histograms: tokens are summed by (source, hash bucket), the bucket in
which the remaining budget ends is found, and only that bucket is divided
again.  Nothing is sorted by document, and a source of any size is summed map-side.

Defined cases: a null text has 0 words; a null source is a source of its own,
last in order; rows with the same ``doc_id`` (null included) share a hash and
are taken together; an empty table gives an empty result; only ``doc_id``,
``text`` and ``source`` are read, and ``mixed`` passes all columns through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.llm import common as C

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 12


def draw(doc_id):
    """60 bits of the md5 of the document's key."""
    key = F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    d = C.columns(docs, "doc_id", "source", "text")
    return d.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), draw(F.col("doc_id")).alias("h"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, full, rest): the weights share all tokens,
    no source above ``max_repeats`` times its own; ``full`` whole passes and
    ``rest`` tokens of one more make the target.  Windows run over sources, not documents."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("total", F.sum("source_size").over(every)).withColumn("all_weights", F.sum("weight").over(every))
    by = by.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # what a unit of weight gets if all sources before this one are at their cap
    by = by.withColumn("unit", (F.col("total") - F.col("cap_before")).cast("double") / (F.col("all_weights") - F.col("weight_before")).cast("double"))
    by = by.withColumn("capped", F.col("cap").cast("double") <= F.col("weight") * F.col("unit"))
    by = by.withColumn("unit", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "unit"))).over(every)["unit"])
    by = by.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("unit")))
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0).cast("long")
    by = by.withColumn("full", full).withColumn("rest", F.when(F.col("full") >= max_repeats, F.lit(0.0)).otherwise(F.col("target") - F.col("full") * F.col("source_size")))
    return by.select("source", "source_size", "target", "full", "rest")


def thresholds(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with ``theta`` and ``with_theta``: one more pass takes the
    hashes below theta, and theta's own documents if that comes nearer to the
    budget.  ``sizes`` and ``goal`` are written tables."""
    goal = goal.select(F.col("source").alias("of"), "source_size", "target", "full", "rest")
    state = goal.withColumn("bucket", F.lit(0).cast("long")).withColumn("used", F.lit(0).cast("long"))
    shift = HASH_BITS
    while True:
        last, shift = shift, shift - LEVEL_BITS
        open_ = C.small(state)
        inside = sizes.where("size > 0").join(open_, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("h", last) == F.col("bucket")))
        hist = inside.groupBy("of", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("tokens"), F.min("h").alias("low"), F.max("h").alias("high"), F.first("rest").alias("rest"), F.first("used").alias("used"))
        so_far = Window.partitionBy("of").orderBy("b")
        hist = hist.withColumn("upto", F.col("used") + F.sum("tokens").over(so_far))
        edge = hist.where(F.col("upto") > F.col("rest")).groupBy("of").agg(F.min(F.struct("b", "tokens", "low", "high", "upto")).alias("e"))
        edge = edge.select(F.col("of").alias("edge_of"), "e.*")
        state = C.cut(goal.join(edge, F.col("of").eqNullSafe(F.col("edge_of")), "left").select("of", "source_size", "target", "full", "rest", F.col("b").alias("bucket"), (F.col("upto") - F.col("tokens")).alias("used"), "tokens", "low", "high"))
        if shift == 0 or state.where("low < high").limit(1).count() == 0:
            break
    # a bucket that holds one hash: its documents go together
    near = 2 * F.col("used") + F.col("tokens") <= 2 * F.col("rest")
    return state.select("of", "source_size", "target", "full", F.coalesce("low", F.lit(-1)).alias("theta"), F.coalesce(near, F.lit(False)).alias("with_theta"))


def _copies(h):
    more = (h < F.col("theta")) | ((h == F.col("theta")) & F.col("with_theta"))
    return F.col("full") + more.cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    sizes = C.cut(sized(docs))
    plan = thresholds(sizes, C.cut(targets(sizes, weights, max_repeats)))
    joined = sizes.join(C.small(plan), F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("copies", _copies(F.col("h"))).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: each document as often as it is taken, columns as they
    came.  Texts are not shuffled: the table of sources is joined to them."""
    sizes = C.cut(sized(docs))
    plan = thresholds(sizes, C.cut(targets(sizes, weights, max_repeats)))
    own = [f"__own_{i}" for i in range(len(docs.columns))]
    of = {c.lower(): F.col(o) for o, c in zip(own, docs.columns)}
    rows = docs.toDF(*own)
    rows = rows.withColumn("__source", of.get("source", F.lit(None)).cast("string")).withColumn("__h", draw(of.get("doc_id", F.lit(None)).cast("long")))
    joined = rows.join(C.small(plan), F.col("__source").eqNullSafe(F.col("of")))
    copies = joined.withColumn("__copies", _copies(F.col("__h")).cast("int")).where("__copies > 0")
    return copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*own).toDF(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
      FROM d GROUP BY source),
u AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights,
             coalesce(sum(3 * source_size) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
      FROM s WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CAST(total - cap_before AS DOUBLE) / CAST(all_weights - weight_before AS DOUBLE) AS unit FROM u),
c AS (SELECT *, CAST(cap AS DOUBLE) <= weight * unit AS capped FROM v),
t AS (SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * arg_min(unit, CAST(cap AS DOUBLE) / weight) FILTER (WHERE NOT capped) OVER () END AS target FROM c),
g AS (SELECT source, source_size, target,
             CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS full_passes FROM t),
r AS (SELECT *, CASE WHEN full_passes >= 3 THEN 0.0::DOUBLE ELSE target - full_passes * source_size END AS rest FROM g),
j AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.full_passes, r.rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (full_passes + CASE WHEN 2 * (upto - own) + own <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM j
"""
