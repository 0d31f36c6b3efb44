"""Positions by sampled splitters."""
import random

from pyspark.sql import functions as F

from quill.functions.ranking import dense_index


def test_positions_are_those_of_the_sorted_values(spark):
    r = random.Random(1)
    words = sorted({"".join(r.choice("abé中z") for _ in range(r.randint(0, 6))) for _ in range(700)}, key=lambda w: w.encode())
    df = spark.createDataFrame([(w, 1) for w in r.sample(words, len(words))] + [(None, 2)], "word string, idx_old int").repartition(5)
    got = {x["word"]: x["idx"] for x in dense_index(df, "word").collect()}
    assert got == {w: i for i, w in enumerate(words)}
    assert dense_index(df.limit(0), "word").collect() == []


def test_a_shared_prefix_fills_no_task(spark):
    """Words that agree in their first ten characters are dealt out evenly."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df = spark.range(20_000).select(F.concat(F.lit("samesamesa"), F.md5(F.col("id").cast("string"))).alias("word"))
        out = dense_index(df, "word", out="at")
        assert out.agg(F.min("at"), F.max("at"), F.count_distinct("at")).first()[:] == (0, 19_999, 20_000)
        sizes = [r["count"] for r in df.repartitionByRange("word").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.set(key, old)
