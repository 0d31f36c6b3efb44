"""c_v topic coherence over boolean sliding windows (W5, M6), without
materialising a single window.

Reference texts are the whitespace-split processed texts of the validation
split; only texts holding a topic word count.  With window width ``w``, a
text of ``L`` tokens has ``max(L - w + 1, 1)`` windows (a short text is one
window).  An occurrence at position ``p`` is inside the windows starting in
``[max(0, p - w + 1), min(p, max(L - w, 0))]``; per (text, word) these
intervals are merged into islands (``lag`` + running sum), so

* windows containing word i   = sum of island lengths,
* windows containing i and j  = sum of island overlaps: islands are cut at every
  ``4 w`` windows, so that a text's islands meet only those of the same stretch
  (an island is ``w`` long but at a text's ends: few of a word in a stretch).

NPMI(i, j) = ln((p_ij + e) / (p_i p_j)) / -ln(p_ij + e), e = 1e-12, p_ii = p_i;
a pair present in every window scores 1 (the limit) instead of the formula's
0/0.  For topic words W: v_i = (NPMI(i, j))_j, V = sum_i v_i,
topic score = mean_i cos(v_i, V); the model score is the mean over topics.
Topic words absent from every reference text are left out and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 110
EPS = 1e-12


def window_islands(texts: DataFrame, words: DataFrame, width: int = WINDOW):
    """``texts(doc_id, pos, token)``; ``words(token)`` the relevant words.
    Returns ``(islands(doc_id, token, lo, hi), n_windows)`` as DataFrames."""
    lens = texts.groupBy("doc_id").agg((F.max("pos") + 1).alias("L"))
    # the words are topics times top words, a size set by the model and not by the data
    occ = texts.join(F.broadcast(words.select("token").distinct()), on="token", how="inner")
    relevant = occ.select("doc_id").distinct()
    n_windows = lens.join(relevant, on="doc_id").agg(
        F.sum(F.greatest(F.col("L") - (width - 1), F.lit(1))).cast("long").alias("n_windows"))
    o = occ.join(lens, on="doc_id").select(
        "doc_id", "token", F.greatest(F.col("pos") - (width - 1), F.lit(0)).alias("lo"),
        F.least(F.col("pos"), F.greatest(F.col("L") - width, F.lit(0))).alias("hi"))
    w = Window.partitionBy("doc_id", "token").orderBy("lo", "hi")
    prev = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    o = o.withColumn("_new", F.when(prev.isNull() | (F.col("lo") > prev), 1).otherwise(0))
    o = o.withColumn("_isl", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = o.groupBy("doc_id", "token", "_isl").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_isl")
    return islands, n_windows


def _stretches(islands: DataFrame, size: int) -> DataFrame:
    """The islands cut at multiples of ``size``, with the ``stretch`` each part is in."""
    number = F.explode(F.expr(f"sequence(lo div {size}, hi div {size})")).alias("stretch")
    return islands.select("doc_id", "token", "lo", "hi", number).select(
        "doc_id", "token", "stretch", F.greatest("lo", F.col("stretch") * size).alias("lo"),
        F.least("hi", F.col("stretch") * size + (size - 1)).alias("hi"))


def sliding_window_counts(texts: DataFrame, words: DataFrame, width: int = WINDOW) -> DataFrame:
    """``(doc_id, token, windows)`` = windows of the text containing the word."""
    islands, _ = window_islands(texts, words, width)
    return islands.groupBy("doc_id", "token").agg(F.sum(F.col("hi") - F.col("lo") + 1).cast("long").alias("windows"))


def coherence_by_topic(top: DataFrame, texts: DataFrame, width: int = WINDOW) -> DataFrame:
    """M6: ``(topic, coherence, n_words, n_scored)`` of every topic;
    ``top(topic, token)`` are the topic words (topics times words: they are
    sent to the tasks).  A topic none of whose words occurs has a null score."""
    from quill.session import materialize
    top = materialize(top.select("topic", "token").distinct())
    islands, n_windows = window_islands(texts, top.select("token"), width)
    islands = materialize(islands)
    wc = islands.groupBy("token").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("c_i"))
    wc = materialize(wc)
    t = top.join(wc, on="token", how="inner")  # words seen in the texts
    pairs = (t.select("topic", F.col("token").alias("wi"), F.col("c_i").alias("c_wi"))
             .join(t.select("topic", F.col("token").alias("wj"), F.col("c_i").alias("c_wj")), on="topic"))
    cut = _stretches(islands, 4 * width)
    a = cut.select("doc_id", "stretch", F.col("token").alias("wi"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    b = cut.select("doc_id", "stretch", F.col("token").alias("wj"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    needed = pairs.select("wi", "wj").distinct()
    ov = (a.join(needed, on="wi").join(b, on=["doc_id", "stretch", "wj"])
          .where((F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a")))
          .groupBy("wi", "wj").agg(F.sum(F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b") + 1).alias("c_ij")))
    n_total = n_windows.first()[0] or 0  # one scalar
    p = pairs.join(ov, on=["wi", "wj"], how="left").withColumn("n_windows", F.lit(n_total).cast("long"))
    n = F.col("n_windows").cast("double")
    pij = F.coalesce(F.col("c_ij"), F.lit(0)).cast("double") / n
    pi = F.col("c_wi").cast("double") / n
    pj = F.col("c_wj").cast("double") / n
    npmi = F.when(F.col("c_ij") == F.col("n_windows"), F.lit(1.0)).otherwise(
        F.log((pij + F.lit(EPS)) / (pi * pj)) / (-F.log(pij + F.lit(EPS))))
    p = p.select("topic", "wi", "wj", npmi.alias("npmi"))
    vsum = p.groupBy("topic", "wj").agg(F.sum("npmi").alias("V"))
    x = p.join(vsum, on=["topic", "wj"])
    cos = x.groupBy("topic", "wi").agg(
        F.try_divide(F.sum(F.col("npmi") * F.col("V")),
                     F.sqrt(F.sum(F.col("npmi") * F.col("npmi"))) * F.sqrt(F.sum(F.col("V") * F.col("V")))).alias("cos"))
    scores = cos.groupBy("topic").agg(F.avg("cos").alias("coherence"))
    words = top.join(wc, on="token", how="left").groupBy("topic").agg(
        F.count(F.lit(1)).alias("n_words"), F.count("c_i").alias("n_scored"))
    return words.join(scores, on="topic", how="left").select("topic", "coherence", "n_words", "n_scored")


def coherence_cv(top: DataFrame, texts: DataFrame, width: int = WINDOW) -> DataFrame:
    """M6: one row, the mean over the topics that have a score."""
    return coherence_by_topic(top, texts, width).agg(F.avg("coherence").alias("coherence"))
