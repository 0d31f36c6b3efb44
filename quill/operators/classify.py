"""Classifier over pooled document vectors and its evaluation
(C1-C5, A10-A12, A16, W3, J8).

The encoder's pooled vector is an input column (``features``); the head is a
linear layer ``logits = W x + b``.  Two heads are provided:

* ``fit_centroid_head``: deterministic nearest-centroid head
  (``W_c`` = class mean, ``b_c = -|W_c|^2 / 2``), computable in SQL;
* ``fit_softmax_head``: multinomial logistic regression (MLlib, distributed
  L-BFGS), the trained head of the reference.

Model weights (classes x dimensions, checked) go to the tasks as one row of
arrays, so inference is a narrow, shuffle-free stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HEAD_WEIGHTS = 10_000_000   # classes x dims up to which the head is sent to the tasks


def fit_centroid_head(train: DataFrame, label_map: DataFrame) -> DataFrame:
    """``(label_id, weights array<double>, bias double)`` from class means."""
    t = train.join(label_map, on="label", how="inner")
    ex = t.select("label_id", F.posexplode("features").alias("dim", "v"))
    means = ex.groupBy("label_id", "dim").agg(F.avg("v").alias("m"))
    w = means.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("_w"))
    w = w.select("label_id", F.transform("_w", lambda s: s["m"]).alias("weights"))
    return w.select("label_id", "weights",
                    (F.aggregate("weights", F.lit(0.0), lambda acc, x: acc + x * x) * F.lit(-0.5)).alias("bias"))


def fit_softmax_head(train: DataFrame, label_map: DataFrame, max_iter: int = 100,
                     reg: float = 0.01) -> DataFrame:
    """Multinomial logistic regression; returns the same weight table."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    t = train.join(label_map, on="label", how="inner").select(
        array_to_vector("features").alias("fv"), F.col("label_id").cast("double").alias("y"))
    lr = LogisticRegression(featuresCol="fv", labelCol="y", family="multinomial", maxIter=max_iter,
                            regParam=reg, elasticNetParam=0.0)
    m = lr.fit(t)
    spark = train.sparkSession
    coef = m.coefficientMatrix.toArray().tolist()  # classes x dims: bounded model
    icpt = m.interceptVector.toArray().tolist()
    rows = [(i, coef[i], float(icpt[i])) for i in range(len(coef))]
    return spark.createDataFrame(rows, "label_id int, weights array<double>, bias double")


def head_logits(df: DataFrame, head: DataFrame) -> DataFrame:
    """C4: adds ``logits array<double>`` (index = label_id).  The head is one
    row of arrays, sent to the tasks after a check of its size."""
    n = head.agg(F.sum(F.size("weights"))).first()[0] or 0  # one scalar
    if n > MAX_HEAD_WEIGHTS:
        raise ValueError(f"a head of {n} weights is too large to send to every task")
    one = head.agg(F.array_sort(F.collect_list(F.struct("label_id", "weights", "bias"))).alias("_head"))
    dot = lambda w: F.aggregate(F.zip_with("features", w, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    out = df.join(F.broadcast(one), F.lit(True))
    return out.withColumn("logits", F.transform("_head", lambda h: dot(h["weights"]) + h["bias"])).drop("_head")


def argmax_predict(df: DataFrame, logits_col: str = "logits") -> DataFrame:
    """``pred_id`` = first index of the largest logit."""
    return df.withColumn("pred_id", (F.array_position(logits_col, F.array_max(logits_col)) - 1).cast("int"))


def cross_entropy(df: DataFrame, logits_col: str = "logits", label_col: str = "label_id") -> DataFrame:
    """Mean of ``logsumexp(logits) - logits[label]``."""
    mx = F.array_max(logits_col)
    lse = mx + F.log(F.aggregate(F.transform(logits_col, lambda z: F.exp(z - mx)), F.lit(0.0), lambda a, x: a + x))
    nll = lse - F.element_at(logits_col, F.col(label_col) + 1)
    return df.agg(F.avg(nll).alias("cross_entropy"))


def accuracy(pred: DataFrame) -> DataFrame:
    """A10: one row; null for an empty input."""
    return pred.agg(F.avg((F.col("pred_id") == F.col("label_id")).cast("double")).alias("accuracy"))


def confusion(pred: DataFrame) -> DataFrame:
    """``(label_id, pred_id, n)``: every metric below is a sum over it."""
    return pred.groupBy("label_id", "pred_id").agg(F.count(F.lit(1)).alias("n"))


def class_scores(pred: DataFrame, label_map: DataFrame | None = None) -> DataFrame:
    """Per class ``(label_id, precision, recall, f1, support, tp)`` over classes
    in truth or prediction (plus every class of ``label_map`` when given); 0/0 -> 0.
    ``pred`` may be predictions or their confusion table."""
    c = pred if "n" in pred.columns else confusion(pred)
    hit = F.when(F.col("label_id") == F.col("pred_id"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    rows = c.select("label_id", hit.cast("long").alias("tp"), F.col("n").cast("long").alias("support"), zero.alias("npred")).unionAll(
        c.select("pred_id", zero, zero, F.col("n").cast("long")))
    if label_map is not None:
        rows = rows.unionAll(label_map.select("label_id", zero, zero, zero))
    c = rows.groupBy("label_id").agg(*[F.sum(x).alias(x) for x in ("tp", "support", "npred")])
    p = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    c = c.select("label_id", p.alias("precision"), r.alias("recall"), "support", "tp")
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return c.withColumn("f1", f1)


def weighted_metrics(pred: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (one row)."""
    s = class_scores(pred)
    tot = F.sum("support")
    m = s.agg((F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
              (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
              (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"),
              (F.sum("tp") / tot).alias("accuracy"))
    return m


def classification_report(pred: DataFrame, label_map: DataFrame) -> DataFrame:
    """One row per class of the label map, then ``accuracy``, ``macro
    avg``, ``weighted avg`` — ``(row, precision, recall, f1, support)``.  The
    scores are one row per class, written once; every line comes from them."""
    from quill.session import materialize
    s = materialize(class_scores(confusion(pred), label_map).join(label_map, "label_id", "left"))
    per = s.select(F.coalesce(F.col("label"), F.col("label_id").cast("string")).alias("row"),
                   "precision", "recall", "f1", "support")
    tot = F.sum("support")
    null = F.lit(None).cast("double")
    macro = s.agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.cast("long").alias("support"))
    weighted = s.agg(F.lit("weighted avg").alias("row"),
                     (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                     (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                     (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.cast("long").alias("support"))
    acc = s.agg(F.lit("accuracy").alias("row"), null.alias("precision"), null.alias("recall"),
                (F.sum("tp") / tot).alias("f1"), tot.cast("long").alias("support"))
    return per.unionByName(acc).unionByName(macro).unionByName(weighted)
