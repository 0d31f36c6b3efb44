"""Class balancing: targets, random oversampling and SMOTE.

Draws come from hashes, so every sample is reproducible and can be
recomputed in SQL:

* rows of class ``c`` are numbered 1..n_c in the order of
  ``md5('seed:order:doc_id')`` then ``doc_id`` (bucketed rank, no
  single-task window per class);
* random oversampling: copy ``j`` (1..deficit_c) of class ``c`` takes row
  ``1 + h(seed, c, j) % n_c``;
* SMOTE: draw ``j`` picks cell ``r = h(seed, c, j) % (n_c * k)``; the base is
  row ``r div k + 1``, the neighbour is its ``(r % k + 1)``-th nearest
  neighbour in the class, the gap is ``h(seed + 1, c, j) / 2**60``.

Copies get ``out_id = max(doc_id) + 1 + (deficits of earlier classes) + j - 1``;
originals keep ``out_id = doc_id``.  The draw table is generated in chunks
so a deficit of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.hashing import TWO_60, hash_draw, hash_key
from quill.functions.ranking import rank_within

DRAW_CHUNK = 1 << 20
DEFAULT_K = 5


def class_targets(df: DataFrame, label_col: str = "label", strategy="auto",
                  key_col: str = "doc_id") -> DataFrame:
    """``(label, n, target, deficit, offset)`` per class.

    ``strategy``: ``'auto'``/``'not majority'``/``'all'`` raise every class
    to the majority size; ``'minority'`` only the smallest class (ties: the
    smallest label); ``'not minority'`` every class but the smallest;
    a DataFrame ``(label, target)`` gives explicit targets (one below a class's
    size fails the job).  ``offset`` is
    the first ``out_id`` of the class's copies."""
    c = df.groupBy(F.col(label_col).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.max(key_col).alias("_maxkey"))
    w_all = Window.partitionBy(F.lit(0))
    c = c.withColumn("n_max", F.max("n").over(w_all)).withColumn("_base", F.max("_maxkey").over(w_all) + 1)
    if isinstance(strategy, DataFrame):
        t = strategy.select(F.col(strategy.columns[0]).alias("label"), F.col(strategy.columns[1]).alias("_t"))
        c = c.join(t, on="label", how="left").withColumn(
            "target", F.when(F.col("_t") < F.col("n"), F.raise_error(F.concat(
                F.lit("target below the size of class "), F.col("label"))).cast("long"))
            .otherwise(F.coalesce(F.col("_t"), F.col("n")))).drop("_t")
    else:
        s = str(strategy).lower()
        minority = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("n", "label")) == 1
        if s in ("auto", "not majority", "all"):
            c = c.withColumn("target", F.col("n_max"))
        elif s == "minority":
            c = c.withColumn("target", F.when(minority, F.col("n_max")).otherwise(F.col("n")))
        elif s == "not minority":
            c = c.withColumn("target", F.when(minority, F.col("n")).otherwise(F.col("n_max")))
        else:
            raise ValueError(f"unknown sampling strategy: {strategy!r}")
    c = c.withColumn("deficit", (F.col("target") - F.col("n")).cast("long"))
    w_cum = Window.partitionBy(F.lit(0)).orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("offset", F.col("_base") + F.coalesce(F.sum("deficit").over(w_cum), F.lit(0)))
    return c.select("label", F.col("n").cast("long"), F.col("target").cast("long"), "deficit",
                    F.col("offset").cast("long"))


def index_rows(df: DataFrame, label_col: str = "label", key_col: str = "doc_id",
               seed: int = 42, tag: str = "order") -> DataFrame:
    """Adds ``idx`` = 1-based position of the row inside its class."""
    x = df.withColumn("_ohk", hash_key(seed, tag, F.col(key_col)))
    return rank_within(x, [label_col], "_ohk", key_col, out="idx").drop("_ohk")


def draw_table(targets: DataFrame, seed: int = 42) -> DataFrame:
    """``(label, j, n, offset)`` for j in 1..deficit, generated chunk by chunk.

    A chunk is one row until its task makes its draws, so nothing measured before
    tells their size: the number of tasks is given, since tasks of so few rows
    would be put together, and joins with the draws are hinted (``merge``), since
    the draws would be sent whole through the driver."""
    t = targets.where(F.col("deficit") > 0)
    chunks = t.select("label", "n", "deficit", "offset",
                      F.explode(F.sequence(F.lit(0).cast("long"),
                                           F.floor((F.col("deficit") - 1) / DRAW_CHUNK).cast("long"))).alias("chunk"))
    chunks = chunks.repartition(2 * targets.sparkSession.sparkContext.defaultParallelism, F.col("label"), F.col("chunk"))
    lo = F.col("chunk") * DRAW_CHUNK + 1
    hi = F.least(F.col("deficit"), (F.col("chunk") + 1) * DRAW_CHUNK)
    return chunks.select("label", "n", "offset", F.explode(F.sequence(lo, hi)).alias("j"))


def random_oversample(df: DataFrame, label_col: str = "label", key_col: str = "doc_id",
                      seed: int = 42, strategy="auto") -> DataFrame:
    """Originals plus copies, ``(out_id, doc_id, label, is_copy)``."""
    base = df.select(F.col(key_col).alias("doc_id"), F.col(label_col).alias("label"))
    targets = class_targets(base, "label", strategy)
    idx = index_rows(base, seed=seed)
    draws = draw_table(targets, seed).withColumn(
        "idx", (F.lit(1) + hash_draw(seed, F.col("label"), F.col("j")) % F.col("n")).cast("long"))
    copies = draws.hint("merge").join(idx, on=["label", "idx"], how="inner").select(
        (F.col("offset") + F.col("j") - 1).alias("out_id"), "doc_id", "label", F.lit(True).alias("is_copy"))
    originals = base.select(F.col("doc_id").alias("out_id"), "doc_id", "label", F.lit(False).alias("is_copy"))
    return originals.unionByName(copies)


def smote_k(df: DataFrame, label_col: str = "label", k_max: int = DEFAULT_K) -> DataFrame:
    """One row ``(min_class, k, method)``: k = min(k_max, smallest
    class - 1); with a class below 2 rows the method falls back to random
    oversampling."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.min("n").cast("long").alias("min_class")).select(
        "min_class",
        F.least(F.lit(k_max).cast("long"), F.col("min_class") - 1).alias("k"),
        F.when(F.col("min_class") < 2, F.lit("ros")).otherwise(F.lit("smote")).alias("method"))


def smote_draws(df: DataFrame, k: int, label_col: str = "label", key_col: str = "doc_id",
                seed: int = 42, strategy="auto") -> DataFrame:
    """B8 draw table: ``(out_id, label, base_id, nn_rank, gap)``."""
    base = df.select(F.col(key_col).alias("doc_id"), F.col(label_col).alias("label"))
    targets = class_targets(base, "label", strategy)
    idx = index_rows(base, seed=seed)
    r = hash_draw(seed, F.col("label"), F.col("j")) % (F.col("n") * k)
    draws = (draw_table(targets, seed)
             .withColumn("idx", (F.floor(r / k) + 1).cast("long"))
             .withColumn("nn_rank", (r % k + 1).cast("int"))
             .withColumn("gap", hash_draw(seed + 1, F.col("label"), F.col("j")) / F.lit(TWO_60)))
    return draws.hint("merge").join(idx, on=["label", "idx"], how="inner").select(
        (F.col("offset") + F.col("j") - 1).alias("out_id"), "label",
        F.col("doc_id").alias("base_id"), "nn_rank", "gap")


def smote_dense(points: DataFrame, k: int | None = None, label_col: str = "label",
                features_col: str = "features", seed: int = 42, strategy="auto",
                block_size: int = 256) -> DataFrame:
    """B8 on dense vectors: the originals and the synthetic rows ``(out_id,
    label, base_id, neighbor_id, gap, features)``; an original is its own base
    without neighbour and gap.  ``k`` defaults to the adaptive k (B9); a class
    of fewer than 2 rows is an error here (``balance`` falls back instead)."""
    from quill.operators.knn import knn_dense
    from quill.session import materialize
    pts = materialize(points.select(F.col("doc_id"), F.col(label_col).alias("label"), F.col(features_col).alias("features")))
    if k is None:
        row = smote_k(pts).first()  # one scalar row that sizes the plan
        if row["method"] != "smote":
            raise ValueError("smallest class has fewer than 2 rows: use random_oversample")
        k = int(row["k"])
    draws = materialize(smote_draws(pts, k, seed=seed, strategy=strategy))
    queries = draws.select(F.col("base_id").alias("doc_id"), "label").distinct()
    nn = knn_dense(pts, queries, k, block_size=block_size)
    # rows of points grow with the input, though their files may look small enough to be sent whole
    d = draws.join(nn.select(F.col("query_id").alias("base_id"), F.col("rank").alias("nn_rank"), "neighbor_id").hint("merge"),
                   on=["base_id", "nn_rank"], how="inner")
    b = pts.select(F.col("doc_id").alias("base_id"), F.col("features").alias("_fb"))
    n = pts.select(F.col("doc_id").alias("neighbor_id"), F.col("features").alias("_fn"))
    d = d.join(b.hint("merge"), on="base_id").join(n.hint("merge"), on="neighbor_id")
    feats = F.zip_with("_fb", "_fn", lambda a, c: a + F.col("gap") * (c - a))
    own = pts.select(F.col("doc_id").alias("out_id"), "label", F.col("doc_id").alias("base_id"),
                     F.lit(None).cast("long").alias("neighbor_id"), F.lit(None).cast("double").alias("gap"), "features")
    return own.unionByName(d.select("out_id", "label", "base_id", "neighbor_id", "gap", feats.alias("features")))


def smote_sparse(docs: DataFrame, bow: DataFrame, k: int | None = None, seed: int = 42,
                 strategy="auto", integral: bool = True, block_size: int = 256) -> DataFrame:
    """B8 on bag-of-words counts.  ``docs(doc_id, label)`` are the rows (a
    document without an in-vocabulary token is an all-zero row),
    ``bow(doc_id, token_id, cnt)`` their counts.  Returns the triples
    ``(out_id, label, token_id, cnt)`` of originals and synthetic rows; with ``integral`` the value is
    truncated to an integer like the reference's integer matrix, zeros dropped."""
    from quill.operators.knn import knn_sparse
    from quill.session import materialize
    docs, bow = materialize(docs.select("doc_id", "label")), materialize(bow.select("doc_id", "token_id", "cnt"))
    if k is None:
        row = smote_k(docs).first()  # one scalar row that sizes the plan
        if row["method"] != "smote":
            raise ValueError("smallest class has fewer than 2 rows: use random_oversample")
        k = int(row["k"])
    draws = materialize(smote_draws(docs, k, seed=seed, strategy=strategy))
    queries = draws.select(F.col("base_id").alias("doc_id"), "label").distinct()
    nn = knn_sparse(docs, bow.select("doc_id", "token_id", "cnt"), queries, k, block_size=block_size)
    d = draws.join(nn.select(F.col("query_id").alias("base_id"), F.col("rank").alias("nn_rank"), "neighbor_id"),
                   on=["base_id", "nn_rank"], how="inner").select("out_id", "label", "base_id", "neighbor_id", "gap")
    a = d.join(bow.select(F.col("doc_id").alias("base_id"), "token_id", F.col("cnt").alias("_a")), on="base_id")
    b = d.join(bow.select(F.col("doc_id").alias("neighbor_id"), "token_id", F.col("cnt").alias("_b")), on="neighbor_id")
    j = a.select("out_id", "label", "gap", "token_id", "_a").join(
        b.select("out_id", F.col("label").alias("_lb"), F.col("gap").alias("_gb"), "token_id", "_b"),
        on=["out_id", "token_id"], how="full_outer")
    gap = F.coalesce(F.col("gap"), F.col("_gb"))
    av = F.coalesce(F.col("_a"), F.lit(0)).cast("double")
    bv = F.coalesce(F.col("_b"), F.lit(0)).cast("double")
    val = av + gap * (bv - av)
    out = j.select("out_id", F.coalesce(F.col("label"), F.col("_lb")).alias("label"), "token_id",
                   (val.cast("long").cast("int") if integral else val).alias("cnt"))
    own = docs.join(bow.select("doc_id", "token_id", "cnt"), on="doc_id").select(
        F.col("doc_id").alias("out_id"), "label", "token_id", F.col("cnt").cast(out.schema["cnt"].dataType).alias("cnt"))
    return own.unionByName(out.where(F.col("cnt") != 0))


METHODS = ("ros", "smote")


def balance(docs: DataFrame, features: DataFrame, method: str = "smote", strategy="auto",
            k: int | None = None, seed: int = 42) -> DataFrame:
    """The balanced table, originals and added rows together.

    ``docs(doc_id, label)``; ``features`` has one row per document
    (``features`` vectors, or any columns with ``method='ros'``) or bag-of-words
    triples (``token_id, cnt``).  ``smote`` needs 2 rows in every class and
    turns into ``ros`` otherwise; another method is an error."""
    if method not in METHODS:
        raise ValueError(f"unknown balancing method: {method!r}")
    docs = docs.select("doc_id", "label")
    if method == "smote" and smote_k(docs).first()["method"] == "ros":  # one scalar row that picks the plan
        method = "ros"
    if method == "ros":
        rows = random_oversample(docs, seed=seed, strategy=strategy).select("out_id", "doc_id", "label")
        return rows.hint("merge").join(features.drop("label"), on="doc_id", how="inner").drop("doc_id")
    if "token_id" in features.columns:
        return smote_sparse(docs, features, k, seed=seed, strategy=strategy)
    points = docs.join(features.select("doc_id", "features"), on="doc_id", how="inner")
    return smote_dense(points, k, seed=seed, strategy=strategy).select("out_id", "label", "features")
