"""Classifier head fitted epoch by epoch (C2, C3, A13): mini-batches, AdamW with
decoupled weight decay, validation after each epoch, the best epoch kept.

Train rows are dealt into blocks by hash.  In an epoch every block goes through
its mini-batches in a fresh hash order, starting from the epoch's weights and
moments; what the blocks end with is averaged by their rows, as sums per class
and element.  One block is the sequential loop over all rows; more of them run at
once and meet at the end of the epoch, so an epoch is one job whatever the number
of rows.  Weights, moments and log are kept by epoch (``Versions``): a fit that
was stopped goes on after its last whole epoch.

Rows stream through a block's task in order; it holds a batch and the head
(classes x dimensions, at most ``classify.MAX_HEAD_WEIGHTS``)."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.functions.hashing import hash_draw, hash_key
from quill.operators import classify as CL
from quill.sources.versions import Versions

BLOCK_ROWS = 100_000
_SENT = "block int, label_id int, values array<double>, rows long, batches long, loss double, correct long"


def _batch_step(W: np.ndarray, M: np.ndarray, S: np.ndarray, X: np.ndarray, y: np.ndarray, step: int, lr: float, decay: float):
    """One AdamW step on a batch; X ends with a column of ones.  Loss and correct rows are those before it."""
    logits = X @ W.T
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss, correct = -np.log(p[at, y]).mean(), int((logits.argmax(axis=1) == y).sum())
    p[at, y] -= 1.0
    g = p.T @ X / len(y)
    M, S = 0.9 * M + 0.1 * g, 0.999 * S + 0.001 * g * g
    W = W * (1 - lr * decay) - lr * (M / (1 - 0.9**step)) / (np.sqrt(S / (1 - 0.999**step)) + 1e-8)
    return W, M, S, loss, correct


def _epoch_fn(bm, first: int, batch_size: int, lr: float, decay: float):
    def fn(frames):
        start, now = bm.value, None
        held: list[pd.DataFrame] = []

        def learn(rows: pd.DataFrame) -> None:
            X = np.stack(rows["features"].to_numpy()).astype(np.float64)
            X = np.concatenate([X, np.ones((len(X), 1))], axis=1)
            state["step"] += 1
            *state["w"], loss, correct = _batch_step(*state["w"], X, rows["label_id"].to_numpy(), first + state["step"], lr, decay)
            state["rows"] += len(rows)
            state["loss"] += loss
            state["correct"] += correct

        def end() -> pd.DataFrame:
            if held:
                learn(pd.concat(held))
            flat = np.concatenate(state["w"], axis=1)
            n = len(flat)
            # scalars once a block: on its first class
            one = np.arange(n) == 0
            return pd.DataFrame({"block": now, "label_id": np.arange(n, dtype=np.int32), "values": list(flat * state["rows"]), "rows": state["rows"],
                                 "batches": one * state["step"], "loss": one * state["loss"], "correct": one * state["correct"]})

        for frame in frames:
            for block, part in frame.groupby("block", sort=False):
                if block != now:
                    if now is not None:
                        yield end()
                    now, held = block, []
                    state = {"w": list(start), "step": 0, "rows": 0, "loss": 0.0, "correct": 0}
                while len(part):
                    room = batch_size - sum(map(len, held))
                    held.append(part.iloc[:room])
                    part = part.iloc[room:]
                    if sum(map(len, held)) == batch_size:
                        learn(pd.concat(held))
                        held = []
        if now is not None:
            yield end()

    return fn


def _matrices(state: DataFrame, classes: int) -> tuple[np.ndarray, ...]:
    """Weights and both moments (classes x (dimensions + 1))."""
    rows = state.orderBy("label_id").collect()  # a row per class, checked against MAX_HEAD_WEIGHTS
    flat = np.array([r["values"] for r in rows])
    return tuple(np.split(flat, 3, axis=1))


def head_of(state: DataFrame) -> DataFrame:
    """``(label_id, weights, bias)`` of kept parameters."""
    n = F.size("values") / 3
    return state.select("label_id", F.slice("values", F.lit(1), (n - 1).cast("int")).alias("weights"), F.element_at("values", n.cast("int")).alias("bias"))


def fit(train: DataFrame, val: DataFrame, classes: int, epochs: int = 3, batch_size: int = 16, lr: float = 2e-5, decay: float = 0.01,
        seed: int = 42, block_rows: int = BLOCK_ROWS, root: str | None = None) -> tuple[Versions, DataFrame]:
    """C2/C3 on ``(doc_id, label_id, features)``: the kept parameters by epoch
    and the log ``(epoch, batches, loss, train_accuracy, val_accuracy)``: mean
    loss over the batches, accuracy while training and after the epoch."""
    from quill.session import ensure_checkpoint_dir, materialize
    spark = train.sparkSession
    if root is None:
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quill-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    kept = Versions(spark, root)
    n = train.count()
    if n == 0:
        raise ValueError("no row to fit on")
    dims = train.select(F.size("features").alias("d")).first()["d"]
    if classes * dims > CL.MAX_HEAD_WEIGHTS:
        raise ValueError(f"a head of {classes} x {dims} weights is too large to send to every task")
    blocks = -(-n // block_rows)
    dealt = materialize(train.select("doc_id", "label_id", "features", (hash_draw(seed, "block", F.col("doc_id")) % blocks).cast("int").alias("block")))
    val = materialize(val.select("doc_id", "label_id", "features"))
    last = kept.last()
    first = 0 if last is None else kept.log().agg(F.sum("steps")).first()[0]
    state = None if last is None else kept.read("params", f"epoch={last}")
    for epoch in range(0 if last is None else last + 1, epochs):
        start = tuple(np.zeros((classes, dims + 1)) for _ in range(3)) if state is None else _matrices(state, classes)
        bm = spark.sparkContext.broadcast(start)
        ordered = dealt.withColumn("_o", hash_key(seed, f"epoch{epoch}", F.col("doc_id"))).repartition(blocks, "block").sortWithinPartitions("block", "_o", "doc_id")
        sent = materialize(ordered.select("block", "label_id", "features").mapInPandas(_epoch_fn(bm, first, batch_size, lr, decay), _SENT))
        each = sent.select("label_id", "rows", F.posexplode("values").alias("pos", "v")).groupBy("label_id", "pos").agg((F.sum("v") / F.sum("rows")).alias("v"))
        params = each.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_v")).select("label_id", F.col("_v.v").alias("values"))
        state = materialize(params)
        accuracy = CL.accuracy(CL.argmax_predict(CL.head_logits(val, head_of(state)))).select(F.col("accuracy").alias("val_accuracy"))
        log = sent.agg(F.sum("batches").alias("batches"), F.max("batches").alias("steps"), (F.sum("loss") / F.sum("batches")).alias("loss"), (F.sum("correct") / F.lit(n)).alias("train_accuracy"))
        kept.write("params", f"epoch={epoch}", state)
        kept.commit(epoch, log.join(accuracy, F.lit(True)).coalesce(1))
        state = kept.read("params", f"epoch={epoch}")
        first += kept.log().where(F.col("epoch") == epoch).first()["steps"]
    return kept, kept.log().where(F.col("epoch") < epochs).select("epoch", "batches", "loss", "train_accuracy", "val_accuracy")


def best(kept: Versions, log: DataFrame) -> tuple[int, DataFrame]:
    """The epoch of the best validation accuracy (the earliest of equals) and its head."""
    epoch = log.orderBy(F.col("val_accuracy").desc_nulls_last(), "epoch").first()["epoch"]
    return epoch, head_of(kept.read("params", f"epoch={epoch}"))
