"""Classifier head by epochs: against a plain loop, over blocks, after a stop."""
import numpy as np
import pytest

from quill.functions.hashing import hash_key
from quill.operators import head as HD
from quill.sources.versions import Versions
from pyspark.sql import functions as F


def _rows(spark, n, classes=3, dims=4, seed=0, shift=0):
    rng = np.random.default_rng(seed)
    centre = np.eye(classes, dims) * 3
    rows = [(i + shift, i % classes, [float(x) for x in centre[i % classes] + rng.normal(size=dims)]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, label_id int, features array<double>")


def test_one_block_is_the_sequential_loop(spark):
    train, val = _rows(spark, 45), _rows(spark, 30, seed=1, shift=1000)
    kept, log = HD.fit(train, val, 3, epochs=2, batch_size=8, lr=0.05)
    W = M = S = np.zeros((3, 5))
    step, want = 0, []
    for epoch in range(2):
        order = train.withColumn("o", hash_key(42, f"epoch{epoch}", F.col("doc_id"))).orderBy("o", "doc_id").collect()
        losses, correct = [], 0
        for k in range(0, 45, 8):
            X = np.array([[*r["features"], 1.0] for r in order[k:k + 8]])
            y = np.array([r["label_id"] for r in order[k:k + 8]])
            step += 1
            z = X @ W.T
            p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            losses.append(-np.log(p[np.arange(len(y)), y]).mean())
            correct += (z.argmax(1) == y).sum()
            g = (p - np.eye(3)[y]).T @ X / len(y)
            M, S = 0.9 * M + 0.1 * g, 0.999 * S + 0.001 * g**2
            W = W - 0.05 * 0.01 * W - 0.05 * (M / (1 - 0.9**step)) / (np.sqrt(S / (1 - 0.999**step)) + 1e-8)
        right = [np.argmax(W @ [*r["features"], 1.0]) == r["label_id"] for r in val.collect()]
        want.append((epoch, 6, np.mean(losses), correct / 45, np.mean(right)))
    got = [tuple(r) for r in log.orderBy("epoch").collect()]
    assert np.allclose(got, want)
    have = {r["label_id"]: [*r["weights"], r["bias"]] for r in HD.head_of(kept.read("params", "epoch=1")).collect()}
    assert np.allclose([have[c] for c in range(3)], W)


def test_blocks_meet_and_learn(spark):
    train, val = _rows(spark, 300), _rows(spark, 60, seed=1, shift=1000)
    kept, log = HD.fit(train, val, 3, epochs=4, batch_size=8, lr=0.05, block_rows=60)
    log = log.orderBy("epoch").collect()
    assert log[-1]["loss"] < log[0]["loss"] and log[-1]["val_accuracy"] > 0.9
    epoch, _ = HD.best(kept, kept.log())
    top = max(r["val_accuracy"] for r in log)
    assert epoch == next(r["epoch"] for r in log if r["val_accuracy"] == top)


def test_a_stopped_fit_goes_on(spark, tmp_path, monkeypatch):
    train, val = _rows(spark, 90), _rows(spark, 30, seed=1, shift=1000)
    args = dict(epochs=3, batch_size=8, lr=0.05, block_rows=40)
    whole = sorted(map(tuple, HD.fit(train, val, 3, **args)[1].collect()))
    commit = Versions.commit

    def lost(self, epoch, log):
        if epoch == 1:  # the driver is lost after the tables and before the marker
            raise RuntimeError("lost")
        commit(self, epoch, log)

    root = str(tmp_path / "kept")
    monkeypatch.setattr(Versions, "commit", lost)
    with pytest.raises(RuntimeError):
        HD.fit(train, val, 3, root=root, **args)
    assert Versions(spark, root).last() == 0
    monkeypatch.setattr(Versions, "commit", commit)
    assert np.allclose(sorted(map(tuple, HD.fit(train, val, 3, root=root, **args)[1].collect())), whole)
    assert Versions(spark, root).last() == 2


def test_no_rows(spark):
    with pytest.raises(ValueError):
        HD.fit(_rows(spark, 0), _rows(spark, 3), 3)
