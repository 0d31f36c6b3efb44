"""Oversampling and SMOTE invariants; exact kNN against brute force."""
import re

import numpy as np
from pyspark.sql import functions as F

from quill.operators import balance as B
from quill.operators import knn as KNN


def _docs(spark, counts):
    rows, i = [], 0
    for lab, n in counts.items():
        for _ in range(n):
            rows.append((i, lab)); i += 1
    return spark.createDataFrame(rows, "doc_id long, label string")


def test_ros_balances_every_class(spark):
    out = B.random_oversample(_docs(spark, {"a": 10, "b": 3, "c": 1}))
    n = {r["label"]: r["n"] for r in out.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 10, "b": 10, "c": 10}
    assert out.select("out_id").distinct().count() == 30


def test_tied_majority_adds_nothing(spark):
    out = B.random_oversample(_docs(spark, {"a": 5, "b": 5}))
    assert out.where(F.col("is_copy")).count() == 0


def test_adaptive_k(spark):
    assert B.smote_k(_docs(spark, {"a": 10, "b": 1})).first()["method"] == "ros"
    r = B.smote_k(_docs(spark, {"a": 10, "b": 3})).first()
    assert (r["k"], r["method"]) == (2, "smote")


def _points(spark, n_per_class, dim=5, seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for lab, n in n_per_class.items():
        for _ in range(n):
            rows.append((i, lab, [float(x) for x in rng.normal(size=dim)])); i += 1
    return spark.createDataFrame(rows, "doc_id long, label string, features array<double>"), rows


def test_knn_matches_brute_force(spark):
    pts, rows = _points(spark, {"a": 37, "b": 11})
    nn = KNN.knn_dense(pts, pts.select("doc_id", "label"), 3, block_size=8).collect()
    got = {(r["query_id"], r["rank"]): r["neighbor_id"] for r in nn}
    for i, li, fi in rows:
        cand = sorted(((sum((a - b) ** 2 for a, b in zip(fi, fj)), j) for j, lj, fj in rows if lj == li and j != i))
        for rank, (_, j) in enumerate(cand[:3], start=1):
            assert got[(i, rank)] == j


def test_smote_rows_between_base_and_neighbour(spark):
    pts, rows = _points(spark, {"a": 30, "b": 6})
    out = B.smote_dense(pts).collect()
    assert len([r for r in out if r["neighbor_id"] is None]) == 36  # the originals
    syn = [r for r in out if r["neighbor_id"] is not None]
    assert len(syn) == 24
    feats = {i: f for i, _, f in rows}
    for r in syn:
        a, b = np.array(feats[r["base_id"]]), np.array(feats[r["neighbor_id"]])
        v = np.array(r["features"])
        assert np.all(v >= np.minimum(a, b) - 1e-12) and np.all(v <= np.maximum(a, b) + 1e-12)


def test_knn_sparse_is_brute_force(spark):
    import random
    from quill.operators.knn import knn_sparse
    r = random.Random(3)
    docs = [(d, "ab"[d % 2]) for d in range(40)]
    bow = {d: {t: r.randint(1, 3) for t in r.sample(range(12), r.randint(0, 5))} for d, _ in docs}
    rows = [(d, t, c) for d, e in bow.items() for t, c in e.items()]
    df = spark.createDataFrame(docs, "doc_id long, label string")
    got = {(x["query_id"], x["rank"]): (x["neighbor_id"], x["dist"]) for x in knn_sparse(
        df, spark.createDataFrame(rows, "doc_id long, token_id int, cnt int"), df, 3, block_size=7).collect()}
    for d, label in docs:
        dist = sorted((sum((bow[d].get(t, 0) - bow[e].get(t, 0)) ** 2 for t in range(12)), e) for e, m in docs if m == label and e != d)
        assert [got[d, k + 1] for k in range(3)] == [(e, float(x)) for x, e in dist[:3]]


def test_balance_returns_originals_and_falls_back(spark):
    import pytest as pt
    from pyspark.sql import functions as F
    from quill.operators import balance as B
    docs = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in range(13)], "doc_id long, label string")
    points = docs.select("doc_id", F.array(F.col("doc_id").cast("double"), F.lit(1.0)).alias("features"))
    for method in B.METHODS:
        got = B.balance(docs, points, method).collect()
        assert sorted(x["label"] for x in got) == ["a"] * 10 + ["b"] * 10
        assert {x["out_id"] for x in got} >= set(range(13))
    lone = docs.where("doc_id <= 10")
    rows = B.balance(lone, points, "smote").where("label = 'b'").collect()
    assert len(rows) == 10 and {tuple(x["features"]) for x in rows} == {(10.0, 1.0)}
    with pt.raises(ValueError):
        B.balance(docs, points, "other")
    low = spark.createDataFrame([("a", 3)], "label string, target long")
    with pt.raises(Exception, match="target below"):
        B.class_targets(docs, strategy=low).collect()
    for strategy, want in (("minority", [10, 10]), ("not minority", [3, 10]), ("all", [10, 10])):
        assert sorted(x["target"] for x in B.class_targets(docs, strategy=strategy).collect()) == want


def test_draws_reach_past_32_bits(spark):
    from pyspark.sql import functions as F
    from quill.functions.hashing import hash_draw
    assert spark.range(50).agg(F.max(hash_draw(1, "t", F.col("id")))).first()[0] > 2**40


def test_knn_prunes_clusters_and_keeps_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], [float(round(x)) for x in rng.normal(size=3) * 3 + 200 * (i % 7)]) for i in range(420)]
    rows += [(1000 + i, "a", [1.0, 1.0, 1.0]) for i in range(12)] + [(2000, "c", [0.0, 0.0, 0.0])]
    pts = spark.createDataFrame(rows, "doc_id long, label string, features array<double>")
    asked = pts.where("doc_id % 3 = 0 or doc_id >= 1000").select("doc_id")
    measured = spark.sparkContext.accumulator(0)
    got = {}
    for r in KNN.knn_dense(pts, asked, 4, block_size=16, measured=measured).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"]))
    queries = {r["doc_id"] for r in asked.collect()}
    assert set(got) == queries - {2000}
    pairs = 0
    for i, li, fi in rows:
        if i in queries:
            cand = sorted((sum((a - b) ** 2 for a, b in zip(fi, fj)), j) for j, lj, fj in rows if lj == li and j != i)
            pairs += len(cand)
            if cand:
                assert [j for _, j in sorted(got[i])] == [j for _, j in cand[:4]]
    assert measured.value < pairs / 3
    assert KNN.knn_dense(pts.limit(0), asked, 4).collect() == []


def test_knn_sparse_by_few_coordinates(spark):
    import random
    r = random.Random(8)
    docs = [(d, "ab"[d % 3 == 0]) for d in range(90)]
    bow = {d: {t: r.randint(1, 4) for t in r.sample(range(40), r.randint(0, 9))} for d, _ in docs}
    bow[7] = dict(bow[20])
    df = spark.createDataFrame(docs, "doc_id long, label string")
    rows = spark.createDataFrame([(d, t, c) for d, e in bow.items() for t, c in e.items()], "doc_id long, token_id int, cnt int")
    for frequent in (1, 6):
        got = {(x["query_id"], x["rank"]): (x["neighbor_id"], x["dist"]) for x in KNN.knn_sparse(df, rows, df, 5, block_size=10, frequent=frequent).collect()}
        for d, label in docs:
            dist = sorted((sum((bow[d].get(t, 0) - bow[e].get(t, 0)) ** 2 for t in range(40)), e) for e, m in docs if m == label and e != d)
            assert [got[d, k + 1] for k in range(5)] == [(e, float(x)) for x, e in dist[:5]]


def test_visits_of_cells_come_in_bounded_frames(monkeypatch):
    """A batch in which every query visits every cell is not one frame; none is lost by it."""
    import numpy as np
    import pandas as pd
    from quill.operators import knn
    P = np.arange(12.0).reshape(6, 2)
    pivots, radius, size = {"a": P}, {"a": np.full(6, 100.0)}, {"a": np.full(6, 9.0)}
    rows = pd.DataFrame({"doc_id": range(50), "label": "a", "features": [P[i % 6] for i in range(50)], "cell": [i % 6 for i in range(50)],
                         "block": 0, "_kth": None})
    monkeypatch.setattr(knn, "VISIT_ROWS", 20)
    frames = list(knn._visits([rows], pivots, radius, size, 3))
    assert max(len(f) for f in frames) <= 20
    got = pd.concat(frames)
    assert sorted(zip(got["doc_id"], got["cell"])) == [(i, j) for i in range(50) for j in range(6)]
    assert all((g["_home"] == 0) == (g["cell"] == g["doc_id"] % 6) for g in got.to_dict("records"))


def test_draws_are_not_sent_whole_and_are_made_in_several_tasks(spark):
    """A chunk of draws is one row until it is made, so its size looks small (F1)."""
    docs = _docs(spark, {"a": 3000, "b": 2, "c": 2, "d": 3})
    plan = B.random_oversample(docs)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[label#\d+, idx", text) and not re.search(r"BroadcastHashJoin \[label#\d+, idx", text)
    draws = B.draw_table(B.class_targets(docs))
    assert draws.count() == 3 * 3000 - 7
    assert draws.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_visits_are_not_written(spark, monkeypatch):
    """Rows without clusters visit nearly all cells: they are sent once a region, and neighbours are those of all pairs, by ties too."""
    import numpy as np
    from quill import session
    r = np.random.default_rng(4)
    rows = [(i, "ab"[i % 3 == 0], [float(x) for x in r.integers(0, 4, 5)]) for i in range(240)]
    pts = spark.createDataFrame(rows, "doc_id long, label string, features array<double>")
    kept, written = session.materialize, []

    def counted(df, *a):
        out = kept(df, *a)
        if "features" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(session, "materialize", counted)
    for region, queries, found in ((65536, 16384, 10**6), (32, 50, 40)):
        for name, value in (("REGION_ROWS", region), ("SLICE_QUERIES", queries), ("FOUND_ROWS", found), ("VISITORS", 30)):
            monkeypatch.setattr(KNN, name, value)
        written.clear()
        got = {(x["query_id"], x["rank"]): (x["neighbor_id"], x["dist"]) for x in KNN.knn_dense(pts, pts, 4, block_size=8).collect()}
        assert written and max(written) <= 240
        for i, label, f in rows:
            near = sorted((sum((a - b) ** 2 for a, b in zip(f, g)), j) for j, other, g in rows if other == label and j != i)
            assert [got[i, k + 1] for k in range(4)] == [(j, d) for d, j in near[:4]]
