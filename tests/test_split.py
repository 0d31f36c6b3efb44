"""Split invariants and fallbacks."""
from pyspark.sql import functions as F

from quill.operators import split as S


def _docs(spark, counts):
    rows, i = [], 0
    for lab, n in counts.items():
        for _ in range(n):
            rows.append((i, lab)); i += 1
    return spark.createDataFrame(rows, "doc_id long, label string")


def test_rare_classes_pooled_and_sizes(spark):
    d = _docs(spark, {"a": 20, "b": 2, "c": 1})
    out = S.stratified_split(d).collect()
    assert len(out) == 23 and len({r["doc_id"] for r in out}) == 23
    assert {r["label"] for r in out if r["stratum"] == "Other_Rare"} == {"b", "c"}
    sizes = {s: sum(1 for r in out if r["split"] == s) for s in ("train", "val", "test")}
    assert sizes == {"train": 18, "val": 2, "test": 3}


def test_lone_rare_row_falls_back(spark):
    d = _docs(spark, {"a": 20, "c": 1})
    feas = S.split_feasibility(d).first()
    assert feas["stratified"] is False
    out = S.stratified_split(d).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(21))


def test_quota_proportional(spark):
    d = _docs(spark, {"a": 50, "b": 30, "c": 20})
    out = S.stratified_split(d)
    tr = {r["label"]: r["n"] for r in out.where(F.col("split") == "train").groupBy("label").agg(F.count("*").alias("n")).collect()}
    for lab, n in {"a": 50, "b": 30, "c": 20}.items():
        assert abs(tr[lab] - n * 0.8) <= 1
