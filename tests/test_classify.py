"""Classification metrics edge cases."""
from quill.operators import classify as CL


def _pred(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "doc_id long, label_id int, pred_id int")


def test_class_never_predicted(spark):
    p = _pred(spark, [(0, 0), (1, 0), (2, 2), (2, 0)])
    s = {r["label_id"]: r for r in CL.class_scores(p).collect()}
    assert s[1]["precision"] == 0.0 and s[1]["recall"] == 0.0 and s[1]["f1"] == 0.0 and s[1]["support"] == 1


def test_weighted_recall_equals_accuracy(spark):
    p = _pred(spark, [(0, 0), (1, 0), (2, 2), (2, 0), (1, 1), (0, 2)])
    m = CL.weighted_metrics(p).first()
    assert abs(m["recall"] - m["accuracy"]) < 1e-12
    rep = {r["row"]: r for r in CL.classification_report(p, spark.createDataFrame(
        [(0, "x"), (1, "y"), (2, "z")], "label_id int, label string")).collect()}
    assert set(rep) == {"x", "y", "z", "accuracy", "macro avg", "weighted avg"}


def test_argmax_first_index_on_ties(spark):
    df = spark.createDataFrame([(1, [0.5, 2.0, 2.0])], "doc_id long, logits array<double>")
    assert CL.argmax_predict(df).first()["pred_id"] == 1
