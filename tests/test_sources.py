"""Sources, sinks and the streaming cleaner."""
import os
import tempfile

from quill.sources import files as FS
from quill.streaming import clean_stream as CS
from tests.conftest import SF_SMALL


def test_csv_round_trip_with_newlines(spark):
    d = tempfile.mkdtemp(prefix="quill-test-")
    df = spark.createDataFrame([(1, 'line one\nline "two"'), (2, None)], "doc_id long, text string")
    FS.write_csv(df, os.path.join(d, "c"))
    back = FS.read_csv(spark, os.path.join(d, "c"), "doc_id long, text string").orderBy("doc_id").collect()
    assert back[0]["text"] == 'line one\nline "two"'


def test_csv_with_line_breaks_in_several_tasks(spark, tmp_path):
    import csv
    import random
    r = random.Random(5)
    rows = []
    for k in range(400):
        body = "".join(r.choice(['word ', 'a,b ', '"quoted" ', "line\nbreak ", "\n\n", "tail"]) for _ in range(r.randint(0, 12)))
        rows.append((k, body + "\n" * (k % 3) + "x" * r.choice([0, 5, 900]), f"label{k % 4}"))
    for name, part in (("a.csv", rows[:250]), ("b.csv", rows[250:]), ("c.csv", [])):
        with open(tmp_path / name, "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_ALL)
            w.writerow(["id", "body", "label"])
            w.writerows(part)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        path, schema = str(tmp_path), "id long, body string, label string"
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        want = sorted(map(tuple, FS.read_csv(spark, path, schema).collect()))
        got = sorted(map(tuple, FS.read_csv_parallel(spark, path, schema).collect()))
        assert len(want) == 400 and got == want
        assert FS.read_csv_parallel(spark, path).dtypes == [("id", "string"), ("body", "string"), ("label", "string")]
        assert FS.read_csv_parallel(spark, str(tmp_path / "c.csv"), schema).collect() == []
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_keeps_fields_as_they_are(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "  spaces around  "), (4, 'a "quoted" word, and a comma'), (5, "line\nbreak\n"), (6, "\ttab"), (7, '"')]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    FS.write_csv(df, str(tmp_path / "c"))
    for read in (FS.read_csv, FS.read_csv_parallel):
        assert sorted(map(tuple, read(spark, str(tmp_path / "c"), "doc_id long, text string").collect())) == [(k, t or None) for k, t in rows]


def test_guarded_source_skips_missing(spark):
    assert FS.read_csv_guarded(spark, "/nonexistent/quill/input.csv") is None


def test_streaming_clean(spark):
    import shutil
    d = tempfile.mkdtemp(prefix="quill-stream-")
    os.makedirs(os.path.join(d, "in"))
    shutil.copy(f"{SF_SMALL}/documents.parquet", os.path.join(d, "in", "part-0.parquet"))
    src = CS.read_documents_stream(spark, os.path.join(d, "in"))
    q = CS.start_clean_to_parquet(src, os.path.join(d, "out"), os.path.join(d, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(d, "out"))
    assert out.count() > 0


def test_tables_and_json_round_trips(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F
    from quill.functions.text import whitespace_split
    from quill.operators import labels as L, topics as TM, vectorize as V
    path = lambda n: str(tmp_path / n)
    seqs = spark.createDataFrame([(1, "train", [2, 5, 3]), (2, "test", [2, 3, 0])], "doc_id long, split string, input_ids array<int>")
    FS.write_sequences(seqs, path("seq"))
    back = spark.read.parquet(path("seq")).where("split = 'test'").select("doc_id", "input_ids").collect()
    assert [(r["doc_id"], r["input_ids"]) for r in back] == [(2, [2, 3, 0])]
    bow = spark.createDataFrame([(1, 0, 2), (1, 3, 1)], "doc_id long, token_id int, cnt int")
    FS.write_bow(bow, path("bow"))
    assert sorted(map(tuple, spark.read.parquet(path("bow")).collect())) == [(1, 0, 2), (1, 3, 1)]
    vocab = spark.createDataFrame([("alpha", 0), ('b"q', 1)], "token string, token_id int")
    V.vocab_json_lines(vocab).write.text(path("vocab"))
    assert sorted(map(tuple, FS.read_vocabulary(spark, path("vocab")).collect())) == [("alpha", 0), ('b"q', 1)]
    lmap = L.fit_label_map(spark.createDataFrame([("x",), ("a",), ("x",)], "label string"))
    FS.write_json_lines(lmap, path("labels"))
    again = FS.read_label_map(spark, path("labels"))
    assert sorted(map(tuple, again.collect())) == [(0, "a"), (1, "x")]
    ids = spark.createDataFrame([(1,), (0,)], "label_id int")
    assert sorted(r["label"] for r in L.decode_labels(ids, again).collect()) == ["a", "x"]
    with pytest.raises(Exception, match="unseen label"):
        L.encode_labels(spark.createDataFrame([("new",)], "label string"), again).collect()
    params = TM.init_params(spark, 5, 3, 2)
    FS.save_params(params, path("ckpt"), "epoch=1")
    loaded = TM.params_to_numpy(FS.load_params(spark, path("ckpt"), "epoch=1"))
    assert {k: v.shape for k, v in loaded.items()}["dec"] == (5, 2)
    with pytest.raises(ValueError):
        FS.require_column(bow, "text")
    one = spark.createDataFrame([("a  b",)], "t string").select(whitespace_split(F.col("t")).alias("w")).first()
    assert one["w"] == ["a", "b"]


def test_lexicon_and_exceptions_are_inputs(spark):
    from quill.operators import clean as C
    words = spark.createDataFrame([(w,) for w in ("dogs", "les", "des", "theses", "mice", "boxes")], "token string")
    nouns = spark.createDataFrame([("dog",), ("thesis",), ("box",)], "word string")
    fixed = spark.createDataFrame([("theses", "thesis"), ("mice", "mouse"), ("oxen", "ox")], "token string, lemma string")
    got = {r["token"]: r["lemma"] for r in C.lemma_map(words, nouns, fixed).collect()}
    assert got == {"dogs": "dog", "theses": "thesis", "mice": "mouse", "boxes": "box"}  # foreign words stay


def test_large_lemma_maps_are_joined(spark, monkeypatch):
    from quill.operators import clean as C
    docs = spark.createDataFrame([(1, ["dogs", "run", "dogs"]), (2, []), (3, ["x"])], "doc_id long, tokens array<string>")
    lemmas = spark.createDataFrame([("dogs", "dog")], "token string, lemma string")
    want = {1: ["dog", "run", "dog"], 2: [], 3: ["x"]}
    assert {r["doc_id"]: r["tokens"] for r in C.lemmatize_arrays(docs, lemmas).collect()} == want
    monkeypatch.setattr(C, "MAP_ROWS", 0)
    assert {r["doc_id"]: r["tokens"] for r in C.lemmatize_arrays(docs, lemmas).collect()} == want
