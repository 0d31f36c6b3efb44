"""Sub-word sequences: length, markers, mask."""
from quill.operators import wordpiece as WP


def test_long_text_truncated_and_masked(spark):
    words = [f"w{i % 7}" for i in range(300)] + ["zq"]
    toks = spark.createDataFrame([(1, p, w, "train") for p, w in enumerate(words)] +
                                 [(2, 0, "w1", "train")], "doc_id long, pos int, token string, split string")
    vocab = WP.build_piece_vocab(toks)
    enc = WP.encode_words(toks, vocab)
    seq = {r["doc_id"]: r for r in WP.encode_sequences(toks, enc).collect()}
    long, short = seq[1], seq[2]
    assert len(long["input_ids"]) == 128 and sum(long["attention_mask"]) == 128
    assert long["input_ids"][0] == 2 and long["input_ids"][127] == 3
    assert len(short["input_ids"]) == 128 and sum(short["attention_mask"]) == short["n_real"]
    assert short["input_ids"][short["n_real"]:] == [0] * (128 - short["n_real"])


def test_greedy_longest_match():
    v = {"un": 4, "##aff": 5, "##able": 6, "##a": 7, "u": 8, "##n": 9}
    assert WP._greedy("unaffable", v, 1, 4) == [4, 5, 6]
    assert WP._greedy("xyz", v, 1, 4) == [1]


def test_vocabulary_as_a_table_gives_the_same_pieces(spark, monkeypatch):
    pieces = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "##a", "u", "##n", "able", "##b", "b", "a", "e", "##e"]
    vocab = spark.createDataFrame([(p, i) for i, p in enumerate(pieces)], "piece string, id int")
    words = ["unaffable", "able", "unable", "bun", "aaa", "xyz", "unx", "", "\u00e9", "a" * 100, "a" * 101, "##a", "[UNK]", "un"]
    toks = spark.createDataFrame([(w,) for w in words + words], "token string")
    plain = {r["token"]: r["piece_ids"] for r in WP.encode_words(toks, vocab).collect()}
    monkeypatch.setattr(WP, "MAX_VOCAB_PIECES", 0)
    got = WP.encode_words(toks, vocab).collect()
    assert len(got) == len(plain) and {r["token"]: r["piece_ids"] for r in got} == plain
    assert plain["unaffable"] == [4, 5, 6]


def test_large_vocabulary_starts_no_python(spark):
    """A dictionary of the pieces lay in every Python worker up to two million pieces."""
    assert WP.MAX_VOCAB_PIECES <= 200_000
    toks = spark.createDataFrame([("ab",), ("abab",)], "token string")
    pieces = spark.range(200_100).selectExpr("concat('p', id) AS piece", "cast(id + 10 AS int) AS id").unionByName(
        spark.createDataFrame([("[UNK]", 1), ("ab", 2), ("##a", 3), ("##b", 4)], "piece string, id int"))
    out = WP.encode_words(toks, pieces)
    assert "Python" not in out._jdf.queryExecution().toString() and "MapInPandas" not in out._jdf.queryExecution().toString()
    assert {r["token"]: r["piece_ids"] for r in out.collect()} == {"ab": [2], "abab": [2, 3, 4]}
