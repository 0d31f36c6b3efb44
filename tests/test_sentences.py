"""Abbreviations found in a corpus, and the tokens they change."""
from quill.operators import clean as C
from quill.operators import sentences as N

SCHEMA = "doc_id long, text string"


def _corpus(spark):
    rows = [(i, f"We met Mr. Smith and Dr. Jones at {i} p.m. on the hill. The hill and the house were green, e.g. near a tree. They saw the tree and a house.") for i in range(40)]
    return spark.createDataFrame(rows + [(900, None), (901, ""), (902, "Ask Mr.")], SCHEMA)


def test_abbreviations_are_told_from_sentence_ends(spark):
    got = {r["word"]: r for r in N.abbreviations(_corpus(spark)).collect()}
    assert {w for w, r in got.items() if r["is_abbreviation"]} == {"mr", "dr", "p.m", "e.g"}
    assert (got["mr"]["n"], got["mr"]["n_period"]) == (41, 41)
    assert (got["house"]["n"], got["house"]["n_period"]) == (80, 40) and not got["house"]["is_abbreviation"]


def test_tokens_keep_the_period(spark):
    rows = [(1, "Then (Mr. Smith) came.  He, Mr., left. Ask Mr."), (2, "No. Mr... Smith"), (3, None), (4, ""), (None, "a Mr. b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    words = spark.createDataFrame([("mr",), ("mr",)], "word string")
    got = {r["doc_id"]: r["tokens"] for r in N.tokenize(docs, words).collect()}
    assert got[1] == ["Then", "(", "Mr.", "Smith", ")", "came", ".", "He", ",", "Mr.", ",", "left", ".", "Ask", "Mr", "."]
    assert got[2] == ["No", ".", "Mr", "...", "Smith"]
    assert got[3] == [] and got[4] == [] and got[None] == ["a", "Mr.", "b"]


def test_cleaning_drops_abbreviations(spark):
    docs = spark.createDataFrame([(1, "Mr. Smith walks home.", "x")], SCHEMA + ", label string")
    words = spark.createDataFrame([("mr",)], "word string")
    plain = C.clean_corpus(docs, lemmatize=False).first()["tokens"]
    known = C.clean_corpus(docs, lemmatize=False, abbreviated=words).first()["tokens"]
    assert plain == ["mr", "smith", "walks", "home"] and known == ["smith", "walks", "home"]


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert N.abbreviations(empty).collect() == []
    assert N.tokenize(empty, N.abbreviations(empty)).collect() == []


def test_a_long_text_is_cut_into_pieces_once(spark):
    """30,000 pieces, cut again for every piece, would take minutes."""
    import time
    docs = spark.createDataFrame([(1, "Then Mr. Smith came home. " * 6000)], SCHEMA)
    words = spark.createDataFrame([("mr",)], "word string")
    begun = time.time()
    tokens = N.tokenize(docs, words).first()["tokens"]
    assert time.time() - begun < 30
    assert tokens.count("Mr.") == 6000 and tokens.count(".") == 6000 and len(tokens) == 36000
