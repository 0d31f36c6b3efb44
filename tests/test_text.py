"""Tokeniser and cleaning edge cases (FIXTURES section 4)."""
import duckdb
from pyspark.sql import functions as F

from quill.functions import text as T
from quill.operators import clean as C

CASES = {
    1: None,
    2: "The, and!!",
    3: "nan",
    4: "null",
    5: "long-term 3.5% $1,000 U.S. growth",
    6: "Don't worry",
    7: "market market",
    8: "I cannot go. He's gonna win... (maybe) \"quoted\" dogs' bones",
    9: "DON'T Cannot cannot GONNA",
    10: "Café élan ÉTÉ 10:30 a,b",
}


def _clean(spark):
    df = spark.createDataFrame([(k, v) for k, v in CASES.items()], "doc_id long, text string")
    return {r["doc_id"]: r["t"] for r in df.select("doc_id", T.clean_tokens("text").alias("t")).collect()}


def test_edge_rows(spark):
    out = _clean(spark)
    assert out[1] == []
    assert out[2] == []
    assert out[3] == ["nan"] and out[4] == ["null"]
    assert out[5] == ["growth"]
    assert out[6] == ["worry"]
    assert out[7] == ["market", "market"]
    assert out[8] == ["go", "gon", "na", "win", "maybe", "quoted", "dogs", "bones"]
    assert out[9] == ["gon", "na"]
    assert out[10] == ["café", "élan", "été", "b"]


def test_spark_rules_equal_portable_rules(spark):
    """The merged Java rules and the RE2 rules used by the oracle agree."""
    con = duckdb.connect()
    rows = [(k, v) for k, v in CASES.items()]
    con.execute("CREATE TABLE t(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    duck = {d: list(tk) for d, tk in con.execute(f"SELECT doc_id, {T.tokenize_sql('text')} FROM t").fetchall()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sp = {r["doc_id"]: list(r["t"]) for r in df.select("doc_id", T.tokenize("text").alias("t")).collect()}
    assert sp == duck


def test_drop_empty_and_join(spark):
    df = spark.createDataFrame([(k, v, "x") for k, v in CASES.items()], "doc_id long, text string, label string")
    cc = C.clean_corpus(df, lemmatize=False, keep_empty=False)
    ids = {r["doc_id"] for r in cc.collect()}
    assert 1 not in ids and 2 not in ids and 7 in ids
    row = cc.where(F.col("doc_id") == 7).first()
    assert row["processed_content"] == "market market"


def test_lemma_rules(spark):
    toks = spark.createDataFrame([(w,) for w in ["markets", "glasses", "women", "wolves", "bus", "zzzs"]], "token string")
    lex = spark.createDataFrame([(w,) for w in ["market", "glass", "glasse", "woman", "women", "wolf", "bus"]], "word string")
    m = {r["token"]: r["lemma"] for r in C.lemma_map(toks, lex).collect()}
    assert m == {"markets": "market", "glasses": "glass", "women": "woman", "wolves": "wolf"}


def test_rules_begin_with_a_character_that_is_looked_up():
    """A rule that begins otherwise is tried at every character of a text (ten times the time)."""
    for pattern, _ in T.SPARK_TOKEN_RULES:
        first = pattern.removeprefix("(?i)").removeprefix("(")
        assert not first.startswith("?") and (first[0] in "[\\'" or first.startswith("--"))
        assert all(ord(c) < 256 for c in pattern)


def test_rules_agree_with_look_around_on_mixed_texts(spark):
    """The same rules in fewer passes, as slow as they are plain."""
    import random
    plain = ((T.EXOTIC_WS, " "), (T._PUNCT + r"|\.{2,}", " $0 "), (r"([:,])([^0-9])", " $1 $2"), (r"([^.\s])\.('*)(\s)", "$1 . $2$3"), (r"--", " $0 "),
             (r"(?i)(?<=[^'\s])('(?=\s)|(?:" + "|".join(T.CLITICS) + r")(?=\s))", " $1"),
             (r"(?i)(?<=\s)(" + "|".join(f"{h}(?={t}\\s)" for h, t in T.FUSED_WORDS) + ")", "$1 "))
    r = random.Random(5)
    parts = [*"aNnTtsDlrem''...  ,,:09-\n\t\x0b\x1f\x85\xa0\u1680\u2003\u3000«“‘„”’\"`;@[(}é😀", "cannot", "GONNA", "n't", "'ll", "...", "don't", "'s"]
    df = spark.createDataFrame([("".join(r.choice(parts) for _ in range(r.randint(0, 30))),) for _ in range(5000)], "text string")
    x = F.concat(F.lit(" "), "text", F.lit(" "))
    for pattern, put in plain:
        x = F.regexp_replace(x, pattern, put)
    lower = F.filter(F.split(F.lower(x), r"\s+"), lambda t: F.length(t) > 0)
    alnum = F.filter(lower, lambda t: t.rlike(r"^[\p{L}\p{N}]+$"))
    got = df.select("text", T.lower_tokens("text").alias("a"), lower.alias("b"), T.filter_alnum(T.lower_tokens("text")).alias("c"), alnum.alias("d"))
    assert [r["text"] for r in got.collect() if r["a"] != r["b"] or r["c"] != r["d"]] == []


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_lemmas_are_joined_not_sent_to_python(spark):
    docs = spark.createDataFrame([(1, ["cats", "cats", "dog"]), (1, ["dogs"]), (None, ["cats"]), (2, []), (3, None)], "doc_id long, tokens array<string>")
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "token string, lemma string")
    out = C.lemmatize_arrays(docs, lemmas)
    assert "Python" not in _plan(out)
    want = [(1, ["cat", "cat", "dog"]), (1, ["dog"]), (2, []), (3, None), (None, ["cat"])]
    assert sorted(((r["doc_id"], r["tokens"]) for r in out.collect()), key=str) == sorted(want, key=str)
    long = docs.select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    got = C.replace_lemmas(long, lemmas)
    assert got.columns == long.columns and "Python" not in _plan(got)
    assert sorted(r["token"] for r in got.collect()) == ["cat", "cat", "cat", "dog", "dog"]


def test_lexicon_counts_documents_without_their_pairs(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (None, "c"), (None, "c"), (None, "d"), (3, "d")]
    long = spark.createDataFrame(rows, "doc_id long, token string")
    lexicon = C.corpus_lexicon(long)
    assert {r["word"] for r in lexicon.collect()} == {"b", "d"}
    assert _plan(lexicon).count("Exchange") == 1 or "doc_id, token" not in _plan(lexicon)
    text_ids = long.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {r["word"] for r in C.corpus_lexicon(text_ids).collect()} == {"b", "d"}


def test_clean_tokens_in_fewer_passes_gives_the_steps_tokens(spark):
    """T1-T4 as a whole against the steps one by one."""
    import random
    draw = random.Random(7)
    parts = ["a", "N", "n", "'", "'", ".", ".", ",", ",", ":", " ", " ", "-", "5", '"', "`", "can", "not", "'s", "n't", "\n", "\x0b",
             "“", "’", "é", "İ", "…", ";", "gim", "me", "\xa0", "　", "it's", "don't", "$", "the", "²", "ß"]
    rows = [("".join(draw.choice(parts) for _ in range(draw.randint(0, 50))),) for _ in range(3000)] + [(None,), ("",)] + [(t,) for t in CASES.values()]
    d = spark.createDataFrame(rows, "text string")
    steps = T.filter_alnum(T.remove_stopwords(T.lower_tokens("text")))
    assert d.where(~steps.eqNullSafe(T.clean_tokens("text"))).count() == 0
    assert len(T.CLEAN_RULES) + 2 < len(T.SPARK_TOKEN_RULES) + 3  # passes over a text, with the splitting


def test_vocabulary_is_fitted_without_writing_every_token(spark):
    """The distinct tokens of a split are enough; ids may repeat, be null or be in no split."""
    from quill.operators import prepare as P
    from quill.operators import vectorize as V
    docs = spark.createDataFrame([(i, f"cats cat word{i % 7} dogs", "x") for i in range(40)] + [(3, "horses horse", "x"), (None, "lions", "x"), (50, "lions lion", "x")],
                                 "doc_id long, text string, label string")
    p = P.prepare(docs)
    got = sorted(map(tuple, V.fit_vocabulary(p.words).collect()))
    assert "tokens" not in p.__dict__  # the long table is not made
    assert got == sorted(map(tuple, V.fit_vocabulary(p.tokens).collect()))
    long = C.explode_tokens(C.with_clean_tokens(docs), keep=())
    assert {r["word"] for r in C.corpus_lexicon(long).collect()} == {r["word"] for r in C.lexicon_of_ranges(p._types).collect()}


def test_rare_rules_are_applied_where_a_text_needs_them(spark):
    """Rules for few texts stand behind a byte search, and the text is bound once."""
    d = spark.createDataFrame([(t,) for t in ("don't  CANNOT", "a\u3000b \u201cc\u201d", "x--y gonna go", "plain", "caf\u00e9 can't", None)], "text string")
    steps = T.filter_alnum(T.remove_stopwords(T.lower_tokens("text")))
    assert d.where(~steps.eqNullSafe(T.clean_tokens("text"))).count() == 0
    plan = str(d.select(T.clean_tokens("text").alias("t"))._jdf.queryExecution().analyzed().toString())
    assert plan.count("regexp_replace") == len(T.CLEAN_RULES) + 2 and "contains" in plan


def test_lexicon_and_lemmas_take_one_pass(spark, monkeypatch):
    """F32: distinct tokens once, and only tokens with a suffix of the rules meet the map."""
    docs = spark.createDataFrame([(1, "cats cat women"), (2, "cat cats dogs woman"), (3, "dogs women"), (3, "woman cats"), (None, "dog")], "doc_id long, text string")
    seen = []
    own = C.may_change
    monkeypatch.setattr(C, "may_change", lambda t: seen.append(1) or own(t))
    monkeypatch.setattr(C, "corpus_lexicon", lambda *a: 1 / 0)
    got = sorted((r["doc_id"] or 0, r["processed_content"]) for r in C.clean_corpus(docs).collect())
    assert got == [(0, "dog"), (1, "cat cat woman"), (2, "cat cat dogs woman"), (3, "dogs woman"), (3, "woman cat")]
    assert len(seen) == 2
