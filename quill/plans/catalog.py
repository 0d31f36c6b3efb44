"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
over the whole given tables.  ``ORACLE`` holds the DuckDB SQL twin of each
deterministic key (same column names and types)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.functions import text as T
from quill.operators import clean as C
from quill.operators import sentences as N
from quill.operators import split as S
from quill.plans import sqlparts as Q
from quill.sources import tables as src

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _joined(col) -> F.Column:
    return F.array_join(col, " ")


# ----------------------------------------------------------------- text

@query("tokenize", Q.with_(Q.docs()) +
       f"SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, array_to_string(tk, ' ') AS tokens_text "
       f"FROM (SELECT doc_id, {T.tokenize_sql('text')} AS tk FROM docs)")
def q_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    d = src.documents_corpus(spark, sf).select("doc_id", T.tokenize("text").alias("tk"))
    return d.select("doc_id", F.size("tk").cast("long").alias("n_tokens"), _joined("tk").alias("tokens_text"))


@query("abbreviations", Q.with_(Q.docs(), N.abbreviations_sql()) + "SELECT word, n, n_period, score, is_abbreviation FROM ab")
def q_abbreviations(spark, sf):
    return N.abbreviations(src.documents_corpus(spark, sf))


@query("tokenize_abbreviated", Q.with_(Q.docs(), N.abbreviations_sql(), N.protected_sql()) +
       f"SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, replace(array_to_string(tk, ' '), '{N.MARK}', '.') AS tokens_text "
       f"FROM (SELECT doc_id, {T.tokenize_sql('text')} AS tk FROM pr)")
def q_tokenize_abbreviated(spark, sf):
    from quill.session import materialize
    docs = src.documents_corpus(spark, sf).select("doc_id", "text")
    d = N.tokenize(docs, materialize(N.abbreviations(docs).where("is_abbreviation")))
    return d.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), _joined("tokens").alias("tokens_text"))


@query("normalize_case", Q.with_(Q.docs()) +
       f"SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, array_to_string(tk, ' ') AS tokens_text "
       f"FROM (SELECT doc_id, list_transform({T.tokenize_sql('text')}, lambda t: lower(t)) AS tk FROM docs)")
def q_normalize_case(spark, sf):
    d = src.documents_corpus(spark, sf).select("doc_id", T.normalize_case(T.tokenize("text")).alias("tk"))
    return d.select("doc_id", F.size("tk").cast("long").alias("n_tokens"), _joined("tk").alias("tokens_text"))


@query("remove_stopwords", Q.with_(Q.docs()) +
       f"SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, array_to_string(tk, ' ') AS tokens_text "
       f"FROM (SELECT doc_id, {T.remove_stopwords_sql(T.lower_tokens_sql('text'))} AS tk FROM docs)")
def q_remove_stopwords(spark, sf):
    d = src.documents_corpus(spark, sf).select("doc_id", T.remove_stopwords(T.lower_tokens("text")).alias("tk"))
    return d.select("doc_id", F.size("tk").cast("long").alias("n_tokens"), _joined("tk").alias("tokens_text"))


@query("filter_alnum", Q.with_(Q.docs()) +
       f"SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, array_to_string(tk, ' ') AS tokens_text "
       f"FROM (SELECT doc_id, {T.clean_tokens_sql('text')} AS tk FROM docs)")
def q_filter_alnum(spark, sf):
    d = src.documents_corpus(spark, sf).select("doc_id", T.clean_tokens("text").alias("tk"))
    return d.select("doc_id", F.size("tk").cast("long").alias("n_tokens"), _joined("tk").alias("tokens_text"))


@query("lemmatize", Q.with_(Q.docs(), Q.clean_arrays(), Q.long_tokens(), Q.lexicon(), Q.lemma_map()) +
       "SELECT token, lemma FROM lm")
def q_lemmatize(spark, sf):
    from quill.session import materialize
    toks = C.explode_tokens(materialize(C.with_clean_tokens(src.documents_corpus(spark, sf)).select("doc_id", "tokens")))
    return C.lemma_map(toks.select("token"), C.corpus_lexicon(toks))


_CLEAN_SQL = Q.with_(*Q.full_clean()) + "SELECT doc_id, label, n_tokens, processed_content FROM cc"


@query("clean_text", _CLEAN_SQL)
def q_clean_text(spark, sf):
    cc = C.clean_corpus(src.documents_corpus(spark, sf))
    return cc.select("doc_id", "label", F.size("tokens").cast("long").alias("n_tokens"), "processed_content")


@query("drop_empty_docs", _CLEAN_SQL + " WHERE n_tokens > 0")
def q_drop_empty_docs(spark, sf):
    cc = C.clean_corpus(src.documents_corpus(spark, sf), keep_empty=False)
    return cc.select("doc_id", "label", F.size("tokens").cast("long").alias("n_tokens"), "processed_content")


@query("multi_corpus_clean", Q.with_(
    Q.docs("d1"), Q.conv_docs("d2"),
    "docs AS (SELECT 'documents' AS corpus, doc_id, text, label FROM d1 "
    "UNION ALL SELECT 'conversations' AS corpus, doc_id, text, label FROM d2)",
    f"ct AS (SELECT corpus, doc_id, label, {T.clean_tokens_sql('text')} AS tokens FROM docs)",
    "tl AS (SELECT corpus, doc_id, label, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM ct)",
    "lex AS (SELECT token AS word FROM (SELECT DISTINCT corpus, doc_id, token FROM tl) GROUP BY token HAVING count(*) >= 2)",
    Q.lemma_map(),
    "tll AS (SELECT t.corpus, t.doc_id, t.pos, coalesce(m.lemma, t.token) AS token FROM tl t LEFT JOIN lm m ON t.token = m.token)") +
    "SELECT a.corpus, a.doc_id, a.label, coalesce(string_agg(t.token, ' ' ORDER BY t.pos), '') AS processed_content "
    "FROM ct a LEFT JOIN tll t ON a.corpus = t.corpus AND a.doc_id = t.doc_id GROUP BY a.corpus, a.doc_id, a.label")
def q_multi_corpus_clean(spark, sf):
    d1 = src.documents_corpus(spark, sf).withColumn("corpus", F.lit("documents"))
    d2 = src.conversations_corpus(spark, sf).drop("conv_id").withColumn("corpus", F.lit("conversations"))
    both = d1.unionByName(d2)
    # one job over all corpora; inside it the key is 2 * doc_id, and 1 more for conversations
    # (a number, so that the lexicon needs no distinct pairs of document and token)
    own = F.coalesce("doc_id", F.raise_error(F.lit("doc_id is null")).cast("long"))
    keyed = both.select((own * 2 + (F.col("corpus") == "conversations").cast("long")).alias("doc_id"), "text", "label")
    cc = C.clean_corpus(keyed)
    corpus = F.when(F.pmod("doc_id", F.lit(2)) == 1, "conversations").otherwise("documents")
    return cc.select(corpus.alias("corpus"), F.shiftright("doc_id", 1).alias("doc_id"), "label", "processed_content")


# ----------------------------------------------------------------- sources

@query("csv_round_trip", "SELECT CAST(doc_id AS BIGINT) AS doc_id, nullif(CAST(text AS VARCHAR), '') AS text, nullif(CAST(lang AS VARCHAR), '') AS lang FROM documents")
def q_csv_round_trip(spark, sf):
    """The documents written as CSV with quoted line breaks and read again by ranges."""
    from quill.session import table_path
    from quill.sources import files as FS
    path = table_path(spark)
    FS.write_csv(src.table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return FS.read_csv_parallel(spark, path, "doc_id long, text string, lang string")


# ----------------------------------------------------------------- split

def _nonempty(spark, sf, label="lang"):
    from quill.session import materialize  # ids and labels, written once: later steps never touch a text
    return materialize(C.nonempty_docs(src.documents_corpus(spark, sf, label)).select("doc_id", "label"))


@query("class_distribution", Q.with_(Q.docs(), Q.clean_arrays(), Q.nonempty()) +
       "SELECT label, CAST(count(*) AS BIGINT) AS n FROM ne GROUP BY label")
def q_class_distribution(spark, sf):
    return S.class_distribution(_nonempty(spark, sf))


@query("rare_class_collapse", Q.with_(Q.docs(label="size_bucket"), Q.clean_arrays(), Q.nonempty(),
                                      Q.collapse("rc", "ne", "coalesce(label, '__null__')", 3, "Other_Rare", "stratum")) +
       "SELECT doc_id, label, stratum FROM rc")
def q_rare_class_collapse(spark, sf):
    return S.collapse_rare(_nonempty(spark, sf, "size_bucket")).select("doc_id", "label", "stratum")


@query("split_feasibility", Q.with_(Q.docs(label="size_bucket"), Q.clean_arrays(), Q.nonempty(),
                                    Q.collapse("rc", "ne", "coalesce(label, '__null__')", 3, "Other_Rare", "stratum"),
                                    Q._quota("qt", "rc", "stratum", 0.2)) +
       "SELECT CAST(sum(n_c) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_strata, "
       "CAST(min(n_c) AS BIGINT) AS min_stratum, "
       "CAST(coalesce(sum(CASE WHEN stratum = 'Other_Rare' THEN n_c END), 0) AS BIGINT) AS n_rare_rows, "
       "bool_and(feasible) AS stratified, CAST(min(n_first) AS BIGINT) AS n_train FROM qt")
def q_split_feasibility(spark, sf):
    return S.split_feasibility(_nonempty(spark, sf, "size_bucket"))


_SPLIT_SQL = Q.with_(Q.docs(), Q.clean_arrays(), Q.nonempty(), *Q.splits()) + \
    "SELECT doc_id, label, split FROM splits"


@query("stratified_split", _SPLIT_SQL)
def q_stratified_split(spark, sf):
    return S.stratified_split(_nonempty(spark, sf)).select("doc_id", "label", "split")


@query("stratified_split_rare", Q.with_(Q.docs(label="size_bucket"), Q.clean_arrays(), Q.nonempty(), *Q.splits()) +
       "SELECT doc_id, label, stratum, split FROM splits")
def q_stratified_split_rare(spark, sf):
    return S.stratified_split(_nonempty(spark, sf, "size_bucket")).select("doc_id", "label", "stratum", "split")


@query("random_split", Q.with_(Q.docs(), Q.clean_arrays(), Q.nonempty(), *Q.splits(stratify=False)) +
       "SELECT doc_id, label, split FROM splits")
def q_random_split(spark, sf):
    return S.random_split(_nonempty(spark, sf)).select("doc_id", "label", "split")


@query("split_sizes", Q.with_(Q.docs(), Q.clean_arrays(), Q.nonempty(), *Q.splits()) +
       "SELECT split, CAST(count(*) AS BIGINT) AS n FROM splits GROUP BY split")
def q_split_sizes(spark, sf):
    return S.split_sizes(S.stratified_split(_nonempty(spark, sf)))


@query("presplit_union", Q.with_(Q.conv_docs(), Q.clean_arrays("cct", "cdocs"),
                                 "cne AS (SELECT c.doc_id, c.conv_id, c.label FROM cdocs c JOIN cct USING (doc_id) WHERE len(cct.tokens) > 0)",
                                 Q.presplit("ps", "cne", "conv_id")) +
       "SELECT doc_id, conv_id, label, split FROM ps")
def q_presplit_union(spark, sf):
    c = C.nonempty_docs(src.conversations_corpus(spark, sf))
    return S.presplit(c, "conv_id").select("doc_id", "conv_id", "label", "split")


# ----------------------------------------------------------------- vocabulary and bag of words

from quill.operators import labels as L  # noqa: E402
from quill.operators import prepare as P  # noqa: E402
from quill.operators import vectorize as V  # noqa: E402


def prepared_documents(spark, sf, label="lang") -> P.Prepared:
    return P.prepare(src.documents_corpus(spark, sf, label))


def prepared_conversations(spark, sf) -> P.Prepared:
    c = src.conversations_corpus(spark, sf)
    return P.prepare(c.select("doc_id", "text", "label"), splits=S.presplit(c.select("doc_id", "conv_id"), "conv_id"))


_PREP = Q.prepared()


@query("fit_vocabulary", Q.with_(*_PREP, Q.vocab()) + "SELECT token, token_id FROM voc")
def q_fit_vocabulary(spark, sf):
    return V.fit_vocabulary(prepared_documents(spark, sf).words)


@query("vocab_json", Q.with_(*_PREP, Q.vocab()) +
       "SELECT CAST(json_object('token', token, 'token_id', token_id) AS VARCHAR) AS json FROM voc")
def q_vocab_json(spark, sf):
    return V.vocab_json_lines(V.fit_vocabulary(prepared_documents(spark, sf).words))


@query("bow_train", Q.with_(*_PREP, Q.vocab(), Q.bow()) +
       "SELECT doc_id, token_id, cnt FROM bow WHERE split = 'train'")
def q_bow_train(spark, sf):
    p = prepared_documents(spark, sf)
    toks = p.rows.where(F.col("split") == "train")
    return V.term_counts(toks, V.fit_vocabulary(p.words)).select("doc_id", "token_id", "cnt")


@query("bow_transform", Q.with_(*_PREP, Q.vocab(), Q.bow()) +
       "SELECT doc_id, split, token_id, cnt FROM bow WHERE split <> 'train'")
def q_bow_transform(spark, sf):
    p = prepared_documents(spark, sf)
    toks = p.rows.where(F.col("split") != "train")
    return V.term_counts(toks, V.fit_vocabulary(p.words)).select("doc_id", "split", "token_id", "cnt")


@query("bow_vector_stats", Q.with_(*_PREP, Q.vocab(), Q.bow()) +
       "SELECT doc_id, CAST(count(*) AS BIGINT) AS nnz, CAST(sum(cnt) AS BIGINT) AS total, "
       "CAST(max(token_id) AS BIGINT) AS max_index FROM bow GROUP BY doc_id")
def q_bow_vector_stats(spark, sf):
    p = prepared_documents(spark, sf)
    return V.bow_vector_stats(V.term_counts(p.rows, V.fit_vocabulary(p.words)))


# ----------------------------------------------------------------- labels

_PREP_C = Q.prepared_conversations()


@query("label_map", Q.with_(*_PREP_C, Q.label_map()) + "SELECT label_id, label FROM lmap")
def q_label_map(spark, sf):
    p = prepared_conversations(spark, sf)
    return L.fit_label_map(p.docs.where(F.col("split") == "train"))


@query("encode_labels", Q.with_(*_PREP_C, Q.label_map()) +
       "SELECT p.doc_id, p.split, p.label, m.label_id FROM pd p JOIN lmap m ON p.label = m.label")
def q_encode_labels(spark, sf):
    p = prepared_conversations(spark, sf)
    m = L.fit_label_map(p.docs.where(F.col("split") == "train"))
    return L.encode_labels(p.docs, m).select("doc_id", "split", "label", "label_id")


@query("unseen_labels", Q.with_(*_PREP_C, Q.label_map()) +
       "SELECT DISTINCT label FROM pd WHERE split <> 'train' AND label NOT IN (SELECT label FROM lmap)")
def q_unseen_labels(spark, sf):
    p = prepared_conversations(spark, sf)
    m = L.fit_label_map(p.docs.where(F.col("split") == "train"))
    return L.unseen_labels(p.docs.where(F.col("split") != "train"), m)


# ----------------------------------------------------------------- balancing

from quill.operators import balance as B  # noqa: E402
from quill.operators import knn as KNN  # noqa: E402


def _train_docs(spark, sf, label="lang"):
    return S.stratified_split(_nonempty(spark, sf, label)).where(F.col("split") == "train").select("doc_id", "label")


_PREP_TRAIN = [*_PREP, "tdocs AS (SELECT doc_id, label FROM pd WHERE split = 'train')"]


@query("oversample_targets", Q.with_(*_PREP_TRAIN, Q.targets("tg", "tdocs")) +
       "SELECT label, n, target, deficit FROM tg")
def q_oversample_targets(spark, sf):
    return B.class_targets(_train_docs(spark, sf)).select("label", "n", "target", "deficit")


_STRATEGIES_SQL = (
    "st AS (SELECT label, CAST(count(*) AS BIGINT) AS n FROM tdocs GROUP BY label), "
    "sr AS (SELECT label, n, max(n) OVER () AS most, row_number() OVER (ORDER BY n, label) = 1 AS least FROM st), "
    "sa AS (SELECT 'auto' AS strategy, label, n, most AS target FROM sr "
    "UNION ALL SELECT 'minority', label, n, CASE WHEN least THEN most ELSE n END FROM sr "
    "UNION ALL SELECT 'not minority', label, n, CASE WHEN least THEN n ELSE most END FROM sr "
    "UNION ALL SELECT 'explicit', label, n, n + most FROM sr)")


@query("oversample_strategies", Q.with_(*_PREP_TRAIN, _STRATEGIES_SQL, "bt AS (SELECT strategy, label, n, target FROM sa)") +
       "SELECT strategy, label, n, target, target - n AS n_copies FROM bt")
def q_oversample_strategies(spark, sf):
    """Rows and copies of each class after oversampling by each strategy;
    the explicit targets are the class size plus that of the largest class."""
    from functools import reduce
    from quill.session import materialize
    docs = materialize(_train_docs(spark, sf))
    asked = B.class_targets(docs).select("label", (F.col("n") + F.col("target")).alias("target"))
    out = []
    for name in ("auto", "minority", "not minority", asked):
        done = B.random_oversample(docs, strategy=name).groupBy("label").agg(
            F.sum((~F.col("is_copy")).cast("long")).alias("n"), F.count(F.lit(1)).alias("target"),
            F.sum(F.col("is_copy").cast("long")).alias("n_copies"))
        out.append(done.select(F.lit(name if isinstance(name, str) else "explicit").alias("strategy"), "label", "n", "target", "n_copies"))
    return reduce(DataFrame.unionByName, out)


@query("random_oversample", Q.with_(*_PREP_TRAIN, *Q.ros("ros", "tdocs")) +
       "SELECT out_id, doc_id, label, is_copy FROM ros")
def q_random_oversample(spark, sf):
    return B.random_oversample(_train_docs(spark, sf))


@query("balanced_distribution", Q.with_(*_PREP_TRAIN, *Q.ros("ros", "tdocs")) +
       "SELECT label, CAST(count(*) AS BIGINT) AS n FROM ros GROUP BY label")
def q_balanced_distribution(spark, sf):
    return S.class_distribution(B.random_oversample(_train_docs(spark, sf)))


@query("smote_k", Q.with_(*_PREP_TRAIN) +
       "SELECT CAST(min(n) AS BIGINT) AS min_class, CAST(least(5, min(n) - 1) AS BIGINT) AS k, "
       "CASE WHEN min(n) < 2 THEN 'ros' ELSE 'smote' END AS method FROM (SELECT count(*) AS n FROM tdocs GROUP BY label)")
def q_smote_k(spark, sf):
    return B.smote_k(_train_docs(spark, sf))


_PREP_RARE_TRAIN = [*Q.prepared("size_bucket"), "tdocs AS (SELECT doc_id, label FROM pd WHERE split = 'train')"]


@query("balance_fallback", Q.with_(*_PREP_RARE_TRAIN, *Q.ros("ros", "tdocs")) +
       "SELECT label, CAST(count(*) AS BIGINT) AS n, "
       "(SELECT CASE WHEN min(n) < 2 THEN 'ros' ELSE 'smote' END FROM (SELECT count(*) AS n FROM tdocs GROUP BY label)) AS method "
       "FROM ros GROUP BY label")
def q_balance_fallback(spark, sf):
    """``balance`` itself, on one feature a document: whichever way it takes, a
    class rises to its target."""
    docs = _train_docs(spark, sf, "size_bucket")
    sizes = src.table(spark, sf, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.array(F.coalesce(F.col("n_chars"), F.lit(0)).cast("double")).alias("features"))
    method = B.smote_k(docs).select("method").first()["method"]  # scalar, as balance reads it
    return S.class_distribution(B.balance(docs, sizes, "smote")).withColumn("method", F.lit(method))


_EMB_K = Q.smote_k("pts")


@query("knn_within_class", Q.with_(Q.emb_points(), "allq AS (SELECT doc_id FROM pts)",
                                   Q.knn_dense("nn", "pts", "allq", "5")) +
       "SELECT query_id, neighbor_id, rank, round(dist, 6) AS dist FROM nn")
def q_knn_within_class(spark, sf):
    pts = src.embeddings_table(spark, sf)
    nn = KNN.knn_dense(pts, pts.select("doc_id", "label"), 5)
    return nn.select("query_id", "neighbor_id", "rank", F.round("dist", 6).alias("dist"))


_SMOTE_DENSE = [Q.emb_points(), *Q.smote_draws("sd", "pts", _EMB_K),
                "sq AS (SELECT DISTINCT base_id AS doc_id FROM sd)",
                Q.knn_dense("nn", "pts", "sq", _EMB_K),
                "sm AS (SELECT d.out_id, d.label, d.base_id, n.neighbor_id, d.gap FROM sd d JOIN nn n "
                "ON n.query_id = d.base_id AND n.rank = d.nn_rank)"]


@query("smote_draws", Q.with_(*_SMOTE_DENSE) +
       "SELECT out_id, label, base_id, neighbor_id, round(gap, 9) AS gap FROM sm")
def q_smote_draws(spark, sf):
    s = B.smote_dense(src.embeddings_table(spark, sf)).where("neighbor_id is not null")
    return s.select("out_id", "label", "base_id", "neighbor_id", F.round("gap", 9).alias("gap"))


@query("smote_dense", Q.with_(*_SMOTE_DENSE,
                              "sv AS (SELECT m.out_id, list_transform(range(1, len(b.f) + 1), "
                              "lambda i: b.f[i] + m.gap * (n.f[i] - b.f[i])) AS v FROM sm m "
                              "JOIN pts b ON b.doc_id = m.base_id JOIN pts n ON n.doc_id = m.neighbor_id "
                              "UNION ALL SELECT doc_id, f FROM pts)") +
       "SELECT out_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim, round(unnest(v), 6) AS value FROM sv")
def q_smote_dense(spark, sf):
    s = B.smote_dense(src.embeddings_table(spark, sf))
    return s.select("out_id", F.posexplode("features").alias("dim", "value")).select(
        "out_id", F.col("dim").cast("int"), F.round("value", 6).alias("value"))


_BOW_TRAIN = [*_PREP_TRAIN, Q.vocab(), Q.bow(), "tbow AS (SELECT doc_id, token_id, cnt FROM bow WHERE split = 'train')"]


@query("smote_bow", Q.with_(*_BOW_TRAIN, *Q.smote_bow()) +
       "SELECT out_id, label, token_id, cnt FROM syn WHERE cnt <> 0 "
       "UNION ALL SELECT d.doc_id, d.label, b.token_id, b.cnt FROM tdocs d JOIN tbow b ON b.doc_id = d.doc_id")
def q_smote_bow(spark, sf):
    p = prepared_documents(spark, sf)
    vocab = V.fit_vocabulary(p.words)
    train = p.rows.where(F.col("split") == "train")
    bow = V.term_counts(train, vocab)
    docs = p.docs.where(F.col("split") == "train").select("doc_id", "label")
    return B.balance(docs, bow, "smote").select("out_id", "label", "token_id", "cnt")


@query("features_with_labels", Q.with_(*_BOW_TRAIN) +
       "SELECT b.doc_id, d.label, b.token_id, b.cnt FROM tbow b JOIN tdocs d ON b.doc_id = d.doc_id")
def q_features_with_labels(spark, sf):
    p = prepared_documents(spark, sf)
    bow = V.term_counts(p.rows.where(F.col("split") == "train"), V.fit_vocabulary(p.words), keep=())
    labels = p.docs.where(F.col("split") == "train").select("doc_id", "label")
    return bow.join(labels, on="doc_id", how="inner").select("doc_id", "label", "token_id", "cnt")


# ----------------------------------------------------------------- sub-word sequences

from quill.operators import wordpiece as WP  # noqa: E402


def _sequences(p: P.Prepared) -> DataFrame:
    vocab = WP.build_piece_vocab(p.tokens.where(F.col("split") == "train"))
    head = WP.sequence_tokens(p.tokens)
    return WP.encode_sequences(head, WP.encode_words(head, vocab))


def _ints(c) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), " ")


_WP = Q.with_(*_PREP, *Q.wordpiece()).replace("WITH ", "WITH RECURSIVE ", 1)


@query("wordpiece_encode", _WP + "SELECT token, array_to_string(piece_ids, ' ') AS piece_ids FROM wp_enc")
def q_wordpiece_encode(spark, sf):
    p = prepared_documents(spark, sf)
    vocab = WP.build_piece_vocab(p.rows.where(F.col("split") == "train"))
    return WP.encode_words(p.words, vocab).select("token", _ints("piece_ids").alias("piece_ids"))


_SEQ = Q.with_(*_PREP, *Q.wordpiece(), *Q.sequences()).replace("WITH ", "WITH RECURSIVE ", 1)


@query("encode_sequences", _SEQ + "SELECT doc_id, split, n_real, input_ids, attention_mask FROM seq")
def q_encode_sequences(spark, sf):
    s = _sequences(prepared_documents(spark, sf))
    return s.select("doc_id", "split", "n_real", _ints("input_ids").alias("input_ids"),
                    _ints("attention_mask").alias("attention_mask"))


@query("oversampled_sequences", Q.with_(*_PREP_TRAIN, *Q.ros("ros", "tdocs"), *Q.wordpiece(), *Q.sequences()
                                        ).replace("WITH ", "WITH RECURSIVE ", 1) +
       "SELECT r.out_id, r.doc_id, r.label, s.input_ids, s.attention_mask FROM ros r JOIN seq s ON s.doc_id = r.doc_id")
def q_oversampled_sequences(spark, sf):
    p = prepared_documents(spark, sf)
    s = _sequences(p)
    draws = B.random_oversample(p.docs.where(F.col("split") == "train").select("doc_id", "label"))
    return draws.join(s.select("doc_id", "input_ids", "attention_mask"), on="doc_id", how="inner").select(
        "out_id", "doc_id", "label", _ints("input_ids").alias("input_ids"), _ints("attention_mask").alias("attention_mask"))


# ----------------------------------------------------------------- classifier

from quill.operators import classify as CL  # noqa: E402


def _classifier(spark, sf):
    pts = src.embeddings_table(spark, sf)
    sp = S.stratified_split(pts.select("doc_id", "label"))
    ep = pts.join(sp.select("doc_id", "split"), on="doc_id")
    lmap = L.fit_label_map(ep.where(F.col("split") == "train"))
    head = CL.fit_centroid_head(ep.where(F.col("split") == "train"), lmap)
    test = L.encode_labels(ep.where(F.col("split") == "test"), lmap)
    pred = CL.argmax_predict(CL.head_logits(test, head))
    return pred, lmap


_CLS = Q.with_(*Q.classifier())


@query("head_logits", _CLS + "SELECT doc_id, CAST(class_id AS INTEGER) AS class_id, round(logit, 6) AS logit FROM lg")
def q_head_logits(spark, sf):
    pred, _ = _classifier(spark, sf)
    return pred.select("doc_id", F.posexplode("logits").alias("class_id", "logit")).select(
        "doc_id", F.col("class_id").cast("int"), F.round("logit", 6).alias("logit"))


@query("argmax_predict", _CLS + "SELECT doc_id, label_id, CAST(pred_id AS INTEGER) AS pred_id FROM pr")
def q_argmax_predict(spark, sf):
    pred, _ = _classifier(spark, sf)
    return pred.select("doc_id", "label_id", "pred_id")


@query("accuracy", _CLS + "SELECT round(avg(CASE WHEN pred_id = label_id THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pr")
def q_accuracy(spark, sf):
    pred, _ = _classifier(spark, sf)
    return CL.accuracy(pred).select(F.round("accuracy", 6).alias("accuracy"))


@query("weighted_metrics", _CLS +
       "SELECT round(sum(precision * support) / sum(support), 6) AS precision, "
       "round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1, "
       "round(sum(tp) / sum(support), 6) AS accuracy FROM sc")
def q_weighted_metrics(spark, sf):
    pred, _ = _classifier(spark, sf)
    m = CL.weighted_metrics(pred)
    return m.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("classification_report", _CLS +
       "SELECT coalesce(m.label, CAST(s.label_id AS VARCHAR)) AS \"row\", round(precision, 6) AS precision, "
       "round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM sc s LEFT JOIN lmap m USING (label_id) "
       "UNION ALL SELECT 'accuracy', NULL, NULL, round(avg(CASE WHEN pred_id = label_id THEN 1.0 ELSE 0.0 END), 6), CAST(count(*) AS BIGINT) FROM pr "
       "UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM sc "
       "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), "
       "round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM sc")
def q_classification_report(spark, sf):
    pred, lmap = _classifier(spark, sf)
    r = CL.classification_report(pred, lmap)
    return r.select("row", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("cross_entropy", _CLS +
       "SELECT round(avg(lse - zl), 6) AS cross_entropy FROM (SELECT doc_id, max(mx) + ln(sum(exp(logit - mx))) AS lse, "
       "max(CASE WHEN class_id = true_id THEN logit END) AS zl FROM (SELECT *, max(logit) OVER (PARTITION BY doc_id) AS mx FROM lg) "
       "GROUP BY doc_id)")
def q_cross_entropy(spark, sf):
    pred, _ = _classifier(spark, sf)
    return CL.cross_entropy(pred).select(F.round("cross_entropy", 6).alias("cross_entropy"))


@query("train_head")
def q_train_head(spark, sf):
    """C1-C2 (rows only): softmax head fitted with distributed L-BFGS on the
    oversampled train rows, then test predictions with the same metrics as the
    centroid head."""
    pts = src.embeddings_table(spark, sf)
    sp = S.stratified_split(pts.select("doc_id", "label"))
    ep = pts.join(sp.select("doc_id", "split"), on="doc_id")
    train = ep.where(F.col("split") == "train")
    lmap = L.fit_label_map(train)
    balanced = B.balance(train, train.select("doc_id", "features"), "ros").withColumnRenamed("out_id", "doc_id")
    head = CL.fit_softmax_head(balanced, lmap)
    test = L.encode_labels(ep.where(F.col("split") == "test"), lmap)
    pred = CL.argmax_predict(CL.head_logits(test, head))
    return pred.select("doc_id", "label_id", "pred_id")


from quill.operators import head as HD  # noqa: E402
from quill.sources.versions import Versions  # noqa: E402


def _head_rows(spark, sf):
    """Labelled rows of each split."""
    pts = src.embeddings_table(spark, sf)
    sp = S.stratified_split(pts.select("doc_id", "label"))
    ep = pts.join(sp.select("doc_id", "split"), on="doc_id")
    lmap = L.fit_label_map(ep.where(F.col("split") == "train"))
    return ep, lmap, lambda rows: L.encode_labels(rows, lmap)


def _head_fit(spark, sf):
    """C2/C3 as in the reference: 3 epochs, batches of 16, on oversampled train rows."""
    ep, lmap, encoded = _head_rows(spark, sf)
    train = ep.where(F.col("split") == "train")
    balanced = B.balance(train, train.select("doc_id", "features"), "ros").withColumnRenamed("out_id", "doc_id")
    kept, log = HD.fit(encoded(balanced), encoded(ep.where(F.col("split") == "val")), lmap.count())
    return kept, log, encoded(ep.where(F.col("split") == "test"))


@query("classifier_log")
def q_classifier_log(spark, sf):
    """C2/A13 (rows only): loss and accuracies of each epoch."""
    return _head_fit(spark, sf)[1]


@query("classifier_best")
def q_classifier_best(spark, sf):
    """C3 (rows only): test predictions by the epoch with the best validation accuracy."""
    kept, log, test = _head_fit(spark, sf)
    epoch, head = HD.best(kept, log)
    return CL.argmax_predict(CL.head_logits(test, head)).select("doc_id", "label_id", "pred_id", F.lit(epoch).alias("epoch"))


_STEP_LR = 0.01


@query("classifier_full_batch", Q.with_(*Q.classifier(), *Q.full_batch_epoch(_STEP_LR)) +
       "SELECT CAST(label_id AS INTEGER) AS label_id, CAST(dim AS INTEGER) AS dim, round(weight, 6) AS weight, round(loss, 6) AS loss, "
       "round(train_accuracy, 6) AS train_accuracy, round(val_accuracy, 6) AS val_accuracy FROM fb_w, fb_log")
def q_classifier_full_batch(spark, sf):
    """C2/C3/A13 of one epoch in one batch: the weights (dim -1: bias) and the log."""
    ep, lmap, encoded = _head_rows(spark, sf)
    train = encoded(ep.where(F.col("split") == "train"))
    kept, log = HD.fit(train, encoded(ep.where(F.col("split") == "val")), lmap.count(), epochs=1, batch_size=max(1, train.count()), lr=_STEP_LR)
    w = HD.head_of(kept.read("params", "epoch=0")).select("label_id", F.posexplode(F.concat(F.array("bias"), "weights")).alias("dim", "weight"))
    out = w.join(F.broadcast(log.drop("epoch", "batches")), F.lit(True))
    return out.select("label_id", (F.col("dim") - 1).alias("dim"), *[F.round(c, 6).alias(c) for c in ("weight", "loss", "train_accuracy", "val_accuracy")])


# ----------------------------------------------------------------- topic model

from quill.operators import coherence as CH  # noqa: E402
from quill.operators import topics as TM  # noqa: E402

TOPIC_H, TOPIC_K = 64, 40   # hidden width reduced from 500 for the SQL twin; 40 topics as in the reference


def _topic_setup(spark, sf):
    p = prepared_documents(spark, sf)
    vocab = V.fit_vocabulary(p.words)
    from quill.session import materialize
    vocab = materialize(vocab)
    n_vocab = vocab.count()  # scalar that sizes the model
    params = TM.init_params(spark, n_vocab, TOPIC_H, TOPIC_K)
    return p, vocab, params


def _val_bow(p, vocab):
    return V.term_counts(p.rows.where(F.col("split") == "val"), vocab, keep=()).select("doc_id", "token_id", "cnt")


_TOPIC = [*_PREP, Q.vocab(), *Q.topic_params(TOPIC_H, TOPIC_K)]
_TOPIC_FWD = [*_TOPIC, Q.bow(), "vb AS (SELECT doc_id, token_id, cnt FROM bow WHERE split = 'val')",
              *Q.topic_forward(TOPIC_H, TOPIC_K)]


@query("topic_word_matrix", Q.with_(*_TOPIC) +
       "SELECT CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS topic, CAST(r AS INTEGER) AS token_id, "
       "round(unnest(w), 9) AS weight FROM tp_dec")
def q_topic_word_matrix(spark, sf):
    _, _, params = _topic_setup(spark, sf)
    return TM.topic_word_matrix(params).select("topic", "token_id", F.round("weight", 9).alias("weight"))


@query("topic_top_words", Q.with_(*_TOPIC, Q.top_words(10)) + "SELECT topic, rank, token_id, token FROM tw")
def q_topic_top_words(spark, sf):
    _, vocab, params = _topic_setup(spark, sf)
    return TM.top_words(TM.topic_word_matrix(params), vocab, 10)


@query("topic_monitor", Q.with_(*_TOPIC, Q.top_words(8, 5)) + "SELECT topic, rank, token_id, token FROM tw")
def q_topic_monitor(spark, sf):
    _, vocab, params = _topic_setup(spark, sf)
    return TM.top_words(TM.topic_word_matrix(params), vocab, 8, n_topics=5)


@query("topic_report", Q.with_(*_TOPIC, Q.top_words(10)) +
       "SELECT topic, 'Topic ' || CAST(topic AS VARCHAR) || ': ' || string_agg(token, ' ' ORDER BY rank) AS line FROM tw GROUP BY topic")
def q_topic_report(spark, sf):
    _, vocab, params = _topic_setup(spark, sf)
    return TM.topic_report(TM.top_words(TM.topic_word_matrix(params), vocab, 10))


def _val_tokens(p):
    from quill.session import materialize
    # only these tokens are written, as they are read several times
    return materialize(p.rows.where(F.col("split") == "val").select("doc_id", "pos", "token"))


_CTX = "ctx AS (SELECT doc_id, pos, token FROM tll WHERE split = 'val')"


@query("sliding_window_counts", Q.with_(*_TOPIC, Q.top_words(10), _CTX, *Q.coherence()) +
       "SELECT doc_id, token, CAST(sum(hi - lo + 1) AS BIGINT) AS windows FROM ch_isl GROUP BY doc_id, token")
def q_sliding_window_counts(spark, sf):
    p, vocab, params = _topic_setup(spark, sf)
    top = TM.top_words(TM.topic_word_matrix(params), vocab, 10)
    ctx = _val_tokens(p)
    return CH.sliding_window_counts(ctx, top.select("token"))


@query("coherence_by_topic", Q.with_(*_TOPIC, Q.top_words(10), _CTX, *Q.coherence()) +
       "SELECT w.topic, round(c.coherence, 6) AS coherence, CAST(count(*) AS BIGINT) AS n_words, "
       "CAST(count(k.token) AS BIGINT) AS n_scored FROM tw w LEFT JOIN ch_coh c ON c.topic = w.topic "
       "LEFT JOIN ch_wc k ON k.token = w.token GROUP BY w.topic, c.coherence")
def q_coherence_by_topic(spark, sf):
    p, vocab, params = _topic_setup(spark, sf)
    top = TM.top_words(TM.topic_word_matrix(params), vocab, 10)
    ctx = _val_tokens(p)
    return CH.coherence_by_topic(top, ctx).withColumn("coherence", F.round("coherence", 6))


@query("coherence_cv", Q.with_(*_TOPIC, Q.top_words(10), _CTX, *Q.coherence()) +
       "SELECT round(avg(coherence), 6) AS coherence FROM ch_coh")
def q_coherence_cv(spark, sf):
    p, vocab, params = _topic_setup(spark, sf)
    top = TM.top_words(TM.topic_word_matrix(params), vocab, 10)
    ctx = _val_tokens(p)
    return CH.coherence_cv(top, ctx).select(F.round("coherence", 6).alias("coherence"))


@query("topic_encode", Q.with_(*_TOPIC_FWD) +
       "SELECT doc_id, CAST(generate_subscripts(mu, 1) - 1 AS INTEGER) AS dim, round(unnest(mu), 6) AS mu FROM tf_z")
def q_topic_encode(spark, sf):
    p, vocab, params = _topic_setup(spark, sf)
    e = TM.encode(_val_bow(p, vocab), params)
    return e.select("doc_id", F.posexplode("mu").alias("dim", "mu")).select(
        "doc_id", F.col("dim").cast("int"), F.round("mu", 6).alias("mu"))


@query("topic_word_logp", Q.with_(*_TOPIC_FWD) + "SELECT doc_id, token_id, round(logp, 6) AS logp FROM tf_lp")
def q_topic_word_logp(spark, sf):
    p, vocab, params = _topic_setup(spark, sf)
    lp = TM.word_logp(_val_bow(p, vocab), params)
    return lp.select("doc_id", "token_id", F.round("logp", 6).alias("logp"))


@query("elbo_loss", Q.with_(*_TOPIC_FWD,
                            "el_r AS (SELECT doc_id, -sum(cnt * logp) AS recon FROM tf_lp GROUP BY doc_id)",
                            "el_k AS (SELECT z.doc_id, -0.5 * list_sum(list_transform(range(1, len(z.mu) + 1), "
                            "lambda k: 1.0 + v.lv[k] - z.mu[k] * z.mu[k] - exp(v.lv[k]))) AS kl FROM tf_z z JOIN tf_v v ON v.doc_id = z.doc_id)") +
       "SELECT r.doc_id, round(r.recon, 4) AS recon, round(k.kl, 6) AS kl, round(r.recon + k.kl, 4) AS loss "
       "FROM el_r r JOIN el_k k ON k.doc_id = r.doc_id")
def q_elbo_loss(spark, sf):
    p, vocab, params = _topic_setup(spark, sf)
    e = TM.elbo(_val_bow(p, vocab), params)
    return e.select("doc_id", F.round("recon", 4).alias("recon"), F.round("kl", 6).alias("kl"),
                    F.round("loss", 4).alias("loss"))


# The three above are held to SQL on the validation split; these give every
# document of every split, those without a counted token too.

def _all_splits(spark, sf):
    p, vocab, params = _topic_setup(spark, sf)
    return p.docs.select("doc_id", "split"), V.term_counts(p.rows, vocab, keep=()), params


@query("topic_encode_splits")
def q_topic_encode_splits(spark, sf):
    """M1/M2 of every split, with logvar."""
    docs, bow, params = _all_splits(spark, sf)
    e = TM.encode(bow, params, docs).join(docs, on="doc_id")
    return e.select("doc_id", "split", F.posexplode(F.arrays_zip("mu", "logvar")).alias("dim", "x")).select(
        "doc_id", "split", F.col("dim").cast("int"), F.round("x.mu", 6).alias("mu"), F.round("x.logvar", 6).alias("logvar"))


@query("topic_word_logp_splits")
def q_topic_word_logp_splits(spark, sf):
    """M3 of every split (a row per counted token, so none of a document without one)."""
    docs, bow, params = _all_splits(spark, sf)
    lp = TM.word_logp(bow, params, docs).join(docs, on="doc_id")
    return lp.select("doc_id", "split", "token_id", F.round("logp", 6).alias("logp"))


def _elbo_splits(spark, sf):
    docs, bow, params = _all_splits(spark, sf)
    return TM.elbo(bow, params, docs).join(docs, on="doc_id")


@query("elbo_loss_splits")
def q_elbo_loss_splits(spark, sf):
    """A15 of every split; a document without a counted token has its KL term."""
    return _elbo_splits(spark, sf).select("doc_id", "split", F.round("recon", 4).alias("recon"),
                                          F.round("kl", 6).alias("kl"), F.round("loss", 4).alias("loss"))


@query("elbo_mean")
def q_elbo_mean(spark, sf):
    """A15 as the training log has it: means over the batches of 64 of the train split's first epoch."""
    from quill.session import materialize
    # written: the order of the batches and the means both read it
    e = materialize(_elbo_splits(spark, sf).where(F.col("split") == "train"))
    b = TM.minibatches(e.select("doc_id"), 0, FIT_BATCH)
    return TM.elbo_mean(e.join(b, on="doc_id").groupBy("batch"))


@query("perplexity", Q.with_(*_TOPIC_FWD) +
       "SELECT round(exp(sum(-cnt * logp) / sum(cnt)), 4) AS perplexity, CAST(sum(cnt) AS BIGINT) AS total_words FROM tf_lp")
def q_perplexity(spark, sf):
    p, vocab, params = _topic_setup(spark, sf)
    r = TM.perplexity(_val_bow(p, vocab), params)
    return r.select(F.round("perplexity", 4).alias("perplexity"), "total_words")


@query("minibatch_assign", Q.with_(*_PREP_TRAIN,
                                   "mb AS (SELECT doc_id, e AS epoch, CAST((row_number() OVER (PARTITION BY e ORDER BY "
                                   "md5(concat_ws(':', '42', 'epoch' || CAST(e AS VARCHAR), CAST(doc_id AS VARCHAR))), doc_id) - 1) // 64 AS BIGINT) AS batch "
                                   "FROM tdocs, (SELECT unnest([0, 1]) AS e))") +
       "SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, batch FROM mb")
def q_minibatch_assign(spark, sf):
    docs = _train_docs(spark, sf)
    out = TM.minibatches(docs, 0, 64).unionByName(TM.minibatches(docs, 1, 64))
    return out.select("doc_id", F.col("epoch").cast("int"), "batch")


FIT_H, FIT_K, FIT_EPOCHS, FIT_BATCH = 500, 40, 15, 64   # as in the reference


def _fit(spark, sf):
    """The fit of the balanced train rows, kept by the application: the keys
    below share it, and one that finds it stopped goes on."""
    from quill.session import ensure_checkpoint_dir, materialize
    name = hashlib.md5(f"{sf}:{FIT_H}:{FIT_K}:{FIT_EPOCHS}:{FIT_BATCH}".encode()).hexdigest()
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quill-tables/{spark.sparkContext.applicationId}/topic-fit-{name}"
    kept = Versions(spark, root)
    if kept.last() == FIT_EPOCHS - 1:
        return kept, kept.log().select("epoch", "batch", "docs", "loss", "recon", "kl")
    p = prepared_documents(spark, sf)
    vocab = materialize(V.fit_vocabulary(p.words))
    kept.write("vocab", "whole", vocab)
    n_vocab = vocab.count()
    bow = materialize(V.term_counts(p.rows.where(F.col("split") == "train"), vocab))
    train = p.docs.where(F.col("split") == "train").select("doc_id", "label")
    rows = B.balance(train, bow, "smote").select(F.col("out_id").alias("doc_id"), "token_id", "cnt")
    # both methods number the same copies: rows without a counted token are in the batches too
    docs = B.random_oversample(train).select(F.col("out_id").alias("doc_id"))
    _, log, _ = TM.fit(rows, n_vocab, H=FIT_H, K=FIT_K, epochs=FIT_EPOCHS, batch_size=FIT_BATCH, vocab=vocab, docs=docs, root=root)
    return kept, log


@query("topic_fit")
def q_topic_fit(spark, sf):
    """M4/M8 (rows only): data-parallel fit; the per-step training log."""
    return _fit(spark, sf)[1]


@query("training_log_summary")
def q_training_log_summary(spark, sf):
    """A13 (rows only): per-epoch averages of the fit's log."""
    return TM.training_log_summary(_fit(spark, sf)[1])


@query("best_checkpoint")
def q_best_checkpoint(spark, sf):
    """A14 (rows only): the epoch with the lowest average loss (earliest on ties)."""
    return TM.best_epoch(TM.training_log_summary(_fit(spark, sf)[1]))


@query("topic_best_words")
def q_topic_best_words(spark, sf):
    """A14/M5/W1 (rows only): top words of every topic by the kept parameters of the best epoch."""
    kept, _ = _fit(spark, sf)
    epoch, params = TM.best_params(kept)
    top = TM.top_words(TM.topic_word_matrix(params), kept.read("vocab", "whole"), 10)
    return top.select(F.lit(epoch).alias("epoch"), "topic", "rank", "token")
