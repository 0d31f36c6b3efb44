"""Corpus cleaning (T5 lemma, T6 join, T7 full pipeline, P3 empty-document drop).

Token streams are carried in *long* form ``(doc_id, pos, token)`` so that the
dictionary steps (lemma, vocabulary, bag of words) are joins and
aggregations Spark can distribute; only ``clean_corpus`` regroups tokens into
one array per document.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.functions import text as T
from quill.sources.files import require_column

# ----------------------------------------------------------------- fixed values
# Noun suffix rules of the lemmatiser: (suffix, replacement).
NOUN_RULES = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
              ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))

LEXICON_MIN_DF = 2
#: Entries up to which a lemma map is sent to the tasks.
MAP_ROWS = 500_000


def with_clean_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``tokens`` = T1-T4 of the text (before lemmatisation)."""
    for c in ("doc_id", text_col):
        require_column(docs, c)
    return docs.withColumn("tokens", T.clean_tokens(text_col))


def explode_tokens(df: DataFrame, tokens_col: str = "tokens", keep=("label",)) -> DataFrame:
    """``(doc_id, pos, token, *keep)`` from an array column."""
    keep = [k for k in keep if k in df.columns]
    return df.select("doc_id", *keep, F.posexplode(tokens_col).alias("pos", "token"))


def corpus_lexicon(tokens_long: DataFrame, min_df: int = LEXICON_MIN_DF) -> DataFrame:
    """A lexicon for corpora without a dictionary: tokens in at least ``min_df``
    documents.  It takes any word of any language for a noun and depends on the
    corpus; give a dictionary of nouns where there is one."""
    if min_df == 2 and tokens_long.schema["doc_id"].dataType.typeName() in ("long", "integer"):
        return lexicon_of_ranges(tokens_long.groupBy("token").agg(*id_range("doc_id")))
    return (tokens_long.select("doc_id", "token").distinct()
            .groupBy("token").agg(F.count(F.lit(1)).alias("df"))
            .where(F.col("df") >= min_df).select(F.col("token").alias("word")))


def id_range(col: str) -> list:
    """The least and the largest id of a group, and whether one is null."""
    return [F.min(col).alias("lo"), F.max(col).alias("hi"), F.max(F.col(col).isNull()).alias("none")]


def lexicon_of_ranges(ranges: DataFrame) -> DataFrame:
    """``(word)``: the tokens of ``ranges(token, lo, hi, none, ...)`` in two documents
    or more: two ids that differ, found without the (document, token) pairs."""
    r = ranges.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("none").alias("none"))
    return r.where((F.col("lo") < F.col("hi")) | (F.col("none") & F.col("lo").isNotNull())).select(F.col("token").alias("word"))


def may_change(token) -> F.Column:
    """Whether a suffix rule applies to a token; any other is its own lemma."""
    ends = [old for old, _ in NOUN_RULES if not any(old != other and old.endswith(other) for other, _ in NOUN_RULES)]
    return functools.reduce(F.Column.__or__, [token.endswith(old) for old in ends])


def lemma_map(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``(token, lemma)`` for every distinct token whose lemma differs.

    ``exceptions(token, lemma)`` come first.  Else the candidates are the token
    itself and each suffix-rule result; those in ``lexicon(word)`` compete and
    the shortest wins (ties by text).  Without any candidate in the lexicon the
    token is its own lemma.
    """
    w = words.select("token").distinct()
    # all candidates in one pass: the token itself and every applicable rule result
    forms = [F.col("token")] + [
        F.when(F.col("token").endswith(old),
               F.concat(F.expr(f"substring(token, 1, length(token) - {len(old)})"), F.lit(new)))
        for old, new in NOUN_RULES]
    cands = w.where(may_change(F.col("token"))).select("token", F.explode(F.array(*forms)).alias("cand")).where(F.col("cand").isNotNull())
    known = cands.join(lexicon.select(F.col("word").alias("cand")), on="cand", how="left_semi")
    best = known.groupBy("token").agg(
        F.min(F.struct(F.length("cand").alias("len"), F.col("cand").alias("cand"))).alias("b"))
    best = best.select("token", F.col("b.cand").alias("lemma"))
    if exceptions is not None:
        fixed = exceptions.select("token", "lemma").join(w, on="token", how="left_semi")
        best = best.join(fixed, on="token", how="left_anti").unionByName(fixed)
    return best.where(F.col("lemma") != F.col("token"))


def lemmatize_long(tokens_long: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """T5 over a long token table; ``token`` is replaced by its lemma."""
    return replace_lemmas(tokens_long, lemma_map(tokens_long.select("token"), lexicon, exceptions))


def sent_if_small(lemmas: DataFrame) -> DataFrame:
    """The map written once, one entry a token; of at most ``MAP_ROWS`` it is sent to the tasks."""
    from quill.session import materialize
    lemmas = materialize(lemmas.groupBy("token").agg(F.min("lemma").alias("lemma")))  # one a token, should exceptions repeat
    return F.broadcast(lemmas) if lemmas.count() <= MAP_ROWS else lemmas


def replace_lemmas(tokens_long: DataFrame, lemmas: DataFrame) -> DataFrame:
    """T5 over a long token table with a map ``(token, lemma)``; one of at most
    ``MAP_ROWS`` entries goes to the tasks and the tokens are not shuffled."""
    return with_lemmas(tokens_long, sent_if_small(lemmas))


def with_lemmas(tokens_long: DataFrame, lemmas: DataFrame) -> DataFrame:
    out = F.coalesce("lemma", "token").alias("token")
    return tokens_long.join(lemmas, on="token", how="left").select(*[out if c == "token" else c for c in tokens_long.columns])


def lemmatize_arrays(docs: DataFrame, lemmas: DataFrame, tokens_col: str = "tokens", by_rules: bool = False) -> DataFrame:
    """T5 over token arrays: ``docs(doc_id, tokens, ...)`` with the lemma of
    every token in place.  The distinct (document, token) pairs meet the map (sent
    to the tasks up to ``MAP_ROWS`` entries), and a document's own entries its
    array.  Rows that repeat a ``doc_id``, or have none, share the entries.
    ``by_rules``: the map has no exceptions, so only tokens with a suffix of the
    rules need to meet it."""
    own = F.filter(tokens_col, may_change) if by_rules else tokens_col
    pairs = docs.select(F.col("doc_id").alias("_of"), F.explode(F.array_distinct(own)).alias("token")).join(sent_if_small(lemmas), on="token")
    own = pairs.groupBy("_of").agg(F.map_from_entries(F.collect_set(F.struct("token", "lemma"))).alias("_own"))
    new = F.transform(tokens_col, lambda t: F.coalesce(F.element_at("_own", t), t))
    return (docs.join(own, F.col("doc_id").eqNullSafe(F.col("_of")), "left")
            .withColumn(tokens_col, F.when(F.col("_own").isNull(), F.col(tokens_col)).otherwise(new)).drop("_of", "_own"))


def clean_long(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Long cleaned tokens ``(doc_id, label, pos, token)`` before
    lemmatisation; empty documents have no rows."""
    return explode_tokens(with_clean_tokens(docs, text_col))


def clean_corpus(docs: DataFrame, lexicon: DataFrame | None = None, lemmatize: bool = True,
                 text_col: str = "text", keep_empty: bool = True, exceptions: DataFrame | None = None,
                 abbreviated: DataFrame | None = None) -> DataFrame:
    """``(doc_id, tokens, processed_content, label)``.

    ``lexicon(word)`` and ``exceptions(token, lemma)`` feed the lemmatiser;
    without a lexicon the corpus's own is used (``corpus_lexicon``).  Documents
    whose cleaned token list is empty keep an empty list and an empty string
    unless ``keep_empty`` is False (P3).  With ``abbreviated(word)`` the periods
    of abbreviations are no sentence ends (``operators.sentences``).
    """
    from quill.operators.sentences import protect
    from quill.session import materialize
    if abbreviated is not None:
        docs = protect(docs, abbreviated, text_col)
    out = materialize(with_clean_tokens(docs, text_col).drop(text_col))
    if lemmatize:
        long = out.select("doc_id", F.explode("tokens").alias("token"))
        # the one pass over the tokens that both the lexicon and the lemmas need
        types = materialize(long.groupBy("token").agg(*id_range("doc_id")))
        lemmas = lemma_map(types.select("token"), lexicon_of_ranges(types) if lexicon is None else lexicon, exceptions)
        out = lemmatize_arrays(out, lemmas, by_rules=exceptions is None)
    out = out.select("doc_id", "tokens", T.join_tokens("tokens").alias("processed_content"),
                     *[c for c in ("label",) if c in docs.columns])
    return out if keep_empty else drop_empty(out)


def drop_empty(clean: DataFrame) -> DataFrame:
    """Documents with no surviving token are dropped."""
    return clean.where(F.size("tokens") > 0)


def nonempty_docs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` restricted to documents with at least one cleaned token
    (lemmatisation never empties a list, so it is not needed here)."""
    return docs.where(F.size(T.clean_tokens(text_col)) > 0)
