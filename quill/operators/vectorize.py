"""Train-only vocabulary and bag-of-words counts.

The canonical bag of words is the triple table ``(doc_id, token_id, cnt)``;
it is never densified.  Counts are pre-aggregated per document before the
vocabulary join, so the join sees one row per distinct (document, token).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.functions import text as T
from quill.functions.ranking import dense_index


def vocab_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens the vectoriser keeps (two characters or more)."""
    return tokens.where(T.vocab_token("token"))


def fit_vocabulary(tokens: DataFrame, split_col: str = "split", fit_split: str = "train") -> DataFrame:
    """``(token, token_id)``; ids follow ascending token order, fitted
    on the ``fit_split`` rows only (no leakage from val/test)."""
    src = tokens.where(F.col(split_col) == fit_split) if split_col in tokens.columns else tokens
    words = vocab_tokens(src).select("token").distinct()
    return dense_index(words, "token", out="token_id").select("token", F.col("token_id").cast("int"))


def term_counts(tokens: DataFrame, vocab: DataFrame, keep=("split", "label")) -> DataFrame:
    """``(doc_id, token_id, cnt, *keep)``; tokens outside the
    vocabulary are ignored."""
    keep = [k for k in keep if k in tokens.columns]
    per_doc = (vocab_tokens(tokens).groupBy("doc_id", *keep, "token")
               .agg(F.count(F.lit(1)).cast("int").alias("cnt")))
    return per_doc.join(vocab, on="token", how="inner").select("doc_id", *keep, "token_id", "cnt")


def vocab_json_lines(vocab: DataFrame) -> DataFrame:
    """One JSON object per vocabulary entry (JSON Lines; written in parallel)."""
    return vocab.select(F.to_json(F.struct("token", "token_id")).alias("json"))


def bow_vector_stats(bow: DataFrame) -> DataFrame:
    """Per-document sparse-vector shape: stored entries, total count and
    largest index (what a CSR row / SparseVector holds)."""
    return bow.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("long").alias("nnz"),
        F.sum("cnt").cast("long").alias("total"),
        F.max("token_id").cast("long").alias("max_index"))


def to_sparse_vectors(bow: DataFrame, vocab_size: int, out: str = "features") -> DataFrame:
    """``(doc_id, features: SparseVector)`` for MLlib estimators (ML boundary only).

    Entries are gathered per document (a document is one row either way)."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    @F.udf(VectorUDT())
    def _vec(entries):
        entries = sorted((e[0], float(e[1])) for e in entries)
        return SparseVector(vocab_size, [e[0] for e in entries], [e[1] for e in entries])

    g = bow.groupBy("doc_id").agg(F.collect_list(F.struct("token_id", "cnt")).alias("_e"))
    return g.select("doc_id", _vec("_e").alias(out))
