"""The prepared corpus: cleaned, split and lemmatised tokens in long form.

    docs --T1-T4--> doc-level token arrays (checkpointed: the regex chain runs once)
         --P3-----> non-empty documents --B2--> split per document (doc-level join)
         --T5-----> lemmas in place --explode-> (doc_id, label, split, pos, token)

    distinct tokens per split (one pass) --> lexicon, lemmas, words of the vocabulary

A corpus lexicon is built from every split (it stands in for an external
dictionary, not a fitted model); the vocabulary is fitted on train only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.operators import clean as C
from quill.operators import split as S
from quill.session import materialize


class Prepared:
    """``docs(doc_id, label, split)`` of the non-empty documents, and
    ``tokens(doc_id, label, split, pos, token)``, lemmatised: made and written
    when first asked for, so keys that need only ids and labels never read them."""

    def __init__(self, base: DataFrame, splits: DataFrame, lexicon: DataFrame | None, exceptions: DataFrame | None):
        self._base, self._splits, self._lexicon, self._exceptions = base, splits, lexicon, exceptions
        # the lexicon also counts documents that are in no split, as one without an id
        self._held = base.join(splits, on="doc_id", how="left").select("doc_id", "label", "split", "tokens")
        self.docs = base.select("doc_id", "label").join(splits, on="doc_id", how="inner").select("doc_id", "label", "split")

    @cached_property
    def _types(self) -> DataFrame:
        """The distinct tokens of each split with the least and largest id that has them: the one pass over the tokens
        that the lexicon, the lemmas and the vocabulary need."""
        long = self._held.select("doc_id", "split", F.explode("tokens").alias("token"))
        return materialize(long.groupBy("split", "token").agg(*C.id_range("doc_id")))

    @cached_property
    def _lemmas(self) -> DataFrame:
        lexicon = C.lexicon_of_ranges(self._types) if self._lexicon is None else self._lexicon
        return C.sent_if_small(C.lemma_map(self._types.select("token"), lexicon, self._exceptions))

    @cached_property
    def words(self) -> DataFrame:
        """``(split, token)``: the distinct lemmatised tokens of each split, from
        the distinct tokens; what a vocabulary is fitted on."""
        return C.with_lemmas(self._types.where("split is not null").select("split", "token"), self._lemmas).distinct()

    @property
    def rows(self) -> DataFrame:
        """``tokens`` without being written, for what reads them once or reads few of them."""
        held = self._base.join(self._splits, on="doc_id", how="inner")
        long = held.select("doc_id", "label", "split", F.posexplode("tokens").alias("pos", "token"))
        return C.with_lemmas(long, self._lemmas)

    @cached_property
    def tokens(self) -> DataFrame:
        return materialize(self.rows)


def prepare(docs: DataFrame, splits: DataFrame | None = None, lexicon: DataFrame | None = None,
            exceptions: DataFrame | None = None, **split_kw) -> Prepared:
    """``splits`` (doc_id, split) may be given (pre-split corpora, B6);
    otherwise a stratified split on ``label`` is made.  ``lexicon(word)`` and
    ``exceptions(token, lemma)`` feed the lemmatiser; without a lexicon the
    corpus's own is used."""
    clean = C.with_clean_tokens(docs)
    # written before the emptiness filter so the regex chain runs once; the
    # size is a column of its own, so ids are read without the tokens
    base = materialize(clean.select("doc_id", "label", "tokens", F.size("tokens").alias("n_tokens")))
    base = base.where("n_tokens > 0").drop("n_tokens")
    if splits is None:
        splits = S.stratified_split(base.select("doc_id", "label"), **split_kw)
    else:
        splits = materialize(splits.select("doc_id", "split"))
    return Prepared(base, splits.select("doc_id", "split"), lexicon, exceptions)
