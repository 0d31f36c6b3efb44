"""Sub-word sequences (E1-E5): greedy longest-match pieces, markers,
truncation, padding and attention masks.

The piece vocabulary is a DataFrame ``(piece, id)``; continuation pieces
carry ``##``.  ``build_piece_vocab`` derives a test vocabulary from the
train split: the special markers, every character and its ``##`` form, and
the words of enough train documents.  Words are encoded once per *distinct* word:
with a dictionary sent to the tasks while the vocabulary is of bounded size, else
by a join of the words' distinct parts with the vocabulary.  They are then joined
back to the token stream and assembled per document.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ----------------------------------------------------------------- fixed values
PAD, UNK, CLS, SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
SPECIALS = (PAD, UNK, CLS, SEP)          # ids 0, 1, 2, 3
MAX_LEN = 128                            # sequence length, markers included
MAX_WORD_CHARS = 100                     # longer words encode as [UNK]
MIN_WORD_DOCS = 20                       # a derived vocabulary holds the words of that many train documents
MAX_VOCAB_PIECES = 200_000               # a larger vocabulary stays a table: every Python worker would hold it (about 40 MB)


def _accent_map() -> tuple[str, str]:
    """Latin letters with diacritics -> base letter, derived from Unicode
    decomposition (U+00C0..U+024F)."""
    src, dst = [], []
    for cp in range(0xC0, 0x250):
        ch = chr(cp)
        d = unicodedata.normalize("NFD", ch)
        if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.category(c) == "Mn" for c in d[1:]):
            src.append(ch)
            dst.append(d[0])
    return "".join(src), "".join(dst)


ACCENT_FROM, ACCENT_TO = _accent_map()


def strip_accents(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, ACCENT_FROM, ACCENT_TO)


def strip_accents_sql(expr: str) -> str:
    return f"translate({expr}, '{ACCENT_FROM}', '{ACCENT_TO}')"


def build_piece_vocab(train_tokens: DataFrame, min_docs: int = MIN_WORD_DOCS) -> DataFrame:
    """``(piece, id)``: specials 0-3, then pieces in ascending order.  All words
    in at least ``min_docs`` documents are whole pieces."""
    from quill.session import materialize
    words = train_tokens.select("doc_id", strip_accents("token").alias("w"))
    counts = materialize(words.distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n")))  # both kinds of pieces come from it
    chars = counts.select(F.explode(F.split("w", "")).alias("c")).where(F.length("c") == 1).distinct()
    pieces = chars.select(F.col("c").alias("piece")).unionByName(
        chars.select(F.concat(F.lit("##"), "c").alias("piece")))
    top = counts.where(F.col("n") >= min_docs).select(F.col("w").alias("piece"))
    allp = pieces.unionByName(top).distinct()
    from quill.functions.ranking import dense_index
    idx = dense_index(allp, "piece", out="id")
    spec = train_tokens.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SPECIALS)], "piece string, id long")
    return spec.unionByName(idx.select("piece", (F.col("id") + len(SPECIALS)).alias("id"))).select(
        "piece", F.col("id").cast("int"))


def _greedy(word: str, vocab: dict, unk: int, max_piece: int) -> list[int]:
    if len(word) > MAX_WORD_CHARS:
        return [unk]
    out, start = [], 0
    while start < len(word):
        end = min(len(word), start + max_piece)
        hit = None
        while end > start:
            sub = word[start:end] if start == 0 else "##" + word[start:end]
            if sub in vocab:
                hit = vocab[sub]
                break
            end -= 1
        if hit is None:
            return [unk]
        out.append(hit)
        start = end
    return out


def _encode_by_join(words: DataFrame, piece_vocab: DataFrame) -> DataFrame:
    """E1 with the vocabulary as a table.  Words are cut into all parts that are
    short enough to be pieces; the distinct parts meet the vocabulary once, and a
    word's matches (at most one a start and length) are walked from its first
    character, the longest piece at each place."""
    from quill.session import materialize
    pieces = piece_vocab.where(~F.col("piece").isin(*SPECIALS))
    starts = F.col("piece").startswith("##")
    both = pieces.select(F.when(starts, F.expr("substring(piece, 3)")).otherwise(F.col("piece")).alias("part"), (~starts).alias("head"), "id")
    both = both.unionAll(pieces.where(starts).select(F.col("piece").alias("part"), F.lit(True).alias("head"), "id"))  # "##x" itself, at a word's start
    both = materialize(both.where(F.length("part") > 0).groupBy("part", "head").agg(F.min("id").alias("id")))
    # a part is as long as a piece of its kind can be: where only characters continue a word, one from its second place on
    longest = dict.fromkeys((True, False), 0) | {r["head"]: r["n"] for r in both.groupBy("head").agg(F.max(F.length("part")).alias("n")).collect()}
    reach = f"if(at = 1, {longest[True]}, {longest[False]})"
    unk = piece_vocab.where(F.col("piece") == UNK).first()["id"]
    d = materialize(words.select("token").distinct().select("token", strip_accents("token").alias("w")))
    cut = (d.where(F.length("w") <= MAX_WORD_CHARS)
           .select("token", "w", F.explode(F.expr("sequence(1, greatest(1, length(w)))")).alias("at"))
           .select("token", "at", "w", F.explode(F.expr(f"sequence(1, greatest(1, least({reach}, length(w) - at + 1)))")).alias("size"))
           .select("token", "at", "size", F.expr("substring(w, at, size)").alias("part"), (F.col("at") == 1).alias("head")))
    found = cut.join(both, on=["part", "head"]).groupBy("token", "at").agg(F.max(F.struct("size", "id")).alias("best"))
    steps = found.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("at", "best"))).alias("steps"))
    d = d.join(steps, on="token", how="left")
    step = "element_at(steps, state.at)"
    walk = ("aggregate(sequence(1, greatest(1, length(w))), named_struct('at', 1, 'ids', cast(array() as array<int>)), "
            f"(state, i) -> if(state.at = i and {step} is not null, "
            f"named_struct('at', i + {step}.size, 'ids', concat(state.ids, array(cast({step}.id as int)))), state))")
    d = d.withColumn("_walk", F.expr(walk))
    whole = (F.col("_walk.at") == F.length("w") + 1) & (F.length("w") <= MAX_WORD_CHARS)
    ids = F.when(F.length("w") == 0, F.array().cast("array<int>")).when(whole, F.col("_walk.ids")).otherwise(F.array(F.lit(unk).cast("int")))
    return d.select("token", ids.alias("piece_ids"))


def encode_words(words: DataFrame, piece_vocab: DataFrame) -> DataFrame:
    """``(token, piece_ids array<int>)`` for distinct ``words.token``."""
    if piece_vocab.count() > MAX_VOCAB_PIECES:
        return _encode_by_join(words, piece_vocab)
    vocab = {r["piece"]: int(r["id"]) for r in piece_vocab.collect()}  # bounded by the check above
    unk = vocab[UNK]
    max_piece = max(len(p) - (2 if p.startswith("##") else 0) for p in vocab if p not in SPECIALS)
    bv = words.sparkSession.sparkContext.broadcast(vocab)

    def fn(batches):
        v = bv.value
        for pdf in batches:
            yield pd.DataFrame({"token": pdf["token"],
                                "piece_ids": [_greedy(w, v, unk, max_piece) for w in pdf["w"]]})

    d = words.select("token").distinct().select("token", strip_accents("token").alias("w"))
    return d.mapInPandas(fn, "token string, piece_ids array<int>")


def sequence_tokens(tokens: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """The tokens that can reach a sequence: every word yields a piece at
    least, so those from position ``max_len - 2`` on are cut in any case."""
    return tokens.where(F.col("pos") < max_len - 2)


def encode_sequences(tokens: DataFrame, word_pieces: DataFrame, max_len: int = MAX_LEN,
                     keep=("split", "label")) -> DataFrame:
    """``(doc_id, *keep, input_ids, attention_mask, n_real)``; pieces
    are truncated to ``max_len - 2``, wrapped in [CLS] .. [SEP], padded with 0."""
    keep = [k for k in keep if k in tokens.columns]
    t = sequence_tokens(tokens, max_len).join(word_pieces, on="token", how="inner")
    g = t.groupBy("doc_id", *keep).agg(F.array_sort(F.collect_list(F.struct("pos", "piece_ids"))).alias("_s"))
    ids = F.slice(F.flatten(F.transform("_s", lambda s: s["piece_ids"])), 1, max_len - 2)
    seq = F.concat(F.array(F.lit(SPECIALS.index(CLS))), ids, F.array(F.lit(SPECIALS.index(SEP))))
    g = g.select("doc_id", *keep, seq.alias("_ids"))
    n = F.size("_ids")
    pad = F.array_repeat(F.lit(SPECIALS.index(PAD)), F.lit(max_len) - n)
    return g.select("doc_id", *keep,
                    F.concat("_ids", pad).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n)).alias("attention_mask"),
                    n.cast("long").alias("n_real"))
