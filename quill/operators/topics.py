"""Neural topic model as data-parallel Spark jobs.

Model: encoder ``h = relu(W1^T x + b1)`` (V -> H), heads ``mu``/``logvar``
(H -> K), decoder ``logits = Wdec z + bdec`` (K -> V), log-softmax over the
vocabulary.  Parameters live in a table ``(layer, row, values)``; layers
``enc`` (V rows of H), ``enc_b``, ``mu``/``lv`` (H rows of K), ``mu_b``/``lv_b``,
``dec`` (V rows of K: the topic-word matrix), ``dec_b`` (one row of V).

* ``init_params`` generates weights from hashes (uniform in
  ``±1/sqrt(fan_in)``), so a model can be rebuilt in SQL;
* inference (encode, log-probabilities, ELBO, perplexity) never has an array of
  documents x vocabulary.  A model of at most ``BROADCAST_PARAMS`` numbers goes
  to the tasks, which keep a running log-sum-exp; of a larger one the vocabulary
  layers stay a table.  A task then has a slice of the documents and reads only
  the rows of the words they have, in order of the vocabulary.  The sum over the
  vocabulary that a softmax divides by is taken from moments of the decoder (see
  ``_Moments``), with a bound of its error; documents beyond the bound meet all rows;
* fitting is synchronous, one barrier stage an epoch: each task holds its rows
  of the vocabulary layers and of Adam's moments, reads its words of every batch
  and updates its rows; the tasks exchange sums as wide as the batch.  The driver
  sees neither parameters nor documents; parameters, moments and the log of an
  epoch are kept in a table, from which a stopped fit goes on.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.functions.hashing import TWO_60, hash_key, units_of
from quill.sources.versions import Versions

BROADCAST_PARAMS = 20_000_000  # numbers of a model that is sent to the tasks whole
FIT_PARAMS = 50_000_000        # numbers of the heads that the driver updates
FIT_BLOCK = 1024               # vocabulary rows updated at a time
FIT_ROWS = 8                   # chunks or batches that go to a task at a time
FIT_DTYPE = np.float32         # of weights and moments while fitting
FIT_TASK_BYTES = 1 << 30       # weights and moments that one task of a fit holds
VOCAB_BLOCK = 8192             # vocabulary rows worked on at a time
SUM_BLOCK = 2048               # vocabulary rows whose exponentials are summed at a time
DOC_SLICE = 64                 # documents worked on at a time
BLOCK_BYTES = 128 << 20        # weights of a large model's block, which a task holds
SLICE_DOCS = 200_000           # documents of a slice, which a task holds
MOMENT_DOCS = 2_000            # documents from which on moments of the decoder cost less than all its rows
MOMENT_FEATURES = 1_300        # products of at most two coordinates that moments are taken of (K up to 49)
MOMENT_ERROR = 1e-10           # bound of the error of a log-sum taken from moments
LAYERS = ("enc", "enc_b", "mu", "mu_b", "lv", "lv_b", "dec", "dec_b")


def _shapes(V: int, H: int, K: int) -> dict:
    # layer -> (rows, cols, fan_in)
    return {"enc": (V, H, V), "enc_b": (1, H, V), "mu": (H, K, H), "mu_b": (1, K, H),
            "lv": (H, K, H), "lv_b": (1, K, H), "dec": (V, K, K), "dec_b": (1, V, K)}


@dataclass(frozen=True)
class Rule:
    """What a hash-initialised model is made by, so that a row can be made where it is needed."""
    seed: int
    V: int
    H: int
    K: int

    def rows(self, layer: str, rows: np.ndarray) -> np.ndarray:
        _, cols, fan_in = _shapes(self.V, self.H, self.K)[layer]
        i = rows.astype(np.int64)[:, None] * cols + np.arange(cols)
        return (units_of(self.seed, layer, i.ravel()) - 0.5).reshape(-1, cols) * (2.0 * (1.0 / math.sqrt(fan_in)))

    def decoder(self, rows: np.ndarray) -> np.ndarray:
        """Rows of ``dec``, the bias as the last number."""
        bias = (units_of(self.seed, "dec_b", rows) - 0.5) * (2.0 * (1.0 / math.sqrt(self.K)))
        return np.concatenate([self.rows("dec", rows), bias[:, None]], axis=1)


def init_params(spark: SparkSession, V: int, H: int, K: int, seed: int = 42) -> DataFrame:
    """Hash-initialised parameter table; what works on it as it is may make rows by its ``rule``."""
    rule, parts = Rule(seed, V, H, K), []

    def values_of(layer: str):
        @F.arrow_udf("array<double>")
        def values(row: pa.Array) -> pa.Array:
            w = rule.rows(layer, row.to_numpy(zero_copy_only=False))
            return _lists(w.ravel(), np.full(len(w), w.shape[1]))
        return values

    for layer, (rows, _, _) in _shapes(V, H, K).items():
        r = spark.range(rows).select(F.col("id").cast("int").alias("row"))
        parts.append(r.select(F.lit(layer).alias("layer"), "row", values_of(layer)(F.col("row")).alias("values")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out._quill_rule = rule  # of this table only: one made from it may have other rows
    return out


def _rule(params: DataFrame) -> Rule | None:
    return getattr(params, "_quill_rule", None)


def topic_word_matrix(params: DataFrame) -> DataFrame:
    """M5: ``(topic, token_id, weight)`` = decoder weight read by column."""
    d = params.where(F.col("layer") == "dec")
    return d.select(F.col("row").alias("token_id"), F.posexplode("values").alias("topic", "weight")).select(
        F.col("topic").cast("int"), F.col("token_id").cast("int"), "weight")


def top_words(tw: DataFrame, vocab: DataFrame, n: int = 10, n_topics: int | None = None) -> DataFrame:
    """``(topic, rank, token_id, token)``: the n largest weights per
    topic (ties: larger token_id first), optionally the first ``n_topics``."""
    if n_topics is not None:
        tw = tw.where(F.col("topic") < n_topics)
    w = Window.partitionBy("topic").orderBy(F.col("weight").desc(), F.col("token_id").desc())
    t = tw.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)  # top-k is the feature
    return t.join(vocab, on="token_id", how="inner").select("topic", F.col("rank").cast("int"), "token_id", "token")


def topic_report(top: DataFrame) -> DataFrame:
    """One line per topic, ``Topic i: w1 w2 ...`` (write with ``df.write.text``)."""
    g = top.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("_w"))
    return g.select("topic", F.concat(F.lit("Topic "), F.col("topic").cast("string"), F.lit(": "),
                                      F.array_join(F.transform("_w", lambda s: s["token"]), " ")).alias("line"))


# ----------------------------------------------------------------- numpy kernels (per Arrow batch)

class Model:
    def __init__(self, mats: dict):
        self.W1, self.b1 = mats["enc"], mats["enc_b"][0]
        self.Wmu, self.bmu = mats["mu"], mats["mu_b"][0]
        self.Wlv, self.blv = mats["lv"], mats["lv_b"][0]
        self.Wd, self.bd = mats["dec"], mats["dec_b"][0]

    def encode(self, ids_list, cnt_list):
        a1 = np.tile(self.b1, (len(ids_list), 1)) + gather_sum(self.W1, ids_list, cnt_list)
        h = np.maximum(a1, 0.0)
        return a1, h, h @ self.Wmu + self.bmu, h @ self.Wlv + self.blv

    def log_probs(self, z):
        logits = z @ self.Wd.T + self.bd
        mx = logits.max(1, keepdims=True)
        lse = mx + np.log(np.exp(logits - mx).sum(1, keepdims=True))
        return logits, logits - lse

    def token_logp(self, z, ids_list):
        """Log-probabilities of the documents' own tokens, and nothing wider
        than DOC_SLICE x VOCAB_BLOCK."""
        out = []
        for lo in range(0, len(z), DOC_SLICE):
            part = z[lo:lo + DOC_SLICE]
            mx, total = np.full(len(part), -np.inf), np.zeros(len(part))
            for v in range(0, len(self.Wd), VOCAB_BLOCK):
                mx, total = log_sum(mx, total, part @ self.Wd[v:v + VOCAB_BLOCK].T + self.bd[v:v + VOCAB_BLOCK])
            for zi, ids, lse in zip(part, ids_list[lo:lo + DOC_SLICE], mx + np.log(total)):
                out.append(self.Wd[ids] @ zi + self.bd[ids] - lse)
        return out


def gather_sum(W, ids_list, cnt_list):
    """Row i: the sum of the rows ids_list[i] of W, weighted by cnt_list[i]."""
    out = np.zeros((len(ids_list), W.shape[1]))
    for lo in range(0, len(ids_list), DOC_SLICE):
        sizes = np.array([len(x) for x in ids_list[lo:lo + DOC_SLICE]])
        if not sizes.sum():
            continue
        rows = W[np.concatenate(ids_list[lo:lo + DOC_SLICE])] * np.concatenate(cnt_list[lo:lo + DOC_SLICE])[:, None]
        full = np.flatnonzero(sizes)
        out[lo + full] = np.add.reduceat(rows, np.concatenate([[0], np.cumsum(sizes[full])[:-1]]), axis=0)
    return out


def log_sum(mx, total, logits):
    """A running log-sum-exp (its maximum, and the sum relative to it) with more logits."""
    new = np.maximum(mx, logits.max(1))
    logits -= new[:, None]
    return new, total * np.exp(mx - new) + np.exp(logits, out=logits).sum(1)


def softmax_sums(Z, W, shift):
    """For each row z of Z a number and the sum of exp(z W^T + shift) relative to
    it.  The number is a bound of the logits, by the norms of both sides: so a
    product and the exponentials are all that is done a logit.  A row whose
    logits may lie too far below its bound gets the maximum itself."""
    norm, size = np.sqrt((W * W).sum(1).max()), np.sqrt((Z * Z).sum(1))
    mx, total = size * norm + shift.max(), np.zeros(len(Z))
    far = 2 * size * norm + (shift.max() - shift.min()) > 600
    near = np.flatnonzero(~far)
    A = np.concatenate([Z[near], np.ones((len(near), 1)), -mx[near, None]], axis=1)
    for v in range(0, len(W), SUM_BLOCK):
        B = np.concatenate([W[v:v + SUM_BLOCK], shift[v:v + SUM_BLOCK, None], np.ones((len(W[v:v + SUM_BLOCK]), 1))], axis=1).T.copy()
        for i in range(0, len(near), DOC_SLICE):
            y = A[i:i + DOC_SLICE] @ B
            total[near[i:i + DOC_SLICE]] += np.exp(y, out=y).sum(1)
    for i in np.array_split(np.flatnonzero(far), -(-int(far.sum()) // DOC_SLICE) or 1):
        mx[i] = -np.inf
        for v in range(0, len(W), VOCAB_BLOCK):
            mx[i], total[i] = log_sum(mx[i], total[i], Z[i] @ W[v:v + VOCAB_BLOCK].T + shift[v:v + VOCAB_BLOCK])
    return mx, total


def n_params(params: DataFrame) -> int:
    return params.select(F.sum(F.size("values"))).first()[0] or 0


def params_to_numpy(params: DataFrame, bound: int = FIT_PARAMS) -> dict:
    """Collect the (model-sized, checked) parameter table to matrices."""
    n = n_params(params)
    if n > bound:
        raise ValueError(f"{n} parameters exceed the bound {bound}")
    pdf = params.toPandas()  # Arrow transfer; size checked above
    mats: dict = {}
    for layer, g in pdf.groupby("layer"):
        g = g.sort_values("row")
        mats[layer] = np.stack([np.asarray(v, dtype=np.float64) for v in g["values"].to_numpy()])
    return mats


def _doc_entries(bow: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """The entries of each document; of those in ``docs``, also without any."""
    e = bow.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token_id", "cnt"))).alias("e"))
    if docs is None:
        return e
    none = F.array().cast(e.schema["e"].dataType)
    return docs.select("doc_id").join(e, "doc_id", "left").select("doc_id", F.coalesce("e", none).alias("e"))


def _ids_cnts(pdf):
    ids = [np.asarray([x["token_id"] for x in e], dtype=np.int64) for e in pdf["e"]]
    cnts = [np.asarray([x["cnt"] for x in e], dtype=np.float64) for e in pdf["e"]]
    return ids, cnts


def forward(bow: DataFrame, params: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """One pass at z = mu: ``(doc_id, mu, logvar, token_ids, cnts, logps)``.
    ``docs(doc_id)`` names the documents when some may be without a counted
    token; those have empty arrays and the encoding of an all-zero row."""
    if _is_large(params):
        return _forward_blocks(bow, params, docs)
    bm = bow.sparkSession.sparkContext.broadcast(params_to_numpy(params, BROADCAST_PARAMS))

    def fn(batches):
        m = Model(bm.value)
        for pdf in batches:
            ids, cnts = _ids_cnts(pdf)
            _, _, mu, lv = m.encode(ids, cnts)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "mu": list(mu), "logvar": list(lv), "token_ids": ids,
                                "cnts": [c.astype(np.int64) for c in cnts], "logps": m.token_logp(mu, ids)})

    return _doc_entries(bow, docs).mapInPandas(fn, FORWARD)


FORWARD = ("doc_id long, mu array<double>, logvar array<double>, token_ids array<int>, "
           "cnts array<int>, logps array<double>")


def _sizes(params: DataFrame) -> tuple[int, int, int]:
    """Vocabulary, hidden width and topics; the weights themselves are not computed for it."""
    if _rule(params) is not None:
        return _rule(params).V, _rule(params).H, _rule(params).K
    rows = {r["layer"]: r["count"] for r in params.groupBy("layer").count().collect()}  # a row per layer
    width = [params.where(F.col("layer") == x).select(F.size("values")).first()[0] for x in ("enc", "dec")]
    return rows["dec"], *width


def _is_large(params: DataFrame) -> bool:
    V, H, K = _sizes(params)
    return V * (H + K + 1) + H + 2 * (H * K + K) > BROADCAST_PARAMS


def _grid(docs: int, per_doc: int, rows: int, per_row: int, tasks: int) -> tuple[int, int]:
    """Into how many blocks the rows of a layer and into how many slices the
    documents are cut.  Every document's numbers go to every block and every row's
    to every slice, so for a number of tasks the sides of the grid are about as
    the sizes of both; a block and a slice are what a task can hold."""
    least = max(1, -(-rows * per_row * 8 // BLOCK_BYTES))
    best = round(math.sqrt(tasks * rows * per_row / max(1, docs * per_doc)))
    blocks = min(max(least, min(best, tasks)), max(1, rows))
    return blocks, max(-(-tasks // blocks), -(-docs // SLICE_DOCS), 1)


def _numbers(column) -> np.ndarray:
    """The numbers of an Arrow column of lists, those of all rows one after the other (null: none)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


class _Slice:
    """A task's documents, and the weights of the part of the vocabulary that its entries are at.

    Rows come in the order of ``step``: -1 the documents (``values``: what they
    bring), then for each part of the vocabulary its weights (even; none of a
    model that has a rule: ``make`` gives the rows of tokens) and entries (odd)."""

    def __init__(self, width: int, make=None) -> None:
        self.keys, self.own = np.zeros(0, np.int64), np.zeros((0, width))
        self._width, self._make = width, make
        self._clear()

    def _clear(self) -> None:
        self.tokens, self.W = np.zeros(0, np.int32), np.zeros((0, self._width))

    def _add(self, tokens: np.ndarray, rows: np.ndarray) -> None:
        tokens, rows = np.concatenate([self.tokens, tokens]), np.concatenate([self.W, rows])
        order = np.argsort(tokens)
        self.tokens, self.W = tokens[order], rows[order]

    def runs(self, batches, docs_width: int = 0):
        """For each run of entries: the place of their document, of their row in ``W``, their token and count."""
        keys, own, held, at = [], [], [], None
        for b in batches:
            step = b["step"].to_numpy()
            cuts = np.flatnonzero(np.diff(step)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(step)]):
                if lo == hi:
                    continue
                run, now = b.slice(lo, hi - lo), int(step[lo])
                if now < 0:
                    keys.append(run["key"].to_numpy())
                    own.append(_numbers(run["values"]).reshape(-1, docs_width) if docs_width else np.zeros((hi - lo, 0)))
                    continue
                if keys:
                    order = np.argsort(np.concatenate(keys), kind="stable")
                    self.keys, self.own = np.concatenate(keys)[order], np.concatenate(own)[order]
                    keys, own = [], []
                if now // 2 != at:
                    held, at = [], now // 2
                    self._clear()
                if now % 2 == 0:
                    held.append((run["token_id"].to_numpy(), _numbers(run["values"]).reshape(-1, self._width)))
                    continue
                if held:
                    self._add(np.concatenate([t for t, _ in held]), np.concatenate([w for _, w in held]))
                    held = []
                token = run["token_id"].to_numpy()
                if self._make is not None:
                    new = np.setdiff1d(token, self.tokens)
                    if len(new):
                        self._add(new, self._make(new))
                j = np.searchsorted(self.tokens, token)
                if (j == len(self.tokens)).any() or (self.tokens[j] != token).any():
                    raise ValueError("a counted token has no row in the model")
                yield np.searchsorted(self.keys, run["key"].to_numpy()), j, token, run["cnt"].to_numpy()


def _sliced(entries: DataFrame, docs: DataFrame, weights: DataFrame | None, slices: int) -> DataFrame:
    """What ``_Slice`` reads: ``docs(key[, values])`` and ``entries(key, token_id, cnt)`` of
    each slice of documents, with those rows of ``weights(row, values)`` that its entries name."""
    size = VOCAB_BLOCK
    at = F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int").alias("slice")
    part = F.floor(F.col("token_id") / size).cast("int") * 2
    both = entries.select(at, (part + 1).alias("step"), "key", "token_id", "cnt")
    if weights is not None:
        wanted = entries.select(at, "token_id").distinct()
        rows = wanted.join(weights, F.col("token_id") == F.col("row")).select("slice", part.alias("step"), "token_id", "values")
        both = both.unionByName(rows, allowMissingColumns=True)
    both = both.unionByName(docs.select("*", at, F.lit(-1).alias("step")), allowMissingColumns=True)
    return both.repartitionById(slices, F.col("slice")).sortWithinPartitions("step").drop("slice")


def _pairs(x: np.ndarray) -> np.ndarray:
    """The products of two coordinates of each row, those of equal ones first."""
    i, j = np.triu_indices(x.shape[1], 1)
    return np.concatenate([x * x, x[:, i] * x[:, j]], axis=1)


class _Moments:
    """``log sum_v exp(z w_v + b_v)`` of many z by the decoder's moments about a centre c.

    With y = (z - c) w_v and e_v = exp(c w_v + b_v) the sum is that of e_v exp(y),
    whose terms up to the fourth power of y are forms in z - c: their coefficients
    are the weighted sums of products of up to four coordinates of w_v, one
    symmetric matrix over the products of at most two.  What is left out is at
    most max|y| exp(max|y|) / 120 times the sum of e_v y^4, which is known, and
    max|y| is at most the longest w_v times the distance of z from c.  So each z
    has a bound of its own; where that exceeds MOMENT_ERROR there is no number."""

    def __init__(self, centre: np.ndarray, top: float, norm: float, G: np.ndarray) -> None:
        self.centre, self.top, self.norm, self.G = centre, top, norm, G

    @staticmethod
    def features(W: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(W), 1)), W, _pairs(W)], axis=1)

    @staticmethod
    def of_rows(parts, centre: np.ndarray) -> tuple[float, float, np.ndarray]:
        """Of frames of rows (their weights, the bias last): the logarithm that the matrix is relative to, the longest row, the matrix."""
        top, norm, size = -np.inf, 0.0, 1 + len(centre) + len(centre) * (len(centre) + 1) // 2
        G = np.zeros((size, size))
        for rows in parts:
            for lo in range(0, len(rows), SUM_BLOCK):
                W, b = rows[lo:lo + SUM_BLOCK, :-1], rows[lo:lo + SUM_BLOCK, -1]
                y = W @ centre + b
                new = max(top, y.max())
                G *= np.exp(top - new)
                top, norm = new, max(norm, np.sqrt((W * W).sum(1).max()))
                q = _Moments.features(W)
                G += (q * np.exp(y - top)[:, None]).T @ q
        return top, norm, G

    def log_sums(self, Z: np.ndarray, error: float) -> np.ndarray:
        """A number for each row of Z, NaN where its bound exceeds ``error``."""
        K, G, out = len(self.centre), self.G, np.empty(len(Z))
        for lo in range(0, len(Z), SUM_BLOCK):
            x = Z[lo:lo + SUM_BLOCK] - self.centre
            p = _pairs(x)
            p[:, K:] *= 2  # (x w)^2 has the product of two different coordinates twice
            q = p @ G[1 + K:, 1 + K:]
            four = (q * p).sum(1)
            total = G[0, 0] + x @ G[0, 1:1 + K] + ((x @ G[1:1 + K, 1:1 + K]) * x).sum(1) / 2 + ((x @ G[1:1 + K, 1 + K:]) * p).sum(1) / 6 + four / 24
            most = self.norm * np.sqrt((x * x).sum(1))
            with np.errstate(all="ignore"):
                good = (most < 30) & (most * np.exp(most) / 120 * np.abs(four) <= error * total)
                out[lo:lo + SUM_BLOCK] = np.where(good, self.top + np.log(total), np.nan)
        return out


def _moments(decoder: DataFrame, rule: Rule | None, z: DataFrame, K: int, tasks: int) -> _Moments:
    """Moments about the mean of the documents' ``mu``."""
    centre = np.array([x or 0.0 for x in z.select(*[F.avg(F.col("mu")[k]) for k in range(K)]).first()])

    def fn(batches):
        top, norm, G = _Moments.of_rows((_decoder_rows(b, rule, K) for b in batches if b.num_rows), centre)
        if top > -np.inf:
            for k in range(0, len(G), 64):
                yield pa.RecordBatch.from_pydict({"part": [k], "top": [top], "norm": [norm], "values": _lists(G[k:k + 64].ravel(), np.array([G[k:k + 64].size]))})

    def add(t: pa.Table) -> pa.Table:
        tops = t["top"].to_numpy()
        G = sum(_numbers(t["values"].slice(i, 1)) * np.exp(tops[i] - tops.max()) for i in range(len(t)))
        return pa.table({"part": t["part"][:1], "top": [tops.max()], "norm": [t["norm"].to_numpy().max()], "values": _lists(G, np.array([len(G)]))})

    kind = "part long, top double, norm double, values array<double>"
    got = decoder.coalesce(tasks).mapInArrow(fn, kind).groupBy("part").applyInArrow(add, kind).orderBy("part").toArrow()  # one matrix, of MOMENT_FEATURES rows at most
    size = 1 + K + K * (K + 1) // 2
    return _Moments(centre, got["top"][0].as_py(), got["norm"][0].as_py(), _numbers(got["values"]).reshape(size, size))


def _decoder_rows(t, rule: Rule | None, K: int) -> np.ndarray:
    """Rows of the decoder, the bias as the last number: those that came, or those that the rule makes of their numbers."""
    return rule.decoder(t["row"].to_numpy()) if rule else _numbers(t["values"]).reshape(-1, K + 1)


def _log_sums(z: DataFrame, decoder: DataFrame, rule: Rule | None, V: int, K: int, n: int, tasks: int) -> DataFrame:
    """``(key, lse)`` of ``z(key, mu)``: by moments of the decoder where they are exact enough, by all its rows elsewhere."""
    from quill.session import materialize
    error, far = MOMENT_ERROR, z.select("key", "mu")
    near = None
    if n > MOMENT_DOCS and 1 + K + K * (K + 1) // 2 <= MOMENT_FEATURES:
        moments = z.sparkSession.sparkContext.broadcast(_moments(decoder, rule, z, K, tasks))

        def fn(batches):
            for b in batches:
                if b.num_rows:
                    lse = moments.value.log_sums(_numbers(b["mu"]).reshape(-1, K), error)
                    yield pa.RecordBatch.from_pydict({"key": b["key"], "lse": pa.array(lse, mask=np.isnan(lse))})

        near = materialize(far.mapInArrow(fn, "key long, lse double"))
        far = far.join(near.where("lse is null").select("key"), "key")
        n = near.where("lse is null").count()
        near = near.where("lse is not null")
        if n == 0:
            return near
    # every document here meets every block: that is what a softmax over the vocabulary is
    blocks, slices = _grid(n, K, V, K + 1, tasks)
    rows = -(-V // blocks)
    blocks = -(-V // rows)

    def every(number: int, name: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias(name)

    def sums(d: pa.Table, w: pa.Table) -> pa.Table:
        if not len(d):
            return pa.table({"key": np.zeros(0, np.int64), "mx": np.zeros(0), "total": np.zeros(0)})
        W = _decoder_rows(w, rule, K)
        mx, total = softmax_sums(_numbers(d["mu"]).reshape(-1, K), W[:, :K], W[:, K])
        return pa.table({"key": d["key"], "mx": mx, "total": total})

    met = far.select("key", "mu", every(blocks, "block"), F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int").alias("slice"))
    dec = decoder.select("*", F.floor(F.col("row") / rows).cast("int").alias("block"), every(slices, "slice"))
    got = met.groupBy("block", "slice").cogroup(dec.groupBy("block", "slice")).applyInArrow(sums, "key long, mx double, total double")
    per_doc = got.groupBy("key").agg(F.collect_list(F.struct("mx", "total")).alias("s"))  # one per block
    per_doc = per_doc.withColumn("top", F.array_max(F.transform("s", lambda v: v["mx"])))
    lse = F.col("top") + F.log(F.aggregate("s", F.lit(0.0), lambda a, v: a + v["total"] * F.exp(v["mx"] - F.col("top"))))
    out = materialize(per_doc.select("key", lse.alias("lse")))
    return out if near is None else near.unionByName(out)


def _forward_blocks(bow: DataFrame, params: DataFrame, docs: DataFrame | None = None, want: str = "arrays") -> DataFrame:
    """The same with a model of any vocabulary: passes over slices of documents
    with the rows of the vocabulary layers that each needs (``_sliced``), so a
    document's sums are made in one task, and ``_log_sums``.  Only the heads
    (hidden x topics) and the biases of fixed width are sent to the tasks.

    ``want``: ``'encode'`` stops at ``mu`` and ``logvar``; ``'sums'`` gives
    ``recon`` and ``words`` of a document besides, without a row or list entry
    per token; ``'words'`` a row per entry, ``'arrays'`` what ``forward`` returns."""
    from quill.session import materialize
    spark = bow.sparkSession
    V, H, K = _sizes(params)
    small = params_to_numpy(params.where(~F.col("layer").isin("enc", "dec", "dec_b")), BROADCAST_PARAMS)
    heads = spark.sparkContext.broadcast(small)
    tasks = spark.sparkContext.defaultParallelism
    none = -(1 << 63)  # stands for a null id, which Arrow's numbers cannot hold
    # counted once: they are read several times
    entries = materialize(bow.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("key"), F.col("token_id").cast("int").alias("token_id"), F.col("cnt").cast("int").alias("cnt")))
    keys = materialize(entries.select("key").distinct())
    n = keys.count()
    rule, sums = _rule(params), want == "sums"
    weights, decoder = None if rule else params.where("layer = 'enc'").select("row", "values"), None
    if want != "encode":
        if rule:
            decoder = spark.range(V).select(F.col("id").cast("int").alias("row"))
        else:  # the bias becomes the last number of each row
            bias = params.where("layer = 'dec_b'").select(F.posexplode("values").alias("row", "bias"))
            decoder = materialize(params.where("layer = 'dec'").select("row", "values").join(bias, "row").select("row", F.concat("values", F.array("bias")).alias("values")))
    if sums and not rule:  # a document's sums of decoder rows are enough, and need no second pass
        weights = weights.join(decoder.select("row", F.col("values").alias("more")), "row").select("row", F.concat("values", "more").alias("values"))
    width = H + (K + 1 if sums else 0)

    def made(tokens: np.ndarray) -> np.ndarray:
        return np.concatenate([rule.rows("enc", tokens), rule.decoder(tokens)], axis=1) if sums else rule.rows("enc", tokens)

    def number_of_slices(width: int) -> int:
        return max(tasks, -(-n // SLICE_DOCS), -(-n * width * 8 // BLOCK_BYTES))

    def encode_rows(batches):
        m, s, out = heads.value, _Slice(width, made if rule else None), None
        for d, j, _, c in s.runs(batches):
            if out is None:
                out, words = np.zeros((len(s.keys), width)), np.zeros(len(s.keys), np.int64)
            order = np.argsort(d, kind="stable")
            d, j, c = d[order], j[order], c[order].astype(np.int64)
            part, first = np.unique(d, return_index=True)
            out[part] += np.add.reduceat(s.W[j] * c[:, None], first, axis=0)
            words[part] += np.add.reduceat(c, first)
        for lo in range(0, len(s.keys), VOCAB_BLOCK):
            own = out[lo:lo + VOCAB_BLOCK]
            h = np.maximum(own[:, :H] + m["enc_b"][0], 0.0)
            mu, size = h @ m["mu"] + m["mu_b"][0], np.full(len(own), K)
            got = {"key": s.keys[lo:lo + VOCAB_BLOCK], "mu": _lists(mu.ravel(), size), "logvar": _lists((h @ m["lv"] + m["lv_b"][0]).ravel(), size)}
            if sums:
                got |= {"cx": (mu * own[:, H:H + K]).sum(1) + own[:, H + K], "words": words[lo:lo + VOCAB_BLOCK]}
            yield pa.RecordBatch.from_pydict(got)

    z = materialize(_sliced(entries, keys, weights, number_of_slices(width))
                    .mapInArrow(encode_rows, "key long, mu array<double>, logvar array<double>" + (", cx double, words long" if sums else "")))
    # a document without entries has the encoding of an all-zero row
    h = np.maximum(small["enc_b"], 0.0)
    zero = {"mu": F.lit((h @ small["mu"] + small["mu_b"])[0].tolist()), "logvar": F.lit((h @ small["lv"] + small["lv_b"])[0].tolist())}

    def of_docs(found: DataFrame, empty: dict) -> DataFrame:
        names = [c for c in found.columns if c != "key"]
        if docs is None:
            return found.select(F.when(F.col("key") != none, F.col("key")).alias("doc_id"), *names)
        # words only of documents that have some
        got = docs.select("doc_id").join(found, F.col("doc_id") == F.col("key"), "left" if empty else "inner")
        return got.select("doc_id", *[F.coalesce(c, empty[c]).alias(c) if empty else c for c in names])

    if want == "encode":
        return of_docs(z, zero)
    lse = _log_sums(z, decoder, rule, V, K, n, 2 * tasks)
    if sums:
        found = z.join(lse, "key").select("key", "mu", "logvar", (F.col("words") * F.col("lse") - F.col("cx")).alias("recon"), "words")
        return of_docs(found, zero | {"recon": F.lit(0.0), "words": F.lit(0).cast("long")})

    def logps(batches):
        s = _Slice(K + 1, rule.decoder if rule else None)
        for d, j, t, c in s.runs(batches, K + 1):
            yield pa.RecordBatch.from_pydict({"key": s.keys[d], "token_id": t, "cnt": c, "logp": (s.own[d, :K] * s.W[j, :K]).sum(1) + s.W[j, K] - s.own[d, K]})

    brought = z.join(lse, "key").select("key", F.concat("mu", F.array("lse")).alias("values"))
    words = _sliced(entries, brought, None if rule else decoder, number_of_slices(K + 1)).mapInArrow(logps, "key long, token_id int, cnt int, logp double")
    if want == "words":
        return of_docs(words, {})
    lists = words.groupBy("key").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("token_id", "cnt", "logp")])
    none_of = {f"{c}s": F.array().cast(f"array<{kind}>") for c, kind in (("token_id", "int"), ("cnt", "int"), ("logp", "double"))}
    return of_docs(z.join(lists, "key"), zero | none_of)


def encode(bow: DataFrame, params: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """M1/M2 (evaluation: z = mu): ``(doc_id, mu array<double>, logvar array<double>)``."""
    if _is_large(params):
        return _forward_blocks(bow, params, docs, "encode")
    return forward(bow, params, docs).select("doc_id", "mu", "logvar")


def word_logp(bow: DataFrame, params: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """M3: ``(doc_id, token_id, cnt, logp)`` for the document's own tokens, z = mu."""
    if _is_large(params):
        return _forward_blocks(bow, params, docs, "words")
    f = forward(bow, params, docs).select("doc_id", F.explode(F.arrays_zip("token_ids", "cnts", "logps")).alias("x"))
    return f.select("doc_id", F.col("x.token_ids").alias("token_id"), F.col("x.cnts").alias("cnt"), F.col("x.logps").alias("logp"))


def elbo(bow: DataFrame, params: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """A15 per document at z = mu: ``(doc_id, recon, kl, loss)``, from one pass."""
    add = lambda a, x: a + x
    if _is_large(params):
        f, recon = _forward_blocks(bow, params, docs, "sums"), F.col("recon")
    else:
        f = forward(bow, params, docs)
        recon = -F.aggregate(F.zip_with("cnts", "logps", lambda c, p: c * p), F.lit(0.0), add)
    kl = F.lit(-0.5) * F.aggregate(F.zip_with("mu", "logvar", lambda m, v: F.lit(1.0) + v - m * m - F.exp(v)), F.lit(0.0), add)
    return f.select("doc_id", recon.alias("recon"), kl.alias("kl")).withColumn("loss", F.col("recon") + F.col("kl"))


def elbo_mean(losses) -> DataFrame:
    """A15 as the training log has it: the mean over a batch of documents (a
    DataFrame of losses, or one grouped by batch)."""
    return losses.agg(*[F.avg(c).alias(c) for c in ("recon", "kl", "loss")], F.count(F.lit(1)).alias("n_docs"))


def perplexity(bow: DataFrame, params: DataFrame) -> DataFrame:
    """``exp(sum nll / sum words)``; null when there are no words.
    Documents without in-vocabulary tokens add nothing to either sum (P8)."""
    if _is_large(params):
        sums = _forward_blocks(bow, params, None, "sums").agg(F.sum("recon").alias("nll"), F.sum("words").alias("words"))
    else:
        sums = word_logp(bow, params).agg(F.sum(-F.col("cnt") * F.col("logp")).alias("nll"), F.sum("cnt").alias("words"))
    return sums.select(
        F.when(F.col("words") > 0, F.exp(F.col("nll") / F.col("words"))).alias("perplexity"),
        F.col("nll").alias("total_nll"), F.col("words").cast("long").alias("total_words"))


# ----------------------------------------------------------------- fitting

def minibatches(docs: DataFrame, epoch: int, batch_size: int, seed: int = 42) -> DataFrame:
    """``(doc_id, epoch, batch)``: a fresh hash order every epoch,
    ``batch = (rank - 1) div batch_size`` (last batch short).  The global
    rank uses hash buckets, not a single-partition window."""
    from quill.functions.ranking import rank_within
    x = docs.select("doc_id").withColumn("_hk", hash_key(seed, f"epoch{epoch}", F.col("doc_id")))
    x = rank_within(x, [], "_hk", "doc_id", out="_r")
    return x.select("doc_id", F.lit(epoch).alias("epoch"),
                    F.floor((F.col("_r") - 1) / batch_size).cast("long").alias("batch"))


def noise(seed: int, epoch: int, doc_id: int, K: int) -> np.ndarray:
    """Reproducible normal draws of a document in an epoch."""
    out = np.empty(K)
    for k in range(K):
        s = f"{seed}:eps{epoch}:{doc_id * K + k}".encode()
        u = [int(hashlib.md5(s + bytes([j])).hexdigest()[:15], 16) / TWO_60 for j in range(2)]
        out[k] = math.sqrt(-2.0 * math.log(max(u[0], 1e-300))) * math.cos(2 * math.pi * u[1])
    return out


STATE = "task int, layer string, chunk int, w binary, m binary, v binary"
_DONE = STATE + ", kind string, batch int, docs int, loss double, recon double, kl double, topic int, token_id int, weight double"


def adam_in_place(w, m, v, g, step: int, lr: float) -> None:
    """One Adam step, a few rows at a time, so that all four stay in the cache."""
    size = max(1, 32768 // max(1, w.shape[1]))
    for lo in range(0, len(w), size):
        wi, mi, vi, gi = (x[lo:lo + size] for x in (w, m, v, g))
        mi *= 0.9
        mi += 0.1 * gi
        vi *= 0.999
        vi += 0.001 * (gi * gi)
        root = np.sqrt(vi * (1.0 / (1 - 0.999 ** step)))
        root += 1e-8
        wi -= mi * (lr / (1 - 0.9 ** step)) / root


def _first_state(params: DataFrame, heads: dict, tasks: int) -> DataFrame:
    """Parameters as bytes, with empty moments: row r of the vocabulary layers
    belongs to task r mod tasks, in chunks of FIT_BLOCK of its rows; the
    decoder's bias is the last column of its rows.  Task -1 has what all tasks hold."""
    spark, fit_block = params.sparkSession, FIT_BLOCK
    bias = params.where("layer = 'dec_b'").select(F.posexplode("values").alias("row", "bias"))
    dec = params.where("layer = 'dec'").select("row", "values").join(bias, "row").select(F.lit("dec").alias("layer"), "row", F.concat("values", F.array("bias")).alias("values"))
    rows = params.where("layer = 'enc'").select("layer", "row", "values").unionByName(dec)
    at = F.floor(F.col("row") / tasks)
    rows = rows.select("layer", "row", "values", (F.col("row") % tasks).cast("int").alias("task"), F.floor(at / fit_block).cast("int").alias("chunk"))

    def pack(key, pdf):
        w = np.concatenate(pdf.sort_values("row")["values"].to_numpy()).astype(FIT_DTYPE)
        return pd.DataFrame({"task": [key[0]], "layer": [key[1]], "chunk": [key[2]], "w": [w.tobytes()], "m": [bytes(w.nbytes)], "v": [bytes(w.nbytes)]})

    small = [(-1, k, 0, bytearray(v.astype(FIT_DTYPE).tobytes()), bytearray(v.size * FIT_DTYPE().nbytes), bytearray(v.size * FIT_DTYPE().nbytes)) for k, v in heads.items()]
    return rows.groupBy("task", "layer", "chunk").applyInPandas(pack, STATE).unionByName(spark.createDataFrame(small, STATE))


def _epoch_input(state: DataFrame, batched: DataFrame, tasks: int) -> DataFrame:
    """What each task reads in an epoch, in order: its parameters, then for every
    batch the batch's documents and the task's own words of them."""
    every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))
    own = F.when(F.col("task") >= 0, F.array("task")).otherwise(F.sequence(F.lit(0), F.lit(tasks - 1)))
    held = state.select(F.explode(own).alias("to"), F.lit(-1).cast("long").alias("batch"), *[c.split()[0] for c in STATE.split(", ")])
    words = F.aggregate("e", F.lit(0.0), lambda a, x: a + x["cnt"])
    docs = batched.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("doc_id", words.alias("words")))).alias("docs")).withColumn("to", every)
    entry = batched.select("batch", "doc_id", F.explode("e").alias("x")).select((F.col("x.token_id") % tasks).cast("int").alias("to"), "batch", F.struct(
        "doc_id", F.col("x.token_id").cast("long").alias("token_id"), F.col("x.cnt").cast("double").alias("cnt")).alias("x"))
    mine = entry.groupBy("to", "batch").agg(F.collect_list("x").alias("e"))
    steps = docs.join(mine, ["to", "batch"], "left")
    return held.unionByName(steps, allowMissingColumns=True).repartitionById(tasks, F.col("to")).sortWithinPartitions("batch", "layer", "chunk")


@contextlib.contextmanager
def _few_rows(spark: SparkSession, rows: int):
    """Frames of at most so many rows go to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class _Shard:
    """A task's rows of a vocabulary layer, with their moments."""

    def __init__(self, rows: int, width: int) -> None:
        self.w, self.m, self.v = (np.zeros((rows, width), FIT_DTYPE) for _ in range(3))

    def put(self, lo: int, *parts: bytes) -> None:
        """Rows from ``lo`` on; written at once, so what came is not held beside them."""
        for mine, part in zip((self.w, self.m, self.v), parts):
            rows = np.frombuffer(part, FIT_DTYPE).reshape(-1, mine.shape[1])
            mine[lo:lo + len(rows)] = rows

    def update(self, lo: int, g: np.ndarray, step: int, lr: float) -> None:
        hi = lo + len(g)
        adam_in_place(self.w[lo:hi], self.m[lo:hi], self.v[lo:hi], g, step, lr)


def _by_row(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` that have each index, 0 to n - 1."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        at, first = np.unique(index[order], return_index=True)
        out[at] = np.add.reduceat(values[order], first, axis=0)
    return out


def _epoch_fn(tasks: int, V: int, H: int, K: int, epoch: int, first: int, lr: float, seed: int, topics: int, words: int, fit_block: int):
    """The task of an epoch.  All tasks run at once (barrier): each holds its
    rows of the vocabulary layers, and a step's sums, as wide as the batch, go
    round between them twice.  The heads are updated alike by all."""

    def fn(frames):
        from pyspark import BarrierTaskContext
        ctx = BarrierTaskContext.get()
        me = ctx.partitionId()

        def gathered(*arrays: np.ndarray) -> list:
            """Each task's arrays."""
            if tasks == 1:
                return [arrays]
            sent = base64.b64encode(b"".join(np.ascontiguousarray(a, dtype=np.float64).tobytes() for a in arrays)).decode()
            out, cuts = [], np.cumsum([a.size for a in arrays])[:-1]
            for message in ctx.allGather(sent):
                flat = np.split(np.frombuffer(base64.b64decode(message)), cuts)
                out.append([f.reshape(a.shape) for f, a in zip(flat, arrays)])
            return out

        mine = len(range(me, V, tasks))
        held = {"enc": _Shard(mine, H), "dec": _Shard(mine, K + 1)}
        heads, moments, log = {}, {}, []
        shapes = {"enc_b": (1, H), "mu": (H, K), "mu_b": (1, K), "lv": (H, K), "lv_b": (1, K)}
        model = None
        step = first

        def learn(docs, e) -> tuple:
            enc, dec = model
            n = len(docs)
            ids = np.array([d["doc_id"] for d in docs], dtype=np.int64)
            size = np.array([d["words"] for d in docs])
            e = [] if e is None else e
            d = np.searchsorted(ids, np.array([x["doc_id"] for x in e], dtype=np.int64))
            t = np.array([x["token_id"] for x in e], dtype=np.int64) // tasks
            c = np.array([x["cnt"] for x in e], dtype=FIT_DTYPE)
            scale = 1.0 / n
            a1 = sum(x[0] for x in gathered(_by_row(d, enc.w[t] * c[:, None], n))) + heads["enc_b"]
            h = np.maximum(a1, 0.0)
            mu, lv = h @ heads["mu"] + heads["mu_b"], h @ heads["lv"] + heads["lv_b"]
            eps, std = np.stack([noise(seed, epoch, int(x), K) for x in ids]), np.exp(0.5 * lv)
            z = mu + eps * std
            # maximum and sum of a running softmax, its sum of decoder rows, and over the own words the sums of decoder rows and logits
            mx, total, rows = np.full(n, -1e300), np.zeros(n), np.zeros((n, K))
            zf = z.astype(FIT_DTYPE)
            for lo in range(0, len(dec.w), VOCAB_BLOCK):
                W = dec.w[lo:lo + VOCAB_BLOCK]
                logits = zf @ W[:, :K].T + W[:, K]
                top = np.maximum(mx, logits.max(1))
                x, old = np.exp(logits - top[:, None]), np.exp(mx - top)
                mx, total, rows = top, total * old + x.sum(1), rows * old[:, None] + x @ W[:, :K]
            own = _by_row(d, dec.w[t, :K] * c[:, None], n)
            xl = np.bincount(d, weights=((z[d] * dec.w[t, :K]).sum(1) + dec.w[t, K]) * c, minlength=n) if len(d) else np.zeros(n)
            got = gathered(mx, total, rows, own, xl)
            top = np.max([g[0] for g in got], axis=0)
            share = [np.exp(g[0] - top) for g in got]
            total = sum(s * g[1] for s, g in zip(share, got))
            lse = top + np.log(total)
            rows = sum(s[:, None] * g[2] for s, g in zip(share, got)) / total[:, None]
            recon = size * lse - sum(g[4] for g in got)
            kl = -0.5 * (1 + lv - mu ** 2 - np.exp(lv)).sum(1)
            dz = (size[:, None] * rows - sum(g[3] for g in got)) * scale
            dmu = dz + mu * scale
            dlv = dz * eps * 0.5 * std + (-0.5 + 0.5 * np.exp(lv)) * scale
            da1 = (dmu @ heads["mu"].T + dlv @ heads["lv"].T) * (a1 > 0)
            order = np.argsort(t, kind="stable")
            d, t, c = d[order], t[order], c[order]
            z, da, lse, size = (x.astype(FIT_DTYPE) for x in (z, da1, lse, size))
            for lo in range(0, len(dec.w), fit_block):
                hi = min(lo + fit_block, len(dec.w))
                i, j = np.searchsorted(t, [lo, hi])
                enc.update(lo, _by_row(t[i:j] - lo, c[i:j, None] * da[d[i:j]], hi - lo), step, lr)
                W = dec.w[lo:hi]
                dlog = np.exp(z @ W[:, :K].T + W[:, K] - lse[:, None]) * size[:, None]
                np.subtract.at(dlog, (d[i:j], t[i:j] - lo), c[i:j])
                dec.update(lo, np.concatenate([dlog.T @ z, dlog.sum(0)[:, None]], axis=1) * scale, step, lr)
            g = {"mu": h.T @ dmu, "mu_b": dmu.sum(0, keepdims=True), "lv": h.T @ dlv, "lv_b": dlv.sum(0, keepdims=True), "enc_b": da1.sum(0, keepdims=True)}
            for k in heads:
                adam_in_place(heads[k], *moments[k], g[k], step, lr)
            return n, float((recon + kl).mean()), float(recon.mean()), float(kl.mean())

        def ready() -> tuple:
            for k, (w, m, v) in list(heads.items()):
                heads[k], moments[k] = (np.frombuffer(w, FIT_DTYPE).reshape(shapes[k]).copy(), [np.frombuffer(x, FIT_DTYPE).reshape(shapes[k]).copy() for x in (m, v)])
            return held["enc"], held["dec"]

        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.batch < 0:
                    if r.task < 0:
                        heads[r.layer] = (r.w, r.m, r.v)
                    else:
                        held[r.layer].put(int(r.chunk) * fit_block, r.w, r.m, r.v)
                else:
                    model = model or ready()
                    step += 1
                    log.append((int(r.batch), *learn(r.docs, r.e)))
        model = model or ready()
        names = [c.split()[0] for c in _DONE.split(", ")]
        none = dict.fromkeys(names)

        def frame_of(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names)

        for layer, shard in zip(("enc", "dec"), model):
            for k, lo in enumerate(range(0, len(shard.w), fit_block)):
                part = [x[lo:lo + fit_block].tobytes() for x in (shard.w, shard.m, shard.v)]
                yield frame_of([none | {"kind": "state", "task": me, "layer": layer, "chunk": k, "w": part[0], "m": part[1], "v": part[2]}])
        if me == 0:
            yield frame_of([none | {"kind": "state", "task": -1, "layer": k, "chunk": 0, "w": w.tobytes(), "m": moments[k][0].tobytes(), "v": moments[k][1].tobytes()} for k, w in heads.items()])
            yield frame_of([none | dict(zip(("kind", "batch", "docs", "loss", "recon", "kl"), ("log", *x))) for x in log])
        D = model[1].w
        for k in range(min(topics, K)):
            top = np.lexsort((-np.arange(len(D)), -D[:, k]))[:words]
            yield frame_of([none | {"kind": "top", "topic": k, "token_id": int(i) * tasks + me, "weight": float(D[i, k])} for i in top])

    return fn


def fit(bow: DataFrame, V: int, H: int = 500, K: int = 40, epochs: int = 15, batch_size: int = 64,
        lr: float = 1e-3, seed: int = 42, params: DataFrame | None = None,
        vocab: DataFrame | None = None, monitor_topics: int = 5, monitor_words: int = 8,
        docs: DataFrame | None = None, root: str | None = None):
    """M4: returns ``(params, training_log, monitor)``; ``training_log`` has
    ``(epoch, batch, docs, loss, recon, kl)`` per step, ``monitor`` the first
    topics' top words after every epoch (M8).  ``docs(doc_id)`` names the
    documents when some of them may be without a counted token.

    An epoch is one barrier stage of as many tasks as hold the model
    (FIT_TASK_BYTES each); documents stream through them.  Parameters and moments are kept under
    ``root`` (two epochs take turns), the best epoch's weights beside them; a fit
    that was stopped goes on after its last whole epoch."""
    spark = bow.sparkSession
    from quill.session import ensure_checkpoint_dir, materialize
    if root is None:
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quill-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    kept = Versions(spark, root)
    last = kept.last()
    if last is None:
        if params is None:
            params = init_params(spark, V, H, K, seed)
        heads = params_to_numpy(params.where(~F.col("layer").isin("enc", "dec", "dec_b")), FIT_PARAMS)
        H, K = heads["mu"].shape
        # a task more costs two exchanges a step, of a second each: as few as hold the model
        tasks = max(1, -(-V * (H + K + 1) * 3 * FIT_DTYPE().nbytes // FIT_TASK_BYTES))
        kept.write("state", "first", _first_state(params, heads, tasks))
        state, step, best = kept.read("state", "first"), 0, None
    else:
        row = kept.log().where(F.col("epoch") == last).first()
        H, K, tasks, step = row["hidden"], row["topics"], row["tasks"], row["steps"]
        best = (row["best_loss"], row["best_epoch"], row["best_slot"])
        state = kept.read("state", row["slot"]).where("kind = 'state'")
    ent = materialize(_doc_entries(bow, docs)) if (-1 if last is None else last) < epochs - 1 else None
    for epoch in range(0 if last is None else last + 1, epochs):
        batched = materialize(ent.join(minibatches(ent.select("doc_id"), epoch, batch_size, seed), on="doc_id").select("batch", "doc_id", "e"))
        run = _epoch_fn(tasks, V, H, K, epoch, step, lr, seed, monitor_topics, monitor_words, FIT_BLOCK)
        slot = f"turn={epoch % 2}"
        # a row is a chunk of parameters and moments or a batch of documents: few at a time, or a frame holds the task's whole model
        with _few_rows(spark, FIT_ROWS):
            kept.write("state", slot, _epoch_input(state.select(*[c.split()[0] for c in STATE.split(", ")]), batched, tasks).mapInPandas(run, _DONE, barrier=True))
        done = kept.read("state", slot)
        state = done.where("kind = 'state'")
        log = done.where("kind = 'log'").select("batch", "docs", "loss", "recon", "kl")
        loss, batches = log.agg(F.avg("loss"), F.count(F.lit(1))).first()
        step += batches
        if loss is not None and (best is None or loss < best[0]):
            best = (loss, epoch, "turn=0" if best and best[2] == "turn=1" else "turn=1")
            kept.write("best", best[2], state.select("task", "layer", "chunk", "w"))
        if vocab is not None:
            w = Window.partitionBy("topic").orderBy(F.col("weight").desc(), F.col("token_id").desc())
            top = done.where("kind = 'top'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= monitor_words)
            kept.write("monitor", f"epoch={epoch}", top.select("topic", "rank", "token_id"))
        facts = {"steps": step, "slot": slot, "tasks": tasks, "hidden": H, "topics": K, "best_loss": best and best[0], "best_epoch": best and best[1], "best_slot": best and best[2]}
        kept.commit(epoch, log.select("*", *[F.lit(v).alias(k) for k, v in facts.items()]).coalesce(1))
    log = kept.log() if epochs else None
    log = spark.createDataFrame([], "epoch int, batch int, docs int, loss double, recon double, kl double") if log is None else log.where(F.col("epoch") < epochs).select("epoch", "batch", "docs", "loss", "recon", "kl")
    mon = spark.createDataFrame([], "epoch int, topic int, rank int, token_id int")
    if vocab is not None and epochs:
        mon = spark.read.parquet(f"{kept.root}/monitor").select(F.col("epoch").cast("int").alias("epoch"), "topic", "rank", "token_id").join(vocab, on="token_id")
    return _params_of(state, tasks, H, K), log, mon


def best_params(kept: Versions) -> tuple[int, DataFrame]:
    """The epoch with the lowest mean loss (the earliest of equals) and its kept parameters."""
    row = kept.log().orderBy(F.col("epoch").desc()).first()
    return row["best_epoch"], _params_of(kept.read("best", row["best_slot"]), row["tasks"], row["hidden"], row["topics"])


def _params_of(state: DataFrame, tasks: int, H: int, K: int) -> DataFrame:
    """The parameter table of kept bytes; the decoder's bias is put together at the end."""
    from quill.session import materialize
    fit_block = FIT_BLOCK
    width = {"enc": H, "dec": K + 1, "enc_b": H, "mu": K, "mu_b": K, "lv": K, "lv_b": K}

    def fn(batches):
        for pdf in batches:
            for task, layer, chunk, w in zip(pdf["task"], pdf["layer"], pdf["chunk"], pdf["w"]):
                W = np.frombuffer(w, FIT_DTYPE).reshape(-1, width[layer]).astype(np.float64)
                if task < 0:
                    yield pd.DataFrame({"layer": layer, "row": np.arange(len(W), dtype=np.int32), "values": list(W)})
                    continue
                row = ((chunk * fit_block + np.arange(len(W))) * tasks + task).astype(np.int32)
                yield pd.DataFrame({"layer": layer, "row": row, "values": list(W[:, :K] if layer == "dec" else W)})
                if layer == "dec":
                    yield pd.DataFrame({"layer": "dec_b", "row": row, "values": list(W[:, K:])})

    rows = materialize(state.select("task", "layer", "chunk", "w").mapInPandas(fn, "layer string, row int, values array<double>"))
    parts = F.array_sort(F.collect_list(F.struct("row", "values")))
    bias = rows.where("layer = 'dec_b'").agg(F.flatten(F.transform(parts, lambda x: x["values"])).alias("values"))
    return rows.where("layer <> 'dec_b'").unionByName(bias.select(F.lit("dec_b").alias("layer"), F.lit(0).alias("row"), "values"))


def training_log_summary(log: DataFrame) -> DataFrame:
    """Unweighted mean over batches per epoch."""
    return log.groupBy("epoch").agg(F.avg("loss").alias("avg_loss"), F.avg("recon").alias("avg_recon"),
                                    F.avg("kl").alias("avg_kl"), F.count(F.lit(1)).alias("batches"))


def best_epoch(summary: DataFrame, metric: str = "avg_loss", minimize: bool = True) -> DataFrame:
    """The epoch with the best metric; strict improvement, so the
    earliest epoch wins ties."""
    key = F.struct((F.col(metric) if minimize else -F.col(metric)).alias("m"), F.col("epoch").alias("e"))
    return summary.agg(F.min(key).alias("b")).select(F.col("b.e").alias("epoch"),
                                                     (F.col("b.m") if minimize else -F.col("b.m")).alias(metric))
