"""Document fingerprints by content-defined chunking.

A gear hash runs over the bytes of a text; a chunk ends where the hash's top
bits are zero, with a harder condition before the normal size and an easier one
after it (normalised chunking), between a least and a greatest size.  The hash
depends on the last 16 bytes only, so boundaries move with the text.  The
fingerprint is the set of (40-bit digest, length) of the chunks; likeness is
the share, by length, of a fingerprint's chunks that the other one contains.

Defined cases: a null text is an empty one; an empty text has the empty
fingerprint, which is like an empty one (1) and unlike any other (0); rows with
the same ``doc_id`` are neighbours in the order of their texts, a null one
comes first; a single document is its own next one; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm import common as C

MIN_SIZE, NORMAL_SIZE, MAX_SIZE = 12, 48, 160
HARD_BITS, EASY_BITS = 7, 4
GEAR = (C.BYTE_VALUE >> np.uint64(48)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[data[i]] in 16 bits, by doubling the window."""
    h = GEAR[data]
    for span in (1, 2, 4, 8):
        if len(h) > span:
            more = h.copy()
            more[span:] += h[:-span] << np.uint16(span)
            h = more
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    if n == 0:
        return []
    h = gear(data)
    hard = (np.flatnonzero(h >> np.uint16(16 - HARD_BITS) == 0) + 1).tolist()
    easy = (np.flatnonzero(h >> np.uint16(16 - EASY_BITS) == 0) + 1).tolist()
    hard.append(n)
    easy.append(n)
    out, at = [], 0
    while at < n:
        end = hard[bisect_left(hard, min(at + MIN_SIZE, n))]
        if end > at + NORMAL_SIZE:
            end = min(easy[bisect_left(easy, min(at + NORMAL_SIZE, n))], at + MAX_SIZE)
        out.append(end)
        at = end
    return out


def chunks(data: np.ndarray) -> np.ndarray:
    """The sorted distinct 48-bit values of a text's chunks: digest, then length."""
    ends = np.array(cuts(data), dtype=np.int64)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    digest = C.range_hash(C.prefix_hash(C.BYTE_VALUE[data]), starts, ends)
    return np.unique(digest >> np.uint64(24) << np.uint64(8) | (ends - starts).astype(np.uint64))


def weight(values: np.ndarray) -> int:
    return int((values & np.uint64(0xFF)).sum())


def likeness(own: np.ndarray, other: np.ndarray) -> float:
    """Share of ``own`` by length that ``other`` contains."""
    total = weight(own)
    if not total:
        return 0.0 if len(other) else 1.0
    return weight(np.intersect1d(own, other, assume_unique=True)) / total


def text_of(values: np.ndarray) -> str:
    """Eight characters a chunk."""
    return base64.b64encode(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8)


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text; nothing is shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield C.batch(schema, b.column(0), [len(t) for t in texts], [text_of(chunks(_bytes(t))) for t in texts])

    return C.columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, is_next, doc_id, text): documents dealt out by ranges of
    ``doc_id`` and sorted inside them; each range ends with a copy of the first
    document after it (the first of all after the last).  Texts are shuffled
    once.  The driver gets one id per range."""
    spark = docs.sparkSession
    d = C.columns(docs, "doc_id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    low = -(1 << 63)
    ids = d.select(F.coalesce("doc_id", F.lit(low)).alias("id"))
    found = ids.stat.approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = np.unique(np.array(found or [], dtype=np.int64))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for b in batches:
            x = b.column(0).to_numpy()
            for k, v in zip(np.searchsorted(bounds, x, side="left").tolist(), x.tolist()):
                if v < best.get(k, v + 1):
                    best[k] = v
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], names=["bucket", "id"])

    heads = sorted(ids.mapInArrow(least, "bucket int, id long").groupBy("bucket").agg(F.min("id").alias("id")).collect())
    before = {r["id"]: heads[k - 1]["bucket"] for k, r in enumerate(heads)}
    schema = pa.schema([("bucket", pa.int32()), ("is_next", pa.bool_()), ("doc_id", pa.int64()), ("text", pa.string())])
    head_ids = np.array(sorted(before), dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1).fill_null("").cast(pa.string())
            x = b.column(0).fill_null(low).to_numpy()
            yield C.batch(schema, np.searchsorted(bounds, x, side="left").astype(np.int32), np.zeros(len(x), bool), b.column(0), text)
            again = np.flatnonzero(np.isin(x, head_ids))
            if len(again):
                at = pa.array(again)
                yield C.batch(schema, [before[v] for v in x[again].tolist()], np.ones(len(again), bool), b.column(0).take(at), text.take(at))

    dealt = d.mapInArrow(deal, "bucket int, is_next boolean, doc_id long, text string")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "is_next", F.col("doc_id").asc_nulls_first(), "text")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form (the last quarter
    replaced by the beginning of the next document), and both likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # bucket, is_next, doc_id, text, chunks
        rows: list[tuple] = []
        for b in batches:
            for bucket, is_next, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                own = chunks(_bytes(text))
                if last and last[0] == bucket and not last[1]:
                    rows.append(_pair(last, text, own))
                last = (bucket, is_next, doc, text, own)
                if len(rows) >= 2000:
                    yield _rows(rows)
                    rows = []
        yield _rows(rows)

    return in_order(docs).mapInArrow(run, _DDL)


def _pair(row: tuple, text: str, following: np.ndarray) -> tuple:
    _, _, doc, own, prints = row
    k = len(own) // 4
    changed = own[: len(own) - k] + text[:k]
    other = chunks(_bytes(changed))
    return doc, len(own), hashlib.sha256(changed.encode()).hexdigest(), text_of(prints), text_of(other), likeness(prints, other), likeness(prints, following)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_OUT), _OUT)], schema=_OUT)
