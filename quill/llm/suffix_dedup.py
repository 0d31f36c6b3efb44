"""Suffix-array deduplication: every byte covered by a 400-byte string that also
starts elsewhere goes.

The suffix array is sparse: suffixes begin at anchors (see ``repeats``), one for
each stretch of strings that share theirs.  Suffixes of anchors that occur in
different surroundings are range-partitioned by their leading bytes with
sampled splitters; a bucket sorts its strings locally by multikey quicksort
(eight bytes a step, only groups that are still equal go on), so strings that
stay together for 400 bytes are its repeats.  A bucket holds whole groups.  One of
more than ``GROUP`` slabs (a passage in a third of all documents) is divided by
what stands around its gram: its slabs get anchors of ``FINE`` bytes, which equal
strings share as well, and those of one such anchor are a group again.  A group
that is still too large has its strings compared across buckets by their hashes;
a slab then has at most ``WINDOW - FINE + 1`` of them.

Defined cases: null texts are empty; a text of less than 400 bytes keeps all of
its bytes; rows that repeat a document repeat its strings; a string that
overlaps its own repeat counts; rows with a null ``doc_id`` are documents like
others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm import common as C
from quill.llm import repeats as R

WINDOW = 400  # a multiple of 8
GRAM = 128
LEAD = 64
#: Bytes of an anchor inside groups that are too large.
FINE = 384
#: Slabs a bucket holds on average.
BUCKET = 4_000
#: Slabs up to which a group stays in one bucket.
GROUP = 512


def multikey_sort(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the ``depth``-byte strings that begin at ``at``, inside groups that
    ascend; returns the places of those equal to another of their group, and
    their groups.  Each step takes the next eight bytes as one key, splits the
    groups by it and drops strings that are alone."""
    wide = np.lib.stride_tricks.as_strided(data, (max(len(data) - 7, 0), 8), (1, 1)) if len(data) >= 8 else np.zeros((0, 8), np.uint8)
    for step in range(0, depth, 8):
        if not len(at):
            break
        key = np.ascontiguousarray(wide[at + step]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((key, group))
        at, key, group = at[order], key[order], group[order]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        alone = new.copy()
        alone[:-1] &= new[1:]
        at, group = at[~alone], group[~alone]
    return at, group


_PART = pa.schema([("gram", pa.int64()), ("fine", pa.int64()), ("slab", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_PART_DDL = "gram long, fine long, slab long, first int, last int"


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted repeats of one bucket, which holds whole groups."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables).combine_chunks()
    key = list(zip(*(t.column(c).to_pylist() for c in ("lead", "gram", "fine"))))
    order = sorted(range(len(key)), key=key.__getitem__)
    t = t.take(pa.array(order)).combine_chunks()
    group = np.cumsum([True, *(key[x] != key[y] for x, y in zip(order[1:], order[:-1]))])
    gram, fine, slab, windows = (t.column(c).to_numpy() for c in ("gram", "fine", "slab", "windows"))
    data, off = C.utf8(t.column("content"))
    owner = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = off[owner] + place
    equal, _ = multikey_sort(data, at, group[owner], WINDOW)
    flags = np.zeros(len(at), bool)
    flags[np.searchsorted(at, equal)] = True
    own, first, last = R.flag_spans(flags, owner, place)
    yield C.batch(_PART, gram[own], fine[own], slab[own], first.astype(np.int32), last.astype(np.int32))


def sorted_parts(slabs: DataFrame) -> DataFrame:
    """(gram, fine, slab, first, last): strings inside slabs that other slabs of
    their group (gram, fine) hold too; a group is held by a task."""
    n = slabs.count()
    buckets = max(int(slabs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // BUCKET + 1)
    lead = F.expr(f"substring(content, anchor + 1, {LEAD})")
    ordered = slabs.select("gram", "fine", "slab", "windows", "content", lead.alias("lead"))
    return ordered.repartitionByRange(buckets, "lead", "gram", "fine").mapInArrow(_bucket, _PART_DDL)


_FINE = pa.schema([("gram", pa.int64()), ("slab", pa.int64()), ("fine", pa.int64()), ("piece", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("anchor", pa.int32())])


def fine_runs(slabs: DataFrame, size: int) -> DataFrame:
    """(gram, slab, fine, piece, start, windows, anchor): the runs of the slabs by
    anchors of ``size`` bytes; ``piece`` is the hash of what a run covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, off in C.text_blocks(b.column(2)):
                rows, start, count, anchor, grams, piece = R.runs_of(C.BYTE_VALUE[data], off, WINDOW, size)
                take = pa.array(i + rows)
                yield C.batch(_FINE, b.column(0).take(take), b.column(1).take(take), C.signed(grams), C.signed(piece), start.astype(np.int32), count.astype(np.int32), anchor.astype(np.int32))

    return slabs.select("gram", "slab", "content").mapInArrow(run, "gram long, slab long, fine long, piece long, start int, windows int, anchor int")


def _in_slabs(runs: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` (gram, fine, piece, first, last) as places in each slab that has the piece."""
    return runs.join(parts, ["gram", "fine", "piece"]).select("gram", "slab", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))


def divided_parts(slabs: DataFrame) -> DataFrame:
    """(gram, slab, first, last) of repeated strings in slabs of large groups."""
    runs = C.cut(fine_runs(slabs, FINE))
    pieces = C.cut(runs.groupBy("gram", "fine", "piece", "windows", "anchor").agg(F.count("*").alias("copies"), F.min(F.struct("slab", "start")).alias("at")))
    whole = _in_slabs(runs, pieces.where("copies > 1").select("gram", "fine", "piece", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last")))
    kinds = C.cut(pieces.groupBy("gram", "fine").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    open_ = pieces.join(kinds, ["gram", "fine"]).select("gram", "fine", "piece", "windows", "anchor", "kinds", F.col("at.slab").alias("slab"), F.col("at.start").alias("start"))
    open_ = C.cut(open_.join(slabs.select("gram", "slab", "content"), ["gram", "slab"]).withColumn("content", F.expr(f"substring(content, start + 1, windows - 1 + {WINDOW})")).drop("slab", "start"))
    near = sorted_parts(open_.where(F.col("kinds") <= GROUP).withColumnRenamed("piece", "slab")).withColumnRenamed("slab", "piece")
    # at WINDOW bytes a run is one string, and its anchor is its hash
    strings = C.cut(fine_runs(open_.where(F.col("kinds") > GROUP).select("gram", F.col("piece").alias("slab"), "content"), WINDOW))
    twice = strings.groupBy("gram", "fine").agg(F.count("*").alias("n")).where("n > 1").select("gram", "fine")
    far = strings.join(twice, ["gram", "fine"]).select("gram", F.col("slab").alias("piece"), F.col("start").alias("first"), F.col("start").alias("last"))
    far = open_.where(F.col("kinds") > GROUP).select("gram", "fine", "piece").join(far, ["gram", "piece"]).select("gram", "fine", "piece", "first", "last")
    return whole.unionAll(_in_slabs(runs, C.cut(near.unionAll(far))))


def repeated_parts(disputed: DataFrame) -> DataFrame:
    """(gram, slab, first, last): strings inside slabs that other slabs hold too."""
    near = sorted_parts(disputed.where(F.col("kinds") <= GROUP).withColumn("fine", F.lit(0).cast("long"))).select("gram", "slab", "first", "last")
    return near.unionAll(divided_parts(disputed.where(F.col("kinds") > GROUP)))


def repeated(docs: DataFrame) -> DataFrame:
    """(id, text, spans) of every document: the byte ranges to remove."""
    k = R.keyed(docs)
    table = R.of_repeated_grams(R.runs(k, R.byte_symbols, WINDOW, GRAM))
    whole, disputed = R.spread(table)
    parts = repeated_parts(C.cut(R.fetch(k, disputed, R.byte_symbols, WINDOW, True)))
    return R.with_spans(k, R.covered(table, whole, parts, WINDOW))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def digest(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = (text or "").encode()
                sha, at, gone, runs = hashlib.sha256(), 0, 0, 0
                if spans.is_valid:
                    x = spans.values
                    for s, e in R.union(list(zip(x.field(0).to_pylist(), x.field(1).to_pylist()))):
                        sha.update(data[at:s])
                        at, gone, runs = e, gone + e - s, runs + 1
                sha.update(data[at:])
                rows.append((doc, len(data), gone, runs, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _OUT)], schema=_OUT)

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Counts and digest of what is left of every document."""
    return digest(repeated(docs))
