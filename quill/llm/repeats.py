"""Anchored runs of windows: how suffix_dedup and substring_dedup find equal
windows of a fixed number of symbols (bytes or words) without a row per position.

The anchor of a window is its minimiser: of the k-symbol grams inside it, the
one with the least hash, the leftmost if two are equal.  Equal windows have
equal anchors at the same offset, and consecutive windows share theirs: a *run*
is a maximal stretch of windows with one anchor, and its *slab* is the symbols
those windows cover.  Windows can only be equal if their runs have the same
gram, so runs with a gram of their own are finished at once, and equal slabs
need no text to be told equal.  Only grams with two different slabs have their
slabs fetched and compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm import common as C

_PLACE = 26  # bits of a place in a slice; the hash has the others
SLICE = 1 << 22  # symbols; a longer text is worked on in slices

#: A text's symbols: 64-bit values, and offsets of the rows of the block.
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def byte_symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return C.BYTE_VALUE[data], off


def word_symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, stops, first = C.word_bounds(data, off)
    return C.word_hashes(data, starts, stops), first


def runs_of(values: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """row, start (from the row's), number of windows, offset of the anchor from
    the start, hash of the gram, hash of the slab: of each run."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(values)
    if n < window:
        return none
    prefix = C.prefix_hash(values)
    at = np.arange(n - gram + 1)
    grams = C.range_hash(prefix, at, at + gram)
    place = np.uint64((1 << _PLACE) - 1)
    least = C.sliding_min((grams & ~place) | at.astype(np.uint64), window - gram + 1)
    sizes = np.maximum(0, np.diff(off) - window + 1)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    if not len(rows):
        return none
    starts = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + off[rows]
    anchor = (least[starts] & place).astype(np.int64)
    new = np.ones(len(rows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(rows)))
    start, anchor, rows = starts[first], anchor[first], rows[first]
    slab = C.range_hash(prefix, start, start + count - 1 + window)
    return rows, start - off[rows], count, anchor - start, grams[anchor], slab


def _slices(values: np.ndarray, off: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(symbols before the slice, values, offsets): the block as it is, or a long row in parts."""
    if len(values) <= SLICE or len(off) > 2:
        yield 0, values, off
        return
    for s in range(0, len(values) - window + 1, SLICE - window + 1):
        part = values[s : s + SLICE]
        yield s, part, np.array([0, len(part)])


_RUNS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("gram", pa.int64()), ("slab", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int32())])


def keyed(docs: DataFrame) -> DataFrame:
    """(id, th, text): th tells rows of the same id apart."""
    return C.columns(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "text")


def runs(keyed_docs: DataFrame, symbols: Symbols, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, off in C.text_blocks(b.column(2)):
                values, bounds = symbols(data, off)
                for before, part, edge in _slices(values, bounds, window):
                    rows, start, count, anchor, grams, slab = runs_of(part, edge, window, gram)
                    take = pa.array(i + rows)
                    yield C.batch(_RUNS, b.column(0).take(take), b.column(1).take(take), C.signed(grams), C.signed(slab), before + start, count.astype(np.int32), anchor.astype(np.int32))

    return keyed_docs.mapInArrow(run, "id long, th long, gram long, slab long, start long, windows int, anchor int")


def of_repeated_grams(table: DataFrame) -> DataFrame:
    """The runs whose gram has another run, written: the others are finished."""
    table = C.cut(table)
    grams = C.cut(table.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    return C.cut(table.join(grams, "gram"))


def spread(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slabs, disputed): distinct slabs with several copies, their number and
    least place; and the slabs whose gram has different ones.  Both counts are
    pre-aggregated before their shuffles, so copies meet as numbers."""
    slabs = table.groupBy("gram", "slab", "windows", "anchor").agg(F.count("*").alias("copies"), F.min(F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("order"), "start", "id", "th")).alias("at"))
    slabs = C.cut(slabs)
    several = C.cut(slabs.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    return slabs.where("copies > 1"), slabs.join(several, "gram")


def fetch(keyed_docs: DataFrame, slabs: DataFrame, symbols: Symbols, window: int, as_bytes: bool) -> DataFrame:
    """``slabs`` with their symbols (bytes, or 64-bit values) as ``content``,
    cut from the whole text of the place they are first at."""
    wanted = slabs.select(F.col("at.id").alias("of"), F.col("at.th").alias("of_th"), F.struct("gram", "slab", F.col("at.start").alias("start"), "windows", "anchor", F.col("at.order").alias("order"), "kinds").alias("s"))
    per_doc = C.cut(wanted.groupBy("of", "of_th").agg(F.collect_list("s").alias("s")))  # as many as a text has runs
    # not sent even if small: texts are shuffled at every size, so disk follows the input
    joined = keyed_docs.hint("shuffle_merge").join(per_doc, F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")))
    schema = pa.schema([("gram", pa.int64()), ("slab", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int32()), ("order", pa.int64()), ("kinds", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            for i, j, data, off in C.text_blocks(b.column(0)):
                values, bounds = (data, off) if as_bytes else symbols(data, off)
                s = lists.slice(i, j - i).flatten()
                if isinstance(s, pa.ChunkedArray):
                    s = s.combine_chunks()
                n = np.asarray(pa.compute.list_value_length(lists.slice(i, j - i)))
                f = {x: s.field(x) for x in ("gram", "slab", "start", "windows", "anchor", "order", "kinds")}
                begin = bounds[np.repeat(np.arange(j - i), n)] + f["start"].to_numpy()
                end = begin + f["windows"].to_numpy() - 1 + window
                yield C.batch(schema, f["gram"], f["slab"], f["windows"], f["anchor"], f["order"], f["kinds"], [values[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist())])

    return joined.select("text", "s").mapInArrow(run, "gram long, slab long, windows int, anchor int, order long, kinds long, content binary")


def flag_spans(flags: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of flagged consecutive windows: owner, first and last place."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (owner[at[1:]] != owner[at[:-1]]) | (place[at[1:]] != place[at[:-1]] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return owner[at[first]], place[at[first]], place[at[last]]


def covered(table: DataFrame, whole: DataFrame, parts: DataFrame, window: int) -> DataFrame:
    """(id, th, spans): covered stretches of each text in symbols.  ``whole``:
    slabs with several copies.  ``parts``: (gram, slab, first, last) of windows covered inside a slab."""
    w = whole.select(F.col("gram").alias("g"), F.col("slab").alias("s"))
    same = (F.col("gram") == F.col("g")) & (F.col("slab") == F.col("s"))
    full = table.join(w, same).select("id", "th", F.struct("start", (F.col("start") + F.col("windows") - 1 + window).alias("end")).alias("x"))
    p = parts.select(F.col("gram").alias("g"), F.col("slab").alias("s"), "first", "last")
    some = table.join(p, same).select("id", "th", F.struct((F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + window).alias("end")).alias("x"))
    return full.unionAll(some).groupBy("id", "th").agg(F.collect_list("x").alias("spans"))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def with_spans(keyed_docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, text, spans) of every document; without covered stretches spans is null."""
    found = C.cut(spans)
    f = found.select(F.col("id").alias("of"), F.col("th").alias("of_th"), "spans")
    return keyed_docs.hint("shuffle_merge").join(f, F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")), "left").select("id", "text", "spans")
