"""Line deduplication by a segment-partition edit join.

Lines are compared without their outer white space.  Equal lines are one line
from the start.  A line of l characters is cut into ``DISTANCE + 1`` segments;
two lines within the distance agree in one segment at least, so each line looks
up, for every possible length of a shorter or equally long partner, the
substrings at the few places where an agreeing segment of that length's layout
can stand.  Lines that meet are verified by banded bit-parallel edit distance.
Where very many lines share a segment, only those are paired whose counts of
characters and of character pairs are near enough: an edit changes few of them.
Linked lines form classes; the first line of a class, by (doc_id, line), stays.

Lines of less than ``MIN_CHARS`` characters are only compared for equality: two
edits would make most short lines alike.

Defined cases: null texts have no lines; blank lines are never duplicates and
stay; rows that repeat a ``doc_id`` with the same text are one document (their
lines stay or go together); a null ``doc_id`` comes first; an empty table gives
an empty result; other columns are not read by ``line_classes`` and pass through
``deduplicated``, which drops the documents that had a line and lost them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm import common as C

DISTANCE = 2
MIN_CHARS = 20
#: Lines of one segment from which on pairs are first held to their profiles.
CROWDED = 20
CLASSES = 32

_ODD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_LINES = pa.schema([
    ("id", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("chars", pa.int32()),
    ("keys", pa.list_(pa.int64())),
])
_DDL = "id long, th long, line int, h1 long, h2 long, chars int, keys array<long>"


def line_bounds(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, number, start and end of the lines that are not blank, without their
    outer white space; ``codes`` are code points."""
    breaks = np.flatnonzero(codes == 10)
    starts = np.concatenate([off[:-1], breaks + 1])
    rows = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, side="right") - 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.empty_like(starts)
    ends[:-1] = np.where(rows[1:] == rows[:-1], starts[1:] - 1, off[rows[:-1] + 1])
    ends[-1:] = off[-1]
    number = np.arange(len(rows)) - np.searchsorted(rows, rows)
    solid = np.flatnonzero((codes != 32) & ((codes < 9) | (codes > 13)))
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = b > a
    return rows[full], number[full], solid[a[full]], solid[b[full] - 1] + 1


def layout(chars: np.ndarray, segment: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of a segment in lines of so many characters: the later
    segments take the characters left over."""
    base, extra = chars // (distance + 1), chars % (distance + 1)
    longer = np.maximum(0, segment - (distance + 1 - extra))
    return segment * base + longer, base + (segment >= distance + 1 - extra)


def segment_keys(prefix: np.ndarray, start: np.ndarray, chars: np.ndarray, distance: int, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) pairs.  The key of an own segment is even, that of a
    substring looked up is the same with the lowest bit set."""
    owner, keys = [], []
    everyone = np.arange(len(start))
    for less in range(distance + 1):
        size_of = chars - less
        for s in range(distance + 1):
            p, size = layout(size_of, s, distance)
            salt = (size_of.astype(np.uint64) << np.uint64(8)) | np.uint64(s)
            low = np.maximum(p - s, p + less - (distance - s))
            high = np.minimum(p + s, p + less + (distance - s))
            for shift in range(-distance, 2 * distance + 1):
                at = p + shift
                ok = (at >= low) & (at <= high) & (at >= 0) & (at + size <= chars) & (size_of >= min_chars)
                if not ok.any():
                    continue
                b = start[ok] + at[ok]
                k = C.mix(C.range_hash(prefix, b, b + size[ok]) ^ C.mix(salt[ok])) & ~np.uint64(1)
                if less == 0 and shift == 0:
                    owner.append(everyone[ok])
                    keys.append(k)
                owner.append(everyone[ok])
                keys.append(k | np.uint64(1))
    return (np.concatenate(owner), np.concatenate(keys)) if owner else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def lines(keyed: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line that is not blank: its place, two hashes of its
    characters, and its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2)
            for i, j in C.row_blocks(C.utf8(column)[1]):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
                off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                rows, number, start, end = line_bounds(codes, off)
                wide = codes.astype(np.uint64) + np.uint64(1)
                prefix = C.prefix_hash(wide * _ODD[0])
                h1 = C.range_hash(prefix, start, end)
                h2 = C.range_hash(C.prefix_hash(wide * wide * _ODD[1]), start, end)
                chars = end - start
                owner, keys = segment_keys(prefix, start, chars, distance, min_chars)
                order = np.argsort(owner, kind="stable")
                take = pa.array(i + rows)
                yield C.batch(_LINES, b.column(0).take(take), b.column(1).take(take), number.astype(np.int32), C.signed(h1), C.signed(h2), chars.astype(np.int32), C.list_array(pa.array(C.signed(keys[order])), np.bincount(owner, minlength=len(rows))))

    return keyed.mapInArrow(run, _DDL)


def within(a: list[str], b: list[str], distance: int) -> np.ndarray:
    """Whether each pair is within the edit distance.  One 64-bit word a pair
    holds the vertical differences of the band of 2 * distance + 1 diagonals;
    all pairs advance by one character of the shorter text at a time."""
    n = len(a)
    swap = [len(x) < len(y) for x, y in zip(a, b)]
    long_ = [y if s else x for x, y, s in zip(a, b, swap)]
    short = [x if s else y for x, y, s in zip(a, b, swap)]
    m = np.array([len(x) for x in long_], np.int64)
    k = np.array([len(x) for x in short], np.int64)
    out = np.full(n, distance + 1, np.int64)
    live = np.flatnonzero((m - k <= distance) & (m > distance))
    for x in np.flatnonzero((m - k <= distance) & (m <= distance)):
        out[x] = m[x] if m[x] <= distance else distance + 1  # so few characters can all be replaced
    if not len(live):
        return out <= distance
    live = live[np.argsort(-k[live], kind="stable")]
    m, k = m[live], k[live]
    width = int(m.max()) + 2 * distance + 2
    table = np.zeros((len(live), width), np.uint32)
    other = np.zeros((len(live), int(k.max()) + 1), np.uint32)
    for r, x in enumerate(live):
        table[r, distance : distance + m[r]] = np.frombuffer(long_[x].encode("utf-32-le"), np.uint32) + np.uint32(1)
        other[r, : k[r]] = np.frombuffer(short[x].encode("utf-32-le"), np.uint32) + np.uint32(1)
    one = np.uint64(1)
    top = np.uint64(63)
    vp = np.full(len(live), ((1 << (distance + 1)) - 1) << (63 - distance), np.uint64)
    vn = np.zeros(len(live), np.uint64)
    score = np.full(len(live), distance, np.int64)
    row_bit = np.full(len(live), 62, np.uint64)
    for j in range(int(k.max())):
        c = int(np.searchsorted(-k, -j, side="left"))  # pairs with more than j characters
        pv, nv, ch = vp[:c], vn[:c], other[:c, j]
        match = np.zeros(c, np.uint64)
        for d in range(2 * distance + 1):
            match |= (table[:c, j + d] == ch).astype(np.uint64) << np.uint64(63 - 2 * distance + d)
        d0 = (((match & pv) + pv) ^ pv) | match | nv
        hp = nv | ~(d0 | pv)
        hn = d0 & pv
        down = j < m[:c] - distance
        score[:c] += np.where(down, 1 - (d0 >> top & one).astype(np.int64), (hp >> row_bit[:c] & one).astype(np.int64) - (hn >> row_bit[:c] & one).astype(np.int64))
        row_bit[:c] -= np.where(down, 0, 1).astype(np.uint64)
        d0 >>= one
        vp[:c] = hn | ~(d0 | hp)
        vn[:c] = d0 & hp
    out[live] = score
    return out <= distance


def _texts(keyed: DataFrame, distinct: DataFrame, ids: DataFrame) -> DataFrame:
    """(line_id, t) of the named lines, cut from the text of their first place."""
    wanted = distinct.join(C.small(C.cut(ids)), F.col("line_id") == F.col("of")).select("line_id", F.col("first.id").alias("in"), F.col("first.th").alias("in_th"), F.col("first.line").alias("at"))
    per_doc = C.cut(wanted.groupBy("in", "in_th").agg(F.collect_list(F.struct("line_id", "at")).alias("want")))  # as many as a text has lines
    found = keyed.join(C.small(per_doc), F.col("id").eqNullSafe(F.col("in")) & (F.col("th") == F.col("in_th"))).select(F.split("text", "\n", -1).alias("l"), "want")
    return found.select("l", F.explode("want").alias("w")).select(F.col("w.line_id").alias("line_id"), F.btrim(F.col("l")[F.col("w.at")], F.lit(" \t\n\x0b\f\r")).alias("t")).dropDuplicates(["line_id"])


def _profiles(texts: DataFrame) -> DataFrame:
    """(line_id, profile): counts of the line's characters, then of its pairs of
    neighbouring characters, each in CLASSES classes by hash."""
    schema = pa.schema([("line_id", pa.int64()), ("profile", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                codes = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
                pairs = codes[:-1] * np.uint64(0x10FFFF) + codes[1:]
                rows.append(np.concatenate([np.bincount((C.mix(x) % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES) for x in (codes, pairs)]))
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield C.batch(schema, b.column(0), C.list_array(pa.array(flat.astype(np.int32)), np.full(len(rows), 2 * CLASSES)))

    return texts.mapInArrow(run, "line_id long, profile array<int>")


def _apart(first: int) -> str:
    """SQL for the sum of the differences of two profiles' counts from there on."""
    return " + ".join(f"abs(p[{k}] - q[{k}])" for k in range(first, first + CLASSES))


def _verify(pairs: DataFrame, texts: DataFrame, distance: int) -> DataFrame:
    both = pairs.join(texts.select(F.col("line_id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("line_id").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo in range(0, x.num_rows, 2048):
                part = x.slice(lo, 2048)
                ok = within(part.column(2).to_pylist(), part.column(3).to_pylist(), distance)
                yield part.select([0, 1]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long")


def _keyed(docs: DataFrame) -> DataFrame:
    return C.columns(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "text")


def line_classes(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(lines, distinct): every line with its hashes; and per distinct line its
    first place, number of occurrences and links, and the first place of its class."""
    keyed = _keyed(docs)
    every = C.cut(lines(keyed, distance, min_chars))
    place = F.struct("id", "th", "line")
    distinct = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.min_by("keys", place).alias("keys"))
    distinct = C.cut(distinct.withColumn("line_id", F.monotonically_increasing_id()))
    entries = distinct.select("line_id", F.explode("keys").alias("key"))
    own = entries.where(F.col("key").bitwiseAND(1) == 0).select(F.col("line_id").alias("x"), "key")
    looked = entries.where(F.col("key").bitwiseAND(1) == 1).select(F.col("line_id").alias("y"), (F.col("key") - 1).alias("key"))
    crowded = C.cut(own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("key"))
    hot = C.small(crowded)
    met = own.join(hot, "key", "left_anti").join(looked, "key").where("x <> y").select("x", "y")
    own_hot, looked_hot = C.cut(own.join(hot, "key")), C.cut(looked.join(hot, "key"))
    lines_hot = own_hot.select(F.col("x").alias("of")).unionAll(looked_hot.select("y")).distinct()
    profiles = C.cut(_profiles(_texts(keyed, distinct, lines_hot)))
    one = own_hot.join(C.small(profiles.select(F.col("line_id").alias("x"), F.col("profile").alias("p"))), "x")
    two = looked_hot.join(C.small(profiles.select(F.col("line_id").alias("y"), F.col("profile").alias("q"))), "y")
    near = F.expr(f"x <> y and {_apart(0)} <= {2 * distance} and {_apart(CLASSES)} <= {4 * distance}")
    met_hot = one.alias("one").join(two.alias("two"), (F.col("one.key") == F.col("two.key")) & near).select("x", "y")
    pairs = C.cut(met.unionAll(met_hot).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    texts = C.cut(_texts(keyed, distinct, pairs.select(F.col("a").alias("of")).unionAll(pairs.select("b")).distinct()))
    links = C.cut(_verify(pairs, texts, distance))
    degree = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    groups = C.cut(C.components(links))
    member = C.cut(degree.join(groups, F.col("node") == F.col("id"), "left").select("node", "links", F.coalesce("component", "node").alias("component")))
    named = distinct.drop("keys").join(C.small(member), F.col("line_id") == F.col("node"), "left").select("h1", "h2", "first", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "line_id").alias("component"))
    linked = named.where("links > 0").groupBy(F.col("component").alias("of")).agg(F.min("first").alias("head"))
    named = named.join(C.small(C.cut(linked)), (F.col("component") == F.col("of")) & (F.col("links") > 0), "left").select("h1", "h2", "first", "times", "links", F.coalesce("head", "first").alias("head"))
    return every.drop("keys"), C.cut(named)


def decisions(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, th, n_lines, n_links, gone): per text, its lines that are not blank,
    the links of its lines to different ones, and the lines that go, each with
    the place of the one that stays for it.  Hot lines are split by the join's
    skew handling; lines without copies or links are not joined at all."""
    every, distinct = line_classes(docs, distance, min_chars)
    active = C.cut(distinct.where("times > 1 or links > 0").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "links", "head"))
    per_line = every.join(C.small(active), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    goes = F.col("head").isNotNull() & (F.col("head") != F.struct("id", "th", "line"))
    out = F.when(goes, F.struct("line", F.col("head.id").alias("to_id"), F.col("head.line").alias("to_line")))
    return per_line.groupBy("id", "th").agg(F.countDistinct("line").alias("n_lines"), F.sum(F.coalesce("links", F.lit(0))).alias("n_links"), F.array_sort(F.collect_set(out)).alias("gone"))


def summary(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: lines, lines removed, links, and as ``removed`` the number
    of each removed line with the document and line that stays for it."""
    d = C.cut(decisions(docs, distance, min_chars)).select(F.col("id").alias("of"), F.col("th").alias("of_th"), "n_lines", "n_links", "gone")
    keyed = _keyed(docs).select("id", "th")
    out = keyed.join(C.small(d), F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")), "left")
    text = F.concat_ws(",", F.transform("gone", lambda x: F.concat_ws(":", x["line"].cast("string"), F.coalesce(x["to_id"].cast("string"), F.lit("")), x["to_line"].cast("string"))))
    zero = F.lit(0)
    return out.select(F.col("id").alias("doc_id"), F.coalesce("n_lines", zero).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), zero).cast("long").alias("n_removed"), F.coalesce("n_links", zero).cast("long").alias("n_links"), F.when(F.col("gone").isNotNull(), text).otherwise("").alias("removed"))


def deduplicated(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without their removed lines, columns as they came."""
    gone = C.cut(decisions(docs, distance, min_chars).where(F.size("gone") > 0).select(F.col("id").alias("of"), F.col("th").alias("of_th"), "n_lines", F.transform("gone", lambda x: x["line"]).alias("drop")))
    own = [f"__own_{i}" for i in range(len(docs.columns))]
    name = {c.lower(): o for o, c in reversed(list(zip(own, docs.columns)))}
    text, n_chars = name["text"], name.get("n_chars")
    kept = docs.toDF(*own)
    rows = kept.withColumn("__th", F.coalesce(F.xxhash64(F.col(text).cast("string")), F.lit(0)))
    rows = rows.join(C.small(gone), F.col(name["doc_id"]).cast("long").eqNullSafe(F.col("of")) & (F.col("__th") == F.col("of_th")), "left").where("drop is null or size(drop) < n_lines")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("drop"), i)), "\n")
    rows = rows.withColumn(text, F.when(F.col("drop").isNull(), F.col(text)).otherwise(left))
    if n_chars:
        rows = rows.withColumn(n_chars, F.when(F.col("drop").isNull(), F.col(n_chars)).otherwise(F.length(text)).cast(kept.schema[n_chars].dataType))
    return rows.select(*own).toDF(*docs.columns)
