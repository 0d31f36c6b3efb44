"""Jaccard join of documents on word 5-grams: a size-aware heavy-light join.

Sets that are equal are one set from the start.  Two different sets with
Jaccard similarity t share at least ``c`` elements of their short forms: the
first ``n - ceil(t * n) + c`` elements in a global order, so the join on
similarity is a join on an overlap of ``c``.  Light (small) sets enumerate all
subsets of ``c`` = 2 elements of the short form and meet in any one; heavy
(large) sets scan the inverted lists of their elements, where one shared
element (``c`` = 1) is enough to meet.  The boundary is where enumerating costs
as much as scanning, with the cost of a scan measured on the corpus.  Sets just
below the boundary are in the inverted lists as well, so every pair meets on
one side.

Two sets of n and m elements overlap in ``ceil(t / (1 + t) * (n + m))`` at
least (t as a fraction), so sets of like size must meet still earlier in their
orders than the short form reaches: entries carry their place, and a list pairs
only entries whose places allow it.

The order puts frequent elements last, so a passage that many documents share
makes no long lists.  Frequencies are counted over all documents (by 48 bits of
the element) and kept as levels in a table of fixed size; any level gives right
results, the levels only decide how short the lists are.

Groups of near copies are joined without their pairs: every list has a pivot,
the set that meets most others, and each set is compared with the pivots of its
lists (as many rows as list entries); then, for the groups so found, one set
of each group in a list is compared with that list's pivot, some rounds on.  What
is left are pairs of sets in one list but in different groups: these are all
compared, on their whole texts.  No pair inside a group is made.

Defined cases: null and empty texts (or such without words) have the empty set
and are linked with nothing; 1 to 4 words are one element; a null ``doc_id``
has no component and links nothing; rows that repeat a ``doc_id`` are one node; an empty table
gives an empty result; other columns are not read by ``classes`` and pass
through ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm import common as C

K = 5
SIMILARITY = 80  # percent
#: Elements in the subsets that light sets enumerate.
OVERLAP = 2
#: Rounds of comparing groups with the pivots of their lists.
ROUNDS = 2
#: Slots of the table of levels (one byte each), and the count of level 1.
SLOT_BITS = 23
SLOTS = 1 << SLOT_BITS
FREQUENT = 8
#: Bytes of text per group of the counting step: a group is held by a task, with its sorted copy.
COUNT_BYTES = 1 << 22


def gram_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of the distinct elements of each row, sorted."""
    starts, stops, first = C.word_bounds(data, off)
    n_words = np.diff(first)
    words = C.word_hashes(data, starts, stops, C.BYTE_VALUE_LOWER)
    row = np.repeat(np.arange(len(n_words)), n_words)
    grams = C.window_hashes(words, K)
    at = np.flatnonzero(row[: len(grams)] == row[K - 1 :]) if len(grams) else np.zeros(0, np.int64)
    few = np.flatnonzero((n_words > 0) & (n_words < K))
    whole = C.range_hash(C.prefix_hash(words), first[few], first[few + 1]) if len(few) else np.zeros(0, np.uint64)
    rows = np.concatenate([row[at], few])
    values = np.concatenate([grams[at], whole])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def least_shared(n: np.ndarray) -> np.ndarray:
    """Elements that a set of n shares with any similar one, at least."""
    return -(-SIMILARITY * n // 100)


def short_form(n: np.ndarray, overlap: int = OVERLAP) -> np.ndarray:
    return np.minimum(n, n - least_shared(n) + overlap)


def _slot(values: np.ndarray) -> np.ndarray:
    return (C.mix(values) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def levels(docs: DataFrame) -> tuple[np.ndarray, float]:
    """The table of levels, and the mean length of the list that an entry of
    an infrequent element stands in.  Each task packs the sorted distinct
    elements of its texts into one row per range of elements; the ranges are
    summed apart from each other."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(max(16, size // COUNT_BYTES))
    width = (1 << 48) // ranges + 1
    block = pa.schema([("part", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("counts", pa.binary())])

    def packed(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        edge = np.searchsorted(values, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
        # sorted values: their high bits repeat and compress away
        planes = (values >> np.uint64(32)).astype(np.uint16), values.astype(np.uint32), counts.astype(np.uint32)
        parts = [k for k in range(ranges) if edge[k] < edge[k + 1]]
        yield C.batch(block, parts, *([x[edge[k] : edge[k + 1]].tobytes() for k in parts] for x in planes))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for b in batches:
            for _, _, data, off in C.text_blocks(b.column(0)):
                values = gram_sets(data, off)[1] >> np.uint64(16)
                found.append(values)
                n += len(values)
                if n > 1 << 20:
                    yield from packed(found)
                    found, n = [], 0
        if n:
            yield from packed(found)

    def total(t):
        high, low, counts = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("high", np.uint16), ("low", np.uint32), ("counts", np.uint32)))
        values = high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
        order = np.argsort(values)
        values, counts = values[order], counts[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        counts, values = np.add.reduceat(counts, new), values[new]
        usual = counts[counts < FREQUENT].astype(np.float64)
        often = counts >= FREQUENT
        level = (np.log2(counts[often] / FREQUENT) + 1).astype(np.int32)
        return pa.table({
            "slot": pa.array(np.concatenate([[-1], _slot(values[often])]), pa.int64()), "level": pa.array(np.concatenate([[0], level]), pa.int32()),
            "scanned": np.concatenate([[(usual**2).sum()], np.zeros(len(level))]), "entries": np.concatenate([[usual.sum()], np.zeros(len(level))]),
        })

    rows = docs.select("text").mapInArrow(gather, "part int, high binary, low binary, counts binary")
    by_slot = rows.groupBy("part").applyInArrow(total, "slot long, level int, scanned double, entries double").groupBy("slot").agg(F.max("level").alias("level"), F.sum("scanned").alias("scanned"), F.sum("entries").alias("entries"))
    got = by_slot.toArrow()  # at most SLOTS + 1 rows
    table, scan = np.zeros(SLOTS, np.uint8), 1.0
    slot, level = got.column("slot").to_numpy(), got.column("level").to_numpy()
    table[slot[slot >= 0]] = np.minimum(255, level[slot >= 0])
    scanned, entries = (float(got.column(c).to_numpy().sum()) for c in ("scanned", "entries"))
    scan = scanned / entries if entries else scan
    return table, scan


def light_size(scan: float) -> int:
    """The largest set that is light: its C(s, 2) subsets cost no more than
    scanning the s lists of its short form, each ``scan`` entries long."""
    n = np.arange(1, 10_000)
    s = short_form(n)
    dear = np.flatnonzero(s * (s - 1) // 2 > s * (1.0 + scan))
    return int(n[dear[0]] - 1) if len(dear) else int(n[-1])


_KEYS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])


def short_forms(docs: DataFrame, table: np.ndarray, light: int) -> DataFrame:
    """(doc_id, n, d1, d2, keys, places): size and digest of each set, the keys
    under which it meets others, and their places in its order.  An element is
    a key with its lowest bit 0, a subset one with its lowest bit 1."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # of fixed size
    both = SIMILARITY * light // 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for b in batches:
            for i, j, data, off in C.text_blocks(b.column(1)):
                rows, values = gram_sets(data, off)
                n = np.bincount(rows, minlength=j - i)
                first = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(C.mix(values ^ np.uint64(seed)))]) for seed in (0x51, 0xA7)]
                d1, d2 = (s[first[1:]] - s[first[:-1]] for s in sums)
                order = np.lexsort((values, level[_slot(values >> np.uint64(16))], rows))
                rows, values = rows[order], values[order]
                place = np.arange(len(rows)) - first[rows]
                size = short_form(n)
                as_list = (place < short_form(n, 1)[rows]) & (n[rows] >= both)
                got_rows, got, places = [rows[as_list]], [values[as_list] & ~np.uint64(1)], [place[as_list]]
                for r in np.flatnonzero((n > 0) & (n <= light)):
                    own = values[first[r] : first[r] + size[r]]
                    x, y = np.triu_indices(len(own), 1)
                    low, high = np.minimum(own[x], own[y]), np.maximum(own[x], own[y])
                    got_rows.append(np.full(len(x), r))
                    got.append(C.mix(low * np.uint64(0x9E3779B97F4A7C15) + C.mix(high)) | np.uint64(1))
                    places.append(np.maximum(x, y) - OVERLAP + 1)
                got_rows, got, places = (np.concatenate(v) for v in (got_rows, got, places))
                order = np.argsort(got_rows, kind="stable")
                sizes = np.bincount(got_rows, minlength=j - i)
                yield C.batch(_KEYS, b.column(0).slice(i, j - i), n, C.signed(d1), C.signed(d2), C.list_array(pa.array(C.signed(got[order])), sizes), C.list_array(pa.array(places[order].astype(np.int32)), sizes))

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, keys array<long>, places array<int>")


def _can_meet(n_a, at_a, n_b, at_b):
    """Whether sets of n_a and n_b elements can be similar and meet at these
    places: their least overlap leaves that many places in each one's form."""
    shared = F.expr(f"({SIMILARITY} * ({n_a} + {n_b}) + {SIMILARITY + 99}) div {SIMILARITY + 100}")
    sizes = F.least(n_a, n_b) * 100 >= SIMILARITY * F.greatest(n_a, n_b)
    return sizes & (F.col(at_a) <= F.col(n_a) - shared) & (F.col(at_b) <= F.col(n_b) - shared)


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar.  Each text is shuffled
    once to its pairs' first side; the second side's copies stay in the join."""
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            ids = [b.column(0).to_numpy(), b.column(1).to_numpy()]
            keep = np.zeros(b.num_rows, bool)
            for lo in range(0, b.num_rows, 256):
                sets: dict[int, np.ndarray] = {}
                for side in (0, 1):
                    part = ids[side][lo : lo + 256]
                    new, at = np.unique(part, return_index=True)
                    fresh = np.array([x not in known and x not in sets for x in new.tolist()], bool)
                    for i, j, data, off in C.text_blocks(b.column(2 + side).take(pa.array(lo + at[fresh]))):
                        rows, values = gram_sets(data, off)
                        edge = np.searchsorted(rows, np.arange(j - i + 1))
                        for k in range(j - i):
                            sets[int(new[fresh][i + k])] = values[edge[k] : edge[k + 1]]
                for x in known.keys() & set(np.concatenate([ids[0][lo : lo + 256], ids[1][lo : lo + 256]]).tolist()):
                    sets[x] = known[x]
                for k in range(lo, min(lo + 256, b.num_rows)):
                    x, y = sets[int(ids[0][k])], sets[int(ids[1][k])]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = 100 * common >= SIMILARITY * (len(x) + len(y) - common) and common > 0
                known = sets  # sets of the last rows: neighbours often share one
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=schema).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, links): size and class of equal sets of every document, and links
    (a, b) between representatives that connect all similar sets."""
    d = C.columns(docs, "doc_id", "text")
    table, scan = levels(d)
    forms = C.cut(short_forms(d, table, light_size(scan)))
    # equal sets: the smallest id stands for all
    heads = forms.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("head"), F.max("n").alias("n"))
    heads = C.cut(heads)
    key = C.small(heads.select(F.col("d1").alias("h1"), F.col("d2").alias("h2"), "head"))
    sets = forms.select("doc_id", "n", "d1", "d2").join(key, (F.col("d1") == F.col("h1")) & (F.col("d2") == F.col("h2")) & (F.col("n") > 0), "left").select("doc_id", "n", "head")
    own = C.small(heads.select(F.col("d1").alias("h1"), F.col("d2").alias("h2"), "head"))
    first = forms.join(own, (F.col("d1") == F.col("h1")) & (F.col("d2") == F.col("h2")) & (F.col("doc_id") == F.col("head")))
    first = first.select(F.col("head").alias("id"), "n", F.explode(F.arrays_zip("keys", "places")).alias("k")).select("id", "n", F.col("k.keys").alias("key"), F.col("k.places").alias("at"))
    # lists with two entries or more
    lists = first.groupBy("key").agg(F.count("*").alias("entries")).where("entries > 1")
    entries = C.cut(first.join(lists, "key").distinct())
    weight = entries.groupBy("id").agg(F.sum("entries").alias("weight"))
    entries = C.cut(entries.join(weight, "id").select("key", "id", "n", "at", "weight"))
    grouped, found = entries.withColumn("g", F.col("id")), None
    for _ in range(ROUNDS):
        stars = C.cut(_stars(grouped))
        near = C.cut(_verify(stars, _texts(d, stars)))
        found = near if found is None else found.unionAll(near)
        groups = components(found)
        grouped = C.cut(entries.join(C.small(groups.select("id", F.col("component").alias("g"))), "id", "left").withColumn("g", F.coalesce("g", "id")))
        found = groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
    pairs = C.cut(_crossing(grouped))
    more = C.cut(_verify(pairs, _texts(d, pairs)))
    return sets, found.unionAll(more)


def _stars(grouped: DataFrame) -> DataFrame:
    """(a, b): of each group in a list one set, and the list's pivot.  The
    pivot is of the list's largest group and has the longest lists itself."""
    best = F.max(F.struct("weight", (-F.col("id")).alias("order"), "id", "n", "at")).alias("best")
    reps = grouped.groupBy("key", "g").agg(F.count("*").alias("size"), best)
    tops = reps.groupBy("key").agg(F.max(F.struct("size", "best", "g")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    met = reps.join(tops, "key").where((F.col("g") != F.col("top.g")) & _can_meet("best.n", "best.at", "top.best.n", "top.best.at"))
    a, b = F.col("best.id"), F.col("top.best.id")
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _crossing(grouped: DataFrame) -> DataFrame:
    """(a, b): all sets that meet in lists but are in different groups.  The
    smaller one (by size, then id) meets with its shorter form."""
    kinds = grouped.groupBy("key").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).where("g1 <> g2").select("key")
    open_ = C.cut(grouped.join(kinds, "key").select("key", "g", "id", "n", "at"))
    inner = F.expr(f"at <= n - (2 * {SIMILARITY} * n + {SIMILARITY + 99}) div {SIMILARITY + 100}")
    left = open_.where(inner).select("key", F.col("g").alias("x"), F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    right = open_.select("key", F.col("g").alias("y"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    # sets of one size of a group go by the first of their places
    sides = left.groupBy("key", "x", "n_a").agg(F.min("at_a").alias("first_a"))
    others = right.groupBy("key", "y", "n_b").agg(F.min("at_b").alias("first_b"))
    fit = (F.col("x") != F.col("y")) & (F.col("n_a") <= F.col("n_b")) & _can_meet("n_a", "first_a", "n_b", "first_b")
    met = sides.join(others, (sides["key"] == others["key"]) & fit).select(sides["key"], "x", "n_a", "y", "n_b")
    pairs = met.join(left, ["key", "x", "n_a"]).join(right, ["key", "y", "n_b"])
    return pairs.where(_can_meet("n_a", "at_a", "n_b", "at_b") & (F.struct("n_a", "a") < F.struct("n_b", "b"))).select("a", "b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    return C.cut(C.components(pairs))


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text) of the documents in the pairs, once each."""
    ids = C.cut(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct())
    return C.cut(docs.join(C.small(ids), F.col("doc_id") == F.col("id")).select("id", "text"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document."""
    sets, found = links(docs)
    groups = C.cut(C.components(found)).select(F.col("id").alias("node"), "component")
    out = sets.join(C.small(groups), F.col("head") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "head", "doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest ``doc_id``, columns
    as they came; a document with the empty set is a group of its own, and so
    is one with a null ``doc_id``.  Rows that repeat a ``doc_id`` are one document."""
    kept = C.cut(classes(docs).where("component_id = doc_id or doc_id is null").groupBy(F.col("doc_id").alias("__kept")).agg(F.count("*").alias("__rows")))
    own = [f"__own_{i}" for i in range(len(docs.columns))]
    id_of = next(o for o, c in zip(own, docs.columns) if c.lower() == "doc_id")
    rows = docs.toDF(*own).join(C.small(kept.select("__kept")), F.col(id_of).cast("long").eqNullSafe(F.col("__kept")), "left_semi")
    if kept.where("__rows > 1 and __kept is not null").limit(1).count():
        rows = rows.where(F.col(id_of).isNotNull()).dropDuplicates([id_of]).unionAll(rows.where(F.col(id_of).isNull()))
    return rows.toDF(*docs.columns)
