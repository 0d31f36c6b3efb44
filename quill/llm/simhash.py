"""SimHash near duplicates by the generalised pigeonhole principle.

A document's fingerprint has a bit for each majority among the XXH64 hashes of
its three-word shingles.  Equal fingerprints become one row.  To find those that
differ in at most DISTANCE bits, the 64 bits are divided into parts, bits that
go together in one part, and each part gets a threshold t >= -1 so that the
thresholds plus one add up to DISTANCE + 1: a pair within the distance is then
within t of each other in some part.  How many parts, and which thresholds, is
what a dynamic programme finds cheapest, given the pairs expected within t in a
part (counted on SAMPLE fingerprints; this changes the cost, never the rows)
and the keys to write.  Every fingerprint stands under its own value of a part
with t >= 0 and is probed under all values within t.

Fingerprints under a key are verified in the task that has the key, by exact
distance, and leave it as a spanning forest, so a key writes fewer links than it
has rows.  A key with more than BUCKET rows is divided first: the bits that its
rows do not share are dealt, in order of their variance in this key, to
DISTANCE + 1 parts, one of which must be equal in any pair within the distance;
the rows meet again under the key and their value of such a part, as often as
needed.  Each turn leaves at most three quarters of the bits open, and LEAF_BITS
open bits bound the rows of a key.

Defined cases: a document without words (null, empty, white space) has
fingerprint zero and is linked like any other; fewer than three words are one
shingle; repeated doc_ids have rows of their own; a null doc_id is linked, but
only known ids name a component, null if a class has none; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm import common as C

WIDTH = 3
SEED = 42
DISTANCE = 3
#: Fingerprints that the parts and thresholds are chosen on.
SAMPLE = 20_000
#: Rows of a key that one task compares, and open bits that need no further division.
BUCKET = 4096
LEAF_BITS = 12
#: Cost of a compared pair next to that of a written key.
PAIR_COST = 0.005
_SLICE = 1 << 15
_POP = np.array([bin(x).count("1") for x in range(1 << 16)], dtype=np.uint8)


def fingerprint(text: str | None) -> int:
    """The 64 majority bits of the hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and the six separators only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[WIDTH - 1 :] or [len(line)]
    count, hashed = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(ends), _SLICE):
        h = np.array([hashed(line[i:j], SEED) for i, j in zip(starts[k : k + _SLICE], ends[k : k + _SLICE])], dtype=np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(ends), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every whole text; fp is the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64)
            yield C.batch(schema, b.column(0), C.signed(fps))

    return C.columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which unsigned 64-bit values differ."""
    x = np.atleast_1d(a ^ b)
    return _POP[np.ascontiguousarray(x).view(np.uint16)].reshape(*x.shape, 4).sum(axis=-1, dtype=np.uint8)


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in parts of nearly equal width; a part begins with the bit
    that goes least with the others left and takes those that go most with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(axis=0))
    with np.errstate(all="ignore"):
        together = np.abs(np.nan_to_num(bits.T @ bits / np.outer(norm, norm)))
    left, out = list(range(64)), []
    for k in range(parts):
        width = 64 * (k + 1) // parts - 64 * k // parts
        part = [min(left, key=lambda b: (together[b, left].sum(), b))]
        left.remove(part[0])
        while len(part) < width:
            best = max(left, key=lambda b: (together[b, part].mean(), -b))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _share(sample: np.ndarray, part: list[int], t: int) -> float:
    """Share of pairs within t of each other in a part: by the sample, at least
    what even bits would give."""
    even = sum(comb(len(part), k) for k in range(t + 1)) / 2.0 ** len(part)
    n = len(sample)
    if n < 2 or comb(len(part), t) > 600:  # not counted: bounded by the counted share of a smaller t
        return even if n < 2 else max(even, _share(sample, part, t - 1))

    def equal(mask: int) -> int:
        _, c = np.unique(sample & np.uint64(mask), return_counts=True)
        return int((c.astype(np.int64) * (c - 1) // 2).sum())

    # pairs that agree outside t bits of the part, over all choices of them: a pair at distance d counts comb(w - d, t - d) times
    whole, w, exact = mask_of(part), len(part), []
    for d in range(t + 1):
        total = sum(equal(whole & ~mask_of(list(gone))) for gone in combinations(part, d))
        exact.append(max(0, total - sum(x * comb(w - k, d - k) for k, x in enumerate(exact))))
    return max(even, sum(exact) / (n * (n - 1) / 2))


def allocate(cost: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Units for each part (threshold plus one) that add up to ``units`` at the least cost; cost[part][u]."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * units
    for each in cost:
        best = [min(((b[0] + each[s - k], [*b[1], s - k]) for k, b in enumerate(best[: s + 1]) if b is not None), default=None) for s in range(units + 1)]
    return best[units]


def plan(sample: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Parts and thresholds (without the parts of threshold -1) for n fingerprints."""
    choices = []
    for parts in range(1, 9):
        groups = grouped_bits(sample, parts)
        costs = []
        for g in groups:
            each = [0.0]
            for t in range(distance + 1):
                keys = 1 + (sum(comb(len(g), k) for k in range(1, t + 1)))
                # a part that no choice can afford is not counted on the sample
                each.append(float("inf") if keys > 600 else n * keys + PAIR_COST * _share(sample, g, t) * n * (n - 1) / 2)
            costs.append(each)
        found = allocate(costs, distance + 1)
        choices.append((found[0], parts, [(g, u - 1) for g, u in zip(groups, found[1]) if u]))
    return min(choices)[2]


def _signatures(uniq: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(key, shared, fp): each fingerprint under the values of each part within its threshold."""
    masks = [mask_of(g) for g, _ in parts]
    flips = [np.array([mask_of(list(c)) for k in range(t + 1) for c in combinations(g, k)], dtype=np.uint64) for g, t in parts]
    schema = pa.schema([("key", pa.int64()), ("shared", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (m, flip, (_, t)) in enumerate(zip(masks, flips, parts)):
                own = (fp & np.uint64(m))[:, None] ^ flip[None, :]
                keys = C.mix(own.ravel() + C.mix(np.array([k], np.uint64))[0])
                # bits that all rows of a key share: those of the part, if none are probed
                yield C.batch(schema, C.signed(keys), C.signed(np.full(own.size, m if t == 0 else 0, np.uint64)), C.signed(np.repeat(fp, own.shape[1])))

    return uniq.select("fp").mapInArrow(run, "key long, shared long, fp long")


def _close(fp: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint of one key the first one of its class within the
    key: least index reachable by links, by rounds over slices of rows."""
    label = np.arange(len(fp))
    step = max(1, (1 << 20) // max(1, len(fp)))
    while True:
        before = label.copy()
        for i in range(0, len(fp), step):
            near = distances(fp[i : i + step, None], fp[None, :]) <= distance
            label[i : i + step] = np.where(near, label[None, :], len(fp)).min(axis=1)
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label


def _links(rows: DataFrame, distance: int) -> DataFrame:
    """A spanning forest of the links (a, b) between fingerprints of a key."""
    names = ["a", "b"]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def pairs(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.diff(key)) + 1
            start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            size = end - start
            for i in np.flatnonzero(size > 64):
                own = fp[start[i] : end[i]]
                first = _close(own, distance)
                at = np.flatnonzero(first != np.arange(len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(own[at])), pa.array(C.signed(own[first[at]]))], names=names)
            small = np.repeat(np.where(size <= 64, end, 0), size)
            here = np.arange(len(key))
            for s in range(1, int(min(64, size.max(initial=0)))):
                at = here[here + s < small]
                at = at[distances(fp[at], fp[at + s]) <= distance]
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(fp[at])), pa.array(C.signed(fp[at + s]))], names=names)

        for b in batches:
            held_k = np.concatenate([held_k, b.column(0).to_numpy(zero_copy_only=False)])
            held_f = np.concatenate([held_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = int(np.searchsorted(held_k, held_k[-1])) if len(held_k) else 0  # the last key may go on
            if whole:
                yield from pairs(held_k[:whole], held_f[:whole])
                held_k, held_f = held_k[whole:], held_f[whole:]
        if len(held_k):
            yield from pairs(held_k, held_f)

    return rows.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: C._forest(linked(batches)), "a long, b long")


def _divided(rows: DataFrame, heavy: DataFrame, distance: int) -> DataFrame:
    """Rows of the heavy keys under a key for each part of their open bits."""
    ones = [F.sum(F.shiftright("fp", b).bitwiseAND(1)).alias(f"b{b}") for b in range(64)]
    stats = rows.join(heavy, "key", "left_semi").groupBy("key").agg(F.bit_and("shared").alias("shared"), F.count("*").alias("n"), *ones)
    schema = pa.schema([("key", pa.int64()), ("masks", pa.list_(pa.int64())), ("shared", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = []
            for shared, n, *ones in zip(*(c.to_pylist() for c in b.columns[1:])):
                open_bits = [k for k in range(64) if not shared >> k & 1]
                open_bits.sort(key=lambda k: (-ones[k] * (n - ones[k]), k))
                masks.append([np.uint64(mask_of(open_bits[p :: distance + 1])).astype(np.int64) for p in range(distance + 1)])
            yield C.batch(schema, b.column(0), masks, b.column(1))

    dealt = C.cut(stats.mapInArrow(deal, "key long, masks array<long>, shared long"))
    parts = rows.select("key", "fp").join(C.small(dealt), "key").select("key", "shared", "fp", F.posexplode("masks").alias("part", "mask"))
    own = F.col("fp").bitwiseAND(F.col("mask"))
    return parts.select(F.xxhash64("key", "part", own).alias("key"), F.col("shared").bitwiseOR(F.col("mask")).alias("shared"), "fp")


def links(uniq: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, leaf_bits: int = LEAF_BITS, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (a written table) whose
    components are those of all pairs within the distance."""
    n = uniq.count()
    drawn = uniq.select("fp").orderBy(F.xxhash64("fp")).limit(sample).toArrow().column(0).combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
    rows, out = C.cut(_signatures(uniq, plan(drawn, n, distance))), None
    while True:
        free = 64 - F.bit_count(F.bit_and("shared"))
        heavy = C.cut(rows.groupBy("key").agg(F.count("*").alias("rows"), free.alias("free")).where((F.col("rows") > bucket) & (F.col("free") > leaf_bits)).select("key"))
        many = heavy.count()
        side = C.small(heavy)
        light = _links(rows.join(side, "key", "left_anti") if many else rows, distance)
        out = light if out is None else out.unionAll(light)
        if not many:
            return out
        rows = C.cut(_divided(rows, side, distance).distinct())


def classes(docs: DataFrame, **sizes: int) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of documents."""
    each = C.cut(fingerprints(docs))
    uniq = C.cut(each.groupBy("fp").agg(F.min("doc_id").alias("lead")))
    found = C.components(links(uniq, **sizes)).select(F.col("id").alias("fp"), "component")
    of = C.cut(uniq.join(found, "fp", "left").select("fp", "lead", F.coalesce("component", "fp").alias("component")))
    least = of.groupBy("component").agg(F.min("lead").alias("component_id"))
    named = C.cut(of.join(least, "component").select("fp", "component_id"))
    return each.join(C.small(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
