"""What the operators of this subpackage share: Arrow text buffers, vectorised
word and window hashing, lineage cuts, size-checked semi joins and distributed
connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.session import ensure_checkpoint_dir

U64 = np.uint64
# An odd multiplier and its inverse modulo 2**64, and the three
# constants of the splitmix64 finaliser.
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_MIX_A, _MIX_B, _MIX_C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

BLOCK_BYTES = 1 << 19
#: Bytes up to which a table may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 of each element."""
    x = x.astype(U64, copy=True)
    x += U64(_MIX_A)
    x ^= x >> U64(30)
    x *= U64(_MIX_B)
    x ^= x >> U64(27)
    x *= U64(_MIX_C)
    x ^= x >> U64(31)
    return x


BYTE_VALUE = mix(np.arange(256, dtype=U64) + U64(1))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: As BYTE_VALUE, with A-Z as a-z.
BYTE_VALUE_LOWER = BYTE_VALUE[_LOWER]

_pow: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    if not _pow or len(_pow[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        _pow[:] = []
        for m in (_MULT, _INV):
            p = np.full(size, m, dtype=U64)
            p[0] = 1
            _pow.append(np.multiply.accumulate(p))
    return _pow[0], _pow[1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash takes the hash of any range in O(1)."""
    p, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the range stands."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, one after another, and the rows' offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count:
        # a null may own bytes: copy the others out
        parts = [x.encode() if isinstance(x, str) else (x or b"") for x in column.to_pylist()]
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        return data, np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def row_blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets) of blocks of rows."""
    data, off = utf8(column)
    for i, j in row_blocks(off, limit):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run without space, tab, newline, vertical
    tab, form feed, carriage return) and, per row, the number of the first word
    (one more at the end)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[:-1][(off[:-1] < off[1:])]
    first[cut] = inside[cut]
    ends = off[1:][(off[:-1] < off[1:])] - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, table: np.ndarray = BYTE_VALUE) -> np.ndarray:
    return range_hash(prefix_hash(table[data]), starts, stops)


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values (of all, whatever row they are of)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    p, _ = powers(k + 1)
    out = np.zeros(n, U64)
    for j in range(k):
        out += values[j : j + n] * p[j + 1]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive elements, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    cur, span = x, 1
    while 2 * span <= w:
        cur = np.minimum(cur[: len(cur) - span], cur[span:])
        span *= 2
    return np.minimum(cur[:n], cur[w - span : w - span + n]) if span < w else cur[:n]


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def cut_path(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names; tables of one
    application lie together, so they can be removed when it has ended."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or ensure_checkpoint_dir(spark)
    return f"{folder.rstrip('/')}/quill-llm/{sc.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back."""
    path = cut_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fixed(kind: T.DataType) -> int:
    """Bytes of a value without what is of any length in it."""
    return 8 + sum(_fixed(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else 8


def _bytes(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value: 8 for a number, what strings hold, and all of a list's elements."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(8) + F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if not isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)) or isinstance(inner, T.StructType) and all(isinstance(f.dataType, T.NumericType) for f in inner.fields):
            return F.lit(16) + F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) * _fixed(inner)
        return F.lit(16) + F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, inner)), F.lit(0))
    return F.lit(8)


def table_bytes(df: DataFrame) -> int:
    """About the bytes of a written table's values, by one aggregation."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def small(df: DataFrame) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its values are at most
    BROADCAST_BYTES, else as it is."""
    return F.broadcast(df) if table_bytes(df) <= BROADCAST_BYTES else df


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, a missing one as null; text as string, doc_id as long."""
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    have = {c.lower(): c for c in reversed(docs.columns)}
    return docs.select(*[(docs[f"`{have[n]}`"] if n in have else F.lit(None)).cast(kinds[n]).alias(n) for n in names])


def batch(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, type=f.type) for a, f in zip(arrays, schema)], schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def list_array(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a partition's links: one link per node but the
    smallest of its tree, to that one."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for k in range(0, len(nodes), 1 << 16):
        part = nodes[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])


#: Links that one task turns into a forest.
FOREST_LINKS = 200_000


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b): component is the
    smallest node reachable; the smallest node itself has no row.  Links are
    first cut down to a forest per FOREST_LINKS of them; if there are several
    forests, alternating large-star and small-star rounds join them: a round
    pre-aggregates the minimum per node before its shuffle, and the links of a
    hot node are split by the skew join."""
    e = cut(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")))
    forests = e.count() // FOREST_LINKS + 1
    e = cut(e.coalesce(forests).mapInArrow(_forest, "a long, b long"))
    if forests == 1:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 1000003)).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lead = big.groupBy("a").agg(F.min("b").alias("m"))
        e = big.join(lead, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(e.unionAll(lead.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
