"""Reproducible randomness from hashes.

Every random choice in the library (split order, oversampling draws, SMOTE
gaps, generated weights) is a pure function of ``(seed, tag, i)``:

    h(seed, tag, i) = first 15 hex digits of md5("seed:tag:i") as an integer in [0, 2**60)

so the same draw can be recomputed in SQL by any engine with ``md5``.  Each
Spark expression has a DuckDB twin (``*_sql``) used by the oracle queries.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_60 = 1152921504606846976.0
_SHIFTS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_AT_A_TIME = 16384  # messages hashed at a time: what a round reads stays in the cache


def _as_str(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    return F.lit(str(c))


def hash_key(seed, tag, i) -> Column:
    """md5 hex digest of ``seed:tag:i`` (used for ranking)."""
    return F.md5(F.concat_ws(":", _as_str(seed), _as_str(tag), _as_str(i)))


def hash_draw(seed, tag, i) -> Column:
    """Integer draw in [0, 2**60) as LONG: a row of any table can be drawn."""
    return F.conv(F.substring(hash_key(seed, tag, i), 1, 15), 16, 10).cast("long")


def hash_unit(seed, tag, i) -> Column:
    """Uniform double in [0, 1)."""
    return hash_draw(seed, tag, i) / F.lit(TWO_60)


# ---------------------------------------------------------------- the same in NumPy

def _md5_start(words: dict[int, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the md5 of n messages of one block; ``words`` has those of the 16 that are not 0."""
    start = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d = (np.full(n, x, np.uint32) for x in start)
    f, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += np.uint32(_SINES[i])
        if g in words:
            f += words[g]
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=u)
        f >>= np.uint32(32 - _SHIFTS[i])
        f |= u
        f += b
        a, d, c, b, f = d, c, b, f, a
    return a + np.uint32(start[0]), b + np.uint32(start[1])


def draws_of(seed, tag, i: np.ndarray) -> np.ndarray:
    """:func:`hash_draw` of each number (0 or more)."""
    head = np.frombuffer(f"{seed}:{tag}:".encode(), np.uint8)
    i = np.asarray(i, np.int64)
    out, digits = np.empty(len(i), np.int64), np.searchsorted(10 ** np.arange(1, 19), i, side="right") + 1
    for many in np.unique(digits):  # messages of equal length
        length, at = len(head) + int(many), np.flatnonzero(digits == many)
        if length > 55:
            raise ValueError(f"seed and tag are too long: {seed}:{tag}")
        for part in np.split(at, range(_AT_A_TIME, len(at), _AT_A_TIME)):
            text = np.zeros((len(part), -(-(length + 1) // 4) * 4), np.uint8)
            text[:, :len(head)] = head
            rest = i[part]
            for k in range(length - 1, len(head) - 1, -1):
                rest, text[:, k] = rest // 10, rest % 10 + 48
            text[:, length] = 0x80
            words = dict(enumerate(np.ascontiguousarray(text.view("<u4").T)))
            words[14] = np.uint32(8 * length)
            a, b = (x.byteswap().astype(np.int64) for x in _md5_start(words, len(part)))
            out[part] = (a << 28) | (b >> 4)
    return out


def units_of(seed, tag, i: np.ndarray) -> np.ndarray:
    """:func:`hash_unit` of each number."""
    return draws_of(seed, tag, i) / TWO_60


# ---------------------------------------------------------------- SQL twins

def _sql_str(x) -> str:
    if isinstance(x, str) and x.startswith("@"):
        return f"CAST({x[1:]} AS VARCHAR)"
    return "'" + str(x).replace("'", "''") + "'"


def hash_key_sql(seed, tag, i) -> str:
    """DuckDB twin of :func:`hash_key`.  Arguments starting with '@' are column
    expressions, others literals."""
    return f"md5(concat_ws(':', {_sql_str(seed)}, {_sql_str(tag)}, {_sql_str(i)}))"


def hash_draw_sql(seed, tag, i) -> str:
    return f"CAST(('0x' || substr({hash_key_sql(seed, tag, i)}, 1, 15)) AS BIGINT)"


def hash_unit_sql(seed, tag, i) -> str:
    return f"({hash_draw_sql(seed, tag, i)} / CAST({int(TWO_60)} AS DOUBLE))"
