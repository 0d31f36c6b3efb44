"""Quality rules with cross-document line frequency.

Base measures are taken of every whole text.  Lines are then normalised (A-Z
lower-cased, white space collapsed), hashed, and counted per host in distinct
documents (equal texts of a host count once, so that copies of a clean page do
not turn it into boilerplate).  Lines above the host's limit are removed; a
document that keeps too few of its words is depleted and rejected.

Defined cases: a null text is an empty one (0 words, rejected by the base
rules); null ``source`` is a host of its own; rows with a null or repeated
``doc_id`` are measured row by row; an empty table gives an empty result; other
columns are not read by ``quality`` and pass through ``clean`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.llm import common as C

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is boilerplate of a host if it is in more distinct documents than
#: this, whatever the size of the host: the limit published for the line-level
#: deduplication of the Llama 3 corpus ("more than 6 times").  A share of the
#: host's documents can be asked for besides; 0 is none.
LINE_DOCS = 6
LINE_SHARE = 0.0
#: A document is depleted if fewer of its words than this share remain.
MIN_LEFT = 0.20
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True

_OUT = pa.schema([
    ("doc_id", pa.int64()), ("host", pa.string()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("line_hash", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64())),
])
_DDL = ("doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, line_hash array<long>, line_words array<long>")


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def line_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each line (split at newlines; a text has one line at least)."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([off[:-1], breaks + 1])
    rows = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, side="right") - 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.empty_like(starts)
    ends[:-1] = np.where(rows[1:] == rows[:-1], starts[1:] - 1, off[rows[:-1] + 1])
    ends[-1:] = off[-1]
    return starts, ends, rows


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def normal_lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of lines with a word: start, end, row, number of words, normalised hash."""
    starts, stops, _ = C.word_bounds(data, off)
    ls, le, lr = line_bounds(data, off)
    w0, w1 = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    has = w1 > w0
    ls, le, lr, w0, w1 = ls[has], le[has], lr[has], w0[has], w1[has]
    words = C.word_hashes(data, starts, stops, C.BYTE_VALUE_LOWER)
    return ls, le, lr, w1 - w0, C.range_hash(C.prefix_hash(words), w0, w1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, host, text, text_hash = b.columns
        for i, j, data, off in C.text_blocks(text):
            n = j - i
            starts, stops, first = C.word_bounds(data, off)
            n_words = np.diff(first)
            inside = ~C.SEPARATOR[data] & ((data & 0xC0) != 0x80)
            raw = C.prefix_hash(C.BYTE_VALUE[data])
            # equal lines of a text
            ls, le, lr, lw, lh = normal_lines(data, off)
            exact = C.range_hash(raw, ls, le)
            order = np.lexsort((exact, lr))
            new = _first_of_runs(lr[order], exact[order])
            dup_lines = np.bincount(lr[order][~new], minlength=n)
            # words in repeated 5-word windows
            words = C.range_hash(raw, starts, stops)
            row = np.repeat(np.arange(n), n_words)
            grams = C.window_hashes(words, 5)
            at = np.flatnonzero(row[: len(grams)] == row[4:]) if len(grams) else np.zeros(0, np.int64)
            order = at[np.lexsort((grams[at], row[at]))]
            new = _first_of_runs(row[order], grams[order])
            again = ~new
            again[:-1] |= ~new[1:]
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, order[again], 1)
            np.add.at(cover, order[again] + 5, -1)
            repeat = np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=n)
            # distinct normalised lines
            order = np.lexsort((lh, lr))
            new = np.flatnonzero(_first_of_runs(lr[order], lh[order])) if len(order) else np.zeros(0, np.int64)
            sums = np.add.reduceat(lw[order], new) if len(new) else np.zeros(0, np.int64)
            sizes = np.bincount(lr[order][new], minlength=n)
            yield C.batch(
                _OUT, ids.slice(i, n), host.slice(i, n), text_hash.slice(i, n), n_words, _per_row(inside, off), _per_row(_IS_SYMBOL[data], off),
                dup_lines, repeat, C.list_array(pa.array(C.signed(lh[order][new])), sizes), C.list_array(pa.array(sums.astype(np.int64)), sizes),
            )


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: base measures and its distinct normalised lines."""
    return C.columns(docs, "doc_id", "source", "text").withColumn("text_hash", _text_hash("text")).mapInArrow(_measure, _DDL)


def frequent_lines(measured: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(host, line_hash, n_docs) of the lines above the limit.  Counts are
    pre-aggregated before their shuffles; no row is a whole group."""
    seen = measured.select("host", "text_hash", F.explode("line_hash").alias("line_hash")).distinct()
    lines = seen.groupBy("host", "line_hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > line_docs)
    if not line_share:
        return lines
    hosts = measured.select(F.col("host").alias("of_host"), "text_hash").distinct().groupBy("of_host").agg(F.count("*").alias("host_docs"))
    return lines.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).where(F.col("n_docs") > line_share * F.col("host_docs")).select("host", "line_hash", "n_docs")


def quality(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """Verdict per document: base measures, ``base_failed``, ``n_line_words``
    (words in lines above the limit), ``depleted`` and ``kept``."""
    return verdicts(C.cut(measure(docs)), line_docs, line_share, min_left).drop("hits")


def verdicts(measured: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """Verdicts over written measures; ``hits`` are the document's own lines
    above the limit (null: none)."""
    lines = C.cut(frequent_lines(measured, line_docs, line_share))
    rows = measured.select("host", "text_hash", F.explode(F.arrays_zip("line_hash", "line_words")).alias("x")).select("host", "text_hash", F.col("x.line_hash").alias("line_hash"), F.col("x.line_words").alias("w")).distinct()
    hot = C.small(lines.select(F.col("host").alias("of_host"), "line_hash"))
    lost = rows.join(hot, (rows["line_hash"] == hot["line_hash"]) & rows["host"].eqNullSafe(hot["of_host"]), "inner").groupBy(F.col("host").alias("of_host"), F.col("text_hash").alias("of_text")).agg(F.sum("w").alias("lost"), F.collect_list(rows["line_hash"]).alias("hits"))
    m = measured.drop("line_hash", "line_words")
    out = m.join(lost, (F.col("text_hash") == F.col("of_text")) & F.col("host").eqNullSafe(F.col("of_host")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost_words = F.coalesce(F.col("lost"), F.lit(0)).cast("long")
    out = out.withColumn("base_failed", failed).withColumn("n_line_words", lost_words).withColumn("depleted", (F.col("n_words") - lost_words) < min_left * F.col("n_words"))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    return out.select("doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "depleted", "kept", "hits")


def clean(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that stay, without their lines above the limit, columns as
    they came (``n_chars``, if there, follows the text).  Kept texts without
    such lines are unchanged to the byte."""
    found = verdicts(C.cut(measure(docs)), line_docs, line_share, min_left)
    acts = found.where(~F.col("kept") | F.col("hits").isNotNull()).select(F.col("host").alias("__of_host"), F.col("text_hash").alias("__of_text"), "kept", "hits")
    acts = C.small(C.cut(acts.dropDuplicates(["__of_host", "__of_text"])))  # equal texts of a host have one verdict
    own = [f"__own_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*own)
    text = next((o for o, c in zip(own, docs.columns) if c.lower() == "text"), None)
    host = next((o for o, c in zip(own, docs.columns) if c.lower() == "source"), None)
    size = next((o for o, c in zip(own, docs.columns) if c.lower() == "n_chars"), None)
    if text is None:
        raise ValueError("documents need a text column")
    rows = rows.withColumn("__host", F.col(host).cast("string") if host else F.lit(None).cast("string")).withColumn("__hash", _text_hash(text))
    joined = rows.join(acts, F.col("__host").eqNullSafe(F.col("__of_host")) & (F.col("__hash") == F.col("__of_text")), "left")
    joined = joined.where(F.coalesce("kept", F.lit(True))).select(*own, "hits")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, hits = b.schema.names[:-1], b.column(b.num_columns - 1)
            has = hits.is_valid()
            columns = dict(zip(names, b.columns))
            if has.true_count:
                new = pa.array(without_lines(columns[text].filter(has), hits.filter(has)), type=columns[text].type)
                columns[text] = pc.replace_with_mask(columns[text], has, new)
                if size:
                    known = pc.and_(has, columns[size].is_valid())
                    columns[size] = pc.replace_with_mask(columns[size], known, pc.cast(pc.utf8_length(columns[text].filter(known)), columns[size].type))
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return joined.mapInArrow(strip, joined.drop("hits").schema).toDF(*docs.columns)


def without_lines(texts: pa.Array, hits: pa.ListArray) -> list[str]:
    """The texts without the lines whose normalised hashes are named."""
    out = []
    for i, j, data, off in C.text_blocks(texts):
        ls, le, lr, _, lh = normal_lines(data, off)
        first = np.searchsorted(lr, np.arange(j - i + 1))
        for k in range(j - i):
            own = slice(first[k], first[k + 1])
            drop = np.isin(C.signed(lh[own]), hits[i + k].values.to_numpy())
            parts, at = [], int(off[k])
            for s, e in zip(ls[own][drop], le[own][drop]):
                parts.append(data[at:s])
                at = min(int(e) + 1, int(off[k + 1]))
            parts.append(data[at : off[k + 1]])
            out.append(b"".join(p.tobytes() for p in parts).decode())
    return out


def __getattr__(name: str) -> str:
    """``SQL``, the twin, with the limits in force when it is read."""
    if name != "SQL":
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT r, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS e, lead(word, 4) OVER o AS f
      FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c, e, f) AS n FROM g WHERE f IS NOT NULL),
z AS (SELECT r, i, max(n) OVER (PARTITION BY r ORDER BY i RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS n
      FROM (SELECT p.r, p.i, coalesce(h.n, 0) AS n FROM p LEFT JOIN h USING (r, i))),
rw AS (SELECT r, count(*) AS n_repeat_words FROM z WHERE n > 1 GROUP BY r),
l AS (SELECT r, source, text, unnest(lines) AS line FROM w),
k AS (SELECT r, source, text, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw FROM l),
m AS (SELECT r, source, text, line, len(lw) AS n, lw AS norm FROM k WHERE len(lw) > 0),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM m GROUP BY r),
lf AS (SELECT source, norm, count(DISTINCT text) AS n_docs FROM m GROUP BY source, norm),
hs AS (SELECT source, count(DISTINCT text) AS host_docs FROM d GROUP BY source),
hot AS (SELECT lf.source, norm FROM lf JOIN hs ON lf.source IS NOT DISTINCT FROM hs.source WHERE n_docs > {LINE_DOCS} AND n_docs > {LINE_SHARE} * host_docs),
lost AS (SELECT r, sum(n) AS lost FROM m JOIN hot ON m.source IS NOT DISTINCT FROM hot.source AND m.norm = hot.norm GROUP BY r),
o AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(lost, 0) AS BIGINT) AS n_line_words
      FROM w LEFT JOIN rw USING (r) LEFT JOIN dl USING (r) LEFT JOIN lost USING (r)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words - n_line_words < {MIN_LEFT} * n_words) AS kept, n_line_words
FROM v
"""
