"""Substring deduplication by relative Lempel-Ziv parsing.

Documents are in the order of ``doc_id``; what stands before a document is its
reference.  All slabs (see ``repeats``) around one gram of words form a block.
The index of a block has, for each 50-word window in it, the first place that
holds it: least document, then slab.  A slab is parsed against the index from
its left: the next window that an earlier document holds starts a factor, which
goes on, word by word, as far as that document's slab agrees.  The windows over
a factor's end are looked up next, so a window that only another document holds
starts a factor of its own that overlaps the one before.  Factors of 50 words or
more are the duplicate spans; pieces of one factor that slabs cut apart are
joined again in the document.

Slabs that are equal as wholes are one factor of the first such slab, without a
look at the text.  The index of a block of very many slabs is not built in one
task: its windows are dealt out by hash, their first places found map-side, and
each slab meets the slabs that its windows name; it is parsed by the same code.

Defined cases: null texts have no words; a text of less than 50 words keeps all
of them; rows with the same ``doc_id`` are one document (neither is before the
other); a null ``doc_id`` stands after all others; an empty table gives an empty
result; other columns are not read.
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

WINDOW = 50
GRAM = 8
#: Slabs up to which a block is indexed in one task.
BLOCK = 2_000
#: Copies of a slab that very many others name as their source.
SALT = 8

_PART = pa.schema([("gram", pa.int64()), ("slab", pa.int64()), ("first", pa.int32()), ("words", pa.int32()), ("from_slab", pa.int64()), ("from_first", pa.int32())])
_PART_DDL = "gram long, slab long, first int, words int, from_slab long, from_first int"


def _words(content: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of slabs, one after another, and the slabs' offsets."""
    values, off = C.utf8(content)
    return np.frombuffer(values.tobytes(), np.uint64), off // 8


def _windows(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, place and hash of each window of the slabs."""
    windows = np.diff(off) - WINDOW + 1
    owner = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = off[owner] + place
    return owner, place, C.range_hash(C.prefix_hash(values), start, start + WINDOW)


def first_places(owner: np.ndarray, hashes: np.ndarray, order: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The index of blocks, looked up for every window: the number of the window
    that is the first to be equal in its block, or -1 if no earlier document has it."""
    by = np.lexsort((owner, order[owner], hashes, block[owner]))
    h, b = hashes[by], block[owner][by]
    new = np.ones(len(by), bool)
    new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
    lead = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.full(len(by), -1)
    out[by] = np.where(order[owner[lead]] < order[owner[by]], lead, -1)
    return out


def agreement(values: np.ndarray, x: np.ndarray, x_end: np.ndarray, y: np.ndarray, y_end: np.ndarray) -> np.ndarray:
    """How many words from x on equal those from y on."""
    most = np.minimum(x_end - x, y_end - y)
    begin = np.cumsum(most) - most
    step = np.arange(int(most.sum())) - np.repeat(begin, most)
    differs = values[np.repeat(x, most) + step] != values[np.repeat(y, most) + step]
    return np.minimum.reduceat(np.where(differs, step, np.repeat(most, most)), begin) if len(most) else most


def parse(values: np.ndarray, off: np.ndarray, owner: np.ndarray, place: np.ndarray, source: np.ndarray, source_place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Greedy factors of slabs: owner, first word, words, slab and first word of
    the source.  ``owner`` and ``place`` are of windows in order; ``source`` is
    the slab in which a window was found, or -1."""
    n = len(owner)
    found = np.where(source >= 0, np.arange(n), n)
    next_found = np.append(np.minimum.accumulate(found[::-1])[::-1], n)
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if n else np.zeros(0, np.int64)
    end = np.append(begin[1:], n)[: len(begin)]
    at, out = begin, []
    while len(at):  # one factor of every slab at a time
        at = next_found[at]
        go = at < end
        at, end = at[go], end[go]
        if not len(at):
            break
        own, first, of, of_first = owner[at], place[at], source[at], source_place[at]
        words = agreement(values, off[own] + first, off[own + 1], off[of] + of_first, off[of + 1])
        whole = words >= WINDOW  # less only if two windows' hashes collide
        out.append([c[whole] for c in (own, first, words, of, of_first)])
        at = np.minimum(at + np.where(whole, words - WINDOW + 1, 1), end)  # the first window over the factor's end
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Indexes and parses the blocks of a partition sorted by gram, a few thousand slabs at a time."""
    held: list[pa.RecordBatch] = []

    def flush(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        gram, slab, order = (t.column(c).to_numpy() for c in ("gram", "slab", "order"))
        values, off = _words(t.column("content"))
        owner, place, hashes = _windows(values, off)
        lead = first_places(owner, hashes, order, gram)
        own, first, words, of, of_first = parse(values, off, owner, place, np.where(lead < 0, -1, owner[lead]), place[lead])
        return C.batch(_PART, gram[own], slab[own], first.astype(np.int32), words.astype(np.int32), slab[of], of_first.astype(np.int32))

    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            held.append(b.slice(lo, BLOCK))
            if sum(x.num_rows for x in held) < 2 * BLOCK:
                continue
            t = pa.Table.from_batches(held)
            gram = t.column("gram").to_numpy()
            whole = int(np.searchsorted(gram, gram[-1]))  # the last block may go on
            if whole:
                yield flush(t.slice(0, whole))
                held = t.slice(whole).to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield flush(t)


_OPEN = pa.schema([("gram", pa.int64()), ("slab", pa.int64()), ("first", pa.int32()), ("order", pa.int64()), ("h", pa.int64())])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            t = b.slice(lo, BLOCK)
            owner, place, h = _windows(*_words(t.column("content")))
            at = pa.array(owner)
            yield C.batch(_OPEN, t.column("gram").take(at), t.column("slab").take(at), place.astype(np.int32), t.column("order").take(at), C.signed(h))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses slabs, each with the slabs that hold windows of it."""
    for b in batches:
        out = [[] for _ in _PART]
        for gram, slab, content, sources in zip(*(c.to_pylist() for c in b.columns)):
            parts = [content, *(s["content"] for s in sources)]
            values = np.frombuffer(b"".join(parts), np.uint64)
            off = np.concatenate([[0], np.cumsum([len(p) // 8 for p in parts])])
            n = off[1] - WINDOW + 1
            source, source_place = np.full(n, -1), np.zeros(n, np.int64)
            for k, s in enumerate(sources):
                at = np.array([p["first"] for p in s["places"]])
                source[at], source_place[at] = k + 1, [p["from_first"] for p in s["places"]]
            _, first, words, of, of_first = parse(values, off, np.zeros(n, np.int64), np.arange(n), source, source_place)
            rows = ([gram] * len(first), [slab] * len(first), first.tolist(), words.tolist(), [sources[k - 1]["from_slab"] for k in of], of_first.tolist())
            for column, more in zip(out, rows):
                column.extend(more)
        yield C.batch(_PART, *out)


def slab_factors(disputed: DataFrame) -> DataFrame:
    """(gram, slab, first, words, from_slab, from_first): factors of slabs, in words of the slabs."""
    usual = disputed.where(F.col("kinds") <= BLOCK).repartition("gram").sortWithinPartitions("gram", "order", "slab")
    parsed = usual.mapInArrow(_blocks, _PART_DDL)
    huge = disputed.where(F.col("kinds") > BLOCK).select("gram", "slab", "order", "content")
    windows = C.cut(huge.mapInArrow(_open, "gram long, slab long, first int, order long, h long"))
    lead = windows.groupBy("gram", "h").agg(F.min(F.struct("order", "slab", "first")).alias("lead"), F.max("order").alias("most"))
    lead = lead.where("lead.order < most").select(F.col("gram").alias("g"), "h", "lead")
    hits = windows.join(lead, (F.col("gram") == F.col("g")) & (windows["h"] == lead["h"])).where("order > lead.order")
    places = F.collect_list(F.struct("first", F.col("lead.first").alias("from_first"))).alias("places")  # at most a slab's windows
    hits = hits.groupBy("gram", "slab", F.col("lead.slab").alias("from_slab")).agg(places).withColumn("salt", F.pmod(F.col("slab"), F.lit(SALT)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt")
    sources = hits.select("gram", "from_slab").distinct().join(huge.select("gram", F.col("slab").alias("from_slab"), "content"), ["gram", "from_slab"]).select("*", salts)
    named = hits.join(sources, ["gram", "from_slab", "salt"]).groupBy("gram", "slab").agg(F.collect_list(F.struct("from_slab", "content", "places")).alias("sources"))
    more = huge.join(named, ["gram", "slab"]).select("gram", "slab", "content", "sources").mapInArrow(_named, _PART_DDL)
    return parsed.unionAll(more)


def _factors(keyed_docs: DataFrame) -> DataFrame:
    table = R.of_repeated_grams(R.runs(keyed_docs, R.word_symbols, WINDOW, GRAM))
    whole, disputed = R.spread(table)
    disputed = C.cut(disputed)
    parts = C.cut(slab_factors(C.cut(R.fetch(keyed_docs, disputed, R.word_symbols, WINDOW, False))))
    at = [F.col("at.id").alias("from_id"), F.col("at.th").alias("from_th"), F.col("at.start").alias("from_start")]
    mine = F.coalesce("id", F.lit((1 << 63) - 1))
    # copies of a slab in later documents are factors of its first one
    full = table.join(whole.select("gram", "slab", F.col("at.order").alias("least"), *at), ["gram", "slab"]).where(mine > F.col("least"))
    full = full.select("id", "th", "start", (F.col("windows") - 1 + WINDOW).alias("words"), "from_id", "from_th", "from_start")
    # the first document that has a slab holds the factors found inside it
    some = parts.join(disputed.select("gram", F.col("slab").alias("from_slab"), *at), ["gram", "from_slab"])
    some = some.join(disputed.select("gram", "slab", F.col("at.order").alias("least")), ["gram", "slab"])
    some = table.join(some, ["gram", "slab"]).where(mine == F.col("least"))
    some = some.select("id", "th", (F.col("start") + F.col("first")).alias("start"), "words", "from_id", "from_th", (F.col("from_start") + F.col("from_first")).alias("from_start"))
    return full.unionAll(some)


def _of_documents(keyed_docs: DataFrame) -> DataFrame:
    """(id, th, spans): the factors of each document, as many as its text has runs at most a few times."""
    return _factors(keyed_docs).groupBy("id", "th").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("words")).alias("end"), "from_id", "from_th", "from_start")).alias("spans"))


def joined(factors: list[tuple]) -> list[tuple]:
    """Factors (start, end, document, its text, place there) with the pieces of
    one that overlap or touch put together, in the order of start."""
    out: list[list] = []
    last: dict[tuple, list] = {}
    for s, e, *of, at in sorted(factors, key=lambda f: (f[0], f[1], str(f[2:]))):
        same = (*of, at - s)
        if (f := last.get(same)) is not None and s <= f[1]:
            f[1] = max(e, f[1])
        else:
            last[same] = f = [s, e, *of, at]
            out.append(f)
    return [tuple(f) for f in out]


def _spans(value: pa.ListScalar) -> list[tuple]:
    return joined(list(zip(*(c.to_pylist() for c in value.values.flatten())))) if value.is_valid else []


_FACTOR = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("from_doc_id", pa.int64()), ("from_start", pa.int64())])


def factors(docs: DataFrame) -> DataFrame:
    """(doc_id, start, words, from_doc_id, from_start): every factor, in words;
    its words are those of an earlier document at ``from_start``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, s, e - s, of, at) for doc, spans in zip(b.column(0).to_pylist(), b.column(1)) for s, e, of, _, at in _spans(spans)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _FACTOR)], schema=_FACTOR)

    return _of_documents(R.keyed(docs)).select("id", "spans").mapInArrow(run, "doc_id long, start long, words long, from_doc_id long, from_start long")


def duplicated(docs: DataFrame) -> DataFrame:
    """(id, text, spans) of every document: its factors are the word ranges to remove."""
    k = R.keyed(docs)
    return R.with_spans(k, _of_documents(k))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_factors", pa.int64())])


def digest(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = (text or "").encode().split()  # at space, tab, newline, vertical tab, form feed, return
                n, gone, own = len(words), 0, _spans(spans)
                for s, e in reversed(R.union([f[:2] for f in own])):
                    del words[s:e]
                    gone += e - s
                rows.append((doc, n, gone, hashlib.sha256(b" ".join(words)).hexdigest(), len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _OUT)], schema=_OUT)

    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Counts and digest of what is left of every document."""
    return digest(duplicated(docs))
