"""Merkle manifest of a table: a tree of SHA-256 digests per language, one over
the languages' roots, and for every row the siblings on its way to the root.

Leaves of a language are numbered by doc_id and cut into aligned blocks of
2**BLOCK_BITS.  A block hashes its own subtree.  Then blocks exchange subtree
roots as a butterfly: in round r, the FANOUT blocks (fewer at the end) that
differ only in the r-th digit of their number to the base FANOUT meet, and each
of them hashes the ancestors over all their roots for itself.  After the last
round every block holds all siblings above it and the root; nothing is handed
down the tree.  A subtree cut short by the end of a language has fewer blocks
than its neighbours have partners for, so its blocks send their root to each
partner that would miss one.  The languages' roots go through the same steps as
one more group.

``manifest`` returns per row its leaf and its proof, one entry a level from the
leaf upwards: 'l' or 'r' (the side on which the sibling stands) and the
sibling's digest, or an empty string where the node has none and is hashed
alone.  ``fold`` recomputes the root from a leaf and a proof.

Defined cases: a null column counts as ``-``; null and repeated doc_ids have
leaves like any other, null first, rows of one doc_id in the order of their
leaves; a null language is a language of its own, before the others; a null
``n_chars`` cannot be altered by ``altered``; an empty table gives an empty
manifest; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.llm import common as C
from quill.llm.positions import numbered

#: Leaves of a block as a power of two, and blocks (a power of two) that meet in a round.
BLOCK_BITS = 12
FANOUT_BITS = 4


def _field(c: str) -> Column:
    text = F.col(c).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(n_chars: Column | None = None) -> Column:
    """Digest of a row of documents, with another n_chars if one is given."""
    count = _field("n_chars")
    if n_chars is not None:
        count = F.when(n_chars.isNull(), "-").otherwise(F.concat(F.length(n_chars.cast("string")).cast("string"), F.lit(":"), n_chars.cast("string")))
    return F.sha2(F.concat(_field("doc_id"), _field("source"), _field("lang"), count, _field("text")), 256)


def _digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels between n leaves and their root."""
    return (n - 1).bit_length()


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and each of ``levels`` levels above them; a last node without a neighbour is hashed alone."""
    out = [nodes]
    for _ in range(levels):
        out.append([_digest(out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels: list[list[str]], i: int) -> list[str]:
    """Proof entries of node i of the lowest level up to the highest, which is not looked at."""
    out = []
    for nodes in levels[:-1]:
        j = i ^ 1
        out.append(("l" if j < i else "r") + nodes[j] if j < len(nodes) else "")
        i >>= 1
    return out


_STATE = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("node", pa.string()), ("upper", pa.list_(pa.string()))])
_STATE_DDL = "grp string, block long, n long, node string, upper array<string>"


def _blocks(placed: DataFrame, bits: int, kept: tuple[str, ...] = ()) -> DataFrame:
    """(grp, block, n, leaves in order) of numbered leaves."""
    own = F.struct("pos", F.col("leaf").alias("digest"), *kept)
    return placed.groupBy("grp", F.shiftright("pos", bits).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(own)).alias("leaves"))


def _roots(placed: DataFrame, bits: int) -> DataFrame:
    """Of each block the root of its subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [climb([x["digest"] for x in each.as_py()], min(bits, height(k.as_py())))[-1][0] for k, each in zip(b.column(2), b.column(3))]
            yield C.batch(_STATE, b.column(0), b.column(1), b.column(2), nodes, [[]] * len(nodes))

    return _blocks(placed, bits).mapInArrow(run, _STATE_DDL)


def _exchange(state: DataFrame, r: int, block_bits: int, digits: int) -> DataFrame:
    """Round r of the butterfly."""
    span = digits * r
    blocks = F.shiftright(F.col("n") - 1, block_bits) + 1
    low = F.col("block").bitwiseAND((1 << span) - 1)
    # Blocks of the own subtree; if they are fewer than partners ask for, they serve those in turn.
    here = F.least(F.lit(1 << span), blocks - F.shiftleft(F.shiftright("block", span), span))
    first = F.shiftright("block", span + digits) == F.shiftright(blocks - 1, span + digits)
    alone = first & (F.shiftright("block", span).bitwiseAND((1 << digits) - 1) == 0)
    asked = F.when((here == 1 << span) | alone, F.array(low)).otherwise(F.sequence(low, F.lit((1 << span) - 1).cast("long"), here))
    sent = state.select("grp", "n", F.shiftright("block", span + digits).alias("part"), F.explode(asked).alias("low"), low.alias("__low"),
                        F.shiftright("block", span).alias("at"), "node", "block", "upper")
    own = F.col("low") == F.col("__low")
    member = F.struct("at", "node", F.when(own, F.col("block")).alias("block"), F.when(own, F.col("upper")).alias("upper"))
    met = sent.groupBy("grp", "part", "low").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(member)).alias("members"))
    bits = block_bits + span

    def ancestors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for grp, n, members in zip(*(b.column(k).to_pylist() for k in range(3))):
                levels = climb([m["node"] for m in members], max(0, min(digits, height(n) - bits)))
                for k, m in enumerate(members):
                    if m["block"] is not None:
                        out.append((grp, m["block"], n, levels[-1][0], m["upper"] + siblings(levels, k)))
            yield C.batch(_STATE, *(list(zip(*out)) or [[]] * 5))

    return met.select("grp", "n", "members").mapInArrow(ancestors, _STATE_DDL)


def butterfly(placed: DataFrame, block_bits: int, fanout_bits: int) -> DataFrame:
    """(grp, block, n, node, upper) of numbered leaves (grp, leaf, pos, n):
    node is the root of the group, upper the proof entries above the block."""
    state = C.cut(_roots(placed, block_bits))
    top = state.agg(F.max("n")).first()[0] or 1
    for r in range(-(-max(0, height(top) - block_bits) // fanout_bits)):
        state = C.cut(_exchange(state, r, block_bits, fanout_bits))
    return state


def _proofs(placed: DataFrame, state: DataFrame, bits: int, kept: dict[str, str]) -> DataFrame:
    """(kept, leaf, pos, n, top, proof) of numbered leaves; kept are columns to
    pass on.  Each block hashes its subtree again instead of storing it."""
    joined = _blocks(placed, bits, tuple(kept)).join(state.drop("n"), ["grp", "block"]).select("leaves", "n", "node", "upper")
    schema = pa.schema([(c, pa.int64() if t == "long" else pa.string()) for c, t in kept.items()]
                       + [("leaf", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("top", pa.string()), ("proof", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                leaves, n, node, upper = (b.column(c)[k].as_py() for c in range(4))
                levels = climb([x["digest"] for x in leaves], min(bits, height(n)))
                yield C.batch(schema, *[[x[c] for x in leaves] for c in kept], levels[0], [x["pos"] for x in leaves], [n] * len(leaves), [node] * len(leaves),
                              [siblings(levels, i) + upper for i in range(len(leaves))])

    ddl = ", ".join([*(f"{c} {t}" for c, t in kept.items()), "leaf string, pos long, n long, top string, proof array<string>"])
    return joined.mapInArrow(run, ddl)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    def step(node: Column, entry: Column) -> Column:
        other = F.substring(entry, 2, 64)
        return F.sha2(F.when(entry.startswith("l"), F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """Digest of the siblings of a proof."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.substring(p, 2, 64)), ""), 256)


def manifest(docs: DataFrame, block_bits: int = BLOCK_BITS, fanout_bits: int = FANOUT_BITS) -> DataFrame:
    """(doc_id, leaf, altered, subroot, root, proof) of every row of documents.
    ``altered`` is the leaf after one is added to n_chars where 7 divides the
    CRC-32 of the decimal doc_id, elsewhere null."""
    rows = C.columns(docs, "doc_id", "source", "lang", "n_chars", "text")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = C.cut(rows.select(F.concat(F.when(F.col("lang").isNull(), "0").otherwise("1"), F.coalesce("lang", F.lit(""))).alias("grp"), "doc_id",
                               leaf().alias("leaf"), F.when(hit, leaf(F.col("n_chars") + 1)).alias("altered")))
    placed = numbered(leaves, "grp", ["doc_id", "leaf"])
    state = butterfly(placed, block_bits, fanout_bits)
    langs = C.cut(state.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("lang"), F.col("node").alias("leaf")))
    places = numbered(langs, "grp", ["lang"])
    tops = _proofs(places, butterfly(places, block_bits, fanout_bits), block_bits, {"lang": "string"}).select(F.col("lang").alias("grp"), F.col("top").alias("root"), F.col("proof").alias("over"))
    full = state.join(tops, "grp").select("grp", "block", "n", F.concat("node", "root").alias("node"), F.concat("upper", "over").alias("upper"))
    out = _proofs(placed, full, block_bits, {"doc_id": "long", "altered": "string"})
    return out.select("doc_id", "leaf", "altered", F.substring("top", 1, 64).alias("subroot"), F.substring("top", 65, 64).alias("root"), "proof")


def verified(docs: DataFrame, block_bits: int = BLOCK_BITS, fanout_bits: int = FANOUT_BITS) -> DataFrame:
    """The manifest's digests, and whether each row, altered or not, still leads to the root."""
    folded = fold(F.coalesce("altered", "leaf"), F.col("proof"))
    out = manifest(docs, block_bits, fanout_bits).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
