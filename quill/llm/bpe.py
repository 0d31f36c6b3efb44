"""Byte-level BPE as a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its bytes exactly if every two
neighbours are (the encoding of their joined bytes is the two themselves), so
the encoding can be read off left to right: after each byte, precisely one
token can end the encoding of the prefix.  The transducer follows all open
hypotheses (a node of the vocabulary's trie and the tokens still pending before
it), emits what all hypotheses agree on, and so emits every token after a
lookahead that the longest token bounds.  States and transitions are made when
first met, and the table is emptied when it reaches its bound.

Decoding is streamed: bytes go through an incremental UTF-8 state machine that
holds back an unfinished character.

Defined cases: a null text is empty and has no tokens; invalid bytes decode to
the replacement character in text form and are kept in byte form; rows with
null or repeated ``doc_id`` are encoded row by row; an empty table gives an
empty result; other columns are not read by ``encoded``.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quill.llm import common as C

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Bounds of the lazily filled tables of a task (about 130, 200 and 100 bytes an
#: entry, and 350 for each state, of which there are five for nine transitions:
#: 270 MB in all); a full table is emptied, and all are when the task ends.
MAX_TRANSITIONS = 450_000
MAX_PIECES = 250_000
MAX_PAIRS = 400_000
#: The same where other stages share the workers' memory.
SHARED_TRANSITIONS = 180_000
SHARED_PIECES = 100_000
_NEVER = 1 << 60
_STATE = (1 << 32) - 1


def read_ranks(name: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encoder over byte strings for a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], max_transitions: int = MAX_TRANSITIONS) -> None:
        self.ranks, self.limit = ranks, max_transitions
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.pairs: dict[int, bool] = {}
        # Tokens that their own merges do not make never stand in an encoding
        # of several tokens; a piece that is such a token is that token.
        self.child: dict[int, int] = {}  # node and byte -> node
        self.token: list[int] = [-1]
        self.grows: list[bool] = [True]
        self.whole: dict[bytes, int] = {}
        # Per token: rank and bytes of what stands at its right (left) end as
        # its merges go on, from the single byte to the token itself.
        self.right: dict[int, list[tuple[int, bytes]]] = {}
        self.left: dict[int, list[tuple[int, bytes]]] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self.merge(t, 2)
            if len(t) > 1 and (len(parts) != 2 or any(p not in ranks or ranks[p] not in self.right for p in parts)):
                self.whole[t] = i
                continue
            own = [(i, t)]
            self.left[i] = (self.left[ranks[parts[0]]] if len(t) > 1 else []) + own
            self.right[i] = (self.right[ranks[parts[1]]] if len(t) > 1 else []) + own
            node = 0
            for b in t:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.grows.append(False)
                    self.grows[node] = True
                node = nxt
            self.token[node] = i
        self.reset()

    def reset(self) -> None:
        """Only the start state: nothing emitted yet, one hypothesis at the root."""
        start = (-1, ((0, ()),))
        self.states: list[tuple] = [start]
        self.number = {start: 0}
        # State and byte -> next state, and above 32 bits the number of what is emitted.
        self.step: dict[int, int] = {}
        self.emits: list[tuple[int, ...]] = [()]
        self.emit_number: dict[tuple[int, ...], int] = {(): 0}

    def full(self) -> bool:
        return len(self.step) >= self.limit or 9 * len(self.states) >= 5 * max(self.limit, 9)

    def merge(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """Repeated merging of the lowest rank, leftmost first, down to ``stop``
        parts: the definition, used on the vocabulary's own tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > stop:
            best, at = min(((ranks.get(a + b, _NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether b can stand right after a: while both grow by their own
        merges, no merge across their border may come first."""
        ok = a < 0
        if not ok:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            right, left, i, j, ok = self.right[a], self.left[b], 0, 0, True
            while True:
                grow_a = right[i + 1][0] if i + 1 < len(right) else _NEVER
                grow_b = left[j + 1][0] if j + 1 < len(left) else _NEVER
                across = self.ranks.get(right[i][1] + left[j][1], _NEVER)
                if across < grow_a and across <= grow_b:  # on equal ranks the leftmost merge is first
                    ok = across == _NEVER
                    break
                if grow_a == grow_b == _NEVER:
                    break
                if grow_a <= grow_b:
                    i += 1
                else:
                    j += 1
            self.pairs[a << 32 | b] = ok
        return ok

    def advance(self, state: int, byte: int) -> int:
        """The transition of a state and byte."""
        before, hypotheses = self.states[state]
        child, token, grows, pairs = self.child, self.token, self.grows, self.pairs
        after: list[tuple[int, tuple[int, ...]]] = []
        done: tuple[int, ...] | None = None
        for node, pending in hypotheses:
            nxt = child.get(node << 8 | byte)
            if nxt is None:
                continue
            if done is None and (t := token[nxt]) >= 0:
                last = pending[-1] if pending else before
                ok = pairs.get(last << 32 | t)
                if ok or ok is None and self.follows(last, t):
                    done = (*pending, t)
            if grows[nxt]:
                after.append((nxt, pending))
        if done is None:
            raise ValueError("bytes outside the vocabulary")
        after.append((0, done))
        common = after[0][1]
        if common:
            k = min([len(pending) for _, pending in after])
            while k and any([pending[:k] != common[:k] for _, pending in after]):
                k -= 1
            common = common[:k]
            if k:
                before = common[-1]
                after = [(node, pending[k:]) for node, pending in after]
            elif min([len(pending) for _, pending in after]):
                before = -2  # no longer looked at
        key = (before, tuple(after))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        if common:
            emitted = self.emit_number.get(common)
            if emitted is None:
                emitted = self.emit_number[common] = len(self.emits)
                self.emits.append(common)
            number |= emitted << 32
        self.step[state << 8 | byte] = number
        return number

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.whole.get(piece)) is not None:
            return [whole]
        if self.full():
            self.reset()
        state, out, step, emits = 0, [], self.step, self.emits
        for byte in piece:
            found = step.get(state << 8 | byte)
            if found is None:
                if self.full():  # keep the current state, drop the rest
                    here = self.states[state]
                    self.reset()
                    step, emits = self.step, self.emits
                    state = self.number.setdefault(here, len(self.states))
                    if state == len(self.states):
                        self.states.append(here)
                found = self.advance(state, byte)
            state = found & _STATE
            if found > _STATE:
                out += emits[found >> 32]
        for node, pending in self.states[state][1]:
            if node == 0:
                out.extend(pending)
        return out


class Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers, filled as met.
    A full table becomes the old one, from which pieces met again come back, so
    frequent pieces stay and memory is bounded by two tables."""

    def __init__(self, transducer: Transducer, max_pieces: int = MAX_PIECES) -> None:
        super().__init__()
        self.transducer, self.limit = transducer, max_pieces
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            found = self.transducer.encode(piece.encode("utf-8"))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def release(self) -> None:
        """Empty all tables that fill up as texts are met."""
        self.clear()
        self.old = {}
        self.transducer.reset()
        self.transducer.pairs.clear()


class Utf8Stream:
    """Incremental UTF-8 decoding: feed bytes, get the characters that are
    complete; an unfinished character waits.  Its states are the bytes held
    back, at most three; anything that cannot become a character is U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end may begin a character."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
            if need <= back:
                return 0
            if back > 1:  # the first continuation byte is restricted after these
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self._unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Decoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.table[i] = t

    def stream(self, ids: Sequence[int], step: int = 4096) -> Iterator[str]:
        """Text of the ids, a part for each ``step`` of them."""
        machine, get = Utf8Stream(), self.table.__getitem__
        for k in range(0, len(ids), step):
            yield machine.feed(b"".join(map(get, ids[k : k + step])))
        yield machine.close()


_worker: dict[str, tuple] = {}


def _tools(name: str) -> tuple:
    """The tables of this worker, made once per rank file."""
    if name not in _worker:
        import public_tokenizers
        import regex

        ranks = read_ranks(name)
        _worker[name] = regex.compile(public_tokenizers.PATTERN), Pieces(Transducer(ranks)), Decoder(ranks)
    return _worker[name]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("decoded_chars", pa.int64())])


def encoded(docs: DataFrame, ranks: str = RANK_FILE) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text as an array."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, pieces, _ = _tools(ranks)
        pieces.limit, pieces.transducer.limit = SHARED_PIECES, SHARED_TRANSITIONS
        gc.disable()  # the tables hold millions of small tuples and no cycles
        for b in batches:
            for i, j in C.row_blocks(C.utf8(b.column(1))[1], 1 << 20):
                rows = [b"".join(map(pieces.__getitem__, pattern.findall(t or ""))) for t in b.column(1).slice(i, j - i).to_pylist()]
                values = pa.array(np.frombuffer(b"".join(rows), dtype="<i4"), type=pa.int32())
                yield C.batch(schema, b.column(0).slice(i, j - i), C.list_array(values, np.array([len(r) // 4 for r in rows], dtype=np.int64)))
        gc.enable()
        pieces.release()
        _worker.pop(ranks, None)  # the stages of a pipeline share their workers

    return C.columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, ranks: str = RANK_FILE) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _tools(ranks)[2]
        for b in batches:
            yield C.batch(schema, b.column(0), pa.array(["".join(decoder.stream(x.as_py() or ())) for x in b.column(1)], type=pa.string()))

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks: str = RANK_FILE) -> DataFrame:
    """Per document: number of tokens, digests of the ids and of the bytes that
    the ids decode to, and the characters decoded.  Ids of a text live in one
    task only as long as its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, pieces, decoder = _tools(ranks)
        gc.disable()  # the tables hold millions of small tuples and no cycles
        for b in batches:
            for i, j in C.row_blocks(C.utf8(b.column(1))[1], 1 << 22):
                n, ids_sha, out_sha, chars = [], [], [], []
                for t in b.column(1).slice(i, j - i).to_pylist():
                    ids = b"".join(map(pieces.__getitem__, pattern.findall(t or "")))
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    digest, count = hashlib.sha256(), 0
                    for part in decoder.stream(np.frombuffer(ids, dtype="<u4").tolist()):
                        digest.update(part.encode("utf-8"))
                        count += len(part)
                    out_sha.append(digest.hexdigest())
                    chars.append(count)
                yield C.batch(_OUT, b.column(0).slice(i, j - i), n, ids_sha, out_sha, chars)
        pieces.release()
        gc.enable()

    return C.columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long")
