"""Chat formatting with schema fingerprinting.

A record is JSON in any of several layouts (prompt and response, instruction,
message lists).  The sorted set of its nested field paths is hashed, and the
hash selects a declarative mapping that turns the record into canonical turns
(role, text).  Turns are written with a template whose control strings are
escaped inside texts, so the output reads back to exactly the turns and to the
spans that the loss covers (texts of the assistant).

Defined cases: null texts and roles are empty strings; a record without turns
formats to the empty string; a layout that is not declared has status
``unknown`` and no turns (it is not dropped); turns with the same number keep
the order (turn, role, text); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm import common as C

# The template's marks and other control strings that texts may hold.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ANY = "|".join(map(re.escape, CONTROL))
_MARK = re.compile(rf"(?<!\\)(\\*)({_ANY}|\Z)")
_REAL = re.compile(rf"(?<!\\)(\\*)({re.escape(CLOSE)})")

#: Layouts.  ``list``: a field with one object per turn, and its role and text
#: fields.  ``fields``: a role for each field, in order; a question mark marks
#: a field that may be absent.
LAYOUTS = (
    {"name": "messages", "list": "messages", "role": "role", "text": "content"},
    {"name": "conversations", "list": "conversations", "role": "from", "text": "value"},
    {"name": "turns", "list": "turns", "role": "speaker", "text": "text"},
    {"name": "prompt", "fields": (("system?", "system"), ("prompt", "user"), ("response", "assistant"))},
    {"name": "completion", "fields": (("prompt", "user"), ("completion", "assistant"))},
    {"name": "question", "fields": (("context?", "system"), ("question", "user"), ("answer", "assistant"))},
    {"name": "instruction", "fields": (("system?", "system"), ("instruction", "user"), ("input?", "user"), ("output", "assistant"))},
)
#: Names of the same role in layouts with named speakers.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths with the kind of each leaf; list items share a path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {f"{at}{{}}"}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {f"{at}:{'text' if isinstance(value, str) else 'null' if value is None else 'number'}"}


def schema_hash(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def registry(layouts: tuple[dict, ...] = LAYOUTS) -> dict[str, dict]:
    """Mapping by the fingerprint of every shape that a layout may take."""
    out: dict[str, dict] = {}
    for x in layouts:
        if "list" in x:
            out[schema_hash({f"{x['list']}[].{x['role']}:text", f"{x['list']}[].{x['text']}:text"})] = x
            out[schema_hash({f"{x['list']}[]"})] = x
            continue
        choices = [((f[:-1], None) if f.endswith("?") else (f,)) for f, _ in x["fields"]]
        for chosen in itertools.product(*choices):
            out.setdefault(schema_hash({f"{f}:text" for f in chosen if f}), x)
    return out


def turns_of(record: dict, layout: dict) -> list[tuple[str, str]]:
    if "list" in layout:
        named = layout["role"] != "role"
        return [(ROLES.get(m[layout["role"]], m[layout["role"]]) if named else m[layout["role"]], m[layout["text"]]) for m in record[layout["list"]]]
    return [(role, record[f.rstrip("?")]) for f, role in layout["fields"] if f.rstrip("?") in record]


def escape(text: str) -> str:
    """Backslashes before a control string, or at the end, are doubled, and a
    control string gets one more: no mark inside a text is a real one."""
    return _MARK.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text, and the spans that the loss covers."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{quote(role, safe='')}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from the formatted text alone."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("no turn begins here")
        line = formatted.index("\n", at)
        role, body = unquote(formatted[at + len(OPEN) : line]), line + 1
        end = next(m for m in _REAL.finditer(formatted, body) if len(m[1]) % 2 == 0)
        out.append((role, unescape(formatted[body : end.start(2)])))
        at = end.end() + 1
    return out


_SHAPE = pa.schema([("key", pa.int64()), ("schema_hash", pa.string()), ("layout", pa.string()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.list_(pa.int64())))])


def format_records(records: DataFrame) -> DataFrame:
    """(key, schema_hash, layout, formatted, loss_spans) of (key long, record JSON)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry()
        for b in batches:
            rows = []
            for key, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                value = json.loads(record) if record else {}
                mark = schema_hash(paths(value))
                layout = known.get(mark)
                text, spans = render(turns_of(value, layout)) if layout else ("", [])
                rows.append((key, mark, layout["name"] if layout else "unknown", text, [list(s) for s in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _SHAPE)], schema=_SHAPE)

    return records.select(F.col("key").cast("long").alias("key"), F.col("record").cast("string").alias("record")).mapInArrow(run, "key long, schema_hash string, layout string, formatted string, loss_spans array<array<long>>")


def records_of(conversations: DataFrame) -> DataFrame:
    """(key, record): each conversation as JSON, in the layout that its roles
    suggest: user and assistant as prompt and response, a system turn before
    them as instruction, anything else as a message list."""
    c = conversations.select(F.col("conv_id").cast("long").alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    g = c.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles = F.concat_ws(",", F.transform("t", lambda x: x["role"]))
    text = lambda i: F.col("t")[i]["text"]
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    pair = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    guided = F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")))
    n = F.size("t")
    return g.select("key", F.when((n == 2) & (roles == "user,assistant"), pair).when((n == 3) & (roles == "system,user,assistant"), guided).otherwise(messages).alias("record"))


_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("layout", pa.string())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, both taken from the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, _, layout, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                turns, all_turns, loss, chars = parse(text), hashlib.sha256(), hashlib.sha256(), 0
                for role, body in turns:
                    all_turns.update(f"{role}\n{body}\n".encode())
                for s, e in spans:
                    part = unescape(text[s:e])
                    loss.update(part.encode())
                    chars += len(part)
                rows.append((key, len(turns), all_turns.hexdigest(), chars, loss.hexdigest(), len(text), layout))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, _OUT)], schema=_OUT)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string")
