"""Personal data with a semi-Markov conditional random field.

Base patterns find emails, IP addresses, cards and phone numbers exactly.  The
field then scores whole candidate spans of up to ``MAX_TOKENS`` tokens with
features of the span as a whole (shape, digit groups, Luhn, character classes,
the word before it); dynamic programming over each region of bounded length
chooses boundaries and types together.  Spans that are found with enough
certainty and touch no base span are added, with kind ``secret`` besides the
four.  The weights are trained here, by the gradient of the conditional
likelihood, on at most ``FIT_REGIONS`` regions of the table, labelled by the
base patterns and by the marked secrets of ``SEEDS``.

Defined cases: a null text is an empty one and has no spans; rows with null or
repeated ``doc_id`` are searched row by row; an empty table (or one without a
region) fits no weights and adds nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm import common as C

# The base patterns, and the order of kinds.
KINDS = ("email", "ip", "card", "phone", "secret")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Marked secrets, the labels from which the field learns what a secret is like.
SEEDS = re.compile(r"(?:password|passwd|token|secret|api_key)\s?[=:]\s?\"?([A-Za-z0-9_-]{12,})|(?<![A-Za-z0-9])(AKIA[A-Z0-9]{16})(?![A-Za-z0-9])")

#: Bounds of the fit and of a region.
FIT_REGIONS, FIT_EPOCHS = 1500, 6
MAX_TOKENS, SIDE_TOKENS, MAX_REGION = 5, 2, 24
MIN_CERTAINTY = 0.9
_TRIGGER = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0d]+")
_SPACE = " \t\n\v\f\r"
_EDGE = "\"'.,;:!?()[]{}<>=«»“”"
_N = 1 << 12


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out: list[tuple[int, int, int]] = []
    at = text.find("@")
    last = 0
    while at >= 0:
        # the longest run before the sign, not reaching into the match before
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
            out.append((1, *m.span()))
    cards, phones = [], []
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            cards.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                phones.append((3, *m.span()))
    return out + cards + phones


def regions(text: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Stretches of tokens around digits and @ signs: (start, end, tokens), at
    most MAX_REGION tokens each, longer ones in consecutive parts.  Tokens are
    words without their outer punctuation."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    spans: list[list[int]] = []
    at = 0
    while m := _TRIGGER.search(text, at):
        s = m.start()
        while s and text[s - 1] not in _SPACE:
            s -= 1
        at = e = _TOKEN.match(text, s).end()
        for _ in range(SIDE_TOKENS):
            while s and text[s - 1] in _SPACE:
                s -= 1
            while s and text[s - 1] not in _SPACE:
                s -= 1
            t = _TOKEN.search(text, e)
            e = t.end() if t else e
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(e, spans[-1][1])
        else:
            spans.append([s, e])
    for s, e in spans:
        tokens = []
        for t in _TOKEN.finditer(text, s, e):
            a, b = t.span()
            # a key and its value are two tokens
            for sub in re.finditer(r"[^=:]+", t[0]) if re.search(r"[A-Za-z_][=:]", t[0]) else [None]:
                x, y = (a, b) if sub is None else (a + sub.start(), a + sub.end())
                while x < y and text[x] in _EDGE:
                    x += 1
                while y > x and text[y - 1] in _EDGE:
                    y -= 1
                if x < y:
                    tokens.append((x, y))
        for k in range(0, len(tokens), MAX_REGION):
            part = tokens[k : k + MAX_REGION]
            out.append((part[0][0], part[-1][1], part))
    return out


def _shape(s: str) -> str:
    """Runs of letters, digits and signs, each run once with its length class."""
    out = []
    for m in re.finditer(r"[0-9]+|[A-Z]+|[a-z]+|[^\x00-\x7f]+|\s+|[^0-9A-Za-z\s]", s):
        c = m[0][0]
        kind = "9" if c.isdigit() and c < "\x80" else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "u" if c > "\x7f" else "_" if c.isspace() else c
        out.append(kind + (str(min(len(m[0]), 4)) if kind in "9" else ""))
        if len(out) == 14:
            out.append("~")
            break
    return "".join(out)


def span_features(text: str, start: int, end: int, n_tokens: int, before: str) -> list[int]:
    """Hashed features of a whole span."""
    s = text[start:end]
    digits = re.sub(r"[^0-9]", "", s)
    letters = sum(c.isalpha() for c in s)
    mixed = bool(digits) and letters > 0
    groups = re.findall(r"[0-9]+", s)
    names = [
        "bias", f"shape {_shape(s)}", f"tokens {n_tokens}", f"digits {min(len(digits), 24)}", f"groups {min(len(groups), 6)}",
        f"luhn {len(digits) >= 13 and luhn(digits)}", f"at {s.count('@')}", f"dots {min(s.count('.'), 5)}", f"plus {s[:1] == '+'}",
        f"small {len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)}", f"mixed {mixed} {min(len(s) // 4, 10)}",
        f"before {before}", f"kind {bool(digits)} {min(letters, 3)} {'@' in s}", f"length {min(len(s), 40)}", f"changes {min(len(re.findall(r'[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])', s)), 6)}",
    ]
    return [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=4).digest(), "little") % _N for n in names]


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(first token, past the last, features): every token alone, and each
    longer span (of tokens that blanks or few signs part) that begins and ends
    with a token holding a digit or @."""
    marks = [bool(_TRIGGER.search(text, a, b)) for a, b in tokens]
    out = []
    for i, (a, _) in enumerate(tokens):
        before = text[tokens[i - 1][0] : tokens[i - 1][1]].lower()[:12] if i else "^"
        if not any(c.isalpha() for c in before) or marks[i - 1]:
            before = "#" if i else "^"
        elif not re.fullmatch(r"pass\w*|token|secret|api_key|key|mail|email|tel|phone|card|ip", before):
            before = "w"
        for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1):
            b = tokens[j - 1][1]
            if j > i + 1 and (tokens[j - 1][0] - tokens[j - 2][1] > 3 or not marks[i] or not marks[j - 1]):
                break
            start = a - 1 if a and text[a - 1] == "(" and marks[i] else a
            out.append((i, j, span_features(text, start, b, j - i, before)))
    return out


class Field:
    """Weights (feature x label).  Transitions between outside (0) and the kinds
    have a place in the recursions but are not trained: they are 0."""

    def __init__(self) -> None:
        self.w = np.zeros((_N, len(KINDS) + 1))
        self.t = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def scores(self, spans: list[tuple[int, int, list[int]]]) -> np.ndarray:
        s = self.w[np.array([f for _, _, f in spans])].sum(axis=1)
        s[np.array([j - i > 1 for i, j, _ in spans]), 0] = -np.inf  # outside is one token at a time
        return s

    def sums(self, n: int, spans: list[tuple[int, int, list[int]]], s: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Forward and backward log sums per boundary and label, and the total."""
        k = s.shape[1]
        ahead, back = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        ahead[0, 0] = 0.0
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for x, (i, j, _) in enumerate(spans):
            ending[j].append(x)
            starting[i].append(x)
        for j in range(1, n + 1):
            terms = [np.logaddexp.reduce(ahead[spans[x][0]][:, None] + self.t, axis=0) + s[x] for x in ending[j]]
            ahead[j] = np.logaddexp.reduce(terms, axis=0)
        back[n] = 0.0
        for i in range(n - 1, -1, -1):
            terms = [np.logaddexp.reduce(self.t + (s[x] + back[spans[x][1]])[None, :], axis=1) for x in starting[i]]
            back[i] = np.logaddexp.reduce(terms, axis=0)
        return ahead, back, float(np.logaddexp.reduce(ahead[n]))

    def marginals(self, n: int, spans: list[tuple[int, int, list[int]]]) -> np.ndarray:
        s = self.scores(spans)
        ahead, back, total = self.sums(n, spans, s)
        inside = np.array([np.logaddexp.reduce(ahead[i][:, None] + self.t, axis=0) + back[j] for i, j, _ in spans])
        with np.errstate(over="ignore"):
            return np.exp(inside + s - total)

    def best(self, n: int, spans: list[tuple[int, int, list[int]]]) -> list[tuple[int, int]]:
        """(span, label) of the best segmentation: boundaries and types at once."""
        s = self.scores(spans)
        k = s.shape[1]
        top, link = np.full((n + 1, k), -np.inf), {}
        top[0, 0] = 0.0
        for x, (i, j, _) in enumerate(spans):  # in order of their first token, so top[i] is complete
            v = top[i][:, None] + self.t
            here = v.max(axis=0) + s[x]
            for y in np.flatnonzero(here > top[j]):
                top[j, y] = here[y]
                link[j, y] = x, int(v[:, y].argmax())
        out, j, y = [], n, int(top[n].argmax())
        while j:
            x, before = link[j, y]
            out.append((x, y))
            j, y = spans[x][0], before
        return out[::-1]


def gold(text: str, tokens: list[tuple[int, int]], spans: list[tuple[int, int, list[int]]]) -> list[tuple[int, int]]:
    """(span, label) of a region by the base patterns and the marked secrets."""
    known = base_spans(text) + [(4, *m.span(1 if m[1] else 2)) for m in SEEDS.finditer(text)]
    where = {(i, j): x for x, (i, j, _) in enumerate(spans)}
    out, at = [], 0
    while at < len(tokens):
        found = None
        for kind, s, e in known:
            if s <= tokens[at][0] < e:
                j = at + 1
                while j < len(tokens) and tokens[j][0] < e:
                    j += 1
                if (at, j) in where:
                    found = where[at, j], kind + 1, j
                    break
        if found:
            out.append(found[:2])
            at = found[2]
        else:
            out.append((where[at, at + 1], 0))
            at += 1
    return out


def doubtful(text: str) -> bool:
    """Whether a pattern ran over the end of one item into the next, so that
    the base rules drop both: no label to learn from."""
    sizes = [sum(c in "0123456789" for c in m[0]) for p in (_CARD, _PHONE) for m in p.finditer(text)]
    return any(n > 15 for n in sizes) and not any(k in (2, 3) for k, _, _ in base_spans(text))


def fit(texts: list[str], epochs: int = FIT_EPOCHS, rate: float = 0.4) -> Field:
    """Stochastic gradient of the conditional likelihood over labelled regions."""
    field = Field()
    data = []
    for text in texts:
        for _, _, tokens in [] if doubtful(text) else regions(text):
            spans = candidates(text, tokens)
            data.append((len(tokens), spans, gold(text, tokens, spans)))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for n, spans, labels in data:
            p = field.marginals(n, spans)
            truth = np.zeros_like(p)
            for x, y in labels:
                truth[x, y] = 1.0
            delta = step * (truth - p)
            moved = np.flatnonzero(np.abs(delta).sum(axis=1) > 1e-4)
            for x in moved:
                np.add.at(field.w, spans[x][2], delta[x])
    return field


def region_table(docs: DataFrame) -> DataFrame:
    """(h, region): texts of the regions, with a character more on either side."""
    schema = pa.schema([("h", pa.int64()), ("region", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [text[max(0, s - 1) : e + 1] for text in b.column(0).to_pylist() if text for s, e, _ in regions(text)]
            h = [int.from_bytes(hashlib.blake2b(r.encode(), digest_size=8).digest(), "little", signed=True) for r in out]
            yield C.batch(schema, h, out)

    return C.columns(docs, "text").mapInArrow(run, "h long, region string")


def train(docs: DataFrame, fit_regions: int = FIT_REGIONS) -> Field:
    """The field for a table: fitted on the ``fit_regions`` distinct regions of least hash."""
    rows = region_table(docs).distinct().orderBy("h", "region").limit(fit_regions).collect()
    return fit([r["region"] for r in rows])


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def find(text: str, field: Field, min_certainty: float = MIN_CERTAINTY) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans of a text, and the spans that the field adds."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    added = []
    for s, e, tokens in regions(text):
        spans = candidates(text, tokens)
        labels = field.best(len(tokens), spans)
        if not any(y for _, y in labels):
            continue
        p = field.marginals(len(tokens), spans)
        for x, y in labels:
            if y and p[x, y] >= min_certainty:
                a, b = tokens[spans[x][0]][0], tokens[spans[x][1] - 1][1]
                if not any(u < b and a < v for u, v in taken):
                    added.append((y - 1, a, b))
    return base, added


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, field: Field, min_certainty: float = MIN_CERTAINTY) -> DataFrame:
    """Counts, digest of the base spans and all spans, per document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((field.w.astype(np.float32), field.t))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field()
        own.w, own.t = shared.value
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base, added = find(text or "", own, min_certainty)
                counts = [sum(k == x for k, _, _ in base) for x in range(4)]
                rows.append((doc, *counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(sorted(base + added)), len(added)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_OUT), _OUT)], schema=_OUT)

    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return C.columns(docs, "doc_id", "text").mapInArrow(run, ddl)


def search(docs: DataFrame, fit_regions: int = FIT_REGIONS, min_certainty: float = MIN_CERTAINTY) -> DataFrame:
    return detect(docs, train(docs, fit_regions), min_certainty)
