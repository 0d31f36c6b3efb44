"""Near duplicates and repeats against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.llm import common as C
from quill.llm import line_dedup, ngram_join, repeats, substring_dedup, suffix_dedup
from tests.llm import brute

CLASHING = ("id", "n", "th", "key", "head", "a", "b", "start", "g", "__kept")


def as_rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_classes(docs_of, seed):
    rows = brute.corpus(70, seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(docs_of(rows, CLASHING)).collect()}
    assert got == brute.jaccard_classes(rows)


@pytest.mark.parametrize("size", [200_000, 7])
def test_components(spark, monkeypatch, size):
    monkeypatch.setattr(C, "FOREST_LINKS", size)
    r = random.Random(size)
    links = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 230)] + [(300, k) for k in range(301, 330)]
    got = {x["id"]: x["component"] for x in C.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    root = {}
    for _ in range(60):
        for a, b in links:
            m = min(root.get(a, a), root.get(b, b))
            root[a] = root[b] = m
    assert got == {k: v for k, v in root.items() if k != v}


def test_jaccard_short_sets(docs_of):
    r = random.Random(3)
    base = [str(i) for i in range(14)]
    rows = [(i, " ".join(base[r.randint(0, 2) : r.randint(6, 14)] + [r.choice("xy")] * r.randint(0, 1))) for i in range(60)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.classes(docs_of(rows)).collect()}
    assert got == brute.jaccard_classes(rows)


def test_jaccard_edges(docs_of):
    rows = [(None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (7, "A b c d e f g")]
    got = sorted(((x["doc_id"], x["component_id"]) for x in ngram_join.classes(docs_of(rows)).collect()), key=str)
    assert got == [(5, 5), (5, 5), (7, 5), (None, None)]
    assert sorted(((x["doc_id"]) for x in ngram_join.deduplicated(docs_of(rows)).collect()), key=str) == [5, None]
    assert ngram_join.classes(docs_of([])).collect() == []


@pytest.mark.parametrize("window", [400])
def test_repeated_bytes(docs_of, window):
    rows = brute.corpus(60, 8, vocabulary=60)
    assert as_rows(suffix_dedup.deduplicated(docs_of(rows, CLASHING))) == brute.repeated_bytes(rows, window)


def test_repeated_bytes_of_one_text(docs_of):
    r = random.Random(1)
    passage = "".join(r.choice("abcdefgh ") for _ in range(700))
    rows = [(1, passage[:500] + "#" + passage[50:]), (2, "z" * 401), (3, "ab" * 350), (4, passage[300:]), (5, None)]
    assert as_rows(suffix_dedup.deduplicated(docs_of(rows))) == brute.repeated_bytes(rows, 400)
    assert suffix_dedup.deduplicated(docs_of([])).collect() == []


@pytest.mark.parametrize("length", [450, 395, 300])
def test_large_groups_are_divided(docs_of, monkeypatch, length):
    """Many texts share a passage in surroundings that differ, or agree for a few bytes."""
    r = random.Random(length)
    passage = "".join(r.choice("abcdefgh ") for _ in range(length))

    def around(letters):
        near = "".join(r.choice(letters[:2]) for _ in range(6))
        return "".join(r.choice(letters) for _ in range(300)), near, "".join(r.choice(letters) for _ in range(120)) if r.random() < 0.5 else letters * 24

    rows = []
    for i in range(120):
        (far, near, same), (end, close, tail) = around("ijkl "), around("nopq ")
        rows.append((i, far + same + near + passage[r.randint(0, 5) :] + close + tail + end))
    monkeypatch.setattr(suffix_dedup, "BUCKET", 10)
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    want = brute.repeated_bytes(rows, 400)
    assert sum(row[2] for row in want) > 0
    assert as_rows(suffix_dedup.deduplicated(docs_of(rows))) == want


@pytest.mark.parametrize("block", [2000, 3])
def test_earlier_words(docs_of, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rows = brute.corpus(60, 9)
    assert as_rows(substring_dedup.deduplicated(docs_of(rows, CLASHING)).drop("n_factors")) == brute.earlier_words(rows, 50)


@pytest.mark.parametrize("block", [2000, 3])
def test_factors_have_sources(docs_of, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rows = brute.corpus(60, 9)
    words = {d: (t or "").encode().split() for d, t in rows}
    found = as_rows(substring_dedup.factors(docs_of(rows, CLASHING)))
    for doc, start, n, of, at in found:
        assert n >= 50 and of < doc and words[doc][start : start + n] == words[of][at : at + n]
    removed = {d: 0 for d in words}
    for d in removed:
        removed[d] = len({k for doc, start, n, _, _ in found if doc == d for k in range(start, start + n)})
    assert [(d, n) for d, n in sorted(removed.items())] == [(r[0], r[2]) for r in brute.earlier_words(rows, 50)]
    assert any(n > 100 for _, _, n, _, _ in found)  # pieces of several slabs are one factor


@pytest.mark.parametrize("block", [2000, 1])
def test_windows_over_factor_ends(docs_of, monkeypatch, block):
    """The third text goes from the first one's words to the second one's: windows
    over the end of the first factor stand in the second source only."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    w = [str(k) for k in range(200)]
    rows = [(1, " ".join(w[:100])), (2, " ".join(w[60:160])), (3, " ".join(w)), (4, " ".join(w[10:150]))]
    found = as_rows(substring_dedup.factors(docs_of(rows)))
    # the second text's shared words are too few; the third has both, overlapping
    assert [f for f in found if f[0] == 3] == [(3, 0, 100, 1, 0), (3, 60, 100, 2, 0)]
    # no word of 4 is left, and windows of words 61 to 99 have the third text alone
    assert as_rows(substring_dedup.deduplicated(docs_of(rows)).drop("n_factors")) == brute.earlier_words(rows, 50)


def test_greedy_parse():
    """A factor goes on as far as its source agrees; the next begins with the first window over its end."""
    w = np.arange(1, 200, dtype=np.uint64)
    slabs = [w[:90], w[20:110], w[10:100]]  # the last is parsed against the first two
    values, off = np.concatenate(slabs), np.concatenate([[0], np.cumsum([len(s) for s in slabs])])
    owner, place, hashes = substring_dedup._windows(values, off)
    lead = substring_dedup.first_places(owner, hashes, np.array([1, 2, 3]), np.zeros(3, np.int64))
    got = substring_dedup.parse(values, off, owner, place, np.where(lead < 0, -1, owner[lead]), place[lead])
    # 80 words of the first slab; then, from window 31 on, the second slab's
    assert [tuple(map(int, f)) for f in zip(*got) if f[0] == 2] == [(2, 0, 80, 0, 10), (2, 31, 59, 1, 21)]
    assert [tuple(map(int, f)) for f in zip(*got) if f[0] == 1] == [(1, 0, 70, 0, 20)]


def test_broadcast_by_bytes(spark, monkeypatch):
    rows = [(1, [(1, 2)] * 1000, ["é" * 50] * 10), (2, None, []), (None, [], None)]
    df = spark.createDataFrame(rows, "a long, b array<struct<x long, y long>>, c array<string>")
    # the elements of lists count, not the rows
    assert 1000 * 16 + 10 * 100 < C.table_bytes(df) < 2 * (1000 * 16 + 10 * 100)
    assert C.table_bytes(df.limit(0)) == 0
    hinted = lambda: "broadcast" in C.small(df)._jdf.queryExecution().logical().toString().lower()
    assert hinted()
    monkeypatch.setattr(C, "BROADCAST_BYTES", 16_000)
    assert not hinted()


def test_earlier_words_edges(docs_of):
    t = " ".join(map(str, range(80)))
    rows = [(4, t), (4, t), (2, "x " + t), (9, t + " " + t), (11, None)]
    assert as_rows(substring_dedup.deduplicated(docs_of(rows)).drop("n_factors")) == brute.earlier_words(rows, 50)
    null = as_rows(substring_dedup.deduplicated(docs_of([(None, t), (3, t)])).na.fill(-1))
    assert [(x[0], x[2]) for x in null] == [(-1, 80), (3, 0)]
    assert substring_dedup.deduplicated(docs_of([])).collect() == []


def test_slices_of_a_long_text(monkeypatch):
    r = np.random.default_rng(0)
    values = r.integers(0, 50, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    monkeypatch.setattr(repeats, "SLICE", 500)
    seen = []
    for before, part, edge in repeats._slices(values, np.array([0, 3000]), 50):
        _, start, count, anchor, grams, _ = repeats.runs_of(part, edge, 50, 16)
        for s, c, a, g in zip(start + before, count, anchor, grams):
            seen += [(s + k, s + a, g) for k in range(c)]
    _, start, count, anchor, grams, _ = repeats.runs_of(values, np.array([0, 3000]), 50, 16)
    assert sorted(seen) == sorted((s + k, s + a, g) for s, c, a, g in zip(start, count, anchor, grams) for k in range(c))


def test_multikey_sort():
    r = np.random.default_rng(2)
    data = r.integers(97, 99, 400).astype(np.uint8)
    at, group = np.arange(300), np.repeat([0, 1], 150)
    got, _ = suffix_dedup.multikey_sort(data, at, group, 8)
    s = [(int(g), data[a : a + 8].tobytes()) for a, g in zip(at, group)]
    assert sorted(got.tolist()) == [a for a in range(300) if s.count(s[a]) > 1]


def test_banded_distance():
    r = random.Random(0)
    a, b = [], []
    for _ in range(3000):
        x = [r.choice("abé漢") for _ in range(r.randint(0, 40))]
        y = list(x)
        for _ in range(r.randint(0, 5)):
            k = r.randint(0, len(y))
            y[k : k + r.randint(0, 1)] = [r.choice("abcé")] * r.randint(0, 1)
        a.append("".join(x))
        b.append("".join(y))
    for distance in (1, 2, 4):
        assert line_dedup.within(a, b, distance).tolist() == [brute.edit_distance(x, y) <= distance for x, y in zip(a, b)]


def test_segments_miss_no_pair():
    r = random.Random(6)
    for distance in (1, 2, 3):
        for _ in range(400):
            x = "".join(r.choice("abc") for _ in range(r.randint(12, 30)))
            y = list(x)
            for _ in range(distance):
                k = r.randint(0, len(y))
                y[k : k + r.randint(0, 1)] = [r.choice("abc")] * r.randint(0, 1)
            pair = [x, "".join(y)]
            codes = np.frombuffer("".join(pair).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            start, chars = np.array([0, len(x)]), np.array([len(x), len(y)])
            owner, keys = line_dedup.segment_keys(line_dedup.C.prefix_hash(codes), start, chars, distance, 4)
            side = [set(keys[owner == k].tolist()) for k in (0, 1)]
            assert any(k % 2 == 0 and k + 1 in side[1] for k in side[0]) or any(k % 2 == 0 and k + 1 in side[0] for k in side[1])


@pytest.mark.parametrize("crowded", [50, 1])
def test_line_classes(docs_of, monkeypatch, crowded):
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    rows = brute.corpus(60, 12, vocabulary=60)
    want = brute.line_heads(rows, line_dedup.DISTANCE, line_dedup.MIN_CHARS)
    for r in line_dedup.summary(docs_of(rows, CLASHING)).collect():
        own = {n: v for (d, n), v in want.items() if d == r["doc_id"]}
        gone = {n: h for n, (h, _) in own.items() if h != (r["doc_id"], n)}
        assert (r["n_lines"], r["n_links"], r["n_removed"]) == (len(own), sum(v[1] for v in own.values()), len(gone))
        assert r["removed"] == ",".join(f"{n}:{d}:{k}" for n, (d, k) in sorted(gone.items()))


def test_lines_removed(docs_of):
    one, two = "this is a line of some length", "and this is another line"
    rows = [(3, f"{one}\n\n{two}"), (5, f"x\n {one}"), (6, f"{one.replace('some', 'sme')}\n{two}!"), (7, ""), (8, None), (9, "x\nx\ny"), (None, "y")]
    docs = docs_of(rows, CLASHING)
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {3: (f"{one}\n\n{two}", 55), 5: ("x", 1), 7: ("", 0), 8: (None, 0), None: ("y", 1)}
    assert line_dedup.deduplicated(docs_of([])).collect() == []


def test_texts_are_joined_alike_at_every_size(spark):
    """Check of op7, op10: small tables of spans are not sent whole, so disk follows the input from small sizes on."""
    from quill.llm import repeats as R
    docs = spark.createDataFrame([(i, "a " * 60) for i in range(4)], "doc_id long, text string")
    k = R.keyed(docs)
    spans = k.select("id", "th", F.expr("array(struct(0L as start, 3L as end))").alias("spans"))
    slabs = k.select(F.struct("id", "th", F.lit(0).cast("long").alias("start"), F.col("id").alias("order")).alias("at"), F.lit(1).cast("long").alias("gram"),
                     F.lit(2).cast("long").alias("slab"), F.lit(1).alias("windows"), F.lit(0).alias("anchor"), F.lit(2).cast("long").alias("kinds"))
    for d in (R.with_spans(k, spans), R.fetch(k, slabs, R.byte_symbols, 50, True)):
        assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
        assert d.count() == 4
