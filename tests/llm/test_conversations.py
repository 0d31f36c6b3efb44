"""Conversation repair against a plain cheapest-path search."""

import random

import pytest

from quill.llm import conversation_repair as R
from tests.llm import brute
from tests.llm.conftest import SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos long, fault string, seg long, n long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_search_is_cheapest_and_least(seed):
    r = random.Random(seed)
    for _ in range(250):
        roles = r.choice(["user", "assistant", "system"]) if r.random() < 0.1 else None
        rows = []
        for k in range(r.randint(0, 11)):
            role = roles or r.choice(["user", "assistant"] * 4 + ["system", "tool"]) if r.random() < 0.5 else ("user", "assistant")[k % 2]
            rows.append((role, str(k), r.choice("......ttbd")))
        want = brute.cheapest_edits(rows)
        codes = ["".join(x if (x := row[0][0]) in "sua" else "x" for row in rows), "".join(row[2] for row in rows)]
        for size in (64, 3, 1):
            cuts = range(0, len(rows), size)
            parts = [R.solve_stretch(codes[0][i : i + size], codes[1][i : i + size], i == 0, i + size >= len(rows)) for i in cuts]
            if parts:
                cost, way = R.join_stretches(parts)
                assert (cost, "".join(a for _, a in way)) == want[:2], (rows, size)


def test_long_stretches_end():
    r = random.Random(9)
    for roles in ("s" * 64, "u" * 64, "x" * 64, "ua" * 32, "".join(r.choice("uuas") for _ in range(64))):
        for bad in ("." * 64, "t" * 64, "".join(r.choice(".tbd") for _ in range(64))):
            rows = [({"s": "system", "u": "user", "a": "assistant", "x": "tool"}[c], str(k), f) for k, (c, f) in enumerate(zip(roles, bad))]
            assert R.Search(roles, bad).run(0, (0, 3)) == brute.cheapest_edits(rows)[:2]


def conversations(n, seed):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 9) if c else 150):
            role = ("user", "assistant")[t % 2] if r.random() < 0.8 else r.choice(["system", "user", "tool", "", None])
            text = r.choice(["yes.", "No!", "why?", "cut off", " \t", "", None, "é. \n", "long " * 2000 + "."]) if r.random() < 0.5 else f"text {r.random()}."
            rows.append((None if c == 3 else c, t if r.random() < 0.9 else r.choice([None, t + 5]), role, text))
    rows += [(900, None, "user", "a."), (900, None, "user", "b."), (901, 1, "user", "x."), (901, 1, "user", "x."), (902, 7, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("stretch", [64, 4])
def test_tables(spark, stretch):
    rows = conversations(40, 3)
    assert got(R.repair(table(spark, rows).repartition(3), stretch)) == brute.repaired_conversations(rows)


def test_empty_and_dropped(spark):
    assert R.repair(table(spark, [])).collect() == []
    import zlib
    gone = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, gone, "user", "hello.")]
    assert got(R.repair(table(spark, rows))) == brute.repaired_conversations(rows)


def test_given_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    assert got(R.repair(df)) == brute.repaired_conversations([tuple(x) for x in df.select("conv_id", "turn", "role", "text").collect()])
