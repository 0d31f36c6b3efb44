"""Merkle manifest against a plain tree."""

import random

import pytest

from quill.llm import merkle
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, pos long, n long, grp string, leaf string, block long, __at long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3, 4) for r in rows], SCHEMA)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def corpus(n, seed, langs=("en", "fr", "é", None, "")):
    r = random.Random(seed)
    rows = [(k, "".join(r.choice("abé ") for _ in range(r.randint(0, 30))), r.choice(["s", None]), r.choice(langs), r.randint(0, 99)) for k in range(n)]
    rows += [(None, None, None, None, None), (None, "x" * 50_000, "s", "en", 5), rows[0], rows[0], (3, "other", "s", rows[3][3], None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,bits,fan", [(75, 1, 1), (90, 2, 2), (333, 1, 3), (37, 12, 4)])
def test_manifest(spark, n, bits, fan):
    rows = corpus(n, n)
    df = table(spark, rows).repartition(5)
    assert got(merkle.verified(df, bits, fan)) == brute.merkle(rows)


def test_many_languages_and_lone_rows(spark):
    rows = [(k, str(k), "s", f"l{k % 11}", k) for k in range(13)]
    assert got(merkle.verified(table(spark, rows), 1, 1)) == brute.merkle(rows)
    assert got(merkle.verified(table(spark, rows[:1]))) == brute.merkle(rows[:1])
    assert merkle.verified(table(spark, [])).collect() == []


def test_every_size_of_a_language(spark):
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33]
    rows = [(100 * n + k, str(k), None, f"l{n}", k) for n in sizes for k in range(n)]
    assert got(merkle.verified(table(spark, rows).coalesce(2), 1, 1)) == brute.merkle(rows)


def test_manifest_keeps_whole_proofs(spark):
    rows = [(k, str(k), None, "en", k) for k in range(6)]
    out = merkle.manifest(table(spark, rows), 1, 1).collect()
    assert {len(r["proof"]) for r in out} == {3} and {e[:1] for r in out for e in r["proof"]} == {"l", "r", ""}
