"""The corpus pipeline against its stages in plain Python, and with awkward tables."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quill.llm import bpe, line_dedup, mixing, quality_rules
from tests.llm import brute


def passes(text):
    w = brute.words(text)
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    return len(w) >= 10 and 100 * len(again) <= 20 * len(w)


def of_quality(rows, host_of):
    """The documents that stay, without lines of more than LINE_DOCS distinct texts of a host."""
    norm = lambda line: " ".join(brute.words("".join(c.lower() if c.isascii() else c for c in line)))
    seen = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            seen.setdefault((host_of[d], norm(line)), set()).add(t)
    out, removed = [], 0
    for d, t in rows:
        own = (t or "").split("\n")
        often = [bool(norm(line)) and len(seen[host_of[d], norm(line)]) > quality_rules.LINE_DOCS for line in own]
        lost = sum(len(norm(line).split()) for line, o in zip(own, often) if o)
        n = len(brute.words(t))
        if passes(t) and n - lost >= quality_rules.MIN_LEFT * n:
            removed += sum(often)
            left = "".join(line + "\n" for line, o in zip(own[:-1], often) if not o) + (own[-1] if not often[-1] else "")
            out.append((d, left))
    return out, removed


def without_lines(rows):
    heads = brute.line_heads(rows, line_dedup.DISTANCE, line_dedup.MIN_CHARS)
    out = []
    for d, t in rows:
        own = {n: h for (x, n), (h, _) in heads.items() if x == d}
        gone = {n for n, h in own.items() if h != (d, n)}
        if own and gone == set(own):
            continue
        out.append((d, None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if n not in gone)))
    return out


def test_stages(spark, docs_of):
    rows = brute.corpus(70, 21)
    # a line in every document of two hosts; one of them has too little besides
    rows += [(1001 + 10 * i, f"Read  our terms and privacy notice\n{i} words that no other document has, and more of them {i}") for i in range(9)]
    rows += [(1002 + 10 * i, "Sign in to see all of the offers that we have for you this week\nonly " + f"n{i}") for i in range(8)]
    docs = docs_of(rows).withColumn("source", F.when(F.col("doc_id") > 1000, F.concat(F.lit("host"), F.pmod("doc_id", F.lit(10)))).otherwise(F.col("source")))
    host_of = {r["doc_id"]: r["source"] for r in docs.collect()}
    got = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            got[name] = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want, removed = of_quality(rows, host_of)
    assert removed >= 9 and not any(d % 10 == 2 for d, _ in want if d > 1000)
    assert got["quality rules"] == sorted(want)
    want = without_lines(want)
    assert got["line dedup"] == sorted(want)
    classes = brute.jaccard_classes(want)
    want = [(d, t) for d, t in want if classes[d][1] == d]
    assert got["n-gram join"] == sorted(want)
    assert {x for x in got["mixing"]} <= set(want)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANK_FILE), special_tokens={})
    assert sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in docs.collect()) == sorted((d, len(enc.encode_ordinary(t)), tuple(enc.encode_ordinary(t))) for d, t in got["mixing"])
    assert len({d for d, _ in got["mixing"]}) > 0.5 * len(want)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, " \n ")], [(None, "ten words are here so that the rules keep it"), (4, "x " * 30)]])
def test_awkward_tables(spark, docs_of, rows):
    docs = docs_of(rows, ("kept", "hot", "drop", "of", "size", "copies", "ids"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert len(docs.collect()) <= 3


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert all(np.array(r["ids"]).min() >= 0 for r in rows if r["ids"])
