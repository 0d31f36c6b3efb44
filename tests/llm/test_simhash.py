"""SimHash classes against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from quill.llm import simhash
from tests.llm import brute

CLASHING = ("fp", "key", "shared", "component", "lead", "fingerprint")


def plain_fingerprint(text):
    w = brute.words(brute.fold(text))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    each = sorted(root)
    for i, a in enumerate(each):
        for b in each[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {f: find(f) for f in each}


def expected(rows):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    of = plain_classes({f for _, f in fps})
    least = {}
    for d, f in fps:
        if d is not None:
            least[of[f]] = min(d, least.get(of[f], d))
    return sorted(((d, f"{f:016x}", least.get(of[f])) for d, f in fps), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_classes(docs_of):
    r = random.Random(5)
    rows = brute.corpus(60, 3)
    base = " ".join(r.choice("abcdefghij") + r.choice("klmno") for _ in range(400))
    for k in range(40):
        w = base.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "edit" + str(r.randint(0, 9))
        rows.append((5000 + k, "\t".join(w).upper() if k % 5 == 0 else " ".join(w)))
    rows += [(7000, None), (7001, ""), (7002, " \n\t"), (7003, "one"), (7004, "One"), (7005, "x y"), (None, "x  y"), (None, "lonely text é É here"),
             (7006, "z " * 70_000), (7006, "z " * 70_000), (7007, "\x1c a b"), (7008, "É a b")]
    out = got(simhash.classes(docs_of(rows, CLASHING)))
    assert out == expected(rows)
    assert len({x[2] for x in out if x[0] and 5000 <= x[0] < 5040}) < 40
    assert simhash.classes(docs_of([])).collect() == []


@pytest.mark.parametrize("bucket,leaf", [(4096, 12), (20, 4), (12, 8)])
def test_links_of_dense_classes(spark, bucket, leaf):
    """Keys that many fingerprints share are divided; no link is lost."""
    r = random.Random(bucket)
    fps = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    fps |= {r.getrandbits(64) for _ in range(100)} | {r.getrandbits(48) for _ in range(100)} | {0, 1, 7, 1 << 63, (1 << 64) - 1}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    from quill.llm import common as C
    uniq = C.cut(spark.createDataFrame(signed, "fp long"))
    of = {x["id"] % (1 << 64): x["component"] % (1 << 64) for x in C.components(simhash.links(uniq, bucket=bucket, leaf_bits=leaf)).collect()}
    want = plain_classes(fps)
    members = {}
    for f, c in want.items():
        members.setdefault(c, set()).add(f)
    mine = {}
    for f in fps:
        mine.setdefault(of.get(f, f), set()).add(f)
    assert sorted(map(sorted, members.values())) == sorted(map(sorted, mine.values()))


def test_thresholds_cover_the_distance():
    r = np.random.default_rng(1)
    sample = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sample[:1500] &= np.uint64(0xFFFF)
    for n in (100, 10**5, 10**8, 10**10):
        parts = simhash.plan(sample, n)
        assert sum(t + 1 for _, t in parts) == simhash.DISTANCE + 1
        bits = [b for g, _ in parts for b in g]
        assert len(bits) == len(set(bits))
    assert len(simhash.plan(sample[:0], 0)) >= 1
    assert simhash.allocate([[0, 5, 9], [0, 1, 2], [0, 4, 4]], 2)[1] == [0, 2, 0]
