import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components


def plain(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    for bit in range(64):
        if shingles and 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            out |= 1 << bit
    return out


def classes(rows):
    """Smallest id reachable, by comparing all pairs."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in rows:
        for j, y in rows:
            if i < j and (x ^ y).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in rows}


def test_fingerprint_is_the_stated_one():
    rng = random.Random(1)
    texts = [None, "", " \t\n\x0b\x0c\r", "One", "one TWO", "Äß É one\x0btwo three", "a a a a a a a", "x" * 5000]
    texts += [" ".join(rng.choices(["alpha", "Beta", "gam ma", "d d"], k=rng.randint(1, 60))) for _ in range(20)]
    texts.append(" ".join(rng.choices("abcdefgh", k=140_000)))
    for t in texts:
        assert simhash.fingerprint(t) % 2**64 == plain(t)


def test_whole_query_against_all_pairs(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=80)) for _ in range(12)]
    texts = [None, "", "  ", None] + base + base[:3]
    for b in base:  # near copies
        for _ in range(8):
            words = b.split()
            words[rng.randrange(len(words))] = "new"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i * 7, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id string")
    want = classes([(i * 7, plain(t)) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {i: c for i, (_, c) in got.items()} == want
    assert all(got[i * 7][0] % 2**64 == plain(t) for i, t in enumerate(texts))
    kept = simhash.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


@pytest.mark.parametrize("hot", [4096, 5])
def test_links_span_all_components(spark, hot):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    fps = set(seeds)
    for s in seeds:
        for _ in range(40):
            x = s
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [(int(np.uint64(x).view(np.int64)),) for x in fps]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in components(simhash.near_links(df, hot)).collect()}
    groups = {}
    for x, (s,) in zip(fps, signed):
        groups.setdefault(roots.get(s, s), set()).add(x)
    want = {}
    for x, c in classes([(x, x) for x in fps]).items():
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("b"), (F.col("id") + 1).alias("a"))
    got = {r.node: r.root for r in components(chain).collect()}
    assert got == {i: 0 for i in range(1, 201)}
