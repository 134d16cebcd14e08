import math
import random
import sys

import pytest

from tidemark.llm import topk


def plain(rows, queries, k):
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    ints = {i: [math.floor(min(sys.float_info.max, 256 * x)) for x in v] for i, v in rows if i is not None and fine(v)}
    out = []
    for q in queries:
        if q in ints:
            score = lambda v: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ints[q], v))))
            found = sorted((-score(v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,tile", [(4096, 512), (7, 3)])
def test_against_all_rows(spark, monkeypatch, shard, tile):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "TILE", tile)
    monkeypatch.setattr(topk, "FAN", 3)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]  # ties
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [(310, []), (311, [1.0, 2.0]), (312, [2.0, 1.0]), (313, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string")
    asked = [i for i, _ in rows if i is not None and i % 10 in (0, 1)]
    got = topk.search(df, df.filter("vec_id % 10 in (0, 1)"), 5).collect()
    assert sorted(map(tuple, got)) == plain(rows, asked, 5)


def test_scores_beyond_64_bits(spark):
    rows = [(5, [1.7e308, 0.0]), (0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1e9, 7.0]), (4, [1e9, 8.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, df.filter("vec_id in (0, 3)"), 5).collect()
    assert sorted(map(tuple, got)) == plain(rows, [0, 3], 5)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert topk.search(df, df, 5).collect() == []
    assert topk.search(df.limit(0), df.limit(0), 5).collect() == []
