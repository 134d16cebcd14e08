import random

import pytest

from tidemark.functions.ranks import prior_mass
from tidemark.session import shared_dir


def plain(rows):
    return {q: (sum(w for _, s, v, _ in rows if s < slot for w in [1.0 if v < x else 0.5 if v == x else 0.0]), float(sum(1 for _, s, _, _ in rows if s < slot))) for q, slot, x, _ in rows}


@pytest.mark.parametrize("first", [0, 2**20 - 2, 2**20 + 5, 2**41, -3, -(2**30)])
def test_history_does_not_depend_on_the_origin(spark, first):
    rows = [(i, first + s, float(v), 1.0) for i, (s, v) in enumerate([(0, 0), (0, 2), (1, 1), (1, 2), (2, 3), (3, 2), (7, 2)])]
    df = spark.createDataFrame(rows, "qid long, slot long, v double, n double").selectExpr("'X' AS k", "*")
    got = {r.qid: (r.n_mid, r.n_all) for r in prior_mass(df.drop("qid"), df.drop("n"), ["k"], ["n"]).collect()}
    assert got == {q: x for q, x in plain(rows).items() if x[1]}


def test_ties_far_values_and_many_slots(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(-50, 3_000_000), rng.choice([1.0, 1.0, 1.0, -1e12, 1e15, 0.25]), 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "qid long, slot long, v double, n double").selectExpr("'X' AS k", "*")
    got = {r.qid: (r.n_mid, r.n_all) for r in prior_mass(df.drop("qid"), df.drop("n"), ["k"], ["n"]).collect()}
    assert got == {q: x for q, x in plain(rows).items() if x[1]}


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def __init__(self, **kw):
            self.kw = kw

        def get(self, key, default=None):
            return self.kw.get(key, default)

    class Session:
        conf = Conf(**{"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.conf = Conf(**{"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs://x/y"})
    assert shared_dir(Session()) == "hdfs://x/y"
