import random
import re

import pytest

from tidemark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), n < 20 or 100 * len(again) > 30 * n


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    some = [f"w{i}" for i in range(6)]
    out = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (None, "a b c\n c\n\nc"), (5, "é#*$%&|<> x\n\n" * 4), (6, "a b c d e f g h " * 5)]
    out += [(10 + i, " ".join(rng.choices(some, k=rng.randint(1, 60))).replace("w3 ", "w3\n")) for i in range(60)]
    out += [(200 + i, " ".join(f"u{rng.randrange(500)}" for _ in range(40))) for i in range(40)]
    out += [(300 + i, " ".join(f"V{rng.randrange(50)}!!" for _ in range(40))) for i in range(5)]
    out += [(400, " ".join(rng.choices(some, k=20_000))), out[20], out[20]]
    return out


def test_rules_against_plain_python(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, bucket string, weight int")
    got = quality.judged(df, spark.createDataFrame([(i,) for i in range(200, 240)], "doc_id long"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, *(r[n] for n in names)) for r in got.collect()], key=key) == sorted([(i, *base(t)) for i, t in rows], key=key)
    assert all(not r.kept for r in got.collect() if r.base_failed)


def test_verdict_follows_the_ratio(spark, rows):
    junk = [(300 + i, " ".join(f"V{j % 5}!!" if j % 2 else f"V{(i + j) % 7}??" for j in range(60))) for i in range(200)]
    df = spark.createDataFrame([r for r in rows if r[0] in range(200, 240)] + junk, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judged(df, spark.createDataFrame([(i,) for i in range(200, 240)], "doc_id long")).collect()}
    assert all(got[i].kept and got[i].score > 0 for i in range(200, 240))
    assert not any(got[i].kept for i in range(300, 500))


def test_score_is_the_mean_log_ratio(spark):
    import math

    docs = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.judged(docs, spark.createDataFrame([(1,)], "doc_id long")).collect()}
    b = quality.BUCKETS  # features: a, b, (a, b) and a, c, (a, c)
    ratio = lambda good, raw: round(1e6 * (math.log((good + 1) / (3 + b)) - math.log((raw + 1) / (6 + b)))) / 1e6
    assert abs(got[1] - (ratio(1, 2) + 2 * ratio(1, 1)) / 3) < 1e-9
    assert abs(got[2] - (ratio(1, 2) + 2 * ratio(0, 1)) / 3) < 1e-9


def test_without_trusted_documents_and_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    docs = spark.createDataFrame([(1, " ".join(map(str, range(30))))], "doc_id long, text string")
    assert [r.kept for r in quality.judged(docs, none).collect()] == [True]
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []
