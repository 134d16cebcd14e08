import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import columns as C
from tidemark.functions.intervals import intersect_unions, union_intervals
from tidemark.operators import coverage as G
from tidemark.operators import profiles as P
from tidemark.operators import stats as S
from tidemark.operators.confluence import intersect


def value(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0]["v"]


def test_strict_band_is_half_at_its_edge(spark):
    w = F.lit(0.004)
    p = F.lit(100.0)
    assert value(spark, C.contribution(p, p * (1 + w), w)) == 0.5
    assert value(spark, C.contribution(p, p * (1 - w), w)) == 0.5
    assert value(spark, C.contribution(p, p * (1 + F.lit(1.5) * w), w)) == 0.0
    assert value(spark, C.contribution(p, p, w)) == 1.0


@pytest.mark.parametrize("price,want", [(100, 1.0), (100.2, 1.0), (100.25, 0.5), (100.3, 0.5), (100.31, 0.0)])
def test_inclusive_band(spark, price, want):
    assert value(spark, C.proximity(F.lit(float(price)), F.lit(100.0), F.lit(0.002), 1.5)) == want


@pytest.mark.parametrize("days,want", [(0, 1.0), (180, 0.625), (360, 0.4375)])
def test_recency(spark, days, want):
    assert value(spark, C.age_weight(F.lit(float(days)), Settings())) == pytest.approx(want)


def test_sign_marks_missing(spark):
    got = [value(spark, C.sign_char(F.lit(x).cast("double"))) for x in (None, float("nan"), 0.0, 1.0, -1.0)]
    assert got == ["M", "M", "N", "S", "R"]


def test_bucket_sides(spark):
    cuts = F.array(F.lit(1.0), F.lit(2.0))
    assert value(spark, C.bucket_right(F.lit(1.0), cuts)) == 1
    assert value(spark, C.bucket_left(F.lit(1.0), cuts)) == 0
    assert value(spark, C.bucket_left(F.lit(None).cast("double"), cuts)) == -1


def test_settings_reject_unknown_fields():
    with pytest.raises(ValueError):
        Settings.from_json('{"half_life": 3}')
    assert Settings.from_json('{"ranks": {"samples": 5}}').ranks.samples == 5


def intervals(spark, rows):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in rows], "k int, lower double, upper double")


def test_touching_intervals_merge(spark):
    u = union_intervals(intervals(spark, [(1, 4), (2, 3), (4, 5), (8, 9)]), ["k"])
    assert sorted((r["lower"], r["upper"]) for r in u.collect()) == [(1, 5), (8, 9)]
    i = intersect_unions(intervals(spark, [(1, 2)]), intervals(spark, [(2, 3)]), ["k"])
    assert [(r["lower"], r["upper"]) for r in i.collect()] == [(2, 2)]


def test_pairwise_overlap_is_not_a_common_region(spark):
    arr = lambda a, b: F.array(F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")))
    assert value(spark, intersect(intersect(arr(1, 3), arr(2, 5)), arr(4, 6))) == []


@pytest.mark.parametrize("q,k,want", [(98, 100, "QUARANTINE"), (99.1, 100, "RETAIN_WARNING"), (101.1, 100, "UNRESOLVED"), (0, 1, "QUARANTINE"), (0, 0, "RETAIN_WARNING"), (float("nan"), 1, "UNRESOLVED")])
def test_minute_rule(spark, q, k, want):
    assert value(spark, G.classify_minute(F.lit(float(q)), F.lit(float(k)), F.lit(True))) == want


def test_boundary_blocks(spark):
    rows = [("X", "g", i * 60_000, q, 100.0, i * 60_000 + 1, i * 60_000 + 59_999, True, "QUARANTINE" if q < 100 else "UNRESOLVED") for i, q in enumerate((102.0, 98.0, 102.0))]
    d = spark.createDataFrame(rows, "symbol string, gap_id string, minute long, quantity double, kline_quantity double, first_time long, last_time long, source_agrees boolean, decision string")
    got = [r["resolved"] for r in G.resolve_boundaries(d).orderBy("minute").collect()]
    assert got == ["RETAIN_BOUNDARY_WARNING", "RETAIN_BOUNDARY_WARNING", "UNRESOLVED"]


def test_decimal_bins(spark):
    t = spark.createDataFrame([("X", 1, 0, 100.0, 2.0, False), ("X", 2, 1, 100.09, 3.0, True), ("X", 3, 2, 100.1, 4.0, False)], "symbol string, id long, timestamp long, price double, quantity double, buyer_is_maker boolean")
    got = {r["bin"]: (r["quantity"], r["delta"]) for r in P.volume_at_price(t, "0.1", 1000).collect()}
    assert got == {1000: (5.0, -1.0), 1001: (4.0, 4.0)}


def test_expanding_midrank(spark):
    rows = [(i, "c", t, float(v)) for i, (v, t) in enumerate(zip((0, 2, 1, 2, 3), (0, 0, 1, 1, 2)))]
    d = spark.createDataFrame(rows, "qid long, config string, timestamp long, value double")
    m = S.midrank_expanding(d, ["config"], 1, 0).orderBy("qid").collect()
    assert [r["row_percentile"] for r in m] == [None, None, 0.5, 0.75, 1.0]
    assert [r["history_rows"] for r in m] == [0, 0, 2, 2, 4]


def test_event_balanced_midrank(spark):
    rows = [(i, "c", t, float(v)) for i, (v, t) in enumerate(zip((0, 0, 0, 2, 1), (0, 0, 0, 1, 2)))]
    d = spark.createDataFrame(rows, "qid long, config string, timestamp long, value double")
    r = S.midrank_expanding(d, ["config"], 1, 0).filter("qid = 4").collect()[0]
    assert (r["event_percentile"], r["row_percentile"]) == (0.5, 0.75)


def test_rolling_volume_map(spark):
    bins = spark.createDataFrame([("X", h, 0, float(h + 1), float(h + 1), 0.0) for h in range(4)], "symbol string, hour long, bin long, quantity double, buy double, sell double")
    log = {r["T"]: r["quantity"] for r in P.rolling_vap(bins, 2, 1).collect()}
    assert (log[2], log[3]) == (3.0, 5.0)


def test_shapes(spark):
    rows = [("up", i, y, True) for i, y in enumerate((0.1, 0.2, 0.3, 0.4))] + [("few", i, y, i != 2) for i, y in enumerate((0.1, 0.2, 0.3, 0.4))] + [("dip", i, y, True) for i, y in enumerate((0.1, 0.3, 0.2, 0.4))]
    d = spark.createDataFrame(rows, "k string, x int, y double, ok boolean")
    got = {r["k"]: r["shape"] for r in S.curve_shape(d, ["k"], "x", "y", "ok", 4).collect()}
    assert got == {"up": "MONOTONIC_INCREASING", "few": "SPARSE", "dip": "NONLINEAR"}
