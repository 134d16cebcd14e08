import random

import pytest

from tests.test_levels import walk
from tidemark.operators import outcomes as O
from tidemark.operators import visits as V


def zone(spark, lower=99.0, upper=101.0, known=0, price=100.0):
    return spark.createDataFrame([("z", "X", "1h", price, lower, upper, known)], "zone_id string, symbol string, tf string, price double, lower double, upper double, known_at long")


def restated(rows, lower, upper, known, price, sep, step=1000):
    """Bar by bar, as a person would follow it."""
    out, cur, prev = [], None, None
    d = price * sep
    for i, (o, h, l, c) in enumerate(rows):
        if i * step >= known:
            if cur is None and h >= lower and l <= upper:
                before = rows[i - 1][3] if i else o
                cur = {"start": i, "approach": "ABOVE" if before > upper else "BELOW" if before < lower else "INSIDE"}
                out.append(cur)
            if cur is not None:
                cur["last"] = i
                if c > upper + d or c < lower - d:
                    cur["end"] = (i + 1) * step
                    cur = None
        prev = c
    return [(v["start"], v["last"], v["approach"], v.get("end")) for v in out]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("sep", [0.0, 0.01])
def test_visits_equal_a_bar_by_bar_restatement(spark, bars_of, seed, sep):
    rows = walk(120, seed)
    rnd = random.Random(seed)
    lower = rows[rnd.randrange(20, 60)][3]
    upper, known = lower * 1.01, 15_000
    z = zone(spark, lower, upper, known, (lower + upper) / 2)
    v = V.track_visits(z, bars_of(rows), sep).orderBy("start_idx").collect()
    assert [(r["start_idx"], r["end_idx"], r["approach"], r["end"]) for r in v] == restated(rows, lower, upper, known, (lower + upper) / 2, sep)


def test_wick_only(spark, bars_of):
    v = V.track_visits(zone(spark), bars_of([(104, 106, 103, 104), (104, 105, 100, 103)])).collect()[0]
    assert (v["wick_touched"], v["close_entered"], v["approach"], v["exit_direction"], v["max_penetration_price"]) == (True, False, "ABOVE", "ABOVE", 1.0)


def test_inside_approach_has_no_penetration(spark, bars_of):
    v = V.track_visits(zone(spark), bars_of([(100, 100.5, 99.5, 100), (100, 103, 99.5, 102)])).collect()[0]
    assert v["crossed_through"] is None and v["max_penetration_price"] is None


def outcome(bars_of, rows, direction, tp=0.01, sl=0.01, horizon=1, entry=100.0):
    b = bars_of([(entry, entry, entry, entry)] + rows)
    e = O.bar_events(b).filter("idx = 0")
    return O.measure(e, b, (horizon,), (tp,), (sl,)).filter(f"direction = '{direction}'").collect()[0]


@pytest.mark.parametrize(
    "hl,long_,short",
    [((102, 99.5), "TP_FIRST", "SL_FIRST"), ((100.5, 98), "SL_FIRST", "TP_FIRST"), ((100.5, 99.5), "NEITHER", "NEITHER"), ((102, 98), "AMBIGUOUS", "AMBIGUOUS")],
)
def test_labels(bars_of, hl, long_, short):
    rows = [(100, hl[0], hl[1], 100)]
    assert outcome(bars_of, rows, "LONG")["label"] == long_
    assert outcome(bars_of, rows, "SHORT")["label"] == short


def test_gap_open_decides(bars_of):
    o = outcome(bars_of, [(96, 105, 95, 104)], "LONG")
    assert (o["label"], o["first_hit_at"]) == ("SL_FIRST", 1000)


def test_censored(bars_of):
    o = outcome(bars_of, [(100, 100.5, 99.5, 100)], "LONG", horizon=2)
    assert (o["label"], o["censored"], o["observed_candles"]) == (None, True, 1)
