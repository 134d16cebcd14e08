import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators.detectors import detect, detect_all
from tidemark.operators.outcomes import measure, schedule_controls
from tidemark.plans.experiment import run_grid
from tidemark.plans.grid import configurations

HOUR = 3_600_000


def walk(n, seed):
    rng = random.Random(seed)
    rows, price = [], 100.0
    for _ in range(n):
        o, c = price, price * (1 + rng.gauss(0, 0.004))
        rows.append((o, max(o, c) * (1 + abs(rng.gauss(0, 0.002))), min(o, c) * (1 - abs(rng.gauss(0, 0.002))), c))
        price = c
    return rows


def visits(zone, bars):
    """Ends of the bars at which price comes to the zone, bar by bar."""
    inside, out = False, []
    for b in bars:
        if b.open_time < zone["known_at"]:
            continue
        if not inside and b.high >= zone["lower"] and b.low <= zone["upper"]:
            inside = True
            out.append(b.end)
        if b.close > zone["upper"] or b.close < zone["lower"]:
            inside = False
    return out


def test_grid_against_bar_by_bar_visits(spark, bars_of):
    bars = bars_of(walk(240, 4), step=HOUR).withColumn("symbol", F.lit("X"))
    rng = random.Random(8)
    data = [(("X", rng.randint(0, 240 * HOUR - 1), round(100 + rng.gauss(0, 1), 2), rng.choice([1.0, 1.5, 2.0]))) for _ in range(900)]
    trades = spark.createDataFrame(data, "symbol string, timestamp long, price double, quantity double")
    detectors = (("A", None), ("B", 2), ("C", 0.005), ("D", 0.5))
    grid = configurations(bars.select("symbol").distinct(), ("1h",), detectors)
    got = run_grid(bars, grid, detectors, trades, control_stride=5, horizons={"1h": (1, 6)}).collect()
    assert len(got) == 4 * 6 * 2 * 4 * 2 and {r.volume_status for r in got} == {"NOT_REQUESTED"}
    rows = bars.orderBy("idx").collect()
    levels = detect_all(bars, detectors, trades).collect()
    every = bars.select("symbol", "tf", "idx", F.col("end").alias("T"), F.col("close").alias("P")).withColumn("event_id", F.col("T").cast("string"))
    outcomes = {}
    for o in measure(every, bars, (1, 6)).collect():
        outcomes.setdefault((o.direction, o.tp, o.sl, o.horizon), {})[int(o.event_id)] = (o.censored, o.label)
    controls = [r.T for r in schedule_controls(bars, 5).collect()]
    assert sorted(controls) == [b.end for b in rows[::5]]
    for r in got:
        times = Counter()
        for z in levels:
            if (z.detector, z.parameter) == (r.detector, r.parameter):
                times.update(visits({"known_at": z.known_at, "lower": z.price * (1 - r.width), "upper": z.price * (1 + r.width)}, rows))
        cell = outcomes[r.direction, r.tp, r.sl, r.horizon]
        for name, group in (("event", times), ("control", Counter(controls))):
            done = {t: n for t, n in group.items() if not cell[t][0]}
            assert (r[f"{name}_total"], r[f"{name}_complete"]) == (sum(group.values()), sum(done.values()))
            hits = sum(n for t, n in done.items() if cell[t][1] == "TP_FIRST")
            assert r[f"{name}_tp_first"] == hits
            assert r[f"{name}_tp_first_fraction"] == (pytest.approx(hits / sum(done.values())) if done else None)


def test_levels_of_trade_windows(spark, bars_of):
    bars = bars_of([(1, 1, 1, 1)] * 3, step=HOUR).withColumn("symbol", F.lit("X"))
    data = [("X", 10, 1.1, 3.0), ("X", 20, 1.7, 1.0), ("X", 30, 2.2, 2.0), ("X", HOUR + 5, 7.7, 1.0)]  # mean 2, so 3 is the tie
    trades = spark.createDataFrame(data, "symbol string, timestamp long, price double, quantity double")
    got = [(r.price, r.source_timestamp, r.known_at) for r in detect(bars, "D", 0.5, trades).collect()]
    assert got == [(1.25, 0, HOUR)]
    with pytest.raises(ValueError, match="trades"):
        detect(bars, "D", 0.5)
