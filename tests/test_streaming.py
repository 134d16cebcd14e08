"""Streams over several micro-batches: a file each, with a hole, a step back and contradictions."""

import random
import time

from pyspark.sql import functions as F

from tidemark.operators import detectors as D
from tidemark.session import scratch
from tidemark.streaming import live as L


def folder(spark, df, name, cuts, by):
    """One file for each range of ``by``, written in order."""
    path = scratch(spark, name)
    for low, high in zip(cuts, cuts[1:]):
        df.filter((F.col(by) >= low) & (F.col(by) < high)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their times
    return path


def bars(spark):
    rng, rows, p = random.Random(7), [], 100.0
    for i in range(90):
        o, p = p, p * (1 + rng.uniform(-0.01, 0.01))
        if not 40 <= i < 47 and i != 61:
            rows.append(("X", "1h", i, i * 1000, i * 1000 + 999, i * 1000 + 1000, o, max(o, p) * 1.002, min(o, p) * 0.998, p))
    return spark.createDataFrame(rows, "symbol string, tf string, idx long, open_time long, close_time long, end long, open double, high double, low double, close double")


def test_reversals_with_holes_equal_the_batch_operator(spark):
    b = bars(spark)
    path = folder(spark, b, "bars", (0, 20_000, 43_000, 61_000, 90_000), "open_time")
    got = L.run(L.detect_reversals(L.read_folder(spark, path, b.schema, 1), 0.005), "c")
    want = D.detect_c(b, 0.005)
    key = lambda rows: sorted((r.kind, round(r.price, 9), r.known_at) for r in rows)
    assert key(got.collect()) == key(want.collect()) and want.count() > 5


def test_a_restart_goes_on(spark):
    b = bars(spark)
    path = folder(spark, b, "bars", (0, 30_000), "open_time")
    out, check = scratch(spark, "out"), scratch(spark, "check")
    L.run(L.detect_reversals(L.read_folder(spark, path, b.schema, 1), 0.005), "c", out, check)
    b.filter("open_time >= 30000").coalesce(1).write.mode("append").parquet(path)
    got = L.run(L.detect_reversals(L.read_folder(spark, path, b.schema, 1), 0.005), "c", out, check)
    assert got.count() == D.detect_c(b, 0.005).count()


def test_clock_steps_back_between_batches(spark):
    t = spark.createDataFrame([("X", i, x) for i, x in enumerate([1, 2, 3, 2, 4, 4, 3])], "symbol string, arrival long, id long")
    for cuts in ((0, 9), (0, 3, 6, 9)):
        got = L.run(L.clock_guard(L.read_folder(spark, folder(spark, t, "t", cuts, "arrival"), t.schema, 1)), "clock")
        assert sorted((r.arrival, r.id) for r in got.collect()) == [(3, 2), (6, 3)]


def test_conflicts_in_a_batch_and_with_accepted_rows(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (1, 2, 5.0), (2, 0, 7.0), (2, 1, 7.0), (3, 0, 1.0)], "k long, arrival long, v double")
    store = spark.createDataFrame([(3, 2.0)], "k long, v double")
    new, bad = L.split_conflicts(rows, store, ["k"], "v")
    assert sorted((r.k, r.v) for r in new.collect()) == [(1, 5.0), (2, 7.0)]
    assert sorted((r.k, r.v) for r in bad.collect()) == [(1, 6.0), (3, 1.0)]


def test_late_trades_go_aside_over_restart_and_replay(spark, tmp_path):
    import random

    from tidemark.streaming import live as L

    rng = random.Random(6)
    step, delay = 100, 150
    packs = []
    for p in range(5):
        packs.append([("X" if rng.random() < 0.7 else "Y", 1000 * p + i, max(0, 300 * p + rng.randint(-600, 300)), float(rng.randint(90, 110)), 1.0) for i in range(40)])
    schema = "symbol string, seq long, timestamp long, price double, quantity double"
    newest, late, kept = None, [], []
    for pack in packs:
        for t in pack:
            gone = newest is not None and t[2] // step * step + step <= newest - delay
            (late if gone else kept).append(t)
        newest = max([t[2] for t in pack] + ([newest] if newest is not None else []))
    want = {}
    for t in sorted(kept, key=lambda t: t[1]):
        o = t[2] // step * step
        if o + step <= newest - delay:
            b = want.setdefault((t[0], o), [t[3], t[3], t[3], t[3], 0])
            b[1], b[2], b[3], b[4] = max(b[1], t[3]), min(b[2], t[3]), t[3], b[4] + 1

    folder = str(tmp_path / "in")
    store = L.BarStore(spark, str(tmp_path / "out"), step, delay)
    assert store.closed().collect() == [] and store.late().collect() == [] and store.watermark() is None
    for n, pack in enumerate(packs):
        df = spark.createDataFrame(pack, schema)
        df.coalesce(1).write.mode("append").parquet(folder)
        if n in (1, 4):  # two runs over the same checkpoint, several files each
            L.BarStore(spark, str(tmp_path / "out"), step, delay).run(L.read_folder(spark, folder, df.schema, 1))
    store.take(spark.createDataFrame(packs[2], schema), 2)  # a batch that runs again replaces itself
    assert sorted(tuple(r)[:5] for r in store.late().collect()) == sorted(late) and late
    got = {(r.symbol, r.open_time): [r.open, r.high, r.low, r.close, r.trade_count] for r in store.closed().collect()}
    assert got == want


def test_clock_guard_takes_batches_of_any_size(spark, monkeypatch):
    """Chunks, several symbols, batches and a repeated batch against plain Python; no series meets one Python group (F8)."""
    import random

    from tidemark.plans import q_streaming

    rng = random.Random(8)
    rows = [(rng.choice("XY"), i, rng.randint(0, 60) + i) for i in range(300)]
    last, want = {}, []
    for symbol, arrival, i in rows:
        if i < last.get(symbol, i):
            want.append((symbol, arrival, i))
        last[symbol] = i
    t = spark.createDataFrame(rows, "symbol string, arrival long, id long")
    for cuts in ((0, 300), (0, 100, 130, 300)):
        guard = L.ClockGuard(spark, scratch(spark, "clock"), chunk=16)
        guard.run(L.read_folder(spark, folder(spark, t, "t", cuts, "arrival"), t.schema, 1))
        assert sorted(map(tuple, guard.found().collect())) == sorted(want)
        guard.take(t.filter(f"arrival < {cuts[1]}"), 0)
        assert sorted(map(tuple, guard.found().collect())) == sorted(want)
    monkeypatch.setattr(L, "_clock", None)
    monkeypatch.setattr(L, "clock_guard", None)
    assert q_streaming.stream_clock(spark, "/root/testdata/sf0.001").first().reversed > 0
