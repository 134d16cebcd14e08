"""Barrier outcomes and excursions over the bars after a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DIRECTIONS, TP_SL

# How the first barrier bar ended the trade; even codes of 1..5 say the take-profit side.
_TP_OPEN, _SL_OPEN, _BOTH, _TP, _SL = 1, 2, 3, 4, 5


def grid_frame(df: DataFrame, horizons, tps=TP_SL, sls=TP_SL) -> DataFrame:
    """Cross each row with direction x tp x sl x horizon (a literal array, no join)."""
    cells = [
        F.struct(F.lit(d).alias("direction"), F.lit(t).alias("tp"), F.lit(s).alias("sl"), F.lit(h).cast("long").alias("horizon"))
        for d in DIRECTIONS
        for t in tps
        for s in sls
        for h in horizons
    ]
    return df.withColumn("_g", F.explode(F.array(*cells))).select(*df.columns, "_g.*")


def _name(direction: str, tp: float, sl: float) -> str:
    return f"hit_{direction}_{round(tp * 1e6)}_{round(sl * 1e6)}"


def _hit(direction: str, tp: float, sl: float) -> Column:
    """Code of the barrier a bar reaches, null if none. The open comes before the extremes."""
    p, o, h, l = F.col("P"), F.col("open"), F.col("high"), F.col("low")
    if direction == "LONG":
        t, s = p * (1 + tp), p * (1 - sl)
        ot, os, tt, ts = o >= t, o <= s, h >= t, l <= s
    else:
        t, s = p * (1 - tp), p * (1 + sl)
        ot, os, tt, ts = o <= t, o >= s, l <= t, h >= s
    return F.when(ot, _TP_OPEN).when(os, _SL_OPEN).when(tt & ts, _BOTH).when(tt, _TP).when(ts, _SL)


def measure(events: DataFrame, candles: DataFrame, horizons, tps=TP_SL, sls=TP_SL, phase_end: int | None = None) -> DataFrame:
    """All grids for each event. ``events``: event_id, symbol, tf, idx, T, P.

    Each event meets its next h bars by an equi-join on the grid index; one conditional
    aggregation gives the first hit of every barrier pair and the excursions of every
    horizon, and only then are the grid rows unfolded.
    """
    hmax = max(horizons)
    bars = candles.select("symbol", "tf", "idx", "open", "high", "low", (F.col("end") - F.col("open_time")).alias("step"), "end")
    if phase_end is not None:
        bars = bars.filter(F.col("end") <= phase_end)
    e = events.select("event_id", "symbol", "tf", F.col("idx").alias("_at"), "T", "P")
    ahead = e.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(hmax)))).withColumn("idx", F.col("_at") + F.col("k"))
    j = ahead.join(bars.drop("end"), ["symbol", "tf", "idx"])
    p, k = F.col("P"), F.col("k")
    rise, fall = F.col("high") / p - 1, 1 - F.col("low") / p
    aggs = [F.max("step").alias("step")]
    for d in DIRECTIONS:
        for t in tps:
            for s in sls:
                aggs.append(F.min(k * 10 + _hit(d, t, s)).alias(_name(d, t, s)))
    for h in horizons:
        inside = k <= h
        aggs += [
            F.count(F.when(inside, 1)).alias(f"n_{h}"),
            F.max(F.when(inside, F.struct(rise.alias("v"), (-k).alias("k")))).alias(f"rise_{h}"),
            F.max(F.when(inside, F.struct(fall.alias("v"), (-k).alias("k")))).alias(f"fall_{h}"),
        ]
    facts = j.groupBy("event_id").agg(*[a for a in aggs])
    d = grid_frame(e.join(facts, "event_id", "left"), horizons, tps, sls)

    def pick(pairs) -> Column:
        out = None
        for cond, value in pairs:
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out

    hit = pick(
        (
            (F.col("direction") == dd) & (F.col("tp") == t) & (F.col("sl") == s),
            F.col(_name(dd, t, s)),
        )
        for dd in DIRECTIONS
        for t in tps
        for s in sls
    )
    at = lambda name: pick((F.col("horizon") == h, F.col(f"{name}_{h}")) for h in horizons)
    d = d.withColumn("_hit", hit).withColumn("observed_candles", F.coalesce(at("n"), F.lit(0)))
    d = d.withColumn("_rise", at("rise")).withColumn("_fall", at("fall"))
    d = d.withColumn("_k", F.floor(F.col("_hit") / 10)).withColumn("_code", F.col("_hit") % 10)
    d = d.withColumn("_in", F.coalesce(F.col("_k") <= F.col("horizon"), F.lit(False)))
    long_ = F.col("direction") == "LONG"
    code, T, step = F.col("_code"), F.col("T"), F.col("step")
    censored = F.col("observed_candles") < F.col("horizon")
    fav = F.when(long_, F.col("_rise")).otherwise(F.col("_fall"))
    adv = F.when(long_, F.col("_fall")).otherwise(F.col("_rise"))

    def pct(x):
        return F.greatest(F.lit(0.0), F.coalesce(x["v"], F.lit(0.0))) * 100

    def when_reached(x):
        return F.when(x["v"] > 0, -x["k"] * step)

    last_bar = F.col("observed_candles") * step
    return d.select(
        "event_id",
        "symbol",
        "tf",
        T.alias("timestamp"),
        "direction",
        "tp",
        "sl",
        "horizon",
        F.when(F.col("_in") & code.isin(_TP_OPEN, _TP), "TP_FIRST")
        .when(F.col("_in") & code.isin(_SL_OPEN, _SL), "SL_FIRST")
        .when(F.col("_in"), "AMBIGUOUS")
        .when(~censored, "NEITHER")
        .alias("label"),
        F.when(F.col("_in"), T + (F.col("_k") - F.when(code <= _SL_OPEN, 1).otherwise(0)) * step).cast("long").alias("first_hit_at"),
        pct(fav).alias("mfe_pct"),
        pct(adv).alias("mae_pct"),
        when_reached(fav).cast("long").alias("time_to_mfe_ms"),
        when_reached(adv).cast("long").alias("time_to_mae_ms"),
        F.col("observed_candles").cast("long").alias("observed_candles"),
        censored.alias("censored"),
        F.coalesce(T + last_bar, T).cast("long").alias("measured_until"),
    )


def bar_events(candles: DataFrame) -> DataFrame:
    """Every closed bar as a decision: T is its end, P its close."""
    from tidemark.functions.columns import content_id

    return candles.select(
        content_id("symbol", "tf", "end").alias("event_id"),
        "symbol",
        "tf",
        "idx",
        F.col("end").alias("T"),
        F.col("close").alias("P"),
    )


def visit_events(visits: DataFrame) -> DataFrame:
    """Distinct decisions of a set of visits: the close of the bar that entered the zone."""
    from tidemark.functions.columns import content_id

    return (
        visits.select("symbol", "tf", F.col("start_idx").alias("idx"), F.col("observed_at").alias("T"), F.col("reference_close").alias("P"))
        .dropDuplicates(["symbol", "tf", "idx"])
        .withColumn("event_id", content_id("symbol", "tf", "T"))
    )


def schedule_controls(candles: DataFrame, every: int) -> DataFrame:
    """Every k-th bar of a series as a control event, counted exactly across chunks."""
    from tidemark.functions.scans import running

    n = running(candles, ["symbol", "tf"], ["idx"], F.floor(F.col("idx") / 4096), {"_n": F.lit(1)})
    return bar_events(n.filter((F.col("_n") - 1) % every == 0))

