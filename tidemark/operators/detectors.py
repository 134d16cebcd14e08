"""Support and resistance levels. A level exists only from ``known_at`` on.

Input candles carry a calendar-grid index ``idx``; a level never bridges a missing bar.
Output: symbol, tf, detector, parameter, kind, price, source_timestamp, known_at,
dependency_start, candidate_id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import content_id, floor_to
from tidemark.functions.scans import halo, own, series

KEYS = ("symbol", "tf")


def _candidates(d: DataFrame, detector: str, parameter) -> DataFrame:
    d = d.select(
        *KEYS,
        F.lit(detector).alias("detector"),
        F.lit(parameter).cast("double").alias("parameter"),
        "kind",
        "price",
        "source_timestamp",
        "known_at",
        "dependency_start",
    )
    return d.withColumn(
        "candidate_id",
        content_id("detector", F.round(F.col("parameter") * 1000).cast("long"), "kind", *KEYS, "source_timestamp", "known_at"),
    )


def detect_a(candles: DataFrame, second_source: bool = False) -> DataFrame:
    """Reversal pairs: bull then bear gives resistance at the lower high, the mirror gives support.

    ``second_source`` stamps the level with the second bar's open instead of the open of
    the bar that set the price.
    """
    w = series(KEYS, "idx")
    d = halo(candles.select(*KEYS, "idx", "open_time", "end", "open", "high", "low", "close"), "idx", before=1)
    d = d.withColumn("p", F.lag(F.struct("idx", "open_time", "open", "high", "low", "close")).over(w))
    d = own(d).filter(F.col("p.idx") == F.col("idx") - 1)
    top = (F.col("p.close") > F.col("p.open")) & (F.col("close") < F.col("open"))
    bottom = (F.col("p.close") < F.col("p.open")) & (F.col("close") > F.col("open"))
    second = F.when(top, F.col("p.high") > F.col("high")).otherwise(F.col("p.low") < F.col("low"))
    source = F.col("open_time") if second_source else F.when(second, F.col("open_time")).otherwise(F.col("p.open_time"))
    d = d.filter(top | bottom).select(
        *KEYS,
        F.when(top, "RESISTANCE").otherwise("SUPPORT").alias("kind"),
        F.when(top, F.least("high", "p.high")).otherwise(F.greatest("low", "p.low")).alias("price"),
        source.alias("source_timestamp"),
        F.col("end").alias("known_at"),
        F.col("p.open_time").alias("dependency_start"),
    )
    return _candidates(d, "A", None)


def extrema(candles: DataFrame, width: int) -> DataFrame:
    """Bars with ``is_high`` / ``is_low``: strict extreme over ``width`` bars on both sides."""
    w = series(KEYS, "idx")
    left, right = w.rangeBetween(-width, -1), w.rangeBetween(1, width)
    d = halo(candles.select(*KEYS, "idx", "open_time", "end", "high", "low", "close"), "idx", width, width)
    full = (F.count("high").over(left) == width) & (F.count("high").over(right) == width)
    d = d.withColumn("_full", full)
    for name, c, agg, op in (("is_high", "high", F.max, "gt"), ("is_low", "low", F.min, "lt")):
        a, b = agg(c).over(left), agg(c).over(right)
        x = F.col(c)
        d = d.withColumn(name, F.col("_full") & ((x > a) & (x > b) if op == "gt" else (x < a) & (x < b)))
    return own(
        d.withColumn("confirmed_end", F.max("end").over(right)).withColumn("first_open", F.min("open_time").over(left))
    ).drop("_full")


def detect_b(candles: DataFrame, width: int) -> DataFrame:
    """Strict local extremes; ties give nothing; known when the last right-hand bar closes."""
    d = extrema(candles, width).filter(F.col("is_high") | F.col("is_low"))
    sides = F.array(
        F.when(F.col("is_high"), F.struct(F.lit("RESISTANCE").alias("kind"), F.col("high").alias("price"))),
        F.when(F.col("is_low"), F.struct(F.lit("SUPPORT").alias("kind"), F.col("low").alias("price"))),
    )
    d = d.withColumn("s", F.explode(F.array_compact(sides))).select(
        *KEYS,
        "s.*",
        F.col("open_time").alias("source_timestamp"),
        F.col("confirmed_end").alias("known_at"),
        F.col("first_open").alias("dependency_start"),
    )
    return _candidates(d, "B", float(width))


class Trackers:
    """Running high and low; a later close the fraction away confirms and restarts at that bar.

    A small helper for detector C: it is fed one bar at a time and holds two bar positions.
    """

    def __init__(self, at: int, high, low, close, fraction: float):
        self.top = self.bottom = at
        self.h, self.l, self.c, self.f = high, low, close, fraction

    def feed(self, i: int):
        """Yield (is_support, extreme position) for levels that bar ``i`` confirms."""
        if self.h[i] > self.h[self.top]:
            self.top = i
        elif self.c[i] <= self.h[self.top] * (1 - self.f):
            yield False, self.top
            self.top = i
        if self.l[i] < self.l[self.bottom]:
            self.bottom = i
        elif self.c[i] >= self.l[self.bottom] * (1 + self.f):
            yield True, self.bottom
            self.bottom = i


C_SCHEMA = (
    "symbol string, tf string, kind string, price double, source_timestamp long, known_at long, dependency_start long"
)


def _fold_c(fraction: float):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        idx, start, end = (pdf[c].to_numpy() for c in ("idx", "open_time", "end"))
        h, l, c = (pdf[x].to_numpy() for x in ("high", "low", "close"))
        rows = []
        run = None
        for i in range(len(pdf)):
            if run is None or idx[i] != idx[i - 1] + 1:
                run = Trackers(i, h, l, c, fraction)
                continue
            for up, e in run.feed(i):
                rows.append(("SUPPORT" if up else "RESISTANCE", l[e] if up else h[e], start[e], end[i], start[e]))
        out = pd.DataFrame(rows, columns=["kind", "price", "source_timestamp", "known_at", "dependency_start"])
        out.insert(0, "tf", pdf["tf"].iloc[0])
        out.insert(0, "symbol", pdf["symbol"].iloc[0])
        return out

    return fold


def detect_c(candles: DataFrame, fraction: float) -> DataFrame:
    """Confirmed reversals: one ordered pass per series.

    The automaton has no associative form, so a series is one group. Its size is the number
    of bars, which the calendar bounds (35,064 a year at 15m), not the number of trades.
    """
    d = candles.select(*KEYS, "idx", "open_time", "end", "high", "low", "close")
    return _candidates(d.groupBy(*KEYS).applyInPandas(_fold_c(fraction), C_SCHEMA), "C", fraction)


ROLL_SCHEMA = C_SCHEMA + ", start_idx long, sync_end long"


def _states_c(fraction: float):
    """Positions of both trackers after every bar of the uninterrupted run."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").reset_index(drop=True)
        idx = pdf["idx"].to_numpy()
        h, l, c = (pdf[x].to_numpy() for x in ("high", "low", "close"))
        top, bottom = np.empty(len(pdf), "int64"), np.empty(len(pdf), "int64")
        run = None
        for i in range(len(pdf)):
            if run is None or idx[i] != idx[i - 1] + 1:
                run = Trackers(i, h, l, c, fraction)
            else:
                for _ in run.feed(i):
                    pass
            top[i], bottom[i] = idx[run.top], idx[run.bottom]
        return pdf.assign(top=top, bottom=bottom)

    return fold


def _prefix_c(fraction: float, window: int):
    """Replay from every window start of a chunk until the trackers meet the global run."""

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").reset_index(drop=True)
        idx, start, end, own_ = (pdf[x].to_numpy() for x in ("idx", "open_time", "end", "_own"))
        h, l, c, top, bottom = (pdf[x].to_numpy() for x in ("high", "low", "close", "top", "bottom"))
        rows = []
        for s in np.flatnonzero(own_):
            last = s + window - 1
            if last >= len(pdf) or idx[last] != idx[s] + window - 1:
                continue
            run, met = Trackers(s, h, l, c, fraction), None
            found = []
            for i in range(s, last + 1):
                if i > s:
                    found += [(up, e, i) for up, e in run.feed(i)]
                if idx[run.top] == top[i] and idx[run.bottom] == bottom[i]:
                    met = i
                    break
            sync = int(end[met]) if met is not None else int(end[last])
            rows.append((None, None, None, None, None, idx[s], sync))
            for up, e, i in found:
                rows.append(("SUPPORT" if up else "RESISTANCE", l[e] if up else h[e], start[e], end[i], start[e], idx[s], sync))
        names = ["kind", "price", "source_timestamp", "known_at", "dependency_start", "start_idx", "sync_end"]
        out = pd.DataFrame(rows, columns=names)
        for n in names[2:5]:
            out[n] = out[n].astype("Int64")
        out.insert(0, "tf", pdf["tf"].iloc[0])
        out.insert(0, "symbol", pdf["symbol"].iloc[0])
        return out

    return replay


def detect_c_rolling(candles: DataFrame, fraction: float, window: int) -> DataFrame:
    """Levels of detector C restarted at the left edge of every complete window of ``window`` bars.

    Returns (symbol, tf, decision_timestamp, kind, price, source_timestamp, known_at). Two runs
    that reach equal trackers stay equal, so only the prefix up to that bar is replayed (in
    chunks of window starts); the rest of each window comes from the one global run.
    """
    d = candles.select(*KEYS, "idx", "open_time", "end", "high", "low", "close")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields)
    states = d.groupBy(*KEYS).applyInPandas(_states_c(fraction), schema + ", top long, bottom long")
    # A window that starts in a chunk ends at latest in the next one.
    chunks = halo(states, "idx", chunk=window)
    ahead = chunks.withColumn("_c", F.col("_c") - 1).withColumn("_own", F.lit(False))
    prefix = chunks.unionByName(ahead).groupBy(*KEYS, "_c").applyInPandas(_prefix_c(fraction, window), ROLL_SCHEMA)
    step = candles.select(F.max(F.col("end") - F.col("open_time")).alias("step"))
    starts = prefix.filter("kind is null").select(*KEYS, "start_idx", "sync_end").crossJoin(F.broadcast(step))
    starts = starts.withColumn("decision_timestamp", (F.col("start_idx") + window) * F.col("step"))
    pre = prefix.filter("kind is not null").join(starts.drop("sync_end", "step"), [*KEYS, "start_idx"])
    cols = [*KEYS, "decision_timestamp", "kind", "price", "source_timestamp", "known_at"]
    # The synchronised rest of the window: global levels with sync_end < known_at <= T.
    span = F.lit(window) * F.col("step")
    g = detect_c(candles, fraction).crossJoin(F.broadcast(step))
    g = g.withColumn("_b", F.explode(F.sequence(F.floor(F.col("known_at") / span), F.floor((F.col("known_at") + span) / span))))
    s = starts.withColumn("_b", F.floor(F.col("decision_timestamp") / span)).drop("step")
    rest = s.join(g.drop("step"), [*KEYS, "_b"]).filter(
        (F.col("known_at") > F.col("sync_end")) & (F.col("known_at") <= F.col("decision_timestamp"))
    )
    return pre.select(*cols).unionByName(rest.select(*cols))


def detect_d(profile: DataFrame, window_ms: int, multiple: float = 1.5) -> DataFrame:
    """Concentrated bins: quantity at least ``multiple`` times the window's mean occupied bin.

    ``profile``: symbol, tf, window_start, lower, upper, quantity (one row per occupied bin).
    """
    mean = F.avg("quantity").over(Window.partitionBy("symbol", "window_start"))
    d = profile.withColumn("_m", mean).filter((F.col("_m") > 0) & (F.col("quantity") >= F.col("_m") * multiple))
    d = d.select(
        *KEYS,
        F.lit("NEUTRAL").alias("kind"),
        ((F.col("lower") + F.col("upper")) / 2).alias("price"),
        F.col("window_start").alias("source_timestamp"),
        (F.col("window_start") + window_ms).alias("known_at"),
        F.col("window_start").alias("dependency_start"),
        "quantity",
        (F.col("quantity") / F.col("_m")).alias("observed_ratio"),
    )
    keep = d.select(*KEYS, "kind", "price", "source_timestamp", "known_at", "quantity", "observed_ratio")
    return _candidates(d, "D", multiple).join(keep, [*KEYS, "kind", "price", "source_timestamp", "known_at"])


def detect_d_windows(trades: DataFrame, clocks: DataFrame, width: float, multiple: float = 1.5) -> DataFrame:
    """Detector D over the trades of fixed windows, one per step of each clock (symbol, tf, step).

    Only windows that are bars of a clock count, so no level comes from an open window. Its parameter is the bin width.
    """
    from tidemark.operators.profiles import decimal_bin

    w = float(width)
    t = trades.select("symbol", "timestamp", "quantity", decimal_bin(F.col("price"), str(width)).alias("bin")).join(F.broadcast(clocks), "symbol")  # a row per symbol and timeframe
    start = F.col("timestamp") - F.pmod("timestamp", F.col("step"))
    exact = F.sum(F.col("quantity").cast("decimal(20,8)")).cast("decimal(20,8)")  # ties with the mean are common
    bins = t.groupBy(*KEYS, start.alias("window_start"), "step", "bin").agg(exact.alias("quantity"))
    window = Window.partitionBy(*KEYS, "window_start")  # bins of one window
    total, n = F.sum("quantity").over(window), F.count(F.lit(1)).over(window)
    d = bins.withColumn("_total", total.cast("decimal(22,8)")).withColumn("_n", n.cast("decimal(10,0)"))
    d = d.filter((F.col("_total") > 0) & (F.col("quantity") * F.col("_n") >= F.col("_total") * F.lit(str(multiple)).cast("decimal(6,3)")))
    return d.select(
        *KEYS, F.lit("D").alias("detector"), F.lit(w).alias("parameter"), F.lit("NEUTRAL").alias("kind"), ((F.col("bin") * w + (F.col("bin") + 1) * w) / 2).alias("price"),
        F.col("window_start").alias("source_timestamp"), (F.col("window_start") + F.col("step")).alias("known_at"), F.col("window_start").alias("dependency_start"),
        content_id(F.lit("D"), F.lit(round(w * 1e6)), *KEYS, "window_start", "bin").alias("candidate_id"),
    )


REGISTRY: dict[str, Callable[..., DataFrame]] = {"A": detect_a, "B": detect_b, "C": detect_c}
FROM_TRADES = {"D": detect_d_windows}


def register(name: str, detector: Callable[..., DataFrame]) -> None:
    """Add a level detector: a function of candles (and one parameter) to the level schema."""
    if name in REGISTRY or name in FROM_TRADES:
        raise ValueError(f"detector {name} exists")
    REGISTRY[name] = detector


def detect(candles: DataFrame, name: str, parameter=None, trades: DataFrame | None = None) -> DataFrame:
    """Levels of one detector; those that read trades take their windows from the clocks of the candles."""
    if name in FROM_TRADES:
        if trades is None:
            raise ValueError(f"detector {name} needs trades")
        clocks = candles.groupBy(*KEYS).agg(F.max(F.col("end") - F.col("open_time")).alias("step"))
        return FROM_TRADES[name](trades, clocks, parameter)
    if name not in REGISTRY:
        raise ValueError(f"unknown detector {name}")
    return REGISTRY[name](candles) if parameter is None else REGISTRY[name](candles, int(parameter) if name == "B" else parameter)


def detect_all(candles: DataFrame, configs, trades: DataFrame | None = None) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [detect(candles, n, p, trades) for n, p in configs])


def catalog(levels: DataFrame) -> DataFrame:
    """One row per level over all configurations, with a dense index in time order.

    The index is exact across chunks: days are numbered first, rows inside a day second.
    """
    from tidemark.functions.scans import running

    one = levels.groupBy("candidate_id").agg(
        *[F.first(c).alias(c) for c in ("symbol", "tf", "detector", "parameter", "kind", "price", "source_timestamp", "known_at")],
        F.min("dependency_start").alias("dependency_start"),
    )
    numbered = running(one, [], ["known_at", "candidate_id"], floor_to(F.col("known_at"), 86_400_000), {"_n": F.lit(1)})
    return numbered.withColumn("candidate_index", F.col("_n") - 1).drop("_n")


def prune(catalog_: DataFrame, membership: DataFrame) -> DataFrame:
    return catalog_.join(membership.select("candidate_id").distinct(), "candidate_id", "left_semi")


def swing_sources(candles: DataFrame, n: int) -> DataFrame:
    """Per bar and side: the latest confirmed n-bar swing (idx, price, open_time, known_at).

    A swing at ``i`` can be used from bar ``i + n`` on; the newest one is carried forward
    inside chunks, and across them through one row per chunk.
    """
    ext = extrema(candles, n)
    sides = []
    for side in ("high", "low"):
        s = ext.filter(f"is_{side}").select(
            *KEYS,
            (F.col("idx") + n).alias("idx"),
            F.struct("idx", F.col(side).alias("price"), "open_time", F.col("confirmed_end").alias("known_at")).alias("swing"),
        )
        d = candles.select(*KEYS, "idx", "open_time", "end", "close").join(s, [*KEYS, "idx"], "left")
        d = d.withColumn("_c", F.floor(F.col("idx") / 4096))
        tail = d.groupBy(*KEYS, "_c").agg(F.max_by("swing", F.when(F.col("swing").isNotNull(), F.col("idx"))).alias("_t"))
        over_chunks = Window.partitionBy(*KEYS).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
        tail = tail.select(*KEYS, "_c", F.last("_t", ignorenulls=True).over(over_chunks).alias("_carry"))
        local = Window.partitionBy(*KEYS, "_c").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
        d = d.join(tail, [*KEYS, "_c"], "left").withColumn(
            "swing", F.coalesce(F.last("swing", ignorenulls=True).over(local), F.col("_carry"))
        )
        sides.append(d.drop("_c", "_carry").withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])
