"""The whole chain over a table of configurations: levels, zones, visits, outcomes, controls, comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import HORIZONS, LABELS
from tidemark.functions.columns import content_id, count_if, ratio
from tidemark.operators.detectors import detect_all
from tidemark.operators.outcomes import grid_frame, measure, schedule_controls, visit_events
from tidemark.operators.profiles import window_status
from tidemark.operators.stats import GRID, multiplicity
from tidemark.operators.visits import track_visits
from tidemark.session import materialize

STATUSES = ("AVAILABLE", "MISSING_TRADE_COVERAGE", "QUARANTINED_TRADE_COVERAGE")


def zones_of(levels: DataFrame, configurations: DataFrame) -> DataFrame:
    """A zone per level and width of its detector's configurations: price x (1 -/+ width)."""
    same = F.coalesce(F.col("parameter"), F.lit(-1.0))
    keys = ["symbol", "tf", "detector", "_parameter"]
    c = configurations.withColumn("_parameter", same).drop("parameter")
    z = levels.withColumn("_parameter", same).join(c, keys).drop("_parameter")
    w = F.col("width")
    return z.withColumns({"lower": F.col("price") * (1 - w), "upper": F.col("price") * (1 + w), "zone_id": content_id("candidate_id", "configuration_id")})


def _counts(group: str, weight: Column) -> list[Column]:
    """Rows, complete ones and labels of one group, each row ``weight`` times."""
    done = ~F.col("censored")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, weight)), F.lit(0)).cast("long")
    return [n(F.lit(True)).alias(f"{group}_total"), n(done).alias(f"{group}_complete"), *[n(done & (F.col("label") == l)).alias(f"{group}_{l.lower()}") for l in LABELS]]


def run_grid(candles: DataFrame, configurations: DataFrame, detectors, trades: DataFrame | None = None, control_stride: int = 24, horizons=HORIZONS, coverage=None) -> DataFrame:
    """One row per configuration and outcome cell: visits against control events, with the difference of their take-profit shares.

    ``candles`` holds all timeframes, ``configurations`` is a table (symbol, tf, detector, parameter, width, configuration_id) of the
    declared ``detectors``, each of which runs once for all its widths. Visits are reduced to counts per event and configuration
    before outcomes are joined; an event that several configurations share, or a control, is measured once. Controls
    are every ``control_stride``-th bar. ``coverage`` (profile, window_ms, start, quarantine spans) adds how many visits had
    usable volume before them; without it none was asked for. Descriptive: configurations are not ranked.
    """
    levels = materialize(detect_all(candles, detectors, trades), "levels")
    zones = materialize(zones_of(levels, configurations).select("zone_id", "configuration_id", "symbol", "tf", "price", "lower", "upper", "known_at"), "zones")
    visits = track_visits(zones, candles).select("zone_id", "symbol", "tf", "start_idx", "observed_at", "reference_close")
    visits = materialize(visits.join(zones.select("zone_id", "configuration_id"), "zone_id"), "visits")
    found = visit_events(visits)
    controls = materialize(schedule_controls(candles, control_stride).select("event_id", "symbol", "tf", "idx", "T", "P"), "controls")
    events = materialize(found.select(*controls.columns).unionByName(controls).dropDuplicates(["symbol", "tf", "idx"]), "events")
    tfs = [r.tf for r in configurations.select("tf").distinct().collect()]  # declared names
    at = lambda d, tf: d.filter(F.col("tf") == tf)
    outcomes = reduce(DataFrame.unionByName, [measure(at(events, tf), at(candles, tf), horizons[tf]) for tf in tfs])
    outcomes = materialize(outcomes.select("event_id", "symbol", "tf", *GRID, "censored", "label"), "outcomes")
    ids = events.select("symbol", "tf", F.col("T").alias("observed_at"), "event_id")
    weights = materialize(multiplicity(visits.join(ids, ["symbol", "tf", "observed_at"]), "configuration_id"), "weights")
    event = weights.join(outcomes, "event_id").groupBy("configuration_id", *GRID).agg(*_counts("event", F.col("weight")))
    ids = controls.select("symbol", "tf", F.col("T").alias("_T")).join(events.select("symbol", "tf", F.col("T").alias("_T"), "event_id"), ["symbol", "tf", "_T"]).select("event_id")
    control = outcomes.join(ids, "event_id", "left_semi").groupBy("symbol", "tf", *GRID).agg(*_counts("control", F.lit(1)))
    cells = reduce(DataFrame.unionByName, [grid_frame(at(configurations, tf), horizons[tf]) for tf in tfs])
    out = cells.join(event, ["configuration_id", *GRID], "left").join(control, ["symbol", "tf", *GRID], "left")
    counts = [c for d in (event, control) for c in d.columns if c not in ("configuration_id", "symbol", "tf", *GRID)]
    out = out.fillna(0, counts)
    share = lambda g: ratio(F.col(f"{g}_tp_first"), F.col(f"{g}_complete"))
    out = out.withColumns({f"{g}_tp_first_fraction": share(g) for g in ("event", "control")})
    out = out.withColumn("difference", F.col("event_tp_first_fraction") - F.col("control_tp_first_fraction"))
    if coverage is None:
        return out.withColumn("volume_status", F.lit("NOT_REQUESTED"))
    profile_, window_ms, start, spans = coverage
    status = window_status(events.select("symbol", F.col("T").alias("observed_at")).distinct(), profile_, window_ms, start, spans)
    per = visits.join(status, ["symbol", "observed_at"]).groupBy("configuration_id").agg(*[count_if(F.col("status") == s).alias(f"visits_{s.split('_')[0].lower()}") for s in STATUSES])
    return out.join(per, "configuration_id", "left").fillna(0, [c for c in per.columns if c.startswith("visits_")])
