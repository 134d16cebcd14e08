"""Price zones around levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import WIDTHS
from tidemark.functions.columns import content_id
from tidemark.functions.scans import halo, own, series


def timeframe_width(tf: Column) -> Column:
    return F.element_at(F.create_map(*[x for tf_, w in WIDTHS.items() for x in (F.lit(tf_), F.lit(w))]), tf)


def construct_zone(levels: DataFrame, model: str = "timeframe", fraction=None, adaptive: DataFrame | None = None) -> DataFrame:
    """Zone bounds price x (1 -/+ f).

    model ``fixed`` takes ``fraction``; ``timeframe`` the timeframe's own width; ``adaptive``
    a frame (symbol, tf, end, fraction) of past-only features, read as of ``known_at``.
    """
    if model == "fixed":
        if not 0 < fraction < 1:
            raise ValueError("half-width must lie in (0, 1)")
        d = levels.withColumn("width_parameter", F.lit(float(fraction)))
    elif model == "timeframe":
        d = levels.withColumn("width_parameter", timeframe_width(F.col("tf")))
    elif model == "adaptive":
        f = adaptive.select("symbol", "tf", F.col("end").alias("known_at"), F.col("fraction").alias("width_parameter"))
        d = levels.join(f, ["symbol", "tf", "known_at"]).filter("width_parameter > 0 and width_parameter < 1")
    else:
        raise ValueError(f"unknown width model {model}")
    w = F.col("width_parameter")
    d = d.withColumn("width_model", F.lit(model)).withColumn("lower", F.col("price") * (1 - w)).withColumn("upper", F.col("price") * (1 + w))
    return d.withColumn("zone_id", content_id("candidate_id", "width_model", F.round(w * 1e8).cast("long")))


def mean_range_width(candles: DataFrame, bars: int = 14) -> DataFrame:
    """An adaptive width: mean (high - low) / close of the last ``bars`` closed bars."""
    w = series(("symbol", "tf"), "idx").rangeBetween(-(bars - 1), 0)
    d = halo(candles.select("symbol", "tf", "idx", "end", "high", "low", "close"), "idx", before=bars - 1)
    d = d.withColumn("fraction", F.avg((F.col("high") - F.col("low")) / F.col("close")).over(w))
    return own(d.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") == bars)).select("symbol", "tf", "end", "fraction")
