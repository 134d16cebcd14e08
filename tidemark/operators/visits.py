"""Visits of price to zones, without a state machine and without a zone x candle product.

While a visit is open, every close lies inside the (separated) zone. So a visit is a run of
consecutive bars that meet the zone; it ends with the first close outside, which is either
the run's last bar or the bar right after it. Only bars that meet a zone are ever joined:
zones and bars are cut into logarithmic price buckets and equi-joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import content_id, visit_group
from tidemark.functions.scans import halo, own, series

BAR = ("idx", "open_time", "end", "open", "high", "low", "close")


def price_bucket(price: Column, size: float) -> Column:
    return F.floor(F.log(price) / F.lit(size)).cast("long")


def with_neighbours(candles: DataFrame) -> DataFrame:
    """Previous close (the bar's own open for the first bar) and the next bar's close and end."""
    w = series(("symbol", "tf"), "idx")
    d = halo(candles.select("symbol", "tf", *BAR), "idx", 1, 1)
    return own(
        d.withColumn("prev_close", F.coalesce(F.lag("close").over(w), F.col("open")))
        .withColumn("next_close", F.lead("close").over(w))
        .withColumn("next_end", F.lead("end").over(w))
    )


def meets(zones: DataFrame, candles: DataFrame, low: Column, high: Column, size: float = 0.01) -> DataFrame:
    """Pairs of a zone [low, high] and a later bar whose range meets it."""
    z = zones.withColumn("_zl", low).withColumn("_zh", high).withColumn("_z0", price_bucket(F.col("_zl"), size))
    z = z.withColumn("_b", F.explode(F.sequence("_z0", price_bucket(F.col("_zh"), size))))
    c = candles.withColumn("_c0", price_bucket(F.col("low"), size))
    c = c.withColumn("_b", F.explode(F.sequence("_c0", price_bucket(F.col("high"), size))))
    return (
        z.join(c, ["symbol", "tf", "_b"])
        .filter(
            (F.col("_b") == F.greatest("_z0", "_c0"))  # each pair once
            & (F.col("high") >= F.col("_zl"))
            & (F.col("low") <= F.col("_zh"))
            & (F.col("open_time") >= F.col("known_at"))
        )
        .drop("_b", "_z0", "_c0", "_zl", "_zh")
    )


def side_of(price: Column, low: Column, high: Column) -> Column:
    return F.when(price > high, "ABOVE").when(price < low, "BELOW").otherwise("INSIDE")


def track_visits(zones: DataFrame, candles: DataFrame, separation: float = 0.0, size: float = 0.01) -> DataFrame:
    """All visits with their facts. ``zones``: zone_id, symbol, tf, price, lower, upper, known_at.

    A bar series must be gap-free (``require_contiguous``).
    """
    d = F.col("price") * F.lit(separation)
    lower, upper = F.col("lower"), F.col("upper")
    rows = meets(
        zones.select("zone_id", "symbol", "tf", "price", "lower", "upper", "known_at"),
        with_neighbours(candles),
        lower - d,
        upper + d,
        size,
    )
    close, high, low, open_ = F.col("close"), F.col("high"), F.col("low"), F.col("open")
    rows = rows.withColumn("touch", (high >= lower) & (low <= upper)).withColumn(
        "leave", (close > upper + d) | (close < lower - d)
    )
    by_zone = Window.partitionBy("zone_id").orderBy("idx")
    fresh = (
        F.lag("idx").over(by_zone).isNull() | F.lag("leave").over(by_zone) | (F.lag("idx").over(by_zone) != F.col("idx") - 1)
    )
    rows = rows.withColumn("_new", F.when(fresh, 1).otherwise(0)).withColumn("seg", F.sum("_new").over(by_zone))
    seen = F.max("touch").over(Window.partitionBy("zone_id", "seg").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_seen", seen).filter("_seen")
    body_low, body_high = F.least(open_, close), F.greatest(open_, close)
    wick = ((low < body_low) & (low <= upper) & (body_low >= lower)) | ((high > body_high) & (high >= lower) & (body_high <= upper))
    first = lambda c: F.min_by(c, "idx")
    last = lambda c: F.max_by(c, "idx")
    touch = F.col("touch")
    v = rows.groupBy("zone_id", "seg").agg(
        F.first("symbol").alias("symbol"),
        F.first("tf").alias("tf"),
        F.first("price").alias("price"),
        F.first("lower").alias("zone_lower"),
        F.first("upper").alias("zone_upper"),
        F.first("known_at").alias("known_at"),
        F.min("idx").alias("start_idx"),
        F.max("idx").alias("last_idx"),
        F.min("open_time").alias("start"),
        F.min("end").alias("observed_at"),
        F.max("end").alias("last_end"),
        first("prev_close").alias("_before"),
        first("close").alias("reference_close"),
        last("leave").alias("_left"),
        last("close").alias("_last_close"),
        last("next_close").alias("_next_close"),
        last("next_end").alias("_next_end"),
        F.bool_or(touch & wick).alias("wick_touched"),
        F.bool_or(touch & close.between(lower, upper)).alias("close_entered"),
        F.max(F.when(touch, upper - low)).alias("_pen_above"),
        F.max(F.when(touch, high - lower)).alias("_pen_below"),
        F.min("close").alias("_min_close"),
        F.max("close").alias("_max_close"),
    )
    zl, zu = F.col("zone_lower"), F.col("zone_upper")
    later = ~F.col("_left") & F.col("_next_close").isNotNull()  # left by the bar after the run
    v = v.withColumn("_exit_close", F.when(F.col("_left"), F.col("_last_close")).when(later, F.col("_next_close")))
    v = v.withColumn("end", F.when(F.col("_left"), F.col("last_end")).when(later, F.col("_next_end")))
    v = v.withColumn("approach", side_of(F.col("_before"), zl, zu)).withColumn("_extra", F.when(later, 1).otherwise(0))
    outside = F.col("approach") != "INSIDE"
    pen = F.greatest(F.lit(0.0), F.when(F.col("approach") == "ABOVE", F.col("_pen_above")).otherwise(F.col("_pen_below")))
    below = F.least("_min_close", F.coalesce("_exit_close", "_min_close")) < zl
    above = F.greatest("_max_close", F.coalesce("_exit_close", "_max_close")) > zu
    step = F.col("observed_at") - F.col("start")
    spent = F.col("last_idx") - F.col("start_idx") + 1 + F.col("_extra")
    mark = lambda s, at: F.struct(F.lit(s).alias("state"), at.alias("at"))
    v = v.select(
        "zone_id",
        "symbol",
        "tf",
        "price",
        "zone_lower",
        "zone_upper",
        "known_at",
        "start_idx",
        (F.col("last_idx") + F.col("_extra")).alias("end_idx"),
        "start",
        "observed_at",
        "reference_close",
        "approach",
        "end",
        F.col("end").isNotNull().alias("ended"),
        F.when(F.col("end").isNotNull(), "EXITED").when(spent > 1, "INTERACTING").otherwise("ENTERED").alias("state"),
        "wick_touched",
        "close_entered",
        F.when(outside, pen).alias("max_penetration_price"),
        F.when(outside, pen / (zu - zl)).alias("max_penetration_zone_fraction"),
        spent.alias("candles_spent"),
        F.when(F.col("end").isNotNull(), side_of(F.col("_exit_close"), zl, zu)).alias("exit_direction"),
        F.when(outside, F.when(F.col("approach") == "ABOVE", below).otherwise(above)).alias("crossed_through"),
        F.array_compact(
            F.array(
                mark("OUTSIDE", F.col("start")),
                mark("ENTERED", F.col("observed_at")),
                F.when(spent > 1, mark("INTERACTING", F.col("observed_at") + step)),
                F.when(F.col("end").isNotNull(), mark("EXITED", F.col("end"))),
            )
        ).alias("transitions"),
    )
    number = F.row_number().over(Window.partitionBy("zone_id").orderBy("start"))
    return v.withColumn("visit_number", number.cast("long")).withColumn("visit_group", visit_group(F.col("visit_number")))


def interactions(visits: DataFrame) -> DataFrame:
    """Decision-time facts only."""
    v = visits.withColumn("event_id", content_id("symbol", "tf", "observed_at"))
    return v.withColumn("interaction_id", content_id("zone_id", "visit_number")).select(
        "interaction_id",
        "event_id",
        "zone_id",
        "symbol",
        "tf",
        "start",
        "observed_at",
        "visit_number",
        "visit_group",
        "known_at",
        "reference_close",
        "zone_lower",
        "zone_upper",
        "approach",
    )


def lifecycles(visits: DataFrame, data_end: Column | None = None) -> DataFrame:
    """Future facts, kept apart from the decision row."""
    return visits.select(
        content_id("zone_id", "visit_number").alias("interaction_id"),
        "end",
        "candles_spent",
        F.col("end").alias("available_at"),
        F.col("end").isNull().alias("censored"),
    )
