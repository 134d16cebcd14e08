"""Traded volume inside the zones around the current price."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import normalized_delta, ratio
from tidemark.functions.intervals import union_intervals, windows_hit
from tidemark.operators.profiles import range_quantity

KEYS = ("symbol", "tf", "T")
SIDES = ("support", "resistance", "joint")


def zone_unions(near: DataFrame, width: float) -> DataFrame:
    """Merged bands of the near levels per decision and side; joint is the union of both."""
    side = F.explode(F.array(F.lower("kind"), F.lit("joint")))
    d = near.select(*KEYS, side.alias("side"), (F.col("price") * (1 - width)).alias("lower"), (F.col("price") * (1 + width)).alias("upper"))
    return union_intervals(d, [*KEYS, "side"])


def zone_flow(d: DataFrame, unions: DataFrame, profile: DataFrame, step: int, windows, spans: DataFrame) -> DataFrame:
    """Side, joint and shared volume over the last 1, 4, 8 ... profile steps before T.

    A window that meets a quarantine or misses a profile bucket is unavailable, never zero.
    """
    n = max(windows)
    ks = F.sequence(F.lit(1), F.lit(n))
    present = profile.select("symbol", "bucket").distinct()
    asks = unions.withColumn("k", F.explode(ks)).withColumn("bucket", F.col("T") - F.col("k") * step)
    asks = asks.join(present, ["symbol", "bucket"], "left_semi")
    q = asks.select(F.struct(*KEYS, "side").alias("qid"), "symbol", "bucket", "lower", "upper")
    got = range_quantity(q, profile.select("symbol", "bucket", "price", "quantity", "buy", "sell"))
    got = got.select("qid.*", ((F.col("T") - F.col("bucket")) / step).cast("long").alias("k"), "quantity", "buy", "sell").drop("bucket")
    spread = F.explode(F.array(*[F.lit(w).cast("long") for w in windows]))
    sums = (
        got.withColumn("window", spread)
        .filter("k <= window")
        .groupBy(*KEYS, "window")
        .agg(*[F.sum(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in SIDES for c in ("quantity", "buy", "sell")])
    )
    counts = unions.groupBy(*KEYS).agg(*[F.count(F.when(F.col("side") == s, 1)).alias(f"{s}_interval_count") for s in SIDES])
    base = d.select(*KEYS).withColumn("window", spread).withColumn("observation_start", F.col("T") - F.col("window") * step)
    hit = windows_hit(base, ["symbol", "T", "window"], F.col("observation_start"), F.col("T"), spans, n * step).withColumn("_hit", F.lit(True))
    times = base.select("symbol", "T", "window").distinct()
    have = (
        times.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("window"))))
        .withColumn("bucket", F.col("T") - F.col("k") * step)
        .join(present, ["symbol", "bucket"])
        .groupBy("symbol", "T", "window")
        .agg(F.count(F.lit(1)).alias("_have"))
    )
    j = (
        base.join(hit, ["symbol", "T", "window"], "left")
        .join(have, ["symbol", "T", "window"], "left")
        .join(sums, [*KEYS, "window"], "left")
        .join(counts, list(KEYS), "left")
    )
    status = F.when(F.col("_hit"), "QUARANTINED").when(F.coalesce("_have", F.lit(0)) < F.col("window"), "MISSING_PROFILE").otherwise("AVAILABLE")
    j = j.withColumn("flow_status", status)
    for s in SIDES:
        for c in ("quantity", "buy", "sell"):
            j = j.withColumn(f"{s}_{c}", F.when(F.col("flow_status") == "AVAILABLE", F.coalesce(f"{s}_{c}", F.lit(0.0))))
        j = j.withColumn(f"{s}_interval_count", F.coalesce(f"{s}_interval_count", F.lit(0)))
        j = j.withColumn(f"{s}_delta", F.col(f"{s}_buy") - F.col(f"{s}_sell"))
        j = j.withColumn(f"{s}_normalized_delta", normalized_delta(F.col(f"{s}_buy"), F.col(f"{s}_sell"), F.round(F.col(f"{s}_quantity"), 9)))
    both = F.col("support_quantity") + F.col("resistance_quantity")
    diff = F.col("support_normalized_delta") - F.col("resistance_normalized_delta")
    return (
        j.withColumn("shared_quantity", both - F.col("joint_quantity"))
        .withColumn("normalized_delta_difference", diff)
        .withColumn("raw_delta_difference", F.col("support_delta") - F.col("resistance_delta"))
        .withColumn("buy_share_difference", diff / 2)
        .withColumn("support_volume_share", ratio(F.col("support_quantity"), F.round(both, 9)))
        .drop("_hit", "_have")
    )


def attach_flow(states: DataFrame, flow: DataFrame, first_window: int) -> DataFrame:
    """States with their shortest-window flow."""
    f = flow.filter(F.col("window") == first_window).drop("window")
    return states.join(f, list(KEYS), "left")


