"""Traded volume at price: exact-price profiles, bins, zone volume, rolling volume maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import count_if, floor_to, ratio, sum_if
from tidemark.functions.intervals import in_buckets, windows_hit
from tidemark.functions.scans import running

SIDES = ("quantity", "buy", "sell")


def side_totals(trades: DataFrame, *keys) -> DataFrame:
    """Total, buy, sell and unknown-side quantity; the delta is null while any side is unknown."""
    q, m = F.col("quantity"), F.col("buyer_is_maker")
    d = trades.groupBy(*keys).agg(
        F.sum(q).alias("quantity"),
        sum_if(~m, q).alias("buy"),
        sum_if(m, q).alias("sell"),
        sum_if(m.isNull(), q).alias("unknown"),
    )
    return d.withColumn("delta", F.when(F.col("unknown") == 0, F.col("buy") - F.col("sell")))


def decimal_bin(price: Column, width: str) -> Column:
    """Exact decimal floor of price / width, on the shortest decimal text of the price."""
    p = price.cast("string").cast("decimal(20,8)")
    w = F.lit(width).cast("decimal(20,8)")
    return ((p - F.pmod(p, w)) / w).cast("long")


def float_bin(price: Column, width: float) -> Column:
    return F.floor(price / F.lit(width)).cast("long")


def volume_at_price(trades: DataFrame, width: str, window_ms: int) -> DataFrame:
    """Decimal bins per window with side totals, trade count and an order-free id checksum.

    Ids stay in the trade table (``bin`` can be recomputed there); a bin row never holds a list
    of its trades, so a bin with a third of all trades is still one small row.
    """
    d = trades.withColumn("window_start", floor_to(F.col("timestamp"), window_ms)).withColumn(
        "bin", decimal_bin(F.col("price"), width)
    )
    q, m = F.col("quantity"), F.col("buyer_is_maker")
    check = F.pmod(F.col("id") * F.lit(2654435761), F.lit(4294967296))
    out = d.groupBy("symbol", "window_start", "bin").agg(
        F.sum(q).alias("quantity"),
        sum_if(~m, q).alias("buy"),
        sum_if(m, q).alias("sell"),
        sum_if(m.isNull(), q).alias("unknown"),
        F.count(F.lit(1)).alias("trade_count"),
        F.sum(check).alias("ids_checksum"),
    )
    w = float(width)
    return (
        out.withColumn("delta", F.when(F.col("unknown") == 0, F.col("buy") - F.col("sell")))
        .withColumn("lower", F.col("bin") * w)
        .withColumn("upper", (F.col("bin") + 1) * w)
    )


def bin_trades(trades: DataFrame, width: float, *keys) -> DataFrame:
    m, q = F.col("buyer_is_maker"), F.col("quantity")
    return trades.groupBy(*keys, float_bin(F.col("price"), width).alias("bin")).agg(
        F.sum(q).alias("quantity"), sum_if(~m, q).alias("buy"), sum_if(m, q).alias("sell")
    )


def profile(trades: DataFrame, step: int) -> DataFrame:
    """Exact observed price x time bucket: quantity, buy, sell, delta."""
    m, q = F.col("buyer_is_maker"), F.col("quantity")
    return (
        trades.groupBy("symbol", floor_to(F.col("timestamp"), step).alias("bucket"), "price")
        .agg(F.sum(q).alias("quantity"), sum_if(~m, q).alias("buy"), sum_if(m, q).alias("sell"))
        .withColumn("delta", F.col("buy") - F.col("sell"))
        .withColumn("end", F.col("bucket") + step)
    )


def merge_profiles(parts: DataFrame, step: int) -> DataFrame:
    """Partial or finer profiles to one profile per ``step``."""
    return (
        parts.groupBy("symbol", floor_to(F.col("bucket"), step).alias("bucket"), "price")
        .agg(*[F.sum(c).alias(c) for c in SIDES])
        .withColumn("delta", F.col("buy") - F.col("sell"))
        .withColumn("end", F.col("bucket") + step)
    )


def window_profile(parts: DataFrame, decisions: DataFrame, step: int, windows) -> DataFrame:
    """Profile of the last 1, 4, 8 ... buckets before each decision T (symbol, T)."""
    n = max(windows)
    d = decisions.select("symbol", "T").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    d = d.withColumn("bucket", F.col("T") - F.col("k") * step)
    j = d.join(parts, ["symbol", "bucket"])
    w = F.explode(F.filter(F.array(*[F.lit(x) for x in windows]), lambda x: x >= F.col("k")))
    return j.withColumn("window", w).groupBy("symbol", "T", "window", "price").agg(*[F.sum(c).alias(c) for c in SIDES])


def with_coverage(profile_: DataFrame, spans: DataFrame, bucket_ms: int) -> DataFrame:
    hit = windows_hit(
        profile_.select("symbol", "bucket", "end").distinct(), ["symbol", "bucket"], F.col("bucket"), F.col("end"), spans, bucket_ms
    ).withColumn("_hit", F.lit(True))
    return (
        profile_.join(hit, ["symbol", "bucket"], "left")
        .withColumn("coverage_status", F.when(F.col("_hit"), "QUARANTINED").otherwise("OBSERVED"))
        .drop("_hit")
    )


def profile_parity(fine: DataFrame, coarse: DataFrame, step: int) -> DataFrame:
    a = merge_profiles(fine, step).select("symbol", "bucket", "price", *[F.col(c).alias(f"a_{c}") for c in SIDES])
    b = coarse.select("symbol", "bucket", "price", *[F.col(c).alias(f"b_{c}") for c in SIDES])
    j = a.join(b, ["symbol", "bucket", "price"], "full_outer")
    worst = F.greatest(*[F.abs(F.coalesce(f"a_{c}", F.lit(0.0)) - F.coalesce(f"b_{c}", F.lit(0.0))) for c in SIDES])
    return j.agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(F.col("a_quantity").isNull() | F.col("b_quantity").isNull()).alias("unmatched"),
        F.max(worst).alias("max_difference"),
    )


def hourly_bins(profile_: DataFrame, width: float) -> DataFrame:
    return profile_.groupBy("symbol", F.col("bucket").alias("hour"), float_bin(F.col("price"), width).alias("bin")).agg(
        *[F.sum(c).alias(c) for c in SIDES]
    )


def range_quantity(bounds: DataFrame, profile_: DataFrame, band: float = 0.002) -> DataFrame:
    """Quantity traded inside closed price ranges.

    ``bounds``: qid, symbol, bucket, lower, upper. Instead of joining every price with every
    range, prices and bounds are sorted together per bucket and one running sum answers both
    ends of all ranges; buckets are cut into price bands, so none runs in a single task.
    Returns qid, bucket, quantity, buy, sell (zero where nothing traded).
    """
    zero = [F.lit(0.0).alias(c) for c in SIDES]
    p = profile_.select("symbol", "bucket", "price", F.lit(1).alias("_o"), F.lit(None).alias("qid"), F.lit(0).alias("_sign"), *SIDES)
    edge = lambda c, o, s: bounds.select(
        "symbol", "bucket", F.col(c).alias("price"), F.lit(o).alias("_o"), "qid", F.lit(s).alias("_sign"), *zero
    )
    rows = p.unionByName(edge("lower", 0, -1)).unionByName(edge("upper", 2, 1))
    chunk = F.floor(F.log("price") / F.lit(band))
    acc = running(rows, ["symbol", "bucket"], ["price", "_o"], chunk, {f"c_{c}": F.col(c) for c in SIDES})
    return (
        acc.filter("_sign <> 0")
        .groupBy("qid", "bucket")
        .agg(*[F.sum(F.col(f"c_{c}") * F.col("_sign")).alias(c) for c in SIDES])
    )


def zone_volume(interactions: DataFrame, profile_: DataFrame, window_ms: int, start: int, spans: DataFrame) -> DataFrame:
    """In-zone quantity of the last window against the window before it.

    Columns: interaction_id, status, quantity, buy, sell, volume_delta, baseline_quantity,
    relative_zone_volume and the window bounds. Missing coverage is told before quarantine only
    where the tape has not started; a missing bucket comes after quarantine.
    """
    T = F.col("observed_at")
    i = interactions.select("interaction_id", "symbol", "observed_at", "zone_lower", "zone_upper")
    both = F.explode(F.array(T - window_ms, T - 2 * window_ms))
    q = i.select(
        F.col("interaction_id").alias("qid"), "symbol", both.alias("bucket"), F.col("zone_lower").alias("lower"), F.col("zone_upper").alias("upper")
    )
    present = profile_.select("symbol", "bucket").distinct()
    q = q.join(present, ["symbol", "bucket"], "left_semi")
    sums = range_quantity(q, profile_).withColumnRenamed("qid", "interaction_id")
    d = i.join(sums, "interaction_id", "left")
    now, base = F.col("bucket") == T - window_ms, F.col("bucket") == T - 2 * window_ms
    d = d.groupBy("interaction_id", "symbol", "observed_at").agg(
        F.max(F.when(now, F.col("quantity"))).alias("_q"),
        F.max(F.when(now, F.col("buy"))).alias("_b"),
        F.max(F.when(now, F.col("sell"))).alias("_s"),
        F.max(F.when(base, F.col("quantity"))).alias("_base"),
    )
    times = i.select("symbol", "observed_at").distinct()
    hit = windows_hit(times, ["symbol", "observed_at"], T - 2 * window_ms, T, spans, 2 * window_ms).withColumn("_hit", F.lit(True))
    d = d.join(hit, ["symbol", "observed_at"], "left")
    status = (
        F.when(T - 2 * window_ms < start, "MISSING_TRADE_COVERAGE")
        .when(F.col("_hit"), "QUARANTINED_TRADE_COVERAGE")
        .when(F.col("_q").isNull() | F.col("_base").isNull(), "MISSING_TRADE_COVERAGE")
        .otherwise("AVAILABLE")
    )
    d = d.withColumn("status", status)
    ok = lambda c: F.when(F.col("status") == "AVAILABLE", c)
    return d.select(
        "interaction_id",
        "symbol",
        T.alias("timestamp"),
        "status",
        ok(F.col("_q")).alias("quantity"),
        ok(F.col("_b")).alias("aggressive_buy_quantity"),
        ok(F.col("_s")).alias("aggressive_sell_quantity"),
        ok(F.col("_b") - F.col("_s")).alias("volume_delta"),
        ok(F.col("_base")).alias("baseline_quantity"),
        ok(ratio(F.col("_q"), F.col("_base"))).alias("relative_zone_volume"),
        ok(T - window_ms).alias("window_start"),
        ok(T - 2 * window_ms).alias("baseline_start"),
    )


def window_status(times: DataFrame, profile_: DataFrame, window_ms: int, start: int, spans: DataFrame) -> DataFrame:
    """(symbol, observed_at, status): may the last two windows before a time be used? The tape has not started, a span touches them, one of
    them has no trades, or both are there."""
    T = F.col("observed_at")
    hit = windows_hit(times, ["symbol", "observed_at"], T - 2 * window_ms, T, spans, 2 * window_ms).withColumn("_hit", F.lit(True))
    asked = times.withColumn("bucket", F.explode(F.array(T - window_ms, T - 2 * window_ms)))
    there = asked.join(profile_.select("symbol", "bucket").distinct(), ["symbol", "bucket"], "left_semi").groupBy("symbol", "observed_at").agg(F.count(F.lit(1)).alias("_n"))
    d = times.join(hit, ["symbol", "observed_at"], "left").join(there, ["symbol", "observed_at"], "left")
    status = (
        F.when(T - 2 * window_ms < start, "MISSING_TRADE_COVERAGE").when(F.col("_hit"), "QUARANTINED_TRADE_COVERAGE")
        .when(F.coalesce("_n", F.lit(0)) < 2, "MISSING_TRADE_COVERAGE").otherwise("AVAILABLE")
    )
    return d.select("symbol", "observed_at", status.alias("status"))


def rolling_vap(bins: DataFrame, lookback: int, step: int) -> DataFrame:
    """Volume per bin over [T - lookback, T) as a change log: valid from T until ``valid_to``.

    Every bucket is added when it closes and taken away ``lookback`` later. A bin is dropped
    when no bucket of it is left, so float residue cannot keep it alive.
    """
    add = bins.select("symbol", "bin", (F.col("hour") + step).alias("T"), *SIDES, F.lit(1).alias("_n"))
    gone = bins.select(
        "symbol", "bin", (F.col("hour") + step + lookback).alias("T"), *[(-F.col(c)).alias(c) for c in SIDES], F.lit(-1).alias("_n")
    )
    d = add.unionByName(gone).groupBy("symbol", "bin", "T").agg(*[F.sum(c).alias(c) for c in SIDES], F.sum("_n").alias("_n"))
    w = Window.partitionBy("symbol", "bin").orderBy("T")  # one row per closed bucket of a bin
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.select(
        "symbol", "bin", "T", F.lead("T").over(w).alias("valid_to"), *[F.sum(c).over(run).alias(c) for c in SIDES], F.sum("_n").over(run).alias("occurrences")
    )
    return d.filter("occurrences > 0")


def vap_at(log: DataFrame, decisions: DataFrame, bucket_ms: int) -> DataFrame:
    """The volume map at each decision (symbol, T, P), from the change log."""
    l = in_buckets(log.withColumnRenamed("T", "valid_from"), F.col("valid_from"), F.coalesce("valid_to", F.col("valid_from") + 1), bucket_ms)
    d = decisions.select("symbol", "T", "P").withColumn("_b", F.floor(F.col("T") / F.lit(bucket_ms)))
    return d.join(l, ["symbol", "_b"]).filter((F.col("T") >= F.col("valid_from")) & (F.col("T") < F.col("valid_to"))).drop("_b", "valid_from", "valid_to")


def vap_snapshot(vap: DataFrame, width: float, multiple: float = 1.5) -> DataFrame:
    """Per decision: volume above, below and straddling P, concentrated parts, totals."""
    low, high = F.col("bin") * F.lit(width), (F.col("bin") + 1) * F.lit(width)
    mean = vap.groupBy("symbol", "T").agg(F.avg("quantity").alias("_mean"))
    d = vap.join(mean, ["symbol", "T"])
    rel = F.when(low >= F.col("P"), "ABOVE").when(high <= F.col("P"), "BELOW").otherwise("STRADDLES")
    d = d.withColumn("relation", rel).withColumn("concentrated", (F.col("_mean") > 0) & (F.col("quantity") >= F.col("_mean") * multiple))
    q, up, down = F.col("quantity"), F.col("relation") == "ABOVE", F.col("relation") == "BELOW"
    return d.groupBy("symbol", "T").agg(
        F.count(F.lit(1)).alias("bins"),
        count_if(up).alias("bins_above"),
        count_if(down).alias("bins_below"),
        count_if(F.col("concentrated")).alias("concentrated_bins"),
        F.sum(q).alias("total_quantity"),
        F.sum("buy").alias("buy"),
        F.sum("sell").alias("sell"),
        sum_if(up, q).alias("above_quantity"),
        sum_if(down, q).alias("below_quantity"),
        sum_if(F.col("relation") == "STRADDLES", q).alias("straddling_quantity"),
        sum_if(up & F.col("concentrated"), q).alias("concentrated_above_quantity"),
        sum_if(down & F.col("concentrated"), q).alias("concentrated_below_quantity"),
    )


def window_bins(trades: DataFrame, width, window_ms: int, tf: str, exact: bool) -> DataFrame:
    """Occupied bins of fixed windows, in the shape detector D reads."""
    key = decimal_bin(F.col("price"), str(width)) if exact else float_bin(F.col("price"), float(width))
    d = trades.groupBy("symbol", floor_to(F.col("timestamp"), window_ms).alias("window_start"), key.alias("bin")).agg(
        F.sum("quantity").alias("quantity")
    )
    w = float(width)
    return d.withColumn("tf", F.lit(tf)).withColumn("lower", F.col("bin") * w).withColumn("upper", (F.col("bin") + 1) * w)
