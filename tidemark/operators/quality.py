"""Integrity checks over candles and trades. Rows are reported or set aside, never repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import MINUTE
from tidemark.functions.columns import all_of, count_if, floor_to
from tidemark.functions.intervals import merged_minutes, windows_hit
from tidemark.functions.scans import previous_row

SEQ_CHUNK = 1_000_000


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def ohlc_violations() -> Column:
    """Names of the broken candle rules, in a fixed order."""
    prices = ("open", "high", "low", "close")
    amounts = ("volume", "quote_volume", "taker_buy_volume", "taker_buy_quote_volume")
    body_low, body_high = F.least("open", "close"), F.greatest("open", "close")
    rules = [
        ("not_finite", ~all_of([_finite(c) for c in prices])),
        ("not_positive", ~all_of([F.col(c) > 0 for c in prices])),
        ("low_above_body", F.col("low") > body_low),
        ("high_below_body", F.col("high") < body_high),
        ("negative_amount", ~all_of([F.col(c) >= 0 for c in amounts])),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), n) for n, bad in rules]))


def validate_ohlc(candles: DataFrame) -> DataFrame:
    return candles.withColumn("violations", ohlc_violations())


def validate_close_clock(candles: DataFrame, step: int) -> DataFrame:
    return candles.withColumn("close_ok", F.col("close_time") == F.col("open_time") + (step - 1)).withColumn(
        "aligned", F.pmod("open_time", F.lit(step)) == 0
    )


def detect_gaps(candles: DataFrame, step: int) -> DataFrame:
    """Expected time, actual time and number of missing bars for every hole."""
    d = previous_row(
        candles.select("symbol", "open_time"),
        ["symbol"],
        ["open_time"],
        F.floor(F.col("open_time") / F.lit(step * 4096)),
        ["open_time"],
    )
    delta = F.col("open_time") - F.col("prev.open_time")
    return d.filter(delta > step).select(
        "symbol",
        (F.col("prev.open_time") + step).alias("expected_open_time"),
        F.col("open_time").alias("actual_open_time"),
        (F.floor(delta / F.lit(step)) - 1).cast("long").alias("missing_candle_count"),
    )


def calendar(bounds: DataFrame, step: int, name: str) -> DataFrame:
    """Every step start in [start, end); ``bounds`` has one row per series.

    The days are generated first and spread before each is expanded, so the calendar of
    a long series is not built in one task.
    """
    days = bounds.select("*", F.explode(F.sequence("start", F.col("end") - 1, F.lit(86_400_000))).alias("_d"))
    inner = F.sequence("_d", F.least(F.col("_d") + (86_400_000 - 1), F.col("end") - 1), F.lit(step))
    return days.repartition("_d").select(
        *[c for c in bounds.columns if c not in ("start", "end")], F.explode(inner).alias(name)
    )


def missing_buckets(actual: DataFrame, bounds: DataFrame, step: int, name: str) -> DataFrame:
    """The full calendar minus what was observed."""
    grid = calendar(bounds, step, name)
    keys = [c for c in grid.columns]
    return grid.join(actual.select(*keys).distinct(), keys, "left_anti")


def contiguity_report(candles: DataFrame, step: int) -> DataFrame:
    d = previous_row(
        candles.select("symbol", "open_time", "end"),
        ["symbol"],
        ["open_time"],
        F.floor(F.col("open_time") / F.lit(step * 4096)),
        ["end"],
    )
    return d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("open_time").alias("ids"),
        count_if(F.col("prev").isNotNull() & (F.col("prev.end") != F.col("open_time"))).alias("breaks"),
    )


def require_contiguous(candles: DataFrame) -> DataFrame:
    """Fail the job where a bar does not start at the end of the one before (grid index step 1)."""
    d = previous_row(
        candles, ["symbol", "tf"], ["idx"], F.floor(F.col("idx") / 4096), ["idx"]
    )
    bad = F.col("prev").isNotNull() & (F.col("idx") != F.col("prev.idx") + 1)
    return d.filter(F.when(bad, F.raise_error(F.lit("missing candles cannot be bridged"))).otherwise(True)).drop("prev")


def dedup_keep_last(candles: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Keep the last record per bar (close_time, then arrival) and how many it replaced."""
    cols = [c for c in candles.columns if c not in ("symbol", "open_time", arrival)]
    return (
        candles.groupBy("symbol", "open_time")
        .agg(
            F.max_by(F.struct(*cols), F.struct("close_time", arrival)).alias("r"),
            (F.count(F.lit(1)) - 1).alias("replaced"),
        )
        .select("symbol", "open_time", "r.*", "replaced")
    )


def with_previous_trade(trades: DataFrame, order: str = "seq") -> DataFrame:
    return previous_row(
        trades,
        ["symbol"],
        [order],
        F.floor(F.col(order) / F.lit(SEQ_CHUNK)),
        ["id", "timestamp", "price", "quantity", "first_trade_id", "last_trade_id"],
    )


def inspect_trades(raw: DataFrame, start: int, end: int, order: str = "seq") -> DataFrame:
    """One integrity row per symbol over parsed trades in arrival order (``bad`` rows set aside)."""
    good = with_previous_trade(raw.filter(~F.col("bad")), order)
    p, has = F.col("prev"), F.col("prev").isNotNull()
    gap = F.col("timestamp") - p["timestamp"]
    record = ["id", "timestamp", "price", "quantity", "buyer_is_maker", "first_trade_id", "last_trade_id"]
    dup = (
        good.groupBy("symbol", "id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*record[1:])).alias("d"))
        .groupBy("symbol")
        .agg(
            F.sum(F.col("n") - 1).alias("duplicate_aggregate_ids"),
            F.sum(F.col("n") - F.col("d")).alias("duplicate_records"),
        )
    )
    main = good.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("valid_rows"),
        count_if((F.col("timestamp") < start) | (F.col("timestamp") >= end)).alias("timestamp_out_of_range"),
        count_if(has & ((gap < 0) | (F.col("id") < p["id"]))).alias("out_of_order"),
        count_if(has & (F.col("id") != p["id"] + 1)).alias("aggregate_id_discontinuities"),
        count_if(has & (F.col("first_trade_id") != p["last_trade_id"] + 1)).alias("constituent_id_discontinuities"),
        F.greatest(F.max(F.when(has, gap)), F.lit(0)).alias("max_intertrade_gap_ms"),
        F.min_by("timestamp", order).alias("first_timestamp"),
        F.max_by("timestamp", order).alias("last_timestamp"),
    )
    bad = raw.groupBy("symbol").agg(F.count(F.lit(1)).alias("raw_rows"), count_if(F.col("bad")).alias("invalid_rows"))
    blocking = [
        "invalid_rows",
        "timestamp_out_of_range",
        "duplicate_aggregate_ids",
        "duplicate_records",
        "out_of_order",
        "aggregate_id_discontinuities",
    ]
    d = bad.join(main, "symbol", "left").join(dup, "symbol", "left")
    passed = (F.coalesce("valid_rows", F.lit(0)) > 0) & all_of([F.coalesce(c, F.lit(0)) == 0 for c in blocking])
    return d.withColumn(
        "status",
        F.when(~passed, "FAIL").when(F.col("constituent_id_discontinuities") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"),
    )


def chunk_stats(trades: DataFrame, by: Column, order: str = "seq") -> DataFrame:
    """Per chunk: rows, duplicates, ordering violations and both kinds of id discontinuity."""
    d = with_previous_trade(trades, order).withColumn("part", by)
    p, has = F.col("prev"), F.col("prev").isNotNull()
    dups = d.groupBy("symbol", "part", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("symbol", "part").agg(
        F.sum(F.col("n") - 1).alias("duplicate_ids")
    )
    step = F.col("id") - p["id"]
    main = d.groupBy("symbol", "part").agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(has & ((step <= 0) | (F.col("timestamp") < p["timestamp"]))).alias("ordering_violations"),
        count_if(has & (step != 1)).alias("aggregate_discontinuities"),
        count_if(has & (F.col("first_trade_id") != p["last_trade_id"] + 1)).alias("constituent_discontinuities"),
        count_if((F.col("price") <= 0) | (F.col("quantity") <= 0)).alias("invalid_values"),
    )
    return main.join(dups, ["symbol", "part"])


def id_gaps(trades: DataFrame, order: str = "seq") -> DataFrame:
    """Boundary records around every id jump greater than one."""
    d = with_previous_trade(trades, order)
    step = F.col("id") - F.col("prev.id")
    return d.filter(step > 1).select(
        "symbol",
        F.col("prev.id").alias("before_id"),
        F.col("prev.timestamp").alias("before_timestamp"),
        F.col("prev.price").alias("before_price"),
        F.col("id").alias("after_id"),
        F.col("timestamp").alias("after_timestamp"),
        F.col("price").alias("after_price"),
        step.alias("id_step"),
    )


def partition_edges(trades: DataFrame, part: Column, order: str = "seq") -> DataFrame:
    """Step between the last row of each partition and the first row of the next."""
    cols = F.struct("id", "timestamp")
    e = (
        trades.withColumn("part", part)
        .groupBy("symbol", "part")
        .agg(F.min_by(cols, order).alias("first"), F.max_by(cols, order).alias("last"))
    )
    w = Window.partitionBy("symbol").orderBy("part")  # one row per partition
    prev = F.lag("last").over(w)
    return e.withColumn("prev", prev).filter("prev is not null").select(
        "symbol",
        "part",
        F.col("prev.id").alias("last_id_before"),
        F.col("first.id").alias("first_id"),
        (F.col("first.id") - F.col("prev.id")).alias("id_step"),
        (F.col("first.timestamp") < F.col("prev.timestamp")).alias("time_reversed"),
    )


def order_issues(trades: DataFrame, order: str = "arrival") -> DataFrame:
    d = with_previous_trade(trades, order)
    step = F.col("id") - F.col("prev.id")
    return d.groupBy("symbol").agg(
        count_if(step < 0).alias("reversals"),
        count_if(step > 1).alias("positive_jumps"),
        count_if(step == 0).alias("duplicates"),
    )


def missing_ids_elsewhere(gaps: DataFrame, other: DataFrame, bucket: int = 4096) -> DataFrame:
    """Per gap: ids missing in the first source and how many of them the other one has."""
    g = gaps.select("symbol", "before_id", "after_id", "id_step")
    spread = g.withColumn(
        "_b",
        F.explode(
            F.sequence(F.floor((F.col("before_id") + 1) / F.lit(bucket)), F.floor((F.col("after_id") - 1) / F.lit(bucket)))
        ),
    )
    o = other.select("symbol", "id", F.floor(F.col("id") / F.lit(bucket)).alias("_b"))
    found = (
        spread.join(o, ["symbol", "_b"])
        .filter((F.col("id") > F.col("before_id")) & (F.col("id") < F.col("after_id")))
        .groupBy("symbol", "before_id")
        .agg(F.count(F.lit(1)).alias("present"))
    )
    return g.join(found, ["symbol", "before_id"], "left").select(
        "symbol",
        "before_id",
        "after_id",
        (F.col("id_step") - 1).alias("missing_id_count"),
        F.coalesce("present", F.lit(0)).alias("present_elsewhere"),
    )


def compare_publications(a: DataFrame, b: DataFrame, gaps: DataFrame, bounds: DataFrame) -> DataFrame:
    """Affected minutes of two per-minute tables: unequal quantity, or near a gap; each with its neighbours."""
    cal = calendar(bounds, MINUTE, "minute")
    j = (
        cal.join(a.select("symbol", "minute", F.col("quantity").alias("qa"), F.col("count").alias("na")), ["symbol", "minute"], "left")
        .join(b.select("symbol", "minute", F.col("quantity").alias("qb"), F.col("count").alias("nb")), ["symbol", "minute"], "left")
        .fillna(0, ["qa", "qb", "na", "nb"])
    )
    differing = j.filter(F.abs(F.col("qa") - F.col("qb")) > 1e-7).select("symbol", "minute")
    around = gaps.select(
        "symbol",
        F.explode(
            F.sequence(
                floor_to(F.col("before_timestamp"), MINUTE) - 5 * MINUTE,
                floor_to(F.col("after_timestamp"), MINUTE) + 5 * MINUTE,
                F.lit(MINUTE),
            )
        ).alias("minute"),
    )
    touched = (
        differing.union(around)
        .distinct()
        .select("symbol", F.explode(F.array(*[F.col("minute") + o for o in (-MINUTE, 0, MINUTE)])).alias("minute"))
        .distinct()
    )
    return j.join(touched, ["symbol", "minute"], "left_semi")


def fingerprint(df: DataFrame, cols) -> DataFrame:
    """Order-free fingerprint: row count and a decimal sum of row hashes."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("hash_sum"),
    )


def fingerprint_equal(a: DataFrame, b: DataFrame, cols) -> DataFrame:
    fa = fingerprint(a, cols).select(F.col("rows").alias("rows_a"), F.col("hash_sum").alias("ha"))
    fb = fingerprint(b, cols).select(F.col("rows").alias("rows_b"), F.col("hash_sum").alias("hb"))
    same = (F.col("rows_a") == F.col("rows_b")) & F.col("ha").eqNullSafe(F.col("hb"))
    return fa.crossJoin(fb).select("rows_a", "rows_b", same.alias("same"))


def reconcile_volume(trades: DataFrame, candles: DataFrame, step: int) -> DataFrame:
    """Trade sum per candle against the candle's own volume."""
    t = trades.groupBy("symbol", floor_to(F.col("timestamp"), step).alias("open_time")).agg(
        F.sum("quantity").alias("trade_volume")
    )
    return (
        candles.select("symbol", "open_time", "volume")
        .join(t, ["symbol", "open_time"], "full_outer")
        .withColumn("difference", F.coalesce("trade_volume", F.lit(0.0)) - F.coalesce("volume", F.lit(0.0)))
    )


def corroborate_empty(expected: DataFrame, candles: DataFrame) -> DataFrame:
    """An empty trade bucket is accepted only where the official candle shows no activity at all."""
    j = expected.join(candles.select("symbol", "open_time", "volume", "trade_count", "taker_buy_volume"), ["symbol", "open_time"], "left")
    idle = (F.col("volume") == 0) & (F.col("trade_count") == 0) & (F.col("taker_buy_volume") == 0)
    return j.withColumn(
        "classification",
        F.when(F.coalesce(idle, F.lit(False)), "ZERO_ACTIVITY_CORROBORATED").otherwise("COVERAGE_REVIEW_REQUIRED"),
    )


def covered_decisions(decisions: DataFrame, spans: DataFrame, lookback: int, bucket: int) -> DataFrame:
    """Decisions whose whole lookback [T - lookback, T) meets no quarantined span."""
    t = F.col("decision_timestamp")
    hit = windows_hit(decisions, ["symbol", "decision_timestamp"], t - lookback, t, spans, bucket)
    return decisions.join(hit, ["symbol", "decision_timestamp"], "left_anti")


def select_source(monthly: DataFrame, daily: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per month the monthly publication where it passed, else the complete daily collection."""
    month = F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd")
    m = monthly.withColumn("part", month).join(verdicts.filter("ok"), ["symbol", "part"], "left_semi")
    d = daily.withColumn("part", month).join(verdicts.filter("not ok"), ["symbol", "part"], "left_semi")
    return m.withColumn("source", F.lit("monthly")).unionByName(d.withColumn("source", F.lit("daily")))


def period_guard(df: DataFrame, ts: str, start: int, end: int, reserved: int) -> DataFrame:
    """Rows of [start, end); any row at or past ``reserved`` inside it fails the job."""
    t = F.col(ts)
    ok = F.when(t >= reserved, F.raise_error(F.lit("reserved period"))).otherwise(True)
    return df.filter((t >= start) & (t < end)).filter(ok)


def closed_only(candles: DataFrame, as_of: int) -> DataFrame:
    return candles.filter(F.col("end") <= as_of)


def complete_lookback(candles: DataFrame, bars: int, chunk: int = 4096) -> DataFrame:
    """Decision rows (T, P) whose window of ``bars`` closed bars ending at T is complete.

    Bars seen up to each grid index come from a running count, so T is complete when the
    count at T minus the count ``bars`` steps earlier equals ``bars``.
    """
    from tidemark.functions.scans import halo, own

    w = Window.partitionBy("symbol", "tf", "_c").orderBy("idx").rangeBetween(-(bars - 1), 0)
    d = halo(candles, "idx", before=bars - 1, chunk=max(chunk, bars))
    return own(d.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") == bars)).drop("_n")


def equivalence(a: DataFrame, b: DataFrame, keys, fields, tol: float = 1e-12) -> DataFrame:
    """Field-by-field differences of two keyed tables; empty means equal."""
    left = a.select(*keys, F.lit(True).alias("_in_a"), *[F.col(f).cast("double").alias(f"a_{f}") for f in fields])
    right = b.select(*keys, F.lit(True).alias("_in_b"), *[F.col(f).cast("double").alias(f"b_{f}") for f in fields])
    j = left.join(right, list(keys), "full_outer")
    cells = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in fields])
    )
    same = F.col("c.a").eqNullSafe(F.col("c.b")) | (F.abs(F.col("c.a") - F.col("c.b")) <= tol)
    return (
        j.select(*keys, "_in_a", "_in_b", cells.alias("c"))
        .filter(F.col("_in_a").isNull() | F.col("_in_b").isNull() | ~F.coalesce(same, F.lit(False)))
        .select(*keys, F.col("c.field").alias("field"), F.col("c.a").alias("a"), F.col("c.b").alias("b"))
    )


def truncation_check(full: DataFrame, truncated: DataFrame, known: str, as_of: int) -> DataFrame:
    """Rows known by ``as_of`` that change when the future is physically removed; empty means causal."""
    past = full.filter(F.col(known) <= as_of)
    lost = past.exceptAll(truncated).withColumn("side", F.lit("only_full"))
    extra = truncated.exceptAll(past).withColumn("side", F.lit("only_truncated"))
    return lost.unionByName(extra)


def rules(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One audit row per rule with the number of rows that break it, in a single pass."""
    one = df.agg(*[count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in checks.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in checks]))
    return one.select(pairs.alias("p")).select("p.*")


def quarantine_minutes(minutes: DataFrame) -> DataFrame:
    return merged_minutes(minutes.filter(F.col("decision") == "QUARANTINE"), ["symbol"])
