"""Market context, quantile models, matched controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import bucket_left, bucket_right, count_if, quantile_label
from tidemark.functions.scans import halo, own, series


def context_features(candles: DataFrame, lookback: int = 24) -> DataFrame:
    """Population deviation of the last log returns and the return over the same bars."""
    w = series(("symbol", "tf"), "idx")
    d = halo(candles.select("symbol", "tf", "idx", "open_time", "end", "close"), "idx", before=lookback)
    d = d.withColumn("_r", F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.log(F.col("close") / F.lag("close").over(w))))
    win = w.rangeBetween(-(lookback - 1), 0)
    d = (
        d.withColumn("volatility", F.stddev_pop("_r").over(win))
        .withColumn("_n", F.count("_r").over(win))
        .withColumn("recent_return", F.col("close") / F.first("close").over(w.rangeBetween(-lookback, 0)) - 1)
    )
    return own(d.filter(F.col("_n") == lookback)).select("symbol", "tf", "idx", F.col("end").alias("timestamp"), "volatility", "recent_return", F.col("close").alias("P"))


def fit_quantiles(df: DataFrame, fields, groups: int, development_end: int | None = None, ts: str = "timestamp", distinct: bool = False) -> DataFrame:
    """One row per field with exact interpolated cut points, from development rows only.

    ``distinct`` collapses equal cuts. The model is one row per field whatever the data size.
    """
    d = df
    if development_end is not None:
        late = F.when(F.col(ts) >= development_end, F.raise_error(F.lit("fitting accepts development rows only"))).otherwise(True)
        d = df.filter(late)
    probs = [i / groups for i in range(1, groups)]
    ok = lambda f: F.when(~F.isnan(F.col(f)), F.col(f))
    one = d.agg(*[F.percentile(ok(f), probs).alias(f"q_{f}") for f in fields], *[F.count(ok(f)).alias(f"n_{f}") for f in fields])
    cuts = lambda f: F.array_distinct(F.col(f"q_{f}")) if distinct else F.col(f"q_{f}")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), cuts(f).alias("cuts"), F.col(f"n_{f}").alias("sample_count")) for f in fields])
    return one.select(F.explode(rows).alias("m")).select("m.*")


def wide_model(model: DataFrame, fields) -> DataFrame:
    return model.agg(*[F.max(F.when(F.col("field") == f, F.col("cuts"))).alias(f"cuts_{f}") for f in fields])


def apply_buckets(df: DataFrame, model: DataFrame, fields, side: str = "label") -> DataFrame:
    """``<field>_bucket`` by the frozen cuts: side label (Q1..), right or left."""
    d = df.crossJoin(F.broadcast(wide_model(model, fields)))  # one row
    f_ = {"label": quantile_label, "right": bucket_right, "left": bucket_left}[side]
    for f in fields:
        d = d.withColumn(f"{f}_bucket", f_(F.col(f), F.col(f"cuts_{f}")))
    return d.drop(*[f"cuts_{f}" for f in fields])


def matched_control(targets: DataFrame, pool: DataFrame, cell, horizon_ms: int, chunk_ms: int = 30 * 86_400_000) -> DataFrame:
    """For each target the most recent pool row of its cell whose horizon is already over.

    Pool rows are shifted by the horizon, sorted together with the targets, and the last one
    is carried forward: inside time chunks, and across them through one row per chunk.
    """
    cell = list(cell)
    t = targets.select(*cell, F.col("event_id"), F.col("timestamp").alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast("struct<timestamp:bigint,event_id:string>").alias("_m"))
    p = pool.select(*cell, F.lit(None).cast("string").alias("event_id"), (F.col("timestamp") + horizon_ms).alias("_t"), F.lit(0).alias("_o"), F.struct("timestamp", "event_id").alias("_m"))
    d = t.unionByName(p).withColumn("_c", F.floor(F.col("_t") / F.lit(chunk_ms)))
    tail = d.groupBy(*cell, "_c").agg(F.max("_m").alias("_tail"))
    before = Window.partitionBy(*cell).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    tail = tail.withColumn("_carry", F.max("_tail").over(before)).drop("_tail")
    local = Window.partitionBy(*cell, "_c").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_last", F.max("_m").over(local)).filter("_o = 1").join(tail, [*cell, "_c"], "left")
    m = F.coalesce("_last", "_carry")
    return d.select("event_id", m["event_id"].alias("control_event_id"), m["timestamp"].alias("control_timestamp")).filter("control_event_id is not null")


def fit_regimes(df: DataFrame, fit_end: int) -> DataFrame:
    """Volatility quartile edges and the neutral return band, from rows before ``fit_end``."""
    early = df.filter(F.col("timestamp") < fit_end)
    return early.agg(F.percentile("volatility", [0.25, 0.75]).alias("vol_cuts"), F.percentile(F.abs("recent_return"), 0.25).alias("neutral"))


def regimes(df: DataFrame, model: DataFrame, fit_end: int) -> DataFrame:
    d = df.crossJoin(F.broadcast(model))
    usable = (F.col("timestamp") >= fit_end) & F.col("volatility").isNotNull() & F.col("recent_return").isNotNull()
    v, x = F.col("volatility"), F.col("recent_return")
    vol = F.when(v < F.col("vol_cuts")[0], "LOW").when(v < F.col("vol_cuts")[1], "MIDDLE").otherwise("HIGH")
    ret = F.when(x < -F.col("neutral"), "NEGATIVE").when(x > F.col("neutral"), "POSITIVE").otherwise("NEUTRAL")
    d = d.withColumn("volatility_regime", F.when(usable, vol).otherwise("CALIBRATION"))
    return d.withColumn("return_regime", F.when(usable, ret).otherwise("CALIBRATION")).drop("vol_cuts", "neutral")


def ventile_support(df: DataFrame, field: str, week: Column, min_rows: int = 200, min_weeks: int = 5) -> DataFrame:
    """Decile, quartile and ventile cuts, whether ventiles are populated well enough, and the positive cut."""
    v = F.col(field)
    cuts = df.agg(
        F.array_distinct(F.percentile(v, [i / 10 for i in range(1, 10)])).alias("decile"),
        F.array_distinct(F.percentile(v, [0.25, 0.5, 0.75])).alias("quartile"),
        F.array_distinct(F.percentile(v, [i / 20 for i in range(1, 20)])).alias("ventile"),
        F.coalesce(F.percentile(F.when(v > 0.01, v), 0.9), F.lit(1.0)).alias("positive_cut"),
    )
    b = df.crossJoin(F.broadcast(cuts)).select(bucket_right(v, F.col("ventile")).alias("b"), week.alias("w")).filter("b >= 0")
    per = b.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("w").alias("weeks"))
    sup = per.agg(F.count(F.lit(1)).alias("bins"), F.min("n").alias("min_rows"), F.min("weeks").alias("min_weeks"))
    ok = (F.col("bins") == 20) & (F.col("min_rows") >= min_rows) & (F.col("min_weeks") >= min_weeks)
    return cuts.crossJoin(sup).withColumn("ventile_supported", F.coalesce(ok, F.lit(False)))
