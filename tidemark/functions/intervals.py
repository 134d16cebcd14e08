"""Interval joins as equi-joins on coarse buckets, and interval unions by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_buckets(df: DataFrame, start: Column, end: Column, size: int, name: str = "_b") -> DataFrame:
    """One row per bucket that the half-open interval [start, end) meets."""
    last = F.greatest(end - 1, start)
    return df.withColumn(
        name, F.explode(F.sequence(F.floor(start / F.lit(size)), F.floor(last / F.lit(size))))
    )


def points_in(df: DataFrame, ts: Column, spans: DataFrame, size: int, keep: bool = True) -> DataFrame:
    """Rows whose time lies in some span (or in none, with ``keep=False``)."""
    s = in_buckets(
        spans.select(F.col("start").alias("_s"), F.col("end").alias("_e")), F.col("_s"), F.col("_e"), size, "_sb"
    )
    d = df.withColumn("_t", ts).withColumn("_b", F.floor(F.col("_t") / F.lit(size)))
    cond = (F.col("_b") == F.col("_sb")) & (F.col("_t") >= F.col("_s")) & (F.col("_t") < F.col("_e"))
    return d.join(s, cond, "left_semi" if keep else "left_anti").drop("_t", "_b")


def windows_hit(df: DataFrame, key: list[str], start: Column, end: Column, spans: DataFrame, size: int) -> DataFrame:
    """Distinct ``key`` of the windows [start, end) that meet a span: start < span.end and end > span.start."""
    s = in_buckets(
        spans.select(F.col("start").alias("_s"), F.col("end").alias("_e")), F.col("_s"), F.col("_e"), size, "_sb"
    )
    d = in_buckets(df.withColumn("_qs", start).withColumn("_qe", end), F.col("_qs"), F.col("_qe"), size)
    cond = (F.col("_b") == F.col("_sb")) & (F.col("_qs") < F.col("_e")) & (F.col("_qe") > F.col("_s"))
    return d.join(s, cond, "left_semi").select(*key).distinct()


def union_intervals(df: DataFrame, keys, low: str = "lower", high: str = "upper") -> DataFrame:
    """Merge closed intervals per key; touching ones merge."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(high).over(before)
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(low) > reach), 1).otherwise(0))
    return (
        marked.withColumn("_run", F.sum("_new").over(w))
        .groupBy(*keys, "_run")
        .agg(F.min(low).alias(low), F.max(high).alias(high))
        .drop("_run")
    )


def merged_minutes(df: DataFrame, keys, minute: str = "minute", step: int = 60_000) -> DataFrame:
    """Adjacent minutes to half-open intervals."""
    d = df.select(*keys, F.col(minute).alias("lower"), (F.col(minute) + step).alias("upper")).distinct()
    return union_intervals(d, keys).select(*keys, F.col("lower").alias("start"), F.col("upper").alias("end"))


def intersect_unions(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Pairwise intersection of two disjoint-interval tables (columns lower, upper)."""
    left = a.select(*keys, F.col("lower").alias("_al"), F.col("upper").alias("_au"))
    right = b.select(*keys, F.col("lower").alias("_bl"), F.col("upper").alias("_bu"))
    low, high = F.greatest("_al", "_bl"), F.least("_au", "_bu")
    return left.join(right, list(keys)).filter(low <= high).select(*keys, low.alias("lower"), high.alias("upper"))
