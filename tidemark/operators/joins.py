"""Joins that state what they expect, and as-of joins on native clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import floor_to


def unique_on(df: DataFrame, keys, what: str) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ok = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"duplicate keys in {what}"))).otherwise(True)
    return df.withColumn("_n", n).filter(ok).drop("_n")


def join_validated(left: DataFrame, right: DataFrame, on, how: str = "inner", relation: str = "many_to_one") -> DataFrame:
    """A join that fails the job on duplicate keys of the 'one' side(s)."""
    on = list(on)
    if relation.endswith("_to_one"):
        right = unique_on(right, on, "right side")
    if relation.startswith("one_to"):
        left = unique_on(left, on, "left side")
    return left.join(right, on, how)


def join_required(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """A left join that fails the job on an unmatched row."""
    j = left.join(right.withColumn("_hit", F.lit(True)), list(on), "left")
    ok = F.when(F.col("_hit").isNull(), F.raise_error(F.lit("unmatched row"))).otherwise(True)
    return j.filter(ok).drop("_hit")


def outer_compare(a: DataFrame, b: DataFrame, on, fields, suffixes=("_dev", "_rep")) -> DataFrame:
    left = a.select(*on, *[F.col(f).alias(f + suffixes[0]) for f in fields])
    right = b.select(*on, *[F.col(f).alias(f + suffixes[1]) for f in fields])
    return left.join(right, list(on), "full_outer")


def asof_latest_closed(queries: DataFrame, states: DataFrame, step: int, ts: str = "T", state_ts: str = "T", how: str = "inner") -> DataFrame:
    """The last state at or before T and younger than one step: on a regular clock an equi-join."""
    s = states.withColumnRenamed(state_ts, "_stamp")
    q = queries.withColumn("_stamp", floor_to(F.col(ts), step))
    return q.join(s, ["symbol", "_stamp"], how).withColumnRenamed("_stamp", "source_timestamp")
