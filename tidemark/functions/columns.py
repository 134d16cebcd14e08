"""Column expressions shared by the operators. Everything here stays inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import DAY, WEEK, Settings


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def floor_to(ts: Column, step: int) -> Column:
    """Start of the step that holds ``ts`` (both milliseconds, integer arithmetic)."""
    return ts - F.pmod(ts, F.lit(step))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def r(c, places: int = 6) -> Column:
    """Half-away-from-zero rounding on the binary value, without negative zero.

    ``round`` works on decimal digits and differs from other engines at exact ties.
    """
    x = F.col(c) if isinstance(c, str) else c
    k = F.lit(float(10**places))
    return F.signum(x) * (F.floor(F.abs(x) * k + F.lit(0.5)) / k) + F.lit(0.0)


def known(c, name: str) -> Column:
    """Whole number for exchange: -1 where it is not available."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("long"), F.lit(-1)).alias(name)


# ---- calendar keys -------------------------------------------------------------------


def week_of(ts: Column) -> Column:
    return F.floor(ts / F.lit(WEEK)).cast("long")


def quarter_of(ts: Column) -> Column:
    t = F.timestamp_millis(ts)
    return F.concat(F.year(t).cast("string"), F.lit("-Q"), F.quarter(t).cast("string"))


def visit_group(n: Column) -> Column:
    return F.when(n < 4, n.cast("string")).otherwise("4+")


# ---- proximity -----------------------------------------------------------------------


def contribution(price: Column, current: Column, width: Column) -> Column:
    """Research rule: strict full band 1, half-open outer band 0.5, else 0."""
    up, down = price * (1 + width), price * (1 - width)
    up_outer = price * (1 + F.lit(1.5) * width)
    down_outer = price * (1 - F.lit(1.5) * width)
    return (
        F.when((current < up) & (current > down), 1.0)
        .when((current >= up) & (current < up_outer), 0.5)
        .when((current <= down) & (current > down_outer), 0.5)
        .otherwise(0.0)
    )


def proximity(price: Column, level: Column, width: Column, outer: float) -> Column:
    """Dashboard rule: inclusive bands on |P/p - 1| with a 1e-14 boundary slack."""
    d = F.abs(price / level - 1)
    slack = F.lit(1e-14)
    edge = width * F.lit(outer)
    return (
        F.when((d <= width) | (F.abs(d - width) <= slack), 1.0)
        .when((d <= edge) | (F.abs(d - edge) <= slack), 0.5)
        .otherwise(0.0)
    )


def age_weight(age_days: Column, cfg: Settings) -> Column:
    floor = cfg.scoring.least_weight
    return F.lit(floor) + F.lit(1 - floor) * F.pow(F.lit(0.5), age_days / F.lit(cfg.scoring.half_life))


def balance_state(value: Column, cfg: Settings) -> Column:
    return (
        F.when(value > cfg.scoring.balanced, "SUPPORT")
        .when(value < -cfg.scoring.balanced, "RESISTANCE")
        .otherwise("BALANCED")
    )


def sign_char(value: Column) -> Column:
    """S / R / N, and M for missing (null or NaN)."""
    return (
        F.when(value.isNull() | F.isnan(value), "M")
        .when(value > 0, "S")
        .when(value < 0, "R")
        .otherwise("N")
    )


def classify_counts(s: Column, r_: Column, available: Column | None = None) -> Column:
    empty = (s + r_) == 0
    if available is not None:
        empty = empty | ~available
    return F.when(empty, "M").when(s > r_, "S").when(r_ > s, "R").otherwise("N")


# ---- buckets -------------------------------------------------------------------------


def bucket_right(value: Column, cuts: Column) -> Column:
    """Number of cuts <= value; -1 for missing."""
    ok = value.isNotNull() & ~F.isnan(value)
    return F.when(ok, F.size(F.filter(cuts, lambda c: c <= value))).otherwise(-1).cast("long")


def bucket_left(value: Column, cuts: Column) -> Column:
    """Number of cuts < value; -1 for missing."""
    ok = value.isNotNull() & ~F.isnan(value)
    return F.when(ok, F.size(F.filter(cuts, lambda c: c < value))).otherwise(-1).cast("long")


def quantile_label(value: Column, cuts: Column) -> Column:
    """MISSING or Q1..Qn, values on a cut belong to the upper group."""
    b = bucket_right(value, cuts)
    return F.when(b < 0, "MISSING").otherwise(F.concat(F.lit("Q"), (b + 1).cast("string")))


def percent_bucket(p: Column, groups: int) -> Column:
    """0..1 percentile into 1..groups, the top edge closed; 0 for missing."""
    return (
        F.when(p.isNull(), 0)
        .otherwise(F.least(F.floor(p * groups) + 1, F.lit(groups)))
        .cast("long")
    )


def sign_bucket(v: Column, eps: float = 0.01) -> Column:
    return (
        F.when(v.isNull(), -1).when(v < -eps, 0).when(v > eps, 2).otherwise(1).cast("long")
    )


def shape_bucket(v: Column, positive_cut: Column, eps: float = 0.01) -> Column:
    s = sign_bucket(v, eps)
    return F.when((s == 2) & (v > positive_cut), 3).otherwise(s).cast("long")


def normalized_delta(buy: Column, sell: Column, quantity: Column) -> Column:
    return F.when(quantity > 0, (buy - sell) / quantity)


def interval_distance(price: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - price, F.lit(0.0), price - high)


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds)


def age_days(t: Column, since: Column) -> Column:
    return (t - since) / F.lit(DAY)


def content_id(*cols) -> Column:
    """Row identity: sha256 over the parts, nulls kept as a visible mark."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("~")) for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)
