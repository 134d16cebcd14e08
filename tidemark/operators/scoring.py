"""Recency- and proximity-weighted scores per timeframe, combined score, history, percentile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DAY, SCORE_AGE_BANDS, Settings
from tidemark.functions.columns import age_days, age_weight, balance_state, count_if, proximity, ratio, sum_if
from tidemark.functions.ranks import prior_mass
from tidemark.operators.fullmap import active_map, near_map

KEYS = ("symbol", "tf", "T")


def score_detail(d: DataFrame, levels: DataFrame, tf: str, cfg: Settings, near_only: bool = False) -> DataFrame:
    """Every live level with age, proximity, age weight and contribution.

    ``near_only`` leaves out levels beyond the outer band: they contribute zero.
    """
    w, span = cfg.scoring.widths[tf], cfg.scoring.days * DAY
    a = near_map(d, levels, span, w, cfg.scoring.outer) if near_only else active_map(d, levels, span)
    age = age_days(F.col("T"), F.col("known_at"))
    a = a.withColumn("age_days", age).withColumn("proximity_weight", proximity(F.col("P"), F.col("price"), F.lit(w), cfg.scoring.outer))
    a = a.withColumn("age_weight", age_weight(F.col("age_days"), cfg))
    return a.withColumn("contribution", F.col("proximity_weight") * F.col("age_weight"))


def score_timeframe(d: DataFrame, levels: DataFrame, tf: str, cfg: Settings, near_only: bool = False) -> DataFrame:
    """Weighted support and resistance, normalised score, state; decisions without structure score 0."""
    s = F.col("kind") == "SUPPORT"
    p, c = F.col("proximity_weight"), F.col("contribution")
    g = score_detail(d, levels, tf, cfg, near_only).groupBy(*KEYS).agg(
        sum_if(s, c).alias("weighted_support"),
        sum_if(~s, c).alias("weighted_resistance"),
        count_if(s & (p > 0)).alias("raw_support_count"),
        count_if(~s & (p > 0)).alias("raw_resistance_count"),
        count_if(s).alias("map_support_count"),
        count_if(~s).alias("map_resistance_count"),
        F.sum(F.when(s, p).otherwise(-p)).alias("legacy_score"),
    )
    out = d.join(g, list(KEYS), "left").fillna(0)
    a, b = F.col("weighted_support"), F.col("weighted_resistance")
    norm = F.coalesce(ratio(a - b, a + b), F.lit(0.0))
    out = out.withColumn("normalized", norm).withColumn("available", a + b > 0).withColumn("weight", F.lit(cfg.scoring.weights[tf]))
    return out.withColumn("state", balance_state(F.col("normalized"), cfg)).withColumn("weighted_contribution", F.col("normalized") * F.col("weight"))


def age_buckets(detail: DataFrame) -> DataFrame:
    """Five age bands per decision: counts of all live levels and their weighted sums."""
    cuts = F.array(*[F.lit(float(x)) for x in (30, 90, 180, 365)])
    band = F.element_at(F.array(*[F.lit(x) for x in SCORE_AGE_BANDS]), F.size(F.filter(cuts, lambda x: x <= F.col("age_days"))) + 1)
    s = F.col("kind") == "SUPPORT"
    return detail.groupBy(*KEYS, band.alias("age")).agg(
        count_if(s).alias("support_count"), count_if(~s).alias("resistance_count"),
        sum_if(s, F.col("contribution")).alias("weighted_support"), sum_if(~s, F.col("contribution")).alias("weighted_resistance"),
    )


def combine(scores: DataFrame, cfg: Settings) -> DataFrame:
    """Weighted sum over timeframes, normalised by all weights; timeframes without structure are named."""
    total = sum(cfg.scoring.weights.values())
    g = scores.groupBy("symbol", "T").agg(
        F.sum("weighted_contribution").alias("combined_score"),
        F.sort_array(F.collect_list(F.when(~F.col("available"), F.col("tf")))).alias("no_structure"),
    )
    g = g.withColumn("combined_normalized", F.col("combined_score") / F.lit(total))
    return g.withColumn("state", balance_state(F.col("combined_normalized"), cfg))


def score_history(clock: DataFrame, levels: dict[str, DataFrame], cfg: Settings) -> DataFrame:
    """The combined score at every decision (symbol, T, P); only nearby levels are joined."""
    parts = [score_timeframe(clock.withColumn("tf", F.lit(tf)).select("symbol", "tf", "T", "P"), lev, tf, cfg, near_only=True) for tf, lev in levels.items()]
    return combine(reduce(lambda a, b: a.unionByName(b), parts), cfg)


def score_percentile(history: DataFrame, cfg: Settings, step: int, origin: int, value: str = "combined_normalized") -> DataFrame:
    """Directional midrank of each score among the earlier scores of its sign within the history window.

    The window is the difference of two prefixes, each answered by dyadic time blocks.
    """
    v = F.col(value)
    side = F.when(v > 0, "SUPPORT").when(v < 0, "RESISTANCE").otherwise("BALANCED")
    t = F.floor((F.col("T") - origin) / F.lit(step)).cast("long")
    d = history.select("symbol", "T", side.alias("direction"), F.abs(v).alias("v"), t.alias("slot"), v.alias("value"))
    live = d.filter("direction <> 'BALANCED'")
    s = live.select("symbol", "direction", "slot", "v", F.lit(1.0).alias("n"))
    q = live.select("symbol", "direction", F.struct("symbol", "T").alias("k"), "slot", "v")
    span = cfg.scoring.days * DAY // step
    both = q.select("symbol", "direction", "v", F.struct("k", F.lit(1).alias("sign")).alias("qid"), "slot").unionByName(
        q.select("symbol", "direction", "v", F.struct("k", F.lit(-1).alias("sign")).alias("qid"), (F.col("slot") - span).alias("slot"))
    )
    m = prior_mass(s, both, ["symbol", "direction"], ["n"])
    m = m.groupBy(F.col("qid.k.symbol").alias("symbol"), F.col("qid.k.T").alias("T")).agg(
        F.sum(F.col("n_mid") * F.col("qid.sign")).alias("mid"), F.round(F.sum(F.col("n_all") * F.col("qid.sign"))).cast("long").alias("sample_count")
    )
    p = F.when(F.col("sample_count") >= cfg.ranks.samples, 100 * F.col("mid") / F.col("sample_count"))
    out = d.join(m, ["symbol", "T"], "left").fillna(0, ["sample_count"]).withColumn("percentile", p)
    a, b, c = cfg.ranks.bands
    pc = F.col("percentile")
    label = F.when(pc >= c, "EXTREME").when(pc >= b, "STRONG").when(pc >= a, "ELEVATED").when(pc.isNotNull(), "NORMAL")
    status = F.when(F.col("direction") == "BALANCED", "BALANCED").when(pc.isNotNull(), "READY").otherwise("INSUFFICIENT_HISTORY")
    return out.withColumn("label", label).withColumn("status", status).drop("v", "slot", "mid")


def histogram(values: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Fixed bins on [-1, 1], the right edge closed, empty bins kept."""
    b = F.least(F.floor((F.col(value) + 1) * (bins / 2)), F.lit(bins - 1)).cast("long")
    got = values.filter(F.col(value).isNotNull()).groupBy("symbol", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = values.select("symbol").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")))
    return grid.join(got, ["symbol", "bin"], "left").fillna(0, ["count"])


def distribution_summary(values: DataFrame, value: str) -> DataFrame:
    """Count and quantiles of the signed values, the positives and the negatives' magnitude."""
    v = F.col(value)
    parts = {"signed": v, "positive": F.when(v > 0, v), "negative_magnitude": F.when(v < 0, -v)}
    g = values.groupBy("symbol").agg(*[F.count(x).alias(f"n_{k}") for k, x in parts.items()], *[F.percentile(x, [0.5, 0.75, 0.9, 0.95, 0.99]).alias(f"q_{k}") for k, x in parts.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col(f"n_{k}").alias("count"), F.col(f"q_{k}").alias("q")) for k in parts]))
    return g.select("symbol", rows.alias("r")).select("symbol", "r.*")


PRICE_TEXT = r"^[+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_prices(prices: DataFrame, column: str = "price_text") -> DataFrame:
    """Hypothetical prices from text; ``bad`` rows are non-decimal, non-finite or not positive."""
    text = F.trim(column)
    v = F.when(text.rlike(PRICE_TEXT), text.try_cast("double"))
    ok = v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))
    return prices.withColumn("price", F.when(ok, v)).withColumn("bad", ~F.coalesce(ok, F.lit(False)))


def what_if(d: DataFrame, prices: DataFrame, levels: DataFrame, tf: str, cfg: Settings) -> DataFrame:
    """Scores of decisions at hypothetical prices (symbol, T, price); closes and slopes stay as they are."""
    q = d.drop("P").join(prices.filter("not bad").select("symbol", "T", F.col("price").alias("P")).distinct(), ["symbol", "T"])
    q = q.select("symbol", "tf", F.struct("T", "P").alias("_id"), "T", "P")
    # Several prices share one T, so the price is part of the key.
    det = score_detail(q, levels, tf, cfg, near_only=True)
    s, c = F.col("kind") == "SUPPORT", F.col("contribution")
    g = det.groupBy("symbol", "tf", "T", "P").agg(sum_if(s, c).alias("a"), sum_if(~s, c).alias("b"))
    out = q.drop("_id").join(g, ["symbol", "tf", "T", "P"], "left").fillna(0.0, ["a", "b"])
    return out.select("symbol", "tf", "T", "P", F.coalesce(ratio(F.col("a") - F.col("b"), F.col("a") + F.col("b")), F.lit(0.0)).alias("normalized"))


