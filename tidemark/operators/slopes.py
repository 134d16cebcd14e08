"""Slope of price since the last confirmed swing and its place in past slopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DAY, Settings
from tidemark.functions.ranks import prior_mass
from tidemark.functions.scans import halo, own
from tidemark.operators.detectors import swing_sources

SERIES = ("symbol", "tf", "side")


def slope_stream(candles: DataFrame, n: int) -> DataFrame:
    """log(close / swing price) per bar since the swing, for both sides."""
    s = swing_sources(candles, n).filter("swing is not null")
    d = s.withColumn("slope", F.log(F.col("close") / F.col("swing.price")) / (F.col("idx") - F.col("swing.idx")))
    way = F.when(F.col("slope") > 0, "UPWARD_STRETCH").when(F.col("slope") < 0, "DOWNWARD_STRETCH").otherwise("FLAT")
    return d.withColumn("swing_n", F.lit(n)).withColumn("T", F.col("end")).withColumn("direction", way)


def slope_percentile(stream: DataFrame, cfg: Settings, step: int, origin: int) -> DataFrame:
    """0..100 midrank of the magnitude among earlier slopes of the same side and direction in the window."""
    t = F.floor((F.col("T") - origin) / F.lit(step)).cast("long")
    live = stream.filter("direction <> 'FLAT'").select(*SERIES, "direction", "T", t.alias("slot"), F.abs("slope").alias("v"))
    keys = [*SERIES, "direction"]
    span = cfg.slopes.days * DAY // step
    ask = lambda sign, at: live.select(*keys, "v", F.struct(*SERIES, "T", F.lit(sign).alias("sign")).alias("qid"), at.alias("slot"))
    q = ask(1, F.col("slot")).unionByName(ask(-1, F.col("slot") - span))
    m = prior_mass(live.select(*keys, "slot", "v", F.lit(1.0).alias("n")), q, keys, ["n"], band=0.0005)
    sign = F.col("qid.sign")
    m = m.groupBy(*[F.col(f"qid.{k}").alias(k) for k in (*SERIES, "T")]).agg(
        F.sum(F.col("n_mid") * sign).alias("_mid"), F.round(F.sum(F.col("n_all") * sign)).cast("long").alias("sample_count")
    )
    p = F.when(F.col("sample_count") >= cfg.ranks.samples, 100 * F.col("_mid") / F.col("sample_count"))
    return stream.join(m, [*SERIES, "T"], "left").fillna(0, ["sample_count"]).withColumn("percentile", p).drop("_mid")


def slope_velocity(points: DataFrame) -> DataFrame:
    """First and second difference of the percentile; null across a new swing, a sign change or a null."""
    w = Window.partitionBy(*SERIES, "_c").orderBy("idx")
    d = halo(points, "idx", before=2).withColumn("_k", F.struct("idx", "swing", "direction", "percentile"))

    def diff(a, b):
        same = (a["idx"] == b["idx"] + 1) & (a["swing"]["idx"] == b["swing"]["idx"]) & (a["direction"] == b["direction"])
        return F.when(same, a["percentile"] - b["percentile"])

    one, two = F.lag("_k", 1).over(w), F.lag("_k", 2).over(w)
    d = d.withColumn("_1", one).withColumn("_2", two)
    # The point two bars back must hang on the current swing as well.
    prior = F.when(F.col("_2.swing.idx") == F.col("swing.idx"), diff(F.col("_1"), F.col("_2")))
    d = d.withColumn("velocity", diff(F.col("_k"), F.col("_1"))).withColumn("acceleration", F.col("velocity") - prior)
    return own(d.drop("_k", "_1", "_2"))


def slope_state(stream: DataFrame, points: DataFrame, cfg: Settings) -> DataFrame:
    """State, ratio to the median and quantiles of the samples, for the decisions in ``points``.

    Quantiles need the samples themselves, so every decision meets its window once: ask for
    the decisions needed (the live report asks for the latest), not for a whole history.
    """
    span = cfg.slopes.days * DAY
    size = max(span // 8, 1)
    s = stream.filter("direction <> 'FLAT'").select(*SERIES, "direction", F.col("T").alias("_t"), F.abs("slope").alias("_v"), F.floor(F.col("T") / F.lit(size)).alias("_b"))
    q = points.select(*SERIES, "direction", "T", "slope", "percentile", "sample_count")
    blocks = F.sequence(F.floor((F.col("T") - span) / F.lit(size)), F.floor(F.col("T") / F.lit(size)))
    j = q.withColumn("_b", F.explode(blocks)).join(s, [*SERIES, "direction", "_b"]).filter((F.col("_t") < F.col("T")) & (F.col("_t") >= F.col("T") - span))
    g = j.groupBy(*SERIES, "T").agg(F.percentile("_v", [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]).alias("quantiles"))
    d = q.join(g, [*SERIES, "T"], "left")
    a, b, c = cfg.ranks.bands
    p = F.col("percentile")
    state = (
        F.when(F.col("direction") == "FLAT", "FLAT").when(p.isNull(), "INSUFFICIENT_HISTORY").when(p >= c, "EXTREME").when(p >= b, "STRETCHED").when(p >= a, "ELEVATED").otherwise("NORMAL")
    )
    med = F.when(p.isNotNull(), F.col("quantiles")[1])
    return d.withColumn("state", state).withColumn("historical_median", med).withColumn("stretch_ratio", F.when(med > 0, F.abs("slope") / med))


def entries(points: DataFrame, cfg: Settings) -> DataFrame:
    """Points that enter the top band: at or above it now, and not in the bar before on the same swing."""
    top = cfg.ranks.bands[-1]
    w = Window.partitionBy(*SERIES, "_c").orderBy("idx")
    d = halo(points, "idx", before=1).withColumn("_p", F.lag(F.struct("idx", "swing", "percentile")).over(w))
    was = (F.col("_p.idx") == F.col("idx") - 1) & (F.col("_p.swing.idx") == F.col("swing.idx")) & (F.col("_p.percentile") >= top)
    return own(d.filter((F.col("percentile") >= top) & ~F.coalesce(was, F.lit(False))).drop("_p"))


def diagnostics(points: DataFrame, candles: DataFrame, cfg: Settings) -> DataFrame:
    """What became of each entry h bars later, measured from the entry's own swing."""
    e = entries(points, cfg).select(*SERIES, "idx", "T", "slope", "swing")
    h = e.withColumn("horizon", F.explode(F.array(*[F.lit(x).cast("long") for x in cfg.slopes.horizons])))
    later = candles.select("symbol", "tf", (F.col("idx")).alias("_i"), F.col("close").alias("_close"))
    j = h.withColumn("_i", F.col("idx") + F.col("horizon")).join(later, ["symbol", "tf", "_i"], "left")
    s = F.log(F.col("_close") / F.col("swing.price")) / (F.col("_i") - F.col("swing.idx"))
    j = j.withColumn("later_slope", s)
    status = F.when(F.col("_close").isNull(), "PENDING").when(s * F.signum("slope") > 0, "OBSERVED").otherwise("DIRECTION_CHANGED")
    return j.withColumn("status", status).drop("_i", "_close")


def last_points(points: DataFrame, n: int) -> DataFrame:
    """The newest n points of every series, found by grid index (a bounded window per series)."""
    newest = points.groupBy(*SERIES).agg(F.max("idx").alias("_max"))
    recent = points.join(newest, list(SERIES)).filter(F.col("idx") > F.col("_max") - n).drop("_max")
    return recent


def describe_text(combined_state, tf_state, direction):
    move = F.when(direction == "UPWARD_STRETCH", "UP").when(direction == "DOWNWARD_STRETCH", "DOWN").otherwise("FLAT")
    return F.concat(combined_state, F.lit(" + "), tf_state, F.lit(" "), move)
