"""The map of all live levels at a decision: scores, counts, geometry, contacts.

A decision row has symbol, tf, T (time), P (price) and optionally ``as_of`` (the native close
whose level set is used; T if absent). A level is live while ``known_at <= as_of`` and
``dependency_start >= as_of - lookback``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import AGE_BAND_HOURS, AGE_BANDS, HOUR
from tidemark.functions.columns import contribution, count_if, ratio
from tidemark.operators.visits import meets, with_neighbours

KEYS = ("symbol", "tf", "T")
LEVEL = ("symbol", "tf", "candidate_id", "kind", "price", "source_timestamp", "known_at", "dependency_start")


def decisions(candles: DataFrame, since: int | None = None) -> DataFrame:
    d = candles.select("symbol", "tf", F.col("end").alias("T"), F.col("close").alias("P"))
    return d if since is None else d.filter(F.col("T") >= since)


def _blocked(d: DataFrame, levels: DataFrame, lookback: int):
    """Time blocks of a sixteenth of the lookback turn 'live at T' into an equi-join."""
    size = max(lookback // 16, 1)
    if "as_of" not in d.columns:
        d = d.withColumn("as_of", F.col("T"))
    d = d.withColumn("_b", F.floor(F.col("as_of") / F.lit(size)))
    l = levels.select(*LEVEL).filter(F.col("known_at") <= F.col("dependency_start") + lookback)
    last = F.floor((F.col("dependency_start") + lookback) / F.lit(size))
    l = l.withColumn("_b", F.explode(F.sequence(F.floor(F.col("known_at") / F.lit(size)), last)))
    return d, l


def _live(lookback: int) -> Column:
    return (F.col("known_at") <= F.col("as_of")) & (F.col("dependency_start") >= F.col("as_of") - lookback)


def active_map(d: DataFrame, levels: DataFrame, lookback: int) -> DataFrame:
    """Every live level of every decision."""
    d, l = _blocked(d, levels, lookback)
    return d.join(l, ["symbol", "tf", "_b"]).filter(_live(lookback)).drop("_b")


def near_map(d: DataFrame, levels: DataFrame, lookback: int, width: float, reach: float = 1.5) -> DataFrame:
    """Live levels within ``reach`` widths of P, found through price buckets as well as time blocks."""
    size = -math.log(1 - reach * width) * 1.001  # |ln P - ln p| of a near level is below one bucket
    d, l = _blocked(d, levels, lookback)
    home = F.floor(F.log("P") / F.lit(size))
    d = d.withColumn("_p", F.explode(F.array(home - 1, home, home + 1)))
    l = l.withColumn("_p", F.floor(F.log("price") / F.lit(size)))
    j = d.join(l, ["symbol", "tf", "_b", "_p"]).filter(_live(lookback)).drop("_b", "_p")
    return j.filter(F.abs(F.col("P") / F.col("price") - 1) <= reach * width + 1e-12)


def with_weight(pairs: DataFrame, width: float) -> DataFrame:
    return pairs.withColumn("weight", contribution(F.col("price"), F.col("P"), F.lit(width)))


def contributions(near: DataFrame, width: float) -> DataFrame:
    sign = F.when(F.col("kind") == "SUPPORT", 1.0).otherwise(-1.0)
    d = with_weight(near, width).filter("weight > 0")
    return d.withColumn("long_contribution", sign * F.col("weight")).withColumn("short_contribution", -sign * F.col("weight"))


def native_score(d: DataFrame, near: DataFrame, width: float) -> DataFrame:
    """Long and short score, full-weight-only score and the four counts; decisions without levels stay."""
    s = F.col("kind") == "SUPPORT"
    full, half = F.col("weight") == 1.0, F.col("weight") == 0.5
    g = with_weight(near, width).groupBy(*KEYS).agg(
        count_if(s & full).alias("full_support"),
        count_if(~s & full).alias("full_resistance"),
        count_if(s & half).alias("half_support"),
        count_if(~s & half).alias("half_resistance"),
    )
    out = d.join(g, list(KEYS), "left").fillna(0, ["full_support", "full_resistance", "half_support", "half_resistance"])
    fs, fr, hs, hr = (F.col(c) for c in ("full_support", "full_resistance", "half_support", "half_resistance"))
    out = (
        out.withColumn("support_count", fs + hs)
        .withColumn("resistance_count", fr + hr)
        .withColumn("A2", (fs - fr).cast("double"))
        .withColumn("A1", (fs - fr) + 0.5 * (hs - hr))
    )
    sc, rc = F.col("support_count"), F.col("resistance_count")
    return out.withColumn("short_score", F.lit(0.0) - F.col("A1")).withColumn("imbalance", ratio(sc - rc, sc + rc))


def raw_map(active: DataFrame, width: float) -> DataFrame:
    """Per side: total, above, below, near, five distance rings, nearest level, mean distance; ages nearby."""
    d = with_weight(active, width)
    p, P, w = F.col("price"), F.col("P"), F.col("weight")
    dist = F.abs(P / p - 1)
    gap = F.abs(p / P - 1)
    age = (F.col("T") - F.col("source_timestamp")) / HOUR
    aggs = []
    for side in ("SUPPORT", "RESISTANCE"):
        n, on = side.lower(), F.col("kind") == side
        rings = {
            "inner": w == 1.0,
            "outer": w == 0.5,
            "to_three": (w == 0) & (dist < 3 * width),
            "to_ten": (w == 0) & (dist >= 3 * width) & (dist < 10 * width),
            "beyond_ten": (w == 0) & (dist >= 10 * width),
        }
        aggs += [
            count_if(on).alias(f"{n}_total"),
            count_if(on & (w != 1.0) & (p > P)).alias(f"{n}_above"),
            count_if(on & (w != 1.0) & (p <= P)).alias(f"{n}_below"),
            count_if(on & (w == 1.0)).alias(f"{n}_near"),
            *[count_if(on & c).alias(f"{n}_density_{k}") for k, c in rings.items()],
            F.min(
                F.when(on, F.struct(F.abs(p - P).alias("d"), F.col("known_at").alias("k"), F.col("source_timestamp").alias("s"), p.alias("p"), F.col("candidate_id").alias("id")))
            ).alias(f"{n}_nearest"),
            F.avg(F.when(on, gap)).alias(f"{n}_mean_distance"),
        ]
    near_age = F.when(w > 0, age)
    aggs += [
        F.min(near_age).alias("age_min"),
        F.percentile(near_age, 0.5).alias("age_median"),
        F.avg(near_age).alias("age_mean"),
        F.max(near_age).alias("age_max"),
    ]
    return d.groupBy(*KEYS, "P").agg(*aggs)


def nearest_level(active: DataFrame) -> DataFrame:
    """Nearest level per side; ties by known_at, source time, price."""
    d = active.groupBy(*KEYS, "P", "kind").agg(
        F.min(F.struct(F.abs(F.col("price") - F.col("P")).alias("d"), "known_at", "source_timestamp", "price", "candidate_id")).alias("n")
    )
    return d.select(*KEYS, "P", "kind", "n.price", "n.known_at", "n.candidate_id", (F.col("n.price") / F.col("P") - 1).alias("signed_distance"))


def clusters(active: DataFrame, width: float) -> DataFrame:
    """Connected groups of overlapping bands, overlapping pairs and repeated prices per decision.

    Bands sorted by price have sorted ends, so the pairs of a band are the earlier bands whose
    end is not below its start: one running count, no pair is ever written out.
    """
    a = active.select(*KEYS, "price", (F.col("price") * (1 - width)).alias("lo"), (F.col("price") * (1 + width)).alias("hi"))
    by = Window.partitionBy(*KEYS).orderBy("price")
    g = a.withColumn("_new", F.when(F.lag("hi").over(by).isNull() | (F.col("lo") > F.lag("hi").over(by)), 1).otherwise(0))
    groups = g.groupBy(*KEYS).agg(
        F.sum("_new").alias("cluster_count"), F.count(F.lit(1)).alias("levels"), (F.count(F.lit(1)) - F.count_distinct("price")).alias("duplicate_price_count")
    )
    # Every start asks how many ends lie strictly before it; equal ends come after the question.
    ends = a.select(*KEYS, F.col("hi").alias("x"), F.lit(1).alias("o"), F.lit(1).alias("end"))
    asks = a.select(*KEYS, F.col("lo").alias("x"), F.lit(0).alias("o"), F.lit(0).alias("end"))
    run = Window.partitionBy(*KEYS).orderBy("x", "o").rowsBetween(Window.unboundedPreceding, 0)
    before = ends.unionByName(asks).withColumn("n", F.sum("end").over(run)).filter("o = 0").groupBy(*KEYS).agg(F.sum("n").alias("_before"))
    n = F.col("levels")
    pairs = (n * (n - 1) / 2).cast("long") - F.col("_before")
    return groups.join(before, list(KEYS)).withColumn("overlap_pair_count", pairs).withColumn("levels_per_cluster", n / F.col("cluster_count")).drop("_before")


def normalized_state(score: DataFrame, raw: DataFrame, cluster: DataFrame) -> DataFrame:
    j = score.select(*KEYS, "P", "A1", "A2", "imbalance", F.col("support_count").alias("nearby_support_count"), F.col("resistance_count").alias("nearby_resistance_count"))
    j = j.join(raw.drop("P"), list(KEYS), "left").join(cluster, list(KEYS), "left")
    s, r_ = F.coalesce("support_total", F.lit(0)), F.coalesce("resistance_total", F.lit(0))
    return j.withColumn("full_map_imbalance", ratio(s - r_, s + r_)).withColumn(
        "nearby_count", F.col("nearby_support_count") + F.col("nearby_resistance_count")
    )


def membership(active: DataFrame) -> DataFrame:
    return active.select(*KEYS, "candidate_id")


def membership_delta(levels: DataFrame, d: DataFrame, lookback: int, step: int) -> DataFrame:
    """Rows added to and removed from the live set at each decision of a gap-free clock.

    A level enters at the first decision at or after ``known_at`` and leaves at the first one
    after ``dependency_start + lookback``: computed from the level alone, no set is compared.
    """
    up = lambda t: -F.floor(-t / F.lit(step)) * step
    enter = up(F.col("known_at"))
    leave = (F.floor((F.col("dependency_start") + lookback) / F.lit(step)) + 1) * step
    l = levels.select("symbol", "tf", "candidate_id", enter.alias("_in"), leave.alias("_out")).filter("_in < _out")
    moves = l.select("symbol", "tf", "candidate_id", F.explode(F.array(F.struct(F.col("_in").alias("T"), F.lit(1).alias("delta")), F.struct(F.col("_out").alias("T"), F.lit(-1).alias("delta")))).alias("m"))
    moves = moves.select("symbol", "tf", "candidate_id", F.col("m.T").cast("long").alias("T"), F.col("m.delta").alias("delta"))
    bounds = d.groupBy("symbol", "tf").agg(F.min("T").alias("_t0"), F.max("T").alias("_t1"))
    # Moves before the first decision are its opening set.
    m = moves.join(bounds, ["symbol", "tf"]).filter(F.col("T") <= F.col("_t1")).withColumn("T", F.greatest("T", "_t0"))
    return m.groupBy("symbol", "tf", "T", "candidate_id").agg(F.sum("delta").alias("delta")).filter("delta <> 0")


def membership_restore(deltas: DataFrame, d: DataFrame, block: int) -> DataFrame:
    """The live set at every decision again: add-minus-remove counts to validity spans, spans to decisions."""
    w = Window.partitionBy("symbol", "tf", "candidate_id").orderBy("T")  # two rows per level
    end = F.coalesce(F.lead("T").over(w), F.lit(9_000_000_000_000_000))
    spans = deltas.withColumn("_n", F.sum("delta").over(w)).withColumn("_to", end).filter("_n > 0")
    last = d.groupBy("symbol", "tf").agg(F.max("T").alias("_t1"))
    spans = spans.join(last, ["symbol", "tf"]).select("symbol", "tf", "candidate_id", F.col("T").alias("_from"), F.least("_to", F.col("_t1") + 1).alias("_to"))
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / F.lit(block)), F.floor((F.col("_to") - 1) / F.lit(block)))))
    q = d.select(*KEYS).withColumn("_b", F.floor(F.col("T") / F.lit(block)))
    return q.join(spans, ["symbol", "tf", "_b"]).filter((F.col("T") >= F.col("_from")) & (F.col("T") < F.col("_to"))).select(*KEYS, "candidate_id")


def contacts(levels: DataFrame, candles: DataFrame, size: float = 0.01) -> DataFrame:
    """Bars after ``known_at`` that cross or touch a level, with ``crossed`` and ``visit_start``.

    Crossing is strict on closes (equality is none); a visit starts where a run of touching
    bars starts.
    """
    c = with_neighbours(candles)
    hull = c.withColumn("_l", F.col("low")).withColumn("_h", F.col("high"))
    hull = hull.withColumn("low", F.least("_l", "prev_close")).withColumn("high", F.greatest("_h", "prev_close"))
    z = levels.select("candidate_id", "symbol", "tf", F.col("price").alias("level"), "known_at")
    j = meets(z, hull, F.col("level"), F.col("level"), size)
    p, a, b = F.col("level"), F.col("prev_close"), F.col("close")
    j = j.withColumn("crossed", ((a < p) & (b > p)) | ((a > p) & (b < p))).withColumn("touch", (F.col("_l") <= p) & (F.col("_h") >= p))
    j = j.filter("crossed or touch")
    w = Window.partitionBy("candidate_id").orderBy("idx")
    again = F.coalesce(F.lag("touch").over(w) & (F.lag("idx").over(w) == F.col("idx") - 1), F.lit(False))
    return j.withColumn("visit_start", F.col("touch") & ~again).select("candidate_id", "end", "crossed", "touch", "visit_start")


def crossings(pairs: DataFrame, contact: DataFrame) -> DataFrame:
    """Crossings, visits and last contact of each (decision, level) pair, as of the decision.

    Contacts and questions of a level are sorted together; running sums give the answers.
    """
    ev = contact.select(
        "candidate_id", F.col("end").alias("_t"), F.lit(0).alias("_o"), F.col("crossed").cast("long").alias("x"),
        F.col("visit_start").cast("long").alias("v"), F.when(F.col("touch"), F.col("end")).alias("last"), F.lit(None).cast("long").alias("T"),
    )
    ask = pairs.select("candidate_id", F.col("T").alias("_t"), F.lit(1).alias("_o"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("v"), F.lit(None).cast("long").alias("last"), "T")
    w = Window.partitionBy("candidate_id").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    d = ev.unionByName(ask.distinct())
    d = d.select("candidate_id", "T", "_o", F.sum("x").over(w).alias("crossings"), F.sum("v").over(w).alias("visits"), F.max("last").over(w).alias("_last"))
    d = d.filter("_o = 1").withColumn("hours_since_contact", (F.col("T") - F.col("_last")) / HOUR)
    return pairs.join(d.drop("_o", "_last"), ["candidate_id", "T"])


def age_bands(pairs: DataFrame) -> DataFrame:
    """Near levels by age band: counts by side, mean crossings and visits."""
    age = (F.col("T") - F.col("source_timestamp")) / HOUR
    band = F.size(F.filter(F.array(*[F.lit(float(b)) for b in AGE_BAND_HOURS]), lambda b: b < F.col("_age")))
    d = pairs.withColumn("_age", age)
    name = F.element_at(F.array(*[F.lit(n) for n in AGE_BANDS]), band + 1)
    return d.withColumn("age_band", name).groupBy(*KEYS, "age_band").agg(
        F.count(F.lit(1)).alias("count"),
        count_if(F.col("kind") == "SUPPORT").alias("support"),
        count_if(F.col("kind") == "RESISTANCE").alias("resistance"),
        F.avg("crossings").alias("mean_crossings"),
        F.avg("visits").alias("mean_visits"),
    )
