"""Several timeframes side by side: alignment, sign patterns, zone overlap, repricing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import STEPS, TFS
from tidemark.functions.columns import classify_counts, interval_distance, sign_char
from tidemark.operators.flow import zone_unions
from tidemark.operators.fullmap import near_map, native_score, with_weight
from tidemark.operators.joins import asof_latest_closed

SIDES = ("support", "resistance")
SUBSETS = [s for n in range(1, len(TFS) + 1) for s in combinations(TFS, n)]


def band(price: Column, width: float) -> Column:
    return F.struct((price * (1 - width)).alias("lo"), (price * (1 + width)).alias("hi"))


def native_states(d: DataFrame, levels: DataFrame, lookback: int, width: float) -> DataFrame:
    """Score, nearby intervals and their union per decision, one row each.

    The interval arrays hold only levels within 1.5 widths of the price.
    """
    near = with_weight(near_map(d, levels, lookback, width), width).filter("weight > 0")
    score = native_score(d, near, width)
    keys = ["symbol", "tf", "T"]
    lists = near.groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("kind") == s.upper(), band(F.col("price"), width)))).alias(f"{s}_intervals") for s in SIDES]
    )
    u = zone_unions(near, width).filter("side <> 'joint'")
    unions = u.groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct(F.col("lower").alias("lo"), F.col("upper").alias("hi"))))).alias(f"{s}_union") for s in SIDES]
    )
    return score.join(lists, keys, "left").join(unions, keys, "left")


def align(clock: DataFrame, states: dict[str, DataFrame]) -> DataFrame:
    """Four native states at each decision of the fastest clock; no state older than one of its steps."""
    out = clock.select("symbol", "T", "P")
    for tf, s in states.items():
        keep = [c for c in s.columns if c not in ("symbol", "tf", "T", "as_of")]
        s = s.select("symbol", F.col("T").alias("_S"), *[F.col(c).alias(f"{tf}__{c}") for c in keep])
        out = asof_latest_closed(out, s, STEPS[tf], "T", "_S").withColumnRenamed("source_timestamp", f"{tf}__source_timestamp")
    return out


def pattern(prefix: str, tfs=TFS) -> Column:
    return F.concat(*[sign_char(F.col(f"`{tf}__{prefix}`")) for tf in tfs])


def sign_patterns(df: DataFrame, names=("imbalance", "A1", "A2")) -> DataFrame:
    for n in names:
        df = df.withColumn(f"{n}_pattern", pattern(n))
        for label, ch in (("support", "S"), ("resistance", "R"), ("neutral", "N"), ("missing", "M")):
            df = df.withColumn(f"{n}_{label}_count", F.regexp_count(f"{n}_pattern", F.lit(ch)).cast("long"))
    p = F.col("imbalance_pattern")
    return df.withColumn("conflict_pattern", F.concat(F.substring(p, 1, 2), F.lit("/"), F.substring(p, 3, 2)))


def intersect(a: Column, b: Column) -> Column:
    """Intersection of two arrays of disjoint closed intervals."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.greatest(x["lo"], y["lo"]).alias("lo"), F.least(x["hi"], y["hi"]).alias("hi")))))
    return F.filter(pairs, lambda z: z["lo"] <= z["hi"])


def zone_overlap(aligned: DataFrame) -> DataFrame:
    """Per side: which timeframe subsets share a price region, the largest count and every component.

    All work is inside the row: the arrays hold a handful of zones around the price.
    """
    for s in SIDES:
        none = F.array().cast("array<struct<lo:double,hi:double>>")
        for sub in SUBSETS:
            name = f"_{s}_{'+'.join(sub)}"
            last = F.coalesce(F.col(f"`{sub[-1]}__{s}_union`"), none)
            aligned = aligned.withColumn(name, last if len(sub) == 1 else intersect(F.col(f"`_{s}_{'+'.join(sub[:-1])}`"), last))
        region = lambda sub: F.col(f"`_{s}_{'+'.join(sub)}`")
        best = F.greatest(*[F.when(F.size(region(x)) > 0, len(x)).otherwise(0) for x in SUBSETS])
        aligned = aligned.withColumn(f"{s}_overlap_count", best.cast("long"))
        names = F.array_compact(F.array(*[F.when((F.size(region(x)) > 0) & (F.lit(len(x)) == F.col(f"{s}_overlap_count")), F.lit("+".join(x))) for x in SUBSETS]))
        aligned = aligned.withColumn(f"{s}_overlap_identities", F.array_join(names, "|"))
        for x in SUBSETS:
            aligned = aligned.withColumn(f"{s}_overlap_{'+'.join(x)}", F.size(region(x)) > 0)
    return aligned


def overlap_components(overlaps: DataFrame) -> DataFrame:
    """Long form: one row per common region with width, distance to price and participating zones."""
    rows = []
    none = F.array().cast("array<struct<lo:double,hi:double>>")
    for s in SIDES:
        for sub in SUBSETS:
            tfs = list(sub)
            count = lambda z: sum(
                (F.size(F.filter(F.coalesce(F.col(f"`{tf}__{s}_intervals`"), none), lambda i: (i["lo"] <= z["hi"]) & (i["hi"] >= z["lo"]))) for tf in tfs), F.lit(0)
            )
            region = F.col(f"`_{s}_{'+'.join(sub)}`")
            rows.append(
                F.transform(
                    region,
                    lambda z: F.struct(
                        F.lit(s).alias("side"), F.lit("+".join(tfs)).alias("combination"), F.lit(len(tfs)).cast("long").alias("timeframe_count"),
                        z["lo"].alias("lower"), z["hi"].alias("upper"), (z["hi"] - z["lo"]).alias("width"),
                        interval_distance(F.col("P"), z["lo"], z["hi"]).alias("price_distance"), count(z).cast("long").alias("candidate_interval_count"),
                    ),
                )
            )
    return overlaps.select("symbol", "T", "P", F.explode(F.flatten(F.array(*rows))).alias("c")).select("symbol", "T", "P", "c.*")


def reprice(clock: DataFrame, levels: dict[str, DataFrame], lookback: int, widths: dict) -> DataFrame:
    """Every timeframe's frozen level set scored at one common current price.

    The set is that of the last native close; only the price is current. Long form, one row
    per (T, tf) with counts, scores, state and nearest full-band flags.
    """
    out = None
    for tf, lev in levels.items():
        step = STEPS[tf]
        d = clock.select("symbol", F.lit(tf).alias("tf"), "T", "P", (F.col("T") - F.pmod("T", F.lit(step))).alias("as_of"))
        s = native_score(d, near_map(d, lev, lookback, widths[tf]), widths[tf])
        s = s.withColumn("state", classify_counts(F.col("support_count"), F.col("resistance_count")))
        out = s if out is None else out.unionByName(s)
    return out


def wide_states(repriced: DataFrame, tfs=TFS) -> DataFrame:
    """One row per T: pattern and the minimum, median and maximum of the absolute imbalances."""
    at = lambda tf, c: F.max(F.when(F.col("tf") == tf, F.col(c)))
    w = repriced.groupBy("symbol", "T", "P").agg(
        *[at(tf, "state").alias(f"{tf}__state") for tf in tfs], *[at(tf, "imbalance").alias(f"{tf}__imbalance") for tf in tfs], *[at(tf, "A1").alias(f"{tf}__A1") for tf in tfs]
    )
    w = w.withColumn("pattern", F.concat(*[F.coalesce(F.col(f"`{tf}__state`"), F.lit("M")) for tf in tfs]))
    v = F.sort_array(F.array(*[F.abs(F.col(f"`{tf}__imbalance`")) for tf in tfs]))
    whole = ~F.exists(v, lambda x: x.isNull())
    n = len(tfs)
    mid = (v[(n - 1) // 2] + v[n // 2]) / 2
    return (
        w.withColumn("strength_minimum", F.when(whole, v[0])).withColumn("strength_median", F.when(whole, mid)).withColumn("strength_maximum", F.when(whole, v[n - 1]))
    )


def shared_close_check(repriced: DataFrame, native: DataFrame) -> DataFrame:
    """At a native close with equal price the repriced row must equal the native one; rows that differ."""
    n = native.select("symbol", "tf", "T", F.col("P").alias("native_P"), F.col("A1").alias("native_A1"), F.col("A2").alias("native_A2"))
    j = repriced.filter(F.col("as_of") == F.col("T")).join(n, ["symbol", "tf", "T"])
    return j.filter((F.col("P") != F.col("native_P")) | (F.col("A1") != F.col("native_A1")) | (F.col("A2") != F.col("native_A2")))
