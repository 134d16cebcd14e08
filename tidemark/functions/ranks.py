"""Rank of a value among earlier values, for every row, without comparing all pairs of rows.

Time is split into dyadic blocks. The rows before time t fall into one block per set bit of
t, so each row is a source in, and asks, at most as many blocks as the largest time has bits.
Inside a block one running sum over the values answers all questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scans import running

FAR = 9e18


def prior_mass(sources: DataFrame, queries: DataFrame, keys, weights, band: float = 0.01) -> DataFrame:
    """``sources``: keys, slot, v, weights; ``queries``: keys, qid, slot, v (slot: any whole number).

    For each qid and weight: ``<w>_mid`` (mass below v plus half the mass at v) and
    ``<w>_all`` over the sources with an earlier slot. Slots count from the least one, and there
    are as many levels as the largest needs. Equal questions are answered once, and the mass of
    a whole block is a plain sum, not part of the running one.
    """
    keys = list(keys)
    asked = queries.select(*keys, "slot", "v").distinct()
    both = sources.select("slot").unionByName(queries.select("slot"))
    span = F.broadcast(both.agg(F.min("slot").cast("long").alias("_low"), F.max("slot").cast("long").alias("_high")))  # one row
    slot = F.col("slot") - F.col("_low")
    levels = F.sequence(F.lit(0), F.length(F.bin(F.col("_high") - F.col("_low"))).cast("int") - 1)
    bit = lambda l: F.pmod(F.call_function("shiftright", slot, l), F.lit(2))
    node = F.call_function("shiftright", slot, F.col("_l"))
    s = sources.crossJoin(span).withColumn("_l", F.explode(F.filter(levels, lambda l: bit(l) == 0)))
    s = s.groupBy(*keys, "_l", node.alias("_n"), "v").agg(*[F.sum(w).cast("double").alias(w) for w in weights])
    q = asked.crossJoin(span).withColumn("_l", F.explode(F.filter(levels, lambda l: bit(l) == 1)))
    q = q.select(*keys, "slot", "v", "_l", (node - 1).alias("_n"))

    chunk = F.floor(F.least(F.greatest(F.col("v") / F.lit(band), F.lit(-FAR)), F.lit(FAR)))
    blocks = s.groupBy(*keys, "_l", "_n").agg(*[F.sum(w).alias(f"{w}_all") for w in weights])
    every = q.join(blocks, [*keys, "_l", "_n"]).groupBy(*keys, "slot", "v").agg(*[F.sum(f"{w}_all").alias(f"{w}_all") for w in weights])

    # Equal values asked in one block by later slots are one question, too.
    points = q.select(*keys, "_l", "_n", "v").distinct().withColumn("_o", F.explode(F.array(F.lit(0), F.lit(2))))
    for w in weights:
        points = points.withColumn(w, F.lit(0.0))
    rows = s.withColumn("_o", F.lit(1)).unionByName(points)
    acc = running(rows, [*keys, "_l", "_n"], ["v", "_o"], chunk, {f"c_{w}": F.col(w) for w in weights}).filter("_o <> 1")
    mids = acc.groupBy(*keys, "_l", "_n", "v").agg(*[(F.sum(f"c_{w}") / 2).alias(f"{w}_mid") for w in weights])
    mids = _same(q, mids, [*keys, "_l", "_n", "v"]).groupBy(*keys, "slot", "v").agg(*[F.sum(f"{w}_mid").alias(f"{w}_mid") for w in weights])

    out = queries.select(*keys, "slot", "v", "qid")
    for part in (mids, every):
        out = _same(out, part, [*keys, "slot", "v"], "left")
    names = [f"{w}_{x}" for w in weights for x in ("mid", "all")]
    return out.filter(F.col(f"{weights[0]}_all").isNotNull()).select("qid", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def _same(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join in which nulls are equal; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"_r_{k}"])
        on = same if on is None else on & same
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def midrank(mid: Column, total: Column) -> Column:
    return F.when(total > 0, mid / total)
