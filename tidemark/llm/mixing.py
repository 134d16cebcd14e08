"""Mixing sources to target weights by Efraimidis-Spirakis sampling, all in DataFrame functions.

A source of weight w may take w of the mix's words, but no more than ``MAX_EPOCHS`` times its own; what it cannot take is
shared anew by weight among the others, which sources in order of words a weight solve in one pass of sums.
A source takes all its documents as often as its target allows, and then documents in order of their exponential keys
-ln(u) / weight until the words are there. Every u is a hash of (id, text), so reruns and other engines take the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.order import placed
from tidemark.session import materialize

SHARES = (5, 2, 1)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
EXACT = "decimal(38,0)"


def uniform(id_col: Column, text: Column) -> Column:
    """52 bits of a hash as a number between 0 and 1, never one of them."""
    digest = F.sha2(F.concat(F.coalesce(id_col.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def label_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``quality_weight``: 2 if labelled good and not toxic, 0.5 if labelled otherwise, 1 without labels.
    Of several labels of an id the worst counts."""
    w = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 2.0).otherwise(0.5)
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("_label_id")).agg(F.min(w).alias("quality_weight"))
    # Null ids have no label: a key of their own spreads them. Labels grow with the documents: never broadcast.
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-"), F.rand(5).cast("string")))
    out = docs.drop("quality_weight").withColumn("_key", key).join(known.hint("merge"), F.col("_key") == F.col("_label_id"), "left")
    return out.withColumn("quality_weight", F.coalesce("quality_weight", F.lit(1.0))).drop("_key", "_label_id")


def targets(sources: DataFrame, shares=SHARES, most: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (``_source`` with nulls as their own, ``source_size``) with ``target``: shares by code point, repeating,
    null last, of all words; none above ``most`` times its words."""
    ranked = placed(sources, [], [F.asc_nulls_last("_source")])
    weighed = materialize(ranked.select("_source", "source_size", F.get(F.array(*map(F.lit, shares)), (F.col("_at") % len(shares)).cast("int")).cast("long").alias("_share")), "sources")
    total = weighed.agg(F.sum("source_size").alias("_all"), F.sum("_share").alias("_shares"))  # one row
    # By words a share: those at their limit come first, and each is judged by what the ones before it leave.
    line = placed(weighed.withColumn("_cap", most * F.col("source_size")), [], [F.col("source_size") / F.col("_share"), F.asc_nulls_last("_source")], {"_capped": "_cap", "_gone": "_share"})
    left, weight = F.col("_all") - F.col("_capped"), F.col("_shares") - F.col("_gone")
    line = line.crossJoin(F.broadcast(total)).withColumn("_full", F.col("_cap").cast(EXACT) * weight.cast("decimal(18,0)") <= F.col("_share").cast(EXACT) * left.cast("decimal(18,0)"))
    line = materialize(line.withColumns({"_left": left, "_weight": weight}), "line")
    rest = line.filter("not _full").agg(F.max(F.struct("_weight", "_left")).alias("_rest"))  # one row: what the first one below its limit finds
    share = F.col("_share") * F.col("_rest._left") / F.col("_rest._weight")
    return line.crossJoin(F.broadcast(rest)).select("_source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def measured(docs: DataFrame, keep=(), id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, u) and the columns of ``keep``: all that the mix needs of the documents, without their texts."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col), F.col(source).alias("source"), size.alias("size"), uniform(F.col(id_col), F.col(text)).alias("u"), *keep)


def mixed(rows: DataFrame, weight: str | None = None, shares=SHARES, most: int = MAX_EPOCHS, id_col: str = "doc_id") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken): how often the mix takes each of the ``measured`` documents, and its words.

    Every document is taken ``floor(target / source_size)`` times; those first in order of key are taken once more, up to
    the one whose middle the remaining budget reaches. Whole documents only, so a source misses its target by half a
    document at most, and none is taken more than ``most`` times. Null texts have no words and a null source is a source;
    null and repeated ids are rows like any other (of equal rows any may be the one taken once more). A null weight
    counts as 1, one that is not above zero puts the document behind all others. Other columns are not read.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    good = (w > 0) & ~F.isnan(w)
    rows = rows.select(
        F.col(id_col), F.col("source").alias("_source"), "size",
        (~good).alias("_late"), (-F.log("u") / F.when(good, w).otherwise(F.lit(1.0))).alias("_key"), F.rand(12).alias("_tie"),
    )
    rows = materialize(rows, "sizes")
    plan = targets(rows.groupBy("_source").agg(F.sum("size").alias("source_size")), shares, most)
    # Keys of joins and windows have no nulls: a name starts with "=".
    name = F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("-"))
    line = placed(rows.withColumn("_name", name), ["_name"], [F.col(c) for c in ("_late", "_key", "size", "_tie")], {"_before": "size"})
    out = line.join(plan.withColumn("_name", name).drop("_source"), "_name")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    more = (rest > 0) & (2 * F.col("_before") + F.col("size") <= 2 * rest)
    copies = (epochs + more.cast("long")).alias("copies")
    return out.select(id_col, F.col("_source").alias("source"), "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))
