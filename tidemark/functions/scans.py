"""Ordered computations that never put a whole series into one task.

A window partitioned only by symbol would run in one task however long the series is.
``halo`` cuts a series into index chunks and repeats the few rows each chunk needs from
its neighbours; ``running`` and ``previous_row`` combine chunk-local windows with a small
table of one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def halo(df: DataFrame, idx: str, before: int = 0, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Add ``_c`` (chunk) and ``_own``; each row also appears in the chunks that look at it.

    A frame that reaches ``before`` index steps back and ``after`` forward is complete for
    every row with ``_own`` when the window is partitioned by the series key and ``_c``.
    """
    i = F.col(idx)
    first = F.floor((i - after) / F.lit(chunk))
    last = F.floor((i + before) / F.lit(chunk))
    return df.withColumn("_c", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col("_c") == F.floor(i / F.lit(chunk))
    )


def own(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_c", "_own")


def series(keys, idx: str):
    return Window.partitionBy(*keys, "_c").orderBy(idx)


def previous_row(
    df: DataFrame, keys, order, chunk: Column, cols, into: str = "prev"
) -> DataFrame:
    """Struct of the previous row's ``cols`` in ``order`` (a list), exact across chunks.

    ``chunk`` must not decrease along ``order``. Inside a chunk it is ``lag``; the first
    row of a chunk takes the last row of the nearest earlier chunk from a one-row-per-chunk
    table. That table is small enough for a window per key.
    """
    keys = list(keys)
    d = df.withColumn("_c", chunk).withColumn("_v", F.struct(*cols))
    local = Window.partitionBy(*keys, "_c").orderBy(*order)
    tails = d.groupBy(*keys, "_c").agg(
        F.max(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col("_v"))).alias("_t")
    )
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_c")
    tails = tails.select(*keys, "_c", F.lag("_t._v").over(w).alias("_tail"))
    d = d.withColumn("_l", F.lag("_v").over(local))
    return (
        d.join(tails, keys + ["_c"], "left")
        .withColumn(into, F.coalesce(F.col("_l"), F.col("_tail")))
        .drop("_c", "_v", "_l", "_tail")
    )


def running(df: DataFrame, keys, order, chunk: Column, sums: dict, inclusive: bool = True) -> DataFrame:
    """Running sums ``{new_column: expression}`` along ``order``, exact across chunks."""
    keys = list(keys)
    d = df.withColumn("_c", chunk)
    for name, e in sums.items():
        d = d.withColumn(f"_x_{name}", e)
    local = Window.partitionBy(*keys, "_c").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    totals = d.groupBy(*keys, "_c").agg(*[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in sums])
    before = (
        (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
        .orderBy("_c")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = totals.select(
        *keys, "_c", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    d = d.join(totals, keys + ["_c"], "left")
    for n in sums:
        d = d.withColumn(n, F.coalesce(F.sum(f"_x_{n}").over(local), F.lit(0)) + F.col(f"_b_{n}"))
    return d.drop("_c", *[f"_x_{n}" for n in sums], *[f"_b_{n}" for n in sums])
