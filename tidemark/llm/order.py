"""Places and running sums along an order, for keys of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize


def placed(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``_at`` (place within its key along ``order``, from 0), ``_rows`` (rows of its key) and, for
    ``{new: column}`` of ``sums``, the sum over the rows before it.

    Rows are dealt by ranges of (keys, order), so that a hot key lies in many slices; slices meet in a table of one row
    for each slice and key. ``rows`` is read twice and should be a written table; keys have no nulls; rows
    that tie in ``order`` need a column that tells them apart for all of it to be one order.
    """
    sums = sums or {}
    sliced = materialize(rows.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    local = Window.partitionBy("_slice", *keys).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy("_slice", *keys).agg(F.count("*").alias("_count"), *(F.sum(c).alias(f"_sum_{new}") for new, c in sums.items()))
    starts = slices.select(
        "_slice", *keys, F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_first"), F.sum("_count").over(whole).alias("_rows"),
        *(F.coalesce(F.sum(f"_sum_{new}").over(earlier), F.lit(0)).alias(f"_start_{new}") for new in sums),
    )
    out = sliced.withColumn("_place", F.row_number().over(local) - 1)
    for new, c in sums.items():
        out = out.withColumn(f"_part_{new}", F.coalesce(F.sum(c).over(upto), F.lit(0)))
    out = out.join(starts, ["_slice", *keys])
    return out.select(*rows.columns, (F.col("_first") + F.col("_place")).alias("_at"), "_rows", *((F.col(f"_start_{new}") + F.col(f"_part_{new}")).alias(new) for new in sums))
