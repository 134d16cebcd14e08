"""The configuration grid: symbols x timeframes x detectors x half-widths, each with a content id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DETECTOR_CONFIGS, FIXED_WIDTHS, WIDTHS
from tidemark.functions.columns import content_id


def configurations(symbols: DataFrame, tfs=("1h",), detectors=DETECTOR_CONFIGS) -> DataFrame:
    """(symbol, tf, detector, parameter, width, configuration_id): parameters are columns, so that one plan runs all of them."""
    rule = lambda d, p: F.struct(F.lit(d).alias("detector"), F.lit(p).cast("double").alias("parameter"))
    wide = lambda tf: F.struct(F.lit(tf).alias("tf"), F.array(*map(F.lit, (*FIXED_WIDTHS, WIDTHS[tf]))).alias("widths"))
    whole = lambda c, k: F.round(F.col(c) * k).cast("long")
    return (
        symbols.select("symbol", F.explode(F.array(*map(wide, tfs))).alias("w"))
        .select("symbol", "w.tf", F.explode("w.widths").alias("width"))
        .withColumn("d", F.explode(F.array(*[rule(d, p) for d, p in detectors])))
        .select("symbol", "tf", "d.*", "width")
        .withColumn("configuration_id", content_id("symbol", "tf", "detector", whole("parameter", 1000), whole("width", 10000)))
    )
