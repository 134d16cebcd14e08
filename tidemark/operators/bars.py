"""Trades to candles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import MINUTE, STEPS
from tidemark.functions.columns import floor_to, sum_if


def trades_to_candles(trades: DataFrame, tf: str, step: int | None = None) -> DataFrame:
    """One hash aggregation: partial bars on the map side, so a busy bar is never one task.

    ``idx`` is the bar's place on the calendar grid; a missing bar is a missing index.
    """
    step = step or STEPS[tf]
    taker = ~F.col("buyer_is_maker")
    turnover = F.col("price") * F.col("quantity")
    return (
        trades.withColumn("open_time", floor_to(F.col("timestamp"), step))
        .groupBy("symbol", "open_time")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("quantity").alias("volume"),
            F.sum(turnover).alias("quote_volume"),
            F.count(F.lit(1)).alias("trade_count"),
            sum_if(taker, F.col("quantity")).alias("taker_buy_volume"),
            sum_if(taker, turnover).alias("taker_buy_quote_volume"),
        )
        .withColumn("tf", F.lit(tf))
        .withColumn("close_time", F.col("open_time") + (step - 1))
        .withColumn("end", F.col("open_time") + step)
        .withColumn("idx", F.floor(F.col("open_time") / step).cast("long"))
    )


def merge_candles(candles: DataFrame, tf: str) -> DataFrame:
    """Candles of a coarser timeframe from those of one that divides it: equal to those from the trades."""
    step = STEPS[tf]
    total = lambda c: F.sum(c).alias(c)
    return (
        candles.withColumn("_at", F.col("open_time"))
        .withColumn("open_time", floor_to(F.col("open_time"), step))
        .groupBy("symbol", "open_time")
        .agg(
            F.min_by("open", "_at").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "_at").alias("close"),
            *[total(c) for c in ("volume", "quote_volume", "trade_count", "taker_buy_volume", "taker_buy_quote_volume")],
        )
        .withColumn("tf", F.lit(tf))
        .withColumn("close_time", F.col("open_time") + (step - 1))
        .withColumn("end", F.col("open_time") + step)
        .withColumn("idx", F.floor(F.col("open_time") / step).cast("long"))
    )


def minute_bars(trades: DataFrame) -> DataFrame:
    """Per-minute quantity, count, first and last time, OHLC, buy and sell."""
    maker = F.col("buyer_is_maker")
    return (
        trades.withColumn("minute", floor_to(F.col("timestamp"), MINUTE))
        .groupBy("symbol", "minute")
        .agg(
            F.sum("quantity").alias("quantity"),
            F.count(F.lit(1)).alias("count"),
            F.min("timestamp").alias("first_time"),
            F.max("timestamp").alias("last_time"),
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            sum_if(~maker, F.col("quantity")).alias("buy"),
            sum_if(maker, F.col("quantity")).alias("sell"),
        )
    )


def to_research(candles: DataFrame) -> DataFrame:
    """Exclusive-end candles with an id; a hole in the clock is an error, never bridged."""
    return candles.select(
        F.concat_ws(":", "symbol", "tf", F.col("open_time").cast("string")).alias("id"),
        F.col("symbol"),
        F.col("tf"),
        F.col("open_time").alias("start"),
        (F.col("close_time") + 1).alias("end"),
        "open",
        "high",
        "low",
        "close",
    )
