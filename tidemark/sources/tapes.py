"""Trade tapes over the given tables.

``intraday_tape`` reads ``events`` (unique, time-ordered ids, 30 days), ``daily_tape`` reads
``lineitem`` (seven years of day-stamped rows). Both give the trade schema:
symbol, seq, id, timestamp, price, quantity, buyer_is_maker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc_millis(df: DataFrame, name: str) -> Column:
    """Milliseconds of a timestamp column, whatever the session zone."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        c = F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp")
    return F.unix_millis(c)


def k_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def intraday_trades(events: DataFrame, by_type: bool = False) -> DataFrame:
    """The tape over any frame with the events schema, batch or streaming."""
    k = k_of(F.col("props"))
    return events.select(
        (F.col("event_type") if by_type else F.lit("ALL")).alias("symbol"),
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("id"),
        utc_millis(events, "ts").alias("timestamp"),
        (F.lit(1000.0) + F.col("value") / 10).alias("price"),
        (F.lit(1.0) + k / 10).alias("quantity"),
        (F.col("user_id") % 2 == 1).alias("buyer_is_maker"),
        (F.col("event_id") * 100).alias("first_trade_id"),
        (F.col("event_id") * 100 + k).alias("last_trade_id"),
    )


def intraday_tape(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    return intraday_trades(table(spark, sf_dir, "events"), by_type)


def daily_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    # One exact order key (order, line, part, supplier); a decimal keeps the aggregation hashed.
    seq = F.expr(
        "CAST((CAST(l_orderkey AS DECIMAL(15,0)) * 10BD + l_linenumber) * 1000000000000000000000BD"
        " + CAST(l_partkey AS DECIMAL(11,0)) * 10000000000BD + l_suppkey AS DECIMAL(38,0))"
    )
    return d.select(
        F.lit("ALL").alias("symbol"),
        seq.alias("seq"),
        utc_millis(d, "l_shipdate").alias("timestamp"),
        (F.lit(1000.0) + F.col("l_extendedprice") / 1000).alias("price"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_linestatus") == "F").alias("buyer_is_maker"),
    )
