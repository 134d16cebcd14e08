"""Candle and trade readers: parquet, CSV with optional header rows, raw JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.intervals import points_in

CANDLE_CSV = (
    "open_time open high low close volume close_time quote_volume trade_count "
    "taker_buy_volume taker_buy_quote_volume ignore"
).split()
TRADE_CSV = "id price quantity first_trade_id last_trade_id timestamp buyer_is_maker".split()
LONGS = {"open_time", "close_time", "trade_count", "id", "first_trade_id", "last_trade_id", "timestamp"}
CANDLE_SCHEMA = (
    "symbol string, tf string, open_time long, close_time long, open double, high double, low double, "
    "close double, volume double, quote_volume double, trade_count long, taker_buy_volume double, "
    "taker_buy_quote_volume double, month string"
)


def candles_parquet(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Candles in [start, end). The month predicate prunes folders, the time one row groups."""
    months = F.date_format(F.timestamp_millis(F.lit(start)), "yyyy-MM"), F.date_format(
        F.timestamp_millis(F.lit(end - 1)), "yyyy-MM"
    )
    return (
        spark.read.schema(CANDLE_SCHEMA)
        .parquet(path)
        .filter(F.col("month").between(*months))
        .filter((F.col("open_time") >= start) & (F.col("open_time") < end))
    )


def _typed(raw: DataFrame, names, key: str) -> DataFrame:
    rows = raw.filter(F.col(key).rlike("^[0-9]+$"))
    return rows.select(
        *[
            F.col(n).cast("long")
            if n in LONGS
            else (F.lower(n) == "true").alias(n)
            if n == "buyer_is_maker"
            else F.col(n).cast("double")
            for n in names
            if n != "ignore"
        ]
    )


def candles_csv(spark: SparkSession, path: str) -> DataFrame:
    """Twelve-column candle CSV; header lines, wherever they are, are the non-numeric rows."""
    raw = spark.read.schema(", ".join(f"{n} string" for n in CANDLE_CSV)).csv(path)
    return _typed(raw, CANDLE_CSV, "open_time")


def trades_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(", ".join(f"{n} string" for n in TRADE_CSV)).csv(path)
    return _typed(raw, TRADE_CSV, "id")


def read_windows(trades: DataFrame, spans: DataFrame, bucket: int = 3_600_000) -> DataFrame:
    """Only the rows inside a list of time windows."""
    return points_in(trades, F.col("timestamp"), spans, bucket)


def parse_klines(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Position-indexed kline arrays to typed columns; ``bad`` marks rows kept aside."""
    a = F.from_json(column, "array<string>")
    names = CANDLE_CSV[:11]
    d = raw.withColumn("_a", a)
    for i, n in enumerate(names):
        kind = "long" if n in LONGS else "double"
        d = d.withColumn(n, F.get(F.col("_a"), i).try_cast(kind))
    bad = F.col("_a").isNull() | (F.size("_a") < 11)
    for n in names:
        bad = bad | F.col(n).isNull()
    return d.withColumn("bad", bad).drop("_a")


def parse_trades(raw: DataFrame, column: str = "raw") -> DataFrame:
    """``{a,p,q,f,l,T,m}`` objects to trades; strict integers and booleans, bad rows kept aside."""
    fields = "a string, p string, q string, f string, l string, T string, m string"
    d = raw.withColumn("_o", F.from_json(column, fields))
    whole = lambda c: F.col(f"_o.{c}").rlike("^[0-9]+$")
    optional = lambda c: F.col(f"_o.{c}").isNull() | (F.col(f"_o.{c}") == "") | whole(c)
    price, qty = F.col("_o.p").try_cast("double"), F.col("_o.q").try_cast("double")
    positive = lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))
    first, last = F.col("_o.f").try_cast("long"), F.col("_o.l").try_cast("long")
    good = (
        whole("a")
        & whole("T")
        & optional("f")
        & optional("l")
        & (first.isNull() == last.isNull())
        & (first.isNull() | (first <= last))
        & positive(price)
        & positive(qty)
        & F.lower("_o.m").isin("true", "false")
    )
    return d.select(
        *[c for c in raw.columns],
        F.col("_o.a").try_cast("long").alias("id"),
        F.col("_o.T").try_cast("long").alias("timestamp"),
        price.alias("price"),
        qty.alias("quantity"),
        (F.lower("_o.m") == "true").alias("buyer_is_maker"),
        first.alias("first_trade_id"),
        last.alias("last_trade_id"),
        F.coalesce(~good, F.lit(True)).alias("bad"),
    )


def symbol_universe(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Trading perpetual symbols with their price tick, from exchange metadata documents."""
    schema = (
        "symbols array<struct<symbol:string,status:string,contractType:string,"
        "filters:array<struct<filterType:string,tickSize:string>>>>"
    )
    s = payloads.select(F.explode(F.from_json(column, schema)["symbols"]).alias("s"))
    tick = F.get(F.filter("s.filters", lambda f: f["filterType"] == "PRICE_FILTER"), 0)["tickSize"]
    return s.filter((F.col("s.status") == "TRADING") & (F.col("s.contractType") == "PERPETUAL")).select(
        F.col("s.symbol").alias("symbol"), tick.cast("double").alias("tick_size")
    )
