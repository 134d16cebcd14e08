"""Inputs the registered queries share, with the SQL blocks that restate them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import STEPS
from tidemark.operators.bars import trades_to_candles
from tidemark.plans.registry import cte
from tidemark.sources.tapes import daily_tape, intraday_tape

T0 = 1_704_067_200_000  # 2024-01-01 UTC, first day of the intraday tape
SPAN = 30 * 86_400_000

cte(
    "trade_e",
    """SELECT 'ALL' AS symbol, event_type, event_id AS seq, event_id AS id, epoch_us(ts) // 1000 AS ts,
  1000::DOUBLE + value / 10 AS price, 1::DOUBLE + CAST(json_extract_string(props, '$.k') AS BIGINT) / 10 AS quantity,
  user_id % 2 = 1 AS maker, event_id * 100 AS first_id,
  event_id * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS last_id,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)
cte(
    "trade_l",
    """SELECT 'ALL' AS symbol, epoch_us(l_shipdate) // 1000 AS ts, 1000::DOUBLE + l_extendedprice / 1000 AS price,
  l_quantity AS quantity, l_linestatus = 'F' AS maker,
  ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem""",
)


def bars_sql(src: str, step: int, symbol: str = "symbol") -> str:
    return f"""SELECT {symbol} AS symbol, ts // {step} * {step} AS open_time, ts // {step} * {step} + {step - 1} AS close_time,
  ts // {step} * {step} + {step} AS end_time, ts // {step} AS idx,
  arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
  sum(quantity) AS volume, sum(price * quantity) AS quote_volume, count(*) AS trade_count,
  sum(CASE WHEN NOT maker THEN quantity ELSE 0 END) AS taker_buy_volume,
  sum(CASE WHEN NOT maker THEN price * quantity ELSE 0 END) AS taker_buy_quote_volume
FROM {src} GROUP BY ALL"""


for _tf, _step in STEPS.items():
    cte(f"bars_e{_tf}", bars_sql("trade_e", _step))
    cte(f"bars_t{_tf}", bars_sql("trade_e", _step, "event_type"))
cte("bars_l1d", bars_sql("trade_l", STEPS["1d"]))


def tape_e(spark: SparkSession, sf: str, by_type: bool = False) -> DataFrame:
    return intraday_tape(spark, sf, by_type)


def tape_l(spark: SparkSession, sf: str) -> DataFrame:
    return daily_tape(spark, sf)


def bars_e(spark: SparkSession, sf: str, tf: str, by_type: bool = False) -> DataFrame:
    return trades_to_candles(tape_e(spark, sf, by_type), tf)


def bars_l(spark: SparkSession, sf: str) -> DataFrame:
    return trades_to_candles(tape_l(spark, sf), "1d")


MISSING = {"monthly": 2.3, "daily": 3.7}


def publication(spark: SparkSession, sf: str, which: str) -> DataFrame:
    """Two publications of the tape, each missing some trades (those of one lot size)."""
    return tape_e(spark, sf).filter(F.col("quantity") != MISSING[which])


cte("pub_m", "SELECT * FROM trade_e WHERE quantity <> 2.3::DOUBLE")
cte("pub_d", "SELECT * FROM trade_e WHERE quantity <> 3.7::DOUBLE")

