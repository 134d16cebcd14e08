"""Scans, sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.config import DAY, DETECTOR_CONFIGS, FIXED_WIDTHS, HOUR, WIDTHS
from tidemark.functions.columns import content_id, r
from tidemark.operators import bars as B
from tidemark.operators import quality as Q
from tidemark.plans.base import T0, bars_e, bars_l, tape_e
from tidemark.plans.registry import build, query
from tidemark.session import scratch
from tidemark.sources import readers as R
from tidemark.sources import sinks as S
from tidemark.sources.tapes import table

CANDLE = "open high low close volume quote_volume taker_buy_volume taker_buy_quote_volume".split()
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in CANDLE)


def candle_out(df, *extra):
    return df.select("symbol", "open_time", *extra, "trade_count", *[r(c).alias(c) for c in CANDLE])


@query(
    "trades_to_candles",
    build(f"SELECT symbol, open_time, close_time, trade_count, {ROUNDED} FROM bars_t4h"),
)
def trades_to_candles(spark, sf):
    return candle_out(bars_e(spark, sf, "4h", by_type=True), "close_time")


@query(
    "trades_to_candles_daily",
    build(f"SELECT symbol, open_time, close_time, trade_count, {ROUNDED} FROM bars_l1d"),
)
def trades_to_candles_daily(spark, sf):
    return candle_out(bars_l(spark, sf), "close_time")


def month_part(df):
    return df.withColumn("month", F.date_format(F.timestamp_millis("open_time"), "yyyy-MM"))


@query(
    "scan_candles_parquet",
    build(f"SELECT symbol, open_time, trade_count, {ROUNDED} FROM bars_e1h WHERE open_time >= {T0 + 5*DAY} AND open_time < {T0 + 20*DAY}"),
)
def scan_candles_parquet(spark, sf):
    path = S.save_partitioned(month_part(bars_e(spark, sf, "1h")).select(*[c.split()[0] for c in R.CANDLE_SCHEMA.split(", ")]), scratch(spark, "candles"), "month")
    return candle_out(R.candles_parquet(spark, path, T0 + 5 * DAY, T0 + 20 * DAY))


@query(
    "scan_candles_csv",
    build(f"SELECT open_time, close_time, trade_count, {ROUNDED} FROM bars_e1h"),
)
def scan_candles_csv(spark, sf):
    path = scratch(spark, "candles-csv")
    d = bars_e(spark, sf, "1h").withColumn("ignore", F.lit(0))
    d.select(*R.CANDLE_CSV).write.option("header", True).csv(path)
    return R.candles_csv(spark, path).select("open_time", "close_time", "trade_count", *[r(c).alias(c) for c in CANDLE])


@query(
    "scan_trades_csv",
    build(
        "SELECT id, ts AS timestamp, round(price, 6) AS price, round(quantity, 6) AS quantity, maker AS buyer_is_maker, "
        "first_id AS first_trade_id, last_id AS last_trade_id FROM trade_e"
    ),
)
def scan_trades_csv(spark, sf):
    path = scratch(spark, "trades-csv")
    tape_e(spark, sf).select(*R.TRADE_CSV).write.option("header", True).csv(path)
    return R.trades_csv(spark, path).withColumn("price", r("price")).withColumn("quantity", r("quantity"))


BUSY = "SELECT symbol, open_time AS s, open_time + 3600000 AS e FROM bars_e1h WHERE volume > (SELECT avg(volume) * 1.2 FROM bars_e1h)"


def busy_hours(spark, sf):
    b = bars_e(spark, sf, "1h").select("symbol", "open_time", "end", "volume")
    mean = b.agg((F.avg("volume") * F.lit(1.2)).alias("m"))
    return b.join(F.broadcast(mean), F.col("volume") > F.col("m")).select(F.col("open_time").alias("start"), "end")


@query(
    "scan_windows",
    build(f"SELECT id, ts AS timestamp, round(price, 6) AS price FROM trade_e t WHERE EXISTS (SELECT 1 FROM ({BUSY}) w WHERE t.ts >= w.s AND t.ts < w.e)"),
)
def scan_windows(spark, sf):
    return R.read_windows(tape_e(spark, sf), busy_hours(spark, sf)).select("id", "timestamp", r("price").alias("price"))


@query(
    "parse_kline_array",
    build(
        f"SELECT open_time, trade_count < 12 AS bad, {ROUNDED} FROM (SELECT *, trade_count < 12 AS short FROM bars_e1h) WHERE NOT short "
        f"UNION ALL SELECT open_time, true, {', '.join('round(' + c + ', 6)' if c in CANDLE[:5] else 'NULL' for c in CANDLE)} FROM bars_e1h WHERE trade_count < 12"
    ),
)
def parse_kline_array(spark, sf):
    """Thin hours arrive truncated after the sixth field and are kept aside as bad."""
    names = R.CANDLE_CSV[:11]
    full = F.array(*[F.col(n).cast("string") for n in names])
    raw = bars_e(spark, sf, "1h").select(
        F.to_json(F.when(F.col("trade_count") < 12, F.slice(full, 1, 6)).otherwise(full)).alias("raw")
    )
    return R.parse_klines(raw).select("open_time", "bad", *[r(c).alias(c) for c in CANDLE])


@query(
    "parse_trade_json",
    build(
        "SELECT raw_id, bad, CASE WHEN NOT bad THEN round(price, 6) END AS price, CASE WHEN NOT bad THEN round(quantity, 6) END AS quantity FROM "
        "(SELECT id AS raw_id, price, quantity, (event_type = 'error' AND k > 80) OR (event_type = 'view' AND k = 7) OR (event_type = 'click' AND k < 3) AS bad FROM trade_e)"
    ),
)
def parse_trade_json(spark, sf):
    """Damaged records: a non-integer id, a non-boolean maker flag, a negative quantity."""
    t, kind = tape_e(spark, sf, by_type=True), F.col("symbol")
    k = F.col("last_trade_id") - F.col("first_trade_id")
    txt = lambda c: F.col(c).cast("string")
    raw = t.select(
        F.col("id").alias("raw_id"),
        F.to_json(
            F.struct(
                F.when((kind == "error") & (k > 80), F.concat(F.lit("x"), txt("id"))).otherwise(txt("id")).alias("a"),
                txt("price").alias("p"),
                F.when((kind == "click") & (k < 3), F.lit("-1")).otherwise(txt("quantity")).alias("q"),
                txt("first_trade_id").alias("f"),
                txt("last_trade_id").alias("l"),
                txt("timestamp").alias("T"),
                F.when((kind == "view") & (k == 7), F.lit("yes")).otherwise(txt("buyer_is_maker")).alias("m"),
            )
        ).alias("raw"),
    )
    ok = ~F.col("bad")
    return R.parse_trades(raw).select(
        "raw_id", "bad", F.when(ok, r("price")).alias("price"), F.when(ok, r("quantity")).alias("quantity")
    )


@query(
    "candle_to_research",
    build("SELECT symbol || ':1d:' || open_time AS id, open_time AS start, close_time + 1 AS \"end\", round(close, 6) AS close FROM bars_e1d"),
)
def candle_to_research(spark, sf):
    return B.to_research(Q.require_contiguous(bars_e(spark, sf, "1d"))).select("id", "start", "end", r("close").alias("close"))


@query("sink_dataset", build("SELECT 'csv' AS format, count(*) AS n, sum(trade_count)::BIGINT AS trades FROM bars_e1h UNION ALL SELECT 'parquet', count(*), sum(trade_count)::BIGINT FROM bars_e1h"))
def sink_dataset(spark, sf):
    root, d = scratch(spark, "dataset"), candle_out(bars_e(spark, sf, "1h"))
    out = []
    for fmt in ("csv", "parquet"):
        path = S.save_dataset(d, root, "ALL", "1h", T0, None, fmt)
        back = spark.read.schema(d.schema).option("header", True).format(fmt).load(path)
        out.append(back.agg(F.lit(fmt).alias("format"), F.count(F.lit(1)).alias("n"), F.sum("trade_count").alias("trades")))
    return reduce(lambda a, b: a.unionByName(b), out)


@query("sink_partitioned", build("SELECT event_type AS symbol, count(*) AS n FROM trade_e GROUP BY ALL"))
def sink_partitioned(spark, sf):
    path = S.save_partitioned(tape_e(spark, sf, by_type=True), scratch(spark, "parts"), "symbol")
    return spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("sink_daily", build("SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, count(*) AS n FROM trade_e GROUP BY ALL"))
def sink_daily(spark, sf):
    path = S.save_daily(tape_e(spark, sf), scratch(spark, "daily"), "timestamp")
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("sink_jsonl", build("SELECT open_time, trade_count, round(close, 6) AS close FROM bars_e4h"))
def sink_jsonl(spark, sf):
    d = bars_e(spark, sf, "4h").select("open_time", F.struct("trade_count", "close").alias("body"))
    lines, _flat = S.save_jsonl(d, scratch(spark, "rows"))
    back = spark.read.schema(d.schema).json(lines)
    return back.select("open_time", "body.trade_count", r("body.close").alias("close"))


@query(
    "flatten_nested",
    build("SELECT open_time AS \"key.open_time\", round(high, 6) AS \"px.range.high\", round(low, 6) AS \"px.range.low\", '[' || trade_count || ',' || idx || ']' AS \"counts\" FROM bars_e4h"),
)
def flatten_nested(spark, sf):
    nested = bars_e(spark, sf, "4h").select(
        F.struct("open_time").alias("key"),
        F.struct(F.struct(r("high").alias("high"), r("low").alias("low")).alias("range")).alias("px"),
        F.array("trade_count", "idx").alias("counts"),
    )
    return S.flatten(nested)


@query("export_bundle", build("SELECT 'decisions' AS part, count(*) AS n FROM bars_e4h UNION ALL SELECT 'outcomes', count(*) FROM bars_e1d"))
def export_bundle(spark, sf):
    d, o = bars_e(spark, sf, "4h").select("open_time", "close"), bars_e(spark, sf, "1d").select("open_time", "high", "low")
    root = S.save_bundle({"decisions": d, "outcomes": o}, scratch(spark, "bundle"))
    read = lambda n, s: spark.read.schema(s).option("header", True).csv(f"{root}/{n}.csv").agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"))
    return read("decisions", d.schema).unionByName(read("outcomes", o.schema))


@query("file_manifest")
def file_manifest(spark, sf):
    """Manifest of two saves of the same bars; the drift report must be about names only."""
    path = S.save_partitioned(month_part(bars_l(spark, sf)), scratch(spark, "manifest"), "month")
    return S.file_manifest(spark, path)


@query("content_id", build("SELECT id, sha256('outcome-v1|' || id || '|' || ts || '|' || event_type) AS content_id FROM trade_e"))
def content_id_(spark, sf):
    t = tape_e(spark, sf, by_type=True)
    return t.select("id", content_id(F.lit("outcome-v1"), "id", "timestamp", "symbol").alias("content_id"))


@query(
    "symbol_universe",
    """SELECT s_name AS symbol, round(CAST(round(abs(s_acctbal) / 1000, 2) AS DOUBLE), 6) AS tick_size FROM supplier
       WHERE s_acctbal > 0 AND s_suppkey % 3 <> 0 ORDER BY 1""",
)
def symbol_universe(spark, sf):
    """One metadata document per nation; suppliers stand for the listed symbols."""
    s = table(spark, sf, "supplier")
    entry = F.struct(
        F.col("s_name").alias("symbol"),
        F.when(F.col("s_acctbal") > 0, "TRADING").otherwise("BREAK").alias("status"),
        F.when(F.col("s_suppkey") % 3 != 0, "PERPETUAL").otherwise("QUARTERLY").alias("contractType"),
        F.array(
            F.struct(F.lit("LOT_SIZE").alias("filterType"), F.lit("1").alias("tickSize")),
            F.struct(F.lit("PRICE_FILTER").alias("filterType"), F.round(F.abs("s_acctbal") / 1000, 2).cast("string").alias("tickSize")),
        ).alias("filters"),
    )
    docs = s.select(F.to_json(F.struct(F.array(entry).alias("symbols"))).alias("payload"))
    return R.symbol_universe(docs).select("symbol", r("tick_size").alias("tick_size")).orderBy("symbol")


_GRID = ", ".join(
    f"('{d}', {'NULL' if p is None else repr(float(p))}::DOUBLE)" for d, p in DETECTOR_CONFIGS
)


@query(
    "config_grid",
    f"""SELECT symbol, '1h' AS tf, detector, parameter, width, sha256(symbol || '|1h|' || detector || '|' || coalesce(CAST(CAST(round(parameter * 1000) AS BIGINT) AS VARCHAR), '~') || '|' || CAST(round(width * 10000) AS BIGINT)) AS configuration_id
    FROM (SELECT DISTINCT event_type AS symbol FROM events), (VALUES {_GRID}) d(detector, parameter),
    (SELECT unnest([{', '.join(map(str, FIXED_WIDTHS + (WIDTHS['1h'],)))}])::DOUBLE AS width)""",
)
def config_grid(spark, sf):
    from tidemark.plans.grid import configurations

    symbols = tape_e(spark, sf, by_type=True).select("symbol").distinct()
    return configurations(symbols)
