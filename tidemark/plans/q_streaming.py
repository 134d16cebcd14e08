"""Structured Streaming over the given tables, driven to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import DAY, HOUR
from tidemark.functions.columns import r
from tidemark.operators import detectors as D
from tidemark.operators import fullmap as M
from tidemark.operators import scoring as SC
from tidemark.plans import q_levels, q_quality  # noqa: F401  (their SQL blocks)
from tidemark.plans.base import SPAN, T0, bars_e, tape_e
from tidemark.plans.q_confluence import CFG
from tidemark.plans.registry import build, cte, query
from tidemark.session import materialize, scratch
from tidemark.sources.tapes import intraday_trades
from tidemark.streaming import live as L


def trades_stream(spark, sf, by_type=False):
    e = L.read_table(spark, sf, "events")
    return intraday_trades(e, by_type).withColumn("ts", F.timestamp_millis("timestamp"))


BARS = "SELECT symbol, open_time, trade_count, round(open, 6) AS open, round(close, 6) AS close FROM {} WHERE end_time <= (SELECT max(ts) FROM trade_e)"


def bar_out(d):
    return d.select("symbol", "open_time", "trade_count", r("open").alias("open"), r("close").alias("close"))


@query("stream_candles_from_trades", build(BARS.format("bars_t1h")))
def stream_candles(spark, sf):
    return bar_out(L.run(L.closed_bars(trades_stream(spark, sf, True), "1 hour", "0 seconds"), "bars"))


@query("stream_native_clocks", build(" UNION ALL ".join(f"SELECT '{tf}' AS tf, * FROM ({BARS.format('bars_e' + tf)})" for tf in ("4h", "1d"))))
def stream_native_clocks(spark, sf):
    a = bar_out(L.run(L.closed_bars(trades_stream(spark, sf), "4 hours", "0 seconds"), "b4")).withColumn("tf", F.lit("4h"))
    return a.unionByName(bar_out(L.run(L.closed_bars(trades_stream(spark, sf), "1 day", "0 seconds"), "b1")).withColumn("tf", F.lit("1d")))


@query("stream_dedup_idempotent", build("SELECT count(*) AS n, count(DISTINCT id) AS ids FROM trade_e"))
def stream_dedup(spark, sf):
    """The same table arrives twice."""
    t = trades_stream(spark, sf).select("symbol", "id", "ts", "price")
    both = t.union(trades_stream(spark, sf).select("symbol", "id", "ts", "price"))
    return L.run(L.dedup(both), "dedup").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


def bar_stream(spark, sf, tf="1h", by_type=False, change=None):
    b = bars_e(spark, sf, tf, by_type).select("symbol", "open_time", "end", "open", "high", "low", "close", "trade_count").withColumn("arrival", F.lit(0))
    b = b if change is None else change(b)
    path = scratch(spark, "bar-files")
    b.write.parquet(path)
    return L.read_folder(spark, path, b.schema)


@query("stream_conflict_reject", build("SELECT 'accepted' AS sink, count(*) AS n FROM bars_e1h WHERE trade_count > 14 UNION ALL SELECT 'quarantine', count(*) FROM bars_e1h WHERE trade_count < 8"))
def stream_conflict(spark, sf):
    """The store holds all bars of up to 14 trades; the stream repeats all, with another close on thin ones."""
    keys = ["symbol", "open_time"]
    store = bars_e(spark, sf, "1h").filter("trade_count <= 14").select(*keys, "close")
    s = bar_stream(spark, sf, change=lambda b: b.withColumn("close", F.when(F.col("trade_count") < 8, F.col("close") + 1).otherwise(F.col("close"))))
    root = scratch(spark, "conflict")

    def each(batch, n):
        held = store if n == 0 else store.unionByName(spark.read.parquet(f"{root}/accepted").select(*keys, "close"))
        new, bad = L.split_conflicts(batch, held, keys, "close")
        L.append_missing(new, f"{root}/accepted", keys)
        L.append_missing(bad, f"{root}/quarantine", keys)

    L.run_batches(s, "conflict", each)
    count = lambda n: spark.read.parquet(f"{root}/{n}").agg(F.lit(n).alias("sink"), F.count(F.lit(1)).alias("n"))
    return count("accepted").unionByName(count("quarantine"))


GUARD = """SELECT symbol, open_time, CASE WHEN p IS NULL OR open_time = p + 900000 THEN 'OK' ELSE 'GAP' END AS status FROM (SELECT symbol, open_time, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS p FROM bars_t15m)"""


@query("stream_gap_guard", build(GUARD))
def stream_gap_guard(spark, sf):
    return L.run(L.guard(bar_stream(spark, sf, "15m", True), 900_000), "guard")


@query("stream_late_data", build("SELECT status, count(*) AS n FROM (SELECT 'OK' AS status FROM bars_e1h UNION ALL SELECT 'DUPLICATE' FROM bars_e1h WHERE trade_count > 15 UNION ALL SELECT 'CONFLICT' FROM bars_e1h WHERE trade_count < 10) GROUP BY status"))
def stream_late(spark, sf):
    """Repeated bars are ignored, contradicting ones refused; nothing is rewritten."""
    more = lambda b: b.unionByName(b.filter("trade_count > 15").withColumn("arrival", F.lit(1))).unionByName(
        b.filter("trade_count < 10").withColumn("arrival", F.lit(1)).withColumn("close", F.col("close") + 1)
    )
    return L.run(L.guard(bar_stream(spark, sf, change=more), HOUR), "late").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


PACK = 5 * DAY
cte("arrive", f"SELECT *, (ts - {T0}) // {PACK} + CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END AS pack, ts // {HOUR} * {HOUR} AS open_time FROM trade_e")
cte("mark", f"SELECT pack, max(newest) OVER (ORDER BY pack ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DAY} AS line FROM (SELECT pack, max(ts) AS newest FROM arrive GROUP BY pack)")
cte("timely", f"SELECT a.*, coalesce(open_time + {HOUR} <= line, false) AS late FROM arrive a JOIN mark USING (pack)")


def late_store(spark, sf):
    """The tape in packs of five days, one file and micro-batch each; every fiftieth trade comes a pack later."""
    pack = F.floor((F.col("timestamp") - T0) / PACK) + F.when(F.col("id") % 50 == 0, 1).otherwise(0)
    trades = materialize(tape_e(spark, sf).select("symbol", F.col("id").alias("seq"), "timestamp", "price", "quantity", pack.alias("pack")), "arrivals")
    path = scratch(spark, "packs")
    for p in range(-(-SPAN // PACK) + 1):  # in order of arrival; the calendar bounds their number
        trades.filter(F.col("pack") == p).drop("pack").coalesce(1).write.mode("append").parquet(path)
    store = L.BarStore(spark, scratch(spark, "bars"), HOUR, DAY)
    store.run(L.read_folder(spark, path, trades.drop("pack").schema, 1))
    return store


@query("stream_late_trades", build("SELECT id AS seq, ts AS timestamp, round(price, 6) AS price FROM timely WHERE late"))
def stream_late_trades(spark, sf):
    """Trades that came after their bar had closed, beside the bars that they did not change."""
    return late_store(spark, sf).late().select("seq", "timestamp", r("price").alias("price"))


@query("stream_timely_bars", build(f"SELECT open_time, round(arg_min(price, id), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, id), 6) AS close, round(sum(quantity), 6) AS volume, count(*) AS trade_count FROM timely WHERE NOT late GROUP BY open_time HAVING open_time + {HOUR} <= (SELECT max(ts) - {DAY} FROM arrive)"))
def stream_timely_bars(spark, sf):
    """Closed bars of the same stream: all trades that were in time."""
    return late_store(spark, sf).closed().select("open_time", *[r(c).alias(c) for c in ("open", "high", "low", "close", "volume")], "trade_count")


@query("stream_clock_guard", build("SELECT symbol, count(*) AS reversed FROM (SELECT symbol, id - lag(id) OVER (ORDER BY arrival) AS d FROM arrived) WHERE d < 0 GROUP BY symbol"))
def stream_clock(spark, sf):
    """Server time (here the id) must not move back along the arrival order."""
    from tidemark.plans.q_quality import arrived

    path, a = scratch(spark, "arrivals"), arrived(spark, sf)
    a.write.parquet(path)
    guard = L.ClockGuard(spark, scratch(spark, "clock"))
    guard.run(L.read_folder(spark, path, a.schema))
    return guard.found().groupBy("symbol").agg(F.count(F.lit(1)).alias("reversed"))


@query("stream_detect_A", build("SELECT symbol, kind, round(price, 6) AS price, known_at FROM lev_t15m"))
def stream_detect_a(spark, sf):
    d = L.run(L.detect_pairs(bar_stream(spark, sf, "15m", True)), "levels-a")
    return d.select("symbol", "kind", r("price").alias("price"), "known_at")


@query("stream_detect_C", build("SELECT kind, round(price, 6) AS price, known_at FROM c_e"))
def stream_detect_c(spark, sf):
    d = L.run(L.detect_reversals(bar_stream(spark, sf), 0.005), "levels-c")
    return d.select("kind", r("price").alias("price"), "known_at")


@query("stream_transition_alert", """SELECT user_id AS key, event_id AS seq, p AS before, event_type AS after FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p <> event_type""")
def stream_transition(spark, sf):
    e = L.read_table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return L.run(L.transition_alerts(e), "alerts")


@query("stream_session_windows", """SELECT key, min(us) AS start_us, max(us) + 14400000000 AS end_us, count(*) AS touches FROM (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY us) AS run FROM (
  SELECT user_id AS key, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 14400000000 THEN 0 ELSE 1 END AS n FROM events)) GROUP BY key, run HAVING max(us) + 14400000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events)""")
def stream_sessions(spark, sf):
    e = L.read_table(spark, sf, "events")
    t = e.select(F.col("user_id").alias("key"), F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp").alias("ts"))
    return L.run(L.sessions(t, "4 hours"), "sessions")


@query("stream_freshness", build(f"""SELECT event_type AS symbol, {T0 + 30*DAY} - max(ts) AS age_ms, CASE WHEN {T0 + 30*DAY} - max(ts) <= 1800000 THEN 'FRESH' WHEN {T0 + 30*DAY} - max(ts) <= 36000000 THEN 'STALE' ELSE 'DISCONNECTED' END AS status FROM trade_e GROUP BY 1"""))
def stream_freshness(spark, sf):
    return L.freshness(tape_e(spark, sf, True), T0 + 30 * DAY, 1_800_000).select("symbol", "age_ms", "status")


SNAP = """SELECT T, round(coalesce((coalesce(sum(contribution) FILTER (WHERE kind = 'SUPPORT'), 0) - coalesce(sum(contribution) FILTER (WHERE kind = 'RESISTANCE'), 0)) / nullif(sum(contribution), 0), 0), 6) + 0.0::DOUBLE AS normalized FROM (SELECT * FROM dec_c1h) d LEFT JOIN site_x USING (T) GROUP BY T"""
from tidemark.plans.q_confluence import site_sql  # noqa: E402

cte("site_x", site_sql("dec_c1h", "lev_e1h", 10, "0.004"))


def snapshots(spark, sf, repeat: bool):
    """Each new hourly close is scored by the batch query and saved once per (symbol, T)."""
    lev = D.detect_a(bars_e(spark, sf, "1h"), second_source=True)
    root, keys = scratch(spark, "snapshots"), ["symbol", "T"]

    def each(batch, _):
        d = batch.select("symbol", F.lit("1h").alias("tf"), F.col("end").alias("T"), F.col("close").alias("P")).filter(F.col("T") >= T0 + 10 * DAY)
        s = SC.score_timeframe(d, lev, "1h", CFG, near_only=True).select("symbol", "T", "normalized")
        L.append_missing(s, root, keys)
        if repeat:
            L.append_missing(s, root, keys)

    L.run_batches(bar_stream(spark, sf), "snapshots", each)
    return spark.read.parquet(root)


@query("stream_snapshot", build(SNAP))
def stream_snapshot(spark, sf):
    return snapshots(spark, sf, False).select("T", r("normalized").alias("normalized"))


@query("stream_score_history", build(SNAP))
def stream_score_history(spark, sf):
    """The same batch twice: only missing observations are appended."""
    return snapshots(spark, sf, True).select("T", r("normalized").alias("normalized"))
