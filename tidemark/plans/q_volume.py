"""Volume at price and zone volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import DAY, HOUR, STEPS
from tidemark.functions.columns import known, r
from tidemark.operators import profiles as P
from tidemark.plans.base import T0, bars_e, tape_e, tape_l
from tidemark.plans.q_levels import visits_e
from tidemark.plans.q_quality import quarantine
from tidemark.plans.registry import build, cte, query

SUMS = "round(sum(quantity), 6) AS quantity, round(sum(CASE WHEN NOT maker THEN quantity ELSE 0 END), 6) AS buy, round(sum(CASE WHEN maker THEN quantity ELSE 0 END), 6) AS sell"


def sides(d, *keys):
    return d.select(*keys, *[r(c).alias(c) for c in ("quantity", "buy", "sell")])


@query(
    "side_totals",
    build("""SELECT event_type AS symbol, round(sum(quantity), 6) AS quantity, round(coalesce(sum(quantity) FILTER (WHERE NOT mk), 0), 6) AS buy, round(coalesce(sum(quantity) FILTER (WHERE mk), 0), 6) AS sell,
      round(coalesce(sum(quantity) FILTER (WHERE mk IS NULL), 0), 6) AS unknown, CASE WHEN count(*) FILTER (WHERE mk IS NULL) = 0 THEN round(coalesce(sum(quantity) FILTER (WHERE NOT mk), 0) - coalesce(sum(quantity) FILTER (WHERE mk), 0), 6) END AS delta
      FROM (SELECT *, CASE WHEN event_type = 'error' AND k > 90 THEN NULL ELSE maker END AS mk FROM trade_e) GROUP BY 1"""),
)
def side_totals(spark, sf):
    """The maker flag of large 'error' trades is unknown, so that symbol has no delta."""
    t = tape_e(spark, sf, True)
    k = F.col("last_trade_id") - F.col("first_trade_id")
    t = t.withColumn("buyer_is_maker", F.when(~((F.col("symbol") == "error") & (k > 90)), F.col("buyer_is_maker")))
    return sides(P.side_totals(t, "symbol").withColumn("u", r("unknown")).withColumn("d", r("delta")), "symbol", F.col("u").alias("unknown"), F.col("d").alias("delta"))


@query(
    "volume_at_price",
    build(f"""SELECT event_type AS symbol, ts // {DAY} * {DAY} AS window_start, (CAST(CAST(price AS VARCHAR) AS DECIMAL(20,8)) * 100000000)::BIGINT // 10000000 AS bin, count(*) AS trade_count, {SUMS} FROM trade_e GROUP BY ALL"""),
)
def volume_at_price(spark, sf):
    return sides(P.volume_at_price(tape_e(spark, sf, True), "0.1", DAY), "symbol", "window_start", "bin", "trade_count")


@query(
    "compact_bin",
    build(f"""SELECT ts // {DAY} * {DAY} AS window_start, (CAST(CAST(price AS VARCHAR) AS DECIMAL(20,8)) * 100000000)::BIGINT // 100000000 AS bin, count(*) AS trade_count, sum((id * 2654435761) % 4294967296)::BIGINT AS ids_checksum FROM trade_e GROUP BY ALL"""),
)
def compact_bin(spark, sf):
    return P.volume_at_price(tape_e(spark, sf), "1", DAY).select("window_start", "bin", "trade_count", "ids_checksum")


@query("bin_trades", build(f"SELECT CAST(floor(price / 0.1::DOUBLE) AS BIGINT) AS bin, {SUMS} FROM trade_e GROUP BY 1"))
def bin_trades(spark, sf):
    return sides(P.bin_trades(tape_e(spark, sf), 0.1), "bin")


@query("hourly_profile", build(f"SELECT ts // {HOUR} * {HOUR} AS hour, round(price, 6) AS price, {SUMS} FROM trade_e GROUP BY ts // {HOUR}, trade_e.price"))
def hourly_profile(spark, sf):
    return sides(P.profile(tape_e(spark, sf), HOUR), F.col("bucket").alias("hour"), r("price").alias("price"))


@query("quarter_profile", build("SELECT event_type AS symbol, ts // 900000 * 900000 AS bucket, round(price, 6) AS price, round(sum(CASE WHEN maker THEN -quantity ELSE quantity END), 6) AS delta, round(sum(quantity), 6) AS quantity FROM trade_e GROUP BY event_type, ts // 900000, trade_e.price"))
def quarter_profile(spark, sf):
    p = P.profile(tape_e(spark, sf, True), STEPS["15m"])
    return p.select("symbol", "bucket", r("price").alias("price"), r("delta").alias("delta"), r("quantity").alias("quantity"))


@query(
    "merge_profiles",
    build(f"""SELECT b.end_time AS T, w AS window, round(t.price, 6) AS price, round(sum(t.quantity), 6) AS quantity FROM bars_e15m b, (SELECT unnest([1, 4, 8])::BIGINT AS w) JOIN trade_e t ON t.ts >= b.end_time - w * 900000 AND t.ts < b.end_time
      GROUP BY b.end_time, w, t.price"""),
)
def merge_profiles(spark, sf):
    t = tape_e(spark, sf)
    d = bars_e(spark, sf, "15m").select("symbol", F.col("end").alias("T"))
    w = P.window_profile(P.profile(t, STEPS["15m"]), d, STEPS["15m"], (1, 4, 8))
    return w.select("T", F.col("window").cast("long").alias("window"), r("price").alias("price"), r("quantity").alias("quantity"))


@query("profile_with_coverage", build(f"""SELECT h AS bucket, h + {HOUR} AS "end", CASE WHEN EXISTS (SELECT 1 FROM quar q WHERE h < q.e AND h + {HOUR} > q.s) THEN 'QUARANTINED' ELSE 'OBSERVED' END AS coverage_status, n FROM (SELECT ts // {HOUR} * {HOUR} AS h, count(DISTINCT price) AS n FROM trade_e GROUP BY 1)"""))
def profile_with_coverage(spark, sf):
    p = P.with_coverage(P.profile(tape_e(spark, sf), HOUR), quarantine(spark, sf), HOUR)
    return p.groupBy("bucket", "end", "coverage_status").agg(F.count(F.lit(1)).alias("n"))


@query("profile_parity", build(f"SELECT count(*) AS rows, 0::BIGINT AS unmatched, true AS equal FROM (SELECT DISTINCT ts // {HOUR}, price FROM trade_e)"))
def profile_parity(spark, sf):
    t = tape_e(spark, sf)
    d = P.profile_parity(P.profile(t, STEPS["15m"]), P.profile(t, HOUR), HOUR)
    return d.select("rows", "unmatched", (F.col("max_difference") < 1e-9).alias("equal"))


cte("prof_l", "SELECT symbol, ts AS bucket, price, sum(quantity) AS quantity, sum(CASE WHEN NOT maker THEN quantity ELSE 0 END) AS buy, sum(CASE WHEN maker THEN quantity ELSE 0 END) AS sell FROM trade_l GROUP BY ALL")
cte("prof_e", f"SELECT symbol, ts // {HOUR} * {HOUR} AS bucket, price, sum(quantity) AS quantity, sum(CASE WHEN NOT maker THEN quantity ELSE 0 END) AS buy, sum(CASE WHEN maker THEN quantity ELSE 0 END) AS sell FROM trade_e GROUP BY ALL")


@query("hourly_bins", build("SELECT bucket AS hour, CAST(floor(price / 5) AS BIGINT) AS bin, round(sum(quantity), 6) AS quantity, round(sum(buy), 6) AS buy, round(sum(sell), 6) AS sell FROM prof_l GROUP BY ALL"))
def hourly_bins(spark, sf):
    return sides(P.hourly_bins(P.profile(tape_l(spark, sf), DAY), 5.0), "hour", "bin")


@query(
    "join_range_price",
    build(f"""SELECT v.zone, v.visit_number, v.observed_at - {HOUR} AS bucket, round(coalesce(sum(p.quantity), 0), 6) AS quantity, round(coalesce(sum(p.buy), 0), 6) AS buy, round(coalesce(sum(p.sell), 0), 6) AS sell
      FROM vis_sep v LEFT JOIN prof_e p ON p.bucket = v.observed_at - {HOUR} AND p.price BETWEEN v.lower AND v.upper GROUP BY ALL"""),
)
def join_range_price(spark, sf):
    v = visits_e(spark, sf, 0.001, 0.003)
    b = v.select(F.struct("zone_id", "visit_number").alias("qid"), "symbol", (F.col("observed_at") - HOUR).alias("bucket"), F.col("zone_lower").alias("lower"), F.col("zone_upper").alias("upper"))
    q = P.range_quantity(b, P.profile(tape_e(spark, sf), HOUR).select("symbol", "bucket", "price", "quantity", "buy", "sell"))
    return sides(q, F.col("qid.zone_id").alias("zone"), F.col("qid.visit_number").alias("visit_number"), "bucket")


ZV = f"""SELECT v.zone, v.visit_number, v.observed_at, CASE WHEN v.observed_at - {2*HOUR} < {T0 + DAY} THEN 'MISSING_TRADE_COVERAGE'
  WHEN EXISTS (SELECT 1 FROM quar q WHERE v.observed_at - {2*HOUR} < q.e AND v.observed_at > q.s) THEN 'QUARANTINED_TRADE_COVERAGE' ELSE 'AVAILABLE' END AS status,
  (SELECT coalesce(sum(quantity), 0) FROM prof_e p WHERE p.bucket = v.observed_at - {HOUR} AND p.price BETWEEN v.lower AND v.upper) AS q,
  (SELECT coalesce(sum(buy - sell), 0) FROM prof_e p WHERE p.bucket = v.observed_at - {HOUR} AND p.price BETWEEN v.lower AND v.upper) AS dl,
  (SELECT coalesce(sum(quantity), 0) FROM prof_e p WHERE p.bucket = v.observed_at - {2*HOUR} AND p.price BETWEEN v.lower AND v.upper) AS base
  FROM vis_e v"""
cte("zvol", ZV)


def zone_volumes(spark, sf, visits=None):
    v = visits_e(spark, sf) if visits is None else visits
    i = v.withColumn("interaction_id", F.struct("zone_id", "visit_number"))
    prof = P.profile(tape_e(spark, sf), HOUR).select("symbol", "bucket", "price", "quantity", "buy", "sell")
    return P.zone_volume(i, prof, HOUR, T0 + DAY, quarantine(spark, sf))


@query(
    "zone_volume_features",
    build("""SELECT zone, visit_number, status, CASE WHEN status = 'AVAILABLE' THEN round(q, 6) END AS quantity, CASE WHEN status = 'AVAILABLE' THEN round(dl, 6) + 0.0::DOUBLE END AS volume_delta,
      CASE WHEN status = 'AVAILABLE' THEN round(base, 6) END AS baseline_quantity, CASE WHEN status = 'AVAILABLE' AND round(base, 6) > 0 THEN round(round(q, 6) / round(base, 6), 5) END AS relative_zone_volume FROM zvol"""),
)
def zone_volume_features(spark, sf):
    d = zone_volumes(spark, sf)
    q, b = r("quantity"), r("baseline_quantity")
    return d.select(
        F.col("interaction_id.zone_id").alias("zone"), F.col("interaction_id.visit_number").alias("visit_number"), "status", q.alias("quantity"),
        r("volume_delta").alias("volume_delta"), b.alias("baseline_quantity"), F.when(b > 0, r(q / b, 5)).alias("relative_zone_volume"),
    )


LOOK = 100
cte("vap_l", f"""SELECT d.t AS T, d.close AS P, h.bin, sum(h.quantity) AS quantity, sum(h.buy) AS buy, sum(h.sell) AS sell
  FROM (SELECT end_time AS t, close FROM bars_l1d) d JOIN (SELECT bucket AS hour, CAST(floor(price / 5) AS BIGINT) AS bin, sum(quantity) AS quantity, sum(buy) AS buy, sum(sell) AS sell FROM prof_l GROUP BY ALL) h
  ON h.hour >= d.t - {LOOK * DAY} AND h.hour < d.t GROUP BY ALL""")


def vap_l(spark, sf):
    from tidemark.plans.base import bars_l

    bins = P.hourly_bins(P.profile(tape_l(spark, sf), DAY), 5.0)
    log = P.rolling_vap(bins, LOOK * DAY, DAY)
    d = bars_l(spark, sf).select("symbol", F.col("end").alias("T"), F.col("close").alias("P"))
    return P.vap_at(log, d, 16 * DAY)


@query("rolling_vap", build("SELECT T, bin, round(quantity, 6) AS quantity, round(buy, 6) AS buy, round(sell, 6) AS sell FROM vap_l"))
def rolling_vap(spark, sf):
    return sides(vap_l(spark, sf), "T", "bin")


@query(
    "vap_snapshot",
    build("""SELECT T, count(*) AS bins, count(*) FILTER (WHERE bin * 5 >= P) AS bins_above, count(*) FILTER (WHERE (bin + 1) * 5 <= P) AS bins_below, count(*) FILTER (WHERE quantity >= mean * 1.5) AS concentrated_bins,
      round(sum(quantity), 6) AS total_quantity, round(sum(quantity) FILTER (WHERE bin * 5 >= P), 6) AS above_quantity, round(coalesce(sum(quantity) FILTER (WHERE bin * 5 < P AND (bin + 1) * 5 > P), 0), 6) AS straddling_quantity,
      round(coalesce(sum(quantity) FILTER (WHERE bin * 5 >= P AND quantity >= mean * 1.5), 0), 6) AS concentrated_above_quantity
      FROM (SELECT *, avg(quantity) OVER (PARTITION BY T) AS mean FROM vap_l) GROUP BY T""").replace("round(sum(quantity) FILTER (WHERE bin * 5 >= P), 6)", "round(coalesce(sum(quantity) FILTER (WHERE bin * 5 >= P), 0), 6)"),
)
def vap_snapshot(spark, sf):
    s = P.vap_snapshot(vap_l(spark, sf), 5.0)
    return s.select("T", "bins", "bins_above", "bins_below", "concentrated_bins", *[r(c).alias(c) for c in ("total_quantity", "above_quantity", "straddling_quantity", "concentrated_above_quantity")])
