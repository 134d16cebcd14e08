"""Levels, zones, visits and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import DAY, DIRECTIONS, HORIZONS, HOUR, STEPS, TP_SL, WIDTHS
from tidemark.functions.columns import content_id, count_if, known, long, r
from tidemark.operators import detectors as D
from tidemark.operators import outcomes as O
from tidemark.operators import profiles as P
from tidemark.operators import quality as Q
from tidemark.operators import visits as V
from tidemark.operators import zones as Z
from tidemark.plans.base import T0, bars_e, bars_l, tape_e, tape_l
from tidemark.plans.registry import build, cte, query

FACTS = "kind price source_timestamp known_at dependency_start".split()


def level_sql(bars: str) -> str:
    return f"""SELECT symbol, CASE WHEN top THEN 'RESISTANCE' ELSE 'SUPPORT' END AS kind,
  CASE WHEN top THEN least(high, ph) ELSE greatest(low, pl) END AS price,
  CASE WHEN (top AND ph > high) OR (NOT top AND pl < low) THEN open_time ELSE pot END AS source_timestamp,
  end_time AS known_at, pot AS dependency_start, open_time AS second_open
FROM (SELECT *, pc > po AND close < open AS top, pc < po AND close > open AS bottom FROM
  (SELECT *, lag(idx) OVER w AS pi, lag(open_time) OVER w AS pot, lag(open) OVER w AS po, lag(close) OVER w AS pc,
    lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM {bars} WINDOW w AS (PARTITION BY symbol ORDER BY idx))
  WHERE pi = idx - 1) WHERE top OR bottom"""


for _tf in STEPS:
    cte(f"lev_e{_tf}", level_sql(f"bars_e{_tf}"))
    cte(f"lev_t{_tf}", level_sql(f"bars_t{_tf}"))
cte("lev_l", level_sql("bars_l1d"))
OUT = "kind, round(price, 6) AS price, source_timestamp, known_at, dependency_start"


def out(d, *keys):
    return d.select(*keys, "kind", r("price").alias("price"), "source_timestamp", "known_at", "dependency_start")


@query("detect_A", build(f"SELECT {OUT} FROM lev_l"))
def detect_a(spark, sf):
    return out(D.detect(bars_l(spark, sf), "A"))


@query("detect_A_symbols", build(f"SELECT symbol, {OUT} FROM lev_t15m"))
def detect_a_symbols(spark, sf):
    """Several symbols with holes in the clock: a pair never spans a missing bar."""
    return out(D.detect(bars_e(spark, sf, "15m", by_type=True), "A"), "symbol")


@query("detect_A_website", build("SELECT kind, round(price, 6) AS price, second_open AS source_time, known_at, dependency_start FROM lev_e1h"))
def detect_a_second(spark, sf):
    d = D.detect_a(bars_e(spark, sf, "1h"), second_source=True)
    return out(d).withColumnRenamed("source_timestamp", "source_time")


def extrema_sql(bars: str, w: int) -> str:
    return f"""SELECT *, lead(end_time, {w}) OVER o AS confirmed, lag(open_time, {w}) OVER o AS first_open,
  high > max(high) OVER l AND high > max(high) OVER r AS is_high, low < min(low) OVER l AND low < min(low) OVER r AS is_low,
  count(*) OVER l = {w} AND count(*) OVER r = {w} AS full_window
FROM {bars} WINDOW o AS (PARTITION BY symbol ORDER BY idx), l AS (PARTITION BY symbol ORDER BY idx RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING),
  r AS (PARTITION BY symbol ORDER BY idx RANGE BETWEEN 1 FOLLOWING AND {w} FOLLOWING)"""


for _w in (1, 2, 4, 8):
    cte(f"ext_l{_w}", extrema_sql("bars_l1d", _w))
    cte(f"ext_e{_w}", extrema_sql("bars_e1h", _w))


def b_sql(ext: str) -> str:
    return f"""SELECT 'RESISTANCE' AS kind, round(high, 6) AS price, open_time AS source_timestamp, confirmed AS known_at, first_open AS dependency_start FROM {ext} WHERE full_window AND is_high
UNION ALL SELECT 'SUPPORT', round(low, 6), open_time, confirmed, first_open FROM {ext} WHERE full_window AND is_low"""


@query("detect_B", build(b_sql("ext_l2")))
def detect_b(spark, sf):
    return out(D.detect(bars_l(spark, sf), "B", 2))


def c_sql(bars: str, f: str) -> str:
    return f"""SELECT * FROM (
  WITH RECURSIVE n AS (SELECT *, row_number() OVER (ORDER BY idx) AS rn FROM {bars}),
  c AS (SELECT rn, end_time, high AS top, open_time AS tt, low AS bot, open_time AS bt, NULL::DOUBLE AS rp, NULL::BIGINT AS rt, NULL::DOUBLE AS sp, NULL::BIGINT AS st FROM n WHERE rn = 1
  UNION ALL SELECT n.rn, n.end_time,
    CASE WHEN n.high > c.top OR n.close <= c.top * (1 - {f}::DOUBLE) THEN n.high ELSE c.top END,
    CASE WHEN n.high > c.top OR n.close <= c.top * (1 - {f}::DOUBLE) THEN n.open_time ELSE c.tt END,
    CASE WHEN n.low < c.bot OR n.close >= c.bot * (1 + {f}::DOUBLE) THEN n.low ELSE c.bot END,
    CASE WHEN n.low < c.bot OR n.close >= c.bot * (1 + {f}::DOUBLE) THEN n.open_time ELSE c.bt END,
    CASE WHEN NOT n.high > c.top AND n.close <= c.top * (1 - {f}::DOUBLE) THEN c.top END, CASE WHEN NOT n.high > c.top AND n.close <= c.top * (1 - {f}::DOUBLE) THEN c.tt END,
    CASE WHEN NOT n.low < c.bot AND n.close >= c.bot * (1 + {f}::DOUBLE) THEN c.bot END, CASE WHEN NOT n.low < c.bot AND n.close >= c.bot * (1 + {f}::DOUBLE) THEN c.bt END
    FROM c JOIN n ON n.rn = c.rn + 1)
  SELECT 'RESISTANCE' AS kind, rp AS price, rt AS source_timestamp, end_time AS known_at, rt AS dependency_start FROM c WHERE rp IS NOT NULL
  UNION ALL SELECT 'SUPPORT', sp, st, end_time, st FROM c WHERE sp IS NOT NULL)"""


cte("c_l", c_sql("bars_l1d", "0.03"))
cte("c_e", c_sql("bars_e1h", "0.005"))


@query("detect_C", build(f"SELECT {OUT} FROM c_l"))
def detect_c(spark, sf):
    return out(D.detect(bars_l(spark, sf), "C", 0.03))


@query("detect_C_rolling")
def detect_c_rolling(spark, sf):
    d = D.detect_c_rolling(bars_l(spark, sf), 0.03, 850)
    return d.groupBy("decision_timestamp", "kind").agg(F.count(F.lit(1)).alias("n"), r(F.avg("price")).alias("mean_price"))


@query(
    "detect_D_trades",
    build(f"""WITH b AS (SELECT ts // {4*HOUR} * {4*HOUR} AS w, (CAST(CAST(price AS VARCHAR) AS DECIMAL(20,8)) * 100000000)::BIGINT // 50000000 AS bin, sum(quantity) AS q FROM trade_e GROUP BY ALL),
      m AS (SELECT *, avg(q) OVER (PARTITION BY w) AS mean FROM b)
      SELECT w AS source_timestamp, w + {4*HOUR} AS known_at, round((bin * 0.5::DOUBLE + (bin + 1) * 0.5::DOUBLE) / 2, 6) AS price, round(q, 6) AS quantity, round(q / mean, 6) AS observed_ratio FROM m WHERE q >= mean * 1.5::DOUBLE"""),
)
def detect_d_trades(spark, sf):
    bins = P.window_bins(tape_e(spark, sf), "0.5", 4 * HOUR, "4h", exact=True)
    return d_out(D.detect_d(bins, 4 * HOUR))


def d_out(d):
    return d.select("source_timestamp", "known_at", *[r(c).alias(c) for c in ("price", "quantity", "observed_ratio")])


@query(
    "detect_D_profiles",
    build(f"""WITH b AS (SELECT ts AS w, CAST(floor(price / 5) AS BIGINT) AS bin, sum(quantity) AS q FROM trade_l GROUP BY ALL),
      m AS (SELECT *, avg(q) OVER (PARTITION BY w) AS mean FROM b)
      SELECT w AS source_timestamp, w + {DAY} AS known_at, round((bin * 5::DOUBLE + (bin + 1) * 5::DOUBLE) / 2, 6) AS price, round(q, 6) AS quantity, round(q / mean, 6) AS observed_ratio FROM m WHERE q >= mean * 1.5::DOUBLE"""),
)
def detect_d_profiles(spark, sf):
    bins = P.hourly_bins(P.profile(tape_l(spark, sf), DAY), 5.0)
    d = bins.select("symbol", F.lit("1d").alias("tf"), F.col("hour").alias("window_start"), (F.col("bin") * 5.0).alias("lower"), ((F.col("bin") + 1) * 5.0).alias("upper"), "quantity")
    return d_out(D.detect_d(d, DAY))


@query(
    "candidate_catalog",
    build(f"""SELECT row_number() OVER (ORDER BY known_at, detector, kind, source_timestamp) - 1 AS n, * FROM (
      SELECT 'A' AS detector, {OUT} FROM lev_l UNION ALL SELECT 'B1', * FROM ({b_sql('ext_l1')}) UNION ALL SELECT 'B2', * FROM ({b_sql('ext_l2')}))""").replace("row_number() OVER (ORDER BY known_at, detector, kind, source_timestamp) - 1 AS n, *", "*"),
)
def candidate_catalog(spark, sf):
    c = D.catalog(D.detect_all(bars_l(spark, sf), [("A", None), ("B", 1), ("B", 2)]))
    name = F.concat("detector", F.coalesce(F.col("parameter").cast("long").cast("string"), F.lit("")))
    return out(c.withColumn("detector", name), "detector")


@query("candidate_index", build(f"""SELECT known_at, count(*) AS levels, sum(count(*)) OVER (ORDER BY known_at)::BIGINT AS last_index_plus_one FROM
      (SELECT known_at FROM lev_l UNION ALL SELECT known_at FROM ({b_sql('ext_l1')})) GROUP BY known_at"""))
def candidate_index(spark, sf):
    c = D.catalog(D.detect_all(bars_l(spark, sf), [("A", None), ("B", 1)]))
    return c.groupBy("known_at").agg(F.count(F.lit(1)).alias("levels"), (F.max("candidate_index") + 1).alias("last_index_plus_one"))


@query("prune_catalog", build("SELECT kind, count(*) AS n FROM lev_l l WHERE EXISTS (SELECT 1 FROM bars_l1d b WHERE b.end_time = l.known_at AND b.trade_count > 20) GROUP BY kind"))
def prune_catalog(spark, sf):
    """Keep the levels that a membership (here: decisions on busy days) uses."""
    b = bars_l(spark, sf)
    c = D.catalog(D.detect(b, "A"))
    used = c.join(b.filter("trade_count > 20").select(F.col("end").alias("known_at")), "known_at", "left_semi")
    return D.prune(c, used).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def swing_sql(ext: str, n: int) -> str:
    parts = []
    for side in ("high", "low"):
        parts.append(f"""SELECT '{side}' AS side, b.idx, b.end_time, b.close, last_value(s.idx IGNORE NULLS) OVER w AS src, last_value(s.price IGNORE NULLS) OVER w AS src_price,
          last_value(s.known IGNORE NULLS) OVER w AS src_known, last_value(s.open_time IGNORE NULLS) OVER w AS src_open
          FROM {ext} b LEFT JOIN (SELECT idx, {side} AS price, confirmed AS known, open_time FROM {ext} WHERE full_window AND is_{side}) s ON s.idx + {n} = b.idx
          WINDOW w AS (ORDER BY b.idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
    return " UNION ALL ".join(parts)


for _n in (2, 4, 8):
    cte(f"swing_l{_n}", swing_sql(f"ext_l{_n}", _n))
    cte(f"swing_e{_n}", swing_sql(f"ext_e{_n}", _n))


@query("swing_sources", build("SELECT side, idx, coalesce(src, -1) AS source_idx, round(src_price, 6) AS source_price, coalesce(src_known, -1) AS known_at FROM swing_l4"))
def swing_sources(spark, sf):
    s = D.swing_sources(bars_l(spark, sf), 4)
    return s.select("side", "idx", known("swing.idx", "source_idx"), r("swing.price").alias("source_price"), known("swing.known_at", "known_at"))


@query(
    "construct_zone",
    build("""SELECT 'timeframe' AS model, kind, source_timestamp, round(price * (1 - 0.022::DOUBLE), 9) AS lower, round(price * (1 + 0.022::DOUBLE), 9) AS upper FROM lev_l
      UNION ALL SELECT 'fixed', kind, source_timestamp, round(price * (1 - 0.001::DOUBLE), 9), round(price * (1 + 0.001::DOUBLE), 9) FROM lev_l
      UNION ALL SELECT 'adaptive', kind, source_timestamp, round(price * (1 - f), 9), round(price * (1 + f), 9) FROM lev_l JOIN
        (SELECT end_time, avg((high - low) / close) OVER w AS f, count(*) OVER w AS n FROM bars_l1d WINDOW w AS (ORDER BY idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) a ON a.end_time = known_at AND n = 14"""),
)
def construct_zone(spark, sf):
    b = bars_l(spark, sf)
    lev = D.detect(b, "A")
    z = Z.construct_zone(lev).unionByName(Z.construct_zone(lev, "fixed", 0.001)).unionByName(
        Z.construct_zone(lev, "adaptive", adaptive=Z.mean_range_width(b)).select(*Z.construct_zone(lev).columns)
    )
    return z.select(F.col("width_model").alias("model"), "kind", "source_timestamp", r("lower", 9).alias("lower"), r("upper", 9).alias("upper"))


# ---- visits --------------------------------------------------------------------------


def visit_sql(levels: str, bars: str, w: str, sep: str = "0") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY zone ORDER BY start_idx) AS visit_number FROM (
  SELECT zone, kind, any_value(known_at) AS known_at, any_value(price) AS price, any_value(lower) AS lower, any_value(upper) AS upper, min(idx) AS start_idx, max(idx) AS end_idx, min(open_time) AS start, min(end_time) AS observed_at,
    arg_min(close, idx) AS reference_close, arg_min(prev_close, idx) AS before_close, bool_or(leave) AS ended, max(end_time) FILTER (WHERE leave) AS end_time,
    max(idx) - min(idx) + 1 AS spent, bool_or(touch AND wick) AS wick, bool_or(touch AND close BETWEEN lower AND upper) AS inside,
    max(upper - low) FILTER (WHERE touch) AS pen_a, max(high - lower) FILTER (WHERE touch) AS pen_b, min(close) AS lo_close, max(close) AS hi_close, arg_max(close, idx) AS last_close
  FROM (SELECT *, min(idx) FILTER (WHERE touch) OVER (PARTITION BY zone, seg) AS first_touch FROM (
    SELECT *, coalesce(sum(CASE WHEN leave THEN 1 ELSE 0 END) OVER (PARTITION BY zone ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM (
      SELECT z.*, b.* EXCLUDE (symbol), b.high >= lower AND b.low <= upper AS touch,
        b.close > upper + z.price * {sep}::DOUBLE OR b.close < lower - z.price * {sep}::DOUBLE AS leave,
        (b.low < least(b.open, b.close) AND b.low <= upper AND least(b.open, b.close) >= lower) OR (b.high > greatest(b.open, b.close) AND b.high >= lower AND greatest(b.open, b.close) <= upper) AS wick
      FROM (SELECT symbol, kind, price, known_at, kind || ':' || source_timestamp || ':' || known_at AS zone, price * (1 - {w}::DOUBLE) AS lower, price * (1 + {w}::DOUBLE) AS upper FROM {levels}) z
      JOIN (SELECT symbol, idx, open_time, end_time, open, high, low, close, coalesce(lag(close) OVER (ORDER BY idx), open) AS prev_close FROM {bars}) b
      ON b.open_time >= z.known_at))) WHERE idx >= first_touch GROUP BY zone, kind, seg)"""


cte("vis_e", visit_sql("lev_e1h", "bars_e1h", "0.004"))
cte("vis_sep", visit_sql("lev_e1h", "bars_e1h", "0.001", "0.003"))
APPROACH = "CASE WHEN before_close > upper THEN 'ABOVE' WHEN before_close < lower THEN 'BELOW' ELSE 'INSIDE' END"


def plain_zones(levels, model="timeframe", fraction=None):
    z = Z.construct_zone(levels, model, fraction)
    return z.withColumn("zone_id", F.concat_ws(":", "kind", F.col("source_timestamp").cast("string"), F.col("known_at").cast("string")))


def visits_e(spark, sf, fraction=None, separation=0.0):
    b = bars_e(spark, sf, "1h")
    z = plain_zones(D.detect(b, "A"), "fixed" if fraction else "timeframe", fraction)
    return V.track_visits(z, b, separation, size=0.004)


FACTS_SQL = f"""zone, visit_number, start, observed_at, coalesce(end_time, -1) AS "end", {APPROACH} AS approach, spent AS candles_spent, wick AS wick_touched, inside AS close_entered,
  CASE WHEN {APPROACH} <> 'INSIDE' THEN round(greatest(0, CASE WHEN {APPROACH} = 'ABOVE' THEN pen_a ELSE pen_b END), 6) END AS max_penetration_price,
  CASE WHEN {APPROACH} <> 'INSIDE' THEN round(greatest(0, CASE WHEN {APPROACH} = 'ABOVE' THEN pen_a ELSE pen_b END) / (upper - lower), 6) END AS max_penetration_zone_fraction,
  CASE WHEN {APPROACH} = 'INSIDE' THEN 'unknown' WHEN CASE WHEN {APPROACH} = 'ABOVE' THEN lo_close < lower ELSE hi_close > upper END THEN 'true' ELSE 'false' END AS crossed_through,
  CASE WHEN ended THEN CASE WHEN last_close > upper THEN 'ABOVE' ELSE 'BELOW' END END AS exit_direction,
  CASE WHEN ended THEN 'EXITED' WHEN spent > 1 THEN 'INTERACTING' ELSE 'ENTERED' END AS state,
  CASE WHEN visit_number < 4 THEN CAST(visit_number AS VARCHAR) ELSE '4+' END AS visit_group"""


def facts_out(v):
    return v.select(
        F.col("zone_id").alias("zone"), "visit_number", "start", "observed_at", known("end", "end"), "approach", "candles_spent", "wick_touched", "close_entered",
        r("max_penetration_price").alias("max_penetration_price"), r("max_penetration_zone_fraction").alias("max_penetration_zone_fraction"),
        F.coalesce(F.col("crossed_through").cast("string"), F.lit("unknown")).alias("crossed_through"), "exit_direction", "state", "visit_group",
    )


@query("track_visits", build("SELECT zone, visit_number, start_idx, end_idx, observed_at, ended FROM vis_e"))
def track_visits(spark, sf):
    return visits_e(spark, sf).select(F.col("zone_id").alias("zone"), "visit_number", "start_idx", "end_idx", "observed_at", "ended")


@query("visit_facts", build(f"SELECT {FACTS_SQL} FROM vis_e"))
def visit_facts(spark, sf):
    return facts_out(visits_e(spark, sf))


@query("visit_facts_separation", build(f"SELECT {FACTS_SQL} FROM vis_sep"))
def visit_facts_separation(spark, sf):
    """Narrow zones that are left only .3 % beyond their edge."""
    return facts_out(visits_e(spark, sf, 0.001, 0.003))


@query("visit_indices", build("SELECT zone, start_idx AS entry, end_idx AS exit, ended FROM vis_sep"))
def visit_indices(spark, sf):
    v = visits_e(spark, sf, 0.001, 0.003)
    return v.select(F.col("zone_id").alias("zone"), F.col("start_idx").alias("entry"), F.col("end_idx").alias("exit"), "ended")


@query("visit_group", build("SELECT kind, CASE WHEN visit_number < 4 THEN CAST(visit_number AS VARCHAR) ELSE '4+' END AS visit_group, count(*) AS n FROM vis_e GROUP BY ALL"))
def visit_group(spark, sf):
    v = visits_e(spark, sf).withColumn("kind", F.split("zone_id", ":")[0])
    return v.groupBy("kind", "visit_group").agg(F.count(F.lit(1)).alias("n"))


@query("visit_transitions", build("""SELECT zone, visit_number, 'OUTSIDE@' || start || ',ENTERED@' || observed_at || CASE WHEN spent > 1 THEN ',INTERACTING@' || (observed_at + 3600000) ELSE '' END
      || CASE WHEN ended THEN ',EXITED@' || end_time ELSE '' END AS transitions FROM vis_e"""))
def visit_transitions(spark, sf):
    text = F.array_join(F.transform("transitions", lambda t: F.concat(t["state"], F.lit("@"), t["at"].cast("string"))), ",")
    return visits_e(spark, sf).select(F.col("zone_id").alias("zone"), "visit_number", text.alias("transitions"))


@query("interaction_lifecycle", build("""SELECT sha256(zone || '|' || visit_number) AS interaction_id, coalesce(end_time, -1) AS "end", spent AS candles_spent, coalesce(end_time, -1) AS available_at, end_time IS NULL AS censored FROM vis_e"""))
def interaction_lifecycle(spark, sf):
    d = V.lifecycles(visits_e(spark, sf))
    return d.select("interaction_id", known("end", "end"), "candles_spent", known("available_at", "available_at"), "censored")


# ---- outcomes ------------------------------------------------------------------------


def grid_sql(hs) -> str:
    v = lambda n, xs, t: f"(SELECT unnest([{', '.join(xs)}])::{t} AS {n})"
    return ", ".join(
        [v("direction", [f"'{d}'" for d in DIRECTIONS], "VARCHAR"), v("tp", map(str, TP_SL), "DOUBLE"), v("sl", map(str, TP_SL), "DOUBLE"), v("horizon", map(str, hs), "BIGINT")]
    )


def outcome_sql(events: str, bars: str, step: int, hs, extra: str = "true") -> str:
    """events: event_id, idx, T, P."""
    return f"""SELECT event_id, T, P, idx AS eidx, direction, tp, sl, horizon, CASE WHEN hit IS NOT NULL THEN hit ELSE CASE WHEN n >= horizon THEN 'NEITHER' END END AS label,
  CASE WHEN hit IS NOT NULL THEN hit_at END AS first_hit_at, greatest(0, coalesce(fav, 0)) * 100 AS mfe_pct, greatest(0, coalesce(adv, 0)) * 100 AS mae_pct,
  CASE WHEN fav > 0 THEN fav_k * {step} END AS time_to_mfe_ms, CASE WHEN adv > 0 THEN adv_k * {step} END AS time_to_mae_ms, n AS observed_candles, n < horizon AS censored, T + n * {step} AS measured_until
FROM (SELECT event_id, T, P, idx, direction, tp, sl, horizon, count(k) AS n, arg_min(lab, k) FILTER (WHERE lab IS NOT NULL) AS hit, arg_min(hat, k) FILTER (WHERE lab IS NOT NULL) AS hit_at,
  max(f) AS fav, max(a) AS adv, arg_max(k, ROW(f, -k)) FILTER (WHERE f IS NOT NULL) AS fav_k, arg_max(k, ROW(a, -k)) FILTER (WHERE a IS NOT NULL) AS adv_k FROM (
  SELECT e.*, b.k, CASE WHEN direction = 'LONG' THEN b.high / P - 1 ELSE 1 - b.low / P END AS f, CASE WHEN direction = 'LONG' THEN 1 - b.low / P ELSE b.high / P - 1 END AS a,
    CASE WHEN direction = 'LONG' THEN CASE WHEN b.open >= P * (1 + tp) THEN 'TP_FIRST' WHEN b.open <= P * (1 - sl) THEN 'SL_FIRST' WHEN b.high >= P * (1 + tp) AND b.low <= P * (1 - sl) THEN 'AMBIGUOUS' WHEN b.high >= P * (1 + tp) THEN 'TP_FIRST' WHEN b.low <= P * (1 - sl) THEN 'SL_FIRST' END
      ELSE CASE WHEN b.open <= P * (1 - tp) THEN 'TP_FIRST' WHEN b.open >= P * (1 + sl) THEN 'SL_FIRST' WHEN b.low <= P * (1 - tp) AND b.high >= P * (1 + sl) THEN 'AMBIGUOUS' WHEN b.low <= P * (1 - tp) THEN 'TP_FIRST' WHEN b.high >= P * (1 + sl) THEN 'SL_FIRST' END END AS lab,
    CASE WHEN CASE WHEN direction = 'LONG' THEN b.open >= P * (1 + tp) OR b.open <= P * (1 - sl) ELSE b.open <= P * (1 - tp) OR b.open >= P * (1 + sl) END THEN T + (b.k - 1) * {step} ELSE T + b.k * {step} END AS hat
  FROM (SELECT * FROM {events}, {grid_sql(hs)}) e LEFT JOIN (SELECT s.event_id AS jid, x.idx - s.idx AS k, x.open, x.high, x.low FROM {events} s JOIN {bars} x ON x.symbol = s.symbol AND x.idx > s.idx AND x.idx <= s.idx + {max(hs)} AND {extra}) b
    ON b.jid = e.event_id AND b.k <= e.horizon) GROUP BY ALL)"""


cte("ev_e1h", "SELECT symbol || ':' || end_time AS event_id, symbol, idx, end_time AS T, close AS P FROM bars_e1h")
cte("ev_t4h", "SELECT symbol || ':' || end_time AS event_id, symbol, idx, end_time AS T, close AS P FROM bars_t4h")
cte("ev_l", "SELECT symbol || ':' || end_time AS event_id, symbol, idx, end_time AS T, close AS P FROM bars_l1d")
cte("out_e", outcome_sql("ev_e1h", "bars_e1h", HOUR, HORIZONS["1h"]))
cte("out_t", outcome_sql("ev_t4h", "bars_t4h", 4 * HOUR, HORIZONS["4h"]))
cte("out_l", outcome_sql("ev_l", "bars_l1d", DAY, HORIZONS["1d"]))


def plain_events(bars):
    return O.bar_events(bars).withColumn("event_id", F.concat_ws(":", "symbol", F.col("T").cast("string")))


def outcomes_e(spark, sf):
    b = bars_e(spark, sf, "1h")
    return O.measure(plain_events(b), b, HORIZONS["1h"])


def outcomes_l(spark, sf):
    b = bars_l(spark, sf)
    return O.measure(plain_events(b), b, HORIZONS["1d"])


GRID = "event_id, direction, tp, sl, horizon"
G = GRID.split(", ")


@query("measure_outcome", build(f"SELECT {GRID}, label, coalesce(first_hit_at, -1) AS first_hit_at, censored, observed_candles, measured_until FROM out_e"))
def measure_outcome(spark, sf):
    return outcomes_e(spark, sf).select(*G, "label", known("first_hit_at", "first_hit_at"), "censored", "observed_candles", "measured_until")


@query("excursions", build(f"SELECT {GRID}, round(mfe_pct, 6) AS mfe_pct, round(mae_pct, 6) AS mae_pct, coalesce(time_to_mfe_ms, -1) AS time_to_mfe_ms, coalesce(time_to_mae_ms, -1) AS time_to_mae_ms FROM out_e"))
def excursions(spark, sf):
    return outcomes_e(spark, sf).select(*G, r("mfe_pct").alias("mfe_pct"), r("mae_pct").alias("mae_pct"), known("time_to_mfe_ms", "time_to_mfe_ms"), known("time_to_mae_ms", "time_to_mae_ms"))


@query("outcome_grid", build("SELECT direction, tp, sl, horizon, coalesce(label, 'CENSORED') AS label, count(*) AS n FROM out_t GROUP BY ALL"))
def outcome_grid(spark, sf):
    b = bars_e(spark, sf, "4h", by_type=True)
    o = O.measure(plain_events(b), b, HORIZONS["4h"])
    return o.groupBy("direction", "tp", "sl", "horizon", F.coalesce("label", F.lit("CENSORED")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


PHASE_END = T0 + 20 * DAY
cte("out_phase", outcome_sql("ev_e1h", "bars_e1h", HOUR, HORIZONS["1h"], f"x.end_time <= {PHASE_END}"))


@query("outcome_phase_end", build("SELECT horizon, censored, count(*) AS n, count(label) AS labelled, sum(observed_candles)::BIGINT AS bars FROM out_phase GROUP BY ALL"))
def outcome_phase_end(spark, sf):
    b = bars_e(spark, sf, "1h")
    o = O.measure(plain_events(b), b, HORIZONS["1h"], phase_end=PHASE_END)
    return o.groupBy("horizon", "censored").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.sum("observed_candles").alias("bars"))


@query("schedule_controls", build("SELECT symbol, end_time AS T, round(close, 6) AS P FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS n FROM bars_t1h) WHERE (n - 1) % 6 = 0"))
def schedule_controls(spark, sf):
    return O.schedule_controls(bars_e(spark, sf, "1h", by_type=True), 6).select("symbol", "T", r("P").alias("P"))


@query("sequence_join_future", build("SELECT e.T, x.idx - e.idx AS k, round(x.close, 6) AS close FROM ev_e1h e JOIN bars_e1h x ON x.idx > e.idx AND x.idx <= e.idx + 4"))
def sequence_join_future(spark, sf):
    b = bars_e(spark, sf, "1h")
    e = plain_events(b).select("symbol", "T", F.col("idx").alias("at"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    j = e.withColumn("idx", F.col("at") + F.col("k")).join(b.select("symbol", "idx", "close"), ["symbol", "idx"])
    return j.select("T", long("k").alias("k"), r("close").alias("close"))


@query("measurement_view", build("""SELECT sha256('outcome-v1|' || i.zone || '|' || i.visit_number || '|' || o.event_id || '|' || o.direction || '|' || CAST(round(o.tp * 1000) AS BIGINT) || '|' || CAST(round(o.sl * 1000) AS BIGINT) || '|' || o.horizon) AS measurement_id, o.label
      FROM vis_sep i JOIN out_e o ON o.T = i.observed_at"""))
def measurement_view(spark, sf):
    """Interactions joined with outcomes lazily: the id is computed, nothing is materialised."""
    v = visits_e(spark, sf, 0.001, 0.003).withColumnRenamed("observed_at", "timestamp")
    v.createOrReplaceTempView("tidemark_interactions")
    outcomes_e(spark, sf).createOrReplaceTempView("tidemark_outcomes")
    return spark.sql(
        """SELECT sha2(concat_ws('|', 'outcome-v1', i.zone_id, i.visit_number, o.event_id, o.direction, CAST(round(o.tp * 1000) AS BIGINT),
             CAST(round(o.sl * 1000) AS BIGINT), o.horizon), 256) AS measurement_id, o.label
           FROM tidemark_interactions i JOIN tidemark_outcomes o ON i.timestamp = o.timestamp"""
    )


@query("truncation_check", build("SELECT NULL::VARCHAR AS kind, NULL::DOUBLE AS price, NULL::BIGINT AS known_at, NULL::VARCHAR AS side WHERE false"))
def truncation_check(spark, sf):
    """Detectors A, B and C lose nothing and gain nothing when the future is removed."""
    cut = T0 + 17 * DAY
    b = bars_e(spark, sf, "1h")
    configs = [("A", None), ("B", 2), ("C", 0.005)]
    cols = ["detector", "kind", "price", "source_timestamp", "known_at"]
    full = D.detect_all(b, configs).select(*cols)
    part = D.detect_all(Q.closed_only(b, cut), configs).select(*cols)
    return Q.truncation_check(full, part, "known_at", cut).select("kind", "price", "known_at", "side")


@query("invariant_audit", build("SELECT unnest(['known_after_source', 'price_positive', 'label_iff_complete', 'hit_after_T', 'excursion_not_negative']) AS rule, 0::BIGINT AS violations"))
def invariant_audit(spark, sf):
    lev = Q.rules(D.detect(bars_e(spark, sf, "1h"), "A"), {"known_after_source": F.col("known_at") > F.col("source_timestamp"), "price_positive": F.col("price") > 0})
    o = Q.rules(
        outcomes_e(spark, sf),
        {
            "label_iff_complete": F.col("censored") | F.col("label").isNotNull(),
            "hit_after_T": F.col("first_hit_at").isNull() | (F.col("first_hit_at") >= F.col("timestamp")),
            "excursion_not_negative": (F.col("mfe_pct") >= 0) & (F.col("mae_pct") >= 0),
        },
    )
    return lev.unionByName(o)
