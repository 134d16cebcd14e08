"""Joins, context, buckets, metrics, percentiles, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import DAY, HORIZONS, HOUR, WEEK
from tidemark.functions.columns import bucket_left, known, long, normalized_delta, percent_bucket, quarter_of, r, shape_bucket, sign_bucket, week_of
from tidemark.operators import context as C
from tidemark.operators import joins as J
from tidemark.operators import outcomes as O
from tidemark.operators import profiles as P
from tidemark.operators import resampling as R
from tidemark.operators import stats as S
from tidemark.operators import visits as V
from tidemark.plans import q_levels, q_map, q_volume
from tidemark.plans.base import T0, bars_e, bars_l, tape_e, tape_l
from tidemark.plans.q_levels import outcomes_e, outcomes_l, plain_events, visits_e
from tidemark.plans.registry import build, cte, query

FIT_E = T0 + 15 * DAY


def context_sql(bars: str, n: int = 24) -> str:
    return f"""SELECT symbol, idx, end_time AS T, close AS P, symbol || ':' || end_time AS event_id, stddev_pop(ret) OVER w AS volatility, close / first_value(close) OVER w1 - 1 AS recent_return, count(ret) OVER w AS n
  FROM (SELECT *, CASE WHEN lag(idx) OVER o = idx - 1 THEN ln(close / lag(close) OVER o) END AS ret FROM {bars} WINDOW o AS (PARTITION BY symbol ORDER BY idx))
  WINDOW w AS (PARTITION BY symbol ORDER BY idx RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW), w1 AS (PARTITION BY symbol ORDER BY idx RANGE BETWEEN {n} PRECEDING AND CURRENT ROW)"""


cte("ctx_e", f"SELECT * FROM ({context_sql('bars_e1h')}) WHERE n = 24")
cte("ctx_l", f"SELECT * FROM ({context_sql('bars_l1d')}) WHERE n = 24")


def ctx(bars):
    c = C.context_features(bars)
    return c.withColumn("event_id", F.concat_ws(":", "symbol", F.col("timestamp").cast("string")))


@query("context_features", build("SELECT T AS timestamp, round(volatility, 6) AS volatility, round(recent_return, 6) AS recent_return FROM ctx_e"))
def context_features(spark, sf):
    return ctx(bars_e(spark, sf, "1h")).select("timestamp", r("volatility").alias("volatility"), r("recent_return").alias("recent_return"))


FIELDS = ("volatility", "recent_return")


def cuts_sql(src: str, where: str, probs="[0.25, 0.5, 0.75]") -> str:
    return f"SELECT quantile_cont(volatility, {probs}) AS vc, quantile_cont(recent_return, {probs}) AS rc, count(*) AS n FROM {src} WHERE {where}"


cte("model_e", cuts_sql("ctx_e", f"T < {FIT_E}"))
cte("model_l", cuts_sql("ctx_l", "true"))


def model_e(spark, sf, c):
    return C.fit_quantiles(c.filter(F.col("timestamp") < FIT_E), FIELDS, 4, FIT_E)


@query("fit_quantiles", build("""SELECT 'volatility' AS field, round(vc[1], 6) AS q1, round(vc[2], 6) AS q2, round(vc[3], 6) AS q3, n AS sample_count FROM model_e
  UNION ALL SELECT 'recent_return', round(rc[1], 6), round(rc[2], 6), round(rc[3], 6), n FROM model_e"""))
def fit_quantiles(spark, sf):
    m = model_e(spark, sf, ctx(bars_e(spark, sf, "1h")))
    return m.select("field", *[r(F.col("cuts")[i]).alias(f"q{i+1}") for i in range(3)], "sample_count")


def label_sql(v, c):
    return f"'Q' || CAST(1 + CASE WHEN {v} >= {c}[1] THEN 1 ELSE 0 END + CASE WHEN {v} >= {c}[2] THEN 1 ELSE 0 END + CASE WHEN {v} >= {c}[3] THEN 1 ELSE 0 END AS VARCHAR)"


cte("buck_e", f"SELECT c.*, {label_sql('volatility', 'vc')} AS vb, {label_sql('recent_return', 'rc')} AS rb FROM ctx_e c, model_e")
cte("buck_l", f"SELECT c.*, {label_sql('volatility', 'vc')} AS vb, {label_sql('recent_return', 'rc')} AS rb FROM ctx_l c, model_l")


def bucketed_e(spark, sf):
    c = ctx(bars_e(spark, sf, "1h"))
    return C.apply_buckets(c, model_e(spark, sf, c), FIELDS)


def bucketed_l(spark, sf):
    c = ctx(bars_l(spark, sf))
    return C.apply_buckets(c, C.fit_quantiles(c, FIELDS, 4), FIELDS)


@query("apply_buckets", build("SELECT T AS timestamp, vb AS volatility_bucket, rb AS recent_return_bucket FROM buck_e"))
def apply_buckets(spark, sf):
    return bucketed_e(spark, sf).select("timestamp", "volatility_bucket", "recent_return_bucket")


@query("fit_transform_freeze", build(f"SELECT vb AS volatility_bucket, T >= {FIT_E} AS replication, count(*) AS n FROM buck_e GROUP BY ALL"))
def fit_transform_freeze(spark, sf):
    """The model is written once and read back; later rows are bucketed by the frozen cuts."""
    from tidemark.session import materialize

    c = ctx(bars_e(spark, sf, "1h"))
    frozen = materialize(model_e(spark, sf, c), "model")
    d = C.apply_buckets(c, frozen, FIELDS)
    return d.groupBy("volatility_bucket", (F.col("timestamp") >= FIT_E).alias("replication")).agg(F.count(F.lit(1)).alias("n"))


@query("sign_bucket", build("SELECT T, sb AS sign_bucket, CASE WHEN sb = 2 AND recent_return > 0.02::DOUBLE THEN 3 ELSE sb END AS shape_bucket FROM (SELECT *, CASE WHEN recent_return < -0.01::DOUBLE THEN 0 WHEN recent_return > 0.01::DOUBLE THEN 2 ELSE 1 END::BIGINT AS sb FROM ctx_e)"))
def sign_bucket_(spark, sf):
    v = F.col("recent_return")
    return ctx(bars_e(spark, sf, "1h")).select(F.col("timestamp").alias("T"), sign_bucket(v).alias("sign_bucket"), shape_bucket(v, F.lit(0.02)).alias("shape_bucket"))


cte("regm", f"SELECT quantile_cont(volatility, [0.25, 0.75]) AS vc, quantile_cont(abs(recent_return), 0.25) AS z FROM ctx_e WHERE T < {T0 + 10*DAY}")
cte("reg_e", f"""SELECT c.*, CASE WHEN T < {T0 + 10*DAY} THEN 'CALIBRATION' WHEN volatility < vc[1] THEN 'LOW' WHEN volatility < vc[2] THEN 'MIDDLE' ELSE 'HIGH' END AS vr,
  CASE WHEN T < {T0 + 10*DAY} THEN 'CALIBRATION' WHEN recent_return < -z THEN 'NEGATIVE' WHEN recent_return > z THEN 'POSITIVE' ELSE 'NEUTRAL' END AS rr FROM ctx_e c, regm""")


def regimes_e(spark, sf):
    c = ctx(bars_e(spark, sf, "1h"))
    return C.regimes(c, C.fit_regimes(c, T0 + 10 * DAY), T0 + 10 * DAY)


@query("regime_columns", build("SELECT T AS timestamp, vr AS volatility_regime, rr AS return_regime FROM reg_e"))
def regime_columns(spark, sf):
    return regimes_e(spark, sf).select("timestamp", "volatility_regime", "return_regime")


@query("asof_matched_control", build("""SELECT t.T AS target, max(p.T) AS control FROM buck_e t JOIN buck_e p ON p.vb = t.vb AND p.rb = t.rb AND p.T + 28800000 <= t.T GROUP BY 1"""))
def asof_matched_control(spark, sf):
    b = bucketed_e(spark, sf)
    m = C.matched_control(b, b, ["volatility_bucket", "recent_return_bucket"], 8 * HOUR, 7 * DAY)
    return m.join(b.select("event_id", F.col("timestamp").alias("target")), "event_id").select("target", F.col("control_timestamp").alias("control"))


@query("match_within_regime", build("SELECT t.T AS target, max(p.T) AS control FROM reg_e t JOIN reg_e p ON p.vr = t.vr AND p.rr = t.rr AND p.T + 14400000 <= t.T WHERE t.vr <> 'CALIBRATION' GROUP BY 1"))
def match_within_regime(spark, sf):
    b = regimes_e(spark, sf).filter("volatility_regime <> 'CALIBRATION'")
    m = C.matched_control(b, b, ["volatility_regime", "return_regime"], 4 * HOUR, 7 * DAY)
    return m.join(b.select("event_id", F.col("timestamp").alias("target")), "event_id").select("target", F.col("control_timestamp").alias("control"))


@query("matched_tables", build("""WITH m AS (SELECT h, t.event_id AS target, arg_max(p.event_id, p.T) AS control FROM buck_e t JOIN (SELECT unnest([4, 8, 24]) AS h) ON true JOIN buck_e p ON p.vb = t.vb AND p.rb = t.rb AND p.T + h * 3600000 <= t.T GROUP BY 1, 2)
  SELECT o.direction, o.tp, o.sl, o.horizon, count(*) AS matched_target_count, count(DISTINCT m.control) AS unique_controls, round(count(*) FILTER (WHERE c.label = 'TP_FIRST') / count(*) FILTER (WHERE NOT c.censored), 6) AS control_tp_rate,
  round(count(*) FILTER (WHERE o.label = 'TP_FIRST' AND NOT o.censored) / count(*) FILTER (WHERE NOT o.censored), 6) AS target_tp_rate
  FROM m JOIN out_e o ON o.event_id = m.target AND o.horizon = h JOIN out_e c ON c.event_id = m.control AND c.horizon = h AND c.direction = o.direction AND c.tp = o.tp AND c.sl = o.sl GROUP BY ALL"""))
def matched_tables(spark, sf):
    b = bucketed_e(spark, sf)
    keys = ["volatility_bucket", "recent_return_bucket"]
    apart = [C.matched_control(b, b, keys, h * HOUR, 7 * DAY).withColumn("horizon", F.lit(h)) for h in HORIZONS["1h"]]  # as far as the outcome looks
    m = apart[0].unionByName(apart[1]).unionByName(apart[2])
    o = outcomes_e(spark, sf).select("event_id", *S.GRID, "label", "censored")
    c = o.select(F.col("event_id").alias("control_event_id"), *S.GRID, F.col("label").alias("cl"), F.col("censored").alias("cc"))
    j = m.join(o, ["event_id", "horizon"]).join(c, ["control_event_id", *S.GRID])
    rate = lambda l, x: r(F.count(F.when((F.col(l) == "TP_FIRST") & ~F.col(x), 1)) / F.count(F.when(~F.col(x), 1)))
    return j.groupBy(*S.GRID).agg(F.count(F.lit(1)).alias("matched_target_count"), F.count_distinct("control_event_id").alias("unique_controls"), rate("cl", "cc").alias("control_tp_rate"), rate("label", "censored").alias("target_tp_rate"))


# ---- joins ---------------------------------------------------------------------------


@query("join_inner_using", build("SELECT event_id, direction, tp, sl, horizon, label, round(volatility, 6) AS volatility FROM out_e JOIN ctx_e USING (event_id)"))
def join_inner_using(spark, sf):
    o = outcomes_e(spark, sf)
    return o.join(ctx(bars_e(spark, sf, "1h")).select("event_id", "volatility"), "event_id").select("event_id", *S.GRID, "label", r("volatility").alias("volatility"))


@query("join_validated", build("SELECT direction, vb AS volatility_bucket, count(*) AS n FROM out_e JOIN buck_e USING (event_id) GROUP BY ALL"))
def join_validated(spark, sf):
    j = J.join_validated(outcomes_e(spark, sf), bucketed_e(spark, sf).select("event_id", "volatility_bucket"), ["event_id"])
    return j.groupBy("direction", "volatility_bucket").agg(F.count(F.lit(1)).alias("n"))


@query("join_left_required", build("SELECT T AS timestamp, round(P, 6) AS P FROM ctx_e"))
def join_left_required(spark, sf):
    b = bars_e(spark, sf, "1h")
    j = J.join_required(ctx(b).select("event_id", "timestamp"), plain_events(b).select("event_id", "P"), ["event_id"])
    return j.select("timestamp", r("P").alias("P"))


@query("join_outer_compare", build(f"""SELECT coalesce(a.k, b.k) AS "window", coalesce(a.n, -1) AS n_dev, coalesce(b.n, -1) AS n_rep FROM (SELECT round(quantity, 6) AS k, count(*) AS n FROM trade_e WHERE ts < {FIT_E} GROUP BY 1) a
  FULL JOIN (SELECT round(quantity, 6) AS k, count(*) AS n FROM trade_e WHERE ts >= {FIT_E} GROUP BY 1) b ON a.k = b.k"""))
def join_outer_compare(spark, sf):
    t = tape_e(spark, sf).groupBy(r("quantity").alias("window"), (F.col("timestamp") < FIT_E).alias("dev")).agg(F.count(F.lit(1)).alias("n"))
    j = J.outer_compare(t.filter("dev"), t.filter("not dev"), ["window"], ["n"])
    return j.select("window", known("n_dev", "n_dev"), known("n_rep", "n_rep"))


@query("join_semi_used", build("SELECT T FROM ev_e1h e WHERE EXISTS (SELECT 1 FROM vis_sep v WHERE v.observed_at = e.T)"))
def join_semi_used(spark, sf):
    v = visits_e(spark, sf, 0.001, 0.003).select(F.col("observed_at").alias("T"))
    return plain_events(bars_e(spark, sf, "1h")).join(v, "T", "left_semi").select("T")


@query("join_anti_missing", build("SELECT T FROM ev_e1h e WHERE T NOT IN (SELECT T FROM ctx_e)"))
def join_anti_missing(spark, sf):
    b = bars_e(spark, sf, "1h")
    return plain_events(b).join(ctx(b).select(F.col("timestamp").alias("T")), "T", "left_anti").select("T")


@query("join_cross_grid", build(f"SELECT event_id, direction, tp, sl, horizon FROM ev_t4h, {q_levels.grid_sql(HORIZONS['4h'])}"))
def join_cross_grid(spark, sf):
    e = plain_events(bars_e(spark, sf, "4h", by_type=True))
    return O.grid_frame(e.select("event_id"), HORIZONS["4h"])


cte("clock15", "SELECT symbol, end_time AS T, close AS P FROM bars_e15m")


@query("asof_latest_closed", build("SELECT c.T, max(b.end_time) AS source_timestamp FROM clock15 c JOIN bars_e4h b ON b.end_time <= c.T AND c.T - b.end_time < 14400000 GROUP BY 1"))
def asof_latest_closed(spark, sf):
    q = bars_e(spark, sf, "15m").select("symbol", F.col("end").alias("T"))
    s = bars_e(spark, sf, "4h").select("symbol", F.col("end").alias("T2"))
    return J.asof_latest_closed(q, s, 4 * HOUR, "T", "T2").select("T", "source_timestamp")


@query("asof_price", build("SELECT t.id, round(arg_max(c.P, c.T), 6) AS price FROM trade_e t JOIN clock15 c ON c.T <= t.ts AND t.ts - c.T < 86400000 GROUP BY 1"))
def asof_price(spark, sf):
    """Latest 15m close at or before each trade; the clock has holes, so the close is carried forward per day chunk."""
    from pyspark.sql import Window

    t = tape_e(spark, sf).select("symbol", "id", F.col("timestamp").alias("t"), F.lit(1).alias("o"), F.lit(None).cast("struct<T:bigint,P:double>").alias("s"))
    c = bars_e(spark, sf, "15m").select("symbol", F.lit(None).cast("long").alias("id"), F.col("end").alias("t"), F.lit(0).alias("o"), F.struct(F.col("end").alias("T"), F.col("close").alias("P")).alias("s"))
    d = t.unionByName(c).withColumn("_c", F.floor(F.col("t") / DAY))
    tail = d.groupBy("symbol", "_c").agg(F.max("s").alias("_t"))
    prev = Window.partitionBy("symbol").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    tail = tail.withColumn("_carry", F.max("_t").over(prev)).drop("_t")
    local = Window.partitionBy("symbol", "_c").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("s", F.max("s").over(local)).filter("o = 1").join(tail, ["symbol", "_c"], "left").withColumn("s", F.coalesce("s", "_carry"))
    return d.filter("s is not null").select("id", r("s.P").alias("price"))


# ---- metrics -------------------------------------------------------------------------

MOVES = S.MOVES


def metric_sql(src: str, keys: str, eb: str | None = None) -> str:
    q = lambda m, p: f"round(quantile_cont({m}::DOUBLE, {p}) FILTER (WHERE NOT censored), 4)"
    cols = ["count(*) AS measurement_count", "count(DISTINCT event_id) AS unique_event_count", "round(avg(censored::INT), 6) AS censored_rate", "count(*) FILTER (WHERE NOT censored) AS complete_measurement_count"]
    for l in ("TP_FIRST", "SL_FIRST", "NEITHER", "AMBIGUOUS"):
        cols.append(f"round(count(*) FILTER (WHERE NOT censored AND label = '{l}') / count(*) FILTER (WHERE NOT censored), 6) AS {l.lower()}_rate")
    for m in MOVES:
        cols += [f"round(avg({m}) FILTER (WHERE NOT censored), 4) AS {m}_mean", f"{q(m, 0.1)} AS {m}_q10", f"{q(m, 0.5)} AS {m}_median", f"{q(m, 0.9)} AS {m}_q90"]
    hit = "NOT censored AND label IN ('TP_FIRST', 'SL_FIRST')"
    cols += [f"count(*) FILTER (WHERE {hit}) AS resolved_measurement_count", f"round(avg(CASE WHEN label = 'TP_FIRST' THEN tp ELSE -sl END) FILTER (WHERE {hit}) * 100, 6) + 0.0::DOUBLE AS gross_boundary_expectancy_conditional_pct"]
    return f"SELECT {keys}, {', '.join(cols)} FROM {src} GROUP BY {keys}"


OUTS = [f"{m}_{s}" for m in MOVES for s in ("mean", "q10", "median", "q90")]


def metric_out(d, *keys):
    whole = ["measurement_count", "unique_event_count", "complete_measurement_count", "resolved_measurement_count"]
    rates = ["censored_rate", "tp_first_rate", "sl_first_rate", "neither_rate", "ambiguous_rate", "gross_boundary_expectancy_conditional_pct"]
    return d.select(*keys, *[long(c).alias(c) for c in whole], *[r(c).alias(c) for c in rates], *[r(c, 4).alias(c) for c in OUTS])


@query("metrics", build(metric_sql("out_e", "direction, tp, sl, horizon")))
def metrics(spark, sf):
    return metric_out(S.metrics(outcomes_e(spark, sf), S.GRID), *S.GRID)


@query("summary_by", build(metric_sql("(SELECT o.*, CASE WHEN vb = 'Q4' THEN NULL ELSE vb END AS bucket FROM out_e o JOIN buck_e USING (event_id))", "bucket, horizon")))
def summary_by(spark, sf):
    """A null key is a group of its own."""
    b = bucketed_e(spark, sf).select("event_id", F.when(F.col("volatility_bucket") != "Q4", F.col("volatility_bucket")).alias("bucket"))
    return metric_out(S.metrics(outcomes_e(spark, sf).join(b, "event_id"), ["bucket", "horizon"]), "bucket", "horizon")


cte("vis_out", "SELECT v.kind, v.visit_number, o.* FROM vis_sep v JOIN out_e o ON o.T = v.observed_at")


@query("weighted_metrics", build(metric_sql("vis_out", "kind, direction, tp, sl, horizon")))
def weighted_metrics(spark, sf):
    """Visits are counted per event first; outcomes join the counts, not the visits."""
    v = visits_e(spark, sf, 0.001, 0.003).select(F.split("zone_id", ":")[0].alias("kind"), F.concat_ws(":", "symbol", F.col("observed_at").cast("string")).alias("event_id"))
    w = S.multiplicity(v, "kind")
    keys = ("kind", *S.GRID)
    return metric_out(S.metrics(w.join(outcomes_e(spark, sf), "event_id"), keys, "weight"), *keys)


@query("event_balanced_metrics", build("""SELECT kind, direction, tp, sl, horizon, round(avg(censored::INT), 6) AS event_balanced_censored_rate, round(count(*) FILTER (WHERE NOT censored AND label = 'TP_FIRST') / count(*) FILTER (WHERE NOT censored), 6) AS event_balanced_tp_first_rate
  FROM (SELECT DISTINCT kind, event_id, direction, tp, sl, horizon, censored, label FROM vis_out) GROUP BY ALL"""))
def event_balanced_metrics(spark, sf):
    v = visits_e(spark, sf, 0.001, 0.003).select(F.split("zone_id", ":")[0].alias("kind"), F.concat_ws(":", "symbol", F.col("observed_at").cast("string")).alias("event_id"))
    keys = ("kind", *S.GRID)
    m = S.metrics(S.multiplicity(v, "kind").join(outcomes_e(spark, sf), "event_id"), keys, "weight")
    return m.select(*keys, r("event_balanced_censored_rate").alias("event_balanced_censored_rate"), r("event_balanced_tp_first_rate").alias("event_balanced_tp_first_rate"))


@query("multiplicity_preagg", build("SELECT kind, 'ALL:' || observed_at AS event_id, count(*) AS weight FROM vis_sep GROUP BY ALL"))
def multiplicity_preagg(spark, sf):
    v = visits_e(spark, sf, 0.001, 0.003).select(F.split("zone_id", ":")[0].alias("kind"), F.concat_ws(":", "symbol", F.col("observed_at").cast("string")).alias("event_id"))
    return S.multiplicity(v, "kind")


def rows_l(spark, sf):
    b = bucketed_l(spark, sf).select("event_id", "volatility_bucket", "recent_return_bucket", "volatility", "recent_return")
    o = outcomes_l(spark, sf).join(b, "event_id")
    return o.withColumn("week", week_of(F.col("timestamp"))).withColumn("quarter", quarter_of(F.col("timestamp")))


cte("rows_l", f"""SELECT o.*, b.vb, b.rb, b.volatility, b.recent_return, o.T // {WEEK} AS week, year(make_timestamp(o.T * 1000)) || '-Q' || quarter(make_timestamp(o.T * 1000)) AS quarter FROM out_l o JOIN buck_l b USING (event_id)""")


@query("summarize_dims", build("""SELECT direction, horizon, 'ALL' AS "table", 'ALL' AS bucket, count(*) AS n, count(*) FILTER (WHERE NOT censored) AS complete, count(*) FILTER (WHERE NOT censored AND label = 'TP_FIRST') AS "TP_FIRST" FROM rows_l GROUP BY direction, horizon
  UNION ALL SELECT direction, horizon, 'volatility_bucket', vb, count(*), count(*) FILTER (WHERE NOT censored), count(*) FILTER (WHERE NOT censored AND label = 'TP_FIRST') FROM rows_l GROUP BY ALL
  UNION ALL SELECT direction, horizon, 'recent_return_bucket', rb, count(*), count(*) FILTER (WHERE NOT censored), count(*) FILTER (WHERE NOT censored AND label = 'TP_FIRST') FROM rows_l GROUP BY ALL"""))
def summarize_dims(spark, sf):
    return S.summarize_dims(rows_l(spark, sf), ["direction", "horizon"], ["volatility_bucket", "recent_return_bucket"])


CELL = """count(*) AS state_count, count(*) FILTER (WHERE NOT censored) AS complete, count(*) FILTER (WHERE NOT censored AND label = 'TP_FIRST') AS "TP_FIRST", count(*) FILTER (WHERE NOT censored AND label = 'SL_FIRST') AS "SL_FIRST",
  round(avg(mfe_pct) FILTER (WHERE NOT censored), 6) AS mfe_pct, round(count(*) FILTER (WHERE NOT censored AND label = 'TP_FIRST') / nullif(count(*) FILTER (WHERE NOT censored), 0), 6) AS tp_first_rate"""


def cell_out(d, *keys):
    return d.select(*keys, "state_count", "complete", "TP_FIRST", "SL_FIRST", r("mfe_pct").alias("mfe_pct"), r("tp_first_rate").alias("tp_first_rate"))


@query("metric_table", build(f"SELECT vb AS volatility_bucket, direction, tp, sl, horizon, {CELL} FROM rows_l GROUP BY ALL"))
def metric_table(spark, sf):
    keys = ("volatility_bucket", *S.GRID)
    return cell_out(S.cell_sums(rows_l(spark, sf), *keys), *keys)


@query("period_all_plus_quarters", build(f"SELECT period, vb AS volatility_bucket, direction, horizon, {CELL} FROM (SELECT *, unnest(['ALL', quarter]) AS period FROM rows_l) GROUP BY ALL"))
def period_all_plus_quarters(spark, sf):
    keys = ("period", "volatility_bucket", "direction", "horizon")
    return cell_out(S.cell_sums(S.all_plus_periods(rows_l(spark, sf)), *keys), *keys)


@query("outcome_cell_sums", build(f"""SELECT vb AS volatility_bucket, rb AS recent_return_bucket, direction, tp, sl, horizon, "TP_FIRST", "SL_FIRST", complete, round(100 * ("TP_FIRST" * tp - "SL_FIRST" * sl) / nullif("TP_FIRST" + "SL_FIRST", 0), 6) AS gross_resolved_expectancy_pct
  FROM (SELECT vb, rb, direction, tp, sl, horizon, {CELL} FROM rows_l GROUP BY ALL)"""))
def outcome_cell_sums(spark, sf):
    keys = ("volatility_bucket", "recent_return_bucket", *S.GRID)
    d = S.with_expectancy(S.cell_sums(rows_l(spark, sf), *keys))
    return d.select(*keys, "TP_FIRST", "SL_FIRST", "complete", r("gross_resolved_expectancy_pct").alias("gross_resolved_expectancy_pct"))


@query("compare_event_control", build("""WITH s AS (SELECT o.*, EXISTS (SELECT 1 FROM vis_sep v WHERE v.observed_at = o.T) AS ev, (row_number() OVER (PARTITION BY direction, tp, sl, horizon ORDER BY T) - 1) % 6 = 0 AS ctl FROM out_e o)
  SELECT *, round(event_rate - control_rate, 6) AS difference FROM (SELECT direction, tp, sl, horizon, count(*) FILTER (WHERE ev AND NOT censored) AS events, count(*) FILTER (WHERE ctl AND NOT censored) AS controls, round(count(*) FILTER (WHERE ev AND label = 'TP_FIRST' AND NOT censored) / count(*) FILTER (WHERE ev AND NOT censored), 6) AS event_rate, round(count(*) FILTER (WHERE ctl AND label = 'TP_FIRST' AND NOT censored) / count(*) FILTER (WHERE ctl AND NOT censored), 6) AS control_rate FROM s GROUP BY ALL)"""))
def compare_event_control(spark, sf):
    b = bars_e(spark, sf, "1h")
    seen = visits_e(spark, sf, 0.001, 0.003).select(F.col("observed_at").alias("timestamp")).distinct()
    ctl = O.schedule_controls(b, 6).select(F.col("T").alias("timestamp"))
    o = outcomes_e(spark, sf).filter("not censored")
    both = o.join(seen, "timestamp", "left_semi").withColumn("group", F.lit("event")).unionByName(o.join(ctl, "timestamp", "left_semi").withColumn("group", F.lit("control")))
    p = both.groupBy(*S.GRID).pivot("group", ["event", "control"]).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == "TP_FIRST").cast("double")).alias("rate"))
    p = p.select(*S.GRID, F.coalesce("event_n", F.lit(0)).alias("events"), F.coalesce("control_n", F.lit(0)).alias("controls"), r("event_rate").alias("event_rate"), r("control_rate").alias("control_rate"))
    return p.withColumn("difference", r(F.col("event_rate") - F.col("control_rate")))


@query("detector_counts", build("SELECT kind, count(*) AS interaction_count, count(DISTINCT observed_at) AS unique_events FROM vis_sep GROUP BY kind"))
def detector_counts(spark, sf):
    v = visits_e(spark, sf, 0.001, 0.003).withColumn("kind", F.split("zone_id", ":")[0])
    return v.groupBy("kind").agg(F.count(F.lit(1)).alias("interaction_count"), F.count_distinct("observed_at").alias("unique_events"))


@query("exact_distribution", build("SELECT A1 AS value, count(*) AS frequency, round(count(*) / (SELECT count(*) FROM score_l)::DOUBLE, 6) AS fraction, round(avg(support_count), 6) AS mean_support FROM score_l GROUP BY A1"))
def exact_distribution(spark, sf):
    s = q_map.score_l(spark, sf)
    d = s.groupBy(F.col("A1").alias("value")).agg(F.count(F.lit(1)).alias("frequency"), F.avg("support_count").alias("m"))
    total = d.agg(F.sum("frequency").alias("t"))
    return d.crossJoin(F.broadcast(total)).select("value", "frequency", r(F.col("frequency") / F.col("t")).alias("fraction"), r("m").alias("mean_support"))


@query("describe", build("""SELECT period, feature, count(*) AS states, count(*) - count(value) AS missing, count(*) FILTER (WHERE value = 0) AS zero, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean
  FROM (SELECT unnest(['ALL', year(make_timestamp(T * 1000)) || '-Q' || quarter(make_timestamp(T * 1000))]) AS period, feature, value FROM (SELECT T, 'A1' AS feature, A1 AS value FROM score_l UNION ALL SELECT T, 'imbalance', imbalance FROM score_l)) GROUP BY ALL"""))
def describe(spark, sf):
    s = q_map.score_l(spark, sf).withColumn("quarter", quarter_of(F.col("T")))
    d = S.all_plus_periods(s).selectExpr("period", "stack(2, 'A1', A1, 'imbalance', imbalance) AS (feature, value)")
    g = d.groupBy("period", "feature").agg(
        F.count(F.lit(1)).alias("states"), (F.count(F.lit(1)) - F.count("value")).alias("missing"), F.count(F.when(F.col("value") == 0, 1)).alias("zero"),
        F.percentile("value", [0.05, 0.5, 0.95]).alias("q"), F.avg("value").alias("m"))
    return g.select("period", "feature", "states", "missing", "zero", r(F.col("q")[0]).alias("p05"), r(F.col("q")[1]).alias("p50"), r(F.col("q")[2]).alias("p95"), r("m").alias("mean"))


def spearman_sql(src, a, b):
    rk = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
    return f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS pairs, round(corr(ra, rb), 6) AS spearman FROM (SELECT {rk(a)} AS ra, {rk(b)} AS rb FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query("spearman", build(spearman_sql("ctx_l", "volatility", "recent_return") + " UNION ALL " + spearman_sql("ctx_l", "recent_return", "P").replace("'P' AS y", "'P' AS y")))
def spearman(spark, sf):
    return S.spearman(ctx(bars_l(spark, sf)), [("volatility", "recent_return"), ("recent_return", "P")]).select("x", "y", "pairs", r("spearman").alias("spearman"))


@query("week_quarter_keys", build(f"SELECT ts // {WEEK} AS week, year(make_timestamp(ts * 1000)) || '-Q' || quarter(make_timestamp(ts * 1000)) AS quarter, count(*) AS n FROM trade_l GROUP BY ALL"))
def week_quarter_keys(spark, sf):
    return tape_l(spark, sf).groupBy(week_of(F.col("timestamp")).alias("week"), quarter_of(F.col("timestamp")).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


# ---- percentiles ---------------------------------------------------------------------

cte("ndelta", f"SELECT ts // {DAY} * {DAY} AS t, CAST(floor((price - 1000) / 35) AS BIGINT) AS bin, (sum(CASE WHEN maker THEN -quantity ELSE quantity END)) / sum(quantity) AS v FROM trade_l GROUP BY ALL")


def ndelta(spark, sf):
    """Normalised delta of three price bands a day: several rows share each time."""
    g = P.bin_trades(tape_l(spark, sf).withColumn("price", F.col("price") - 1000), 35.0, F.col("timestamp").alias("timestamp"))
    return g.select(F.struct("timestamp", "bin").alias("qid"), "timestamp", "bin", normalized_delta(F.col("buy"), F.col("sell"), F.col("quantity")).alias("value"), F.lit("ALL").alias("config"))


@query("normalized_delta", build("SELECT t AS timestamp, bin, round(v, 6) + 0.0::DOUBLE AS normalized_delta FROM ndelta"))
def normalized_delta_(spark, sf):
    return ndelta(spark, sf).select("timestamp", "bin", r("value").alias("normalized_delta"))


@query("midrank_expanding", build("""WITH e AS (SELECT *, count(*) OVER (PARTITION BY t) AS m FROM ndelta)
  SELECT a.t AS timestamp, a.bin, count(b.t) AS history_rows, round((count(*) FILTER (WHERE b.v < a.v) + 0.5::DOUBLE * count(*) FILTER (WHERE b.v = a.v)) / nullif(count(b.t), 0), 6) AS row_percentile,
  round(round(sum(CASE WHEN b.v < a.v THEN 1.0::DOUBLE / b.m WHEN b.v = a.v THEN 0.5::DOUBLE / b.m ELSE 0 END) / nullif(sum(1.0::DOUBLE / b.m), 0), 12), 6) AS event_percentile FROM e a LEFT JOIN e b ON b.t < a.t GROUP BY a.t, a.bin"""))
def midrank_expanding(spark, sf):
    m = S.midrank_expanding(ndelta(spark, sf), ["config"], DAY, 9000 * DAY)
    exact = F.round("event_percentile", 12)  # sums of thirds and the like: their noise must not decide a 5 in the last place
    return m.select("timestamp", "bin", "history_rows", r("row_percentile").alias("row_percentile"), r(exact).alias("event_percentile"))


FREEZE = 10_000 * DAY


@query("midrank_frozen", build(f"""WITH e AS (SELECT *, count(*) OVER (PARTITION BY t) AS m FROM ndelta WHERE t < {FREEZE}), h AS (SELECT sum(1.0::DOUBLE) AS tr, sum(1.0::DOUBLE / m) AS te FROM e)
  SELECT a.t AS timestamp, a.bin, round((count(*) FILTER (WHERE b.v < a.v) + 0.5::DOUBLE * count(*) FILTER (WHERE b.v = a.v)) / any_value(tr), 6) AS row_percentile,
  round(sum(CASE WHEN b.v < a.v THEN 1.0::DOUBLE / b.m WHEN b.v = a.v THEN 0.5::DOUBLE / b.m ELSE 0 END) / any_value(te), 6) AS event_percentile FROM ndelta a, e b, h WHERE a.t >= {FREEZE} GROUP BY a.t, a.bin"""))
def midrank_frozen(spark, sf):
    d = ndelta(spark, sf)
    model = S.ecdf_model(d.filter(F.col("timestamp") < FREEZE), ["config"])
    m = S.midrank_frozen(d.filter(F.col("timestamp") >= FREEZE), model, ["config"])
    return m.select("qid.timestamp", "qid.bin", r("row_percentile").alias("row_percentile"), r("event_percentile").alias("event_percentile"))


@query("percent_bucket", build("""WITH p AS (SELECT a.t, a.bin, (count(*) FILTER (WHERE b.v < a.v) + 0.5::DOUBLE * count(*) FILTER (WHERE b.v = a.v)) / nullif(count(b.t), 0) AS p FROM ndelta a LEFT JOIN ndelta b ON b.t < a.t GROUP BY a.t, a.bin)
  SELECT CASE WHEN p IS NULL THEN 0 ELSE least(floor(p * 10) + 1, 10) END::BIGINT AS decile, count(*) AS n FROM p GROUP BY 1"""))
def percent_bucket_(spark, sf):
    m = S.midrank_expanding(ndelta(spark, sf), ["config"], DAY, 9000 * DAY)
    return m.groupBy(percent_bucket(F.col("row_percentile"), 10).alias("decile")).agg(F.count(F.lit(1)).alias("n"))


# ---- bootstrap -----------------------------------------------------------------------


def weights_sql(src: str, draws: int, seed: int) -> str:
    x = f"((draw * 1000003 + slot * 10007 + {seed}) % 2147483648)"
    for _ in range(3):
        x = f"(({x} * 1103515245 + 12345) % 2147483648)"
    return f"""SELECT w.week, draw, count(*) AS w FROM (SELECT draw, (({x}) // 256) % n AS i FROM (SELECT unnest(range({draws}))::BIGINT AS draw), (SELECT unnest(range(count(DISTINCT week)))::BIGINT AS slot, count(DISTINCT week) AS n FROM {src}))
  JOIN (SELECT week, row_number() OVER (ORDER BY week) - 1 AS i FROM (SELECT DISTINCT week FROM {src})) w USING (i) GROUP BY ALL"""


DRAWS = 1000
SIX = {"TP_FIRST": "x1", "SL_FIRST": "x2", "NEITHER": "x3", "AMBIGUOUS": "x4", "mfe_pct": "x5", "mae_pct": "x6"}
cte("boot_w", weights_sql("rows_l", DRAWS, 3101))
_SUMS = ", ".join(f"count(*) FILTER (WHERE NOT censored AND label = '{m}')::DOUBLE AS {c}" for m, c in list(SIX.items())[:4]) + ", " + ", ".join(f"coalesce(sum({m}) FILTER (WHERE NOT censored), 0) AS {c}" for m, c in list(SIX.items())[4:])
cte("boot_s", f"SELECT week, b, direction, tp, sl, horizon, count(*) FILTER (WHERE NOT censored)::DOUBLE AS n, {_SUMS} FROM (SELECT *, unnest([vb, 'ALL']) AS b FROM rows_l) GROUP BY ALL")
cte("boot_d", f"SELECT b, direction, tp, sl, horizon, draw, sum(n * w) AS n, {', '.join(f'sum({c} * w) AS {c}' for c in SIX.values())} FROM boot_s JOIN boot_w USING (week) GROUP BY ALL")
cte("boot_p", f"SELECT b, direction, tp, sl, horizon, count(*) FILTER (WHERE n > 0) AS blocks, sum(n) AS n, {', '.join(f'sum({c}) / nullif(sum(n), 0) AS {c}' for c in SIX.values())} FROM boot_s GROUP BY ALL")
_CELL = "a.direction = z.direction AND a.tp = z.tp AND a.sl = z.sl AND a.horizon = z.horizon"
cte("boot_q", f"SELECT a.b, a.direction, a.tp, a.sl, a.horizon, {', '.join(f'count(a.{c} / nullif(a.n, 0) - z.{c} / nullif(z.n, 0)) AS k{c}, quantile_cont(a.{c} / nullif(a.n, 0) - z.{c} / nullif(z.n, 0), [0.025, 0.975]) AS q{c}' for c in SIX.values())} FROM boot_d a JOIN boot_d z ON a.b <> 'ALL' AND z.b = 'ALL' AND a.draw = z.draw AND {_CELL} GROUP BY ALL")


@query("block_bootstrap", build(" UNION ALL ".join(f"""SELECT a.b AS volatility_bucket, a.direction, a.tp, a.sl, a.horizon, '{m}' AS metric, a.n::BIGINT AS complete, a.blocks AS week_blocks, round(a.{c} - z.{c}, 6) + 0.0::DOUBLE AS increment,
  CASE WHEN a.blocks >= 5 AND k{c} >= 950 THEN round(q{c}[1], 6) + 0.0::DOUBLE END AS ci_low, CASE WHEN a.blocks >= 5 AND k{c} >= 950 THEN round(q{c}[2], 6) + 0.0::DOUBLE END AS ci_high, CASE WHEN a.blocks >= 5 THEN k{c} ELSE 0 END AS finite_draws
  FROM boot_p a JOIN boot_p z ON a.b <> 'ALL' AND z.b = 'ALL' AND {_CELL} JOIN boot_q q ON q.b = a.b AND q.direction = a.direction AND q.tp = a.tp AND q.sl = a.sl AND q.horizon = a.horizon""" for m, c in SIX.items())))
def block_bootstrap(spark, sf):
    """Every volatility bucket against all rows: six metrics, all cells."""
    rows = rows_l(spark, sf).withColumn("bucket", F.explode(F.array("volatility_bucket", F.lit("ALL"))))
    b = R.against_all(rows, "bucket", S.GRID, "week", list(SIX))
    return b.select(F.col("bucket").alias("volatility_bucket"), *S.GRID, "metric", "complete", "week_blocks", r("estimate").alias("increment"), r("ci_low").alias("ci_low"), r("ci_high").alias("ci_high"), "finite_draws")


@query("cuts_ventile_support", build("""WITH c AS (SELECT list_distinct(quantile_cont(volatility, [x / 20.0 for x in range(1, 20)])) AS v, quantile_cont(volatility, [0.25, 0.5, 0.75]) AS q, coalesce(quantile_cont(recent_return, 0.9) FILTER (WHERE recent_return > 0.01::DOUBLE), 1) AS pc FROM ctx_l)
  SELECT round(q[1], 6) AS quartile_1, round(q[3], 6) AS quartile_3, 20::BIGINT AS bins, false AS ventile_supported FROM c""".replace("[x / 20.0 for x in range(1, 20)]", "[" + ", ".join(str(i / 20) for i in range(1, 20)) + "]")))
def cuts_ventile_support(spark, sf):
    m = C.ventile_support(ctx(bars_l(spark, sf)), "volatility", week_of(F.col("timestamp")))
    return m.select(r(F.col("quartile")[0]).alias("quartile_1"), r(F.col("quartile")[2]).alias("quartile_3"), "bins", "ventile_supported")


@query("best_bucket", build("""SELECT direction, tp, sl, horizon, arg_max(vb, ROW(rate, -CAST(substr(vb, 2) AS BIGINT))) AS bucket FROM (SELECT vb, direction, tp, sl, horizon, count(*) FILTER (WHERE NOT censored AND label = 'TP_FIRST') / count(*) FILTER (WHERE NOT censored) AS rate FROM rows_l GROUP BY ALL) GROUP BY ALL"""))
def best_bucket(spark, sf):
    c = S.cell_sums(rows_l(spark, sf), "volatility_bucket", *S.GRID)
    order = F.struct("tp_first_rate", -F.substring("volatility_bucket", 2, 1).cast("int"))
    return c.groupBy(*S.GRID).agg(F.max_by("volatility_bucket", order).alias("bucket"))


cte("curve_l", """SELECT direction, tp, sl, horizon, CAST(substr(vb, 2) AS BIGINT) AS x, count(*) FILTER (WHERE NOT censored) AS complete, count(*) FILTER (WHERE NOT censored AND label = 'TP_FIRST') / count(*) FILTER (WHERE NOT censored)::DOUBLE AS y, count(*) FILTER (WHERE NOT censored AND label = 'AMBIGUOUS') / count(*) FILTER (WHERE NOT censored)::DOUBLE AS amb FROM rows_l GROUP BY ALL""")


def curve_l(spark, sf):
    c = S.cell_sums(rows_l(spark, sf), "volatility_bucket", *S.GRID)
    return c.withColumn("x", F.substring("volatility_bucket", 2, 1).cast("long")).withColumn("ok", F.col("complete") >= 200)


@query("curve_shape", build("""WITH d AS (SELECT *, y - lag(y) OVER (PARTITION BY direction, tp, sl, horizon ORDER BY x) AS d FROM curve_l)
  SELECT direction, tp, sl, horizon, count(*) FILTER (WHERE d > 1e-12) AS increasing_steps, count(*) FILTER (WHERE d < -1e-12) AS decreasing_steps, round(max(abs(d)), 6) AS largest_step, round(max(y) FILTER (WHERE x = 4) - max(y) FILTER (WHERE x = 1), 6) + 0.0::DOUBLE AS high_minus_low,
  CASE WHEN min(complete) < 200 THEN 'SPARSE' WHEN count(*) FILTER (WHERE abs(d) > 1e-12) = 0 THEN 'FLAT' WHEN count(*) FILTER (WHERE d < -1e-12) = 0 THEN 'MONOTONIC_INCREASING' WHEN count(*) FILTER (WHERE d > 1e-12) = 0 THEN 'MONOTONIC_DECREASING' ELSE 'NONLINEAR' END AS shape FROM d GROUP BY ALL"""))
def curve_shape(spark, sf):
    s = S.curve_shape(curve_l(spark, sf), S.GRID, "x", "tp_first_rate", "ok", 4)
    return s.select(*S.GRID, "increasing_steps", "decreasing_steps", r("largest_step").alias("largest_step"), r("high_minus_low").alias("high_minus_low"), "shape")


@query("extreme_contrast", build("SELECT direction, tp, sl, horizon, round(h.y - l.y, 6) + 0.0::DOUBLE AS difference, least(h.complete, l.complete) AS minimum_complete, h.complete >= 200 AND l.complete >= 200 AS both_supported FROM (SELECT * FROM curve_l WHERE x = 4) h JOIN (SELECT * FROM curve_l WHERE x = 1) l USING (direction, tp, sl, horizon)"))
def extreme_contrast(spark, sf):
    p = curve_l(spark, sf).groupBy(*S.GRID).pivot("x", [1, 4]).agg(F.max("tp_first_rate").alias("y"), F.max("complete").alias("n"))
    return p.select(*S.GRID, r(F.col("4_y") - F.col("1_y")).alias("difference"), F.least("1_n", "4_n").alias("minimum_complete"), ((F.col("1_n") >= 200) & (F.col("4_n") >= 200)).alias("both_supported"))


cte("vol_l", "SELECT c.event_id, round(b.volume, 6) AS volume FROM ctx_l c JOIN bars_l1d b ON b.symbol = c.symbol AND b.end_time = c.T")
cte("vcut_l", "SELECT quantile_cont(volume, [0.25, 0.5, 0.75]) AS c FROM vol_l")
cte("vcell_l", f"""SELECT {label_sql('volume', 'c')} AS vb, direction, tp, sl, horizon, count(*) FILTER (WHERE NOT censored) AS n, count(*) FILTER (WHERE NOT censored AND label = 'TP_FIRST') / nullif(count(*) FILTER (WHERE NOT censored), 0)::DOUBLE AS y,
  count(*) FILTER (WHERE NOT censored AND label = 'AMBIGUOUS') / nullif(count(*) FILTER (WHERE NOT censored), 0)::DOUBLE AS amb FROM out_l JOIN vol_l USING (event_id), vcut_l GROUP BY ALL""")


@query("volume_composition", build("SELECT direction, tp, sl, horizon, h.n AS high_complete, l.n AS low_complete, round(h.amb - l.amb, 6) + 0.0::DOUBLE AS ambiguity_high_minus_low, round(h.y - l.y, 6) + 0.0::DOUBLE AS tp_high_minus_low FROM (SELECT * FROM vcell_l WHERE vb = 'Q4') h JOIN (SELECT * FROM vcell_l WHERE vb = 'Q1') l USING (direction, tp, sl, horizon)"))
def volume_composition(spark, sf):
    """How labels are made up after bars of high and of low volume."""
    bars = bars_l(spark, sf)
    c = ctx(bars).join(bars.select("symbol", F.col("end").alias("timestamp"), r("volume").alias("volume")), ["symbol", "timestamp"])
    c = C.apply_buckets(c, C.fit_quantiles(c, ["volume"], 4), ["volume"]).select("event_id", "volume_bucket")
    cells = S.cell_sums(outcomes_l(spark, sf).join(c, "event_id"), "volume_bucket", *S.GRID)
    p = cells.groupBy(*S.GRID).pivot("volume_bucket", ["Q1", "Q4"]).agg(F.max("tp_first_rate").alias("y"), F.max("ambiguous_rate").alias("a"), F.max("complete").alias("n"))
    return p.select(*S.GRID, F.col("Q4_n").alias("high_complete"), F.col("Q1_n").alias("low_complete"), r(F.col("Q4_a") - F.col("Q1_a")).alias("ambiguity_high_minus_low"), r(F.col("Q4_y") - F.col("Q1_y")).alias("tp_high_minus_low"))


_SL = "0.1::DOUBLE * (sxy - sx * sy / n) / CASE WHEN n >= 2 AND sxx - sx * sx / n > 1e-14 THEN sxx - sx * sx / n END"
cte("slope_s", "SELECT direction, tp, sl, horizon, week, count(*)::DOUBLE AS n, sum(volatility) AS sx, sum(volatility * volatility) AS sxx, sum(mfe_pct) AS sy, sum(volatility * mfe_pct) AS sxy FROM rows_l WHERE NOT censored GROUP BY ALL")
cte("slope_w", weights_sql("(SELECT * FROM rows_l WHERE NOT censored)", DRAWS, 3101))


@query("ols_slope", build(f"""WITH p AS (SELECT direction, tp, sl, horizon, sum(n) AS n, count(*) AS blocks, sum(sx) AS sx, sum(sxx) AS sxx, sum(sy) AS sy, sum(sxy) AS sxy FROM slope_s GROUP BY ALL),
  d AS (SELECT direction, tp, sl, horizon, draw, sum(n * w) AS n, sum(sx * w) AS sx, sum(sxx * w) AS sxx, sum(sy * w) AS sy, sum(sxy * w) AS sxy FROM slope_s JOIN slope_w USING (week) GROUP BY ALL),
  q AS (SELECT direction, tp, sl, horizon, count({_SL}) AS k, quantile_cont({_SL}, [0.025, 0.975]) AS q FROM d GROUP BY ALL)
  SELECT p.direction, p.tp, p.sl, p.horizon, p.n::BIGINT AS n, blocks AS week_blocks, round({_SL}, 4) + 0.0::DOUBLE AS slope_per_point_one, CASE WHEN blocks >= 5 AND k >= 950 THEN round(q[1], 4) + 0.0::DOUBLE END AS ci_low, CASE WHEN blocks >= 5 AND k >= 950 THEN round(q[2], 4) + 0.0::DOUBLE END AS ci_high,
  CASE WHEN blocks >= 5 THEN k ELSE 0 END AS finite_draws FROM p JOIN q USING (direction, tp, sl, horizon)"""))
def ols_slope(spark, sf):
    """Slope of the favourable excursion over volatility in every cell, with an interval from resampled weeks."""
    s = R.ols_slope(rows_l(spark, sf).filter("not censored"), S.GRID, "week", "volatility", "mfe_pct")
    return s.select(*S.GRID, "n", "week_blocks", r("estimate", 4).alias("slope_per_point_one"), r("ci_low", 4).alias("ci_low"), r("ci_high", 4).alias("ci_high"), "finite_draws")
