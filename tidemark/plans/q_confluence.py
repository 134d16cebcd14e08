"""Timeframes side by side, repricing, scoring and slopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import DAY, HOUR, STEPS, TFS, WIDTHS, Scoring, Settings, Slopes
from tidemark.functions.columns import age_weight, known, long, proximity, r
from tidemark.operators import confluence as X
from tidemark.operators.bars import merge_candles
from tidemark.operators import detectors as D
from tidemark.operators import flow as FL
from tidemark.operators import fullmap as M
from tidemark.operators import profiles as P
from tidemark.operators import quality as Q
from tidemark.operators import scoring as SC
from tidemark.operators import slopes as SL
from tidemark.plans import q_map
from tidemark.plans.base import T0, bars_e, bars_l, tape_e
from tidemark.plans.q_map import equals_together, score_sql, union_sql, weight_sql
from tidemark.plans.q_quality import quarantine
from tidemark.plans.registry import build, cte, query
from tidemark.session import materialize

LB = 10 * DAY
SINCE = T0 + LB

for _tf, _s in STEPS.items():
    _w = str(WIDTHS[_tf])
    cte(f"dec_c{_tf}", f"SELECT symbol, end_time AS T, close AS P FROM bars_e{_tf} WHERE end_time >= {SINCE}")
    cte(f"act_c{_tf}", f"""SELECT d.T, d.P, l.kind, l.price, {weight_sql(_w)} AS weight FROM dec_c{_tf} d JOIN lev_e{_tf} l ON l.known_at <= d.T AND l.dependency_start >= d.T - {LB}""")
    cte(f"score_c{_tf}", score_sql(f"act_c{_tf}", f"dec_c{_tf}"))
    cte(f"ivl_c{_tf}", f"SELECT T, lower(kind) AS side, price * (1 - {_w}::DOUBLE) AS lo, price * (1 + {_w}::DOUBLE) AS hi FROM act_c{_tf} WHERE weight > 0")
    cte(f"uni_c{_tf}", union_sql(f"SELECT * FROM ivl_c{_tf}", "T, side"))
    cte(f"act_p{_tf}", f"""SELECT d.T, d.P, l.kind, l.price, {weight_sql(_w)} AS weight FROM dec_c15m d JOIN lev_e{_tf} l ON l.known_at <= d.T // {_s} * {_s} AND l.dependency_start >= d.T // {_s} * {_s} - {LB}""")
    cte(f"score_p{_tf}", score_sql(f"act_p{_tf}", "dec_c15m"))

SIGN = "CASE WHEN {c} IS NULL THEN 'M' WHEN {c} > 0 THEN 'S' WHEN {c} < 0 THEN 'R' ELSE 'N' END"
cte("aligned", "SELECT c.T, c.P, " + ", ".join(f's{i}.T AS "src{i}", s{i}.A1 AS a{i}, s{i}.A2 AS b{i}, s{i}.imbalance AS m{i}' for i in range(4)) + " FROM dec_c15m c " + " ".join(
    f"JOIN score_c{tf} s{i} ON s{i}.T = c.T // {STEPS[tf]} * {STEPS[tf]}" for i, tf in enumerate(TFS)))
cte("signs", f"SELECT *, {' || '.join(SIGN.format(c=f'm{i}') for i in range(4))} AS imbalance_pattern, {' || '.join(SIGN.format(c=f'a{i}') for i in range(4))} AS a1_pattern FROM aligned")


def stored_bars(spark, sf):
    """Bars of all timeframes from one reading of the trades. They are small next to these and read many times: written once."""
    fine = materialize(bars_e(spark, sf, TFS[0]), f"bars-{TFS[0]}")
    return {TFS[0]: fine} | {tf: materialize(merge_candles(fine, tf), f"bars-{tf}") for tf in TFS[1:]}


def native(bars):
    out = {}
    for tf, b in bars.items():
        out[tf] = X.native_states(M.decisions(b, SINCE), D.detect_a(b), LB, WIDTHS[tf])
    return out


def clock15(bars):
    return M.decisions(bars["15m"], SINCE).drop("tf")


def scores_only(bars):
    """The four native scores, without interval lists."""
    out = {}
    for tf, b in bars.items():
        d = M.decisions(b, SINCE)
        out[tf] = M.native_score(d, M.near_map(d, D.detect_a(b), LB, WIDTHS[tf]), WIDTHS[tf])
    return out


@query("align_native", build("SELECT T, src0, src1, src2, src3, a0, a1, a2, a3, round(m3, 6) AS m3 FROM aligned"))
def align_native(spark, sf):
    bars = stored_bars(spark, sf)
    a = X.align(clock15(bars), scores_only(bars))
    q = lambda tf, c: F.col(f"`{tf}__{c}`")
    return a.select("T", *[q(tf, "source_timestamp").alias(f"src{i}") for i, tf in enumerate(TFS)], *[q(tf, "A1").alias(f"a{i}") for i, tf in enumerate(TFS)], r(q("1d", "imbalance")).alias("m3"))


@query("sign_pattern", build("SELECT T, imbalance_pattern, a1_pattern, length(imbalance_pattern) - length(replace(imbalance_pattern, 'S', '')) AS support_count, length(imbalance_pattern) - length(replace(imbalance_pattern, 'R', '')) AS resistance_count, substr(imbalance_pattern, 1, 2) || '/' || substr(imbalance_pattern, 3, 2) AS conflict_pattern FROM signs"))
def sign_pattern(spark, sf):
    bars = stored_bars(spark, sf)
    s = X.sign_patterns(X.align(clock15(bars), scores_only(bars)))
    return s.select("T", "imbalance_pattern", F.col("A1_pattern").alias("a1_pattern"), F.col("imbalance_support_count").alias("support_count"), F.col("imbalance_resistance_count").alias("resistance_count"), "conflict_pattern")


@query("native_intervals", build(" UNION ALL ".join(f"SELECT '{tf}' AS tf, T, side, count(*) AS intervals, round(min(lo), 9) AS lowest, round(max(hi), 9) AS highest FROM ivl_c{tf} GROUP BY T, side" for tf in TFS)))
def native_intervals(spark, sf):
    out = None
    for tf, s in native(stored_bars(spark, sf)).items():
        for side in X.SIDES:
            a = F.col(f"{side}_intervals")
            d = s.filter(F.size(a) > 0).select(F.lit(tf).alias("tf"), "T", F.lit(side).alias("side"), F.size(a).cast("long").alias("intervals"), r(F.array_min(F.transform(a, lambda x: x["lo"])), 9).alias("lowest"), r(F.array_max(F.transform(a, lambda x: x["hi"])), 9).alias("highest"))
            out = d if out is None else out.unionByName(d)
    return out


GRAIN = {"15m": STEPS["15m"], "1h": STEPS["15m"], "4h": HOUR, "1d": HOUR}  # buckets of the profile that a timeframe's window is made of
cte("prof_q", f"SELECT symbol, ts // {STEPS['15m']} * {STEPS['15m']} AS bucket, price, sum(quantity) AS quantity, sum(CASE WHEN NOT maker THEN quantity ELSE 0 END) AS buy, sum(CASE WHEN maker THEN quantity ELSE 0 END) AS sell FROM trade_e GROUP BY ALL")


def native_flow_sql(tf: str) -> str:
    step, grain = STEPS[tf], GRAIN[tf]
    prof = "prof_q" if grain == STEPS["15m"] else "prof_e"
    cte(f"uni_j{tf}", union_sql(f"SELECT T, side, lo, hi FROM ivl_c{tf} UNION ALL SELECT T, 'joint', lo, hi FROM ivl_c{tf}", "T, side"))
    cte(f"have_{tf}", f"SELECT d.T, count(DISTINCT p.bucket) AS n FROM dec_c{tf} d JOIN (SELECT DISTINCT bucket FROM {prof}) p ON p.bucket >= d.T - {step} AND p.bucket < d.T GROUP BY 1")
    cte(f"sum_{tf}", f"SELECT u.T, " + ", ".join(f"sum(p.{c}) FILTER (WHERE side = '{x}') AS {x}_{c}" for x in FL.SIDES for c in ("quantity", "buy", "sell")) + f" FROM uni_j{tf} u JOIN {prof} p ON p.bucket >= u.T - {step} AND p.bucket < u.T AND p.price BETWEEN u.lo AND u.hi GROUP BY 1")
    cte(f"ivn_{tf}", "SELECT T, " + ", ".join(f"count(*) FILTER (WHERE side = '{x}') AS {x}_n" for x in FL.SIDES) + f" FROM uni_j{tf} GROUP BY 1")
    return f"""SELECT '{tf}' AS tf, d.T, {step / HOUR}::DOUBLE AS flow_hours, CASE WHEN EXISTS (SELECT 1 FROM quar q WHERE d.T - {step} < q.e AND d.T > q.s) THEN 'QUARANTINED' WHEN coalesce(h.n, 0) < {step // grain} THEN 'MISSING_PROFILE' ELSE 'AVAILABLE' END AS flow_status,
      {', '.join(f'coalesce({x}_n, 0) AS {x}_interval_count' for x in FL.SIDES)}, {', '.join(f'coalesce({x}_{c}, 0) AS {x}_{c}' for x in FL.SIDES for c in ('quantity', 'buy', 'sell'))}
      FROM dec_c{tf} d LEFT JOIN have_{tf} h ON h.T = d.T LEFT JOIN sum_{tf} s ON s.T = d.T LEFT JOIN ivn_{tf} v ON v.T = d.T"""


cte("flow_n", " UNION ALL ".join(f"({native_flow_sql(tf)})" for tf in TFS))


@query("zone_flow_native", equals_together(build(f"""SELECT tf, T, flow_hours, flow_status, {', '.join(f'{x}_interval_count' for x in FL.SIDES)}, {', '.join(f"CASE WHEN flow_status = 'AVAILABLE' THEN round({x}_{c}, 6) END AS {x}_{c}" for x in FL.SIDES for c in ('quantity', 'buy', 'sell'))} FROM flow_n""")))
def zone_flow_native(spark, sf):
    """Volume in each timeframe's own zones over its own last step: fine profile for the short ones, hourly for the long ones."""
    fine = materialize(P.profile(tape_e(spark, sf), STEPS["15m"]), "profile")
    profiles = {STEPS["15m"]: fine, HOUR: materialize(P.merge_profiles(fine, HOUR), "profile")}
    spans = materialize(quarantine(spark, sf), "spans")
    out = None
    for tf, b in stored_bars(spark, sf).items():
        d = M.decisions(b, SINCE)
        near = M.with_weight(M.near_map(d, D.detect_a(b), LB, WIDTHS[tf]), WIDTHS[tf]).filter("weight > 0")
        f = FL.zone_flow(d, FL.zone_unions(near, WIDTHS[tf]), profiles[GRAIN[tf]], GRAIN[tf], (STEPS[tf] // GRAIN[tf],), spans)
        out = f if out is None else out.unionByName(f)
    hours = F.col("window") * F.create_map(*[F.lit(x) for tf in TFS for x in (tf, GRAIN[tf] / HOUR)])[F.col("tf")]
    return out.select("tf", "T", hours.cast("double").alias("flow_hours"), "flow_status", *[F.col(f"{x}_interval_count") for x in FL.SIDES], *[r(f"{x}_{c}").alias(f"{x}_{c}") for x in FL.SIDES for c in ("quantity", "buy", "sell")])


def overlap_sql() -> str:
    """Each subset from the subset without its last timeframe, by equality on time and side."""
    for tf in TFS:
        cte(f"at_{tf}", f"SELECT c.T, c.P, u.side, u.lo, u.hi FROM dec_c15m c JOIN uni_c{tf} u ON u.T = c.T // {STEPS[tf]} * {STEPS[tf]}")
    parts = []
    for sub in X.SUBSETS:
        name = "k_" + "_".join(sub)
        if len(sub) == 1:
            cte(name, f"SELECT * FROM at_{sub[0]}")
        else:
            cte(name, f"SELECT a.T, a.P, a.side, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM k_{'_'.join(sub[:-1])} a JOIN at_{sub[-1]} b ON a.T = b.T AND a.side = b.side WHERE greatest(a.lo, b.lo) <= least(a.hi, b.hi)")
        parts.append(f"SELECT *, '{'+'.join(sub)}' AS combination, {len(sub)} AS timeframe_count FROM {name}")
    return " UNION ALL ".join(parts)


cte("components", overlap_sql())


@query("zone_overlap_tf", build("""SELECT c.T, s.side, coalesce(max(k.timeframe_count), 0)::BIGINT AS overlap_count, coalesce(string_agg(DISTINCT k.combination, '|' ORDER BY k.combination) FILTER (WHERE k.timeframe_count = k.top), '') AS identities
  FROM dec_c15m c CROSS JOIN (VALUES ('support'), ('resistance')) s(side) LEFT JOIN (SELECT *, max(timeframe_count) OVER (PARTITION BY T, side) AS top FROM components) k ON k.T = c.T AND k.side = s.side GROUP BY ALL"""))
def zone_overlap_tf(spark, sf):
    bars = stored_bars(spark, sf)
    o = X.zone_overlap(X.align(clock15(bars), native(bars)))
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_overlap_count").alias("overlap_count"), F.array_join(F.sort_array(F.split(f"{s}_overlap_identities", "[|]")), "|").alias("identities")) for s in X.SIDES]))
    return o.select("T", rows.alias("r")).select("T", "r.*")


@query("interval_intersection", equals_together(build("SELECT T, side, combination, round(lo, 9) AS lower, round(hi, 9) AS upper, round(greatest(lo - P, 0, P - hi), 9) AS price_distance FROM components")))
def interval_intersection(spark, sf):
    bars = stored_bars(spark, sf)
    c = X.overlap_components(X.zone_overlap(X.align(clock15(bars), native(bars))))
    return c.select("T", "side", "combination", r("lower", 9).alias("lower"), r("upper", 9).alias("upper"), r("price_distance", 9).alias("price_distance"))


@query("spatial_prevalence", build("""WITH o AS (SELECT c.T, coalesce(max(timeframe_count) FILTER (WHERE side = 'support'), 0)::BIGINT AS s, coalesce(max(timeframe_count) FILTER (WHERE side = 'resistance'), 0)::BIGINT AS r FROM dec_c15m c LEFT JOIN components k USING (T) GROUP BY 1)
  SELECT s AS support_overlap_count, r AS resistance_overlap_count, count(*) AS timestamps, round(count(*) / (SELECT count(*) FROM o)::DOUBLE, 6) AS fraction FROM o GROUP BY ALL"""))
def spatial_prevalence(spark, sf):
    bars = stored_bars(spark, sf)
    o = X.zone_overlap(X.align(clock15(bars), native(bars)))
    g = o.groupBy("support_overlap_count", "resistance_overlap_count").agg(F.count(F.lit(1)).alias("timestamps"))
    total = g.agg(F.sum("timestamps").alias("t"))
    return g.crossJoin(F.broadcast(total)).select("support_overlap_count", "resistance_overlap_count", "timestamps", r(F.col("timestamps") / F.col("t")).alias("fraction"))


def repriced(spark, sf, bars=None):
    bars = bars or stored_bars(spark, sf)
    return X.reprice(clock15(bars), {tf: D.detect_a(b) for tf, b in bars.items()}, LB, WIDTHS)


STATE = "CASE WHEN support_count + resistance_count = 0 THEN 'M' WHEN support_count > resistance_count THEN 'S' WHEN resistance_count > support_count THEN 'R' ELSE 'N' END"
cte("repriced", " UNION ALL ".join(f"SELECT '{tf}' AS tf, T, P, support_count, resistance_count, A1, A2, imbalance, {STATE} AS state FROM score_p{tf}" for tf in TFS))


@query("reprice_states", build("SELECT tf, T, support_count, resistance_count, A1, A2, round(imbalance, 6) AS imbalance, state FROM repriced"))
def reprice_states(spark, sf):
    return repriced(spark, sf).select("tf", "T", "support_count", "resistance_count", "A1", "A2", r("imbalance").alias("imbalance"), "state")


cte("wide_p", """SELECT T, max(state) FILTER (WHERE tf = '15m') || max(state) FILTER (WHERE tf = '1h') || max(state) FILTER (WHERE tf = '4h') || max(state) FILTER (WHERE tf = '1d') AS pattern,
  CASE WHEN count(imbalance) = 4 THEN list_sort(list(abs(imbalance))) END AS v FROM repriced GROUP BY T""")


@query("strength_summary", build("SELECT T, pattern, round(v[1], 6) AS strength_minimum, round((v[2] + v[3]) / 2, 6) AS strength_median, round(v[4], 6) AS strength_maximum FROM wide_p"))
def strength_summary(spark, sf):
    w = X.wide_states(repriced(spark, sf))
    return w.select("T", "pattern", *[r(f"strength_{k}").alias(f"strength_{k}") for k in ("minimum", "median", "maximum")])


@query("shared_close_check", build("SELECT NULL::BIGINT AS T, NULL::VARCHAR AS tf WHERE false"))
def shared_close_check(spark, sf):
    """At a shared close where both prices agree, repriced and native scores must be equal."""
    n = None
    bars = stored_bars(spark, sf)
    for s in scores_only(bars).values():
        s = s.select("symbol", "tf", "T", "P", "A1", "A2")
        n = s if n is None else n.unionByName(s)
    d = X.shared_close_check(repriced(spark, sf, bars), n)
    return d.filter(F.col("P") == F.col("native_P")).select("T", "tf")


# ---- scoring -------------------------------------------------------------------------

CFG = Settings(Scoring(days=10), Slopes(days=10))
LCFG = Settings()
AGEW = "(0.25::DOUBLE + 0.75::DOUBLE * pow(0.5::DOUBLE, age / 180::DOUBLE))"


def prox_sql(w: str) -> str:
    d = "abs(P / price - 1)"
    return f"CASE WHEN {d} <= {w}::DOUBLE OR abs({d} - {w}::DOUBLE) <= 1e-14 THEN 1.0::DOUBLE WHEN {d} <= {w}::DOUBLE * 1.5::DOUBLE OR abs({d} - {w}::DOUBLE * 1.5::DOUBLE) <= 1e-14 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"


def site_sql(dec: str, lev: str, days: int, w: str) -> str:
    return f"""SELECT *, prox * aw AS contribution FROM (SELECT *, {prox_sql(w)} AS prox, {AGEW} AS aw FROM (SELECT d.T, d.P, l.kind, l.price, l.known_at, l.second_open, (d.T - l.known_at) / 86400000::DOUBLE AS age
  FROM {dec} d JOIN {lev} l ON l.known_at <= d.T AND l.dependency_start >= d.T - {days * DAY}))"""


cte("site_l", site_sql("dec_l", "lev_l", 850, "0.022"))
for _tf in TFS:
    cte(f"site_c{_tf}", site_sql("dec_c15m", f"lev_e{_tf}", 10, str(WIDTHS[_tf])))


def detail_l(spark, sf):
    b = bars_l(spark, sf)
    d = M.decisions(Q.complete_lookback(b, 850))
    return d, D.detect_a(b, second_source=True)


@query("score_detail", build("SELECT T, kind, second_open AS source_time, round(age, 6) AS age_days, prox AS proximity_weight, round(aw, 6) AS age_weight, round(contribution, 6) AS contribution FROM site_l"))
def score_detail(spark, sf):
    d, lev = detail_l(spark, sf)
    s = SC.score_detail(d, lev, "1d", LCFG)
    return s.select("T", "kind", F.col("source_timestamp").alias("source_time"), r("age_days").alias("age_days"), "proximity_weight", r("age_weight").alias("age_weight"), r("contribution").alias("contribution"))


@query("score_timeframe", build("""SELECT T, raw_s AS raw_support_count, raw_r AS raw_resistance_count, map_s AS map_support_count, map_r AS map_resistance_count, legacy AS legacy_score, round(ws, 6) AS weighted_support, round(wr, 6) AS weighted_resistance,
  round(n, 6) + 0.0::DOUBLE AS normalized, CASE WHEN n > 0.05 THEN 'SUPPORT' WHEN n < -0.05 THEN 'RESISTANCE' ELSE 'BALANCED' END AS state FROM (SELECT *, coalesce((ws - wr) / nullif(ws + wr, 0), 0) AS n FROM (
  SELECT T, count(*) FILTER (WHERE kind = 'SUPPORT' AND prox > 0) AS raw_s, count(*) FILTER (WHERE kind = 'RESISTANCE' AND prox > 0) AS raw_r, count(*) FILTER (WHERE kind = 'SUPPORT') AS map_s, count(*) FILTER (WHERE kind = 'RESISTANCE') AS map_r,
    sum(CASE WHEN kind = 'SUPPORT' THEN prox ELSE -prox END) AS legacy, coalesce(sum(contribution) FILTER (WHERE kind = 'SUPPORT'), 0) AS ws, coalesce(sum(contribution) FILTER (WHERE kind = 'RESISTANCE'), 0) AS wr FROM site_l GROUP BY T))"""))
def score_timeframe(spark, sf):
    d, lev = detail_l(spark, sf)
    s = SC.score_timeframe(d, lev, "1d", LCFG)
    return s.select("T", "raw_support_count", "raw_resistance_count", "map_support_count", "map_resistance_count", "legacy_score", r("weighted_support").alias("weighted_support"), r("weighted_resistance").alias("weighted_resistance"), r("normalized").alias("normalized"), "state")


@query("score_age_buckets", build("""SELECT T, CASE WHEN age < 30 THEN '0-30d' WHEN age < 90 THEN '30-90d' WHEN age < 180 THEN '90-180d' WHEN age < 365 THEN '180-365d' ELSE '365d+' END AS age, count(*) FILTER (WHERE kind = 'SUPPORT') AS support_count, count(*) FILTER (WHERE kind = 'RESISTANCE') AS resistance_count,
  round(coalesce(sum(contribution) FILTER (WHERE kind = 'SUPPORT'), 0), 6) AS weighted_support FROM site_l GROUP BY ALL""".replace("END AS age, count", "END AS band, count").replace("SELECT T,", "SELECT T, band AS age, support_count, resistance_count, weighted_support FROM (SELECT T,") + ")"))
def score_age_buckets(spark, sf):
    d, lev = detail_l(spark, sf)
    return SC.age_buckets(SC.score_detail(d, lev, "1d", LCFG)).select("T", "age", "support_count", "resistance_count", r("weighted_support").alias("weighted_support"))


@query("age_weight_proximity", build("SELECT round(age, 0) AS age_days, prox AS proximity, round(min(aw), 6) AS smallest_age_weight, count(*) AS n FROM site_l GROUP BY ALL"))
def age_weight_proximity(spark, sf):
    """The scalar rules on every live level: whole days of age, proximity step, age weight."""
    d, lev = detail_l(spark, sf)
    a = M.active_map(d, lev, 850 * DAY)
    age = (F.col("T") - F.col("known_at")) / F.lit(DAY)
    p = proximity(F.col("P"), F.col("price"), F.lit(WIDTHS["1d"]), 1.5)
    return a.select(r(age, 0).alias("age_days"), p.alias("proximity"), age_weight(age, LCFG).alias("w")).groupBy("age_days", "proximity").agg(r(F.min("w")).alias("smallest_age_weight"), F.count(F.lit(1)).alias("n"))


WEIGHTS = {"15m": 0.85, "1h": 0.7, "4h": 0.55, "1d": 1.0}
cte("site_norm", " UNION ALL ".join(f"""SELECT T, '{tf}' AS tf, {WEIGHTS[tf]}::DOUBLE AS w, coalesce((ws - wr) / nullif(ws + wr, 0), 0) AS n, ws + wr > 0 AS available FROM (SELECT d.T, coalesce(sum(contribution) FILTER (WHERE kind = 'SUPPORT'), 0) AS ws, coalesce(sum(contribution) FILTER (WHERE kind = 'RESISTANCE'), 0) AS wr
  FROM dec_c15m d LEFT JOIN site_c{tf} USING (T) GROUP BY d.T)""" for tf in TFS))
cte("site_hist", "SELECT T, sum(w * n) AS combined_score, sum(w * n) / 3.1::DOUBLE AS v, coalesce(string_agg(tf, ',' ORDER BY tf) FILTER (WHERE NOT available), '') AS no_structure FROM site_norm GROUP BY T")


def history(spark, sf):
    bars = stored_bars(spark, sf)
    lev = {tf: D.detect_a(b, second_source=True) for tf, b in bars.items()}
    return SC.score_history(clock15(bars), lev, CFG)


@query("score_combined", build("SELECT T, round(combined_score, 6) + 0.0::DOUBLE AS combined_score, no_structure, CASE WHEN v > 0.05 THEN 'SUPPORT' WHEN v < -0.05 THEN 'RESISTANCE' ELSE 'BALANCED' END AS state FROM site_hist"))
def score_combined(spark, sf):
    return history(spark, sf).select("T", r("combined_score").alias("combined_score"), F.array_join("no_structure", ",").alias("no_structure"), "state")


@query("score_history", build("SELECT T, round(v, 6) + 0.0::DOUBLE AS combined_normalized FROM site_hist"))
def score_history(spark, sf):
    return history(spark, sf).select("T", r("combined_normalized").alias("combined_normalized"))


@query("score_percentile", build("""WITH h AS (SELECT T, round(v, 9) AS v FROM site_hist), p AS (SELECT a.T, a.v, count(b.T) AS n, 100 * (count(*) FILTER (WHERE abs(b.v) < abs(a.v)) + 0.5::DOUBLE * count(*) FILTER (WHERE abs(b.v) = abs(a.v))) / nullif(count(b.T), 0) AS p
    FROM h a LEFT JOIN h b ON sign(a.v) = sign(b.v) AND a.v <> 0 AND b.T < a.T AND b.T >= a.T - 864000000 GROUP BY ALL)
  SELECT T, CASE WHEN v > 0 THEN 'SUPPORT' WHEN v < 0 THEN 'RESISTANCE' ELSE 'BALANCED' END AS direction, n AS sample_count, CASE WHEN n >= 30 THEN round(p, 5) END AS percentile,
  CASE WHEN v = 0 THEN 'BALANCED' WHEN n >= 30 THEN 'READY' ELSE 'INSUFFICIENT_HISTORY' END AS status, CASE WHEN n < 30 THEN NULL WHEN p >= 95 THEN 'EXTREME' WHEN p >= 90 THEN 'STRONG' WHEN p >= 75 THEN 'ELEVATED' ELSE 'NORMAL' END AS label FROM p"""))
def score_percentile(spark, sf):
    h = materialize(history(spark, sf).withColumn("combined_normalized", r("combined_normalized", 9)), "scores")
    p = SC.score_percentile(h, CFG, STEPS["15m"], T0)
    return p.select("T", "direction", "sample_count", r("percentile", 5).alias("percentile"), "status", "label")


@query("histogram_40", build("""SELECT g.bin, count(h.T) AS count FROM (SELECT unnest(range(40)) AS bin) g LEFT JOIN (SELECT T, least(floor((round(v, 9) + 1) * 20), 39)::BIGINT AS bin FROM site_hist) h USING (bin) GROUP BY g.bin"""))
def histogram_40(spark, sf):
    h = history(spark, sf).withColumn("combined_normalized", r("combined_normalized", 9))
    return SC.histogram(h, "combined_normalized").select("bin", "count")


@query("distribution_summary", build("""SELECT part, count(v) AS count, round(quantile_cont(v, 0.5), 6) + 0.0::DOUBLE AS q50, round(quantile_cont(v, 0.9), 6) AS q90 FROM (SELECT 'signed' AS part, v FROM site_hist UNION ALL SELECT 'positive', v FROM site_hist WHERE v > 0 UNION ALL SELECT 'negative_magnitude', -v FROM site_hist WHERE v < 0) GROUP BY part"""))
def distribution_summary(spark, sf):
    d = SC.distribution_summary(history(spark, sf), "combined_normalized")
    return d.select("part", "count", r(F.col("q")[0]).alias("q50"), r(F.col("q")[2]).alias("q90"))


@query("score_what_if", build(f"""WITH q AS (SELECT d.T, d.P * f AS P FROM dec_l d, (VALUES (0.97::DOUBLE), (1.03::DOUBLE)) v(f)), s AS ({site_sql('q', 'lev_l', 850, '0.022')})
  SELECT q.T, round(q.P, 6) AS P, round(coalesce((coalesce(sum(contribution) FILTER (WHERE kind = 'SUPPORT'), 0) - coalesce(sum(contribution) FILTER (WHERE kind = 'RESISTANCE'), 0)) / nullif(sum(contribution), 0), 0), 6) + 0.0::DOUBLE AS normalized FROM q LEFT JOIN s ON s.T = q.T AND s.P = q.P GROUP BY q.T, q.P"""))
def score_what_if(spark, sf):
    """Three per cent up and down; rejected texts never reach the score."""
    d, lev = detail_l(spark, sf)
    texts = F.array((F.col("P") * 0.97).cast("string"), (F.col("P") * 1.03).cast("string"), F.lit("abc"), F.lit("-5"), F.lit("1e999"))
    prices = SC.parse_prices(d.select("symbol", "T", F.explode(texts).alias("price_text")))
    w = SC.what_if(d, prices, lev, "1d", LCFG)
    return w.select("T", r("P").alias("P"), r("normalized").alias("normalized"))


@query("what_if_rejects", build("SELECT x AS price_text, count(*) AS n FROM dec_l, (VALUES ('abc'), ('-5'), ('1e999'), ('0')) v(x) GROUP BY x"))
def what_if_rejects(spark, sf):
    d, _ = detail_l(spark, sf)
    texts = F.array((F.col("P")).cast("string"), F.lit("abc"), F.lit("-5"), F.lit("1e999"), F.lit("0"))
    return SC.parse_prices(d.select("T", F.explode(texts).alias("price_text"))).filter("bad").groupBy("price_text").agg(F.count(F.lit(1)).alias("n"))


# ---- slopes --------------------------------------------------------------------------

N = 4
cte("slope_e", f"SELECT side, idx, end_time AS T, close, src, src_price, src_open, ln(close / src_price) / (idx - src) AS slope FROM swing_e{N} WHERE src IS NOT NULL")
cte("pct_e", """SELECT a.*, count(b.T) AS n, CASE WHEN a.slope <> 0 AND count(b.T) >= 30 THEN 100 * (count(*) FILTER (WHERE abs(b.slope) < abs(a.slope)) + 0.5::DOUBLE * count(*) FILTER (WHERE abs(b.slope) = abs(a.slope))) / count(b.T) END AS p, sign(a.slope) AS dir,
  quantile_cont(abs(b.slope), 0.5) AS med, quantile_cont(abs(b.slope), 0.9) AS p90 FROM slope_e a LEFT JOIN slope_e b ON b.side = a.side AND sign(b.slope) = sign(a.slope) AND a.slope <> 0 AND b.T < a.T AND b.T >= a.T - 864000000 GROUP BY a.side, a.idx, a.T, a.close, a.src, a.src_price, a.src_open, a.slope""")


def stream_e(spark, sf):
    """Read several times below, so it is written once: the trades behind it are scanned once."""
    return materialize(SL.slope_stream(bars_e(spark, sf, "1h"), N), "slopes")


def points_e(spark, sf):
    return materialize(SL.slope_percentile(stream_e(spark, sf), CFG, HOUR, T0), "slope-points")


@query("slope_stream", build("SELECT side, idx, src AS source_idx, round(slope, 9) + 0.0::DOUBLE AS slope FROM slope_e"))
def slope_stream(spark, sf):
    return stream_e(spark, sf).select("side", "idx", F.col("swing.idx").alias("source_idx"), r("slope", 9).alias("slope"))


@query("midrank_window", build("SELECT side, T, n AS sample_count, round(p, 5) AS percentile FROM pct_e"))
def midrank_window(spark, sf):
    return points_e(spark, sf).select("side", "T", "sample_count", r("percentile", 5).alias("percentile"))


cte("velo_e", """SELECT *, CASE WHEN s1 = src AND d1 = dir AND i1 = idx - 1 THEN p - p1 END AS velocity, CASE WHEN s1 = src AND d1 = dir AND i1 = idx - 1 AND s2 = src AND d2 = d1 AND i2 = i1 - 1 THEN (p - p1) - (p1 - p2) END AS acceleration
  FROM (SELECT *, lag(p) OVER w AS p1, lag(src) OVER w AS s1, lag(dir) OVER w AS d1, lag(idx) OVER w AS i1, lag(p, 2) OVER w AS p2, lag(src, 2) OVER w AS s2, lag(dir, 2) OVER w AS d2, lag(idx, 2) OVER w AS i2 FROM pct_e WINDOW w AS (PARTITION BY side ORDER BY idx))""")


@query("slope_velocity", build("SELECT side, T, round(velocity, 5) + 0.0::DOUBLE AS velocity, round(acceleration, 5) + 0.0::DOUBLE AS acceleration FROM velo_e"))
def slope_velocity(spark, sf):
    v = SL.slope_velocity(points_e(spark, sf))
    return v.select("side", "T", r("velocity", 5).alias("velocity"), r("acceleration", 5).alias("acceleration"))


PSTATE = "CASE WHEN slope = 0 THEN 'FLAT' WHEN p IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN p >= 95 THEN 'EXTREME' WHEN p >= 90 THEN 'STRETCHED' WHEN p >= 75 THEN 'ELEVATED' ELSE 'NORMAL' END"


@query("slope_state", build(f"SELECT side, T, {PSTATE} AS state, CASE WHEN p IS NOT NULL THEN round(med, 9) END AS historical_median, round(p90, 9) AS p90, CASE WHEN p IS NOT NULL AND med > 0 THEN round(abs(slope) / med, 5) END AS stretch_ratio FROM pct_e"))
def slope_state(spark, sf):
    s = SL.slope_state(stream_e(spark, sf), points_e(spark, sf), CFG)
    return s.select("side", "T", "state", r("historical_median", 9).alias("historical_median"), r(F.col("quantiles")[3], 9).alias("p90"), r("stretch_ratio", 5).alias("stretch_ratio"))


cte("entry_e", """SELECT * FROM (SELECT *, lag(p) OVER w AS p1, lag(src) OVER w AS s1, lag(idx) OVER w AS i1 FROM pct_e WINDOW w AS (PARTITION BY side ORDER BY idx)) WHERE p >= 95 AND NOT coalesce(p1 >= 95 AND s1 = src AND i1 = idx - 1, false)""")


@query("slope_diagnostics", build("""SELECT e.side, e.T, h AS horizon, CASE WHEN b.close IS NULL THEN 'PENDING' WHEN ln(b.close / e.src_price) * e.slope > 0 THEN 'OBSERVED' ELSE 'DIRECTION_CHANGED' END AS status, round(ln(b.close / e.src_price) / (e.idx + h - e.src), 9) + 0.0::DOUBLE AS later_slope
  FROM entry_e e CROSS JOIN (SELECT unnest([4, 8, 16, 32])::BIGINT AS h) LEFT JOIN bars_e1h b ON b.idx = e.idx + h"""))
def slope_diagnostics(spark, sf):
    d = SL.diagnostics(points_e(spark, sf), bars_e(spark, sf, "1h"), CFG)
    return d.select("side", "T", "horizon", "status", r("later_slope", 9).alias("later_slope"))


@query("slope_series", build("SELECT side, T, round(p, 5) AS percentile, round(velocity, 5) + 0.0::DOUBLE AS velocity FROM velo_e WHERE idx > (SELECT max(idx) FROM slope_e) - 48"))
def slope_series(spark, sf):
    v = SL.last_points(SL.slope_velocity(points_e(spark, sf)), 48)
    return v.select("side", "T", r("percentile", 5).alias("percentile"), r("velocity", 5).alias("velocity"))


@query("slope_all", build(" UNION ALL ".join(f"SELECT '{name}' AS scale, side, T, CASE WHEN slope > 0 THEN 'BALANCED + SUPPORT UP' WHEN slope < 0 THEN 'BALANCED + SUPPORT DOWN' ELSE 'BALANCED + SUPPORT FLAT' END AS description FROM (SELECT side, end_time AS T, ln(close / src_price) AS slope FROM swing_e{n} WHERE src IS NOT NULL)" for name, n in CFG.slopes.swings.items())))
def slope_all(spark, sf):
    """Three swing scales and both sides, with the text a dashboard shows."""
    b, out = bars_e(spark, sf, "1h"), None
    for name, n in CFG.slopes.swings.items():
        s = SL.slope_stream(b, n)
        d = s.select(F.lit(name).alias("scale"), "side", "T", SL.describe_text(F.lit("BALANCED"), F.lit("SUPPORT"), F.col("direction")).alias("description"))
        out = d if out is None else out.unionByName(d)
    return out
