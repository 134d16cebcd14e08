"""The full map, its geometry, contacts and flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import DAY, HOUR, WIDTHS
from tidemark.functions.columns import contribution, known, long, r
from tidemark.functions.intervals import union_intervals
from tidemark.operators import detectors as D
from tidemark.operators import flow as FL
from tidemark.operators import fullmap as M
from tidemark.operators import profiles as P
from tidemark.operators import quality as Q
from tidemark.plans import q_volume  # noqa: F401  (its SQL blocks)
from tidemark.plans.base import T0, bars_e, bars_l, tape_e
from tidemark.plans.q_quality import quarantine
from tidemark.plans.registry import build, cte, query
from tidemark.session import materialize

LB_L, LB_E = 850 * DAY, 10 * DAY
W_L, W_E = WIDTHS["1d"], WIDTHS["1h"]


def state_l(spark, sf):
    b = bars_l(spark, sf)
    return M.decisions(Q.complete_lookback(b, 850)), D.detect_a(b)


def state_e(spark, sf, bars=None):
    b = materialize(bars_e(spark, sf, "1h"), "bars-1h") if bars is None else bars
    return M.decisions(Q.complete_lookback(b, 240)), D.detect_a(b)


cte("dec_l", "SELECT symbol, end_time AS T, close AS P FROM (SELECT *, count(*) OVER (ORDER BY idx RANGE BETWEEN 849 PRECEDING AND CURRENT ROW) AS n FROM bars_l1d) WHERE n = 850")
cte("dec_e", "SELECT symbol, end_time AS T, close AS P FROM (SELECT *, count(*) OVER (ORDER BY idx RANGE BETWEEN 239 PRECEDING AND CURRENT ROW) AS n FROM bars_e1h) WHERE n = 240")


def weight_sql(w: str, p="l.price", P="d.P") -> str:
    return f"""CASE WHEN {P} < {p} * (1 + {w}::DOUBLE) AND {P} > {p} * (1 - {w}::DOUBLE) THEN 1.0::DOUBLE
  WHEN ({P} >= {p} * (1 + {w}::DOUBLE) AND {P} < {p} * (1 + 1.5::DOUBLE * {w}::DOUBLE)) OR ({P} <= {p} * (1 - {w}::DOUBLE) AND {P} > {p} * (1 - 1.5::DOUBLE * {w}::DOUBLE)) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"""


def active_sql(dec: str, lev: str, lookback: int, w: str) -> str:
    return f"""SELECT d.T, d.P, l.kind, l.price, l.source_timestamp, l.known_at, l.dependency_start, l.kind || ':' || l.source_timestamp || ':' || l.known_at AS lid, {weight_sql(w)} AS weight
  FROM {dec} d JOIN {lev} l ON l.known_at <= d.T AND l.dependency_start >= d.T - {lookback}"""


cte("act_l", active_sql("dec_l", "lev_l", LB_L, "0.022"))
cte("act_e", active_sql("dec_e", "lev_e1h", LB_E, "0.004"))


@query("join_active_map", build("SELECT T, kind, count(*) AS n, round(sum(price), 4) AS total_price FROM act_l GROUP BY ALL"))
def join_active_map(spark, sf):
    d, lev = state_l(spark, sf)
    return M.active_map(d, lev, LB_L).groupBy("T", "kind").agg(F.count(F.lit(1)).alias("n"), r(F.sum("price"), 4).alias("total_price"))


@query("expiring_membership", build("SELECT T, kind, source_timestamp, known_at FROM act_e"))
def expiring_membership(spark, sf):
    d, lev = state_e(spark, sf)
    return M.active_map(d, lev, LB_E).select("T", "kind", "source_timestamp", "known_at")


@query("contribution", build("SELECT T, kind, source_timestamp, known_at, weight FROM act_e WHERE weight > 0"))
def contribution_(spark, sf):
    """Through the full product of live levels: the plain form of the proximity rule."""
    d, lev = state_e(spark, sf)
    a = M.active_map(d, lev, LB_E).withColumn("weight", contribution(F.col("price"), F.col("P"), F.lit(W_E)))
    return a.filter("weight > 0").select("T", "kind", "source_timestamp", "known_at", "weight")


@query("contributions_table", build("SELECT T, kind, source_timestamp, known_at, weight, CASE WHEN kind = 'SUPPORT' THEN weight ELSE -weight END AS long_contribution, CASE WHEN kind = 'SUPPORT' THEN -weight ELSE weight END AS short_contribution FROM act_l WHERE weight > 0"))
def contributions_table(spark, sf):
    d, lev = state_l(spark, sf)
    c = M.contributions(M.near_map(d, lev, LB_L, W_L), W_L)
    return c.select("T", "kind", "source_timestamp", "known_at", "weight", "long_contribution", "short_contribution")


def score_sql(act: str, dec: str) -> str:
    c = lambda k, w: f"count(*) FILTER (WHERE kind = '{k}' AND weight = {w})"
    return f"""SELECT *, full_support + half_support AS support_count, full_resistance + half_resistance AS resistance_count,
  (full_support - full_resistance)::DOUBLE AS A2, (full_support - full_resistance) + 0.5::DOUBLE * (half_support - half_resistance) AS A1,
  (full_support + half_support - full_resistance - half_resistance) / nullif((full_support + half_support + full_resistance + half_resistance)::DOUBLE, 0) AS imbalance
  FROM (SELECT d.T, d.P, coalesce(fs, 0) AS full_support, coalesce(fr, 0) AS full_resistance, coalesce(hs, 0) AS half_support, coalesce(hr, 0) AS half_resistance FROM {dec} d LEFT JOIN
    (SELECT T, {c('SUPPORT', 1)} AS fs, {c('RESISTANCE', 1)} AS fr, {c('SUPPORT', 0.5)} AS hs, {c('RESISTANCE', 0.5)} AS hr FROM {act} GROUP BY T) USING (T))"""


cte("score_l", score_sql("act_l", "dec_l"))
cte("score_e", score_sql("act_e", "dec_e"))


def score_l(spark, sf):
    d, lev = state_l(spark, sf)
    return M.native_score(d, M.near_map(d, lev, LB_L, W_L), W_L)


def score_e(spark, sf):
    d, lev = state_e(spark, sf)
    return M.native_score(d, M.near_map(d, lev, LB_E, W_E), W_E)


@query("native_score", build("SELECT T, full_support, full_resistance, half_support, half_resistance, support_count, resistance_count, A1, A2, 0.0::DOUBLE - A1 AS short_score, round(imbalance, 6) AS imbalance FROM score_l"))
def native_score(spark, sf):
    s = score_l(spark, sf)
    return s.select("T", "full_support", "full_resistance", "half_support", "half_resistance", "support_count", "resistance_count", "A1", "A2", "short_score", r("imbalance").alias("imbalance"))


def raw_sql() -> str:
    cols = []
    for side in ("SUPPORT", "RESISTANCE"):
        n, on = side.lower(), f"kind = '{side}'"
        f = lambda cond, name: f"count(*) FILTER (WHERE {on} AND {cond}) AS {n}_{name}"
        cols += [
            f("true", "total"), f("weight <> 1 AND price > P", "above"), f("weight <> 1 AND price <= P", "below"), f("weight = 1", "near"),
            f("weight = 1", "density_inner"), f("weight = 0.5", "density_outer"), f("weight = 0 AND abs(P / price - 1) < 3 * 0.022::DOUBLE", "density_to_three"),
            f("weight = 0 AND abs(P / price - 1) >= 3 * 0.022::DOUBLE AND abs(P / price - 1) < 10 * 0.022::DOUBLE", "density_to_ten"), f("weight = 0 AND abs(P / price - 1) >= 10 * 0.022::DOUBLE", "density_beyond_ten"),
            f"round(avg(abs(price / P - 1)) FILTER (WHERE {on}), 7) AS {n}_mean_distance",
            f"round(arg_min(price, ROW(abs(price - P), known_at, source_timestamp, price)) FILTER (WHERE {on}), 6) AS {n}_nearest_price",
        ]
    age = "(T - source_timestamp) / 3600000::DOUBLE"
    cols += [f"round({a} FILTER (WHERE weight > 0), 4) AS age_{k}" for k, a in (("min", f"min({age})"), ("median", f"median({age})"), ("mean", f"avg({age})"), ("max", f"max({age})"))]
    return f"SELECT T, {', '.join(cols)} FROM act_l GROUP BY T, P"


cte("raw_l", raw_sql())
RAW = [f"{s}_{c}" for s in ("support", "resistance") for c in ("total", "above", "below", "near", "density_inner", "density_outer", "density_to_three", "density_to_ten", "density_beyond_ten")]


@query("raw_map", build("SELECT * FROM raw_l"))
def raw_map(spark, sf):
    d, lev = state_l(spark, sf)
    m = M.raw_map(M.active_map(d, lev, LB_L), W_L)
    return m.select(
        "T", *RAW, *[r(f"{s}_mean_distance", 7).alias(f"{s}_mean_distance") for s in ("support", "resistance")],
        *[r(f"{s}_nearest.p").alias(f"{s}_nearest_price") for s in ("support", "resistance")], *[r(f"age_{k}", 4).alias(f"age_{k}") for k in ("min", "median", "mean", "max")],
    )


@query("nearest_level", build("SELECT T, kind, round(arg_min(price, ROW(abs(price - P), known_at, source_timestamp, price)), 6) AS price, arg_min(known_at, ROW(abs(price - P), known_at, source_timestamp, price)) AS known_at FROM act_e GROUP BY ALL"))
def nearest_level(spark, sf):
    d, lev = state_e(spark, sf)
    return M.nearest_level(M.active_map(d, lev, LB_E)).select("T", "kind", r("price").alias("price"), "known_at")


cte("clus_e", """SELECT T, count(*) AS levels, sum(new)::BIGINT AS cluster_count, count(*) - count(DISTINCT price) AS duplicate_price_count FROM (
    SELECT T, price, CASE WHEN lo > lag(hi) OVER w OR lag(hi) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM (SELECT T, price, price * (1 - 0.004::DOUBLE) AS lo, price * (1 + 0.004::DOUBLE) AS hi FROM act_e) WINDOW w AS (PARTITION BY T ORDER BY price)) GROUP BY T""")
cte("pairs_e", """SELECT a.T, count(*) AS overlap_pair_count FROM (SELECT *, row_number() OVER (PARTITION BY T ORDER BY price, lid) AS n FROM act_e) a JOIN (SELECT *, row_number() OVER (PARTITION BY T ORDER BY price, lid) AS n FROM act_e) b
    ON a.T = b.T AND a.n < b.n AND b.price * (1 - 0.004::DOUBLE) <= a.price * (1 + 0.004::DOUBLE) GROUP BY 1""")


@query("cluster_count", build("SELECT c.T, levels, cluster_count, duplicate_price_count, coalesce(overlap_pair_count, 0) AS overlap_pair_count FROM clus_e c LEFT JOIN pairs_e p USING (T)"))
def cluster_count(spark, sf):
    d, lev = state_e(spark, sf)
    c = M.clusters(M.active_map(d, lev, LB_E), W_E)
    return c.select("T", "levels", long("cluster_count").alias("cluster_count"), "duplicate_price_count", "overlap_pair_count")


def snapshot_e(spark, sf):
    d, lev = state_e(spark, sf)
    a = M.active_map(d, lev, LB_E)
    return M.normalized_state(M.native_score(d, M.near_map(d, lev, LB_E, W_E), W_E), M.raw_map(a, W_E), M.clusters(a, W_E))


cte("state_e", """SELECT s.T, s.P, s.A1, s.A2, s.imbalance, s.support_count AS nearby_support_count, s.resistance_count AS nearby_resistance_count, c.cluster_count, coalesce(p.overlap_pair_count, 0) AS overlap_pair_count,
  c.levels / c.cluster_count::DOUBLE AS levels_per_cluster, (r.st - r.rt) / (r.st + r.rt)::DOUBLE AS full_map_imbalance, r.age_mean, r.st, r.rt
  FROM score_e s LEFT JOIN clus_e c USING (T) LEFT JOIN pairs_e p USING (T) LEFT JOIN (SELECT T, count(*) FILTER (WHERE kind = 'SUPPORT') AS st, count(*) FILTER (WHERE kind = 'RESISTANCE') AS rt,
    avg((T - source_timestamp) / 3600000::DOUBLE) FILTER (WHERE weight > 0) AS age_mean FROM act_e GROUP BY T) r USING (T)""")


@query("snapshot", build("SELECT T, round(P, 6) AS P, A1, A2, nearby_support_count, nearby_resistance_count, cluster_count, overlap_pair_count, st AS support_total, rt AS resistance_total, round(age_mean, 4) AS age_mean FROM state_e"))
def snapshot(spark, sf):
    s = snapshot_e(spark, sf)
    return s.select("T", r("P").alias("P"), "A1", "A2", "nearby_support_count", "nearby_resistance_count", long("cluster_count").alias("cluster_count"), "overlap_pair_count", "support_total", "resistance_total", r("age_mean", 4).alias("age_mean"))


@query("normalized_state", build("SELECT T, round(imbalance, 6) AS imbalance, round(full_map_imbalance, 6) AS full_map_imbalance, round(levels_per_cluster, 6) AS levels_per_cluster FROM state_e"))
def normalized_state(spark, sf):
    return snapshot_e(spark, sf).select("T", *[r(c).alias(c) for c in ("imbalance", "full_map_imbalance", "levels_per_cluster")])




@query(
    "membership_delta",
    build("""SELECT t.T, t.lid, 1::BIGINT AS delta FROM act_e t WHERE NOT EXISTS (SELECT 1 FROM act_e p WHERE p.T = t.T - 3600000 AND p.lid = t.lid)
      UNION ALL SELECT p.T + 3600000, p.lid, -1 FROM act_e p WHERE p.T + 3600000 <= (SELECT max(T) FROM dec_e) AND NOT EXISTS (SELECT 1 FROM act_e t WHERE t.T = p.T + 3600000 AND t.lid = p.lid)"""),
)
def membership_delta(spark, sf):
    d, lev = state_e(spark, sf)
    return M.membership_delta(named(lev), d, LB_E, HOUR).select("T", F.col("candidate_id").alias("lid"), long("delta").alias("delta"))


def named(lev):
    return lev.withColumn("candidate_id", F.concat_ws(":", "kind", F.col("source_timestamp").cast("string"), F.col("known_at").cast("string")))


@query("membership_restore", build("SELECT T, lid FROM act_e"))
def membership_restore(spark, sf):
    d, lev = state_e(spark, sf)
    m = M.membership_restore(M.membership_delta(named(lev), d, LB_E, HOUR), d, DAY)
    return m.select("T", F.col("candidate_id").alias("lid"))


CROSS = """SELECT n.T, n.P, n.kind, n.lid, n.source_timestamp, count(*) FILTER (WHERE c.crossed) AS crossings, count(*) FILTER (WHERE c.touch AND NOT c.again) AS visits, (n.T - max(c.end_time) FILTER (WHERE c.touch)) / 3600000::DOUBLE AS hours_since_contact
  FROM (SELECT * FROM act_e WHERE weight > 0) n LEFT JOIN (SELECT l.kind || ':' || l.source_timestamp || ':' || l.known_at AS lid, b.end_time, (b.pc < l.price AND b.close > l.price) OR (b.pc > l.price AND b.close < l.price) AS crossed,
    b.low <= l.price AND b.high >= l.price AS touch, coalesce(lag(b.low <= l.price AND b.high >= l.price) OVER (PARTITION BY l.kind, l.source_timestamp, l.known_at ORDER BY b.idx), false) AS again
    FROM lev_e1h l JOIN (SELECT *, lag(close) OVER (ORDER BY idx) AS pc FROM bars_e1h) b ON b.open_time >= l.known_at) c ON c.lid = n.lid AND c.end_time <= n.T GROUP BY n.T, n.P, n.kind, n.lid, n.source_timestamp"""
cte("cross_e", CROSS)


def crossings_e(spark, sf):
    d, lev = state_e(spark, sf)
    lev = named(lev)
    near = M.with_weight(M.near_map(d, lev, LB_E, W_E), W_E).filter("weight > 0")
    return M.crossings(near, M.contacts(lev, bars_e(spark, sf, "1h"), 0.004))


@query("crossings", build("SELECT T, lid, crossings, visits, round(hours_since_contact, 4) AS hours_since_contact FROM cross_e"))
def crossings(spark, sf):
    c = crossings_e(spark, sf)
    return c.select("T", F.col("candidate_id").alias("lid"), "crossings", "visits", r("hours_since_contact", 4).alias("hours_since_contact"))


@query(
    "age_band_features",
    build("""SELECT T, CASE WHEN a <= 720 THEN 'recent_0_30d' WHEN a <= 4320 THEN 'medium_30_180d' WHEN a <= 8760 THEN 'old_180_365d' ELSE 'very_old_over_365d' END AS age_band, count(*) AS count, count(*) FILTER (WHERE kind = 'SUPPORT') AS support,
      count(*) FILTER (WHERE kind = 'RESISTANCE') AS resistance FROM (SELECT *, (T - source_timestamp) / 3600000::DOUBLE AS a FROM act_l WHERE weight > 0) GROUP BY ALL"""),
)
def age_band_features(spark, sf):
    d, lev = state_l(spark, sf)
    near = M.with_weight(M.near_map(d, lev, LB_L, W_L), W_L).filter("weight > 0")
    return M.age_bands(near.withColumn("crossings", F.lit(0)).withColumn("visits", F.lit(0))).select("T", "age_band", "count", "support", "resistance")


@query("age_band_contacts", build("SELECT T, count(*) AS count, round(avg(crossings), 6) AS mean_crossings, round(avg(visits), 6) AS mean_visits FROM cross_e GROUP BY T"))
def age_band_contacts(spark, sf):
    b = M.age_bands(crossings_e(spark, sf))
    return b.select("T", "count", r("mean_crossings").alias("mean_crossings"), r("mean_visits").alias("mean_visits"))


# ---- intervals and flow --------------------------------------------------------------

SIDES_SQL = """SELECT T, lower(kind) AS side, price * (1 - 0.004::DOUBLE) AS lo, price * (1 + 0.004::DOUBLE) AS hi FROM act_e WHERE weight > 0
  UNION ALL SELECT T, 'joint', price * (1 - 0.004::DOUBLE), price * (1 + 0.004::DOUBLE) FROM act_e WHERE weight > 0"""


def union_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY {keys} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ({src}))) GROUP BY {keys}, run"""


def equals_together(sql: str) -> str:
    """The same unions with equal intervals always in one run: a frame of rows may put the one that opens a run behind its equal."""
    return sql.replace("ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run", "ORDER BY lo, hi) AS run")


cte("uni_e", union_sql(SIDES_SQL, "T, side"))


def near_e(spark, sf, bars=None):
    d, lev = state_e(spark, sf, bars)
    return d, M.with_weight(M.near_map(d, lev, LB_E, W_E), W_E).filter("weight > 0")


@query("interval_union", equals_together(build("SELECT T, side, round(lo, 9) AS lower, round(hi, 9) AS upper FROM uni_e")))
def interval_union(spark, sf):
    _, near = near_e(spark, sf)
    return FL.zone_unions(near, W_E).select("T", "side", r("lower", 9).alias("lower"), r("upper", 9).alias("upper"))


@query("interval_distance", build("SELECT T, side, round(min(greatest(lo - P, 0, P - hi)), 9) AS distance FROM uni_e JOIN dec_e USING (T) GROUP BY ALL"))
def interval_distance(spark, sf):
    from tidemark.functions.columns import interval_distance as dist

    d, near = near_e(spark, sf)
    u = FL.zone_unions(near, W_E).join(d, ["symbol", "tf", "T"])
    return u.groupBy("T", "side").agg(r(F.min(dist(F.col("P"), F.col("lower"), F.col("upper"))), 9).alias("distance"))


def flow_sql(windows) -> str:
    s = lambda side, c: f"coalesce((SELECT sum(p.{c}) FROM uni_e u JOIN prof_e p ON p.price BETWEEN u.lo AND u.hi WHERE u.T = d.T AND u.side = '{side}' AND p.bucket >= d.T - w * 3600000 AND p.bucket < d.T), 0)"
    cols = ", ".join(f"{s(x, c)} AS {x}_{c}" for x in FL.SIDES for c in ("quantity", "buy", "sell"))
    return f"""SELECT d.T, w AS "window", CASE WHEN EXISTS (SELECT 1 FROM quar q WHERE d.T - w * 3600000 < q.e AND d.T > q.s) THEN 'QUARANTINED' ELSE 'AVAILABLE' END AS flow_status, {cols}
  FROM dec_e d, (SELECT unnest([{', '.join(map(str, windows))}])::BIGINT AS w)"""


cte("flow_e", flow_sql((1, 4, 8)))


def flow_e(spark, sf, bars=None):
    d, near = near_e(spark, sf, bars)
    prof = materialize(P.profile(tape_e(spark, sf), HOUR), "profile")
    return FL.zone_flow(d, FL.zone_unions(near, W_E), prof, HOUR, (1, 4, 8), materialize(quarantine(spark, sf), "spans"))


OKF = "CASE WHEN flow_status = 'AVAILABLE' THEN {} END"
FLOW_COLS = ", ".join(f"{OKF.format(f'round({s}_{c}, 6)')} AS {s}_{c}" for s in FL.SIDES for c in ("quantity", "buy", "sell"))


@query("zone_flow_windows", build(f"""SELECT T, "window", flow_status, {FLOW_COLS}, {OKF.format('round(support_quantity + resistance_quantity - joint_quantity, 6) + 0.0::DOUBLE')} AS shared_quantity,
  {OKF.format('round(support_buy - support_sell - resistance_buy + resistance_sell, 6) + 0.0::DOUBLE')} AS raw_delta_difference FROM flow_e"""))
def zone_flow_windows(spark, sf):
    f = flow_e(spark, sf)
    cols = [f"{s}_{c}" for s in FL.SIDES for c in ("quantity", "buy", "sell")] + ["shared_quantity", "raw_delta_difference"]
    return f.select("T", "window", "flow_status", *[r(c).alias(c) for c in cols])


@query(
    "zone_flow_1h",
    build(f"""SELECT T, flow_status, {OKF.format('CASE WHEN round(support_quantity, 6) > 0 THEN round((round(support_buy, 6) - round(support_sell, 6)) / round(support_quantity, 6), 5) + 0.0::DOUBLE END')} AS support_normalized_delta,
      {OKF.format('CASE WHEN round(support_quantity + resistance_quantity, 6) > 0 THEN round(round(support_quantity, 6) / (round(support_quantity, 6) + round(resistance_quantity, 6)), 5) END')} AS support_volume_share FROM flow_e WHERE "window" = 1"""),
)
def zone_flow_1h(spark, sf):
    f = flow_e(spark, sf).filter(F.col("window") == 1)
    q, b, s, o = (r(c) for c in ("support_quantity", "support_buy", "support_sell", "resistance_quantity"))
    return f.select("T", "flow_status", F.when(q > 0, r((b - s) / q, 5)).alias("support_normalized_delta"), F.when(q + o > 0, r(q / (q + o), 5)).alias("support_volume_share"))


@query("attach_flow", build(f"""SELECT s.T, s.A1, f.flow_status, {OKF.format('round(f.joint_quantity, 6)')} AS quantity, {OKF.format('round(f.joint_buy - f.joint_sell, 6) + 0.0::DOUBLE')} AS delta FROM score_e s LEFT JOIN flow_e f ON f.T = s.T AND f."window" = 1"""))
def attach_flow(spark, sf):
    a = FL.attach_flow(score_e(spark, sf), flow_e(spark, sf), 1)
    return a.select("T", "A1", "flow_status", r("joint_quantity").alias("quantity"), r("joint_delta").alias("delta"))


@query("hourly_flow_extract", build(f"""SELECT T AS observation_end, T - 3600000 AS observation_start, flow_status, {OKF.format('round(support_quantity, 6)')} AS support_quantity, {OKF.format('round(resistance_quantity, 6)')} AS resistance_quantity FROM flow_e WHERE "window" = 1"""))
def hourly_flow_extract(spark, sf):
    """The nested volume record of a snapshot, read back to flat columns."""
    f = flow_e(spark, sf).filter(F.col("window") == 1)
    nested = f.select(F.struct("observation_start", F.col("T").alias("observation_end"), F.col("flow_status").alias("status"),
                               F.struct(F.col("support_quantity").alias("quantity")).alias("support"), F.struct(F.col("resistance_quantity").alias("quantity")).alias("resistance")).alias("volume"))
    v = lambda p: F.col(f"volume.{p}")
    return nested.select(v("observation_end"), v("observation_start"), v("status").alias("flow_status"), r(v("support.quantity")).alias("support_quantity"), r(v("resistance.quantity")).alias("resistance_quantity"))


@query("nearby_filter", build("SELECT T, count(*) FILTER (WHERE weight = 1) AS full_band, count(*) FILTER (WHERE weight = 0.5) AS half_band FROM act_e WHERE weight > 0 GROUP BY T"))
def nearby_filter(spark, sf):
    _, near = near_e(spark, sf)
    c = lambda w: F.count(F.when(F.col("weight") == w, 1))
    return near.groupBy("T").agg(c(1.0).alias("full_band"), c(0.5).alias("half_band"))


@query("join_interval_overlap", build("""WITH spans AS (SELECT min(s) AS s, max(e) AS e FROM (SELECT s, e, s - row_number() OVER (ORDER BY s) * 60000 AS island FROM quar) GROUP BY island)
  SELECT count(*) AS pairs FROM vis_sep v JOIN spans q ON v.start < q.e AND v.observed_at > q.s"""))
def join_interval_overlap(spark, sf):
    """Pairs of a visit's first bar and a quarantine interval that overlap; adjacent quarantined minutes are one interval."""
    from tidemark.functions.intervals import in_buckets
    from tidemark.plans.q_levels import visits_e

    v = visits_e(spark, sf, 0.001, 0.003).select("start", "observed_at")
    v = in_buckets(v, F.col("start"), F.col("observed_at"), HOUR)
    q = in_buckets(quarantine(spark, sf).select(F.col("start").alias("s"), F.col("end").alias("e")), F.col("s"), F.col("e"), HOUR)
    first = F.col("_b") == F.floor(F.greatest("start", "s") / F.lit(HOUR))
    j = v.join(q, "_b").filter((F.col("start") < F.col("e")) & (F.col("observed_at") > F.col("s")) & first)
    return j.agg(F.count(F.lit(1)).alias("pairs"))


@query("overlap_pairs_top3", build("""SELECT rank, a_known, b_known FROM (SELECT row_number() OVER (ORDER BY a.known_at, a.lid, b.known_at, b.lid) AS rank, a.known_at AS a_known, b.known_at AS b_known
  FROM (SELECT 'A' AS det, 'A:' || kind || ':' || source_timestamp || ':' || known_at AS lid, known_at, price FROM lev_l) a JOIN (SELECT 'C:' || kind || ':' || source_timestamp || ':' || known_at AS lid, known_at, price FROM c_l) b
  ON greatest(a.price * (1 - 0.001::DOUBLE), b.price * (1 - 0.001::DOUBLE)) <= least(a.price * (1 + 0.001::DOUBLE), b.price * (1 + 0.001::DOUBLE))) WHERE rank <= 3"""))
def overlap_pairs_top3(spark, sf):
    """First three overlapping zone pairs of detectors A and C, found through shared price buckets."""
    from pyspark.sql import Window

    b, w = bars_l(spark, sf), 0.001
    size = w * 2.1

    def side(d, tag, name):
        p = D.detect(b, d, *([0.03] if d == "C" else []))
        bucket = F.floor(F.log("price") / F.lit(size))
        p = p.select(F.concat_ws(":", F.lit(tag), "kind", F.col("source_timestamp").cast("string"), F.col("known_at").cast("string")).alias(f"{name}_id"), F.col("known_at").alias(f"{name}_known"), F.col("price").alias(f"{name}_price"), bucket.alias("_b"))
        return p

    a, c = side("A", "A", "a"), side("C", "C", "b")
    a = a.withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
    j = a.join(c, "_b").filter(F.greatest(F.col("a_price") * (1 - w), F.col("b_price") * (1 - w)) <= F.least(F.col("a_price") * (1 + w), F.col("b_price") * (1 + w)))
    top = j.orderBy("a_known", "a_id", "b_known", "b_id").limit(3)
    rank = F.row_number().over(Window.orderBy("a_known", "a_id", "b_known", "b_id")).cast("long")
    return top.select(rank.alias("rank"), "a_known", "b_known")
