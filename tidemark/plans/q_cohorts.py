"""Cohorts over repriced states, stability tables, deep-dive facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import DAY, HORIZONS, HOUR, TFS
from tidemark.functions.columns import bucket_left, long, percent_bucket, r, week_of
from tidemark.operators import cohorts as H
from tidemark.operators import confluence as X
from tidemark.operators import context as C
from tidemark.operators import outcomes as O
from tidemark.operators import resampling as R
from tidemark.operators import stats as S
from tidemark.plans import q_confluence, q_levels, q_map, q_stats
from tidemark.plans.base import T0
from tidemark.plans.q_confluence import repriced
from tidemark.plans.q_levels import outcome_sql, plain_events
from tidemark.plans.registry import build, cte, query
from tidemark.session import materialize

GRID = S.GRID
HALF = T0 + 20 * DAY
cte("ev_c15", "SELECT symbol || ':' || end_time AS event_id, symbol, idx, end_time AS T, close AS P FROM bars_e15m WHERE end_time >= %d" % (T0 + 10 * DAY))
cte("out_c15", outcome_sql("ev_c15", "bars_e15m", 900_000, HORIZONS["15m"]))


def states(spark, sf):
    w = X.wide_states(repriced(spark, sf))
    return w.withColumn("event_id", F.concat_ws(":", "symbol", F.col("T").cast("string"))).withColumn("week", week_of(F.col("T"))).withColumn("quarter", F.when(F.col("T") < HALF, "H1").otherwise("H2"))


_WRITTEN: dict[tuple, object] = {}  # tables that several queries of one session read: written once per input folder


def bars(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "bars")
    if key not in _WRITTEN:
        _WRITTEN[key] = q_confluence.stored_bars(spark, sf)
    return _WRITTEN[key]


def outcomes15(spark, sf):
    b = bars(spark, sf)["15m"]
    return O.measure(plain_events(b).filter(F.col("T") >= T0 + 10 * DAY), b, HORIZONS["15m"])


cte("pat", f"SELECT T, 'ALL:' || T AS event_id, pattern, T // 604800000 AS week, CASE WHEN T < {HALF} THEN 'H1' ELSE 'H2' END AS quarter, v FROM wide_p")


BLOCK = DAY  # the tape spans thirty days, and an interval needs five blocks
FLOWS = ("joint_quantity", *H.DELTAS)
FIELDS = (*FLOWS, *[f"{tf}__imbalance" for tf in TFS])
ONE = "list_sort(list_distinct(quantile_cont({}, [0.25, 0.5, 0.75])))"
N = "(4 - length(replace({0}, {1}, '')))"

cte("ways", "SELECT * FROM (VALUES ('support', 'S', 'R', 'LONG'), ('resistance', 'R', 'S', 'SHORT')) v(side, ch, oth, way)")
cte("subs", "SELECT * FROM (VALUES " + ", ".join(f"('{'+'.join(TFS[i] for i in x)}', '{''.join('X' if i in x else '.' for i in range(4))}', {len(x)})" for x in H.SUBSETS) + ") v(name, mask, size)")
cte("adds", "SELECT * FROM (VALUES " + ", ".join(f"('{'+'.join(b)}', '{''.join('X' if t in b else '.' for t in TFS)}', '{x}', {TFS.index(x) + 1})" for b, x in H.ADDITIONS) + ") v(base, mask, added, i)")
cte("reg_c", "SELECT DISTINCT T, side, combination, timeframe_count FROM components")
cte("cfr", f"""SELECT s.T, 'ALL:' || s.T AS event_id, s.T // {BLOCK} AS block, CASE WHEN s.T < {HALF} THEN 'H1' ELSE 'H2' END AS quarter, imbalance_pattern AS ip, a1_pattern AS ap, {' || '.join(q_confluence.SIGN.format(c=f'b{i}') for i in range(4))} AS bp,
  coalesce((SELECT max(timeframe_count) FROM reg_c k WHERE k.T = s.T AND side = 'support'), 0) AS zs, coalesce((SELECT max(timeframe_count) FROM reg_c k WHERE k.T = s.T AND side = 'resistance'), 0) AS zr,
  round(joint_quantity, 6) AS f0, CASE WHEN round(support_quantity, 6) > 0 THEN round((round(support_buy, 6) - round(support_sell, 6)) / round(support_quantity, 6), 5) END AS f1,
  CASE WHEN round(resistance_quantity, 6) > 0 THEN round((round(resistance_buy, 6) - round(resistance_sell, 6)) / round(resistance_quantity, 6), 5) END AS f2, round(joint_buy - joint_sell, 6) AS f3,
  {', '.join(f'abs(round(m{i}, 9)) AS f{4 + i}' for i in range(4))}
  FROM signs s LEFT JOIN (SELECT * FROM flow_e WHERE "window" = 1 AND flow_status = 'AVAILABLE') f ON f.T = s.T // 3600000 * 3600000""")
cte("cfm", f"SELECT {', '.join(ONE.format(f'f{i}') + f' AS c{i}' for i in range(8))} FROM cfr")
cte("cfb", f"SELECT cfr.*, {', '.join(f'CASE WHEN f{i} IS NULL THEN -1 ELSE len(list_filter(c{i}, lambda x: x < f{i})) END AS q{i}, len(c{i}) AS t{i}' for i in range(8))} FROM cfr, cfm")
cte("descr", "SELECT event_id, block, quarter, 'imbalance' AS d, ip AS p FROM cfb UNION ALL SELECT event_id, block, quarter, 'A1', ap FROM cfb UNION ALL SELECT event_id, block, quarter, 'A2', bp FROM cfb")
cte("sided", f"SELECT b.*, w.*, CASE side WHEN 'support' THEN zs ELSE zr END AS z, {N.format('ip', 'ch')} AS n, {N.format('ip', 'oth')} AS o FROM cfb b, ways w")
_K = "event_id, block, quarter"
_OVER = "CASE WHEN z >= 2 THEN 'overlap' ELSE 'no_overlap' END"
_ALL4 = "ip = repeat(ch, 4)"
MEMBERS = [
    f"SELECT {_K}, 'all' AS category, 'baseline' AS family, 'BOTH' AS interpretation FROM cfb",
    f"SELECT {_K}, d || '/pattern/' || p, 'exact_pattern', 'BOTH' FROM descr",
    f"SELECT {_K}, d || '/' || side || '/count/' || {N.format('p', 'ch')}, 'sign_count', way FROM descr, ways WHERE NOT contains(p, 'M')",
    f"SELECT {_K}, d || '/' || side || '/unopposed/' || {N.format('p', 'ch')}, 'unopposed_count', way FROM descr, ways WHERE NOT contains(p, 'M') AND NOT contains(p, oth)",
    f"SELECT {_K}, d || '/' || side || '/aligned/' || name, 'hierarchy_inclusive', way FROM descr, ways, subs WHERE regexp_full_match(p, replace(mask, 'X', ch))",
    f"SELECT {_K}, d || '/' || side || '/only/' || name, 'hierarchy_exclusive', way FROM descr, ways, subs WHERE regexp_full_match(p, replace(mask, 'X', ch)) AND NOT contains(p, 'M') AND {N.format('p', 'ch')} = size",
    f"SELECT {_K}, 'conflict/' || substr(ip, 1, 2) || '/' || substr(ip, 3, 2), 'conflict', 'BOTH' FROM cfb",
    f"""SELECT {_K}, 'incremental/' || side || '/' || base || '/add_' || added || '/' || label, 'incremental', way FROM (SELECT *, unnest(CASE substr(ip, i, 1) WHEN ch THEN ['agrees'] WHEN 'N' THEN ['neutral', 'not_agrees'] WHEN oth THEN ['conflicts', 'not_agrees'] ELSE ['missing'] END) AS label
      FROM cfb, ways, adds WHERE regexp_full_match(ip, replace(mask, 'X', ch)))""",
    f"SELECT {_K}, 'direction_space/' || side || '/agrees/' || {_OVER}, 'direction_space', way FROM sided WHERE n >= 2 AND o = 0",
    f"SELECT {_K}, 'direction_space/' || side || '/conflicts/' || {_OVER}, 'direction_space', way FROM sided WHERE n > 0 AND o > 0",
    f"SELECT {_K}, 'zone/' || side || '/count/' || z, 'zone_count', way FROM sided",
    f"SELECT {_K}, 'zone/' || s.side || '/combo/' || combination, 'zone_combination', way FROM sided s JOIN reg_c k ON k.T = s.T AND k.side = s.side",
    f"SELECT {_K}, 'joint/' || side || '/sign' || n || '/zone' || z, 'direction_x_space', way FROM sided",
    f"SELECT {_K}, 'spatial_increment/' || side || '/sign' || n || '/' || {_OVER}, 'spatial_increment', way FROM sided",
    f"SELECT {_K}, 'spatial_exact/' || side || '/' || ip || '/' || {_OVER}, 'spatial_exact', way FROM sided WHERE NOT contains(ip, 'M')",
    f"SELECT {_K}, 'quantity/' || side || '/count' || n || '/Q' || q0, 'quantity', way FROM sided",
    *[f"SELECT {_K}, 'delta/' || side || '/{f}/Q' || q{i + 1}, 'delta_exploratory', way FROM sided WHERE {_ALL4}" for i, f in enumerate(H.DELTAS)],
    *[f"SELECT {_K}, 'magnitude/' || side || '/{tf}/Q' || q{4 + i}, 'magnitude', way FROM sided WHERE {_ALL4}" for i, tf in enumerate(TFS)],
    f"""SELECT {_K}, 'magnitude/' || side || '/joint/' || CASE WHEN least(q4, q5, q6, q7) < 0 THEN 'missing' WHEN greatest(q4, q5, q6, q7) = 0 THEN 'weak' WHEN q4 = t4 AND q5 = t5 AND q6 = t6 AND q7 = t7 THEN 'strong'
      WHEN least(q4, q5, q6, q7) > 0 AND q4 < t4 AND q5 < t5 AND q6 < t6 AND q7 < t7 THEN 'moderate' ELSE 'mixed' END, 'magnitude', way FROM sided WHERE {_ALL4}""",
]
cte("memb", " UNION ALL ".join(MEMBERS))


def frame(spark, sf):
    """Aligned native states with three sign patterns, overlaps, hourly flow and strength buckets; and the cut counts."""
    b = bars(spark, sf)
    d = X.zone_overlap(X.sign_patterns(X.align(q_confluence.clock15(b), q_confluence.native(b))))
    q = {f"{s}_{c}": r(f"{s}_{c}") for s in ("support", "resistance", "joint") for c in ("quantity", "buy", "sell")}
    share = lambda s: F.when(q[f"{s}_quantity"] > 0, r((q[f"{s}_buy"] - q[f"{s}_sell"]) / q[f"{s}_quantity"], 5))
    flow = q_map.flow_e(spark, sf, b["1h"]).filter("window = 1 and flow_status = 'AVAILABLE'").select(
        F.col("T").alias("_h"), q["joint_quantity"].alias("joint_quantity"), share("support").alias(H.DELTAS[0]), share("resistance").alias(H.DELTAS[1]), r(F.col("joint_buy") - F.col("joint_sell")).alias(H.DELTAS[2])
    )
    d = d.join(flow, F.col("T") - F.pmod("T", F.lit(HOUR)) == F.col("_h"), "left")
    marks = [F.concat_ws(":", "symbol", F.col("T").cast("string")).alias("event_id"), F.floor(F.col("T") / BLOCK).alias("block"), F.when(F.col("T") < HALF, "H1").otherwise("H2").alias("quarter")]
    names = [f"{n}_pattern" for n in H.DESCRIPTORS] + [f"{s}_overlap_count" for s in X.SIDES]
    regions = [F.col(f"`{s}_overlap_{'+'.join(x)}`") for s in X.SIDES for x in X.SUBSETS]
    d = materialize(d.select("T", *marks, *names, *regions, *FLOWS, *[F.abs(r(f"`{tf}__imbalance`", 9)).alias(f"{tf}__imbalance") for tf in TFS]), "frame")
    model = materialize(C.fit_quantiles(d, FIELDS, 4, distinct=True), "cuts")
    tops = {m.field: len(m.cuts or []) for m in model.collect()}  # one number per field
    return C.apply_buckets(d, model, FIELDS, "left"), tops


def codes(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "codes")
    if key not in _WRITTEN:
        d, tops = frame(spark, sf)
        _WRITTEN[key] = materialize(H.facet_codes(d, {f: F.lit(n).cast("long") for f, n in tops.items()}), "codes"), tops
    return _WRITTEN[key]


def code_sums(spark, sf):
    """Sums per code, the names of all cohorts of a code, and the cut counts."""
    key = (spark.sparkContext.applicationId, sf, "code-sums")
    if key not in _WRITTEN:
        c, tops = codes(spark, sf)
        o = outcomes15(spark, sf).select("event_id", *GRID, "label", "censored", "mfe_pct", "mae_pct")
        _WRITTEN[key] = materialize(H.code_sums(c, o, GRID), "code-sums"), materialize(H.cohort_names(c), "cohort-names"), tops
    return _WRITTEN[key]


def sums(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "sums")
    if key not in _WRITTEN:
        per_code, names, tops = code_sums(spark, sf)
        _WRITTEN[key] = materialize(H.unfolded(per_code, names, ["category", "family", "interpretation", "block", "quarter", *GRID]), "cohort-sums"), tops
    return _WRITTEN[key]


@query("cohort_masks", build("SELECT category, family, interpretation, count(*) AS n FROM memb GROUP BY ALL"))
def cohort_masks(spark, sf):
    """States of every cohort, counted per code first."""
    c, _ = codes(spark, sf)
    n = c.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return H.cohort_names(c).join(n, "code").groupBy("category", "family", "interpretation").agg(F.sum("n").alias("n"))


SIX = {"TP_FIRST": "tp", "SL_FIRST": "sl_", "NEITHER": "ne", "AMBIGUOUS": "am", "mfe_pct": "mf", "mae_pct": "ma"}
_X = ", ".join(f"count(*) FILTER (WHERE NOT censored AND label = '{m}')::DOUBLE AS {c}" for m, c in list(SIX.items())[:4]) + ", " + ", ".join(f"coalesce(sum({m}) FILTER (WHERE NOT censored), 0) AS {c}" for m, c in list(SIX.items())[4:])
_C = "category, family, interpretation"
_G = "direction, tp, sl, horizon"
# Grid columns are renamed here, where tp and sl are also names of sums.
cte("cohw", f"SELECT {_C}, block, quarter, direction, o.tp AS gt, o.sl AS gs, horizon, count(*) AS n, count(*) FILTER (WHERE NOT censored) AS done, {_X} FROM memb m JOIN out_c15 o USING (event_id) GROUP BY ALL")
cte("coh", f"""SELECT {_C}, period, direction, gt, gs, horizon, sum(n)::BIGINT AS n, sum(done)::BIGINT AS complete, count(DISTINCT block) FILTER (WHERE done > 0) AS blocks, {', '.join(f'sum({c}) / nullif(sum(done), 0)::DOUBLE AS {c}' for c in SIX.values())}
  FROM (SELECT *, unnest(['ALL', quarter]) AS period FROM cohw) GROUP BY ALL""")


@query("cohort_summary", build(f"""SELECT category, family, interpretation, period, direction, gt AS tp, gs AS sl, horizon, n, complete, n - complete AS censored, blocks AS week_blocks, complete >= 200 AND blocks >= 5 AS supported, {', '.join(f'round({c}, 6) AS "{m}"' for m, c in SIX.items())} FROM coh"""))
def cohort_summary(spark, sf):
    t = H.cohort_table(sums(spark, sf)[0], GRID)
    return t.select("category", "family", "interpretation", "period", *GRID, "n", "complete", "censored", "week_blocks", "supported", *[r(m).alias(m) for m in SIX])


cte("declared", "SELECT * FROM (VALUES " + ", ".join(str(d) for d in H.declared(dict.fromkeys(FIELDS, 3))) + ") v(category, family, interpretation) WHERE NOT (" + " OR ".join(
    f"starts_with(category, '{at}') AND TRY_CAST(regexp_extract(category, 'Q(-?[0-9]+)$', 1) AS INTEGER) > (SELECT len(c{i}) FROM cfm)"
    for i, f in enumerate(FIELDS) for at in (["quantity/"] if i == 0 else [f"{k}/{s}/{f.removesuffix('__imbalance')}/" for k in (["delta"] if i < 4 else ["magnitude"]) for s in ("support", "resistance")])) + ")")


@query("cohort_empty_cells", build("""SELECT d.*, p.period, g.direction, g.gt AS tp, g.gs AS sl, g.horizon, coalesce(c.n, 0) AS n, coalesce(c.complete, 0) AS complete, coalesce(c.complete >= 200 AND c.blocks >= 5, false) AS supported FROM declared d CROSS JOIN (VALUES ('ALL'), ('H1'), ('H2')) p(period)
  CROSS JOIN (SELECT DISTINCT direction, gt, gs, horizon FROM coh) g LEFT JOIN coh c ON c.category = d.category AND c.period = p.period AND c.direction = g.direction AND c.gt = g.gt AND c.gs = g.gs AND c.horizon = g.horizon"""))
def cohort_empty_cells(spark, sf):
    """All predeclared cohorts appear in all cells, also those no state falls into."""
    s, tops = sums(spark, sf)
    names = spark.createDataFrame(H.declared(tops), "category string, family string, interpretation string")
    cells = O.grid_frame(spark.createDataFrame([("ALL",), ("H1",), ("H2",)], "period string"), HORIZONS["15m"])
    full = H.with_empty(H.cohort_table(s, GRID), names, cells)
    return full.select("category", "family", "interpretation", "period", *GRID, "n", "complete", "supported")


def _pairs_sql() -> str:
    """Comparisons as rules over names, with the highest quantity bucket looked up."""
    q = "(SELECT len(c0) FROM cfm)"
    rows = [c for c in H.comparisons(dict.fromkeys(FIELDS, 9)) if c[3] != "quantity"]
    fixed = "SELECT * FROM (VALUES " + ", ".join(str(c) for c in rows) + ") v(comparison, a, b, family)"
    return fixed + f" UNION ALL SELECT x || '/high_minus_low', x || '/Q' || {q}, x || '/Q0', 'quantity' FROM (SELECT 'quantity/' || side || '/count' || unnest(range(5)) AS x FROM ways)"


cte("cmp", _pairs_sql())
_ON = "a.period = b.period AND a.direction = b.direction AND a.gt = b.gt AND a.gs = b.gs AND a.horizon = b.horizon"
cte("effects", f"""SELECT v.comparison, v.family, v.a, v.b, a.period, a.direction, a.gt, a.gs, a.horizon, m AS metric, CASE m {' '.join(f"WHEN '{m}' THEN a.{c} - b.{c}" for m, c in SIX.items())} END AS effect, a.complete AS a_complete, b.complete AS b_complete, a.blocks AS a_blocks, b.blocks AS b_blocks,
  a.complete >= 200 AND b.complete >= 200 AND a.blocks >= 5 AND b.blocks >= 5 AS supported
  FROM cmp v JOIN coh a ON a.category = v.a JOIN coh b ON b.category = v.b AND {_ON}, (SELECT unnest([{', '.join(f"'{m}'" for m in SIX)}]) AS m)""")
def effects(spark, sf):
    s, tops = sums(spark, sf)
    pairs = spark.createDataFrame(H.comparisons(tops), "comparison string, a string, b string, family string")
    return S.contrast(H.cohort_table(s, GRID), pairs, ["period", *GRID], H.METRICS)


@query("cohort_contrast", build("""SELECT comparison, family, period, direction, gt AS tp, gs AS sl, horizon, metric, round(effect, 6) + 0.0::DOUBLE AS effect, a_complete, b_complete, a_blocks, b_blocks, supported FROM effects"""))
def cohort_contrast(spark, sf):
    """All predeclared comparisons in all periods, cells and metrics."""
    return effects(spark, sf).select("comparison", "family", "period", *GRID, "metric", r("effect").alias("effect"), "a_complete", "b_complete", "a_blocks", "b_blocks", "supported")


def contrast_intervals(spark, sf):
    """Both interval queries read one written table. Only the cohorts that a comparison names are unfolded, straight to days."""
    key = (spark.sparkContext.applicationId, sf, "intervals")
    if key not in _WRITTEN:
        per_code, names, tops = code_sums(spark, sf)
        pairs = spark.createDataFrame(H.comparisons(tops), "comparison string, a string, b string, family string")
        compared = F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("category")).distinct())  # a declared list
        blocks = H.unfolded(per_code, names.join(compared, "category", "left_semi"), ["category", *GRID, "block"])
        blocks = blocks.select("category", *GRID, "block", *[F.col(c).cast("double").alias(c) for c in ("complete", *H.METRICS)])
        _WRITTEN[key] = materialize(R.paired(materialize(blocks, "block-sums"), "category", GRID, pairs, "block", ["complete", *H.METRICS], H.METRICS), "intervals")
    return _WRITTEN[key]


@query("cohort_intervals")
def cohort_intervals(spark, sf):
    """The comparisons over the whole period with intervals from draws that both sides share. SQL would need millions of drawn rows;
    the operator is held against it in block_bootstrap and against draws in plain Python in the tests."""
    return contrast_intervals(spark, sf).select("comparison", "family", *GRID, "metric", *[r(c).alias(c) for c in ("estimate", "ci_low", "ci_high")], "finite_draws")


@query("evidence_intervals")
def evidence_intervals(spark, sf):
    """Per comparison and metric, the cells whose interval lies above or below zero."""
    c = contrast_intervals(spark, sf)
    count = lambda cond: F.count(F.when(cond, 1))
    return c.groupBy("comparison", "metric").agg(
        F.count(F.lit(1)).alias("grids"), count(F.col("ci_low").isNotNull()).alias("with_interval"), count(r("ci_low", 9) > 0).alias("ci_positive"), count(r("ci_high", 9) < 0).alias("ci_negative")
    )


@query("quarter_stability", build("""SELECT comparison, direction, gt AS tp, gs AS sl, horizon, metric, round(max(effect) FILTER (WHERE period = 'ALL'), 6) + 0.0::DOUBLE AS pooled_effect, count(DISTINCT period) FILTER (WHERE period <> 'ALL') AS quarters, count(*) FILTER (WHERE period <> 'ALL' AND supported) AS supported_quarters,
  CASE WHEN sum(abs(round(effect, 9))) FILTER (WHERE period <> 'ALL') > 0 THEN round(max(abs(round(effect, 9))) FILTER (WHERE period <> 'ALL') / sum(abs(round(effect, 9))) FILTER (WHERE period <> 'ALL'), 5) END AS largest_quarter_share FROM effects GROUP BY ALL"""))
def quarter_stability(spark, sf):
    s = H.quarter_stability(effects(spark, sf).withColumn("effect", r("effect", 9)), ["comparison", *GRID, "metric"])
    return s.select("comparison", *GRID, "metric", r("pooled_effect").alias("pooled_effect"), "quarters", "supported_quarters", r("largest_quarter_share", 5).alias("largest_quarter_share"))


@query("stability_counts", build("""SELECT a.family, metric, count(*) AS comparisons, count(*) FILTER (WHERE a.supported AND b.supported) AS supported_both, count(*) FILTER (WHERE sign(round(a.effect, 9)) * sign(round(b.effect, 9)) > 0) AS same_sign
  FROM (SELECT * FROM effects WHERE period = 'H1') a JOIN (SELECT * FROM effects WHERE period = 'H2') b USING (comparison, direction, gt, gs, horizon, metric) GROUP BY ALL"""))
def stability_counts(spark, sf):
    e = effects(spark, sf).withColumn("effect", r("effect", 9))
    return H.stability_counts(e.filter("period = 'H1'"), e.filter("period = 'H2'"), ["comparison", "family", *GRID, "metric"], ["family", "metric"])


@query("evidence_ranges", build("""SELECT comparison, metric, count(*) AS grids, count(*) FILTER (WHERE supported) AS supported_count, round(min(effect), 6) + 0.0::DOUBLE AS minimum_effect, round(max(effect), 6) + 0.0::DOUBLE AS maximum_effect, min(a_complete) AS minimum_a_complete, min(b_complete) AS minimum_b_complete,
  count(*) FILTER (WHERE round(effect, 9) > 0) AS positive, count(*) FILTER (WHERE round(effect, 9) < 0) AS negative FROM effects WHERE period = 'ALL' GROUP BY ALL"""))
def evidence_ranges(spark, sf):
    e = H.evidence_ranges(effects(spark, sf).filter("period = 'ALL'").withColumn("effect", r("effect", 9)), ["comparison", "metric"])
    return e.select("comparison", "metric", "grids", "supported_count", r("minimum_effect").alias("minimum_effect"), r("maximum_effect").alias("maximum_effect"), "minimum_a_complete", "minimum_b_complete", "positive", "negative")


IMB = [f"{tf}__imbalance" for tf in TFS]
cte("imb_p", "SELECT T, " + ", ".join(f"abs(max(imbalance) FILTER (WHERE tf = '{tf}')) AS i{k}" for k, tf in enumerate(TFS)) + " FROM repriced GROUP BY T")
cte("imb_m", "SELECT " + ", ".join(f"quantile_cont(i{k}, [0.25, 0.5, 0.75]) AS c{k}" for k in range(4)) + " FROM imb_p")


def left_sql(v, c):
    return f"CASE WHEN {v} IS NULL THEN -1 ELSE CASE WHEN {v} > {c}[1] THEN 1 ELSE 0 END + CASE WHEN {v} > {c}[2] THEN 1 ELSE 0 END + CASE WHEN {v} > {c}[3] THEN 1 ELSE 0 END END"


cte("vec", f"SELECT p.T, {', '.join(left_sql(f'i{k}', f'c{k}') + f' AS b{k}' for k in range(4))} FROM imb_p p, imb_m")


def vector(spark, sf):
    s = states(spark, sf)
    for i, tf in enumerate(TFS):
        s = s.withColumn(f"m{i}", F.abs(F.col(f"`{tf}__imbalance`")))
    fields = [f"m{i}" for i in range(4)]
    return C.apply_buckets(s, C.fit_quantiles(s, fields, 4), fields, "left")


@query("fit_confluence", build(" UNION ALL ".join(f"SELECT 'm{k}' AS field, round(c{k}[1], 6) AS q1, round(c{k}[3], 6) AS q3 FROM imb_m" for k in range(4))))
def fit_confluence(spark, sf):
    s = states(spark, sf).select(*[F.abs(F.col(f"`{tf}__imbalance`")).alias(f"m{i}") for i, tf in enumerate(TFS)])
    m = C.fit_quantiles(s, [f"m{i}" for i in range(4)], 4, distinct=False)
    return m.select("field", r(F.col("cuts")[0]).alias("q1"), r(F.col("cuts")[2]).alias("q3"))


@query("magnitude_vector", build("""SELECT T, b0::BIGINT AS b0, b1::BIGINT AS b1, b2::BIGINT AS b2, b3::BIGINT AS b3, (b0 = 3)::BIGINT + (b1 = 3)::BIGINT + (b2 = 3)::BIGINT + (b3 = 3)::BIGINT AS q4_count FROM vec"""))
def magnitude_vector(spark, sf):
    v = vector(spark, sf)
    b = [F.col(f"m{i}_bucket") for i in range(4)]
    return v.select("T", *[x.alias(f"b{i}") for i, x in enumerate(b)], long(F.size(F.filter(F.array(*b), lambda x: x == 3))).alias("q4_count"))


@query("hypothesis_masks", build("""WITH j AS (SELECT p.pattern, v.*, CASE WHEN least(b0, b1, b2, b3) < 0 THEN 'missing' WHEN greatest(b0, b1, b2, b3) = 0 THEN 'weak' WHEN least(b0, b1, b2, b3) = 3 THEN 'strong' WHEN least(b0, b1, b2, b3) > 0 AND greatest(b0, b1, b2, b3) < 3 THEN 'moderate' ELSE 'mixed' END AS s FROM pat p JOIN vec v USING (T))
  SELECT category, count(*) AS n FROM (SELECT pattern || '/strength/' || s AS category FROM j UNION ALL SELECT pattern || '/Q4_count/' || ((b0 = 3)::INT + (b1 = 3)::INT + (b2 = 3)::INT + (b3 = 3)::INT) FROM j WHERE s <> 'missing'
  UNION ALL SELECT pattern || '/native/15m/Q' || b0 FROM j UNION ALL SELECT pattern || '/native/1h/Q' || b1 FROM j UNION ALL SELECT pattern || '/native/4h/Q' || b2 FROM j UNION ALL SELECT pattern || '/native/1d/Q' || b3 FROM j) GROUP BY 1"""))
def hypothesis_masks(spark, sf):
    v = vector(spark, sf)
    tags = H.strength_tags({tf: F.col(f"m{i}_bucket") for i, tf in enumerate(TFS)}, 3, F.col("pattern"), F.lit(True))
    return H.memberships(v.select("T", "pattern", *[f"m{i}_bucket" for i in range(4)]), tags).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("score_ablation", build("""SELECT CASE WHEN sign(A1) = sign(A2) THEN 'same_sign' WHEN A1 * A2 < 0 THEN 'sign_flip' ELSE 'one_zero' END AS sign_case, CASE WHEN abs(A1) > abs(A2) THEN 'larger' WHEN abs(A1) < abs(A2) THEN 'smaller' ELSE 'equal' END AS magnitude_case, count(*) AS n, round(avg(A1 - A2), 6) + 0.0::DOUBLE AS mean_difference FROM score_l GROUP BY ALL"""))
def score_ablation(spark, sf):
    a = H.ablation(q_map.score_l(spark, sf))
    return a.groupBy("sign_case", "magnitude_case").agg(F.count(F.lit(1)).alias("n"), r(F.avg("half_band_difference")).alias("mean_difference"))


@query("conditional_summary", build("""WITH u AS (SELECT *, rb <> 'Q1' AS ok FROM rows_l), x AS (SELECT vb, rb, direction, tp, sl, horizon, count(*) FILTER (WHERE NOT censored) AS complete, count(*) FILTER (WHERE NOT censored AND label = 'TP_FIRST') AS h FROM u WHERE ok GROUP BY ALL)
  SELECT vb AS volatility_bucket, rb AS recent_return_bucket, direction, tp, sl, horizon, complete, round(h / complete::DOUBLE, 6) AS tp_first_rate, round(h / complete::DOUBLE - sum(h) OVER m / (sum(complete) OVER m)::DOUBLE, 6) + 0.0::DOUBLE AS increment_vs_map,
  round(sum(h) OVER g / (sum(complete) OVER g)::DOUBLE, 6) AS rate_cohort FROM x WINDOW m AS (PARTITION BY vb, direction, tp, sl, horizon), g AS (PARTITION BY direction, tp, sl, horizon)"""))
def conditional_summary(spark, sf):
    rows = q_stats.rows_l(spark, sf).withColumn("ok", F.col("recent_return_bucket") != "Q1")
    c = H.conditional_summary(rows, "recent_return_bucket", "volatility_bucket", GRID)
    return c.select("volatility_bucket", "recent_return_bucket", *GRID, "complete", r("tp_first_rate").alias("tp_first_rate"), r("increment_vs_map").alias("increment_vs_map"), r("rate_cohort").alias("rate_cohort"))


@query("flow_coverage_table", build("""SELECT "window", count(*) AS states, count(*) FILTER (WHERE flow_status = 'AVAILABLE') AS coverage_valid, count(*) FILTER (WHERE flow_status = 'AVAILABLE' AND round(support_quantity, 6) = 0) AS support_zero,
  round(median((round(support_quantity, 6) + round(resistance_quantity, 6) - round(joint_quantity, 6)) / nullif(round(joint_quantity, 6), 0)) FILTER (WHERE flow_status = 'AVAILABLE'), 5) + 0.0::DOUBLE AS shared_over_joint_median FROM flow_e GROUP BY 1"""))
def flow_coverage_table(spark, sf):
    f = q_map.flow_e(spark, sf)
    q = {c: r(f"{c}_quantity") for c in ("support", "resistance", "joint")}
    ok = F.col("flow_status") == "AVAILABLE"
    share = (q["support"] + q["resistance"] - q["joint"]) / F.nullif(q["joint"], F.lit(0.0))
    return f.groupBy("window").agg(F.count(F.lit(1)).alias("states"), F.count(F.when(ok, 1)).alias("coverage_valid"), F.count(F.when(ok & (q["support"] == 0), 1)).alias("support_zero"), r(F.percentile(F.when(ok, share), 0.5), 5).alias("shared_over_joint_median"))


@query("delta_appendix", build("""SELECT s.sg AS pattern, count(*) AS n, round(avg(f.joint_buy - f.joint_sell), 6) + 0.0::DOUBLE AS mean_joint_delta FROM (SELECT T, CASE WHEN imbalance > 0 THEN 'S' WHEN imbalance < 0 THEN 'R' WHEN imbalance = 0 THEN 'N' ELSE 'M' END AS sg FROM score_e) s JOIN flow_e f ON f.T = s.T AND f."window" = 1 AND flow_status = 'AVAILABLE' GROUP BY 1"""))
def delta_appendix(spark, sf):
    from tidemark.functions.columns import sign_char

    s = q_map.score_e(spark, sf).select("T", sign_char(F.col("imbalance")).alias("pattern"))
    f = q_map.flow_e(spark, sf).filter((F.col("window") == 1) & (F.col("flow_status") == "AVAILABLE"))
    return s.join(f, "T").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), r(F.avg("joint_delta")).alias("mean_joint_delta"))


# ---- facets --------------------------------------------------------------------------

cte("deep", """SELECT v.kind, v.visit_number, 'ALL:' || v.observed_at AS event_id, CASE WHEN v.visit_number < 4 THEN CAST(v.visit_number AS VARCHAR) ELSE '4+' END AS vg, CASE WHEN rr IS NULL THEN 'CALIBRATION' ELSE rr END AS rr, least(floor((v.reference_close - v.lower) / (v.upper - v.lower) * 10) + 1, 10)::BIGINT AS pos
  FROM vis_sep v LEFT JOIN reg_e g ON g.T = v.observed_at""")
cte("fam", """SELECT 'position' AS family, 'ALL' AS facet, 'ALL' AS facet_value, CAST(greatest(pos, 0) AS VARCHAR) AS bucket, event_id FROM deep UNION ALL SELECT 'raw_sign', 'ALL', 'ALL', CASE WHEN kind = 'SUPPORT' THEN '3' ELSE '1' END, event_id FROM deep
  UNION ALL SELECT 'position', 'visit_group', vg, CAST(greatest(pos, 0) AS VARCHAR), event_id FROM deep UNION ALL SELECT 'position', 'return_regime', rr, CAST(greatest(pos, 0) AS VARCHAR), event_id FROM deep""")


def deep(spark, sf):
    v = q_levels.visits_e(spark, sf, 0.001, 0.003)
    g = q_stats.regimes_e(spark, sf).select(F.col("timestamp").alias("observed_at"), "return_regime")
    d = v.join(g, "observed_at", "left").withColumn("return_regime", F.coalesce("return_regime", F.lit("CALIBRATION")))
    d = d.withColumn("event_id", F.concat_ws(":", "symbol", F.col("observed_at").cast("string"))).withColumn("kind", F.split("zone_id", ":")[0])
    pos = F.greatest(percent_bucket((F.col("reference_close") - F.col("zone_lower")) / (F.col("zone_upper") - F.col("zone_lower")), 10), F.lit(0))
    fam = {"position": pos, "raw_sign": F.when(F.col("kind") == "SUPPORT", 3).otherwise(1)}
    return H.facet_memberships(d, fam, ["visit_group", "return_regime"])


@query("facet_memberships", build("SELECT family, facet, facet_value, bucket, count(*) AS weight_sum, count(DISTINCT event_id) AS events FROM fam GROUP BY ALL"))
def facet_memberships(spark, sf):
    return deep(spark, sf).groupBy("family", "facet", "facet_value", "bucket").agg(F.sum("weight").alias("weight_sum"), F.count(F.lit(1)).alias("events"))


@query("event_weight_matrix", build("SELECT family, bucket, event_id, count(*) AS weight FROM fam WHERE facet = 'ALL' GROUP BY ALL"))
def event_weight_matrix(spark, sf):
    return deep(spark, sf).filter("facet = 'ALL'").select("family", "bucket", "event_id", "weight")


cte("fam_out", "SELECT f.*, o.direction, o.tp, o.sl, o.horizon, o.label, o.censored, o.mfe_pct, o.mae_pct FROM fam f JOIN out_e o USING (event_id)")


def facet_outcomes(spark, sf):
    o = q_levels.outcomes_e(spark, sf).select("event_id", *GRID, "label", "censored", "mfe_pct", "mae_pct", "time_to_mfe_ms", "time_to_mae_ms")
    return materialize(deep(spark, sf), "facets").join(o, "event_id")


FACET = ("family", "facet", "facet_value", "bucket")
_F = "family, facet, facet_value, bucket, direction, tp, sl, horizon"
_BAL = "count(DISTINCT event_id) FILTER (WHERE NOT censored AND label = '{}') / nullif(count(DISTINCT event_id) FILTER (WHERE NOT censored), 0)"


@query("deepdive_summary", build(f"""WITH x AS (SELECT {_F}, count(*) AS n, count(DISTINCT event_id) AS e, count(*) FILTER (WHERE NOT censored) AS done, count(*) FILTER (WHERE NOT censored AND label = 'TP_FIRST') AS h, {_BAL.format('TP_FIRST')} AS bt, {_BAL.format('SL_FIRST')} AS bs FROM fam_out GROUP BY ALL)
  SELECT {_F}, n AS measurement_count, e AS unique_event_count, round(h / nullif(done, 0)::DOUBLE, 6) AS tp_first_rate, round(bt, 6) AS event_balanced_tp_first_rate, round(bs, 6) AS event_balanced_sl_first_rate,
    round(h / nullif(done, 0)::DOUBLE - sum(h) OVER b / nullif(sum(done) OVER b, 0)::DOUBLE, 6) + 0.0::DOUBLE AS increment_vs_facet FROM x WINDOW b AS (PARTITION BY family, facet, facet_value, direction, tp, sl, horizon)"""))
def deepdive_summary(spark, sf):
    """Every facet and bucket in every cell and horizon, with its rate against all buckets of the facet value."""
    keys = [*FACET, *GRID]
    m = S.metrics(facet_outcomes(spark, sf), keys, "weight").withColumn("_h", F.col("tp_first_rate") * F.col("complete_measurement_count"))
    base = m.groupBy(*[k for k in keys if k != "bucket"]).agg((F.sum("_h") / F.nullif(F.sum("complete_measurement_count"), F.lit(0))).alias("_base"))
    m = m.join(base, [k for k in keys if k != "bucket"]).withColumn("increment_vs_facet", F.col("tp_first_rate") - F.col("_base"))
    return m.select(*keys, "measurement_count", "unique_event_count", *[r(c).alias(c) for c in ("tp_first_rate", "event_balanced_tp_first_rate", "event_balanced_sl_first_rate", "increment_vs_facet")])


@query("weighted_movement", build(f"SELECT {_F}, round(avg(mfe_pct), 4) AS mfe_mean, round(median(mfe_pct), 4) AS mfe_median, round(avg(mae_pct), 4) AS mae_mean, round(median(mae_pct), 4) AS mae_median FROM fam_out WHERE NOT censored GROUP BY ALL"))
def weighted_movement(spark, sf):
    """Excursions both ways of every facet and bucket in every cell and horizon, weighted by measurements."""
    w = F.col("weight")
    both = [x for m in ("mfe", "mae") for x in (r(F.sum(w * F.col(f"{m}_pct")) / F.sum(w), 4).alias(f"{m}_mean"), r(F.percentile(f"{m}_pct", 0.5, w), 4).alias(f"{m}_median"))]
    return facet_outcomes(spark, sf).filter("not censored").groupBy(*FACET, *GRID).agg(*both)


@query("condition_columns", build("""SELECT T, (CASE WHEN imbalance > 0 THEN 2 WHEN imbalance < 0 THEN 0 ELSE 1 END)::BIGINT AS map_direction, (CASE WHEN age_mean IS NULL THEN -1 ELSE (age_mean > 720)::INT + (age_mean > 4320)::INT + (age_mean > 8760)::INT END)::BIGINT AS age_band FROM state_e"""))
def condition_columns(spark, sf):
    s = q_map.snapshot_e(spark, sf)
    way = F.when(F.col("imbalance") > 0, 2).when(F.col("imbalance") < 0, 0).otherwise(1)
    return s.select("T", long(way).alias("map_direction"), bucket_left(F.col("age_mean"), F.array(*[F.lit(x) for x in (720.0, 4320.0, 8760.0)])).alias("age_band"))
