"""Set operations, sorts and limits, and the flagship chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DAY, FIXED_WIDTHS, HORIZONS, HOUR, LABELS, STEPS, WIDTHS
from tidemark.functions.columns import r
from tidemark.operators import detectors as D
from tidemark.operators import profiles as P
from tidemark.operators.stats import GRID
from tidemark.plans.base import T0, bars_e, publication, tape_e
from tidemark.plans.experiment import run_grid
from tidemark.plans.grid import configurations
from tidemark.plans.q_levels import b_sql, c_sql, extrema_sql, level_sql, outcome_sql
from tidemark.plans.q_quality import quarantine
from tidemark.plans.registry import build, cte, query
from tidemark.session import materialize

DETECTORS = (("A", None), ("B", 1), ("B", 2), ("C", 0.003), ("C", 0.005), ("D", 0.5), ("D", 1.0))  # bins of D at the scale of the tape's prices
CLOCKS = ("1h", "1d")
STRIDE = 6


def _grid_sql() -> None:
    """Levels of all detectors and clocks in one table, all widths, visits by brute force."""
    parts = []
    for tf in CLOCKS:
        bars, step = f"bars_e{tf}", STEPS[tf]
        for w in (1, 2):
            cte(f"gx_{tf}_{w}", extrema_sql(bars, w))
        rules = [("A", "NULL", level_sql(bars)), ("B", "1", b_sql(f"gx_{tf}_1").replace("round(high, 6)", "high").replace("round(low, 6)", "low")), ("B", "2", b_sql(f"gx_{tf}_2").replace("round(high, 6)", "high").replace("round(low, 6)", "low")), ("C", "0.003", c_sql(bars, "0.003")), ("C", "0.005", c_sql(bars, "0.005"))]
        for w in ("0.5", "1.0"):
            size = round(float(w) * 100_000_000)
            rules.append(("D", w, f"""SELECT 'NEUTRAL' AS kind, (bin * {w}::DOUBLE + (bin + 1) * {w}::DOUBLE) / 2 AS price, w AS source_timestamp, w + {step} AS known_at FROM (SELECT *, sum(q) OVER (PARTITION BY w) AS total, count(*) OVER (PARTITION BY w) AS n
              FROM (SELECT ts // {step} * {step} AS w, (CAST(CAST(price AS VARCHAR) AS DECIMAL(20,8)) * 100000000)::BIGINT // {size} AS bin, sum((CAST(quantity AS DECIMAL(20,8)) * 100000000)::BIGINT) AS q FROM trade_e GROUP BY ALL)) WHERE 2 * q * n >= 3 * total"""))
        parts += [f"SELECT '{tf}' AS tf, '{d}' AS detector, {p}::DOUBLE AS parameter, kind, price, source_timestamp, known_at FROM ({q})" for d, p, q in rules]
    cte("g_lev", " UNION ALL ".join(parts))
    widths = " UNION ALL ".join(f"SELECT '{tf}' AS tf, unnest([{', '.join(map(str, (*FIXED_WIDTHS, WIDTHS[tf])))}])::DOUBLE AS width" for tf in CLOCKS)
    cte("g_zone", f"SELECT row_number() OVER () AS zone, l.*, width, price * (1 - width) AS lower, price * (1 + width) AS upper FROM g_lev l JOIN ({widths}) USING (tf)")
    for tf in CLOCKS:  # a visit starts with a touch after a bar that left, or with the first touch
        cte(f"g_in_{tf}", f"""SELECT zone, z.detector, z.parameter, z.width, b.idx, b.end_time, b.high >= lower AND b.low <= upper AS touch, b.close > upper OR b.close < lower AS leave
          FROM g_zone z JOIN bars_e{tf} b ON z.tf = '{tf}' AND b.open_time >= z.known_at""")
        cte(f"g_vis_{tf}", f"""SELECT '{tf}' AS tf, detector, parameter, width, min(end_time) FILTER (WHERE touch) AS T FROM (SELECT *, coalesce(sum(leave::INT) OVER (PARTITION BY zone ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM g_in_{tf})
          GROUP BY zone, detector, parameter, width, seg HAVING bool_or(touch)""")
        cte(f"g_ev_{tf}", f"SELECT symbol || ':' || end_time AS event_id, symbol, idx, end_time AS T, close AS P, (row_number() OVER (ORDER BY idx) - 1) % {STRIDE} = 0 AS control FROM bars_e{tf}")
        cte(f"g_out_{tf}", outcome_sql(f"(SELECT event_id, symbol, idx, T, P FROM g_ev_{tf})", f"bars_e{tf}", STEPS[tf], HORIZONS[tf]))
    cte("g_vis", " UNION ALL ".join(f"SELECT * FROM g_vis_{tf}" for tf in CLOCKS))
    cte("g_w", "SELECT tf, detector, parameter, width, T, count(*) AS w FROM g_vis GROUP BY ALL")
    cte("g_out", " UNION ALL ".join(f"SELECT '{tf}' AS tf, o.*, e.control FROM g_out_{tf} o JOIN g_ev_{tf} e ON e.event_id = o.event_id" for tf in CLOCKS))
    cte("g_stat", f"""SELECT t.T, CASE WHEN t.T - {2 * HOUR} < {T0 + DAY} THEN 'm' WHEN EXISTS (SELECT 1 FROM quar q WHERE t.T - {2 * HOUR} < q.e AND t.T > q.s) THEN 'q'
      WHEN EXISTS (SELECT 1 FROM prof_e p WHERE p.bucket = t.T - {HOUR}) AND EXISTS (SELECT 1 FROM prof_e p WHERE p.bucket = t.T - {2 * HOUR}) THEN 'a' ELSE 'm' END AS s FROM (SELECT DISTINCT T FROM g_w) t""")


def _count_sql(w: str, where: str = "true") -> str:
    return ", ".join([f"coalesce(sum({w}) FILTER (WHERE {where}), 0)::BIGINT AS total", f"coalesce(sum({w}) FILTER (WHERE {where} AND NOT censored), 0)::BIGINT AS complete"]
                     + [f"coalesce(sum({w}) FILTER (WHERE {where} AND NOT censored AND label = '{x}'), 0)::BIGINT AS {x.lower()}" for x in LABELS])


_grid_sql()
_NAMES = ("total", "complete", *[x.lower() for x in LABELS])
_ID = "tf, detector, parameter, width"


@query("run_experiment", build(f"""WITH c AS (SELECT l.*, width FROM (SELECT DISTINCT tf, d.* FROM (VALUES {', '.join(f"('{tf}')" for tf in CLOCKS)}) t(tf), (VALUES {', '.join(f"('{d}', {'NULL' if p is None else float(p)}::DOUBLE)" for d, p in DETECTORS)}) d(detector, parameter)) l
    JOIN ({' UNION ALL '.join(f"SELECT '{tf}' AS tf, unnest([{', '.join(map(str, (*FIXED_WIDTHS, WIDTHS[tf])))}])::DOUBLE AS width" for tf in CLOCKS)}) USING (tf)),
  x AS (SELECT w.detector, w.parameter, w.width, o.tf, o.direction, o.tp, o.sl, o.horizon, {_count_sql('w.w')} FROM g_w w JOIN g_out o ON o.tf = w.tf AND o.T = w.T GROUP BY ALL),
  k AS (SELECT tf, direction, tp, sl, horizon, {_count_sql('1', 'control')} FROM g_out GROUP BY ALL),
  v AS (SELECT {_ID}, count(*) FILTER (WHERE s = 'a') AS visits_available, count(*) FILTER (WHERE s = 'm') AS visits_missing, count(*) FILTER (WHERE s = 'q') AS visits_quarantined FROM g_vis JOIN g_stat USING (T) GROUP BY ALL)
  SELECT c.tf, c.detector, c.parameter, c.width, k.direction, k.tp, k.sl, k.horizon, {', '.join(f'coalesce(x.{n}, 0) AS event_{n}, k.{n} AS control_{n}' for n in _NAMES)},
    round(x.tp_first / nullif(x.complete, 0)::DOUBLE, 6) AS event_tp_first_fraction, round(k.tp_first / nullif(k.complete, 0)::DOUBLE, 6) AS control_tp_first_fraction,
    round(x.tp_first / nullif(x.complete, 0)::DOUBLE - k.tp_first / nullif(k.complete, 0)::DOUBLE, 6) + 0.0::DOUBLE AS difference, coalesce(visits_available, 0) AS visits_available, coalesce(visits_missing, 0) AS visits_missing, coalesce(visits_quarantined, 0) AS visits_quarantined
  FROM c JOIN k ON k.tf = c.tf LEFT JOIN x ON x.tf = c.tf AND x.detector = c.detector AND x.parameter IS NOT DISTINCT FROM c.parameter AND x.width = c.width AND x.direction = k.direction AND x.tp = k.tp AND x.sl = k.sl AND x.horizon = k.horizon
  LEFT JOIN v ON v.tf = c.tf AND v.detector = c.detector AND v.parameter IS NOT DISTINCT FROM c.parameter AND v.width = c.width"""))
def run_experiment(spark, sf):
    """Seven detectors x six widths on two timeframes in one plan, against control events, with the state of the volume before each visit."""
    bars = materialize(reduce(DataFrame.unionByName, [bars_e(spark, sf, tf) for tf in CLOCKS]), "bars")
    grid = materialize(configurations(bars.select("symbol").distinct(), CLOCKS, DETECTORS), "configurations")
    tape = tape_e(spark, sf)
    volume = (P.profile(tape, HOUR), HOUR, T0 + DAY, quarantine(spark, sf))
    g = run_grid(bars, grid, DETECTORS, tape, STRIDE, coverage=volume)
    parts = [f"{x}_{n}" for n in _NAMES for x in ("event", "control")]
    return g.select("tf", "detector", "parameter", "width", *GRID, *parts, *[r(c).alias(c) for c in ("event_tp_first_fraction", "control_tp_first_fraction", "difference")], "visits_available", "visits_missing", "visits_quarantined")


@query("union_all", build("SELECT src, count(*) AS n FROM (SELECT 'm' AS src FROM pub_m UNION ALL SELECT 'd' FROM pub_d) GROUP BY src"))
def union_all(spark, sf):
    u = publication(spark, sf, "monthly").withColumn("src", F.lit("m")).unionByName(publication(spark, sf, "daily").withColumn("src", F.lit("d")))
    return u.groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query("distinct", build("SELECT DISTINCT event_type AS symbol, ts // 3600000 * 3600000 AS hour FROM trade_e"))
def distinct(spark, sf):
    return tape_e(spark, sf, True).select("symbol", (F.col("timestamp") - F.pmod("timestamp", F.lit(HOUR))).alias("hour")).distinct()


@query("except", build("SELECT id FROM trade_e EXCEPT SELECT id FROM pub_m"))
def except_(spark, sf):
    return tape_e(spark, sf).select("id").join(publication(spark, sf, "monthly").select("id"), "id", "left_anti")


@query("subset_check", build("SELECT (SELECT count(*) FROM (SELECT id FROM pub_m EXCEPT SELECT id FROM trade_e)) AS only_left, (SELECT count(*) FROM (SELECT id FROM trade_e EXCEPT SELECT id FROM pub_m)) AS only_right"))
def subset_check(spark, sf):
    a, b = publication(spark, sf, "monthly").select("id"), tape_e(spark, sf).select("id")
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return n(a.exceptAll(b), "only_left").crossJoin(n(b.exceptAll(a), "only_right"))


@query("sort_stable", build("SELECT symbol, kind, source_timestamp, known_at FROM lev_t4h ORDER BY symbol, known_at, kind, source_timestamp"))
def sort_stable(spark, sf):
    return D.detect_a(bars_e(spark, sf, "4h", True)).select("symbol", "kind", "source_timestamp", "known_at").orderBy("symbol", "known_at", "kind", "source_timestamp")


@query("top_k", build("SELECT symbol, open_time, rank FROM (SELECT symbol, open_time, row_number() OVER (PARTITION BY symbol ORDER BY round(volume, 6) DESC, open_time) AS rank FROM bars_t1h) WHERE rank <= 3"))
def top_k(spark, sf):
    """Three busiest bars per symbol; Spark limits inside each partition before the shuffle."""
    w = Window.partitionBy("symbol").orderBy(F.desc("volume"), "open_time")
    b = bars_e(spark, sf, "1h", True).select("symbol", "open_time", r("volume").alias("volume"))
    return b.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3").select("symbol", "open_time", "rank")


@query("latest_per_key", build("SELECT symbol, max(open_time) AS open_time, round(arg_max(close, open_time), 6) AS close FROM bars_t4h GROUP BY symbol"))
def latest_per_key(spark, sf):
    b = bars_e(spark, sf, "4h", True)
    return b.groupBy("symbol").agg(F.max("open_time").alias("open_time"), r(F.max_by("close", "open_time")).alias("close"))


@query("tail_n", build("SELECT symbol, open_time FROM bars_t1h b WHERE idx > (SELECT max(idx) FROM bars_t1h m WHERE m.symbol = b.symbol) - 24"))
def tail_n(spark, sf):
    """The last 24 hours of the chart of every symbol, by grid index."""
    b = bars_e(spark, sf, "1h", True)
    last = b.groupBy("symbol").agg(F.max("idx").alias("m"))
    return b.join(last, "symbol").filter(F.col("idx") > F.col("m") - 24).select("symbol", "open_time")


@query("deterministic_sample", build("""SELECT kind, source_timestamp, known_at FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY known_at, source_timestamp) AS n FROM lev_e1h) WHERE n <= 3"""))
def deterministic_sample(spark, sf):
    w = Window.partitionBy("kind").orderBy("known_at", "source_timestamp")
    d = D.detect_a(bars_e(spark, sf, "1h")).withColumn("n", F.row_number().over(w)).filter("n <= 3")
    return d.select("kind", "source_timestamp", "known_at")


@query("edge_examples", build("SELECT T FROM (SELECT end_time AS T, row_number() OVER (ORDER BY end_time) - 1 AS n FROM bars_e4h) WHERE n % 16 = 0 OR T % 86400000 = 0 OR (T - 14400000) % 86400000 = 0 OR (T + 14400000) % 86400000 = 0"))
def edge_examples(spark, sf):
    """Audit rows: evenly spaced decisions, native boundaries and their neighbours."""
    from tidemark.functions.scans import running

    d = bars_e(spark, sf, "4h").select("symbol", F.col("end").alias("T"), "idx")
    d = running(d, ["symbol"], ["idx"], F.floor(F.col("idx") / 4096), {"n": F.lit(1)})
    at = lambda o: F.pmod(F.col("T") + o, F.lit(86_400_000)) == 0
    return d.filter(((F.col("n") - 1) % 16 == 0) | at(0) | at(-4 * HOUR) | at(4 * HOUR)).select("T")
