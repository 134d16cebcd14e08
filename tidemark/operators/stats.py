"""Outcome metrics, percentiles, shapes and contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import LABELS, MIN_SUPPORT_ROWS, MIN_SUPPORT_WEEKS
from tidemark.functions.columns import count_if, ratio
from tidemark.functions.ranks import prior_mass

GRID = ("direction", "tp", "sl", "horizon")
MOVES = ("mfe_pct", "mae_pct", "time_to_mfe_ms", "time_to_mae_ms")


def metrics(rows: DataFrame, keys, weight: str | None = None) -> DataFrame:
    """The outcome metric set per key. Rates divide by complete rows; NEITHER and AMBIGUOUS count.

    With ``weight`` each row stands for that many measurements: means, rates and exact
    percentiles are weighted, so shared outcomes are never expanded. Event-balanced columns
    count every (event, grid) once.
    """
    keys = list(keys)
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    done = ~F.col("censored")
    cw = F.when(done, w)
    aggs = [
        F.sum(w).alias("measurement_count"),
        F.count_distinct("event_id").alias("unique_event_count"),
        (F.sum(F.when(F.col("censored"), w).otherwise(0)) / F.sum(w)).alias("censored_rate"),
        F.coalesce(F.sum(cw), F.lit(0)).alias("complete_measurement_count"),
    ]
    for l in LABELS:
        aggs.append((F.sum(F.when(done & (F.col("label") == l), w).otherwise(0)) / F.sum(cw)).alias(f"{l.lower()}_rate"))
    for m in MOVES:
        v = F.when(done, F.col(m).cast("double"))
        vw = F.when(v.isNotNull(), w).otherwise(0)
        aggs.append((F.sum(v * w) / F.nullif(F.sum(vw), F.lit(0))).alias(f"{m}_mean"))
        aggs.append(F.percentile(v, [0.1, 0.5, 0.9], vw if weight else F.lit(1)).alias(f"_{m}"))
    hit = done & F.col("label").isin("TP_FIRST", "SL_FIRST")
    gain = F.when(F.col("label") == "TP_FIRST", F.col("tp")).otherwise(-F.col("sl"))
    aggs += [
        F.coalesce(F.sum(F.when(hit, w)), F.lit(0)).alias("resolved_measurement_count"),
        (F.sum(F.when(hit, gain * w)) / F.sum(F.when(hit, w)) * 100).alias("gross_boundary_expectancy_conditional_pct"),
    ]
    main = rows.groupBy(*keys).agg(*aggs)
    for m in MOVES:
        for i, q in enumerate(("q10", "median", "q90")):
            main = main.withColumn(f"{m}_{q}", F.col(f"_{m}")[i])
    main = main.drop(*[f"_{m}" for m in MOVES])
    grid = [g for g in GRID if g not in keys and g in rows.columns]
    once = rows.select(*keys, *grid, "event_id", "censored", "label").dropDuplicates([*keys, *grid, "event_id"])
    done1 = F.when(~F.col("censored"), F.lit(1))
    eb = once.groupBy(*keys).agg(
        F.avg(F.col("censored").cast("double")).alias("event_balanced_censored_rate"),
        *[(count_if(~F.col("censored") & (F.col("label") == l)) / F.nullif(F.count(done1), F.lit(0))).alias(f"event_balanced_{l.lower()}_rate") for l in LABELS],
    )
    cond = None
    for k in keys:
        c = main[k].eqNullSafe(eb[k])
        cond = c if cond is None else cond & c
    j = main.join(eb, cond) if keys else main.crossJoin(eb)
    return j.select(*[main[c] for c in main.columns], *[eb[c] for c in eb.columns if c not in keys])


def multiplicity(rows: DataFrame, *keys) -> DataFrame:
    """Eager aggregation: how often each event occurs per key, before outcomes are joined."""
    return rows.groupBy(*keys, "event_id").agg(F.count(F.lit(1)).alias("weight"))


def cell_sums(rows: DataFrame, *keys) -> DataFrame:
    """Counts and sums per cell: the additive form of the metrics."""
    done = ~F.col("censored")
    hit = lambda l: count_if(done & (F.col("label") == l)).alias(l)
    d = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("state_count"),
        count_if(done).alias("complete"),
        count_if(~done).alias("censored_count"),
        *[hit(l) for l in LABELS],
        F.avg(F.when(done, F.col("mfe_pct"))).alias("mfe_pct"),
        F.avg(F.when(done, F.col("mae_pct"))).alias("mae_pct"),
    )
    return d.withColumn("tp_first_rate", ratio(F.col("TP_FIRST"), F.col("complete"))).withColumn(
        "ambiguous_rate", ratio(F.col("AMBIGUOUS"), F.col("complete"))
    )


def with_expectancy(cells: DataFrame) -> DataFrame:
    n = F.col("TP_FIRST") + F.col("SL_FIRST")
    return cells.withColumn("gross_resolved_expectancy_pct", ratio(100 * (F.col("TP_FIRST") * F.col("tp") - F.col("SL_FIRST") * F.col("sl")), n))


def all_plus_periods(rows: DataFrame, period: str = "quarter") -> DataFrame:
    """Each row twice, under ALL and under its own period: both come out of one aggregation."""
    return rows.withColumn("period", F.explode(F.array(F.lit("ALL"), F.col(period))))


def summarize_dims(rows: DataFrame, keys, dims) -> DataFrame:
    """No dimension, then each dimension alone, by grouping sets in one pass."""
    keys = list(keys)
    done = ~F.col("censored")
    g = rows.groupingSets([[F.col(k) for k in keys]] + [[F.col(k) for k in keys] + [F.col(d)] for d in dims], *[F.col(c) for c in keys + list(dims)])
    names = [F.when(F.grouping(d) == 0, F.lit(d)) for d in dims]
    values = [F.when(F.grouping(d) == 0, F.coalesce(F.col(d).cast("string"), F.lit("MISSING"))) for d in dims]
    return g.agg(
        F.coalesce(*names, F.lit("ALL")).alias("table"),
        F.coalesce(*values, F.lit("ALL")).alias("bucket"),
        F.count(F.lit(1)).alias("n"),
        count_if(done).alias("complete"),
        count_if(done & (F.col("label") == "TP_FIRST")).alias("TP_FIRST"),
    ).drop(*dims)


# ---- percentiles ---------------------------------------------------------------------


def midrank_expanding(df: DataFrame, keys, step: int, origin: int) -> DataFrame:
    """Percentile of each ``value`` among strictly earlier times, by rows and by events.

    ``df``: keys, qid, timestamp, value. Rows of one time never see each other; in the
    event-balanced form a time counts once however many rows it has.
    """
    keys = list(keys)
    t = F.floor((F.col("timestamp") - origin) / F.lit(step)).cast("long").alias("slot")
    per_time = Window.partitionBy(*keys, "timestamp")
    s = df.withColumn("_m", F.count(F.lit(1)).over(per_time)).select(*keys, t, F.col("value").alias("v"), F.lit(1.0).alias("row"), (1 / F.col("_m")).alias("event"))
    q = df.select(*keys, "qid", t, F.col("value").alias("v"))
    m = prior_mass(s, q, keys, ["row", "event"])
    p = lambda c: F.when(F.col("row_all") > 0.5, F.col(f"{c}_mid") / F.col(f"{c}_all"))
    got = m.select("qid", p("event").alias("event_percentile"), p("row").alias("row_percentile"), F.round("row_all").cast("long").alias("history_rows"))
    return df.join(got, "qid", "left").fillna(0, ["history_rows"])


def ecdf_model(df: DataFrame, keys) -> DataFrame:
    """Frozen weighted ECDF: value, row weight, event weight."""
    w = Window.partitionBy(*keys, "timestamp")
    d = df.withColumn("_m", F.count(F.lit(1)).over(w))
    return d.groupBy(*keys, "value").agg(F.sum(F.lit(1.0)).alias("row_weight"), F.sum(1 / F.col("_m")).alias("event_weight"))


def midrank_frozen(df: DataFrame, model: DataFrame, keys, band: float = 0.01) -> DataFrame:
    """Percentile against a frozen ECDF: model and questions sorted together, one running sum."""
    from tidemark.functions.scans import running

    keys = list(keys)
    m = model.select(*keys, F.col("value").alias("v"), F.lit(1).alias("_o"), F.lit(None).cast(df.schema["qid"].dataType).alias("qid"), F.col("row_weight").alias("r"), F.col("event_weight").alias("e"))
    q = df.select(*keys, F.col("value").alias("v"), F.explode(F.array(F.lit(0), F.lit(2))).alias("_o"), "qid", F.lit(0.0).alias("r"), F.lit(0.0).alias("e"))
    acc = running(m.unionByName(q), keys, ["v", "_o"], F.floor(F.col("v") / F.lit(band)), {"cr": F.col("r"), "ce": F.col("e")})
    mid = acc.filter("_o <> 1").groupBy(*keys, "qid").agg((F.sum("cr") / 2).alias("cr"), (F.sum("ce") / 2).alias("ce"))
    total = model.groupBy(*keys).agg(F.sum("row_weight").alias("tr"), F.sum("event_weight").alias("te"))
    return mid.join(total, keys).select(*keys, "qid", (F.col("ce") / F.col("te")).alias("event_percentile"), (F.col("cr") / F.col("tr")).alias("row_percentile"))


def supported(complete: Column, weeks: Column) -> Column:
    return (complete >= MIN_SUPPORT_ROWS) & (weeks >= MIN_SUPPORT_WEEKS)


# ---- shapes, correlations, contrasts -------------------------------------------------


def curve_shape(curve: DataFrame, keys, x: str, y: str, supported_col: str | None = None, expected: int | None = None) -> DataFrame:
    """Direction of a bucket curve: steps, ends minus middle, rank correlation and a name."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(x)  # one row per bucket
    whole = Window.partitionBy(*keys)
    rank = lambda c: F.rank().over(whole.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2
    d = curve.filter(F.col(y).isNotNull()).withColumn("_d", F.col(y) - F.lag(y).over(w)).withColumn("_rx", rank(x)).withColumn("_ry", rank(y))
    d = d.withColumn("_last", F.lead(x).over(w).isNull()).withColumn("_first", F.lag(x).over(w).isNull())
    yc = F.col(y)
    ok = F.bool_and(F.col(supported_col)) if supported_col else F.lit(True)
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("buckets"),
        count_if(F.col("_d") > 1e-12).alias("increasing_steps"),
        count_if(F.col("_d") < -1e-12).alias("decreasing_steps"),
        F.max(F.abs("_d")).alias("largest_step"),
        (F.max(F.when(F.col("_last"), yc)) - F.max(F.when(F.col("_first"), yc))).alias("high_minus_low"),
        ((F.max(F.when(F.col("_last"), yc)) + F.max(F.when(F.col("_first"), yc))) / 2 - F.avg(F.when(~F.col("_last") & ~F.col("_first"), yc))).alias("ends_minus_middle"),
        F.when(F.stddev_pop("_ry") > 0, F.corr("_rx", "_ry")).otherwise(0.0).alias("rank_correlation"),
        ok.alias("_ok"),
    )
    sparse = ~F.col("_ok") | (F.col("buckets") < (expected or 3))
    up, down = F.col("increasing_steps"), F.col("decreasing_steps")
    name = (
        F.when(sparse, "SPARSE").when((up == 0) & (down == 0), "FLAT").when(down == 0, "MONOTONIC_INCREASING").when(up == 0, "MONOTONIC_DECREASING").otherwise("NONLINEAR")
    )
    return g.withColumn("shape", name).drop("_ok")


def spearman(df: DataFrame, pairs, keys=()) -> DataFrame:
    """Rank correlation with average ties over rows where both fields exist.

    Ranks come from value counts: a running sum over distinct values, chunked by value, so no
    task sorts all rows of one field.
    """
    from functools import reduce

    from tidemark.functions.scans import running

    keys = list(keys)
    out = []
    for a, b in pairs:
        d = df.select(*keys, F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
        for c in ("a", "b"):
            n = d.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("n"))
            n = running(n, keys, [c], F.floor(F.signum(c) * F.log1p(F.abs(c)) * 64), {"upto": F.col("n")})
            n = n.select(*keys, c, (F.col("upto") - (F.col("n") - 1) / 2.0).alias(f"r{c}"))
            d = d.join(n, keys + [c])
        g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.when((F.stddev_pop("ra") > 0) & (F.stddev_pop("rb") > 0), F.corr("ra", "rb")).alias("spearman"))
        out.append(g.select(*keys, F.lit(a).alias("x"), F.lit(b).alias("y"), "pairs", "spearman"))
    return reduce(lambda p, q: p.unionByName(q), out)


def contrast(cohorts: DataFrame, comparisons: DataFrame, keys, metrics_) -> DataFrame:
    """Effect a minus b per metric for a declared list of comparisons (comparison, a, b, further columns)."""
    keys = list(keys)
    side = lambda n: cohorts.select(F.col("category").alias(n), *keys, F.col("complete").alias(f"{n}_complete"), F.col("week_blocks").alias(f"{n}_blocks"), *[F.col(m).alias(f"{n}_{m}") for m in metrics_])
    j = F.broadcast(comparisons).join(side("a"), "a").join(side("b"), ["b", *keys])
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"a_{m}") - F.col(f"b_{m}")).alias("effect")) for m in metrics_]))
    d = j.withColumn("c", cells)
    ok = supported(F.col("a_complete"), F.col("a_blocks")) & supported(F.col("b_complete"), F.col("b_blocks"))
    return d.select(*comparisons.columns, *keys, "c.*", "a_complete", "b_complete", "a_blocks", "b_blocks", ok.alias("supported"))
