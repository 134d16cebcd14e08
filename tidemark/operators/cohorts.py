"""Predeclared cohorts, their tables and contrasts, stability over quarters and phases."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import TFS
from tidemark.functions.columns import bucket_left, count_if, ratio
from tidemark.operators.stats import supported

METRICS = ("TP_FIRST", "SL_FIRST", "NEITHER", "AMBIGUOUS", "mfe_pct", "mae_pct")
SUBSETS = [s for n in range(1, len(TFS) + 1) for s in combinations(range(len(TFS)), n)]


def _tag(cond: Column, name: Column, family: str, side: str = "BOTH") -> Column:
    return F.when(cond, F.struct(name.alias("category"), F.lit(family).alias("family"), F.lit(side).alias("interpretation")))


WAYS = (("support", "S", "R", "LONG"), ("resistance", "R", "S", "SHORT"))
DESCRIPTORS = ("imbalance", "A1", "A2")
# Timeframes that agree, and the one whose sign is added.
ADDITIONS = (
    (("15m",), "1h"), (("1h",), "4h"), (("4h",), "1d"), (("15m", "1h"), "4h"), (("1h", "4h"), "1d"),
    (("15m", "1h", "4h"), "1d"), (("15m", "1h", "1d"), "4h"), (("15m", "4h", "1d"), "1h"), (("1h", "4h", "1d"), "15m"),
)
DELTAS = ("support_normalized_delta", "resistance_normalized_delta", "joint_delta")
JOINT = ("weak", "moderate", "strong", "mixed", "missing")
CODE = ("facet", "p", "k", "m", "v", "t")


def _name(tfs) -> str:
    return "+".join(tfs)


def _at(p: Column, tf: str) -> Column:
    return F.substring(p, TFS.index(tf) + 1, 1)


def _agree(p: Column, tfs, ch: str) -> Column:
    cond = F.lit(True)
    for tf in tfs:
        cond = cond & (_at(p, tf) == ch)
    return cond


def _tfs(sub) -> tuple:
    return tuple(TFS[i] for i in sub)


def facet_codes(states: DataFrame, tops: dict[str, Column]) -> DataFrame:
    """One row per state and facet with the facet's code: all that the cohorts of a facet ask of a state.

    ``states``: sign patterns of three descriptors, overlap counts and regions per side, and buckets of joint quantity, deltas and
    absolute imbalances (``<field>_bucket``); ``tops``: the highest bucket of each field. Ten rows a state stand for about
    a hundred memberships.
    """
    p = F.col("imbalance_pattern")
    none = {"p": F.lit(None).cast("string"), "k": F.lit(None).cast("long"), "m": F.lit(None).cast("string"), "v": F.lit(None).cast("array<long>"), "t": F.lit(None).cast("array<long>")}
    code = lambda facet, **parts: F.struct(F.lit(facet).alias("facet"), *[parts.get(n, d).alias(n) for n, d in none.items()])
    rows = [code(d, p=F.col(f"{d}_pattern")) for d in DESCRIPTORS]
    for side, *_ in WAYS:
        rows.append(code(side, p=p, k=F.col(f"{side}_overlap_count")))
        regions = F.array_compact(F.array(*[F.when(F.col(f"`{side}_overlap_{_name(_tfs(s))}`"), F.lit(_name(_tfs(s)))) for s in SUBSETS]))
        rows.append(code(f"{side}_regions", m=F.array_join(regions, "|")))
    rows.append(code("quantity", p=p, k=F.col("joint_quantity_bucket")))
    whole = p.isin(*[ch * len(TFS) for _, ch, _, _ in WAYS])
    rows += [F.when(whole, code("delta", p=p, k=F.col(f"{f}_bucket"), m=F.lit(f))) for f in DELTAS]
    each = F.array(*[F.col(f"`{tf}__imbalance_bucket`") for tf in TFS])
    rows.append(F.when(whole, code("magnitude", p=p, v=each, t=F.array(*[tops[f"{tf}__imbalance"] for tf in TFS]))))
    keep = [c for c in ("event_id", "block", "quarter") if c in states.columns]
    out = states.select(*keep, F.explode(F.array_compact(F.array(*rows))).alias("_c")).select(*keep, "_c.*")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("facet", "p", "k", "m")] + [F.coalesce(F.array_join(c, ","), F.lit("")) for c in ("v", "t")]
    return out.withColumn("code", F.concat_ws(":", *text))


def _descriptor_tags(name: str, p: Column) -> list[Column]:
    """Number of agreeing signs, that number without an opposite one, subsets that agree, exact pattern."""
    out = [_tag(F.lit(True), F.concat(F.lit(f"{name}/pattern/"), p), "exact_pattern")]
    clear = ~p.contains("M")
    for side, ch, other, way in WAYS:
        n, against = F.regexp_count(p, F.lit(ch)), F.regexp_count(p, F.lit(other))
        out.append(_tag(clear, F.concat(F.lit(f"{name}/{side}/count/"), n.cast("string")), "sign_count", way))
        out.append(_tag(clear & (against == 0), F.concat(F.lit(f"{name}/{side}/unopposed/"), n.cast("string")), "unopposed_count", way))
        for sub in SUBSETS:
            on = _agree(p, _tfs(sub), ch)
            out.append(_tag(on, F.lit(f"{name}/{side}/aligned/{_name(_tfs(sub))}"), "hierarchy_inclusive", way))
            out.append(_tag(on & clear & (n == len(sub)), F.lit(f"{name}/{side}/only/{_name(_tfs(sub))}"), "hierarchy_exclusive", way))
    return out


def _added_tags(p: Column) -> list[Column]:
    """Timeframes that agree, split by what the added one says."""
    out = []
    for side, ch, other, way in WAYS:
        for base, added in ADDITIONS:
            on, a = _agree(p, base, ch), _at(p, added)
            for label, cond in (("agrees", a == ch), ("neutral", a == "N"), ("conflicts", a == other), ("missing", a == "M"), ("not_agrees", a.isin("N", other))):
                out.append(_tag(on & cond, F.lit(f"incremental/{side}/{_name(base)}/add_{added}/{label}"), "incremental", way))
    return out


def _space_tags(side: str, ch: str, other: str, way: str, p: Column, k: Column) -> list[Column]:
    """Timeframes whose zones overlap, alone and with the signs."""
    n, against = F.regexp_count(p, F.lit(ch)), F.regexp_count(p, F.lit(other))
    over = F.when(k >= 2, "overlap").otherwise("no_overlap")
    text = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    c = lambda x: x.cast("string")
    return [
        _tag(F.lit(True), text(f"zone/{side}/count/", c(k)), "zone_count", way),
        _tag(F.lit(True), text(f"joint/{side}/sign", c(n), "/zone", c(k)), "direction_x_space", way),
        _tag(F.lit(True), text(f"spatial_increment/{side}/sign", c(n), "/", over), "spatial_increment", way),
        _tag(~p.contains("M"), text(f"spatial_exact/{side}/", p, "/", over), "spatial_exact", way),
        _tag((n >= 2) & (against == 0), text(f"direction_space/{side}/agrees/", over), "direction_space", way),
        _tag((n > 0) & (against > 0), text(f"direction_space/{side}/conflicts/", over), "direction_space", way),
    ]


def _magnitude_tags(p: Column, v: Column, t: Column) -> list[Column]:
    """Strength of each timeframe where all four agree, and of all together."""
    out = []
    both = F.arrays_zip(v.alias("v"), t.alias("t"))
    joint = (
        F.when(F.exists(v, lambda x: x < 0), "missing").when(F.forall(v, lambda x: x == 0), "weak").when(F.forall(both, lambda x: x["v"] == x["t"]), "strong")
        .when(F.forall(both, lambda x: (x["v"] > 0) & (x["v"] < x["t"])), "moderate").otherwise("mixed")
    )
    for side, ch, _, way in WAYS:
        on = p == ch * len(TFS)
        out += [_tag(on, F.concat(F.lit(f"magnitude/{side}/{tf}/Q"), F.get(v, F.lit(i)).cast("string")), "magnitude", way) for i, tf in enumerate(TFS)]
        out.append(_tag(on, F.concat(F.lit(f"magnitude/{side}/joint/"), joint), "magnitude", way))
    return out


def unfold(codes: DataFrame) -> DataFrame:
    """(code, category, family, interpretation): every cohort of every code, both sides of a sign and all its subsets."""
    p, k, m, v, t = (F.col(c) for c in CODE[1:])
    tags = {d: _descriptor_tags(d, p) for d in DESCRIPTORS}
    conflict = F.concat(F.lit("conflict/"), F.substring(p, 1, 2), F.lit("/"), F.substring(p, 3, 2))
    tags["imbalance"] += [_tag(F.lit(True), F.lit("all"), "baseline"), _tag(F.lit(True), conflict, "conflict"), *_added_tags(p)]
    tags |= {"quantity": [], "delta": [], "magnitude": _magnitude_tags(p, v, t)}
    q = F.concat(F.lit("Q"), k.cast("string"))
    for side, ch, other, way in WAYS:
        tags[side] = _space_tags(side, ch, other, way, p, k)
        tags[f"{side}_regions"] = [_tag(F.array_contains(F.split(m, "[|]"), n), F.lit(f"zone/{side}/combo/{n}"), "zone_combination", way) for n in (_name(_tfs(s)) for s in SUBSETS)]
        tags["quantity"].append(_tag(F.lit(True), F.concat(F.lit(f"quantity/{side}/count"), F.regexp_count(p, F.lit(ch)).cast("string"), F.lit("/"), q), "quantity", way))
        tags["delta"].append(_tag(p == ch * len(TFS), F.concat(F.lit(f"delta/{side}/"), m, F.lit("/"), q), "delta_exploratory", way))
    parts = [codes.filter(F.col("facet") == f).select("code", F.explode(F.array_compact(F.array(*x))).alias("_t")).select("code", "_t.*") for f, x in tags.items()]
    return reduce(DataFrame.unionByName, parts)


def declared(tops: dict[str, int]) -> list[tuple[str, str, str]]:
    """Every predeclared cohort (category, family, interpretation), so that empty ones appear. ``tops``: highest bucket of each field."""
    rows = [("all", "baseline", "BOTH")]
    subs = [_name(_tfs(s)) for s in SUBSETS]
    every = ["".join(x) for x in product("SRNM", repeat=len(TFS))]
    n = range(len(TFS) + 1)
    for d in DESCRIPTORS:
        rows += [(f"{d}/pattern/{p}", "exact_pattern", "BOTH") for p in every]
        for side, _, _, way in WAYS:
            rows += [(f"{d}/{side}/{kind}/{k}", f"{family}_count", way) for k in n for kind, family in (("count", "sign"), ("unopposed", "unopposed"))]
            rows += [(f"{d}/{side}/{kind}/{s}", f"hierarchy_{family}", way) for s in subs for kind, family in (("aligned", "inclusive"), ("only", "exclusive"))]
    rows += [(f"conflict/{p[:2]}/{p[2:]}", "conflict", "BOTH") for p in every]
    over = ("overlap", "no_overlap")
    for side, _, _, way in WAYS:
        rows += [(f"incremental/{side}/{_name(b)}/add_{a}/{x}", "incremental", way) for b, a in ADDITIONS for x in ("agrees", "neutral", "conflicts", "missing", "not_agrees")]
        rows += [(f"direction_space/{side}/{x}/{o}", "direction_space", way) for x in ("agrees", "conflicts") for o in over]
        rows += [(f"zone/{side}/count/{k}", "zone_count", way) for k in n] + [(f"zone/{side}/combo/{s}", "zone_combination", way) for s in subs]
        rows += [(f"joint/{side}/sign{i}/zone{j}", "direction_x_space", way) for i in n for j in n]
        rows += [(f"spatial_increment/{side}/sign{i}/{o}", "spatial_increment", way) for i in n for o in over]
        rows += [(f"spatial_exact/{side}/{p}/{o}", "spatial_exact", way) for p in every if "M" not in p for o in over]
        rows += [(f"quantity/{side}/count{i}/Q{q}", "quantity", way) for i in n for q in range(-1, tops["joint_quantity"] + 1)]
        rows += [(f"delta/{side}/{f}/Q{q}", "delta_exploratory", way) for f in DELTAS for q in range(-1, tops[f] + 1)]
        rows += [(f"magnitude/{side}/{tf}/Q{q}", "magnitude", way) for tf in TFS for q in range(-1, tops[f"{tf}__imbalance"] + 1)]
        rows += [(f"magnitude/{side}/joint/{x}", "magnitude", way) for x in JOINT]
    return rows


def comparisons(tops: dict[str, int]) -> list[tuple[str, str, str, str]]:
    """Every predeclared comparison (comparison, a, b, family)."""
    out = []
    n = range(len(TFS) + 1)
    baseline = lambda name, family: out.append((f"{name}/vs_all", name, "all", family))
    for side, *_ in WAYS:
        for k in n:
            baseline(f"imbalance/{side}/count/{k}", "sign_baseline")
            baseline(f"zone/{side}/count/{k}", "zone_baseline")
            x = f"spatial_increment/{side}/sign{k}"
            out.append((x, f"{x}/overlap", f"{x}/no_overlap", "spatial_increment"))
            x = f"quantity/{side}/count{k}"
            out.append((f"{x}/high_minus_low", f"{x}/Q{tops['joint_quantity']}", f"{x}/Q0", "quantity"))
        for sub in SUBSETS:
            name = f"imbalance/{side}/aligned/{_name(_tfs(sub))}"
            baseline(name, "hierarchy_baseline")
            baseline(f"zone/{side}/combo/{_name(_tfs(sub))}", "zone_baseline")
            for lower in (x for x in SUBSETS if set(x) < set(sub)):
                short = _name(_tfs(lower))
                out.append((f"{name}/vs/{short}", name, f"imbalance/{side}/aligned/{short}", "nested_baseline"))
        for base, added in ADDITIONS:
            x = f"incremental/{side}/{_name(base)}/add_{added}"
            out += [(f"{x}/agrees_vs_{b}", f"{x}/agrees", f"{x}/{b}", "incremental") for b in ("not_agrees", "neutral", "conflicts")]
        for p in map("".join, product("SRN", repeat=len(TFS))):
            x = f"spatial_exact/{side}/{p}"
            out.append((x, f"{x}/overlap", f"{x}/no_overlap", "spatial_exact"))
    for name, a, b in (("lower_support_higher_resistance", "SSRR", "RRSS"), ("lower_support_vs_all_support", "SSRR", "SSSS"), ("lower_resistance_vs_all_resistance", "RRSS", "RRRR")):
        out.append((f"conflict/{name}", f"imbalance/pattern/{a}", f"imbalance/pattern/{b}", "conflict"))
    return out


def cohort_names(codes: DataFrame) -> DataFrame:
    """(code, category, family, interpretation) of the codes that occur; equal rows go first, by hash, as codes are few."""
    return unfold(codes.select("code", *CODE).distinct().dropDuplicates(["code"]))


def code_sums(codes: DataFrame, outcomes: DataFrame, grid) -> DataFrame:
    """Sums per code, quarter, block and grid; the outcomes meet ten rows a state. ``codes``: a written table of ``facet_codes``."""
    done = ~F.col("censored")
    hit = lambda l: count_if(done & (F.col("label") == l)).alias(l)
    move = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0.0)).alias(c)
    return codes.select("event_id", "code", "block", "quarter").join(outcomes, "event_id").groupBy("code", "block", "quarter", *grid).agg(
        F.count(F.lit(1)).alias("n"), count_if(done).alias("complete"), count_if(~done).alias("censored"), *[hit(l) for l in METRICS[:4]], *[move(c) for c in METRICS[4:]]
    )


def unfolded(per_code: DataFrame, names: DataFrame, keys) -> DataFrame:
    """``code_sums`` of all cohorts of ``names``: what unfolds are sums, whose number the codes and the calendar bound."""
    return per_code.join(names, "code").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "complete", "censored", *METRICS)])


def cohort_sums(codes: DataFrame, outcomes: DataFrame, grid) -> DataFrame:
    """Sums per cohort, quarter, block and grid: taken once per code, then unfolded to all cohorts of the code."""
    return unfolded(code_sums(codes, outcomes, grid), cohort_names(codes), ["category", "family", "interpretation", "block", "quarter", *grid])


def cohort_table(sums: DataFrame, grid) -> DataFrame:
    """n, complete, censored, blocks, support and six metrics per cohort, period and grid; ALL and quarters in one aggregation."""
    d = sums.withColumn("period", F.explode(F.array(F.lit("ALL"), F.col("quarter"))))
    g = d.groupBy("category", "family", "interpretation", "period", *grid).agg(
        *[F.sum(c).alias(c) for c in ("n", "complete", "censored")],
        F.count_distinct(F.when(F.col("complete") > 0, F.col("block"))).alias("week_blocks"),
        *[ratio(F.sum(m), F.sum("complete")).alias(m) for m in METRICS],
    )
    return g.withColumn("supported", supported(F.col("complete"), F.col("week_blocks")))


def memberships(states: DataFrame, tags: list[Column]) -> DataFrame:
    """Long form: one row per state and cohort it belongs to."""
    return states.withColumn("_t", F.explode(F.array_compact(F.array(*tags)))).select(*states.columns, "_t.*")


def strength_tags(tf_buckets: dict[str, Column], top: int, prefix: Column, condition: Column) -> list[Column]:
    """Per-timeframe strength buckets, number of top buckets, weak / moderate / strong / mixed / missing."""
    b = list(tf_buckets.values())
    v = F.array(*b)
    missing = F.exists(v, lambda x: x < 0)
    weak, strong = F.forall(v, lambda x: x == 0), F.forall(v, lambda x: x == top)
    moderate = F.forall(v, lambda x: (x > 0) & (x < top))
    joint = F.when(missing, "missing").when(weak, "weak").when(strong, "strong").when(moderate, "moderate").otherwise("mixed")
    q4 = F.size(F.filter(v, lambda x: x == top))
    tags = [_tag(condition, F.concat(prefix, F.lit(f"/native/{tf}/Q"), c.cast("string")), "native_strength") for tf, c in tf_buckets.items()]
    tags.append(_tag(condition, F.concat(prefix, F.lit("/strength/"), joint), "strength_configuration"))
    tags.append(_tag(condition & ~missing, F.concat(prefix, F.lit("/Q4_count/"), q4.cast("string")), "Q4_count"))
    return tags


def bucket_tag(value: Column, cuts: Column, prefix: Column, family: str, condition: Column) -> Column:
    return _tag(condition, F.concat(prefix, F.lit("/Q"), bucket_left(value, cuts).cast("string")), family)


def with_empty(table: DataFrame, categories: DataFrame, cells: DataFrame) -> DataFrame:
    """All declared categories x cells, counts zero where nothing fell."""
    keys = ["category", "family", "interpretation", *cells.columns]
    full = F.broadcast(categories).crossJoin(F.broadcast(cells))  # declared lists, not data
    return full.join(table, keys, "left").fillna(0, ["n", "complete", "censored", "week_blocks"]).fillna(False, ["supported"])


def quarter_stability(effects: DataFrame, keys) -> DataFrame:
    """Sign agreement over quarters and the share of the largest quarter.

    ``effects``: keys, period (ALL or a quarter), effect, supported.
    """
    keys = list(keys)
    e, ok, q = F.col("effect"), F.col("supported"), F.col("period") != "ALL"
    g = effects.groupBy(*keys).agg(
        F.max(F.when(~q, e)).alias("pooled_effect"),
        F.count_distinct(F.when(q, F.col("period"))).alias("quarters"),
        count_if(q & ok).alias("supported_quarters"),
        count_if(q & ok & (e > 0)).alias("positive_quarters"),
        count_if(q & ok & (e < 0)).alias("negative_quarters"),
        F.min(F.when(q, e)).alias("min_quarter_effect"),
        F.max(F.when(q, e)).alias("max_quarter_effect"),
        ratio(F.max(F.when(q, F.abs(e))), F.sum(F.when(q, F.abs(e)))).alias("largest_quarter_share"),
    )
    same = ((F.col("positive_quarters") == F.col("quarters")) & (F.col("pooled_effect") > 0)) | ((F.col("negative_quarters") == F.col("quarters")) & (F.col("pooled_effect") < 0))
    return g.withColumn("same_sign_all_quarters", F.coalesce(same, F.lit(False)))


def stability_counts(dev: DataFrame, rep: DataFrame, keys, by) -> DataFrame:
    """Per ``by``: comparisons, how many are supported in both phases, how many keep their sign."""
    side = lambda d, s: d.select(*keys, F.col("effect").alias(f"effect_{s}"), F.col("supported").alias(f"supported_{s}"))
    j = side(dev, "dev").join(side(rep, "rep"), list(keys))
    both = F.col("supported_dev") & F.col("supported_rep")
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("comparisons"), count_if(both).alias("supported_both"), count_if(F.signum("effect_dev") * F.signum("effect_rep") > 0).alias("same_sign")
    )


def evidence_ranges(effects: DataFrame, by) -> DataFrame:
    e = F.col("effect")
    return effects.groupBy(*by).agg(
        F.count(F.lit(1)).alias("grids"), count_if(F.col("supported")).alias("supported_count"), F.min(e).alias("minimum_effect"), F.max(e).alias("maximum_effect"),
        count_if(e > 0).alias("positive"), count_if(e < 0).alias("negative"), F.min("a_complete").alias("minimum_a_complete"), F.min("b_complete").alias("minimum_b_complete"),
    )


def conditional_summary(rows: DataFrame, cell, within, grid) -> DataFrame:
    """Rate of each flow bucket inside its map bucket, against the map bucket, the cohort and all rows.

    ``rows``: within, cell, grid, label, censored, ``ok`` (usable flow). All four levels come
    from one aggregation of the finest cells.
    """
    done = ~F.col("censored")
    fine = rows.groupBy("ok", within, cell, *grid).agg(count_if(done).alias("n"), count_if(done & (F.col("label") == "TP_FIRST")).alias("x"))
    roll = lambda d, keys, s: d.groupBy(*keys, *grid).agg(ratio(F.sum("x"), F.sum("n")).alias(f"rate_{s}"))
    used = fine.filter("ok")
    full = used.groupBy(within, cell, *grid).agg(F.sum("n").alias("complete"), ratio(F.sum("x"), F.sum("n")).alias("tp_first_rate"))
    out = full.join(roll(used, [within], "map_only"), [within, *grid]).join(roll(used, [], "cohort"), list(grid)).join(roll(fine, [], "unconditioned"), list(grid))
    return out.withColumn("increment_vs_map", F.col("tp_first_rate") - F.col("rate_map_only"))


def facet_memberships(rows: DataFrame, families: dict[str, Column], facets: list[str]) -> DataFrame:
    """Long rows (family, facet, facet_value, bucket, event_id, weight): every family under ALL, the
    first one under each facet as well, pre-aggregated to multiplicities."""
    names = list(families)
    tags = [F.struct(F.lit(f).alias("family"), F.lit("ALL").alias("facet"), F.lit("ALL").alias("facet_value"), b.cast("string").alias("bucket")) for f, b in families.items()]
    for facet in facets:
        tags.append(F.struct(F.lit(names[0]).alias("family"), F.lit(facet).alias("facet"), F.col(facet).cast("string").alias("facet_value"), families[names[0]].cast("string").alias("bucket")))
    d = rows.withColumn("_t", F.explode(F.array(*tags)))
    return d.groupBy("_t.family", "_t.facet", "_t.facet_value", "_t.bucket", "event_id").agg(F.count(F.lit(1)).alias("weight"))


def ablation(score: DataFrame) -> DataFrame:
    """Full-and-half against full-only score: sign case, magnitude case."""
    a, b = F.col("A1"), F.col("A2")
    sign = F.when(F.signum(a) == F.signum(b), "same_sign").when(a * b < 0, "sign_flip").otherwise("one_zero")
    size = F.when(F.abs(a) > F.abs(b), "larger").when(F.abs(a) < F.abs(b), "smaller").otherwise("equal")
    return score.withColumn("half_band_difference", a - b).withColumn("sign_case", sign).withColumn("magnitude_case", size)
