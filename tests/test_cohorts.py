import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.config import TFS
from tidemark.operators import cohorts as H
from tidemark.plans import q_cohorts as Q

SUBS = [tuple(TFS[i] for i in s) for s in H.SUBSETS]
FIELDS = ["joint_quantity", *H.DELTAS, *[f"{tf}__imbalance" for tf in TFS]]
TOPS = {"joint_quantity": 3, "support_normalized_delta": 3, "resistance_normalized_delta": 2, "joint_delta": 3, "15m__imbalance": 3, "1h__imbalance": 2, "4h__imbalance": 3, "1d__imbalance": 3}


def masks(s):
    """All cohorts of one state, asked one by one."""
    out = {"all"}
    p = s["imbalance_pattern"]
    for d in H.DESCRIPTORS:
        q = dict(zip(TFS, s[f"{d}_pattern"]))
        text = s[f"{d}_pattern"]
        out.add(f"{d}/pattern/{text}")
        for side, ch, other, _ in H.WAYS:
            n = text.count(ch)
            if "M" not in text:
                out.add(f"{d}/{side}/count/{n}")
                if other not in text:
                    out.add(f"{d}/{side}/unopposed/{n}")
            for sub in SUBS:
                if all(q[t] == ch for t in sub):
                    out.add(f"{d}/{side}/aligned/{'+'.join(sub)}")
                    if n == len(sub) and "M" not in text:
                        out.add(f"{d}/{side}/only/{'+'.join(sub)}")
    out.add(f"conflict/{p[:2]}/{p[2:]}")
    q = dict(zip(TFS, p))
    b = {f: s[f"{f}_bucket"] for f in FIELDS}
    for side, ch, other, _ in H.WAYS:
        n, o, z = p.count(ch), p.count(other), s[f"{side}_overlap_count"]
        over = "overlap" if z >= 2 else "no_overlap"
        for base, added in H.ADDITIONS:
            if all(q[t] == ch for t in base):
                at = f"incremental/{side}/{'+'.join(base)}/add_{added}/"
                out.add(at + {ch: "agrees", "N": "neutral", other: "conflicts", "M": "missing"}[q[added]])
                if q[added] in ("N", other):
                    out.add(at + "not_agrees")
        if n >= 2 and o == 0:
            out.add(f"direction_space/{side}/agrees/{over}")
        if n > 0 and o > 0:
            out.add(f"direction_space/{side}/conflicts/{over}")
        out |= {f"zone/{side}/count/{z}", f"joint/{side}/sign{n}/zone{z}", f"spatial_increment/{side}/sign{n}/{over}", f"quantity/{side}/count{n}/Q{b['joint_quantity']}"}
        out |= {f"zone/{side}/combo/{'+'.join(x)}" for x in SUBS if s[f"{side}_overlap_{'+'.join(x)}"]}
        if "M" not in p:
            out.add(f"spatial_exact/{side}/{p}/{over}")
        if n == 4:
            out |= {f"delta/{side}/{f}/Q{b[f]}" for f in H.DELTAS} | {f"magnitude/{side}/{t}/Q{b[f'{t}__imbalance']}" for t in TFS}
            v = [b[f"{t}__imbalance"] for t in TFS]
            top = [TOPS[f"{t}__imbalance"] for t in TFS]
            joint = "missing" if min(v) < 0 else "weak" if max(v) == 0 else "strong" if v == top else "moderate" if all(0 < x < y for x, y in zip(v, top)) else "mixed"
            out.add(f"magnitude/{side}/joint/{joint}")
    return out


def states(n=400):
    rng = random.Random(7)
    out = []
    for i in range(n):
        s = {"event_id": f"e{i}", "block": i // 40, "quarter": "H1" if i < n // 2 else "H2"}
        for d in H.DESCRIPTORS:
            s[f"{d}_pattern"] = rng.choice(["SSSS", "RRRR", "".join(rng.choices("SRNM", [4, 3, 2, 1], k=4))])
        for side, *_ in H.WAYS:
            for x in SUBS:
                s[f"{side}_overlap_{'+'.join(x)}"] = rng.random() < 0.2
            s[f"{side}_overlap_count"] = rng.randint(0, 4)
        for f in FIELDS:
            s[f"{f}_bucket"] = rng.choice([-1, *[0] * 3, *range(TOPS[f] + 1), *[TOPS[f]] * 3])
        out.append(s)
    return out


def test_codes_unfold_to_all_masks(spark):
    rows = states()
    names = list(rows[0])
    kind = lambda v: "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "string"
    df = spark.createDataFrame([tuple(s[c] for c in names) for s in rows], ", ".join(f"`{c}` {kind(rows[0][c])}" for c in names))
    codes = H.facet_codes(df, {f: F.lit(n).cast("long") for f, n in TOPS.items()})
    got = codes.join(H.unfold(codes.select("code", *H.CODE).dropDuplicates(["code"])), "code").groupBy("event_id", "category").count().collect()
    assert all(r["count"] == 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.event_id, set()).add(r.category)
    assert by == {s["event_id"]: masks(s) for s in rows}
    declared = {c for c, _, _ in H.declared(TOPS)}
    assert set().union(*by.values()) <= declared and len(declared) == len(H.declared(TOPS))
    assert len({f for _, f, _ in H.declared(TOPS)}) == 17
    assert all(a in declared and b in declared for _, a, b, _ in H.comparisons(TOPS))
    # Sums by code, then unfolded, are the sums over the members.
    rng = random.Random(3)
    outcome = {s["event_id"]: (rng.choice(["TP_FIRST", "SL_FIRST", "NEITHER"]), rng.random() < 0.2, rng.random(), rng.random()) for s in rows}
    o = spark.createDataFrame([(e, "LONG", *x) for e, x in outcome.items()], "event_id string, direction string, label string, censored boolean, mfe_pct double, mae_pct double")
    table = H.cohort_table(H.cohort_sums(codes, o, ["direction"]), ["direction"]).collect()
    n, done, hit, blocks = Counter(), Counter(), Counter(), {}
    for s in rows:
        label, censored, *_ = outcome[s["event_id"]]
        for c in masks(s):
            for period in ("ALL", s["quarter"]):
                n[c, period] += 1
                done[c, period] += not censored
                hit[c, period] += not censored and label == "TP_FIRST"
                if not censored:
                    blocks.setdefault((c, period), set()).add(s["block"])
    assert {(r.category, r.period): (r.n, r.complete, r.censored, r.week_blocks) for r in table} == {k: (n[k], done[k], n[k] - done[k], len(blocks.get(k, ()))) for k in n}
    assert all((r.TP_FIRST is None) == (r.complete == 0) and abs((r.TP_FIRST or 0) * r.complete - hit[r.category, r.period]) < 1e-9 for r in table)


def test_bars_of_all_timeframes_from_one_reading(spark, monkeypatch):
    """Coarse bars merged from fine ones are those of the trades, and the trades are read once (F6, F7, F9, F10)."""
    from tidemark.plans import base, q_confluence

    sf, read = "/root/testdata/sf0.001", []
    want = {tf: base.bars_e(spark, sf, tf) for tf in ("1h", "4h", "1d")}
    tape = base.intraday_tape
    monkeypatch.setattr(base, "intraday_tape", lambda *a: read.append(1) or tape(*a))
    got = q_confluence.stored_bars(spark, sf)
    assert len(read) == 1 and list(got) == ["15m", "1h", "4h", "1d"]
    names = ["symbol", "tf", "idx", "open_time", "close_time", "end", "open", "high", "low", "close", "trade_count"]
    for tf, b in want.items():
        assert sorted(got[tf].columns) == sorted(b.columns)
        rows = lambda d: sorted(map(tuple, d.select(*names).collect()))
        assert rows(got[tf]) == rows(b) and got[tf].count() > 20


def test_intervals_unfold_compared_cohorts_only_and_are_drawn_once(spark, monkeypatch):
    """Both interval queries read one table; its cohorts are those of the comparisons, with the sums that all cohorts have."""
    grid = {"direction": "LONG", "tp": 1.0, "sl": 1.0, "horizon": 4}
    code = {"facet": "imbalance", "k": None, "m": None, "v": None, "t": None, "quarter": "H1"}
    rows, moves = [], []
    for i in range(240):
        p = ("SSSS", "RRRR", "SRNM")[i % 3]
        rows.append(code | {"event_id": str(i), "code": p, "p": p, "block": i // 30})
        moves.append(grid | {"event_id": str(i), "label": ("TP_FIRST", "SL_FIRST")[i % 5 == 0], "censored": i % 11 == 0, "mfe_pct": i / 100, "mae_pct": -i / 90})
    kind = "event_id string, code string, facet string, p string, k long, m string, v array<long>, t array<long>, block long, quarter string"
    codes = spark.createDataFrame([tuple(r[c.split()[0]] for c in kind.split(", ")) for r in rows], kind)
    o = spark.createDataFrame([tuple(m[c] for c in ("event_id", *Q.GRID, "label", "censored", "mfe_pct", "mae_pct")) for m in moves], "event_id string, direction string, tp double, sl double, horizon int, label string, censored boolean, mfe_pct double, mae_pct double")
    monkeypatch.setattr(Q, "_WRITTEN", {})
    monkeypatch.setattr(Q, "codes", lambda *_: (codes, TOPS))
    monkeypatch.setattr(Q, "outcomes15", lambda *_: o)
    paired, seen = Q.R.paired, []
    monkeypatch.setattr(Q.R, "paired", lambda sums, *a: seen.append(sums) or paired(sums, *a))
    got = Q.contrast_intervals(spark, "x").collect()
    assert Q.cohort_intervals(spark, "x").count() == len(got) and len(seen) == 1 and Q.evidence_intervals(spark, "x").count() > 0 and len(seen) == 1  # drawn once for both
    compared = {x for c in H.comparisons(TOPS) for x in c[1:3]}
    used = {r.category for r in seen[0].collect()}
    every = Q.sums(spark, "x")[0]
    assert used == compared & {r.category for r in every.collect()} and "A1/pattern/SSSS" not in used and "conflict/SS/SS" not in used
    whole = every.groupBy("category", *Q.GRID, "block").agg(*[F.sum(c).cast("double").alias(c) for c in ("complete", *H.METRICS)])
    pairs = spark.createDataFrame(H.comparisons(TOPS), "comparison string, a string, b string, family string")
    want = paired(whole, "category", Q.GRID, pairs, "block", ["complete", *H.METRICS], H.METRICS).collect()
    close = lambda rows: sorted((r.comparison, r.metric, *[None if x is None else round(x, 9) + 0.0 for x in (r.estimate, r.ci_low, r.ci_high)], r.finite_draws) for r in rows)
    assert len(got) == len(want) > 0 and any(r.ci_low is not None for r in got)
    assert {repr(x) for x in close(got)} ^ {repr(x) for x in close(want)} == set()
