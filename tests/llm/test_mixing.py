import hashlib
import math
import random
import re
from collections import defaultdict

from tidemark.llm import mixing


def share_out(sizes, shares, most):
    """Targets by handing the excess on, round by round."""
    total = sum(sizes)
    target, full = [0.0] * len(sizes), [False] * len(sizes)
    while not all(full):
        left = total - sum(most * s for s, f in zip(sizes, full) if f)
        weight = sum(w for w, f in zip(shares, full) if not f)
        level = [left * w / weight for w in shares]
        over = [i for i, f in enumerate(full) if not f and level[i] >= most * sizes[i]]
        if not over:
            break
        for i in over:
            full[i] = True
    for i, f in enumerate(full):
        target[i] = float(most * sizes[i]) if f else level[i]
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain(rows, weights, shares=(5, 2, 1), most=3):
    groups = defaultdict(list)
    for (i, text, source), w in zip(rows, weights):
        digest = hashlib.sha256(f"{'-' if i is None else i}:{text or ''}".encode()).hexdigest()
        late = w is not None and not w > 0
        key = -math.log((int(digest[:13], 16) + 0.5) / 2**52) / (1.0 if w is None or late else w)
        groups[source].append((late, key, size(text), i))
    names = sorted(groups, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[2] for r in groups[s]) for s in names]
    target = share_out(sizes, [shares[i % len(shares)] for i in range(len(names))], most)
    out = []
    for name, total, t in zip(names, sizes, target):
        epochs = int(t // total) if total else 0
        rest, before = t - epochs * total, 0
        for _, _, n, i in sorted(groups[name], key=lambda r: r[:3]):
            more = rest > 0 and before + n / 2 <= rest
            out.append((i, name, n, total, round(t, 6), (epochs + more) * n))
            before += n
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_against_plain_python(spark):
    rng = random.Random(12)
    rows, weights = [], []
    for i in range(700):
        source = rng.choices(["a", "b", "ü", "Z", None, "", "𝒳"], [60, 2, 20, 5, 5, 3, 1])[0]
        text = rng.choice([None, "", " \t", "x"]) if rng.random() < 0.1 else " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([1, 5, 40, 700])))
        rows.append((rng.choice([i, i, i, 3, None]), text, source))
        weights.append(rng.choice([None, 0.5, 1.0, 2.0, 0.0, -1.0, float("nan")]))
    rows += rows[:30]
    weights += weights[:30]
    data = [(*r, w, "x", 7) for r, w in zip(rows, weights)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, w double, taken string, target int")
    got = mixing.mixed(mixing.measured(df, ["w"]), "w").collect()
    assert ordered((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == ordered(plain(rows, weights))
    by = defaultdict(list)
    for r in got:
        assert r.taken <= 3 * r["size"]
        by[r.source].append(r)
    for some in by.values():
        assert abs(sum(r.taken for r in some) - some[0].target) <= max(r["size"] for r in some)


def test_targets_stop_and_hand_on(spark):
    rng = random.Random(3)
    for n in (1, 2, 9, 40):
        sizes = [rng.choice([0, 1, 10, 1000, 10**6]) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:03}", s) for i, s in enumerate(sizes)], "_source string, source_size long")
        got = [r.target for r in mixing.targets(df).orderBy("_source").collect()]
        want = share_out(sizes, [(5, 2, 1)[i % 3] for i in range(n)], 3)
        assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9) for a, b in zip(got, want))
        assert math.isclose(sum(got), sum(sizes), rel_tol=1e-12)


def test_good_documents_are_taken_more_often(spark):
    data = [(i, f"some words {i}", "big" if i % 2 else "small", 1 if i % 4 < 2 else 0) for i in range(4000)] + [(9000 + i, "one", "tiny", 0) for i in range(3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, quality int")
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in data] + [(0, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    weighed = mixing.label_weights(docs.withColumnRenamed("quality", "quality_weight"), labels)
    assert dict(weighed.groupBy("quality_weight").count().collect()) == {2.0: 1999, 0.5: 2004}
    taken = mixing.mixed(mixing.measured(weighed, ["quality_weight"]), "quality_weight").join(docs.select("doc_id", "quality"), "doc_id").filter("source = 'small' and copies = 1").groupBy("quality").count()
    n = dict(taken.collect())
    assert n[1] > 1.5 * n[0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(mixing.measured(df)).collect() == []
