import random

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import near


def plain(text, width=5):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def classes(sets, percent=80):
    """Smallest place reachable, by comparing all pairs."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if not x and not y or len(x & y) * 100 >= percent * len(x | y) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def texts(seed):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.4)) % 400}"  # noqa: E731  common ones too
    prose = lambda n: [word() for _ in range(n)]
    out = [None, "", " \t\n", "One two", "one TWO", "one two three four five", "one two three four six"]
    common = prose(40)
    for n in (8, 30, 60, 120, 120, 300):
        base = prose(n)
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):  # at similarity 0.8 and on both sides of it
                words[rng.randrange(n)] = word()
            out.append(" ".join(words))
    out += [" ".join(prose(rng.randint(0, 30)) + common + prose(rng.randint(0, 30))) for _ in range(40)]
    out += out[20:40]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_survivors_against_all_pairs_by_jaccard(spark, block):
    rows = texts(block)
    want = classes([plain(t) for t in rows])
    assert 60 < len(set(want)) < len(rows) - 60
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    kept = near.keep_first(docs, block=block)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_pipeline_stage_takes_copies_of_similarity_08(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(2)
    bases = [[f"w{rng.randrange(10_000)}" for _ in range(204)] for _ in range(30)]
    rows = [" ".join(b) for b in bases]
    for b in bases:  # four words apart from each other: 20 of 200 shingles, similarity 180 / 220
        rows.append(" ".join("new" + w if i in (30, 70, 110, 150) else w for i, w in enumerate(b)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    stage = dict(pipeline.STAGES)["SimHash near-dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == list(range(30))


def test_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a), (7, a), (7, a), (7, b), (None, c), (None, c), (3, c + " more"), (None, "alone"), (None, "alone"), (None, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in near.keep_first(docs).collect()), key=str)
    assert got == sorted([(7, a), (7, b), (3, c + " more"), (None, "alone"), (None, "other")], key=str)


@pytest.mark.parametrize("step", [1, 2, 7, 1000])
def test_buckets_over_batches(step):
    rng = random.Random(step)
    rows = sorted((rng.randrange(30), rng.randrange(12)) for _ in range(120))
    df = pd.DataFrame([(h, node, node + 50, node % 5) for h, node in rows], columns=["h", "node", "n", "pos"])
    got = pd.concat(near._shared(df.iloc[i : i + step].reset_index(drop=True) for i in range(0, len(df), step)))
    want = []
    for h in range(30):
        members = sorted({node for x, node in rows if x == h})
        want += [(h, m, m + 50, m % 5, members[0], members[0] + 50, members[0] % 5, i) for i, m in enumerate(members) if len(members) > 1]
    assert [tuple(map(int, r)) for r in got.itertuples(index=False)] == want


def test_empty_table(spark):
    assert near.keep_first(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_stage_gets_links_from_fingerprints(spark, monkeypatch):
    """With the completion from the sets switched off, pairs within three bits are still found and verified (F5)."""
    import corpus_pipeline as pipeline
    from tidemark.llm.simhash import fingerprint

    rng = random.Random(5)
    rows = []
    for _ in range(20):
        base = [f"w{rng.randrange(10_000)}" for _ in range(400)]
        rows += [" ".join(base), " ".join([*base, "end"]), " ".join(["start", *base])]
    rows += ["a b c d e", "A B c d e"]
    bits = [fingerprint(t, 5) for t in rows]
    sets = [plain(t) for t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if ((bits[i] ^ bits[j]) & (1 << 64) - 1).bit_count() <= 3 and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    monkeypatch.setattr(near, "_prefixes", lambda *a: lambda batches: (pd.DataFrame(columns=["h", "node", "n", "pos"]).astype("int64") for _ in batches))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = sorted(r.doc_id for r in dict(pipeline.STAGES)["SimHash near-dedup"](spark, docs, "").collect())
    assert got == sorted(set(root)) and len(got) < 40


def test_bound_from_parities_never_exceeds_what_is_apart():
    rng = np.random.default_rng(3)
    refused = 0
    for n in (0, 1, 3, 63, 64, 65, 200, 1025, 5000):
        x = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        for left in (0, n // 9, n // 3, n):
            for more in (0, n // 9, n, 3 * n):
                y = np.unique(np.r_[x[left:], rng.integers(-(2**63), 2**63 - 1, more)])
                apart = len(np.setxor1d(x, y))
                least = near._apart_at_least(near.parities(x), near.parities(y))
                assert least <= apart and (apart or not least) and least == near._apart_at_least(near.parities(y), near.parities(x))
                if len(x) + len(y):
                    ok = bool(near._possible(80).func(*(pd.Series([v]) for v in (len(x), len(y), near.parities(x), near.parities(y))))[0])
                    shared = len(x) + len(y) - apart
                    assert ok or shared // 2 * 180 < 80 * (len(x) + len(y))
                    refused += not ok
    assert refused > 60


def test_whole_sets_go_out_for_close_pairs_only_and_shuffles_go(spark, monkeypatch):
    """Texts that begin alike are candidates and far apart: their sets stay where they are (F1). No shuffle of the stage outlives it."""
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    common = prose(40)
    rows = [" ".join(common + prose(160)) for _ in range(40)]
    rows += [r + " end" for r in rows[:5]]
    monkeypatch.setattr(near, "OFTEN", 1000)  # else what they begin with comes last in the order
    written = {}
    plain_write = near.materialize
    monkeypatch.setattr(near, "materialize", lambda df, label="cut": written.setdefault(label, []).append(out := plain_write(df, label)) or out)
    files = lambda: {f.getName() for f in _listed(spark) if f.getName().startswith("shuffle_")}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    before = files()
    kept = near.keep_first(docs)
    assert not files() - before
    assert sum(t.count() for name in ("led", "crossing") for t in written[name]) > 200
    assert sum(t.count() for t in written["sets"]) <= 40
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))


def _listed(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [files.apply(i) for i in range(files.size())]
