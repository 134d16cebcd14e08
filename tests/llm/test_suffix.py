import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, suffix


def removed(texts, size):
    """Covered bytes of each text, from a table of all windows."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - size + 1):
            seen[d[i : i + size]] = seen.get(d[i : i + size], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = True
        left = bytes(np.frombuffer(d, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choices("abcdé ", k=n))
    passages = [make(n) for n in (39, 40, 41, 60, 130)]
    out = [None, "", "x", make(40), "z" * 90, "ab" * 60, "xyz" * 50 + make(30)]
    for _ in range(40):
        t = make(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 8)
            t += p[a : len(p) - rng.randint(0, 8)] + make(rng.randint(0, 30))
        out.append(t)
    out += out[8:12] + [make(3000)]
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_removed_bytes_against_all_windows(spark, hot):
    for seed in (1, 2):
        rows = texts(seed)
        # ids: one null, one twice with other text, the same row twice
        ids = [None if i == 5 else 3 if i == 4 else i for i in range(len(rows))]
        data = [(i, t, 0, "s") for i, t in zip(ids, rows)] + [(8, rows[8], 0, "s")]
        df = spark.createDataFrame(data, "doc_id long, text string, n_bytes int, cut_ string")
        got = suffix.without_repeats(df, size=40, hot=hot).select("doc_id", "text", "cut.*").collect()
        want = removed([r[1] for r in data], 40)
        key = lambda r: tuple(map(str, r))
        assert sorted([(r.doc_id, r[2], r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=key) == sorted(
            [(d[0], *w) for d, w in zip(data, want)], key=key
        )


def test_maximal_repeats_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 9)
        base = bytes(rng.choices(b"ab", k=24))
        pairs = set()
        while len(pairs) < n:
            x = bytearray(base)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(24)] = 99
            pairs.add((bytes(x[:8]), bytes(x[8:])))
        lefts, rights = map(list, zip(*sorted(pairs)))
        got = suffix.maximal_repeats(lefts, rights, [1] * n, 10)
        want = set()
        for i in range(n):
            for j in range(i):
                back, ahead = suffix.common(lefts[i][::-1], lefts[j][::-1]), suffix.common(rights[i], rights[j])
                if back + ahead >= 10:  # the string that both share, and all that have it
                    a, b = lefts[i][len(lefts[i]) - back :], rights[i][:ahead]
                    want.add((back, ahead, frozenset(m for m in range(n) if lefts[m].endswith(a) and rights[m].startswith(b))))
        # of strings with the same members only the longest is maximal
        assert {(b, a, frozenset(m)) for b, a, m in got} >= {w for w in want if not any(v[2] == w[2] and v[0] >= w[0] and v[1] >= w[1] and v != w for v in want)}
        far = [(max([b for b, _, m in got if i in m], default=0), max([a for _, a, m in got if i in m], default=0)) for i in range(n)]
        assert far == list(zip(*(x.tolist() for x in suffix.reach(lefts, rights, [1] * n, 10))))
        for back, ahead, members in got:
            shared = {(lefts[m][len(lefts[m]) - back :], rights[m][:ahead]) for m in members}
            assert len(shared) == 1 and len(members) > 1 and back + ahead >= 10


def test_all_occurrences_of_a_repeat(spark):
    rng = random.Random(4)
    p = "".join(rng.choices("abcdefgh", k=60))
    docs = spark.createDataFrame([(i, "".join(rng.choices("abcdefgh", k=20 + i)) + p + "".join(rng.choices("abcdefgh", k=30))) for i in range(6)], "doc_id long, text string")
    got = suffix.repeats(docs, size=40).groupBy("repeat_id", "n_bytes").agg(F.countDistinct("_a").alias("n")).collect()
    assert max(r.n for r in got) == 6 and all(r.n_bytes >= 40 for r in got)


def test_slices_join(spark, monkeypatch):
    rng = random.Random(6)
    data = bytes(rng.choices(b"abc", k=5000))
    whole = suffix.anchors([data], 40, 20)[0][0]
    parts = [np.unique(np.concatenate([suffix.anchors([data[a : a + 700 + 39]], 40, 20)[0][0] + a for a in range(0, 4961, 700)]))]
    assert (whole == parts[0]).all()


@pytest.mark.parametrize("step", [64, 700])
def test_long_texts_lose_nothing_at_slice_borders(spark, monkeypatch, step):
    monkeypatch.setattr(suffix, "SLICE", step)
    rng = random.Random(8)
    make = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage, twice = make(90), make(1500)
    rows = [make(5000), make(700 * 3 + 10) + passage + make(680) + passage, twice, twice, "q" * 900, make(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(2, twice)], "doc_id long, text string").coalesce(1)
    got = suffix.without_repeats(df, size=40).select("doc_id", "cut.*").collect()
    want = removed([*rows, twice], 40)
    assert want[0][1] == 0 and want[1][1] >= 180
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((i, *w) for i, w in zip([0, 1, 2, 3, 4, 5, 2], want))


def test_empty_table(spark):
    assert suffix.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_planted_passages_are_read_from_the_text_that_is_left(spark, tmp_path):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(n))
    rows = []  # (text, what is left)
    for n in (39, 51, 60, 90):  # 389, 509, 599 and 899 bytes; the contract cuts from 400 bytes on
        passage = "|" + words(n) + "|"
        for k in "01":  # neighbours that differ
            before, after = words(rng.randint(0, 60)) + k, k + words(30)
            rows.append((before + passage + after, before + passage * (n == 39) + after))
    rows += [(text, text) for text in (words(rng.randint(0, 120)) for _ in range(12))]
    spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op7_suffix_array"](spark, str(tmp_path)).collect()}
    for i, (text, left) in enumerate(rows):
        assert got[i].text == left and got[i].n_bytes == len(text) and got[i].n_removed == len(text) - len(left)
        assert got[i].kept_sha256 == hashlib.sha256(left.encode()).hexdigest()
