import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(level, fanout):
    """Root and the steps of each digest."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // fanout * fanout : a // fanout * fanout + fanout]
            paths[i].append("".join(":" if j == a % fanout else x for j, x in enumerate(run)))
        at = [a // fanout for a in at]
        level = [h("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def plain(rows, fanout):
    """{(id, leaf): [(subroot, root, path), ...]} of (id, group, leaf)."""
    groups = defaultdict(list)
    for i, g, leaf in rows:
        groups[g].append((i is not None, i or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = {g: tree([r[2] for r in sorted(groups[g])], fanout) for g in names}
    root, over = tree([done[g][0] for g in names], fanout)
    out = []
    for g, upper in zip(names, over):
        for r, path in zip(sorted(groups[g]), done[g][1]):
            out.append((r[1] if r[0] else None, r[2], done[g][0], root, path + upper))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("fanout, block", [(2, 2), (2, 8), (3, 9), (5, 25), (2, 512)])
def test_against_plain_tree(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(fanout * block)
    rows = []
    for g, n in [("a", 1), ("b", 2), ("ü", 3), (None, 5), ("𝒳", block), ("", block + 1), ("hot", 137)]:
        for _ in range(n):
            i = rng.choice([None, *range(300)])
            rows.append((i, g, h(f"{i}{g}{rng.randint(0, 3)}")))
    df = spark.createDataFrame([(*r, 1, 2**60 + 1) for r in rows], "doc_id long, lang string, leaf string, node int, big long")
    out = merkle.manifest(df, "lang", "doc_id", fanout).withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, list(r.path)) for r in out), key=key) == sorted(plain(rows, fanout), key=key)
    assert all(r.folded == r.root and r.big == 2**60 + 1 for r in out)


def test_many_rounds(spark, monkeypatch):
    """Thirteen rounds for 4500 blocks: the plan grows with the rounds, not as a power of them (F2)."""
    monkeypatch.setattr(merkle, "BLOCK", 2)
    rows = [(i, "big" if i else "one", h(str(i))) for i in range(9001)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").repartition(4)
    out = merkle.manifest(df, "lang", "doc_id").collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, list(r.path)) for r in out), key=key) == sorted(plain(rows, 2), key=key)


@pytest.mark.parametrize("fanout", [2, 3])
def test_power_is_one_branch_a_round(spark, fanout):
    got = spark.range(1, 2000).select("id", merkle._power(F.col("id"), 20, fanout).alias("p")).collect()
    assert all(r.p >= r.id and (r.p == 1 or r.p // fanout < r.id) and fanout ** round(math.log(r.p, fanout)) == r.p for r in got)


def test_query_on_nulls_and_tampering(spark, tmp_path):
    from tidemark.llm.queries import op13

    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "é\n"]), rng.choice([None, "en"]), rng.choice([None, "s"]), rng.choice([None, 0, -5, 12])) for _ in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))

    def digest(r, more=0):
        i, text, lang, source, n = r
        cells = [i, source, lang, None if n is None else n + more, text]
        return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in cells))

    want = plain([(r[0], r[2], digest(r)) for r in rows], 2)
    got = op13(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got), key=key) == sorted(((*w[:4], h("".join(w[4]).replace(":", ""))) for w in want), key=key)
    touched = {digest(r): digest(r, 1) for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    paths = {(w[0], w[1]): {tuple(x[4]) for x in want if x[:2] == w[:2]} for w in want}
    for r in got:
        ends = set()
        for path in paths[r.doc_id, r.leaf]:
            end = touched.get(r.leaf, r.leaf)
            for step in path:
                end = h(step.replace(":", end))
            ends.add(end)
        assert r.folded_root in ends and r.verified == (r.folded_root == r.root) == (touched.get(r.leaf, r.leaf) == r.leaf)
    assert not all(r.verified for r in got)


def test_empty_table_and_reserved_names(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, leaf string")
    assert merkle.manifest(df, "lang", "doc_id").collect() == []
    with pytest.raises(ValueError, match="root"):
        merkle.manifest(df.withColumn("root", F.lit(1)), "lang", "doc_id")
