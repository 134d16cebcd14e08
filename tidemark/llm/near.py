"""Near copies by SimHash and by the similarity of their shingle sets, with none left out.

Two texts are linked if the Jaccard similarity of their sets of ``width``-word shingles is at least ``percent``
hundredths; a group is whatever links reach. SimHash comes first: fingerprints of the same shingles within three bits meet by
deletion variants (``simhash.near_links``), and the sets decide. Fingerprints of 64 bits cannot find all pairs: at similarity 0.8
they differ by about ten bits, and segments short enough for that put nearly every pair into one bucket. So what SimHash has not
joined is completed from the sets: with all shingles in one order, two sets that similar share one among the first
``n - ceil(percent n / 100) + 1`` of each, and at the first one shared enough must be left on both sides.

* Any order is right. Shingles often seen in a sample of the texts come last, the others by their hash.
* Equal texts are one node, and so are all texts without words.
* First each member of a bucket is compared with the bucket's first one, and the components are formed. Only
  pairs of different components are compared afterwards, so a large group of near copies is not squared.
* Most candidates are far apart. Parities of the shingles by their lowest bits, about a bit and a half for a shingle, bound from below how many
  shingles two sets do not share; whole sets go out only for pairs that this bound leaves.
* What decides is always the number of shingles shared, from whole texts. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.simhash import fingerprints, near_links
from tidemark.session import materialize, shuffles_dropped

WIDTH = 5
PERCENT = 80
SAMPLE = 16  # one text in so many is read for the order
OFTEN = 3  # texts of the sample from which a shingle comes late in the order
LISTED = 100_000  # shingles that the order knows; of more, the most frequent ones
BLOCK = 2048  # members of a bucket that one task compares; more are dealt out as pairs of blocks
BASE = 0x9E3779B97F4A7C15


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the different shingles, in rising order; a text of fewer words is one shingle. Bytes A-Z are
    lower-cased, words are runs without ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        out += h[i : i + n] * np.uint64(pow(BASE, i + 1, 1 << 64))
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((out ^ (out >> np.uint64(29))).view(np.int64))


def _sets(width: int):
    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width) for t in texts])

    return sets


def _order(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the sample has often, in rising order, and their counts."""
    seen = texts.filter(F.pmod("node", F.lit(SAMPLE)) == 0).select(F.explode(_sets(width)("text")).alias("h"))
    top = seen.groupBy("h").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(LISTED).collect()
    top.sort()
    return np.array([r[0] for r in top], np.int64), np.array([r[1] for r in top], np.int64)


def _prefixes(width: int, percent: int, late: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, nodes, ns = [], [], []
            for node, text in zip(pdf["node"].tolist(), pdf["text"], strict=True):
                h = shingles(text, width)
                n = len(h)
                if len(late) and n:
                    at = np.minimum(np.searchsorted(late, h), len(late) - 1)
                    known = late[at] == h
                    if known.any():
                        h = h[np.lexsort((h, np.where(known, counts[at], 0)))]
                out.append(h[: n - -(-percent * n // 100) + 1])
                nodes.append(node)
                ns.append(n)
            sizes = [len(x) for x in out]
            pos = [np.arange(s) for s in sizes]
            yield pd.DataFrame(
                {
                    "h": np.concatenate([np.empty(0, np.int64), *out]),
                    "node": np.repeat(np.array(nodes, np.int64), sizes),
                    "n": np.repeat(np.array(ns, np.int32), sizes),
                    "pos": np.concatenate([np.empty(0, np.int32), *pos]).astype(np.int32),
                }
            )

    return run


def _near_enough(n, pos, m, at, percent):
    """Can sets of n and m shingles that first meet at these places be as similar as asked?"""
    most = np.minimum(n.astype(np.int64) - pos, m.astype(np.int64) - at)
    return most * (100 + percent) >= percent * (n.astype(np.int64) + m)


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by shingle and node those of shingles in several nodes, with place in the bucket and its first row."""
    last, first, place = None, None, 0  # the open row; first row of its bucket; its place
    for pdf in batches:
        if last is not None:
            pdf = pd.concat([last, pdf], ignore_index=True)
        h, node = pdf["h"].to_numpy(), pdf["node"].to_numpy()
        new = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])]
        pdf = pdf[new].reset_index(drop=True)
        if not len(pdf):
            continue
        h = pdf["h"].to_numpy()
        start = np.r_[True, h[1:] != h[:-1]]
        at = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
        places = np.arange(len(h)) - at
        heads = pdf[["node", "n", "pos"]].iloc[at].set_axis(["lead", "lead_n", "lead_pos"], axis=1).reset_index(drop=True)
        if last is not None and first is not None:
            mine = at == 0
            places[mine] += place
            for c, v in zip(heads.columns, first, strict=True):
                heads.loc[mine, c] = v
        out = pd.concat([pdf, heads], axis=1).assign(place=places)
        # a row alone so far is held back until the next bucket begins
        more = np.r_[~start[1:], False] | (places > 0)
        yield out[more][:-1] if more[-1] else out[more]
        last, first, place = pdf.iloc[[-1]], tuple(heads.iloc[-1]), int(places[-1])
    if last is not None and place > 0:
        head = pd.DataFrame([first], columns=["lead", "lead_n", "lead_pos"])
        yield pd.concat([last.reset_index(drop=True), head], axis=1).assign(place=place)


def _crossing(percent: int):
    def pairs(p: list[np.ndarray]) -> list[np.ndarray]:
        block, i, j, node, n, pos, root = p
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = []
        for x in left:
            y = right[right > x] if i[0] == j[0] else right
            y = y[(root[y] != root[x]) & _near_enough(n[y], pos[y], n[x], pos[x], percent)]
            out.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], 1))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rest = ["h", "i", "j", "block", "node", "n", "pos", "root"], None

        def made(rows):
            key = rows[["h", "i", "j"]].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
            cols = [rows[c].to_numpy() for c in ("block", "i", "j", "node", "n", "pos", "root")]
            out = [np.empty((0, 2), np.int64)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out += pairs([c[a:b] for c in cols])
                if sum(map(len, out)) > 200_000:
                    yield pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])
                    out = [np.empty((0, 2), np.int64)]
            yield pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])

        for pdf in batches:
            rows = pdf[names] if rest is None else pd.concat([rest, pdf[names]], ignore_index=True)
            key = rows[["h", "i", "j"]].to_numpy()
            if not len(rows):
                continue
            open_ = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])[-1])
            yield from made(rows[:open_]) if open_ else ()
            rest = rows[open_:]
        if rest is not None:
            yield from made(rest)

    return run


def parities(h: np.ndarray) -> bytes:
    """For each of 2^k bits, at least as many as there are shingles, whether an odd number of them have it as their lowest k bits."""
    width = max(64, 1 << (max(len(h), 1) - 1).bit_length())
    return np.packbits(np.bincount(h & (width - 1), minlength=width) & 1, bitorder="little").tobytes()


def _apart_at_least(x: bytes, y: bytes) -> int:
    """Shingles that only one of two sets has, at the least: those of both cancel out, each other one turns one bit."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    width = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, width), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def marks(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, bits): number and parities of the shingles of each node."""

    @F.pandas_udf("n long, bits binary")
    def marked(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, width) for t in texts]
        return pd.DataFrame({"n": [len(h) for h in sets], "bits": [parities(h) for h in sets]})

    found = texts.select("node", marked("text").alias("m"))
    return materialize(found.select("node", "m.n", "m.bits").dropDuplicates(["node"]), "marks")


def _possible(percent: int):
    @F.pandas_udf("boolean")
    def possible(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        whole, least = (n + m).to_numpy(), np.minimum(n, m).to_numpy()
        out = least * (100 + percent) >= percent * whole
        for i in np.flatnonzero(out):
            out[i] = (whole[i] - _apart_at_least(x.iat[i], y.iat[i])) * (100 + percent) >= 2 * percent * whole[i]
        return pd.Series(out)

    return possible


def _alike(texts: DataFrame, known: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the ``pairs`` that are as similar as asked. The marks (``known``) leave out those that cannot be, and the whole sets of the rest decide."""
    both = pairs.join(known.toDF("a", "n", "x"), "a").join(known.toDF("b", "m", "y"), "b")
    pairs = materialize(both.filter(_possible(percent)("n", "m", "x", "y")).select("a", "b"), "possible")
    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
    sets = materialize(texts.join(needed, "node").dropDuplicates(["node"]).select("node", _sets(width)("text").alias("s")), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    joint = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", joint.alias("joint"), (F.size("x") + F.size("y")).alias("all"))
    return materialize(both.filter(f"joint * {100 + percent} >= {percent} * all").select("a", "b"), "alike")


def fingerprint_pairs(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(a, b): each node with the first one of its fingerprint, and first ones of fingerprints within three bits, enough to span what these reach."""
    prints = materialize(fingerprints(texts, "text", width).select("node", "fp").distinct(), "prints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    same = prints.join(firsts, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    end = lambda fp, name: firsts.select(F.col("fp").alias(fp), F.col("first").alias(name))
    near = near_links(firsts.select("fp")).toDF("x", "y").join(end("x", "a"), "x").join(end("y", "b"), "y").select("a", "b")
    pairs = same.unionByName(near).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialize(pairs.distinct(), "fingerprint-pairs")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose nodes have different roots."""
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"_{side}"))
    both = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return both.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def groups(texts: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(node, root) for every node of ``texts`` (node, text) that is not the smallest of its group; node 0 has no words."""
    texts = texts.filter("node <> 0")
    marked = marks(texts, width)
    known = _alike(texts, marked, fingerprint_pairs(texts, width), width, percent)
    prefixes = texts.mapInPandas(_prefixes(width, percent, *_order(texts, width)), "h long, node long, n int, pos int")
    shared = materialize(
        prefixes.repartition("h").sortWithinPartitions("h", "node").mapInPandas(
            _shared, "h long, node long, n int, pos int, lead long, lead_n int, lead_pos int, place long"
        ),
        "shared",
    )
    apart = f"least(n - pos, lead_n - lead_pos) * {100 + percent} >= {percent} * (cast(n as bigint) + lead_n)"
    led = shared.filter(f"place > 0 and {apart}").selectExpr("least(node, lead) as a", "greatest(node, lead) as b").distinct()
    led = materialize(_apart(led, components(known)), "led")
    links = materialize(known.unionByName(_alike(texts, marked, led, width, percent)), "near")
    roots = components(links)
    placed = materialize(
        shared.select("h", "node", "n", "pos", (F.col("place") / block).cast("long").alias("block"))
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node")),
        "placed",
    )
    split = materialize(
        placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("block").alias("most")).filter("lo <> hi").select("h", "most"), "split"
    )
    crossing = (
        placed.join(split, "h")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "most")))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .repartition("h", "i", "j")
        .sortWithinPartitions("h", "i", "j")
        .mapInPandas(_crossing(percent), "a long, b long")
        .distinct()
        .join(led, ["a", "b"], "left_anti")
    )
    return components(links.unionByName(_alike(texts, marked, materialize(crossing, "crossing"), width, percent)))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row of each group of near copies, all columns: the least by id (nulls last), then by hashes of text and row.

    Rows with null or repeated ids are rows like any other, and of equal rows one stays. Texts without words are one group.
    """
    worded = F.col(text).rlike(r"[^ \t-\r]")
    rows = docs.withColumns({"_node": F.when(worded, F.xxhash64(text)).otherwise(F.lit(0)), "_row": F.xxhash64(*docs.columns)})
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "_node", "_row")
    with shuffles_dropped(docs.sparkSession):
        roots = groups(rows.select(F.col("_node").alias("node"), F.col(text).alias("text")), width, percent, block)
        small = materialize(rows.groupBy("_node", "_row", id_col).count(), "rows")
        best = (
            small.join(roots.withColumnRenamed("node", "_node"), "_node", "left")
            .groupBy(F.coalesce("root", "_node").alias("root"))
            .agg(F.min(F.struct(order.alias("order"), "count")).alias("best"))
        )
        best = materialize(best.select(F.col("best.order._row").alias("_row"), (F.col("best.count") > 1).alias("_many")), "best")
    kept = rows.join(best, "_row")
    once, many = kept.filter("not _many"), kept.filter("_many").dropDuplicates(["_row"])
    return once.unionByName(many).select(*docs.columns)
