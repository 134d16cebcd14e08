"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at most
three bits, one segment differs in at most one bit, so both have an equal variant of that segment with
one bit struck out. Each distinct fingerprint is indexed under its 64 variants; an equality match on
(segment, struck bit, other bits) yields the candidates, and the exact distance decides.

* Copies are one fingerprint before anything is indexed.
* A pair has one home: equal segments meet at bit 0 of that segment only, others at their differing bit.
* A bucket never emits its pairs: it is searched breadth-first and yields the links of a spanning
  forest, which has the same components. Buckets over ``HOT`` are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.session import materialize

MAX_BITS = 3
SHINGLE = 3
HOT = 4096  # members of a bucket that one task compares; more are dealt out in blocks of this size
SMALL = 32  # up to here all buckets of a batch are compared together
LINKS = "a long, b long, bucket long"


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of the shingles of whole ``text`` as a signed 64-bit number; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = words[at : at + (1 << 16) + width - 1]
        shingles = [b" ".join(part)] if n == 1 else map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``docs`` with a long column ``fp``; null and empty texts have 0. Bytes A-Z are lower-cased, words are
    runs without ASCII white space, repeats of shingles count."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.withColumn("fp", fp(F.col(text)))


def variants(distinct: DataFrame) -> DataFrame:
    """(bucket, fp): the 64 one-wildcard variants of each fingerprint; bucket = segment, bit, other bits."""
    seg = "shiftrightunsigned(fp, 32 * (v div 32)) & 4294967295"
    return distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).selectExpr(
        f"shiftleft(cast(v as bigint), 32) | (({seg}) & ~shiftleft(1L, v % 32)) as bucket", "fp"
    )


def _allowed(bucket, x, y):
    """Is this bucket the home of the pair, and are they near enough?"""
    v = bucket >> np.uint64(32)
    diff = x ^ y
    apart = diff >> v & np.uint64(1)  # bit v % 32 of segment v // 32 is bit v of the fingerprint
    same = (diff >> (v & np.uint64(32)) & np.uint64(0xFFFFFFFF)) == 0
    home = (apart == 1) | same & (v & np.uint64(31) == 0)
    return home & (np.bitwise_count(diff) <= MAX_BITS)


def forest(bucket: int, xs: np.ndarray, ys: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of ``xs`` (of pairs inside it), or of xs + ys with pairs across only."""
    key = np.uint64(bucket)
    if ys is None:
        left, out, todo = xs, [], []
        while todo or len(left):
            if not todo:
                todo, left = [left[0]], left[1:]
            x = todo.pop()
            near = _allowed(key, x, left)
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                todo += list(found)
                left = left[~near]
        return out
    out, rest, todo = [], [xs, ys], []
    while todo or (len(rest[0]) and len(rest[1])):
        if not todo:
            todo, rest[0] = [(0, rest[0][0])], rest[0][1:]
        side, x = todo.pop()
        other = rest[1 - side]
        near = _allowed(key, x, other)
        if near.any():
            found = other[near]
            out += [(int(x), int(y)) for y in found]
            todo += [(1 - side, y) for y in found]
            rest[1 - side] = other[~near]
    return out


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _scan(hot: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches sorted by bucket: small buckets together, middle ones singly, rows of hot ones passed on."""
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)  # the open bucket
        gone, open_key = 0, None  # rows of it passed on already, where it is hot

        def close(keys, fps):
            out = []
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[cuts, len(keys)])
            u = keys.view(np.uint64)
            for d in range(1, min(SMALL, int(sizes.max(initial=1)))):
                i = np.flatnonzero((keys[d:] == keys[:-d]) & (np.repeat(sizes, sizes)[d:] <= SMALL))
                i = i[_allowed(u[i], fps[i], fps[i + d])]
                out.append(np.stack([fps[i], fps[i + d]], 1))
            for c, n in zip(cuts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
                if found := forest(int(u[c]), fps[c : c + n]):
                    out.append(np.array(found, np.uint64))
            links = np.concatenate([*out, np.empty((0, 2), np.uint64)])
            return pd.DataFrame({"a": _signed(links[:, 0].copy()), "b": _signed(links[:, 1].copy()), "bucket": pd.array([None] * len(links), "Int64")})

        def passed(key, fps, first=0):
            return pd.DataFrame({"a": _signed(fps), "b": np.arange(first, first + len(fps)), "bucket": pd.array(np.full(len(fps), key), "Int64")})

        for pdf in batches:
            new_keys, new_fps = pdf["bucket"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64)
            if gone:
                cut = int((new_keys == open_key).sum())
                yield passed(open_key, new_fps[:cut], gone)
                gone = gone + cut if cut == len(new_keys) else 0
                new_keys, new_fps = new_keys[cut:], new_fps[cut:]
            if not len(new_keys):
                continue
            keys, fps = np.r_[keys, new_keys], np.r_[fps, new_fps]
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                whole = _without_hot(keys[:last], hot)
                yield close(keys[:last][whole], fps[:last][whole])
                for key in np.unique(keys[:last][~whole]):
                    yield passed(key, fps[:last][keys[:last] == key])
                keys, fps = keys[last:], fps[last:]
            if len(keys) > hot:
                gone, open_key = len(fps), keys[0]
                yield passed(open_key, fps)
                keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        if len(keys):
            yield close(keys, fps)

    return run


def _without_hot(keys: np.ndarray, hot: int) -> np.ndarray:
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[cuts, len(keys)])
    return np.repeat(sizes <= hot, sizes)


def _block_pair(pdf: pd.DataFrame) -> pd.DataFrame:
    bucket, i, j = int(pdf["bucket"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    rows, block = pdf["a"].to_numpy(np.int64).view(np.uint64), pdf["block"].to_numpy()
    found = forest(bucket, rows) if i == j else forest(bucket, rows[block == i], rows[block == j])
    links = np.array(found, np.uint64).reshape(-1, 2)
    return pd.DataFrame({"a": _signed(links[:, 0].copy()), "b": _signed(links[:, 1].copy())})


def near_links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) between distinct fingerprints within three bits, enough to span every component."""
    found = materialize(
        variants(distinct).repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_scan(hot), LINKS), "scan"
    )
    links = found.filter("bucket is null").select("a", "b")
    members = found.filter("bucket is not null").withColumn("block", (F.col("b") / hot).cast("long"))
    if members.isEmpty():
        return links
    blocks = members.groupBy("bucket").agg((F.max("block") + 1).alias("n"))
    dealt = (
        members.join(blocks, "bucket")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    )
    return links.unionByName(dealt.groupBy("bucket", "i", "j").applyInPandas(_block_pair, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """(id, fp, component_id): ``component_id`` is the smallest id reachable over links of at most three bits.

    Null and empty texts share fingerprint 0 and are linked like any other. Rows with a null id are left out
    (they cannot be named); repeated ids give one row each. Other columns of ``docs`` are not read.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    prints = materialize(fingerprints(rows, "_text", width).select("_id", "fp"), "prints")
    least = materialize(prints.groupBy("fp").agg(F.min("_id").alias("first")), "least")
    roots = components(near_links(least.select("fp"), hot))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(materialize(named, "named"), "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate group; all columns stay."""
    first = near_duplicates(docs, id_col, text).filter(F.col("component_id") == F.col(id_col)).select(id_col).distinct()
    return docs.join(first, id_col, "left_semi")
