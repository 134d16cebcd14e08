"""Repeated passages through the common-prefix interval tree of enhanced suffix arrays.

Two equal strings of ``size`` bytes hold the same anchor at the same place: of all ``k``-byte strings
inside, the one with the least hash (the last one on ties). So only suffixes at anchors are
sorted, about two in ``size - k``, and only with those of the same anchor string; each such group is an
independent suffix array. An anchor's context reaches ``size - k`` bytes back and ``size`` bytes ahead,
within its document, which holds every window that can have this anchor.

Per group: equal contexts are one suffix with a count; the suffixes are sorted, their common prefixes
stack-scanned into the interval tree, and in each interval the suffixes are ordered by what stands before
the anchor; the same scan over that order gives the runs with a common left side. A run that several
children share (or a context that occurs several times) is a maximal repeat: its members differ on either
side. Every member is reported, neighbours or not.

A group with more than ``HOT`` different contexts is counted window by window instead of sorted
in one task; the covered bytes are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize  # before a join with a hot key both sides are tables, which AQE can split

SIZE = 400
HOT = 20_000  # different contexts of one anchor string that a task sorts
SLICE = 1 << 19  # bytes scanned at once
BASE = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        _POWERS.clear()
        both = (BASE, pow(BASE, -1, 1 << 64))
        _POWERS[n] = tuple(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)].cumprod(dtype=np.uint64) for b in both)
    return _POWERS[n]


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-byte string of ``data`` (uint8) that depends on its bytes only."""
    up, down = _powers(max(SLICE * 2, len(data)))
    codes = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    sums = np.r_[np.uint64(0), (codes[data] * up[: len(data)]).cumsum(dtype=np.uint64)]
    n = len(data) - k + 1
    return _mix((sums[k:] - sums[:n]) * down[:n])


def last_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least value, the last of equals."""
    n = len(h) - width + 1
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    rows = -(-len(h) // width)
    r = np.full((rows, width), top)
    r.reshape(-1)[: len(h)] = h
    place = np.arange(rows * width, dtype=np.int32).reshape(rows, width)
    ahead = np.minimum.accumulate(r, axis=1)
    ahead_at = np.maximum.accumulate(np.where(r == ahead, place, -1), axis=1).reshape(-1)
    back = np.minimum.accumulate(r[:, ::-1], axis=1)[:, ::-1]
    lower = np.ones(r.shape, bool)
    lower[:, :-1] = r[:, :-1] < back[:, 1:]
    back_at = np.minimum.accumulate(np.where(lower, place, np.int32(2**31 - 1))[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    ahead, back = ahead.reshape(-1), back.reshape(-1)
    return np.where(ahead[width - 1 : width - 1 + n] <= back[:n], ahead_at[width - 1 : width - 1 + n], back_at[:n])


def anchors(parts: list[bytes], size: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each part its anchor places and their hashes; parts are scanned together."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    if len(data) < size:
        return [(np.empty(0, np.int64), np.empty(0, np.uint64)) for _ in parts]
    h = rolling(data, k)
    at = last_argmin(h, size - k + 1)
    out, first = [], 0
    for part in parts:
        mine = np.unique(at[first : max(first, first + len(part) - size + 1)])
        out.append((mine - first, h[mine]))
        first += len(part)
    return out


def _anchor_rows(size: int, k: int):
    def flush(todo, out, last):
        """Rows of the slices; ``last`` is the last place in the text of the first one, and returned for the slice after.
        Windows on both sides of a border may choose one anchor: places never fall, so it is the last one again."""
        for (a, b, text, at), (places, keys) in zip(todo, anchors([t[at : at + SLICE + size - 1] for _, _, t, at in todo], size, k), strict=True):
            if at == 0:
                last = -1
            for p, key in zip((places + at).tolist(), keys.view(np.int64).tolist(), strict=True):
                if p <= last:
                    continue
                last = p
                context = text[max(0, p - size + k) : p + size]
                out.append((a, b, p, key, xxhash.xxh3_64_intdigest(context, min(p, size - k))))
        return last

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            todo, held, out, last = [], 0, [], -1
            for a, b, text in zip(pdf["_a"].tolist(), pdf["_b"].tolist(), pdf["_text"], strict=True):
                data = (text or "").encode("utf-8", "replace")
                for at in range(0, max(0, len(data) - size + 1), SLICE):
                    todo.append((a, b, data, at))
                    held += min(SLICE, len(data) - at) + size
                    if held >= SLICE:
                        last = flush(todo, out, last)
                        todo, held = [], 0
                if len(out) > 200_000:
                    yield _rows(out)
                    out = []
            flush(todo, out, last)
            yield _rows(out)

    def _rows(out):
        df = pd.DataFrame(out, columns=["_a", "_b", "pos", "key", "context"])
        return df.assign(context=np.array(df["context"], np.uint64).view(np.int64))

    return run


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    diff = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (diff.bit_length() + 7) // 8


def interval_tree(lcp: list[int]) -> Iterator[tuple[int, int, int, list[int]]]:
    """(common length, first, last, bounds of the children) of each interval, children before parents.

    ``lcp[i]`` belongs to suffixes i - 1 and i; ``lcp[0]`` is not read.
    """
    stack: list[list] = []  # [length, first, starts of children]
    for i in range(1, len(lcp) + 1):
        now, first = (lcp[i], i - 1) if i < len(lcp) else (-1, i - 1)
        while stack and stack[-1][0] > now:
            length, first, starts = stack.pop()
            yield length, first, i - 1, starts
        if now >= 0:
            if stack and stack[-1][0] == now:
                stack[-1][2].append(i)
            else:
                stack.append([now, first, [first, i]])


class Enhanced:
    """Suffix array over the contexts of one anchor, with its interval tree and the order of the left sides."""

    def __init__(self, lefts: list[bytes], rights: list[bytes]):
        n = len(rights)
        order = sorted(range(n), key=rights.__getitem__)
        self.lcp = [0] + [common(rights[order[i - 1]], rights[order[i]]) for i in range(1, n)]
        self.order = np.array(order)
        turned = [x[::-1] for x in lefts]
        by_left = sorted(range(n), key=turned.__getitem__)
        self.rank = np.empty(n, np.int64)
        self.rank[by_left] = np.arange(n)
        self.least = _Least(np.array([0] + [common(turned[by_left[i - 1]], turned[by_left[i]]) for i in range(1, n)]))

    def intervals(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(common length ahead, members by left side, common left lengths of neighbours, child of each member)."""
        for ahead, first, last, starts in interval_tree(self.lcp):
            places = np.arange(first, last + 1)
            ranks = self.rank[self.order[places]]
            by = np.argsort(ranks)
            child = np.searchsorted(np.array(starts), places[by], "right")
            yield ahead, self.order[places[by]], self.least.between(ranks[by][:-1], ranks[by][1:]), child


def maximal_repeats(lefts: list[bytes], rights: list[bytes], counts: list[int], size: int) -> list[tuple[int, int, list[int]]]:
    """(back, ahead, members): strings of ``back`` bytes before and ``ahead`` bytes from the anchor, at least
    ``size`` together, with all contexts that have them, which cannot be extended on either side for all."""
    out = [(len(x), len(y), [i]) for i, (x, y, c) in enumerate(zip(lefts, rights, counts, strict=True)) if c > 1 and len(x) + len(y) >= size]
    if len(rights) == 1:
        return out
    for ahead, members, joint, child in Enhanced(lefts, rights).intervals():
        for back, first, last, _ in interval_tree([0, *joint.tolist()]):
            if back + ahead >= size and (child[first : last + 1] != child[first]).any():  # else a child has it, longer
                out.append((back, ahead, members[first : last + 1].tolist()))
    return out


def reach(lefts: list[bytes], rights: list[bytes], counts: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each context the furthest bytes before and from the anchor that its maximal repeats cover (0, 0: none).

    All of them hold the anchor, so the covered bytes are one span. In an interval a member's longest left
    side is the one it shares with a neighbour.
    """
    n = len(rights)
    back, ahead = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        if counts[i] > 1 and len(lefts[i]) + len(rights[i]) >= size:
            back[i], ahead[i] = len(lefts[i]), len(rights[i])
    if n == 2:
        a, b = common(*rights), common(lefts[0][::-1], lefts[1][::-1])
        if a + b >= size:
            back, ahead = np.maximum(back, b), np.maximum(ahead, a)
    if n > 2:
        for length, members, joint, _ in Enhanced(lefts, rights).intervals():
            left = np.maximum(np.r_[0, joint], np.r_[joint, 0])
            ok = left + length >= size
            np.maximum.at(back, members[ok], left[ok])
            np.maximum.at(ahead, members[ok], length)
    return back, ahead


class _Least:
    """Least value of lcs(i, j], for many pairs at once."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while step * 2 <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        level = np.frexp((j - i).astype(float))[1] - 1
        for v in np.unique(level):
            at = level == v
            out[at] = np.minimum(self.levels[v][i[at] + 1], self.levels[v][j[at] - (1 << int(v)) + 1])
        return out


FOUND = "key long, context long, repeat int, back int, ahead int"


def _group_rows(size: int, groups: bool):
    def one(group):
        key, contexts, counts, lefts, rights = group
        if groups:
            return [(key, contexts[i], n, back, ahead) for n, (back, ahead, members) in enumerate(maximal_repeats(lefts, rights, counts, size)) for i in members]
        return [(key, c, 0, b, a) for c, b, a in zip(contexts, *(x.tolist() for x in reach(lefts, rights, counts, size)), strict=True) if a]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, out = None, []
        for pdf in batches:
            for key, context, count, left, right in zip(*(pdf[c].tolist() for c in ("key", "context", "n", "left", "right")), strict=True):
                if group is None or group[0] != key:
                    if group:
                        out += one(group)
                    group = (key, [], [], [], [])
                if group[1] and group[1][-1] == context:  # of a row that is there twice
                    continue
                for to, x in zip(group[1:], (context, count, left, right), strict=True):
                    to.append(x)
            yield pd.DataFrame(out, columns=["key", "context", "repeat", "back", "ahead"])
            out = []
        if group:
            yield pd.DataFrame(one(group), columns=["key", "context", "repeat", "back", "ahead"])

    return run


def _contexts(size: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, wanted in zip(pdf["_text"], pdf["wanted"], strict=True):
                data = text.encode("utf-8", "replace")
                for w in wanted:
                    p = w["pos"]
                    out.append((w["key"], w["context"], w["n"], w["hot"], data[max(0, p - size + k) : p], data[p : p + size]))
                    if len(out) == 20_000:
                        yield pd.DataFrame(out, columns=["key", "context", "n", "hot", "left", "right"])
                        out = []
            yield pd.DataFrame(out, columns=["key", "context", "n", "hot", "left", "right"])

    return run


def _windows(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, context, n, left, right in zip(*(pdf[c].tolist() for c in ("key", "context", "n", "left", "right")), strict=True):
                data, out = left + right, []
                for back in range(len(left) + 1):
                    window = data[len(left) - back : len(left) - back + size]
                    if len(window) == size:
                        out.append((key, context, n, back, xxhash.xxh3_128_digest(window)))
                yield pd.DataFrame(out, columns=["key", "context", "n", "back", "window"])

    return run


def _identified(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows are told apart by hashes of id and text; equal rows have the same spans anyway."""
    return docs.select(F.xxhash64(id_col).alias("_a"), F.xxhash64(text).alias("_b"), F.col(text).alias("_text"))


def _found(docs: DataFrame, id_col: str, text: str, size: int, hot: int, groups: bool) -> tuple[DataFrame, DataFrame]:
    """All occurrences of anchors that occur more than once, and (key, context, repeat, back, ahead)."""
    k = size // 2
    rows = _identified(docs, id_col, text)
    every = materialize(
        rows.filter(F.length("_text") * 4 >= size).mapInPandas(_anchor_rows(size, k), "_a long, _b long, pos long, key long, context long"), "anchors"
    )
    often = materialize(every.groupBy("key").count().filter("count > 1").select("key"), "often")
    every = materialize(every.join(often, "key"), "repeated")
    kinds = every.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("_a", "_b", "pos")).alias("at"))
    kinds = materialize(kinds.select("key", "context", "n", "at.*"), "contexts")
    crowded = kinds.groupBy("key").count().filter(F.col("count") > hot).select("key", F.lit(True).alias("hot"))
    wanted = (
        kinds.join(crowded, "key", "left")
        .groupBy("_a", "_b")
        .agg(F.collect_list(F.struct("pos", "key", "context", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    )
    contexts = materialize(
        rows.join(wanted, ["_a", "_b"]).mapInPandas(_contexts(size, k), "key long, context long, n long, hot boolean, left binary, right binary"), "bytes"
    )
    found = contexts.filter("not hot").repartition("key").sortWithinPartitions("key", "context").mapInPandas(_group_rows(size, groups), FOUND)
    windows = contexts.filter("hot").drop("hot").dropDuplicates(["key", "context"])
    if not windows.isEmpty():
        windows = materialize(windows.mapInPandas(_windows(size), "key long, context long, n long, back int, window binary"), "windows")
        same = ["key", "back", "window"]  # at the same distance from the anchor, so never a window and itself
        twice = windows.groupBy(same).agg(F.sum("n").alias("all")).filter("all > 1").select(same)
        found = found.unionByName(
            windows.join(twice, same).select("key", "context", F.lit(None).cast("int").alias("repeat"), "back", (F.lit(size) - F.col("back")).alias("ahead"))
        )
    return every, materialize(found, "found")


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, hot: int = HOT) -> DataFrame:
    """Maximal repeat groups with all occurrences: (repeat_id, n_bytes, id hash, text hash, start)."""
    every, found = _found(docs, id_col, text, size, hot, True)
    return every.join(found, ["key", "context"]).select(
        F.xxhash64("key", "repeat", "back", "ahead").alias("repeat_id"),
        (F.col("back") + F.col("ahead")).alias("n_bytes"),
        "_a",
        "_b",
        (F.col("pos") - F.col("back")).alias("start"),
    )


CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _cutter(with_text: bool):
    @F.pandas_udf(CUT)
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, cuts in zip(texts, spans, strict=True):
            data = (text or "").encode("utf-8", "replace")
            kept, at, n = [], 0, 0
            for start, end in merged([] if cuts is None else [(c["start"], c["end"]) for c in cuts]):
                kept.append(data[at:start])
                at, n = end, n + 1
            left = b"".join([*kept, data[at:]])
            out.append((len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return cut


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans, joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """``docs`` with a struct ``cut``: bytes, removed bytes and spans, digest and text of what is left.

    Removed is every byte covered by a string of ``size`` bytes that also starts elsewhere, in this or another
    row. Null texts are empty; rows with null or repeated ids are rows like any other. ``kept_text``
    leaves out the parts of a character cut in two (null without ``with_text``); ``kept_sha256`` is over the exact bytes.
    """
    every, found = _found(docs, id_col, text, size, hot, False)
    reach = materialize(found.groupBy("key", "context").agg(F.max("back").alias("back"), F.max("ahead").alias("ahead")), "reach")
    spans = (
        every.join(reach, ["key", "context"])
        .select("_a", "_b", F.struct((F.col("pos") - F.col("back")).alias("start"), (F.col("pos") + F.col("ahead")).alias("end")).alias("span"))
        .groupBy("_a", "_b")
        .agg(F.collect_set("span").alias("_spans"))
    )
    rows = docs.withColumns({"_a": F.xxhash64(id_col), "_b": F.xxhash64(text)})
    return rows.join(spans, ["_a", "_b"], "left").withColumn("cut", _cutter(with_text)(F.col(text), "_spans")).drop("_a", "_b", "_spans")
