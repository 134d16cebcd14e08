"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of top lists.

All vectors lie in shards of ``SHARD`` rows, the queries in tiles of ``TILE`` rows, each one matrix. Every
(tile, shard) cell is one matrix product and yields at most k rows for each query; lists of ``FAN`` shards
merge into one, level by level, so no task ever holds more than ``FAN`` lists of a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

SHARD = 4096
TILE = 512
PER_CELL = 16  # tiles that one task meets a shard with
FAN = 16
EXACT = 2**50  # up to here doubles add whole numbers exactly and a score and a place fit one 64-bit number
LEAST, MOST = -(2**63), 2**63 - 1

BLOCKS = "block long, dim int, ids binary, matrix binary"


def _blocks(size: int):
    """Rows of (vec_id, vector) in matrices of one dimension and at most ``size`` rows, in order of id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 32

        def block(dim, rows):
            nonlocal number
            rows.sort(key=lambda r: r[0])
            number += 1
            ids, vectors = np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], float).reshape(len(rows), dim)
            return pd.DataFrame([(number, dim, ids.tobytes(), np.nan_to_num(np.floor(256 * vectors)).tobytes())], columns=["block", "dim", "ids", "matrix"])

        for pdf in batches:
            for i, v in zip(pdf["vec_id"].tolist(), pdf["vector"], strict=True):
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == size:
                    yield block(len(v), held.pop(len(v)))
        for dim, rows in held.items():
            yield block(dim, rows)

    return run


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of the k best rows of each query by inner product, ties to the smaller id.

    ``ids`` rise. A row with the query's id is left out. Sums beyond 64 bits count as the largest or smallest long.
    """
    if len(rows) == 0:
        return []
    with np.errstate(over="ignore"):
        bound = rows.shape[1] * np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0)
    if bound < EXACT:
        # One number for score and place: larger is better, no two are equal.
        score = (queries @ rows.T).astype(np.int64)
        place = np.arange(len(ids), dtype=np.int64)
        joint = (score << 12) | (SHARD - 1 - place)
        joint[query_ids[:, None] == ids[None, :]] = LEAST
        n = min(k, len(ids))
        top = np.argpartition(joint, len(ids) - n, axis=1)[:, len(ids) - n :]
        values = np.take_along_axis(joint, top, axis=1)
        q, c = np.nonzero(values != LEAST)
        at = top[q, c]
        return list(zip(query_ids[q].tolist(), ids[at].tolist(), score[q, at].tolist(), strict=True))
    exact = [[int(x) for x in r] for r in rows]
    out = []
    for q, own in zip(queries, query_ids.tolist(), strict=True):
        q = [int(x) for x in q]
        score = lambda r: min(MOST, max(LEAST, sum(a * b for a, b in zip(q, r, strict=True))))  # noqa: B023, E731
        found = sorted((-score(r), i) for r, i in zip(exact, ids.tolist(), strict=True) if i != own)
        out += [(own, i, -s) for s, i in found[:k]]
    return out


def _cell(k: int):
    def run(shards: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in tiles.itertuples(index=False):
            for s in shards[shards["dim"] == t.dim].itertuples(index=False):
                q, r = (np.frombuffer(x.ids, "<i8") for x in (t, s))
                a, b = (np.frombuffer(x.matrix, float).reshape(len(n), t.dim) for x, n in ((t, q), (s, r)))
                out += [(*x, s.shard) for x in best(a, q, b, r, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "shard"])

    return run


def _merge(k: int) -> Column:
    """The k best of several lists of (worse, vec_id, score)."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("top")))), 1, k).alias("top")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``, by the inner product of
    floor(256 x); rank from 1, ties to the smaller id, the query's own id left out.

    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part.
    Vectors meet only those of their own length. Rows with equal ids are one query, and equal
    (id, score) count once. Other columns are not read.
    """

    def valid(df: DataFrame) -> DataFrame:
        fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return df.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & fine).select(
            F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
        )

    def dealt(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        df = materialize(valid(df), name)
        n = max(1, -(-df.count() // size))
        return materialize(df.repartition(n, "vec_id").mapInPandas(_blocks(size), BLOCKS), name).withColumn("part", F.shiftright("block", 32)), n

    tiles, n_tiles = dealt(queries, TILE, "tiles")
    shards, n = dealt(vectors, SHARD, "shards")
    # A cell is a shard and ``PER_CELL`` tiles: shards are copied once for each such set, tiles once for each shard.
    left = shards.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit((n_tiles - 1) // PER_CELL)))).withColumn("shard", F.col("part").cast("int"))
    right = tiles.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("set", F.floor(F.col("part") / PER_CELL).cast("int"))
    lists = left.groupBy("shard", "set").cogroup(right.groupBy("shard", "set")).applyInPandas(_cell(k), "query_id long, vec_id long, score long, shard int")
    order = F.struct((-F.col("score").cast("decimal(20,0)")).alias("worse"), "vec_id", "score")
    n = -(-n // FAN)
    lists = lists.groupBy("query_id", F.pmod("shard", F.lit(n)).alias("g")).agg(F.slice(F.array_sort(F.array_distinct(F.collect_list(order))), 1, k).alias("top"))
    while n > 1:
        n = -(-n // FAN)
        lists = lists.groupBy("query_id", F.pmod("g", F.lit(n)).alias("g")).agg(_merge(k))
    return lists.select("query_id", F.posexplode("top").alias("rank", "t")).select("query_id", (F.col("rank") + 1).alias("rank"), "t.vec_id", "t.score")
