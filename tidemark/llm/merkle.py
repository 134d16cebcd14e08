"""Merkle manifest of a dataset by a butterfly exchange between blocks of leaves.

Leaves of a group stand in order and lie in aligned blocks of a power of ``fanout`` leaves. A block hashes its own subtree.
Then the blocks swap roots round by round: in round r each takes one node from the ``fanout`` blocks that differ from it in
digit r of their numbers, keeps the others as siblings and hashes the parent itself, as do all blocks below that parent.
After the last round every block has the root and the upper part of all its proofs; nothing goes down the tree.
Numbers up to the next power of ``fanout`` are blocks without leaves that take part, so every
exchange has ``fanout`` messages, also at a ragged end.

A step of a proof is a text: the run's digests joined, with ":" in place of the own one. The roots of the groups are
leaves of one more tree of the same kind.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.order import placed
from tidemark.session import materialize

FANOUT = 2
BLOCK = 512  # leaves in a block, at most
OWN = ":"
CUT = 8  # rounds between written tables


def value(x: Column) -> Column:
    """A value as bytes that no other value shares: its UTF-8 length and itself; ``-`` for null."""
    text = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """Digest of a row."""
    return F.sha2(F.concat(*map(value, fields)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda own, step: F.sha2(F.replace(step, F.lit(OWN), own), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.replace(F.array_join(path, ""), F.lit(OWN), F.lit("")), 256)


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def grow(level: list[str], levels: int | None, fanout: int, paths: bool = False) -> tuple[str, list[list[str]]]:
    """Root of some digests in order, after ``levels`` levels or (None) when one is left, and the steps of each."""
    steps: list[list[str]] = [[] for _ in level] if paths else []
    width, done = 1, 0
    while len(level) > 1 if levels is None else done < levels:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        if paths:
            shown = ["".join([*run[:i], OWN, *run[i + 1 :]]) for run in runs for i in range(len(run))]
            for i, own in enumerate(steps):
                own.append(shown[i // width])
        level = [_h("".join(run)) for run in runs]
        width, done = width * fanout, done + 1
    return level[0], steps


def _levels(fanout: int) -> int:
    k = 1
    while fanout ** (k + 1) <= BLOCK:
        k += 1
    return k


def _own_levels(leaves: pa.Table, inner: int, fanout: int) -> int | None:
    """A group of one block is done when one node is left; else every block is as high as a full one."""
    return None if leaves["_rows"][0].as_py() <= fanout**inner else inner


def masked(own: Column):
    return lambda x: F.when(x["_digit"] == own, F.lit(OWN)).otherwise(x["_node"])


def _power(n: Column, rounds: int, fanout: int) -> Column:
    """The least power of ``fanout`` that ``n`` does not exceed, one branch a round: nested in each other, branches would treble each round."""
    out = F.lit(fanout**rounds).cast("long")
    return F.coalesce(*(F.when(n <= fanout**r, F.lit(fanout**r).cast("long")) for r in range(rounds)), out)


def _exchanged(blocks: DataFrame, fanout: int) -> DataFrame:
    """(_g, _block, _node, _upper): every block with its group's root and the steps from its own node to that."""
    n = F.col("_blocks")
    last = blocks.agg(F.max("_blocks")).first()[0] or 0  # one number
    rounds = 0
    while fanout**rounds < last:
        rounds += 1
    # Block b also stands for b + n, b + 2 n, ... below the power of fanout that n does not exceed.
    state = blocks.withColumn("_power", _power(n, rounds, fanout)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1)))).withColumn("_to", F.col("_block") + F.col("_i") * n)
    state = state.filter("_to < _power").select(
        "_g", F.col("_to").alias("_block"), "_blocks", F.when(F.col("_i") == 0, F.col("_node")).alias("_node"), F.array().cast("array<string>").alias("_upper")
    )
    for r in range(rounds):
        step = F.lit(fanout**r).cast("long")
        digit = F.pmod(F.floor(F.col("_block") / step), F.lit(fanout)).cast("int")
        active = step < n
        sent = state.withColumn("_digit", digit).withColumn("_d", F.explode(F.when(active, F.sequence(F.lit(0), F.lit(fanout - 1))).otherwise(F.array("_digit"))))
        own = F.col("_d") == F.col("_digit")
        got = sent.groupBy("_g", (F.col("_block") + (F.col("_d") - F.col("_digit")) * step).alias("_block"), "_blocks").agg(
            F.array_sort(F.collect_list(F.struct("_digit", "_node"))).alias("_sent"), F.max(F.when(own, F.col("_upper"))).alias("_upper")
        )
        nodes = F.filter("_sent", lambda x: x["_node"].isNotNull())
        joined = F.array_join(F.transform(nodes, lambda x: x["_node"]), "")
        step_text = F.array_join(F.transform(nodes, masked(digit)), "")
        state = got.select(
            "_g", "_block", "_blocks",
            F.when(~active, F.get("_sent", F.lit(0))["_node"]).when(F.size(nodes) > 0, F.sha2(joined, 256)).alias("_node"),
            F.when(active, F.concat("_upper", F.array(step_text))).otherwise(F.col("_upper")).alias("_upper"),
        )
        if r % CUT == CUT - 1:
            state = materialize(state, "exchange")
    return state.filter("_block < _blocks").select("_g", "_block", "_node", "_upper")


def _tree(leaves: DataFrame, order: list[str], fanout: int, more: DataFrame | None = None):
    """Table of the groups' roots (_g, _node), and a function from further steps of the groups (_g, _root, _more) to ``leaves`` with
    ``subroot``, ``root`` and ``path``.

    ``leaves`` is a written table with ``_g`` (no nulls) and ``leaf``."""
    inner = _levels(fanout)
    size = fanout**inner
    line = placed(leaves, ["_g"], [F.asc_nulls_first(c) for c in order])
    line = materialize(line.withColumn("_block", F.floor(F.col("_at") / size)).withColumn("_blocks", F.ceil(F.col("_rows") / size)), "leaves")

    def root(t: pa.Table) -> pa.Table:
        digests = t.sort_by("_at")["leaf"].to_pylist()
        node, _ = grow(digests, _own_levels(t, inner, fanout), fanout)
        return pa.table({c: t[c][:1] for c in ("_g", "_block", "_blocks")} | {"_node": pa.array([node], pa.string())})

    blocks = line.select("_g", "_block", "_blocks", "_rows", "_at", "leaf").groupBy("_g", "_block").applyInArrow(root, "_g string, _block long, _blocks long, _node string")
    state = materialize(_exchanged(materialize(blocks, "blocks"), fanout), "upper")

    def proofs(further: DataFrame | None) -> DataFrame:
        top = state.withColumnRenamed("_node", "_subroot")
        if further is None:
            top = top.withColumn("_root", F.col("_subroot"))
        else:
            top = top.join(further, "_g").withColumn("_upper", F.concat("_upper", "_more")).drop("_more")
        names = [c for c in leaves.columns if c != "_g"]
        schema = ", ".join(f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in names)

        def block(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.sort_by("_at")
            _, steps = grow(left["leaf"].to_pylist(), _own_levels(left, inner, fanout), fanout, paths=True)
            upper = right["_upper"][0].as_py()
            out = {c: left[c] for c in names}
            for new, c in (("subroot", "_subroot"), ("root", "_root")):
                out[new] = pa.array([right[c][0].as_py()] * len(left), pa.string())
            out["path"] = pa.array([s + upper for s in steps], pa.list_(pa.string()))
            return pa.table(out)

        return line.groupBy("_g", "_block").cogroup(top.groupBy("_g", "_block")).applyInArrow(block, f"{schema}, subroot string, root string, path array<string>")

    return state.filter("_block = 0").select("_g", "_node"), proofs


def manifest(leaves: DataFrame, group: str, order: str, fanout: int = FANOUT) -> DataFrame:
    """``leaves`` with ``subroot`` (of its group), ``root`` (of all groups) and ``path`` (steps from leaf to root).

    ``leaves`` has a column ``leaf`` (digest of each row) and keeps its other columns; those named subroot, root or path, or
    with a leading ``_``, are an error. In a group leaves stand by ``order``, nulls first, ties by leaf (rows equal in
    both are interchangeable). Groups stand by their text, null first. A group of one leaf is that leaf; an empty table
    has no tree.
    """
    clash = [c for c in leaves.columns if c in ("subroot", "root", "path") or c.startswith("_")]
    if clash:
        raise ValueError(f"reserved column names: {clash}")
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # null first
    table = materialize(leaves.withColumn("_g", name).withColumn("_tie", F.rand(13)), "leaves")
    tops, proofs = _tree(table, [order, "leaf", "_tie"], fanout)
    tops = materialize(tops.select(F.lit("").alias("_g"), F.col("_g").alias("name"), F.col("_node").alias("leaf")), "tops")
    _, over = _tree(tops, ["name"], fanout)
    further = over(None).select(F.col("name").alias("_g"), F.col("root").alias("_root"), F.col("path").alias("_more"))
    return proofs(further).drop("_tie")
