"""Connected components by contraction, all in Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    ``links`` has the columns ``a`` and ``b`` (long); direction, repeats and self links do not matter.
    Each round hooks every node with a smaller neighbour onto the smallest one, shortens the hooks
    to their ends by pointer jumping, and replaces the links by links between ends. Every component
    with links left loses nodes each round, chains shorten by halves, and the rows never exceed the
    links given. Joins are plain equi-joins of written tables, so AQE splits a hot node.
    """
    a, b = F.col("a"), F.col("b")
    links = materialize(
        links.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links"
    )
    parents = None
    while not links.isEmpty():
        hook = _ends(links.groupBy(b.alias("node")).agg(F.min("a").alias("up")))
        moved = hook if parents is None else parents.join(
            hook.select(F.col("node").alias("up"), F.col("up").alias("end")), "up", "left"
        ).select("node", F.coalesce("end", "up").alias("up")).unionByName(hook)
        parents = materialize(moved, "parents")
        for side in ("a", "b"):
            links = links.join(hook.withColumnRenamed("node", side), side, "left").withColumn(
                side, F.coalesce("up", side)
            ).drop("up")
        links = materialize(
            links.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links"
        )
    if parents is None:
        return links.select(a.alias("node"), b.alias("root"))
    return parents.withColumnRenamed("up", "root")


def _ends(hook: DataFrame) -> DataFrame:
    """Follow (node, up) to the last node, doubling the step each time."""
    hook = materialize(hook, "hook")
    while True:
        further = hook.select(F.col("node").alias("up"), F.col("up").alias("end"))
        jumped = materialize(
            hook.join(further, "up", "left").select("node", F.coalesce("end", "up").alias("up"), F.col("end").isNotNull().alias("moved")),
            "hook",
        )
        hook = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return hook
