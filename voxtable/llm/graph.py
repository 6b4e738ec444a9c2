"""Connected components by contraction, in joins and aggregations only."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a long, b long) with the smallest node it can reach.

    In each round every node points to the neighbour (or itself) that comes first in an order which changes with the
    round, and the graph shrinks to what is pointed to; a path shrinks by a constant share a round, a star at once.
    Minima combine before the shuffle, so hubs cost no more than their edges.  No edges: no rows.
    """
    live = settle(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    steps: list[DataFrame] = []
    for i in count():  # each round joins at least two nodes of every part that is left
        if live.isEmpty():
            break
        seed = F.lit((0x5851F42D4C957F2D * (i + 1)) % 2**62)
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(seed)).alias("m"))
        steps.append(settle(near.select(F.col("a").alias("node"), F.least("m", F.col("a").bitwiseXOR(seed)).bitwiseXOR(seed).alias("to"))))
        left, right = steps[-1].toDF("a", "ta"), steps[-1].toDF("b", "tb")
        after = settle(live.join(left, "a").join(right, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct())
        drop_settled(live)
        live = after
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    at = steps[0]
    for step in steps[1:]:
        at = at.join(step.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    at = settle(at)
    return at.join(at.groupBy("to").agg(F.min("node").alias("root")), "to").select("node", "root")
