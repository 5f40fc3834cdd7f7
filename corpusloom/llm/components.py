"""Groups of linked records: connected components by alternating stars.

Each round sends every larger neighbour of a record, then every smaller one, to the smallest record in
its neighbourhood, until nothing changes; the number of rounds grows with the logarithm of the longest
chain. Rounds are joins and grouped minima over written tables: no neighbourhood is ever held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges: (u, v) both ways. One star step; (u, v) with u the larger end."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if larger:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b); component is the smallest id in it. Links of an id to itself give it a component of its own."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sign = None
    while True:
        edges = written(_star(written(_star(edges, True), "large"), False), "small")
        now = edges.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
        if sign == now:
            break
        sign = now
    root = edges.groupBy("u").agg(F.min("v").alias("component"))
    return ids.join(root, ids.id == root.u, "left").select("id", F.coalesce("component", "id").alias("component"))
