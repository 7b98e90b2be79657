"""Connected components of a graph given as pairs, by repeated smallest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnloom.sources.sinks import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) for every node of an edge; loops are allowed.

    Each round links the larger neighbours of every node to its smallest neighbour, then the smaller
    ones (alternating large and small stars), so long chains halve and no node gathers its
    neighbours: both steps are sums per node and joins on edges, which Spark splits where a node has
    very many. Rounds end when the edges no longer change; each round is written before the next.
    """
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    both = written(both, "edges")
    before = None
    while True:
        large = _star(both.select("u", "v").unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))),
                      larger=True)
        small = written(_star(large, larger=False), "edges")
        mark = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        both = small
        if tuple(mark) == before:
            break
        before = tuple(mark)
    nodes = both.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = both.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours of u to the smallest of u and its neighbours; pairs are (u, v).

    ``larger``: only neighbours above u move (v > u); otherwise u has only smaller neighbours.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least, "u")
    if larger:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()
