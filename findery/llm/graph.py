"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds after which an error is raised; the algorithm needs about log2 of the longest path.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    Nodes are longs. Null ends and loops are ignored; repeated and reversed edges count once.
    An empty edge table gives an empty result. No list of neighbours is ever built: each step is
    a partial ``min`` per node and an equi-join whose large side AQE can split, and each round
    ends in a table in the shared folder, so lineage stays short.
    """
    e = edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v"))
    e = materialize(e.where("u is not null and v is not null and u <> v").distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == state or not now.n:
            break
        state = (now.n, now.h)
        e = materialize(_small_star(_large_star(e)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is tied to the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
