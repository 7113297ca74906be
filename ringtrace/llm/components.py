"""Distributed connected components: alternating large-star and small-star steps.

Every step is a grouped minimum plus an equi-join, so no neighbour list is ever collected, a
node with a third of all edges is split by AQE like any skewed join, and each round is written
to the shared folder.  The rounds grow with the logarithm of the longest path.  Equal ends make the files of
many edges small, so from ``MERGE`` edges on the joins are merges, whatever Spark makes of their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop

MERGE = 100_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected ``edges`` to (node, root): root is the smallest node reachable.

    Edges with a null end and loops are ignored; repeated edges count once; without edges the
    result is empty.  Node ids are of any orderable type.
    """
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    now = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(hi.alias("hi"), lo.alias("lo"))
        .distinct(),
        "edges",
    )
    state = _state(now)
    while state[0]:
        new = cut(_small_star(_large_star(now, state[0] >= MERGE), state[0] >= MERGE), "edges")
        drop(now)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame, merge: bool = False) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    ends = both.where("v > u")
    return (ends.hint("merge") if merge else ends).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame, merge: bool = False) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = (edges.hint("merge") if merge else edges).join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()
