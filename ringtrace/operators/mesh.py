"""Peer averaging on a mesh of nodes: ring and random links, weights over live nodes, mixing steps, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import cut
from .ranks import running_before


def ring_and_random(nodes: DataFrame, extra: int = 2, seed: int = 0) -> DataFrame:
    """(src, dst) of a ring over the numeric ids of ``nodes`` in order, and ``extra`` random links from each node.

    The links depend on ids and ``seed`` alone.  Ranks are counted in two levels, so no task sees all nodes.
    """
    ranked = cut(running_before(nodes.select("node").distinct(), [], "node", F.lit(1), "rank"), "mesh-ranks")
    n = ranked.count()
    if n < 2:
        return nodes.sparkSession.createDataFrame([], "src long, dst long")
    chance = F.pmod(F.xxhash64(F.col("node").cast("long"), F.col("k"), F.lit(seed)), F.lit(n))
    aims = ranked.select("node", "rank", F.explode(F.sequence(F.lit(0), F.lit(extra))).alias("k"))
    aims = aims.select(F.col("node").alias("src"), F.when(F.col("k") == 0, F.pmod(F.col("rank") + 1, F.lit(n))).otherwise(chance).alias("rank"))
    return aims.join(ranked.withColumnRenamed("node", "dst"), "rank").where("src <> dst").select("src", "dst").distinct()


def _both_ways(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Links of two live nodes, in both directions, each once."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    alive = live.select("node").distinct()
    return both.join(alive.withColumnRenamed("node", "src"), "src", "left_semi").join(alive.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def metropolis(nodes: DataFrame, edges: DataFrame, live: DataFrame) -> DataFrame:
    """(src, dst, w): symmetric weights whose rows and columns sum to 1 over the live nodes.

    A node without a live neighbour, or one that is not live, keeps itself with weight 1.  Ends that are not in
    ``nodes`` do not matter; links of a node to itself, null ends and repeats neither.
    """
    both = cut(_both_ways(edges, live.join(nodes, "node", "left_semi")), "mesh-links")
    degree = both.groupBy("src").agg(F.count("*").alias("d"))
    w = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    w = w.select("src", "dst", (1.0 / (1 + F.greatest("d", "e"))).alias("w"))
    given = w.groupBy("src").agg(F.sum("w").alias("given"))
    own = nodes.select(F.col("node").alias("src")).distinct().join(given, "src", "left")
    return w.unionByName(own.select("src", F.col("src").alias("dst"), (1 - F.coalesce("given", F.lit(0.0))).alias("w")))


def mix(models: DataFrame, weights: DataFrame, steps: int) -> DataFrame:
    """(node, dim, v) after ``steps`` weighted averages over neighbours; the mean over live nodes does not change.

    Each step is written, so its cost does not grow with the number of steps.
    """
    weights = cut(weights, "mesh-weights")
    for _ in range(steps):
        moved = weights.join(models.withColumnRenamed("node", "src"), "src")
        models = cut(moved.groupBy(F.col("dst").alias("node"), "dim").agg(F.sum(F.col("w") * F.col("v")).alias("v")), "mesh-models")
    return models


def consensus_distance(models: DataFrame, live: DataFrame) -> DataFrame:
    """(distance, nodes): mean over live nodes of |x - mean| / |mean|; 0 where all hold one model, null where the mean is 0."""
    models = models.join(live.select("node").distinct(), "node", "left_semi")
    mean = models.groupBy("dim").agg(F.avg("v").alias("m"))
    size = mean.agg(F.sqrt(F.sum(F.col("m") ** 2)).alias("size"))
    each = models.join(mean, "dim").groupBy("node").agg(F.sqrt(F.sum((F.col("v") - F.col("m")) ** 2)).alias("d"))
    return each.agg(F.avg("d").alias("d"), F.count("*").alias("nodes")).join(size, how="cross").select(F.try_divide("d", "size").alias("distance"), "nodes")  # one row each


def components(live: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of every live node: the smallest live node it can reach over live nodes.

    Each round takes the smallest label of the neighbours, hooks it to the root of the old label, and jumps to the label's
    label until nothing changes; the rounds grow with the logarithm of the longest path.
    """
    both = cut(_both_ways(edges, live), "mesh-links")
    labels = cut(live.select("node").distinct().withColumn("root", F.col("node")), "mesh-roots")
    before = None
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        seen = labels.join(near, "node", "left").withColumn("low", F.least("root", F.coalesce("near", "root")))
        hooked = seen.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("hook"))  # an old root follows its smallest member
        seen = cut(seen.join(hooked, "node", "left").select("node", F.least("low", F.coalesce("hook", "low")).alias("root")), "mesh-roots")
        for _ in range(2):
            ends = seen.select(F.col("node").alias("root"), F.col("root").alias("end"))
            seen = seen.join(ends, "root").select("node", F.col("end").alias("root"))
        labels = cut(seen, "mesh-roots")
        state = tuple(labels.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())
        if state == before:
            return labels
        before = state
