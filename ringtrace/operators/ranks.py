"""Running totals in two levels, so that one key with very many values is not one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, descending: bool = False, parts: int = 64) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the key's rows that come before, ``order`` being unique within a key.

    Quantiles of each key cut its order into ``parts`` buckets; bucket sums are added up first, and a window
    runs inside each bucket only.
    """
    cuts = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    df = df.withColumn("__v", value)
    if keys:
        bounds = df.groupBy(*keys).agg(F.percentile_approx(order, cuts, 1000).alias("__cuts"))
        rows = df.join(bounds, keys)
    else:
        row = df.agg(F.percentile_approx(order, cuts, 1000).alias("c")).first()  # ``parts`` numbers
        rows = df.withColumn("__cuts", F.lit(row["c"] or []).cast("array<double>"))
    rows = rows.withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col(order)))).drop("__cuts")
    sums = rows.groupBy(*keys, "__b").agg(F.sum("__v").alias("__s"))
    way = F.desc if descending else F.asc
    ahead = Window.partitionBy(*keys).orderBy(way("__b")).rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows a key
    starts = sums.select(*keys, "__b", F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, "__b").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(starts, [*keys, "__b"])
    return out.withColumn(name, F.col("__start") + F.coalesce(F.sum("__v").over(inside), F.lit(0))).drop("__v", "__b", "__start")


def hash_rank(df: DataFrame, keys: list[str], h: Column, ties: list[str], rank: str, total: str, bits: int = 12) -> DataFrame:
    """Adds ``rank``, from 1 by a 32-bit hash ``h`` and then ``ties`` inside a key, and ``total``, the key's rows.

    Equal to one ``row_number`` a key, but a key is cut into 2^``bits`` hash ranges: their counts are added up, and
    rows are sorted inside a range only.  Null keys form a group as in a window.
    """
    rows = df.withColumn("__h", h.cast("long")).withColumn("__b", F.shiftright("__h", 32 - bits))
    whole = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))])  # at most 2^bits rows a key
    counts = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__c")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__start", before).withColumn(total, F.sum("__n").over(whole))
    inside = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__h", *ties))
    same = F.col("__b") == F.col("__c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.withColumn("__r", inside).join(counts, same)
    return out.withColumn(rank, F.col("__start") + F.col("__r")).drop("__h", "__b", "__c", "__n", "__r", "__start", *[f"__k{i}" for i in range(len(keys))])
