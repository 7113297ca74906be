"""Nearest-time joins by one union and ordered windows: O(n log n), equi-key shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    by: dict[str, str],
    carry: list[str],
    left_id: str,
    right_id: str,
    tolerance: float | None = None,
    slice_of: float | None = None,
) -> DataFrame:
    """``left`` with ``carry`` columns of the row of ``right`` nearest in time under equal keys.

    ``by`` maps left key columns to right ones.  At equal distance the earlier row wins, among equal
    times before the left row the one with the largest ``right_id``, after it the smallest.  A left
    row with a null key, or with nothing within ``tolerance`` (inclusive), gets nulls.

    With ``slice_of``, a length of time, a key is cut into slices of it: rows are sorted inside a slice only, and
    the last and first row of ``right`` in the slices around it are carried in, so a busy key is many tasks.
    """
    keys = [f"__k{n}" for n in range(len(by))]
    payload = F.struct(F.col(right_time).alias("t"), *[F.col(c) for c in carry])
    rows = right.select(
        *[F.col(r).alias(k) for k, r in zip(keys, by.values())], F.col(right_time).cast("double").alias("__t"),
        F.lit(1).alias("__side"), F.col(right_id).cast("long").alias("__rid"), payload.alias("__r"),
    )
    null_key = F.lit(False)
    for k in by:
        null_key = null_key | F.col(k).isNull()
    # rows without a key meet nothing: they get a partition of their own each
    apart = F.when(null_key, F.col(left_id).cast("long"))
    own = left.select(
        "*", *[F.col(c).alias(k) for k, c in zip(keys, by)], F.col(left_time).cast("double").alias("__t"),
        F.lit(0).alias("__side"), F.col(left_id).cast("long").alias("__rid"), apart.alias("__apart"),
    )
    both = own.unionByName(rows, allowMissingColumns=True)
    both = both.withColumn("__w", F.lit(0) if slice_of is None else F.floor(F.col("__t") / slice_of))
    order = Window.partitionBy(*keys, "__apart", "__w").orderBy("__t", F.desc("__side"), "__rid")
    back = F.last("__r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    onward = Window.partitionBy(*keys, "__apart", "__w").orderBy(F.desc("__t"), "__side", F.desc("__rid"))  # the reverse: a frame that looks ahead is read anew for each row
    ahead = F.last("__r", ignorenulls=True).over(onward.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__b", back).withColumn("__f", ahead).where("__side = 0")
    if slice_of is not None:
        at = F.when(F.col("__side") == 1, F.struct("__t", "__rid"))
        ends = both.where("__apart IS NULL").groupBy(*keys, "__w").agg(F.max_by("__r", at).alias("__last"), F.min_by("__r", at).alias("__first"))
        along, astern = (Window.partitionBy(*keys).orderBy(w) for w in ("__w", F.desc("__w")))  # a row a slice
        ends = ends.select(*keys, "__w", F.last("__last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__past"),
                           F.last("__first", ignorenulls=True).over(astern.rowsBetween(Window.unboundedPreceding, -1)).alias("__next"))
        found = found.join(ends, [*keys, "__w"], "left").withColumn("__b", F.coalesce("__b", "__past")).withColumn("__f", F.coalesce("__f", "__next"))
    earlier = F.col("__f").isNull() | (F.col("__t") - F.col("__b.t") <= F.col("__f.t") - F.col("__t"))
    best = F.when(F.col("__b").isNotNull() & earlier, F.col("__b")).otherwise(F.col("__f"))
    near = F.lit(True) if tolerance is None else F.abs(F.col("__t") - F.col("__m.t")) <= tolerance
    return found.withColumn("__m", best).select(
        *left.columns, *[F.when(near, F.col(f"__m.{c}")).alias(c) for c in carry]
    )


def position_at(
    queries: DataFrame, positions: DataFrame, by: list[str], query_time: str, time: str, carry: list[str], query_id: str, slice_of: float | None = None,
) -> DataFrame:
    """``queries`` with ``carry`` of the first position at or after the time; past the end, the last one.

    With ``slice_of``, a length of time, a key is cut into slices of it: rows are sorted inside a slice only, and the
    first position of the slices behind and the last of those before are carried in.
    """
    rows = positions.select(*by, F.col(time).cast("double").alias("__t"), F.lit(1).alias("__side"), F.struct(*carry).alias("__r"))
    own = queries.select("*", F.col(query_time).cast("double").alias("__t"), F.lit(0).alias("__side"))
    both = own.unionByName(rows, allowMissingColumns=True)
    both = both.withColumn("__w", F.lit(0) if slice_of is None else F.floor(F.col("__t") / slice_of))
    order = Window.partitionBy(*by, "__w").orderBy("__t", "__side", query_id)
    onward = Window.partitionBy(*by, "__w").orderBy(F.desc("__t"), F.desc("__side"), F.desc(query_id))  # the reverse: a frame that looks ahead is read anew for each row
    after = F.last("__r", ignorenulls=True).over(onward.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("__r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__a", after).withColumn("__b", before).where("__side = 0")
    if slice_of is not None:
        at = F.when(F.col("__side") == 1, F.col("__t"))
        names = [f"__k{n}" for n in range(len(by))]
        ends = both.groupBy(*[F.col(c).alias(k) for c, k in zip(by, names)], F.col("__w").alias("__s")).agg(F.max_by("__r", at).alias("__last"), F.min_by("__r", at).alias("__first"))
        along, astern = (Window.partitionBy(*names).orderBy(s) for s in ("__s", F.desc("__s")))  # a row a slice
        ends = ends.withColumn("__past", F.last("__last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
        ends = ends.withColumn("__next", F.last("__first", ignorenulls=True).over(astern.rowsBetween(Window.unboundedPreceding, -1)))
        same = F.col("__w").eqNullSafe(F.col("__s"))
        for c, k in zip(by, names):
            same = same & F.col(c).eqNullSafe(F.col(k))
        found = found.join(ends, same, "left").withColumn("__a", F.coalesce("__a", "__next")).withColumn("__b", F.coalesce("__b", "__past"))
    return found.withColumn("__m", F.coalesce("__a", "__b")).select(*queries.columns, *[F.col(f"__m.{c}").alias(c) for c in carry])


def gaps(df: DataFrame, keys: list[str], time: str, slice_ms: float, ties: list[str] = ()) -> DataFrame:
    """Adds ``gap``: time since the key's row before, null for its first; of equal times ``ties`` tells the order.

    Keys are cut into slices of time, and each slice's first row takes the end of the key's slice before, so a busy key
    is many sorted runs and not one.  Rows without a time have no gap and are not counted as rows before.
    """
    rows = df.withColumn("__s", F.floor(F.col(time) / slice_ms))
    inside = Window.partitionBy(*keys, "__s").orderBy(time, *ties)
    ends = rows.where("__s IS NOT NULL").groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__s").alias("__t")).agg(F.max(time).alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__t")))  # a row a slice
    same = F.col("__s") == F.col("__t")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.withColumn("__l", F.lag(time).over(inside)).join(ends, same, "left")
    before = F.coalesce("__l", "__end")
    return out.withColumn("gap", F.when(F.col("__s").isNotNull(), F.col(time) - before)).select(*df.columns, "gap")
