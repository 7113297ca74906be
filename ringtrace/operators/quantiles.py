"""Exact quantiles by refined histograms: no task ever holds or sorts all values of a group.

Counts of equal-width buckets come first; only the buckets that hold a wanted rank are cut again, until
they hold few values, which are then numbered.  Equal values never part, so a bucket of one value is done.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import cut

BUCKETS, FEW, ROUNDS = 1024, 20_000, 8


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    """Equality of the group columns of ``a`` and their copies ``__k..`` in ``b``, nulls being equal."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"__k{n}"]) for n, c in enumerate(by)])


def exact_quantiles(df: DataFrame, by: list[str], values: dict[str, Column], wanted: dict[str, tuple[str, float]], buckets: int = BUCKETS, few: int = FEW, rounds: int = ROUNDS) -> DataFrame:
    """(by, one double for each name in ``wanted``), equal to ``percentile``: linear between the two ranks around q (n - 1).

    ``wanted`` maps a name to (name of a value, q).  Nulls and NaN are left out, infinities count.  A group without
    any value has no row; without ``by`` there is one row, with nulls where there is nothing.  A bucket that still
    holds over ``few`` values after ``rounds`` cuts is sorted whole, so results never depend on the three numbers.
    """
    names = list(values)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("s"), values[k].cast("double").alias("v")) for n, k in enumerate(names)])).alias("__e")
    rows = cut(df.select(*by, each).select(*by, F.col("__e.s").alias("__s"), F.col("__e.v").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)"), "quantile-rows")
    keys = [*by, "__s"]
    copies = [f"__k{n}" for n in range(len(keys))]
    end = F.when(F.col("__v") == float("inf"), 1).when(F.col("__v") == float("-inf"), -1).otherwise(0)
    found = [F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")]
    whole = Window.partitionBy(*copies)
    cells = rows.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, copies)], end.alias("__b")).agg(*found)
    ahead = F.coalesce(F.sum("__n").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("__before", ahead).withColumn("__total", F.sum("__n").over(whole)).drop("__b")
    series = F.col(copies[-1])
    place = {k: F.lit(float(q)) * (F.col("__total") - 1) for k, (_, q) in wanted.items()}
    ranks = [(names.index(s), f(place[k]).cast("long")) for k, (s, _) in wanted.items() for f in (F.floor, F.ceil)]
    holds = reduce(lambda x, y: x | y, [(series == s) & (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n")) for s, r in ranks])
    cells = cut(cells.where(holds), "quantile-cells")
    coarse = (F.col("__n") > few) & (F.col("__lo") < F.col("__hi"))
    for _ in range(rounds):
        if cells.where(coarse).isEmpty():
            break
        big = cells.where(coarse)
        inside = rows.join(big, _same(rows, big, keys) & F.col("__v").between(F.col("__lo"), F.col("__hi")))
        share = (F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2)  # halves, so that no width overflows
        parts = inside.groupBy(*copies, "__before", "__total", F.floor(share * buckets).alias("__b")).agg(*found)
        run = Window.partitionBy(*copies, "__before").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
        parts = parts.withColumn("__ahead", F.coalesce(F.sum("__n").over(run), F.lit(0)))
        parts = parts.select(*copies, "__n", "__lo", "__hi", (F.col("__before") + F.col("__ahead")).alias("__before"), "__total")
        cells = cut(cells.where(~coarse).unionByName(parts.where(holds)), "quantile-cells")
    mixed, single = cells.where("__lo < __hi"), cells.where("__lo = __hi")
    held = rows.join(mixed, _same(rows, mixed, keys) & F.col("__v").between(F.col("__lo"), F.col("__hi")))
    number = F.row_number().over(Window.partitionBy(*copies, "__before").orderBy("__v")) - 1
    held = held.select(*copies, "__total", (F.col("__before") + number).alias("__from"), F.lit(1).cast("long").alias("__n"), F.col("__v"))
    points = held.unionByName(single.select(*copies, "__total", F.col("__before").alias("__from"), "__n", F.col("__lo").alias("__v")))
    out = []
    for k, (s, _) in wanted.items():
        own = series == names.index(s)
        low, high = (F.max(F.when(own & (f(place[k]) >= F.col("__from")) & (f(place[k]) < F.col("__from") + F.col("__n")), F.col("__v"))) for f in (F.floor, F.ceil))
        at = F.max(F.when(own, place[k]))
        out.append(F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(k))
    back = [F.col(c).alias(k) for k, c in zip(by, copies)]
    return points.groupBy(*back).agg(*out) if by else points.agg(*out)


def quantile_numbers(df: DataFrame, values: dict[str, Column], wanted: dict[str, tuple[str, float]]) -> dict[str, float | None]:
    """The same without groups, as numbers; what has no value is None."""
    return exact_quantiles(df, [], values, wanted).first().asDict()


def with_quantiles(stats: DataFrame, rows: DataFrame, by: list[str], values: dict[str, Column], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``stats``, one row a group, with the exact quantiles of the group's ``rows``; null keys are equal."""
    found = exact_quantiles(rows, by, values, wanted).withColumnsRenamed({c: f"__k{n}" for n, c in enumerate(by)})
    return stats.join(found, _same(stats, found, by), "left").select(*stats.columns, *wanted)
