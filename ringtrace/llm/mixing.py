"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Every row has a 48-bit hash of its id (of its text if it has none).  Sizes are summed by source and the top 16 bits, the
bucket where the running sum crosses a source's budget is found, only rows of that boundary
bucket are summed by the next 16 bits, and again by the last 16.  The result is one
threshold per source, so the last pass is a filter by comparison: no row is ever sorted.  Each
histogram is searched in two steps of 256 sums, so that is what a window over one source holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, drop, words

LEVELS, STEP = 3, 16


def id_hash(key: Column, text: Column) -> Column:
    """48 bits of the MD5 of the id as text, of the text's own MD5 if the id is null: SQL engines agree on it, so plans can be replayed elsewhere."""
    name = F.coalesce(key.cast("string"), F.md5(text.cast("binary")), F.lit(""))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): weighted shares of ``share`` x all sizes.

    Weights repeat over the sources by code point, null last.  A target stops at ``most`` x its
    source's size and the excess is shared again by weight: with level L, the target is
    min(cap, weight x L), and L follows from the sources ordered by cap / weight, whose caps bind
    first.  The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(n, F.lit(len(weights))))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ratio = F.col("cap") / F.col("w")
    filling = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    below = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
        / F.sum("w").over(rest),
    )
    level = F.max(F.when(F.col("level") <= ratio, F.col("level"))).over(everything)
    full = F.least(F.col("cap"), F.col("w") * F.coalesce(level, F.lit(float("inf"))))
    return per.select("source", "source_size", full.alias("target"))


def _digit(level: int) -> Column:
    shift = STEP * (LEVELS - 1 - level)
    return F.shiftright(F.col("h"), shift).bitwiseAND(F.lit((1 << STEP) - 1))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, bar, left, tied): rows of a source under the hash ``bar`` fill its budget but for
    ``left`` words, which the rows with exactly that hash (``tied`` words together) supply.

    ``goals`` is (source, budget), a budget being the words wanted beyond whole repeats.
    """
    now = goals.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("bar"))
    for level in range(LEVELS):
        shift = STEP * (LEVELS - level)
        at = now.select(F.col("source").alias("s"), "left", "bar")
        inside = rows.join(at, F.col("source").eqNullSafe(F.col("s"))).where(
            F.shiftright("h", shift) == F.shiftright("bar", shift)
        )
        sums = inside.groupBy("source", "left", "bar", _digit(level).alias("digit")).agg(F.sum("size").alias("mass"))
        sums = cut(sums.withColumn("high", F.shiftright("digit", STEP // 2)), "mix-sums")
        coarse = _crossing(sums.groupBy("source", "left", "bar", "high").agg(F.sum("mass").alias("mass")), "high")
        coarse = coarse.select(F.col("source").alias("s"), "high", F.col("left").alias("rest"))
        fine = sums.join(coarse, sums["source"].eqNullSafe(F.col("s")) & (sums["high"] == coarse["high"]))
        unit = 1 << (STEP * (LEVELS - 1 - level))
        now = _crossing(fine.select("source", F.col("rest").alias("left"), "bar", "digit", "mass"), "digit").select(
            "source", "left", (F.col("bar") + F.col("digit") * unit).alias("bar"), F.col("mass").alias("tied")
        )
        now = cut(now, "mix-bars")
        drop(sums)
    return now


def _crossing(sums: DataFrame, digit: str) -> DataFrame:
    """The line of each source in whose ``mass`` the running sum passes ``left``; ``left`` becomes what it has to give."""
    upto = Window.partitionBy("source").orderBy(digit)
    run = sums.withColumn("reached", F.sum("mass").over(upto)).where(F.col("reached") > F.col("left"))
    first = run.withColumn("k", F.row_number().over(upto)).where("k = 1")
    return first.withColumn("left", F.col("left") - (F.col("reached") - F.col("mass"))).drop("k", "reached")


def _plan(rows: DataFrame, weights, share: float, most: float) -> DataFrame:
    """One row a source, written: (s, source_size, target, whole, bar, left, tied).

    Read back from a file, its size is known, so Spark broadcasts it while it is under its threshold
    and shuffles when there are too many sources.
    """
    per = targets(rows, weights, share, most)
    goal = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    per = cut(per.withColumn("whole", whole).withColumn("budget", goal - whole * F.col("source_size")), "mix-goals")
    bars = thresholds(rows.where("size > 0"), per.where("budget > 0").select("source", "budget"))
    plan = per.join(bars.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    return cut(
        plan.select(F.col("source").alias("__s"), "source_size", "target", "whole", "bar", "left", "tied"), "mix-plan"
    )


def _taken(size: Column, h: Column, whole_docs: bool) -> Column:
    """Words taken of a document: whole repeats, and once more or in part as its hash says."""
    at_bar = F.floor(F.col("left") / F.col("tied") + 0.5) * size if whole_docs else F.floor(size * F.col("left") / F.col("tied"))
    part = (
        F.when(F.col("bar").isNull() | (size == 0), F.lit(0))
        .when(h < F.col("bar"), size)
        .when(h == F.col("bar"), at_bar)
        .otherwise(0)
    )
    return (F.col("whole") * size + part).cast("long")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            words(F.col(text_col)).alias("size"),
            id_hash(F.col(id_col), F.col(text_col)).alias("h"),
        ),
        "mix-rows",
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    whole_docs: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row for each row of ``docs``.

    ``taken`` is whole repeats of the document plus, for hashes under the source's threshold, one
    more; the document at the threshold gives the words that are still missing, so a
    source's taken words come to its rounded target.  With ``whole_docs`` that document is taken if at least
    half of it is wanted, which is what ``apply_mix`` does; a source is then half a document off at most.
    Rows that repeat an id share the remainder in proportion, rounded down.  Null texts have size 0; a null source is a source of its own.
    """
    rows = _rows(docs, id_col, text_col, source_col)
    plan = _plan(rows, weights, share, most)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("__s"))).select(
        "doc_id", "source", "size", "source_size", "target", _taken(F.col("size"), F.col("h"), whole_docs).alias("taken")
    )


def apply_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` repeated or left out as ``mix`` with ``whole_docs`` decides, all columns unchanged.

    Whole documents only: the one at a threshold is taken if at least half of it is wanted.  A document
    of no words belongs to every mix once.  Texts are not shuffled: a row needs its own hash
    and its source's line of the plan only.
    """
    plan = _plan(_rows(docs, id_col, text_col, source_col), weights, share, most)
    both = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), words(docs[text_col]).alias("size"), id_hash(docs[id_col], docs[text_col]).alias("h"))
    both = both.join(plan, F.col(f"row.`{source_col}`").eqNullSafe(F.col("__s")))
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise((_taken(F.col("size"), F.col("h"), True) / F.col("size")).cast("int"))
    copies = both.select("row", times.alias("n")).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return copies.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 12) AS BIGINT) AS h FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
wt AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w,
    source_size * 2.0::DOUBLE AS cap FROM per),
lv AS (SELECT *, cap / w AS ratio, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
tg AS (SELECT source, source_size, least(cap, w * coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), 'inf'::DOUBLE)) AS target FROM lv),
gl AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target + 0.5) / source_size) AS BIGINT) ELSE 0 END AS whole FROM tg),
bd AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size AS budget FROM gl),
hs AS (SELECT source, h, sum(size) AS tied FROM d WHERE size > 0 GROUP BY source, h),
cs AS (SELECT *, sum(tied) OVER (PARTITION BY source ORDER BY h) - tied AS before FROM hs),
pt AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.whole * d.size
    + CASE WHEN d.size = 0 OR b.budget <= 0 OR c.before >= b.budget THEN 0
           WHEN c.before + c.tied <= b.budget THEN d.size
           ELSE floor(CAST(d.size * (b.budget - c.before) AS DOUBLE) / c.tied) END AS taken
    FROM d JOIN bd b ON d.source IS NOT DISTINCT FROM b.source
    LEFT JOIN cs c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h AND d.size > 0)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM pt
"""
