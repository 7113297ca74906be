"""Replay of a scored trace: running scores, verdicts of station seconds, and tracks cut into frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import reports as R
from ..functions import scalars as S
from ..sources.io import cut

#: Fixed value: a frame in which a station sent nothing.
GAP = -99999
PLACES = ["trueX", "trueY", "claimedX", "claimedY"]


def second_counts(pred: DataFrame, by: list[str], time: str) -> DataFrame:
    """(by, time, y, p, n): confusion counts of every second."""
    return R.confusion(pred, by=[*by, time])


def running_metrics(counts: DataFrame, by: list[str], time: str, classes: list[int] | None = None, chunk: int = 4096) -> DataFrame:
    """Scores over all decisions up to each second, from ``second_counts``: one row a second of each ``by``.

    decisions, alerts and attacks are the second's own; accuracy, macro_f1 (over the classes met so far), mcc, the
    share of each attack family that was flagged and false_alarm (of benign rows) are cumulative, null where there is
    nothing to divide by and mcc 0.  Counts without a time, truth, prediction or key take no part.  Sums run inside
    chunks of ``chunk`` units of time, whose totals are added up apart, so that a long replay is not one task.
    """
    counts = counts.na.drop(subset=[*by, time, "y", "p"])
    if classes is None:
        counts = cut(counts, "second-counts")
        classes = sorted(r[0] for r in counts.select(F.explode(F.array("y", "p"))).distinct().collect()) or [0]  # a row a class
    y, p = F.col("y"), F.col("p")

    def n(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    cells = {f"{kind}{k}": n(cond) for k, c in enumerate(classes) for kind, cond in (("t", y == c), ("q", p == c), ("h", (y == c) & (p == c)), ("f", (y == c) & (p != 0)))}
    per = counts.groupBy(*by, time).agg(F.sum("n").alias("decisions"), n(p != 0).alias("alerts"), n(y != 0).alias("attacks"), *[v.alias(k) for k, v in cells.items()])
    per = per.withColumn("__c", F.floor(F.col(time) / chunk))
    ahead = Window.partitionBy(*by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    starts = per.groupBy(*by, "__c").agg(*[F.sum(k).alias(f"__{k}") for k in cells])
    starts = starts.select(*by, "__c", *[F.coalesce(F.sum(f"__{k}").over(ahead), F.lit(0)).alias(f"__{k}") for k in cells])
    so_far = Window.partitionBy(*by, "__c").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    run = per.join(starts, [*by, "__c"]).select(*by, time, "decisions", "alerts", "attacks", *[(F.col(f"__{k}") + F.sum(k).over(so_far)).cast("double").alias(k) for k in cells])

    def total(f) -> Column:
        return sum((f(k) for k in range(len(classes))), F.lit(0.0))

    t, q, h, f = ({k: F.col(f"{kind}{k}") for k in range(len(classes))} for kind in "tqhf")
    s, hit = total(lambda k: t[k]), total(lambda k: h[k])
    met = total(lambda k: (t[k] + q[k] > 0).cast("int"))
    f1 = F.try_divide(total(lambda k: F.coalesce(F.try_divide(2 * h[k], t[k] + q[k]), F.lit(0.0))), met)
    spread = F.sqrt(s * s - total(lambda k: q[k] * q[k])) * F.sqrt(s * s - total(lambda k: t[k] * t[k]))
    mcc = F.coalesce(F.try_divide(hit * s - total(lambda k: t[k] * q[k]), spread), F.lit(0.0))

    def flagged(chosen) -> Column:
        own = [k for k, c in enumerate(classes) if chosen(c)]
        return F.try_divide(sum((f[k] for k in own), F.lit(0.0)), sum((t[k] for k in own), F.lit(0.0)))

    families = {name: flagged(lambda c, name=name: S.FAMILY.get(c) == name) for name in dict.fromkeys(S.FAMILY.values())}
    return run.select(*by, time, "decisions", "alerts", "attacks", F.try_divide(hit, s).alias("accuracy"), f1.alias("macro_f1"), mcc.alias("mcc"),
                      *[v.alias(k) for k, v in families.items()], flagged(lambda c: c == 0).alias("false_alarm"))


def verdicts(pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, flagged, top, truth) of each station second: receivers, those that flag it, the class most of them name
    (0 if none flags), the class it has; ties go to the smaller class."""
    flag = F.col("p") != 0
    return pred.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"),
                                   F.coalesce(F.mode(F.when(flag, F.col("p")), True), F.lit(0)).alias("top"), F.mode("y", True).alias("truth"))


def track_frames(tx: DataFrame, frame_ms: float, size: int) -> DataFrame:
    """(key_seed, claimedStationId, part, attack, node, pos): tracks in parts of ``size`` frames.

    A frame holds the place of the last message sent in it, in tenths of a metre, true and claimed, and ``GAP`` where
    there is none; a part without any message has no row, so no row grows with the length of the drive.  ``attack`` and
    ``node`` are the station's most frequent ones over the whole drive.
    """
    keys = ["key_seed", "claimedStationId"]
    last = R.last_per_frame(tx.where("txTimeMs IS NOT NULL"), keys, "txTimeMs", "msgUid", frame_ms, PLACES)
    part = F.floor(F.col("frame") / size)
    tenths = F.array(*[F.coalesce(F.rint(F.col(c) * 10).cast("long"), F.lit(GAP).cast("long")) for c in PLACES])
    last = last.select(*keys, part.alias("part"), (F.col("frame") - part * size).cast("int").alias("i"), tenths.alias("at"))
    found = last.groupBy(*keys, "part").agg(F.map_from_entries(F.collect_list(F.struct("i", "at"))).alias("m"))  # at most ``size`` entries
    empty = F.array_repeat(F.lit(GAP).cast("long"), len(PLACES))
    pos = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), empty)))
    who = tx.groupBy(*keys).agg(F.mode("attackId", True).alias("attack"), F.mode("txNodeId", True).alias("node"))
    return found.join(who, keys).select(*keys, "part", "attack", "node", pos.alias("pos"))


def export_drives(tx: DataFrame, pred: DataFrame, time: str, frame_ms: float, size: int, folder: str) -> str:
    """Everything a player of the drives needs, as JSON lines in folders by kind and seed: ``frames`` (parts of tracks),
    ``seconds`` (verdicts of station seconds), ``cells`` (confusion counts of a second) and ``scores`` (running)."""
    counts = cut(second_counts(pred, ["key_seed"], time), "second-counts")
    kinds = {"frames": track_frames(tx, frame_ms, size), "seconds": verdicts(pred, ["key_seed", "key_claimedStationId", time]),
             "cells": counts, "scores": running_metrics(counts, ["key_seed"], time)}
    for kind, rows in kinds.items():
        rows.write.partitionBy("key_seed").json(f"{folder}/{kind}")
    return folder
