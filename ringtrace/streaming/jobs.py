"""Structured Streaming forms of the trace operators; each equals its batch twin on closed windows.

Sources are file streams with a given schema.  State expires by watermark, so it does not grow with
every identity ever heard.

Lateness: every job takes ``late``, how far behind the newest event a row may arrive.  Rows that come later
than that may be dropped by Spark; all others count.  Jobs that need the order of events hold rows
back until the watermark has passed them, so rows may be mixed over files and batches within ``late``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as X, reports as R
from ..sources.io import scratch
from .stateful import in_order, moment, nearest_stream


def file_stream(spark: SparkSession, df: DataFrame, name: str, files: int = 6, time: str | None = None, late_ms: int = 0, per_trigger: int = 1) -> DataFrame:
    """``df`` written to a shared folder and read back as a stream of ``per_trigger`` files a batch.

    With a ``time`` column rows go to files in order of event time plus a hashed delay of up to ``late_ms``, as
    a network would deliver them; files are written one after another so that they are read in that order.
    """
    path = scratch(spark, name)
    if time is None:
        df.repartition(files).write.parquet(path)
    else:
        ms = F.unix_millis(F.col(time))
        ends = df.agg(F.min(ms), F.max(ms)).first()
        low, span = ends[0] or 0, (ends[1] or 0) - (ends[0] or 0) + late_ms + 1
        arrival = ms + (F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20)) / float(1 << 20) * late_ms).cast("long")
        parts = df.withColumn("__file", F.floor((arrival - low) * files / span).cast("int"))
        kept = scratch(spark, name + "-rows")
        parts.write.partitionBy("__file").parquet(kept)
        for n in range(files):
            spark.read.parquet(kept).where(F.col("__file") == n).select(*df.columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def with_time(df: DataFrame, ms: str) -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis(F.col(ms).cast("long")))


def run_to_table(out: DataFrame, name: str, mode: str = "append", report: list | None = None) -> DataFrame:
    """Process all that is there into a Parquet table in the shared folder and return it.

    Exactly once by the checkpoint: the sink is a file sink, the offsets are in the checkpoint folder.  ``report`` gets a
    row for each batch and stateful operator: (batch, operator, rows of state, rows dropped as late, bytes).
    """
    spark = out.sparkSession
    path = scratch(spark, name)
    q = out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", path + "-state").trigger(availableNow=True).start(path)
    q.awaitTermination()
    if report is not None:
        report += [(p.batchId, s.operatorName, s.numRowsTotal, s.numRowsDroppedByWatermark, s.memoryUsedBytes) for p in q.recentProgress for s in p.stateOperators]
    return spark.read.schema(out.schema).parquet(path)


def cbr_sliding_stream(pssch: DataFrame, width: str = "2 days", slide: str = "1 day", capacity: float = 100.0, late: str = "0 seconds") -> DataFrame:
    """Sliding channel busy ratio, capped at 1, with exact neighbour counts and the last power; corrupt receptions count towards the load."""
    g = pssch.withWatermark("ts", late).groupBy("rxNodeId", F.window("ts", width, slide).alias("w"))
    return g.agg(F.least(F.lit(1.0), F.sum("subChLen") / capacity).alias("cbr"), F.size(F.collect_set("txRnti")).alias("neighbours"), F.count_if(F.col("corrupt") == 1).alias("corrupt"),
                 F.max(F.struct("timeMs", "radioUid", "slRsrpDbm")).alias("last")).select("rxNodeId", F.unix_millis("w.start").alias("start_ms"), "cbr", "neighbours", "corrupt", F.col("last.slRsrpDbm").alias("last_power"))


def vote_stream(verdicts: DataFrame, share: float, width: str = "1 day", late: str = "0 seconds") -> DataFrame:
    """Receivers, flags and the alert of each station and window."""
    g = verdicts.withWatermark("ts", late).groupBy("claimedStationId", F.window("ts", width).alias("w"))
    out = g.agg(F.count("*").alias("n"), F.count_if(F.col("p") != 0).alias("k"))
    return out.select("claimedStationId", F.unix_millis("w.start").alias("start_ms"), "n", "k", (F.col("k") >= F.ceil(F.col("n") * share)).alias("alert"))


def asof_stream(rx: DataFrame, pssch: DataFrame, within_ms: int = 1_800_000, late: str = "30 minutes") -> DataFrame:
    """(msgUid, sinr): every message with the nearest data-channel reception of its radio, one row each, null if none is near.

    A message comes out when the watermark has passed its interval; receptions leave the state when no message can need them.
    """
    out = nearest_stream(rx, pssch, {"rxNodeId": "rxNodeId", "claimedStationId": "txRnti"}, ("msgUid", "radioUid"), ("rxTimeMs", "timeMs"), [], {"": (F.lit(True), ["sinr"])}, within_ms, late)
    return out.select(F.col("uid").alias("msgUid"), "sinr")


RESIDUALS = ["dt", "claimedDist", "dx", "dy", "moved", "dmv", "ssc", "predict", "heading", "accel"]


KEPT = "rxTimeMs double, claimedX double, claimedY double, claimedSpeed double, claimedHeading double"


def residual_step(road_length: float) -> Callable[[dict, tuple | None], tuple[tuple, tuple]]:
    """The residuals of a message (in the order of ``RESIDUALS``) against the one before it on its link, and what to keep of it."""
    import math

    def unwrap(d):
        return None if d is None else d - float(round(d / road_length)) * road_length

    def minus(a, b):
        return None if a is None or b is None else a - b

    def over(a, b):
        return None if a is None or not b else a / b

    def hypot(a, b):
        return None if a is None or b is None else math.hypot(a, b)

    def step(r: dict, last: tuple | None) -> tuple[tuple, tuple]:
        now = (r["rxTimeMs"], r["claimedX"], r["claimedY"], r["claimedSpeed"], r["claimedHeading"])
        t, x, y, v, h = now
        pt, px, py, pv, ph = last or (None,) * 5
        away = hypot(minus(x, r["rxX"]), minus(y, r["rxY"]))
        gap = minus(t, pt)
        dt = None if gap is None else gap / 1000.0
        dx, dy = unwrap(minus(x, px)), minus(y, py)
        moved = hypot(dx, dy)
        way = None if pv is None or dt is None else pv * dt
        turn = None if ph is None else math.radians(ph)
        known = None not in (px, py, way, turn)
        ahead = hypot(unwrap(minus(x, px + way * math.sin(turn))), minus(y, py + way * math.cos(turn))) if known else None
        heading = None
        if moved is not None and moved > 1.0 and h is not None:
            turned = math.fmod(abs(h - math.degrees(math.atan2(dx, dy)) % 360.0), 360.0)
            heading = min(turned, 360.0 - turned)
        return (dt, away, dx, dy, moved, minus(moved, way), minus(over(moved, dt), v), ahead, heading, over(minus(v, pv), dt)), now

    return step


POSITION = ["rxTimeMs", "claimedX", "claimedY", "claimedSpeed", "claimedHeading", "rxX", "rxY"]


def residuals_stream(rx: DataFrame, late: str = "0 seconds", road_length: float = 6000.0, hold_ms: int = 40 * 86_400_000) -> DataFrame:
    """All residuals of a message against the one before it on its link, the last message being the state."""
    inner = residual_step(road_length)

    def step(r: dict, last: tuple | None) -> tuple[tuple, tuple]:
        made, kept = inner(r, last)
        return (r["msgUid"], *made), kept

    schema = "msgUid long, " + ", ".join(f"{c} double" for c in RESIDUALS)
    return in_order(rx, X.LINK, ["rxTimeMs", "msgUid"], ["msgUid", *POSITION], step, KEPT, schema, late, hold_ms)


def link_features_stream(rx: DataFrame, pssch: DataFrame, width_ms: int, within_ms: int = 1_800_000, late: str = "0 seconds", road_length: float = 6000.0, hold_ms: int = 40 * 86_400_000) -> DataFrame:
    """All link-window features in one plan of three stateful operators: nearest receptions, residuals, windows.

    Rows leave the first operator ``within_ms`` after their own time, which is the event time from there on; windows are laid so
    that they hold the same messages as the batch's.  Sequence gaps are taken in the order of time, as the
    batch's are where sequence numbers rise with it.
    """
    carry = [*X.LINK, "msgType", "seqNo", *POSITION]
    picks = {"": (F.lit(True), ["sinr", "tbler", "corrupt", "mcs"]), "clear_": (F.col("corrupt") == 0, ["slRsrpDbm"])}
    near = nearest_stream(rx, pssch, {"rxNodeId": "rxNodeId", "claimedStationId": "txRnti"}, ("msgUid", "radioUid"), ("rxTimeMs", "timeMs"), carry, picks, within_ms, late)
    near = near.withColumnRenamed("clear_slRsrpDbm", "slRsrpDbm").withColumnRenamed("uid", "msgUid").withColumnRenamed("ready", "ts")
    through = ["msgType", "seqNo", "sinr", "tbler", "corrupt", "mcs", "slRsrpDbm"]
    kinds, inner = dict(near.dtypes), residual_step(road_length)

    def step(r: dict, last: tuple | None) -> tuple[tuple, tuple]:
        made, kept = inner(r, None if last is None else last[1:])
        before, seq = None if last is None else last[0], r["seqNo"]
        gap = None if before is None or seq is None else max(seq - before - 1, 0)
        return (moment(r["ms"]), *[r[c] for c in X.LINK], r["rxTimeMs"], gap, r["claimedSpeed"], *[r[c] for c in through], *made), (seq, *kept)

    schema = ["ts timestamp", *[f"{c} {kinds[c]}" for c in X.LINK], "rxTimeMs double", "seq_gap long", "claimedSpeed double"]
    schema += [f"{c} {kinds[c]}" for c in through] + [f"{c} double" for c in RESIDUALS]
    rows = in_order(near, X.LINK, ["rxTimeMs", "msgUid"], ["msgUid", *POSITION, *X.LINK, *through], step, "seqNo long, " + KEPT, ", ".join(schema), "", hold_ms, "ts")
    window = F.window("ts", f"{width_ms} milliseconds", f"{width_ms} milliseconds", f"{within_ms % width_ms} milliseconds")
    out = X.window_features(rows, None, window=window)
    start = F.unix_millis("window.start") - within_ms
    return out.withColumn("window", F.floor(start / width_ms).cast("long"))


def alerts_stream(hits: DataFrame, k: int, m: int, late: str = "0 seconds", hold_ms: int = 40 * 86_400_000) -> DataFrame:
    """K-of-M alerts and episode starts of each track, the last M hits being the state."""

    def step(r: dict, last: tuple | None) -> tuple[tuple, tuple]:
        hits, on = (list(last[0]), last[1]) if last is not None else ([], False)
        hits = [*hits, bool(r["hit"])][-m:]
        fired = sum(hits) >= k
        return (r["key_window"], fired, fired and not on), (hits, fired)

    return in_order(hits, ["key_region", "key_claimedStationId"], ["timeMs", "key_window"], ["key_window", "timeMs", "hit"], step, "hits array<boolean>, fired boolean", "key_window long, fired boolean, edge boolean", late, hold_ms)


def score_seconds(src: DataFrame, predict: Callable[[DataFrame], DataFrame], by: list[str], time: str, name: str) -> DataFrame:
    """(by, time, y, p, n): each micro-batch scored by a fitted model, counted by second; ``running_metrics`` makes scores of it.

    ``predict`` keeps ``by`` and ``time`` and adds y and p.  A second may come in several batches: counts are summed on read.
    A batch that is run again overwrites its own folder, so they are exactly once.
    """
    spark = src.sparkSession
    path = scratch(spark, name)

    def one(batch: DataFrame, n: int) -> None:
        R.confusion(predict(batch), by=[*by, time]).write.mode("overwrite").parquet(f"{path}/batch={n}")

    src.writeStream.foreachBatch(one).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy(*by, time, "y", "p").agg(F.sum("n").alias("n"))


def score_stream(src: DataFrame, predict: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Each micro-batch scored by a fitted model; (y, p) counts are appended per batch and summed on read.

    A batch that is run again overwrites its own folder, so the counts are exactly once.
    """
    spark = src.sparkSession
    path = scratch(spark, name)

    def one(batch: DataFrame, n: int) -> None:
        R.confusion(predict(batch)).write.mode("overwrite").parquet(f"{path}/batch={n}")

    src.writeStream.foreachBatch(one).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.parquet(path)
    return counts.groupBy("y", "p").agg(F.sum("n").alias("n"))
