"""Reports of a campaign and its corpus: rungs of lies, matched residuals, client skew, traffic, sending intervals, card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import reports as R
from .asof import gaps
from .partition import STATION
from .quantiles import exact_quantiles, quantile_numbers, with_quantiles
from ..functions import scalars as S
from ..sources.io import cut

#: Bins of channels, of the channel busy ratio, classes that lie about their place.
CHANNELS = [0, 2.5, 4, 6, 10, float("inf")]
BUSY = [0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 1.01]
LIARS = [1, 2, 3, 4, 11, 13]
#: Fixed values, bytes: a safety message with its header, one number, a place, the ids of a report.
MESSAGE_BYTES, NUMBER_BYTES, PLACE_BYTES, ID_BYTES = 275, 4, 8, 12


def claim_error(tx: DataFrame) -> DataFrame:
    return tx.withColumn("err", F.hypot(F.col("claimedX") - F.col("trueX"), F.col("claimedY") - F.col("trueY")))


# ---- magnitude of lies
def magnitude_rungs(tx: DataFrame, lying: bool = True) -> DataFrame:
    """(attackId, stations, measured, least, p25, p50, p75, most, inside): station medians of the claim error by class.

    With ``lying`` only messages beyond the largest benign error count and stations without one are not ``measured``;
    else all messages do.  ``inside`` counts medians within the benign p95.  No lie at all leaves a class with nulls.
    """
    e = claim_error(tx)
    b = quantile_numbers(e.where("attackId = 0"), {"e": F.col("err")}, {"top": ("e", 1.0), "p95": ("e", 0.95)})
    bad = e.where("attackId > 0")
    used = bad.where(F.col("err") > (b["top"] or 0.0)) if lying else bad
    keys = ["attackId", "key_seed", "txNodeId"]
    medians = cut(exact_quantiles(used, keys, {"e": F.col("err")}, {"lie": ("e", 0.5)}), "rungs")
    everyone = bad.groupBy("attackId").agg(F.count_distinct("key_seed", "txNodeId").alias("stations"))
    own = medians.groupBy("attackId").agg(F.count("*").alias("measured"), F.min("lie").alias("least"), F.max("lie").alias("most"), F.count_if(F.col("lie") <= (b["p95"] or 0.0)).alias("inside"))
    out = with_quantiles(own, medians, ["attackId"], {"lie": F.col("lie")}, {"p25": ("lie", 0.25), "p50": ("lie", 0.5), "p75": ("lie", 0.75)})
    return everyone.join(out, "attackId", "left").na.fill(0, ["measured", "inside"]).select("attackId", "stations", "measured", "least", "p25", "p50", "p75", "most", "inside")


def rung_overlap(rungs: DataFrame) -> DataFrame:
    """(attackId, other, overlap) of every two classes with lies: whether their ranges of station medians meet."""
    w = Window.orderBy("attackId").rowsBetween(Window.unboundedPreceding, -1)  # a row a class
    band = F.struct("attackId", "least", "most")
    pairs = rungs.where("least IS NOT NULL").withColumn("e", F.collect_list(band).over(w)).withColumn("e", F.explode("e"))
    return pairs.select(F.col("e.attackId").alias("attackId"), F.col("attackId").alias("other"), (F.greatest("least", "e.least") <= F.least("most", "e.most")).alias("overlap"))


# ---- residual and channel counts
def residual_by_channels(units: DataFrame, value: str, count: str, label: str, edges: list[float] = CHANNELS) -> DataFrame:
    """(bin, label, units, median) of a residual in bins (lo, hi] of the channel count; units without a channel go."""
    rows = units.where(F.col(count) > 0).withColumn("bin", S.cut_bins(count, edges)).where("bin IS NOT NULL")
    sizes = rows.groupBy("bin", label).agg(F.count(value).alias("units"))
    return with_quantiles(sizes, rows, ["bin", label], {"v": F.col(value)}, {"median": ("v", 0.5)})


def residual_excess(units: DataFrame, value: str, count: str, label: str) -> DataFrame:
    """``sybil_residual`` with the excess in benign standard deviations, the share explained and what is left of it."""
    sd = units.where(F.col(count) > 0).agg(F.stddev_samp(F.when(F.col(label) == 0, F.col(value))).alias("sd"))
    one = R.sybil_residual(units.where(F.col(count) > 0), value, count, label).crossJoin(sd)  # one row each
    left = F.col("excess") - F.col("explained")
    return one.select("*", F.try_divide("excess", "sd").alias("excess_sd"), F.try_divide("explained", "excess").alias("share"), left.alias("left_over"), F.try_divide(left, F.col("sd")).alias("left_over_sd"))


# ---- label skew of clients
def enough_rows(df: DataFrame, client: str, least: int) -> DataFrame:
    """Rows of the clients that have at least ``least``."""
    return df.join(df.groupBy(client).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(client), client, "left_semi")


def client_shares(df: DataFrame, client: str, label: str) -> DataFrame:
    """(label, mean, std, least, most) of each class's share over all clients; a client without the class counts as 0."""
    per = R.share(df, label, [client])
    n = df.agg(F.count_distinct(client).alias("clients"))
    g = per.groupBy(label).agg(F.count("*").alias("k"), F.sum("share").alias("s"), F.sum(F.col("share") * F.col("share")).alias("ss"), F.min("share").alias("lo"), F.max("share").alias("most")).crossJoin(n)  # one row
    var = F.try_divide(F.col("ss") - F.col("s") * F.col("s") / F.col("clients"), F.col("clients") - 1)
    return g.select(label, (F.col("s") / F.col("clients")).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), F.when(F.col("k") < F.col("clients"), 0.0).otherwise(F.col("lo")).alias("least"), "most")


def skew_rule(df: DataFrame, client: str, label: str, min_tv: float = 0.10, min_spread: float = 0.5) -> DataFrame:
    """One row: clients, effective classes (mean, least, most, spread), clients that lack one class and two, mean total
    variation from the pool, and whether the partition is skewed enough: both measures must reach their floors."""
    s = R.partition_skew(df, client, label)
    g = s.agg(F.count("*").alias("clients"), F.avg("effective").alias("mean_effective"), F.min("effective").alias("least_effective"), F.max("effective").alias("most_effective"),
              (F.max("effective") - F.min("effective")).alias("spread"), F.count_if(F.col("missing") >= 1).alias("lack_one"), F.count_if(F.col("missing") >= 2).alias("lack_two"), F.avg("tv").alias("mean_tv"))
    return g.withColumn("passed", F.coalesce((F.col("mean_tv") >= min_tv) & (F.col("spread") >= min_spread), F.lit(False)))


# ---- traffic of messages and reports
def report_traffic(tx: DataFrame, heard: DataFrame, window_ms: float, features: int) -> DataFrame:
    """One row: windows, messages and Mbit/s of safety traffic, reports a second and for each receiver, Mbit/s of full and
    of minimal reports and their ratio to the safety traffic.

    A report is one receiver that heard a station in a window; a full one carries ``features`` numbers more.  ``tx`` has
    key_seed, msgUid, claimedStationId and txTimeMs, ``heard`` key_seed, msgUid and rxNodeId.
    """
    w = tx.select("key_seed", "msgUid", "claimedStationId", S.window_index("txTimeMs", window_ms).alias("w")).where("w IS NOT NULL")
    sent = w.groupBy("key_seed", "w").agg(F.count("*").alias("n")).agg(F.count("*").alias("windows"), F.sum("n").alias("messages"))
    reports = heard.join(w, ["key_seed", "msgUid"]).select("key_seed", "claimedStationId", "w", "rxNodeId").distinct().agg(F.count("*").alias("reports"))
    ears = heard.agg(F.count_distinct("key_seed", "rxNodeId").alias("receivers"))
    seconds = F.col("windows") * (window_ms / 1000.0)
    rate = F.try_divide("reports", seconds)
    safety = F.try_divide(F.col("messages") * MESSAGE_BYTES * 8, seconds * 1e6)
    full, minimal = (rate * size * 8 / 1e6 for size in (features * NUMBER_BYTES + NUMBER_BYTES + PLACE_BYTES + ID_BYTES, NUMBER_BYTES + PLACE_BYTES + ID_BYTES))
    one = sent.crossJoin(reports).crossJoin(ears)  # one row each
    return one.select("windows", "messages", "reports", "receivers", safety.alias("safety_mbit"), rate.alias("reports_per_s"), F.try_divide(rate, F.col("receivers")).alias("per_receiver"),
                      full.alias("full_mbit"), minimal.alias("minimal_mbit"), F.try_divide(full, safety).alias("full_ratio"), F.try_divide(minimal, safety).alias("minimal_ratio"))


def regions_per_window(obs: DataFrame, keys: list[str], region: str) -> DataFrame:
    """(median, most): in how many regions a station was heard in one window."""
    per = obs.groupBy(*keys).agg(F.count_distinct(region).alias("n"))
    per = cut(per, "regions")
    q = quantile_numbers(per, {"n": F.col("n")}, {"median": ("n", 0.5)})
    return per.agg(F.lit(q["median"]).cast("double").alias("median"), F.max("n").alias("most"))


# ---- campaign summary
def benign_cam_gaps(tx: DataFrame, slice_ms: float) -> DataFrame:
    """Benign CAM with the time since the sender's CAM before it; each sender's first goes."""
    return gaps(tx.where("attackId = 0 AND msgType = 2"), ["key_seed", "txNodeId"], "txTimeMs", slice_ms, ["msgUid"]).where("gap IS NOT NULL")


def cam_interval(tx: DataFrame, slice_ms: float) -> DataFrame:
    """One row: intervals, median, mean and rate of benign CAM, and how many distinct intervals (few mean a fixed timer)."""
    g = cut(benign_cam_gaps(tx, slice_ms).select("gap"), "gaps")
    q = quantile_numbers(g, {"g": F.col("gap")}, {"median": ("g", 0.5)})
    return g.agg(F.count("*").alias("n"), F.lit(q["median"]).cast("double").alias("median_ms"), F.avg("gap").alias("mean_ms"), F.try_divide(F.lit(1000.0), F.avg("gap")).alias("hz"), F.count_distinct("gap").alias("kinds"))


def dcc_interval(tx: DataFrame, slice_ms: float, edges: list[float] = BUSY) -> DataFrame:
    """(bin, n, median_ms): benign CAM intervals by measured channel busy ratio, bins (lo, hi]; the rest has no bin and goes."""
    g = cut(benign_cam_gaps(tx, slice_ms).select("gap", S.cut_bins("txCbr", edges).alias("bin")).where("bin IS NOT NULL"), "dcc")
    return with_quantiles(g.groupBy("bin").agg(F.count("*").alias("n")), g, ["bin"], {"g": F.col("gap")}, {"median_ms": ("g", 0.5)})


def role_counts(tx: DataFrame, stations: DataFrame) -> DataFrame:
    """(fact, value): stations by role, attack stations by class, messages by type, first and last second of sending."""
    def rows(df: DataFrame, prefix: str, by: Column, n: Column) -> DataFrame:
        return df.groupBy(F.concat(F.lit(prefix), F.coalesce(by.cast("string"), F.lit("unknown"))).alias("fact")).agg(n.cast("long").alias("value"))

    each = rows(stations, "role:", F.col("role"), F.count("*")).unionByName(
        rows(tx.where("attackId > 0"), "class:", F.col("attackId"), F.count_distinct("key_seed", "txNodeId"))).unionByName(
        rows(tx, "message:", F.coalesce(S.code_map("msgType", S.MESSAGE), F.col("msgType").cast("string")), F.count("*")))
    span = tx.agg(F.count("*").alias("messages"), F.count_distinct("key_seed", "txNodeId").alias("senders"), F.floor(F.min("txTimeMs") / 1000).alias("first_s"), F.floor(F.max("txTimeMs") / 1000).alias("last_s"))
    return each.unionByName(span.unpivot([], span.columns, "fact", "value"))


def error_by_class(tx: DataFrame, classes: list[int] = LIARS) -> DataFrame:
    """(attackId, n, median): claim error of the classes that lie about their place."""
    e = claim_error(tx.where(F.col("attackId").isin(*classes)))
    return with_quantiles(e.groupBy("attackId").agg(F.count("err").alias("n")), e, ["attackId"], {"e": F.col("err")}, {"median": ("e", 0.5)})


# ---- corpus card
def card_columns(df: DataFrame, blocks: dict[str, tuple[str, ...]]) -> DataFrame:
    """(block, columns, rows, complete): how many columns each block has by prefix, and rows in which none of them is null."""
    own = {b: [c for c in df.columns if c.startswith(p)] for b, p in blocks.items()}
    full = [F.count_if(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in cols) or "true")).alias(b) for b, cols in own.items()]
    row = df.agg(F.count("*").alias("rows"), *full)
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.lit(len(cols)).cast("long").alias("columns"), F.col(b).alias("complete")) for b, cols in own.items()])).alias("e")
    return row.select("rows", each).select("e.block", "e.columns", "rows", "e.complete")


def card_splits(df: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, class, stations, windows, share): transmitters of each class by frozen split, class null for all of them,
    and the share of the windows; rows without a split come under null."""
    tagged = df.join(splits.select(*STATION, "split").dropDuplicates(STATION), STATION, "left").withColumn("class", F.col("label_attackId"))
    facts = [F.count_distinct(*STATION).alias("stations"), F.count("*").alias("windows")]
    each = tagged.groupBy("split", "class").agg(*facts).unionByName(tagged.groupBy("split").agg(F.lit(None).cast("int").alias("class"), *facts))
    n = df.agg(F.count("*").alias("__n"))
    return each.crossJoin(n).select("split", "class", "stations", "windows", F.try_divide("windows", "__n").alias("share"))  # one row
