"""Message residuals and window features of a link (receiver, claimed station)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .asof import asof_nearest

LINK = ["key_seed", "rxNodeId", "claimedStationId"]
TRACKED, SPAN_DB, EDGE = 8, 2.0, 0.15


def message_residuals(rx: DataFrame, road_length: float | None = 6000.0) -> DataFrame:
    """Adds each message's residuals against the message before it on its link."""
    link = Window.partitionBy(*LINK).orderBy("rxTimeMs", "msgUid")

    def before(c: str) -> Column:
        return F.lag(c).over(link)

    rows = rx.select("*", *[before(c).alias(f"p_{c}") for c in ("rxTimeMs", "claimedX", "claimedY", "claimedSpeed", "claimedHeading")])
    rows = rows.withColumn("claimedDist", S.distance(F.col("claimedX") - F.col("rxX"), F.col("claimedY") - F.col("rxY")))
    rows = rows.withColumn("dt", (F.col("rxTimeMs") - F.col("p_rxTimeMs")) / 1000.0)
    rows = rows.withColumn("dx", S.unwrap(F.col("claimedX") - F.col("p_claimedX"), road_length))
    rows = rows.withColumn("dy", F.col("claimedY") - F.col("p_claimedY"))
    rows = rows.withColumn("moved", S.distance("dx", "dy"))
    px, py = S.dead_reckon("p_claimedX", "p_claimedY", "p_claimedSpeed", "p_claimedHeading", "dt")
    rows = rows.select(
        "*",
        (F.col("moved") - F.col("p_claimedSpeed") * F.col("dt")).alias("dmv"),
        (F.try_divide("moved", "dt") - F.col("claimedSpeed")).alias("ssc"),
        S.distance(S.unwrap(F.col("claimedX") - px, road_length), F.col("claimedY") - py).alias("predict"),
        F.when(F.col("moved") > 1.0, S.angle_gap("claimedHeading", S.bearing("dx", "dy"))).alias("heading"),
        F.try_divide(F.col("claimedSpeed") - F.col("p_claimedSpeed"), F.col("dt")).alias("accel"),
    )
    return rows.drop(*[c for c in rows.columns if c.startswith("p_")])


def seq_gap(rx: DataFrame) -> DataFrame:
    """Adds ``seq_gap``: numbers missing before a message on its link, never negative."""
    order = Window.partitionBy(*LINK).orderBy("seqNo", "rxTimeMs", "msgUid")
    return rx.withColumn("seq_gap", S.at_least(F.col("seqNo") - F.lag("seqNo").over(order) - 1, 0))


def bind_radio(rx: DataFrame, tx: DataFrame, radios: DataFrame) -> DataFrame:
    """Messages with the radio of their sender; only the link (msgUid, txNodeId) of the truth is read."""
    nodes = tx.select("key_seed", "msgUid", "txNodeId")
    return rx.join(nodes, ["key_seed", "msgUid"], "left").join(radios, ["key_seed", "txNodeId"], "left")


def mode_by(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Most common value of a column for each key; the smallest of equally common ones."""
    return df.groupBy(*keys).agg(F.mode(column, True).alias(name))


def radio_match(rx: DataFrame, pssch: DataFrame, tolerance: float, slice_of: float | None = None) -> DataFrame:
    """Each message with the nearest data-channel reception of its radio."""
    return asof_nearest(rx, pssch, "rxTimeMs", "timeMs", {"rxNodeId": "rxNodeId", "radio": "txRnti"},
                        ["sinr", "tbler", "corrupt", "mcs"], "msgUid", "radioUid", tolerance, slice_of)


def power_match(rx: DataFrame, pscch: DataFrame, tolerance: float, slice_of: float | None = None) -> DataFrame:
    """Each message with the power of the nearest decoded control channel of its radio."""
    return asof_nearest(rx, pscch.where("corrupt = 0"), "rxTimeMs", "timeMs", {"rxNodeId": "rxNodeId", "radio": "txRnti"},
                        ["slRsrpDbm"], "msgUid", "radioUid", tolerance, slice_of)


def owned_channels(pscch: DataFrame, rx: DataFrame, slice_of: float | None = None) -> DataFrame:
    """Each decoded control channel with the identity whose message from that radio is nearest in time."""
    heard = rx.where("radio IS NOT NULL").select("rxNodeId", "radio", "rxTimeMs", "claimedStationId", "msgUid")
    return asof_nearest(pscch.where("corrupt = 0"), heard, "timeMs", "rxTimeMs", {"rxNodeId": "rxNodeId", "txRnti": "radio"},
                        ["claimedStationId"], "radioUid", "msgUid", slice_of=slice_of)


def rsrp_stats(owned: DataFrame, window_ms: float) -> DataFrame:
    owned = owned.where("claimedStationId IS NOT NULL").withColumn("window", S.window_index("timeMs", window_ms))
    return owned.groupBy(*LINK, "window").agg(
        F.avg("slRsrpDbm").alias("phy_rsrp_mean"), F.stddev_samp("slRsrpDbm").alias("phy_rsrp_std"),
        F.min("slRsrpDbm").alias("phy_rsrp_min"), F.max("slRsrpDbm").alias("phy_rsrp_max"), F.count("slRsrpDbm").alias("phy_rsrp_count"),
    )


def channel_load(pscch: DataFrame, window_ms: float) -> DataFrame:
    """Receptions and their corrupt share for each receiver and window, corrupt ones included."""
    return pscch.groupBy("key_seed", "rxNodeId", S.window_index("timeMs", window_ms).alias("window")).agg(
        F.count("*").alias("phy_cbr_pscch_rate"), F.avg("corrupt").alias("phy_pscch_corrupt_rate"))


def neighbours(rx: DataFrame, window_ms: float) -> DataFrame:
    return rx.groupBy("key_seed", "rxNodeId", S.window_index("rxTimeMs", window_ms).alias("window")).agg(
        F.count_distinct("claimedStationId").alias("phy_neighbours"))


def window_features(rows: DataFrame, window_ms, extra_keys: list[str] | None = None, window: Column | None = None) -> DataFrame:
    """One pass over residual rows (with ``seq_gap``) to the application features of each link and window.

    Radio statistics are added where the rows carry radio columns.  A stream gives its own ``window``, an expression of
    its event time.
    """
    rows = rows.withColumn("window", S.window_index("rxTimeMs", window_ms) if window is None else window)
    gaps = F.sum("seq_gap")
    aggs = [
        F.count("*").alias("app_n_msgs"), F.count_if(F.col("msgType") == 2).alias("app_n_cam"),
        F.count_if(F.col("msgType") == 1).alias("app_n_denm"), F.count_if(F.col("msgType") == 14).alias("app_n_cpm"),
        F.avg("dt").alias("app_iat_mean"), F.stddev_samp("dt").alias("app_iat_std"), F.min("dt").alias("app_iat_min"),
        F.avg("claimedDist").alias("app_claimed_dist_mean"), F.stddev_samp("claimedDist").alias("app_claimed_dist_std"),
        F.avg("claimedSpeed").alias("app_claimed_speed_mean"), F.stddev_samp("claimedSpeed").alias("app_claimed_speed_std"),
        F.avg("dmv").alias("app_dmv_mean"), F.max(F.abs("dmv")).alias("app_dmv_absmax"),
        F.avg("ssc").alias("app_ssc_mean"), F.max(F.abs("ssc")).alias("app_ssc_absmax"),
        F.avg("predict").alias("app_predict_mean"), F.max("predict").alias("app_predict_max"),
        F.avg("heading").alias("app_heading_mean"), F.max("heading").alias("app_heading_max"),
        F.max(F.abs("accel")).alias("app_accel_absmax"),
        F.coalesce(gaps, F.lit(0)).alias("app_seq_gaps"),
        (F.coalesce(gaps, F.lit(0)) / F.greatest(F.lit(1.0), F.coalesce(gaps, F.lit(0)) + F.count("*"))).alias("app_seq_loss_rate"),
    ]
    if "sinr" in rows.columns:
        rows = rows.withColumn("sinr_db", S.to_db("sinr"))
        aggs += [
            F.avg("sinr_db").alias("phy_sinr_db_mean"), F.stddev_samp("sinr_db").alias("phy_sinr_db_std"),
            F.avg("tbler").alias("phy_tbler_mean"), F.avg("corrupt").alias("phy_corrupt_rate"), F.avg("mcs").alias("phy_mcs_mean"),
        ]
    if "slRsrpDbm" in rows.columns:
        rows = rows.withColumn("rsrp_resid", F.col("slRsrpDbm") - S.predicted_rsrp("claimedDist"))
        aggs += [
            F.avg("rsrp_resid").alias("phy_rsrp_resid_mean"), F.stddev_samp("rsrp_resid").alias("phy_rsrp_resid_std"),
            F.max(F.abs("rsrp_resid")).alias("phy_rsrp_resid_absmax"),
        ]
    return rows.groupBy(*LINK, *(extra_keys or []), "window").agg(*aggs)


def window_sweep(rows: DataFrame, widths: list[float]) -> DataFrame:
    """The same features for several window lengths in one job, the length being a key."""
    each = rows.withColumn("width_ms", F.explode(F.array(*[F.lit(float(w)) for w in widths])))
    return window_features(each, F.col("width_ms"), ["width_ms"])


def long_features(rows: DataFrame, long_ms: float) -> DataFrame:
    """All long-window statistics of a link in one aggregation.

    Tracking: how received power follows the power that the claimed distance implies.  Closest approach: when
    the claimed distance is least against when the power is strongest.  Unused ones are pruned by the optimizer.
    """
    heard = rows.where("slRsrpDbm IS NOT NULL AND claimedDist IS NOT NULL").select(
        *LINK, S.window_index("rxTimeMs", long_ms).alias("long_window"), "claimedDist", "rxTimeMs", "msgUid",
        F.col("slRsrpDbm").alias("m"), S.predicted_rsrp("claimedDist").alias("p"))
    g = heard.groupBy(*LINK, "long_window").agg(
        F.count("*").alias("n"), F.covar_pop("m", "p").alias("cov"), F.var_pop("m").alias("vm"), F.var_pop("p").alias("vp"),
        (F.max("p") - F.min("p")).alias("phy_track_span"), F.min(F.struct("claimedDist", "rxTimeMs", "msgUid", "p")).alias("near"),
        F.min(F.struct((-F.col("m")).alias("neg"), "rxTimeMs", "msgUid")).alias("loud"), F.min("rxTimeMs").alias("t0"), F.max("rxTimeMs").alias("t1"))
    tracked = (F.col("n") >= TRACKED) & (F.col("phy_track_span") >= SPAN_DB) & (F.col("vm") > 0) & (F.col("vp") > 0)
    span, at = F.col("t1") - F.col("t0"), F.col("near.rxTimeMs")
    passed = (at - F.col("t0") > EDGE * span) & (F.col("t1") - at > EDGE * span) & (F.col("n") >= TRACKED) & (span > 0)
    lag = (F.col("loud.rxTimeMs") - at) / 1000.0
    return g.select(
        *LINK, "long_window", F.when(tracked, F.col("cov") / F.sqrt(F.col("vm") * F.col("vp"))).alias("phy_track_corr"),
        F.when(tracked, F.col("cov") / F.col("vp")).alias("phy_track_slope"),
        F.when(tracked, F.sqrt(S.at_least(F.col("vm") + F.col("vp") - 2 * F.col("cov"), 0.0))).alias("phy_track_resid_std"), "phy_track_span",
        F.when(passed, lag).alias("phy_closest_lag_s"), F.when(passed, F.abs(lag)).alias("phy_closest_lag_abs"),
        F.when(passed, -F.col("loud.neg") - F.col("near.p")).alias("phy_closest_power_gap"))


def tracking(rows: DataFrame, long_ms: float) -> DataFrame:
    f = long_features(rows, long_ms)
    return f.select(*LINK, "long_window", *[c for c in f.columns if c.startswith("phy_track")])


def closest_approach(rows: DataFrame, long_ms: float) -> DataFrame:
    f = long_features(rows, long_ms)
    return f.select(*LINK, "long_window", *[c for c in f.columns if c.startswith("phy_closest")])


def merge_long(track: DataFrame, closest: DataFrame) -> DataFrame:
    return track.join(closest, [*LINK, "long_window"], "full")


def assemble(agg: DataFrame, power: DataFrame, load: DataFrame, long: DataFrame, window_ms: float, long_ms: float) -> DataFrame:
    """All window features side by side; long-window columns are copied to each of their windows."""
    out = agg.join(power, [*LINK, "window"], "left").join(load, ["key_seed", "rxNodeId", "window"], "left")
    out = out.withColumn("long_window", S.window_index(F.col("window") * window_ms, long_ms))
    out = out.join(long, [*LINK, "long_window"], "left").drop("long_window")
    return out.withColumn("phy_rsrp_vs_claimed", F.col("phy_rsrp_mean") - S.predicted_rsrp("app_claimed_dist_mean"))


def voiceprint(agg: DataFrame, apart: float = 30.0, crowded: int = 64) -> DataFrame:
    """Smallest power difference to another station of the same receiver and window that claims to be ``apart`` or more away.

    Stations of a receiver and window are compared two by two while they are at most ``crowded``.  In larger
    groups they are ranked by claimed distance: those far below are a prefix of the ranks, those far above a suffix.  A tree
    of halves over the ranks splits either into a logarithmic number of nodes, each of them one list sorted by power, in
    which a station finds the nearest power before and after its own: n log n rows in a group of n.
    """
    group = ["key_seed", "rxNodeId", "window"]
    mine = agg.where("phy_rsrp_mean IS NOT NULL AND app_claimed_dist_mean IS NOT NULL")
    mine = mine.select(*group, "claimedStationId", F.col("phy_rsrp_mean").alias("r"), F.col("app_claimed_dist_mean").alias("x"))
    large = mine.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > crowded)
    some, many = mine.join(large, group, "left_anti"), mine.join(large, group)
    other = some.select(*group, F.col("claimedStationId").alias("o"), F.col("r").alias("r2"), F.col("x").alias("x2"))
    far = (F.col("claimedStationId") != F.col("o")) & (F.abs(F.col("x") - F.col("x2")) >= apart)
    few = some.join(other, group).where(far).groupBy(*LINK, "window").agg(F.min(F.abs(F.col("r") - F.col("r2"))).alias("d"))

    keys = ", ".join(group)
    many = many.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("x", "claimedStationId")).cast("long") - 1)
    for name, way in (("below", "x"), ("above", "x DESC")):  # how many stations are far on either side
        many = many.withColumn(name, F.expr(f"count(1) OVER (PARTITION BY {keys} ORDER BY {way} RANGE BETWEEN UNBOUNDED PRECEDING AND {float(apart)}D PRECEDING)"))
    many = many.withColumn("top", F.ceil(F.log2("n")).cast("int"))

    def bits(c: str) -> Column:
        return F.filter(F.sequence(F.lit(0), F.col("top")), lambda b: F.call_function("getbit", F.col(c), b) == 1)

    def node(level: Column, index: Column) -> Column:
        return F.struct(level.alias("level"), index.cast("long").alias("index"))

    def shifted(c: Column, b: Column) -> Column:
        return F.call_function("shiftright", c, b)

    # a prefix of p ranks is a node for each set bit of p; a suffix likewise, counted from the end of the whole tree
    many = many.withColumn("rest", F.when(F.col("above") > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("top")) - (F.col("n") - F.col("above"))).otherwise(F.lit(0).cast("long")))
    low = F.transform(bits("below"), lambda b: node(b, shifted(F.col("below"), b) - 1))
    high = F.transform(bits("rest"), lambda b: node(b, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("top") - b) - shifted(F.col("rest"), b)))
    own = F.transform(F.sequence(F.lit(0), F.col("top")), lambda b: node(b, shifted(F.col("rank"), b)))
    asks = many.select(*LINK, "window", "r", F.explode(F.concat(low, high)).alias("node"), F.lit(0).alias("side"))
    gives = many.select(*LINK, "window", "r", F.explode(own).alias("node"), F.lit(1).alias("side"))
    order = Window.partitionBy(*group, "node.level", "node.index").orderBy("r", "side")
    power = F.when(F.col("side") == 1, F.col("r"))
    before = F.last(power, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    onward = Window.partitionBy(*group, "node.level", "node.index").orderBy(F.desc("r"), F.desc("side"))  # the reverse: a frame that looks ahead is read anew for each row
    after = F.last(power, ignorenulls=True).over(onward.rowsBetween(Window.unboundedPreceding, 0))
    wide = asks.unionByName(gives).withColumn("d", F.least(F.col("r") - before, after - F.col("r"))).where("side = 0")
    best = few.unionByName(wide.groupBy(*LINK, "window").agg(F.min("d").alias("d"))).withColumnRenamed("d", "phy_rsrp_voiceprint_min")
    return agg.join(best, [*LINK, "window"], "left")


def versus_bin(agg: DataFrame, value: str, name: str, step: float = 3.0) -> DataFrame:
    """A value minus the mean of its power bin over the seed; null where the power is.

    The bin means are a grouped aggregate joined back, so a crowded bin is never one task.  The last bits of a mean
    depend on the order of its terms; they are rounded away, so that a mean halfway between two bins goes to the even one.
    """
    binned = agg.withColumn("__bin", F.rint(F.round(F.col("phy_rsrp_mean") / step, 10)))
    means = binned.where("__bin IS NOT NULL").groupBy("key_seed", "__bin").agg(F.avg(value).alias("__mean"))
    return binned.join(means, ["key_seed", "__bin"], "left").withColumn(name, F.col(value) - F.col("__mean")).drop("__bin", "__mean")


def attach_roles(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Observer role by node id, ``unknown`` where the register lacks it."""
    roles = stations.select(F.col("nodeId").alias("rxNodeId"), F.col("role").alias("key_observer_role")).dropDuplicates(["rxNodeId"])
    return df.join(roles, "rxNodeId", "left").withColumn("key_observer_role", F.coalesce("key_observer_role", F.lit("unknown")))


def label_windows(tx: DataFrame, rx: DataFrame, window_ms: float) -> DataFrame:
    """Labels of each link and window: most common class and sender, share of the class, clean at 0.9."""
    j = rx.join(tx.select("key_seed", "msgUid", "attackId", "txNodeId"), ["key_seed", "msgUid"], "left")
    j = j.withColumn("window", S.window_index("rxTimeMs", window_ms))
    each = j.groupBy(*LINK, "window", "attackId").agg(F.count("*").alias("n"))
    purity = each.groupBy(*LINK, "window").agg((F.max(F.when(F.col("attackId").isNotNull(), F.col("n"))) / F.sum("n")).alias("label_attack_purity"))
    lab = j.groupBy(*LINK, "window").agg(F.mode("attackId", True).alias("label_attackId"), F.mode("txNodeId", True).alias("label_txNodeId"))
    return lab.join(purity, [*LINK, "window"]).select(
        "*", (F.col("label_attackId") > 0).cast("int").alias("label_is_attack"), (F.col("label_attack_purity") >= 0.9).cast("int").alias("label_clean"))


def compare_features(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(feature, n, max_diff, null_mismatch): two builds of the same rows, null-aware."""
    left = a.select(*keys, F.struct(*columns).alias("a"))
    both = left.join(b.select(*keys, F.struct(*columns).alias("b")), keys)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a.{c}").cast("double").alias("x"), F.col(f"b.{c}").cast("double").alias("y")) for c in columns]))
    return both.select(each.alias("e")).groupBy("e.feature").agg(
        F.count("*").alias("n"), F.max(F.abs(F.col("e.x") - F.col("e.y"))).alias("max_diff"),
        F.count_if(F.col("e.x").isNull() != F.col("e.y").isNull()).alias("null_mismatch"))
