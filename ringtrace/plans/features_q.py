"""Queries of the feature build, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, features as X
from ..sources import adapters as A
from .ctes import cte, gap, pmod, rsrp, unwrap, with_
from .registry import query

W, LONG, TOL = A.WEEK_MS, A.WEEK_MS * 10, 1_800_000
LINK = "key_seed, rxNodeId, claimedStationId"

cte("res0", "rx", f"""SELECT *, sqrt((claimedX - rxX) ^ 2 + (claimedY - rxY) ^ 2) AS claimedDist, (rxTimeMs - lag(rxTimeMs) OVER w) / 1000.0::DOUBLE AS dt,
 {unwrap('claimedX - lag(claimedX) OVER w')} AS dx, claimedY - lag(claimedY) OVER w AS dy, lag(claimedX) OVER w AS px, lag(claimedY) OVER w AS py,
 lag(claimedSpeed) OVER w AS ps, lag(claimedHeading) OVER w AS ph FROM rx WINDOW w AS (PARTITION BY {LINK} ORDER BY rxTimeMs, msgUid)""")
cte("res", "res0", f"""SELECT * EXCLUDE (px, py, ps, ph), moved - ps * dt AS dmv, moved / nullif(dt, 0) - claimedSpeed AS ssc,
 sqrt({unwrap('claimedX - (px + ps * dt * sin(radians(ph)))')} ^ 2 + (claimedY - (py + ps * dt * cos(radians(ph)))) ^ 2) AS predict,
 CASE WHEN moved > 1.0 THEN {gap('claimedHeading', pmod('degrees(atan2(dx, dy))'))} END AS heading, (claimedSpeed - ps) / nullif(dt, 0) AS accel
 FROM (SELECT *, sqrt(dx ^ 2 + dy ^ 2) AS moved FROM res0)""")
cte("gaps", "rx", f"""SELECT msgUid, CASE WHEN g < 0 THEN 0 ELSE g END AS seq_gap FROM (SELECT msgUid,
 seqNo - lag(seqNo) OVER (PARTITION BY {LINK} ORDER BY seqNo, rxTimeMs, msgUid) - 1 AS g FROM rx)""")


def matched(left: str, right: str, lt: str, rt: str, on: str, lid: str, rid: str, tol: str, cols: str) -> str:
    """Nearest row of ``right`` for each row of ``left`` by join and rank."""
    within = f" AND abs(r.{rt} - l.{lt}) <= {tol}" if tol else ""
    return f"""SELECT {lid}, {cols} FROM (SELECT l.{lid} AS {lid}, r.* EXCLUDE ({rid}), row_number() OVER (PARTITION BY l.{lid} ORDER BY abs(r.{rt} - l.{lt}), r.{rt} > l.{lt},
 CASE WHEN r.{rt} <= l.{lt} THEN -r.{rid} ELSE r.{rid} END) AS k FROM {left} l JOIN {right} r ON {on}{within}) WHERE k = 1"""


cte("near_radio", "rx pssch", matched("rx", "pssch", "rxTimeMs", "timeMs", "l.rxNodeId = r.rxNodeId AND l.claimedStationId = r.txRnti", "msgUid", "radioUid", str(TOL), "sinr, tbler, corrupt, mcs"))
cte("clear", "pssch", "SELECT * FROM pssch WHERE corrupt = 0")
cte("near_power", "rx clear", matched("rx", "clear", "rxTimeMs", "timeMs", "l.rxNodeId = r.rxNodeId AND l.claimedStationId = r.txRnti", "msgUid", "radioUid", str(TOL), "slRsrpDbm"))
cte("heard", "rx", "SELECT msgUid, rxNodeId AS rx2, claimedStationId, rxTimeMs FROM rx")
cte("owner", "clear heard", matched("clear", "heard", "timeMs", "rxTimeMs", "l.rxNodeId = r.rx2 AND l.txRnti = r.claimedStationId", "radioUid", "msgUid", "", "claimedStationId"))
cte("fullrx", "res gaps near_radio near_power", f"""SELECT r.*, g.seq_gap, n.sinr, n.tbler, n.corrupt, n.mcs, p.slRsrpDbm, CAST(floor(r.rxTimeMs / {W}) AS BIGINT) AS "window"
 FROM res r JOIN gaps g USING (msgUid) LEFT JOIN near_radio n USING (msgUid) LEFT JOIN near_power p USING (msgUid)""")
APP = """count(*) AS app_n_msgs, count(*) FILTER (msgType = 2) AS app_n_cam, count(*) FILTER (msgType = 1) AS app_n_denm, count(*) FILTER (msgType = 14) AS app_n_cpm,
 avg(dt) AS app_iat_mean, stddev_samp(dt) AS app_iat_std, min(dt) AS app_iat_min, avg(claimedDist) AS app_claimed_dist_mean, stddev_samp(claimedDist) AS app_claimed_dist_std,
 avg(claimedSpeed) AS app_claimed_speed_mean, stddev_samp(claimedSpeed) AS app_claimed_speed_std, avg(dmv) AS app_dmv_mean, max(abs(dmv)) AS app_dmv_absmax,
 avg(ssc) AS app_ssc_mean, max(abs(ssc)) AS app_ssc_absmax, avg(predict) AS app_predict_mean, max(predict) AS app_predict_max, avg(heading) AS app_heading_mean,
 max(heading) AS app_heading_max, max(abs(accel)) AS app_accel_absmax, CAST(coalesce(sum(seq_gap), 0) AS BIGINT) AS app_seq_gaps,
 CAST(coalesce(sum(seq_gap), 0) AS DOUBLE) / greatest(1.0::DOUBLE, coalesce(sum(seq_gap), 0) + count(*)) AS app_seq_loss_rate"""
PHY = f""", avg(db) AS phy_sinr_db_mean, stddev_samp(db) AS phy_sinr_db_std, avg(tbler) AS phy_tbler_mean, avg(corrupt) AS phy_corrupt_rate, avg(mcs) AS phy_mcs_mean,
 avg(rr) AS phy_rsrp_resid_mean, stddev_samp(rr) AS phy_rsrp_resid_std, max(abs(rr)) AS phy_rsrp_resid_absmax"""
APP_D = "app_iat_mean app_iat_std app_iat_min app_claimed_dist_mean app_claimed_dist_std app_claimed_speed_mean app_claimed_speed_std app_dmv_mean app_dmv_absmax app_ssc_mean app_ssc_absmax app_predict_mean app_predict_max app_heading_mean app_heading_max app_accel_absmax app_seq_loss_rate"
PHY_D = "phy_sinr_db_mean phy_sinr_db_std phy_tbler_mean phy_corrupt_rate phy_mcs_mean phy_rsrp_resid_mean phy_rsrp_resid_std phy_rsrp_resid_absmax"
cte("g01", "fullrx", f"""SELECT {LINK}, "window", {APP}{PHY} FROM (SELECT *, CASE WHEN sinr > 0 THEN 10 * log10(sinr) END AS db, slRsrpDbm - {rsrp('claimedDist')} AS rr FROM fullrx) GROUP BY ALL""")
cte("g02", "pssch owner", f"""SELECT key_seed, rxNodeId, o.claimedStationId, CAST(floor(timeMs / {W}) AS BIGINT) AS "window", avg(slRsrpDbm) AS phy_rsrp_mean,
 stddev_samp(slRsrpDbm) AS phy_rsrp_std, min(slRsrpDbm) AS phy_rsrp_min, max(slRsrpDbm) AS phy_rsrp_max, count(*) AS phy_rsrp_count
 FROM pssch JOIN owner o USING (radioUid) GROUP BY ALL""")
cte("g03", "pssch", f"""SELECT key_seed, rxNodeId, CAST(floor(timeMs / {W}) AS BIGINT) AS "window", count(*) AS phy_cbr_pscch_rate, avg(corrupt) AS phy_pscch_corrupt_rate FROM pssch GROUP BY ALL""")
cte("g04", "rx", f"""SELECT key_seed, rxNodeId, CAST(floor(rxTimeMs / {W}) AS BIGINT) AS "window", count(DISTINCT claimedStationId) AS phy_neighbours FROM rx GROUP BY ALL""")
cte("pairs", "fullrx", f"SELECT *, {rsrp('claimedDist')} AS p, CAST(floor(rxTimeMs / {LONG}) AS BIGINT) AS long_window FROM fullrx WHERE slRsrpDbm IS NOT NULL")
cte("g05", "pairs", f"""SELECT {LINK}, long_window, CASE WHEN ok THEN cov / sqrt(vm * vp) END AS phy_track_corr, CASE WHEN ok THEN cov / vp END AS phy_track_slope,
 CASE WHEN ok THEN sqrt(greatest(vm + vp - 2 * cov, 0)) END AS phy_track_resid_std, span AS phy_track_span FROM (SELECT *, n >= 8 AND span >= 2 AND vm > 0 AND vp > 0 AS ok FROM
 (SELECT {LINK}, long_window, count(*) AS n, covar_pop(slRsrpDbm, p) AS cov, var_pop(slRsrpDbm) AS vm, var_pop(p) AS vp, max(p) - min(p) AS span FROM pairs GROUP BY ALL))""")
cte("g06", "pairs", f"""SELECT {LINK}, long_window, CASE WHEN ok THEN (tp - tc) / 1000 END AS phy_closest_lag_s, CASE WHEN ok THEN abs(tp - tc) / 1000 END AS phy_closest_lag_abs,
 CASE WHEN ok THEN peak - pc END AS phy_closest_power_gap FROM (SELECT *, tc - t0 > 0.15::DOUBLE * (t1 - t0) AND t1 - tc > 0.15::DOUBLE * (t1 - t0) AND n >= 8 AND t1 > t0 AS ok FROM
 (SELECT {LINK}, long_window, count(*) AS n, min(rxTimeMs) AS t0, max(rxTimeMs) AS t1, first(rxTimeMs ORDER BY claimedDist, rxTimeMs, msgUid) AS tc,
 first(p ORDER BY claimedDist, rxTimeMs, msgUid) AS pc, first(rxTimeMs ORDER BY slRsrpDbm DESC, rxTimeMs, msgUid) AS tp, max(slRsrpDbm) AS peak FROM pairs GROUP BY ALL))""")
cte("j06", "g01 g02 g03 g04 g05 g06", f"""SELECT g01.*, phy_rsrp_mean, phy_rsrp_std, phy_rsrp_min, phy_rsrp_max, phy_rsrp_count, phy_cbr_pscch_rate, phy_pscch_corrupt_rate, phy_neighbours,
 phy_track_corr, phy_track_slope, phy_track_resid_std, phy_track_span, phy_closest_lag_s, phy_closest_lag_abs, phy_closest_power_gap,
 phy_rsrp_mean - {rsrp('app_claimed_dist_mean')} AS phy_rsrp_vs_claimed FROM g01 LEFT JOIN g02 USING ({LINK}, "window") LEFT JOIN g03 USING (key_seed, rxNodeId, "window")
 LEFT JOIN g04 USING (key_seed, rxNodeId, "window") LEFT JOIN g05 ON g01.key_seed = g05.key_seed AND g01.rxNodeId = g05.rxNodeId AND g01.claimedStationId = g05.claimedStationId
 AND CAST(floor(g01."window" * {W} / {LONG}::DOUBLE) AS BIGINT) = g05.long_window LEFT JOIN g06 ON g01.key_seed = g06.key_seed AND g01.rxNodeId = g06.rxNodeId AND g01.claimedStationId = g06.claimedStationId
 AND g05.long_window = g06.long_window""")
LONG_D = "phy_track_corr phy_track_slope phy_track_resid_std phy_track_span phy_closest_lag_s phy_closest_lag_abs phy_closest_power_gap"


def rx_radio(spark, d):
    """Messages with residuals, gaps and radio number (here the station's own)."""
    rows = X.seq_gap(X.message_residuals(A.rx(spark, d)))
    return rows.withColumn("radio", F.col("claimedStationId"))


def full(spark, d):
    rows, radio = rx_radio(spark, d), A.pssch(spark, d)
    return X.power_match(X.radio_match(rows, radio, TOL), radio, TOL).drop("radio")


def owned(spark, d):
    radio = A.pssch(spark, d).drop("claimedStationId")
    return X.owned_channels(radio, A.rx(spark, d).withColumn("radio", F.col("claimedStationId")))


def assembled(spark, d):
    rows = full(spark, d)
    load = X.channel_load(A.pssch(spark, d), W).join(X.neighbours(A.rx(spark, d), W), ["key_seed", "rxNodeId", "window"], "full")
    long = X.long_features(rows, LONG)
    return X.assemble(X.window_features(rows, W), X.rsrp_stats(owned(spark, d), W), load, long, W, LONG)


RES_D = "dt dx moved dmv ssc predict heading accel claimedDist"


@query("w01_message_residuals", with_("res", "SELECT msgUid, dt, dx, moved, dmv, ssc, predict, heading, accel, claimedDist FROM res"), RES_D)
def w01(spark, d):
    return X.message_residuals(A.rx(spark, d)).select("msgUid", *RES_D.split())


@query("w02_seq_gap", with_("gaps", "SELECT * FROM gaps"))
def w02(spark, d):
    return X.seq_gap(A.rx(spark, d)).select("msgUid", "seq_gap")


@query("j01_bind_radio", with_("rx tx pssch", """SELECT rx.msgUid, t.txNodeId, m.radio FROM rx LEFT JOIN tx t USING (msgUid) LEFT JOIN
 (SELECT txRnti AS txNodeId, first(r ORDER BY n DESC, r) AS radio FROM (SELECT txRnti, rxNodeId AS r, count(*) AS n FROM pssch GROUP BY ALL) GROUP BY 1) m USING (txNodeId)"""))
def j01(spark, d):
    sent = A.pssch(spark, d).withColumnRenamed("txRnti", "txNodeId")
    radios = X.mode_by(sent, ["key_seed", "txNodeId"], "rxNodeId", "radio")
    return X.bind_radio(A.rx(spark, d), A.tx(spark, d), radios).select("msgUid", "txNodeId", "radio")


@query("j02_asof_data_channel", with_("rx near_radio", "SELECT msgUid, sinr, tbler, corrupt, mcs FROM rx LEFT JOIN near_radio USING (msgUid)"), "sinr tbler")
def j02(spark, d):
    rows = A.rx(spark, d).withColumn("radio", F.col("claimedStationId"))
    return X.radio_match(rows, A.pssch(spark, d), TOL, A.WEEK_MS).select("msgUid", "sinr", "tbler", "corrupt", "mcs")


@query("j03_asof_control_power", with_("rx near_power", "SELECT msgUid, slRsrpDbm FROM rx LEFT JOIN near_power USING (msgUid)"), "slRsrpDbm")
def j03(spark, d):
    rows = A.rx(spark, d).withColumn("radio", F.col("claimedStationId"))
    return X.power_match(rows, A.pssch(spark, d), TOL, A.WEEK_MS).select("msgUid", "slRsrpDbm")


@query("j04_channel_owner", with_("owner", "SELECT radioUid, claimedStationId FROM owner"))
def j04(spark, d):
    return owned(spark, d).where("claimedStationId IS NOT NULL").select("radioUid", "claimedStationId")


@query("j05_position_at", with_("rx tx", """SELECT rx.msgUid, coalesce((SELECT first(trueX ORDER BY txTimeMs, msgUid) FROM tx WHERE tx.txNodeId = rx.claimedStationId AND tx.txTimeMs >= rx.rxTimeMs + 60000 AND tx.txTimeMs =
 (SELECT min(txTimeMs) FROM tx t2 WHERE t2.txNodeId = rx.claimedStationId AND t2.txTimeMs >= rx.rxTimeMs + 60000)),
 (SELECT last(trueX ORDER BY txTimeMs, msgUid) FROM tx WHERE tx.txNodeId = rx.claimedStationId)) AS trueX FROM rx"""), "trueX")
def j05(spark, d):
    asked = A.rx(spark, d).select("msgUid", F.col("claimedStationId").alias("txNodeId"), (F.col("rxTimeMs") + 60000).alias("t"))
    return asof.position_at(asked, A.tx(spark, d), ["txNodeId"], "t", "txTimeMs", ["trueX"], "msgUid").select("msgUid", "trueX")


@query("g01_window_features", with_("g01", "SELECT * FROM g01"), f"{APP_D} {PHY_D}")
def g01(spark, d):
    return X.window_features(full(spark, d), W)


@query("g02_rsrp_stats", with_("g02", "SELECT * FROM g02"), "phy_rsrp_mean phy_rsrp_std phy_rsrp_min phy_rsrp_max")
def g02(spark, d):
    return X.rsrp_stats(owned(spark, d), W)


@query("g03_channel_load", with_("g03", "SELECT * FROM g03"), "phy_pscch_corrupt_rate")
def g03(spark, d):
    return X.channel_load(A.pssch(spark, d), W)


@query("g04_neighbours", with_("g04", "SELECT * FROM g04"))
def g04(spark, d):
    return X.neighbours(A.rx(spark, d), W)


@query("g05_tracking", with_("g05", "SELECT * FROM g05"), "phy_track_corr phy_track_slope phy_track_resid_std phy_track_span")
def g05(spark, d):
    return X.tracking(full(spark, d), LONG)


@query("g06_closest_approach", with_("g06", "SELECT * FROM g06"), "phy_closest_lag_s phy_closest_lag_abs phy_closest_power_gap")
def g06(spark, d):
    return X.closest_approach(full(spark, d), LONG)


@query("j07_long_window_merge", with_("g05 g06", f"SELECT * FROM g05 FULL JOIN g06 USING ({LINK}, long_window)"), LONG_D)
def j07(spark, d):
    rows = full(spark, d)
    return X.merge_long(X.tracking(rows, LONG), X.closest_approach(rows, LONG))


@query("g07_radio_of_node", with_("pssch", """SELECT txRnti AS node, first(mcs ORDER BY n DESC, mcs) AS mcs FROM (SELECT txRnti, mcs, count(*) AS n FROM pssch GROUP BY ALL) GROUP BY 1"""))
def g07(spark, d):
    return X.mode_by(A.pssch(spark, d).withColumnRenamed("txRnti", "node"), ["node"], "mcs", "m").select("node", F.col("m").alias("mcs"))


ALL_D = f"{APP_D} {PHY_D} phy_rsrp_mean phy_rsrp_std phy_rsrp_min phy_rsrp_max phy_pscch_corrupt_rate {LONG_D} phy_rsrp_vs_claimed"


@query("j06_assembled_features", with_("j06", "SELECT * FROM j06"), ALL_D)
def j06(spark, d):
    return assembled(spark, d)


@query("j13_voiceprint", with_("j06", f"""SELECT {LINK}, "window", (SELECT min(abs(b.phy_rsrp_mean - a.phy_rsrp_mean)) FROM j06 b WHERE b.key_seed = a.key_seed AND b.rxNodeId = a.rxNodeId AND b."window" = a."window"
 AND b.claimedStationId <> a.claimedStationId AND abs(b.app_claimed_dist_mean - a.app_claimed_dist_mean) >= 30) AS phy_rsrp_voiceprint_min FROM j06 a"""), "phy_rsrp_voiceprint_min")
def j13(spark, d):
    agg = X.window_features(X.seq_gap(X.message_residuals(A.rx(spark, d))), W).join(X.rsrp_stats(owned(spark, d), W), [*X.LINK, "window"], "left")
    return X.voiceprint(agg).select(*X.LINK, "window", "phy_rsrp_voiceprint_min")


@query("g10_versus_power_bin", with_("j06", f"""SELECT {LINK}, "window", CASE WHEN b IS NOT NULL THEN app_seq_loss_rate - avg(app_seq_loss_rate) OVER (PARTITION BY key_seed, b) END AS phy_loss_vs_rsrp,
 CASE WHEN b IS NOT NULL THEN phy_tbler_mean - avg(phy_tbler_mean) OVER (PARTITION BY key_seed, b) END AS phy_tbler_vs_rsrp FROM (SELECT *, round_even(phy_rsrp_mean / 3.0::DOUBLE, 0) AS b FROM j06)"""), "phy_loss_vs_rsrp phy_tbler_vs_rsrp")
def g10(spark, d):
    agg = assembled(spark, d)
    out = X.versus_bin(X.versus_bin(agg, "app_seq_loss_rate", "phy_loss_vs_rsrp"), "phy_tbler_mean", "phy_tbler_vs_rsrp")
    return out.select(*X.LINK, "window", "phy_loss_vs_rsrp", "phy_tbler_vs_rsrp")


@query("g45_window_sweep", with_("fullrx", f"""SELECT {LINK}, width_ms, CAST(floor(rxTimeMs / width_ms) AS BIGINT) AS "window", {APP} FROM fullrx, (VALUES (86400000.0::DOUBLE), (604800000.0::DOUBLE)) w(width_ms) GROUP BY ALL"""), f"{APP_D} width_ms")
def g45(spark, d):
    return X.window_sweep(X.seq_gap(X.message_residuals(A.rx(spark, d))), [86_400_000, 604_800_000])


@query("j08_observer_roles", with_("rx stations", "SELECT msgUid, coalesce(role, 'unknown') AS key_observer_role FROM rx LEFT JOIN stations ON nodeId = rxNodeId"))
def j08(spark, d):
    return X.attach_roles(A.rx(spark, d), A.stations(spark, d)).select("msgUid", "key_observer_role")


cte("labels_w", "rx tx", f"""SELECT {LINK}, "window", first(attackId ORDER BY n DESC, attackId) AS label_attackId, max(n) / CAST(sum(n) AS DOUBLE) AS label_attack_purity FROM
 (SELECT rx.key_seed, rx.rxNodeId, rx.claimedStationId, CAST(floor(rxTimeMs / {W}) AS BIGINT) AS "window", attackId, count(*) AS n FROM rx JOIN tx USING (msgUid) GROUP BY ALL) GROUP BY ALL""")


@query("g08_label_windows", with_("labels_w", "SELECT *, claimedStationId AS label_txNodeId, CAST(label_attackId > 0 AS INT) AS label_is_attack, CAST(label_attack_purity >= 0.9 AS INT) AS label_clean FROM labels_w"), "label_attack_purity")
def g08(spark, d):
    return X.label_windows(A.tx(spark, d), A.rx(spark, d), W)


@query("j09_attach_labels", with_("g01 labels_w", f"""SELECT {LINK}, "window", app_n_msgs, label_attackId, label_attack_purity FROM g01 LEFT JOIN labels_w USING ({LINK}, "window")"""), "label_attack_purity")
def j09(spark, d):
    agg = X.window_features(X.seq_gap(X.message_residuals(A.rx(spark, d))), W)
    return agg.join(X.label_windows(A.tx(spark, d), A.rx(spark, d), W), [*X.LINK, "window"], "left").select(*X.LINK, "window", "app_n_msgs", "label_attackId", "label_attack_purity")


@query("j24_compare_features", with_("res", f"""SELECT feature, count(*) AS n, max(abs(x - y)) AS max_diff, count(*) FILTER ((x IS NULL) <> (y IS NULL)) AS null_mismatch FROM
 (SELECT unnest(['dt', 'moved', 'heading']) AS feature, unnest([dt, moved, heading]) AS x, unnest([dt + CASE WHEN msgUid % 10 = 0 THEN 1 ELSE 0 END, moved, CASE WHEN msgUid % 7 > 0 THEN heading END]) AS y FROM res) GROUP BY ALL"""), "max_diff")
def j24(spark, d):
    a = X.message_residuals(A.rx(spark, d))
    b = a.withColumn("dt", F.col("dt") + F.when(F.col("msgUid") % 10 == 0, 1).otherwise(0)).withColumn("heading", F.when(F.col("msgUid") % 7 > 0, F.col("heading")))
    return X.compare_features(a, b, ["msgUid"], ["dt", "moved", "heading"])


@query("f_scalars", with_("rx", f"""SELECT msgUid, sqrt((claimedX - rxX) ^ 2 + (claimedY - rxY) ^ 2) AS f01, {unwrap('claimedX - 5 * rxX')} AS f02, {gap('claimedHeading', 'claimedSpeed * 9')} AS f03,
 {pmod('degrees(atan2(claimedX - rxX, claimedY + 0.5))')} AS f04, claimedX + claimedSpeed * 2 * sin(radians(claimedHeading)) AS f05x, claimedY + claimedSpeed * 2 * cos(radians(claimedHeading)) AS f05y, {rsrp('claimedX')} AS f06,
 CASE WHEN claimedY > 0 THEN 10 * log10(claimedY) END AS f07, CAST(floor(rxTimeMs / 1000) AS BIGINT) AS f08, CASE WHEN claimedX > 0 AND claimedX <= 100 THEN 0 WHEN claimedX > 100 AND claimedX <= 500 THEN 1 WHEN claimedX > 500 AND claimedX <= 2000 THEN 2 END AS f09_cut,
 CAST(claimedX >= 100 AS INT) + CAST(claimedX >= 500 AS INT) AS f09_dig, round_even(claimedX / 0.5::DOUBLE, 0) * 0.5 AS f10, CASE msgType WHEN 1 THEN 'DENM' WHEN 2 THEN 'CAM' WHEN 14 THEN 'CPM' END AS f11,
 sqrt(claimedX ^ 2 + claimedY ^ 2) AS f12_speed, {pmod('degrees(atan2(claimedX, claimedY))')} AS f12_heading, CASE WHEN msgUid % 11 > 0 THEN -(msgUid % 11) / 11.0::DOUBLE * ln((msgUid % 11) / 11.0::DOUBLE) ELSE 0 END AS f13 FROM rx"""),
       "f01 f02 f03 f04 f05x f05y f06 f07 f10 f12_speed f12_heading f13")
def scalars(spark, d):
    x, y = S.dead_reckon("claimedX", "claimedY", "claimedSpeed", "claimedHeading", 2.0)
    speed, heading = S.polar("claimedX", "claimedY")
    return A.rx(spark, d).select(
        "msgUid", S.distance(F.col("claimedX") - F.col("rxX"), F.col("claimedY") - F.col("rxY")).alias("f01"),
        S.unwrap(F.col("claimedX") - 5 * F.col("rxX"), 6000).alias("f02"), S.angle_gap("claimedHeading", F.col("claimedSpeed") * 9).alias("f03"),
        S.bearing(F.col("claimedX") - F.col("rxX"), F.col("claimedY") + 0.5).alias("f04"), x.alias("f05x"), y.alias("f05y"), S.predicted_rsrp("claimedX").alias("f06"),
        S.to_db("claimedY").alias("f07"), S.window_index("rxTimeMs", 1000).alias("f08"), S.cut_bins("claimedX", [0, 100, 500, 2000]).alias("f09_cut"),
        S.digitize("claimedX", [100, 500]).alias("f09_dig"), S.quantise("claimedX", 0.5).alias("f10"), S.code_map("msgType", S.MESSAGE).alias("f11"),
        speed.alias("f12_speed"), heading.alias("f12_heading"), S.entropy_terms((F.col("msgUid") % 11) / 11.0).alias("f13"))
