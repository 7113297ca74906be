"""Queries of campaign reports and the corpus card, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import campaign as C, geometry as G
from ..sources import adapters as A
from . import reports_q  # noqa: F401  its table expressions are used below
from .ctes import cte, with_
from .registry import query
from .spacetime_q import bands

DAY = 86_400_000.0
INF = "'Infinity'::DOUBLE"


def rungs_sql(name: str, where: str) -> str:
    cte(name, "err", f"""SELECT attackId, stations, coalesce(measured, 0) AS measured, least, p25, p50, p75, most, coalesce(inside, 0) AS inside FROM (SELECT attackId, count(DISTINCT (key_seed, txNodeId)) AS stations FROM err WHERE attackId > 0 GROUP BY 1) LEFT JOIN
 (SELECT attackId, count(*) AS measured, min(lie) AS least, quantile_cont(lie, 0.25) AS p25, quantile_cont(lie, 0.5) AS p50, quantile_cont(lie, 0.75) AS p75, max(lie) AS most, count(*) FILTER (lie <= (SELECT quantile_cont(err, 0.95) FROM err WHERE attackId = 0)) AS inside
 FROM (SELECT attackId, key_seed, txNodeId, quantile_cont(err, 0.5) AS lie FROM err WHERE attackId > 0{where} GROUP BY ALL) GROUP BY 1) USING (attackId)""")
    return with_(name, f"SELECT * FROM {name}")


@query("g16_rungs", rungs_sql("rungs", " AND err > (SELECT max(err) FROM err WHERE attackId = 0)"), "least p25 p50 p75 most")
def g16(spark, d):
    return C.magnitude_rungs(A.tx(spark, d))


@query("g16_rungs_all_messages", rungs_sql("rungs_all", ""), "least p25 p50 p75 most")
def g16a(spark, d):
    return C.magnitude_rungs(A.tx(spark, d), lying=False)


@query("g16_rung_overlap", with_("rungs", "SELECT a.attackId, b.attackId AS other, greatest(a.least, b.least) <= least(a.most, b.most) AS overlap FROM rungs a JOIN rungs b ON a.attackId < b.attackId"))
def g16o(spark, d):
    return C.rung_overlap(C.magnitude_rungs(A.tx(spark, d)))


@query("g21_by_channel_count", with_("corpus", f"SELECT bin, label_is_attack, count(*) AS units, quantile_cont(app_price, 0.5) AS median FROM (SELECT *, {bands('app_quantity', [0, 2.5, 4, 6, 10])[:-4]} WHEN app_quantity > 10 THEN 4 END AS bin FROM corpus) GROUP BY ALL"), "median")
def g21(spark, d):
    return C.residual_by_channels(A.corpus(spark, d), "app_price", "app_quantity", "label_is_attack")


@query("g21_residual_excess", with_("corpus", """SELECT a, b, r, ms - mb AS excess, a + b * mx - mb AS explained, sd, (ms - mb) / sd AS excess_sd, (a + b * mx - mb) / (ms - mb) AS share, ms - a - b * mx AS left_over, (ms - a - b * mx) / sd AS left_over_sd FROM (SELECT
 regr_intercept(app_price, ln(app_quantity)) FILTER (label_is_attack = 0) AS a, regr_slope(app_price, ln(app_quantity)) FILTER (label_is_attack = 0) AS b, corr(ln(app_quantity), app_price) FILTER (label_is_attack = 0) AS r, stddev_samp(app_price) FILTER (label_is_attack = 0) AS sd,
 quantile_cont(app_price, 0.5) FILTER (label_is_attack = 0) AS mb, quantile_cont(app_price, 0.5) FILTER (label_is_attack = 1) AS ms, quantile_cont(ln(app_quantity), 0.5) FILTER (label_is_attack = 1) AS mx FROM corpus)"""), "a b r excess explained sd excess_sd share left_over left_over_sd")
def g21e(spark, d):
    return C.residual_excess(A.corpus(spark, d), "app_price", "app_quantity", "label_is_attack")


LEAST = 20
SKEWED = "label_attackId < 11 OR key_claimedStationId % 3 = 0"
cte("skewed", "corpus", f"SELECT key_claimedStationId AS client, label_attackId AS class FROM corpus WHERE ({SKEWED}) AND key_claimedStationId IN (SELECT key_claimedStationId FROM corpus WHERE {SKEWED} GROUP BY 1 HAVING count(*) >= {LEAST})")
cte("grid", "skewed", """SELECT client, class, coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY client) AS DOUBLE) AS s, q FROM (SELECT DISTINCT client FROM skewed) CROSS JOIN (SELECT class, count(*) / CAST((SELECT count(*) FROM skewed) AS DOUBLE) AS q FROM skewed GROUP BY 1)
 LEFT JOIN (SELECT client, class, count(*) AS n FROM skewed GROUP BY ALL) USING (client, class)""")


def skewed(spark, d):
    return C.enough_rows(A.corpus(spark, d).where(SKEWED), "key_claimedStationId", LEAST)


@query("g28_class_shares", with_("grid", "SELECT class AS label_attackId, avg(s) AS mean, stddev_samp(s) AS std, min(s) AS least, max(s) AS most FROM grid GROUP BY 1"), "mean std least most")
def g28(spark, d):
    return C.client_shares(skewed(spark, d), "key_claimedStationId", "label_attackId")


@query("g28_skew_rule", with_("grid", """SELECT count(*) AS clients, avg(e) AS mean_effective, min(e) AS least_effective, max(e) AS most_effective, max(e) - min(e) AS spread, count(*) FILTER (m >= 1) AS lack_one, count(*) FILTER (m >= 2) AS lack_two, avg(tv) AS mean_tv, avg(tv) >= 0.1 AND max(e) - min(e) >= 0.5 AS passed
 FROM (SELECT client, exp(sum(CASE WHEN s > 0 THEN -s * ln(s) ELSE 0 END)) AS e, count(*) FILTER (s = 0) AS m, sum(abs(s - q)) / 2 AS tv FROM grid GROUP BY 1)"""), "mean_effective least_effective most_effective spread mean_tv")
def g28r(spark, d):
    return C.skew_rule(skewed(spark, d), "key_claimedStationId", "label_attackId")


FEATURES = 62
SECONDS = f"(windows * {DAY} / 1000)"


@query("g33_report_traffic", with_("tx ears", f"""SELECT *, messages * 275 * 8 / ({SECONDS} * 1e6) AS safety_mbit, reports / {SECONDS} AS reports_per_s, reports / {SECONDS} / receivers AS per_receiver, reports / {SECONDS} * {FEATURES * 4 + 24} * 8 / 1e6 AS full_mbit,
 reports / {SECONDS} * 24 * 8 / 1e6 AS minimal_mbit, reports * {FEATURES * 4 + 24} / (messages * 275.0::DOUBLE) AS full_ratio, reports * 24 / (messages * 275.0::DOUBLE) AS minimal_ratio FROM (SELECT count(DISTINCT (key_seed, floor(txTimeMs / {DAY}))) AS windows, count(*) AS messages FROM tx),
 (SELECT count(DISTINCT (tx.key_seed, claimedStationId, floor(txTimeMs / {DAY}), ears.rxNodeId)) AS reports FROM ears JOIN tx USING (key_seed, msgUid)), (SELECT count(DISTINCT (key_seed, rxNodeId)) AS receivers FROM ears)"""), "safety_mbit reports_per_s per_receiver full_mbit minimal_mbit full_ratio minimal_ratio")
def g33(spark, d):
    return C.report_traffic(A.tx(spark, d), A.heard(spark, d), DAY, FEATURES)


@query("g33_regions_per_window", with_("units", "SELECT quantile_cont(n, 0.5) AS median, max(n) AS most FROM (SELECT count(DISTINCT floor(rxX / 1500)) AS n FROM units GROUP BY key_seed, key_claimedStationId, key_window)"), "median")
def g33r(spark, d):
    return C.regions_per_window(A.units(spark, d).withColumn("key_region", F.floor(F.col("rxX") / 1500)), G.TRIPLE, "key_region")


cte("camgap", "tx", "SELECT * FROM (SELECT *, txTimeMs - lag(txTimeMs) OVER (PARTITION BY key_seed, txNodeId ORDER BY txTimeMs, msgUid) AS gap FROM tx WHERE attackId = 0 AND msgType = 2) WHERE gap IS NOT NULL")


@query("g37_cam_interval", with_("camgap", "SELECT count(*) AS n, quantile_cont(gap, 0.5) AS median_ms, avg(gap) AS mean_ms, 1000 / avg(gap) AS hz, count(DISTINCT gap) AS kinds FROM camgap"), "median_ms mean_ms hz")
def g37i(spark, d):
    return C.cam_interval(A.tx(spark, d), 7 * DAY)


@query("g37_dcc_interval", with_("camgap", f"SELECT bin, count(*) AS n, quantile_cont(gap, 0.5) AS median_ms FROM (SELECT gap, {bands('txCbr', [f'{e}::DOUBLE' for e in C.BUSY])} AS bin FROM camgap) WHERE bin IS NOT NULL GROUP BY 1"), "median_ms")
def g37d(spark, d):
    return C.dcc_interval(A.tx(spark, d), 7 * DAY)


@query("g37_roles", with_("tx stations", """SELECT 'role:' || role AS fact, count(*) AS value FROM stations GROUP BY 1 UNION ALL SELECT 'class:' || attackId, count(DISTINCT (key_seed, txNodeId)) FROM tx WHERE attackId > 0 GROUP BY 1
 UNION ALL SELECT 'message:' || CASE msgType WHEN 1 THEN 'DENM' WHEN 2 THEN 'CAM' ELSE 'CPM' END, count(*) FROM tx GROUP BY 1
 UNION ALL SELECT unnest(['messages', 'senders', 'first_s', 'last_s']), unnest([count(*), count(DISTINCT (key_seed, txNodeId)), CAST(floor(min(txTimeMs) / 1000) AS BIGINT), CAST(floor(max(txTimeMs) / 1000) AS BIGINT)]) FROM tx"""))
def g37r(spark, d):
    return C.role_counts(A.tx(spark, d), A.stations(spark, d))


@query("g37_error_by_class", with_("err", "SELECT attackId, count(*) AS n, quantile_cont(err, 0.5) AS median FROM err WHERE attackId IN (1, 2, 3, 4, 11, 13) GROUP BY 1"), "median")
def g37e(spark, d):
    return C.error_by_class(A.tx(spark, d))


BLOCKS = {"application": ("app_",), "physical": ("phy_",), "keys and labels": ("key_", "label_")}


@query("g46_columns", with_("corpus", "SELECT unnest(['application', 'physical', 'keys and labels']) AS block, unnest([2, 2, 9])::BIGINT AS columns, count(*) AS \"rows\", count(*) AS complete FROM corpus"))
def g46c(spark, d):
    return C.card_columns(A.corpus(spark, d), BLOCKS)


cte("parted", "corpus", "SELECT *, CASE label_txNodeId % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM corpus")


@query("g46_split_shares", with_("parted", """SELECT split, label_attackId AS class, count(DISTINCT (key_seed, label_txNodeId)) AS stations, count(*) AS windows, count(*) / CAST((SELECT count(*) FROM parted) AS DOUBLE) AS share FROM parted GROUP BY GROUPING SETS ((split, label_attackId), (split))"""), "share")
def g46s(spark, d):
    df = A.corpus(spark, d)
    splits = df.select("key_seed", "label_txNodeId").distinct().withColumn("split", F.expr("CASE label_txNodeId % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END"))
    return C.card_splits(df, splits)
