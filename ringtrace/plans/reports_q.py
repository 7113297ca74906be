"""Queries of metrics, tracks, drift and update aggregation, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as X, geometry as G, mesh as M, reports as R
from ..sources import adapters as A
from . import features_q, geometry_q, partition_q  # noqa: F401  their table expressions are used below
from .ctes import cte, pmod, with_
from .registry import query

TR = "key_region, key_claimedStationId"
TRACK, ORDER = ["key_region", "key_claimedStationId"], ["timeMs", "key_window"]

cte("pred", "corpus", "SELECT key_seed, key_rxNodeId, key_claimedStationId, key_window, label_attackId AS y, CASE WHEN app_quantity > 30 THEN label_attackId WHEN app_quantity > 15 THEN 0 ELSE 1 END AS p FROM corpus")
cte("score", "corpus", "SELECT key_seed, label_txNodeId, label_is_attack AS y, phy_tax * 10 + app_quantity / 500 AS score FROM corpus")
cte("fired", "tracks", f"SELECT *, sum(CAST(hit AS INT)) OVER (PARTITION BY {TR} ORDER BY timeMs, key_window ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 AS fired FROM tracks")
cte("ep", "fired", f"""SELECT {TR}, count(*) FILTER (edge) AS episodes, bool_or(fired) AS found, count(*) AS length, bool_or(attack) AS attack FROM (SELECT *, fired AND NOT coalesce(lag(fired) OVER (PARTITION BY {TR} ORDER BY timeMs, key_window), false) AS edge FROM fired) GROUP BY ALL""")
cte("err", "tx", "SELECT *, sqrt((claimedX - trueX) ^ 2 + (claimedY - trueY) ^ 2) AS err FROM tx")
cte("rxs", "rx", "SELECT rx.*, sqrt((claimedX - rxX) ^ 2 + (claimedY - rxY) ^ 2) AS d FROM rx")


def pred(spark, d):
    p = F.when(F.col("app_quantity") > 30, F.col("label_attackId")).when(F.col("app_quantity") > 15, 0).otherwise(1)
    return A.corpus(spark, d).select("key_seed", "key_rxNodeId", "key_claimedStationId", "key_window", F.col("label_attackId").alias("y"), p.alias("p"))


def score(spark, d):
    return A.corpus(spark, d).select("key_seed", "label_txNodeId", F.col("label_is_attack").alias("y"), (F.col("phy_tax") * 10 + F.col("app_quantity") / 500).alias("score"))


def fired(spark, d):
    return R.k_of_m(A.tracks(spark, d), TRACK, ORDER, 3, 5)


def ep(spark, d):
    return R.episodes(fired(spark, d), TRACK, ORDER)


CLS = """SELECT class, coalesce(hit / CAST(nullif(called, 0) AS DOUBLE), 0) AS "precision", coalesce(hit / CAST(nullif(actual, 0) AS DOUBLE), 0) AS recall, coalesce(2.0::DOUBLE * hit / nullif(actual + called, 0), 0) AS f1 FROM (SELECT class, sum(CAST(y = class AND p = class AS INT)) AS hit, sum(CAST(p = class AS INT)) AS called, sum(CAST(y = class AS INT)) AS actual FROM pred, (SELECT unnest([0, 1, 11]) AS class) GROUP BY 1)"""
cte("cls", "pred", CLS)


@query("g29_class_scores", with_("cls", "SELECT * FROM cls"), '"precision" recall f1')
def g29c(spark, d):
    return R.class_scores(pred(spark, d))


@query("g29_metrics", with_("pred cls", """SELECT avg(CAST(y = p AS INT)) AS accuracy, (SELECT avg(f1) FROM cls) AS macro_f1, (sum(CAST(y = p AS INT)) * count(*)::DOUBLE - (SELECT sum(t * q) FROM (SELECT class, (SELECT count(*) FROM pred WHERE y = class) AS t, (SELECT count(*) FROM pred WHERE p = class) AS q FROM cls)))
 / sqrt((count(*)::DOUBLE * count(*) - (SELECT sum(q * q) FROM (SELECT count(*) AS q FROM pred GROUP BY p))) * (count(*)::DOUBLE * count(*) - (SELECT sum(q * q) FROM (SELECT count(*) AS q FROM pred GROUP BY y)))) AS mcc FROM pred"""), "accuracy macro_f1 mcc")
def g29(spark, d):
    return R.metrics(pred(spark, d))


@query("g30_threshold_table", with_("score", """SELECT t, fpr, recall, tp / greatest(1, tp + fp) AS "precision", coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc,
 a / nullif(a + b, 0) AS precision_at, (a * (1 - fpr) * 0.95::DOUBLE - b * (1 - recall) * 0.05::DOUBLE) / nullif(sqrt((a + b) * (a + (1 - recall) * 0.05::DOUBLE) * ((1 - fpr) * 0.95::DOUBLE + b) * ((1 - fpr) * 0.95::DOUBLE + (1 - recall) * 0.05::DOUBLE)), 0) AS mcc_at, fpr * 3600 AS alerts_per_hour FROM
 (SELECT *, recall * 0.05::DOUBLE AS a, fpr * 0.95::DOUBLE AS b FROM (SELECT *, fp / greatest(1, fp + tn) AS fpr, tp / greatest(1, tp + fn) AS recall FROM (SELECT t, count(*) FILTER (score >= t AND y = 1)::DOUBLE AS tp, count(*) FILTER (score >= t AND y = 0)::DOUBLE AS fp, count(*) FILTER (score < t AND y = 1)::DOUBLE AS fn, count(*) FILTER (score < t AND y = 0)::DOUBLE AS tn
 FROM score, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS t) GROUP BY 1)))"""), 't fpr recall "precision" mcc precision_at mcc_at alerts_per_hour')
def g30(spark, d):
    return R.threshold_table(score(spark, d), [0.25, 0.5, 0.75], 0.05, 3600)


@query("g31_prevalence", with_("score", "SELECT (r * 0.01::DOUBLE) / (r * 0.01::DOUBLE + f * 0.99::DOUBLE) AS precision_at FROM (SELECT avg(CAST(score >= 0.5 AS INT)) FILTER (y = 1) AS r, avg(CAST(score >= 0.5 AS INT)) FILTER (y = 0) AS f FROM score)"), "precision_at")
def g31(spark, d):
    return R.threshold_table(score(spark, d), [0.5], 0.01, 1).select("precision_at")


@query("g32_decisions", with_("corpus", "SELECT quantile_cont(n, 0.5) AS median FROM (SELECT count(DISTINCT key_claimedStationId) AS n FROM corpus GROUP BY key_seed, key_observer_role, key_window)"), "median")
def g32(spark, d):
    return R.decisions(A.corpus(spark, d), ["key_seed", "key_observer_role", "key_window"], "key_claimedStationId")


def auc_sql(rows: str, features: list[str], label: str, classes: list[int]) -> str:
    parts = [f"SELECT '{f}' AS feature, {c} AS class, (sum(CASE WHEN {label} = {c} THEN r END) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * (n - n1)) AS auc FROM (SELECT {label}, rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0::DOUBLE AS r, count(*) OVER () AS n, count(*) FILTER ({label} = {c}) OVER () AS n1 FROM {rows}) GROUP BY n, n1" for f in features for c in classes]
    return " UNION ALL ".join(parts)


@query("m26_auc", with_("corpus", auc_sql("corpus", ["app_quantity", "phy_tax"], "label_attackId", [1, 11])), "auc")
def m26(spark, d):
    return R.auc(A.corpus(spark, d), ["app_quantity", "phy_tax"], "label_attackId", [1, 11])


@query("m22_matched_threshold", with_("score", """SELECT min(score) AS threshold FROM (SELECT score, coalesce(sum(w) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM
 (SELECT score, sum(1.0::DOUBLE / (n * rows)) AS w FROM (SELECT score, count(*) OVER (PARTITION BY key_seed, label_txNodeId) AS rows, (SELECT count(DISTINCT (key_seed, label_txNodeId)) FROM score WHERE y = 0) AS n FROM score WHERE y = 0) GROUP BY 1)) WHERE above <= 0.0500001"""), "threshold")
def m22(spark, d):
    return R.matched_threshold(score(spark, d).where("y = 0"), ["key_seed", "label_txNodeId"], 0.0500001)


@query("m28_plausibility", with_("corpus", """SELECT label_attackId, avg(CAST(app_price > hi AS INT)) AS price, avg(CAST(app_quantity < lo OR app_quantity > up AS INT)) AS quantity, avg(CAST(app_price > hi OR app_quantity < lo OR app_quantity > up AS INT)) AS "any" FROM corpus,
 (SELECT quantile_cont(app_price, 0.95) AS hi, quantile_cont(app_quantity, 0.025) AS lo, quantile_cont(app_quantity, 0.975) AS up FROM corpus WHERE label_attackId = 0) GROUP BY 1"""), 'price quantity "any"')
def m28(spark, d):
    df = A.corpus(spark, d)
    return R.plausibility(df, df, {"price": ("app_price", "hi"), "quantity": ("app_quantity", "both")}, 0.05, "label_attackId")


@query("w03_k_of_m", with_("fired", f"SELECT {TR}, key_window, fired FROM fired"))
def w03(spark, d):
    return fired(spark, d).select(*TRACK, "key_window", "fired")


@query("w04_k_of_m_whole", with_("tracks", f"SELECT {TR}, key_window, sum(CAST(hit AS INT)) OVER w >= 2 AND count(*) OVER w = 4 AS fired FROM tracks WINDOW w AS (PARTITION BY {TR} ORDER BY timeMs, key_window ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"))
def w04(spark, d):
    return R.k_of_m(A.tracks(spark, d), TRACK, ORDER, 2, 4, whole=True).select(*TRACK, "key_window", "fired")


@query("w05_episodes", with_("ep", "SELECT * FROM ep"))
def w05(spark, d):
    return ep(spark, d)


@query("w06_forward_fill", with_("rx", """SELECT msgUid, CASE WHEN rxTimeMs - t <= 604800000 THEN v END AS held_held FROM (SELECT msgUid, rxTimeMs, last(CASE WHEN msgType = 2 THEN rxTimeMs END IGNORE NULLS) OVER w AS t, last(CASE WHEN msgType = 2 THEN claimedX END IGNORE NULLS) OVER w AS v FROM rx
 WINDOW w AS (PARTITION BY claimedStationId ORDER BY rxTimeMs, msgUid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""), "held_held")
def w06(spark, d):
    rows = A.rx(spark, d).withColumn("held", F.when(F.col("msgType") == 2, F.col("claimedX")))
    return R.forward_fill(rows, ["claimedStationId"], "rxTimeMs", "msgUid", "held", A.WEEK_MS, 4 * A.WEEK_MS).select("msgUid", "held_held")


@query("w07_gap", with_("tx", "SELECT msgUid, txTimeMs - lag(txTimeMs) OVER (PARTITION BY txNodeId ORDER BY txTimeMs, msgUid) AS gap FROM tx"), "gap")
def w07(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("txNodeId").orderBy("txTimeMs", "msgUid")
    return A.tx(spark, d).select("msgUid", (F.col("txTimeMs") - F.lag("txTimeMs").over(w)).alias("gap"))


@query("w08_rank_avg", with_("corpus", "SELECT DISTINCT key_seed, app_quantity, count(*) OVER (PARTITION BY key_seed, app_quantity) AS n, rank() OVER (PARTITION BY key_seed ORDER BY app_quantity) + (count(*) OVER (PARTITION BY key_seed, app_quantity) - 1) / 2.0::DOUBLE AS rank FROM corpus"), "rank app_quantity")
def w08(spark, d):
    return R.rank_avg(A.corpus(spark, d), ["key_seed"], "app_quantity")


DAY = 86_400_000
cte("frames", "tx", f"SELECT claimedStationId, CAST(floor(txTimeMs / {DAY}) AS BIGINT) AS frame, last(claimedX ORDER BY txTimeMs, msgUid) AS claimedX FROM tx GROUP BY ALL")


@query("w09_last_per_frame", with_("frames", "SELECT * FROM frames"), "claimedX")
def w09(spark, d):
    return R.last_per_frame(A.tx(spark, d), ["claimedStationId"], "txTimeMs", "msgUid", DAY, ["claimedX"])


@query("w10_resample", with_("frames", f"""SELECT claimedStationId, f AS frame, {pmod('claimedX + coalesce(step * (f - frame) / (nxt - frame), 0)', '6000.0::DOUBLE')} AS claimedX, f <> frame AS gap FROM
 (SELECT *, unnest(range(frame, greatest(coalesce(nxt, frame + 1), frame + 1))) AS f FROM (SELECT *, lead(frame) OVER w AS nxt, (lead(claimedX) OVER w - claimedX) - round_even((lead(claimedX) OVER w - claimedX) / 6000.0::DOUBLE, 0) * 6000 AS step FROM frames WINDOW w AS (PARTITION BY claimedStationId ORDER BY frame)))"""), "claimedX")
def w10(spark, d):
    return R.resample(R.last_per_frame(A.tx(spark, d), ["claimedStationId"], "txTimeMs", "msgUid", DAY, ["claimedX"]), ["claimedStationId"], "claimedX", 6000.0, 32)


@query("w11_running_scores", with_("pred", 'SELECT "second", n, CAST(sum(n) OVER w AS BIGINT) AS seen, sum(hit) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS accuracy FROM (SELECT key_window AS "second", count(*) AS n, count(*) FILTER (y = p) AS hit FROM pred GROUP BY 1) WINDOW w AS (ORDER BY "second" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'), "accuracy")
def w11(spark, d):
    return R.running_scores(pred(spark, d), F.col("key_window"))


@query("w12_share", with_("corpus", "SELECT *, n / CAST(sum(n) OVER (PARTITION BY key_seed) AS DOUBLE) AS share FROM (SELECT key_seed, label_attackId, count(*) AS n FROM corpus GROUP BY ALL)"), "share")
def w12(spark, d):
    return R.share(A.corpus(spark, d), "label_attackId", ["key_seed"])


cte("votes", "pred", "SELECT key_seed, key_claimedStationId, count(*) AS n, count(*) FILTER (p <> 0) AS k, bool_or(y <> 0 AND key_claimedStationId % 5 = 0) AS attack FROM pred GROUP BY ALL")


@query("g35_vote", with_("pred", """SELECT key_seed, key_claimedStationId, n, k, top, k >= ceil(n * 0.4::DOUBLE) AS alert FROM (SELECT key_seed, key_claimedStationId, CAST(sum(c) AS BIGINT) AS n, CAST(coalesce(sum(c) FILTER (p <> 0), 0) AS BIGINT) AS k, first(p ORDER BY CASE WHEN p <> 0 THEN c ELSE 0 END DESC, p) FILTER (p <> 0) AS top FROM (SELECT key_seed, key_claimedStationId, p, count(*) AS c FROM pred GROUP BY ALL) GROUP BY ALL)"""))
def g35(spark, d):
    return R.vote(pred(spark, d), ["key_seed", "key_claimedStationId"], 0.4)


@query("g36_matched_vote", with_("votes", """SELECT "out" AS seed, min(share) AS share FROM (SELECT o.key_seed AS "out", share, count(*) FILTER (k >= ceil(n * share)) AS a FROM votes v, (SELECT DISTINCT key_seed FROM votes) o, (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS share) WHERE NOT attack AND v.key_seed <> o.key_seed GROUP BY ALL) JOIN
 (SELECT o.key_seed AS "out", count(*) FILTER (k > n * 0.6::DOUBLE) AS goal FROM votes v, (SELECT DISTINCT key_seed FROM votes) o WHERE NOT attack AND v.key_seed <> o.key_seed GROUP BY 1) USING ("out") WHERE a <= goal GROUP BY 1"""), "share")
def g36(spark, d):
    v = pred(spark, d).groupBy(F.col("key_seed").alias("seed"), "key_claimedStationId").agg(F.count("*").alias("n"), F.count_if(F.col("p") != 0).alias("k"), F.bool_or((F.col("y") != 0) & (F.col("key_claimedStationId") % 5 == 0)).alias("attack"))
    return R.matched_vote(v, v.withColumn("flag", F.col("k") > F.col("n") * 0.6), [0.3, 0.5, 0.7, 0.9])


@query("j25_paired_verdicts", with_("votes fit", "SELECT v.key_seed, v.key_claimedStationId, v.k, f.claim_rmse > 2 AS pooled FROM votes v JOIN fit f ON v.key_seed = f.key_seed AND v.key_claimedStationId = f.key_claimedStationId"))
def j25(spark, d):
    v = R.vote(pred(spark, d), ["key_seed", "key_claimedStationId"], 0.4)
    return v.join(G.claim_fit(A.units(spark, d)), ["key_seed", "key_claimedStationId"]).select("key_seed", "key_claimedStationId", "k", (F.col("claim_rmse") > 2).alias("pooled"))


cte("det", "fit units", "SELECT f.key_seed, f.key_claimedStationId, avg(CAST(claim_rmse > 2 AS INT)) AS rate, 10 + f.key_claimedStationId % 90 AS \"offset\" FROM fit f GROUP BY ALL")


@query("g39_flag_rates", with_("score", "SELECT key_seed, label_txNodeId, y, avg(CAST(score > 0.5 AS INT)) AS rate, count(*) AS windows FROM score GROUP BY ALL"), "rate")
def g39(spark, d):
    return R.flag_rates(score(spark, d), ["key_seed", "label_txNodeId", "y"], 0.5)


@query("g40_any_region", with_("tracks", "SELECT key_claimedStationId, seed, max(score) AS score FROM tracks GROUP BY ALL"), "score")
def g40(spark, d):
    return R.any_region(A.tracks(spark, d), ["key_claimedStationId", "seed"])


@query("g41_detection_curve", with_("det", 'SELECT CAST("offset" >= 20 AS INT) + CAST("offset" >= 50 AS INT) + CAST("offset" >= 80 AS INT) AS band, count(*) AS stations, avg(rate) AS rate, avg(CAST(rate > 0.5 AS INT)) AS caught FROM det GROUP BY 1 HAVING count(*) >= 5'), "rate caught")
def g41(spark, d):
    det = G.claim_fit(A.units(spark, d)).groupBy("key_seed", "key_claimedStationId").agg(F.avg((F.col("claim_rmse") > 2).cast("int")).alias("rate")).withColumn("offset", 10 + F.col("key_claimedStationId") % 90)
    return R.detection_curve(det, [20, 50, 80], 5)


@query("j26_attach_offsets", with_("det err", """SELECT key_claimedStationId, rate, o.off AS offset_m FROM det LEFT JOIN (SELECT txNodeId, quantile_cont(err, 0.5) AS off FROM err GROUP BY 1) o ON o.txNodeId = key_claimedStationId"""), "rate offset_m")
def j26(spark, d):
    det = G.claim_fit(A.units(spark, d)).groupBy("key_seed", "key_claimedStationId").agg(F.avg((F.col("claim_rmse") > 2).cast("int")).alias("rate"))
    off = R.station_offsets(A.tx(spark, d)).select(F.col("txNodeId").alias("key_claimedStationId"), F.col("offset").alias("offset_m"))
    return det.join(off, "key_claimedStationId", "left").select("key_claimedStationId", "rate", "offset_m")


@query("g42_contact_time", with_("ep", "SELECT CASE WHEN length <= 4 THEN 0 WHEN length <= 8 THEN 1 WHEN length <= 12 THEN 2 WHEN length <= 16 THEN 3 WHEN length <= 100 THEN 4 END AS bin, count(*) FILTER (attack) AS attack_tracks, avg(CAST(found AS INT)) FILTER (attack) AS found, avg(CAST(found AS INT)) FILTER (NOT attack) AS flagged FROM ep GROUP BY 1"), "found flagged")
def g42(spark, d):
    return R.contact_time(ep(spark, d))


@query("g43_found_by_class", with_("ep", "SELECT key_claimedStationId % 5 AS class, count(*) AS tracks, avg(CAST(found AS INT)) AS found FROM ep GROUP BY 1"), "found")
def g43(spark, d):
    return R.found_by(ep(spark, d), F.col("key_claimedStationId") % 5)


@query("g44_family_scores", with_("pred", "SELECT CASE WHEN y IN (1, 3, 11, 13) THEN 'spoofing' WHEN y IN (7, 12) THEN 'flooding' WHEN y = 4 THEN 'replay' WHEN y = 0 THEN 'benign' ELSE 'other' END AS family, avg(CAST(p <> 0 AS INT)) AS flagged, avg(CAST(y <> 0 AND p IN (1, 11) AS INT)) AS named FROM pred GROUP BY 1"), "flagged named")
def g44(spark, d):
    return R.family_scores(pred(spark, d))


cte("shares", "corpus", "SELECT key_claimedStationId, label_attackId, n / CAST(sum(n) OVER (PARTITION BY key_claimedStationId) AS DOUBLE) AS s FROM (SELECT key_claimedStationId, label_attackId, count(*) AS n FROM corpus WHERE label_attackId < 11 OR key_claimedStationId % 3 = 0 GROUP BY ALL)")
cte("pool", "corpus", "SELECT label_attackId, n / CAST(sum(n) OVER () AS DOUBLE) AS q FROM (SELECT label_attackId, count(*) AS n FROM corpus WHERE label_attackId < 11 OR key_claimedStationId % 3 = 0 GROUP BY ALL)")


@query("g28_partition_skew", with_("shares pool", """SELECT key_claimedStationId, exp(sum(CASE WHEN s > 0 THEN -s * ln(s) ELSE 0 END)) AS effective, count(*) FILTER (s = 0) AS missing, sum(abs(s - q)) / 2 AS tv FROM (SELECT c.key_claimedStationId, q, coalesce(s, 0) AS s FROM (SELECT DISTINCT key_claimedStationId FROM shares) c CROSS JOIN pool LEFT JOIN shares USING (key_claimedStationId, label_attackId)) GROUP BY 1"""), "effective tv")
def g28(spark, d):
    return R.partition_skew(A.corpus(spark, d).where("label_attackId < 11 OR key_claimedStationId % 3 = 0"), "key_claimedStationId", "label_attackId")


FS = ["app_quantity", "app_price", "phy_discount", "phy_tax"]


@query("g20_feature_shift", with_("corpus", " UNION ALL ".join(f"SELECT '{f}' AS feature, abs((avg({f}) FILTER (key_seed > 's3') - avg({f}) FILTER (key_seed <= 's3')) / stddev_samp({f}) FILTER (key_seed <= 's3')) AS shift FROM corpus" for f in FS)), "shift")
def g20(spark, d):
    df = A.corpus(spark, d)
    return R.feature_shift(df.where("key_seed <= 's3'"), df.where("key_seed > 's3'"), FS)


@query("o01_top_features", with_("corpus", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, stddev_samp({f}) / abs(avg({f})) AS score FROM corpus" for f in FS) + ") ORDER BY score DESC, feature LIMIT 2"), "score")
def o01(spark, d):
    row = A.corpus(spark, d).agg(*[(F.stddev_samp(f) / F.abs(F.avg(f))).alias(f) for f in FS])
    return row.unpivot([], FS, "feature", "score").orderBy(F.desc("score"), "feature").limit(2)


@query("g19_pool_separation", with_("corpus", " UNION ALL ".join(f"SELECT '{f}' AS stat, label_attackId, (quantile_cont({f}, 0.5) - (SELECT quantile_cont({f}, 0.5) FROM corpus WHERE label_attackId = 0)) / (SELECT stddev_samp({f}) FROM corpus WHERE label_attackId = 0) AS shift FROM corpus WHERE label_attackId <> 0 GROUP BY label_attackId" for f in FS)), "shift")
def g19(spark, d):
    return R.pool_separation(A.corpus(spark, d), FS, "label_attackId")


@query("m33_refit_scaling", with_("ev od", "SELECT key_rxNodeId, key_seed, (app_quantity - (SELECT avg(app_quantity) FROM od)) / (SELECT stddev_pop(app_quantity) FROM od) * (SELECT stddev_pop(app_quantity) FROM ev) + (SELECT avg(app_quantity) FROM ev) AS app_quantity FROM od"), "app_quantity")
def m33(spark, d):
    df = A.corpus(spark, d)
    return R.refit_scaling(df.where("label_txNodeId % 2 = 0"), df.where("label_txNodeId % 2 = 1"), ["app_quantity"], ["key_rxNodeId", "key_seed"])


@query("g18_receiver_counts", with_("units", """SELECT m AS median, p25, p10, least, most, thin, CAST(ceil(m / 2) AS BIGINT) AS colluders_2, CAST(ceil(m / 3) AS BIGINT) AS colluders_3, CAST(ceil(m / 4) AS BIGINT) AS colluders_4 FROM (SELECT quantile_cont(n, 0.5) AS m, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.1) AS p10, min(n) AS least, max(n) AS most, avg(CAST(n < 80 AS INT)) AS thin FROM (SELECT count(*) AS n FROM units GROUP BY key_seed, key_claimedStationId, key_window))"""), "median p25 p10 thin")
def g18(spark, d):
    return R.receiver_counts(A.units(spark, d).groupBy(*G.TRIPLE).agg(F.count("*").alias("n")))


@query("g16_magnitude_ladder", with_("err", """SELECT attackId, count(*) AS stations, quantile_cont(lie, 0.25) AS p25, quantile_cont(lie, 0.5) AS p50, quantile_cont(lie, 0.75) AS p75, avg(CAST(lie <= (SELECT quantile_cont(err, 0.95) FROM err WHERE attackId = 0) AS INT)) AS inside_benign FROM
 (SELECT attackId, txNodeId, quantile_cont(err, 0.5) AS lie FROM err WHERE attackId > 0 AND err > (SELECT max(err) FROM err WHERE attackId = 0) GROUP BY ALL) GROUP BY 1"""), "p25 p50 p75 inside_benign")
def g16(spark, d):
    return R.magnitude_ladder(A.tx(spark, d))


@query("g17_carriageway_share", with_("tx", f"""SELECT attackId, width, windows, windows_outside, messages_outside FROM (SELECT attackId, width, count(*) AS windows, avg(CAST(abs(y) > width AS INT)) AS windows_outside FROM (SELECT claimedStationId, floor(txTimeMs / {DAY}) AS w, avg(claimedY) AS y, min(attackId) AS attackId FROM tx GROUP BY ALL HAVING max(claimedX) - min(claimedX) <= 1000), (SELECT unnest([1, 2])::DOUBLE AS width) GROUP BY ALL)
 JOIN (SELECT attackId, width, avg(CAST(abs(claimedY) > width AS INT)) AS messages_outside FROM tx, (SELECT unnest([1, 2])::DOUBLE AS width) GROUP BY ALL) USING (attackId, width)"""), "width windows_outside messages_outside")
def g17(spark, d):
    return R.carriageway_share(A.tx(spark, d), [1, 2], DAY)


@query("g21_sybil_residual", with_("corpus", """SELECT a, b, r, ms - mb AS excess, a + b * mx - mb AS explained FROM (SELECT regr_intercept(app_price, ln(app_quantity)) FILTER (label_is_attack = 0) AS a, regr_slope(app_price, ln(app_quantity)) FILTER (label_is_attack = 0) AS b, corr(ln(app_quantity), app_price) FILTER (label_is_attack = 0) AS r,
 quantile_cont(app_price, 0.5) FILTER (label_is_attack = 0) AS mb, quantile_cont(app_price, 0.5) FILTER (label_is_attack = 1) AS ms, quantile_cont(ln(app_quantity), 0.5) FILTER (label_is_attack = 1) AS mx FROM corpus)"""), "a b r excess explained")
def g21(spark, d):
    return R.sybil_residual(A.corpus(spark, d), "app_price", "app_quantity", "label_is_attack")


B = "CASE WHEN d > 0 AND d <= 500 THEN 0 WHEN d > 500 AND d <= 1500 THEN 1 WHEN d > 1500 AND d <= 3000 THEN 2 END"


@query("g23_bler", with_("pssch", "SELECT CASE WHEN x > -30 AND x <= 0 THEN 0 WHEN x > 0 AND x <= 7 THEN 1 WHEN x > 7 AND x <= 30 THEN 2 END AS bin, count(*) AS n, avg(corrupt) AS bler, avg(tbler) AS tbler FROM (SELECT *, CASE WHEN sinr > 0 THEN 10 * log10(sinr) END AS x FROM pssch) GROUP BY 1"), "bler tbler")
def g23(spark, d):
    return R.binned_mean(A.pssch(spark, d), S.to_db("sinr"), [-30, 0, 7, 30], bler=F.col("corrupt"), tbler=F.col("tbler"))


@query("g24_cbr_summary", with_("tx", "SELECT avg(txCbr) AS mean, quantile_cont(txCbr, 0.5) AS median, quantile_cont(txCbr, 0.95) AS p95, max(txCbr) AS most, count(*) / CAST(count(DISTINCT txNodeId) AS DOUBLE) / ((max(txTimeMs) - min(txTimeMs)) / 1000) AS rate FROM tx"), "mean median p95 most rate")
def g24(spark, d):
    return R.cbr_summary(A.tx(spark, d))


@query("j16_radio_to_node", with_("pssch", "SELECT txRnti, first(rxNodeId ORDER BY n DESC, rxNodeId) AS node FROM (SELECT txRnti, rxNodeId, count(*) AS n FROM pssch GROUP BY ALL) GROUP BY 1"))
def j16(spark, d):
    return X.mode_by(A.pssch(spark, d), ["txRnti"], "rxNodeId", "node")


@query("g27_station_offsets", with_("err", 'SELECT key_seed, txNodeId, max(attackId) AS attackId, quantile_cont(err, 0.5) AS "offset" FROM err GROUP BY ALL'), '"offset"')
def g27(spark, d):
    return R.station_offsets(A.tx(spark, d))


@query("g33_sharing_cost", with_("tx", f"SELECT count(*) / span AS reports_per_s, quantile_cont(n, 0.5) AS messages, count(*) / span * 8 * 24000 / 1e6 AS mbit_24000 FROM (SELECT claimedStationId, floor(txTimeMs / {DAY}) AS w, count(*) AS n, min(txTimeMs) AS t FROM tx GROUP BY ALL), (SELECT NULL) GROUP BY ALL".replace("span", "((SELECT max(t2) - min(t2) FROM (SELECT min(txTimeMs) AS t2 FROM tx GROUP BY claimedStationId, floor(txTimeMs / 86400000))) / 1000)").replace(", (SELECT NULL) GROUP BY ALL", "")), "reports_per_s messages mbit_24000")
def g33(spark, d):
    return R.sharing_cost(A.tx(spark, d), DAY, [24000])


@query("g34_upload_cost", with_("tracks", "SELECT quantile_cont(r, 0.1) AS p10, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.9) AS p90, 25648.0::DOUBLE / avg(r) AS break_even_minutes FROM (SELECT key_region, count(*) * 244 / 43200.0::DOUBLE AS r FROM tracks GROUP BY 1)"), "p10 p50 p90 break_even_minutes")
def g34(spark, d):
    return R.upload_cost(A.tracks(spark, d), "key_region", 43200.0, 244, 25648)


@query("g37_campaign_summary", with_("tx", """SELECT attackId, count(*) AS n, count(DISTINCT txNodeId) AS stations, count(*) FILTER (msgType = 1) AS denm, count(*) FILTER (msgType = 2) AS cam, count(*) FILTER (msgType = 14) AS cpm, quantile_cont(gap, 0.5) AS gap_median, avg(gap) AS gap_mean, count(DISTINCT gap) AS gaps FROM (SELECT *, txTimeMs - lag(txTimeMs) OVER (PARTITION BY txNodeId ORDER BY txTimeMs, msgUid) AS gap FROM tx) GROUP BY 1"""), "gap_median gap_mean")
def g37(spark, d):
    return R.campaign_summary(A.tx(spark, d), A.WEEK_MS)


cte("means", "err", "SELECT avg(err) AS m FROM err WHERE attackId = 0 GROUP BY txNodeId")


@query("g38_benign_error", with_("err means", f"SELECT quantile_cont(err, 0.5) AS median, quantile_cont(err, 0.95) AS p95, max(err) AS most, count(*) FILTER (err = 0) AS zero, quantile_cont(abs({pmod('claimedHeading - trueHeading + 180')} - 180), 0.5) AS heading, max(abs(claimedSpeed - trueSpeed)) AS speed, (SELECT quantile_cont(m, 0.25) FROM means) AS station_p25, (SELECT quantile_cont(m, 0.5) FROM means) AS station_p50, (SELECT quantile_cont(m, 0.75) FROM means) AS station_p75 FROM err WHERE attackId = 0"), "median p95 most heading speed station_p25 station_p50 station_p75")
def g38(spark, d):
    return R.benign_error(A.tx(spark, d))


cte("dims", "updates", "SELECT client, class, n_rows, n_steps, unnest(range(64)) AS dim, CAST(unnest(vector) AS DOUBLE) AS v FROM updates")


@query("m35_weighted_mean", with_("dims", "SELECT CAST(dim AS INT) AS dim, sum(n_rows * v) / sum(n_rows) AS value FROM dims GROUP BY 1"), "value")
def m35(spark, d):
    return R.aggregate_updates(A.updates(spark, d), "weighted")


@query("m35_normalised_mean", with_("dims", "SELECT CAST(dim AS INT) AS dim, sum(n_rows * w) / sum(n_rows) * (sum(n_rows * v / w) / sum(n_rows)) AS value FROM (SELECT *, (n_steps - 0.9::DOUBLE * (1 - pow(0.9::DOUBLE, n_steps)) / (1 - 0.9::DOUBLE)) / (1 - 0.9::DOUBLE) AS w FROM dims) GROUP BY 1"), "value")
def m35n(spark, d):
    return R.aggregate_updates(A.updates(spark, d), "normalised")


@query("m35_clipped_mean", with_("dims", "SELECT CAST(dim AS INT) AS dim, avg(v * f) AS value FROM dims JOIN (SELECT client, least(1.0::DOUBLE, 0.5::DOUBLE / (sqrt(sum(v * v)) + 1e-12::DOUBLE)) AS f FROM dims GROUP BY 1) USING (client) GROUP BY 1"), "value")
def m35c(spark, d):
    return R.aggregate_updates(A.updates(spark, d), "clipped", clip=0.5)


@query("m35_prototypes", with_("dims", "SELECT class, CAST(dim AS INT) AS dim, sum(n_rows * v) / sum(n_rows) AS value FROM dims GROUP BY ALL"), "value")
def m35p(spark, d):
    return R.prototypes(A.updates(spark, d))


@query("m35_server_step", with_("dims", "SELECT CAST(dim AS INT) AS dim, 0.1::DOUBLE * m / (sqrt(0.01::DOUBLE * m * m) + 0.001::DOUBLE) AS value FROM (SELECT dim, sum(n_rows * v) / sum(n_rows) AS m FROM dims GROUP BY 1)"), "value")
def m35s(spark, d):
    return R.server_step(A.updates(spark, d))


cte("rounds", "updates", """SELECT CAST(dim - 1 AS INT) AS dim, {0} FROM (SELECT dim, client % 3 AS k, n_rows, vector[dim] AS v FROM updates, (SELECT unnest(range(1, 65)) AS dim) WHERE dim <= len(vector)) GROUP BY 1""".format(
    ", ".join(f"sum(n_rows * v) FILTER (k = {k}) / sum(n_rows) FILTER (k = {k}) AS d{k}" for k in range(3))))
_M = ["0.1::DOUBLE * d0"]
_V = ["0.01::DOUBLE * d0 * d0"]
for _k in (1, 2):
    _M.append(f"0.9::DOUBLE * ({_M[-1]}) + 0.1::DOUBLE * d{_k}")
    _V.append(f"0.99::DOUBLE * ({_V[-1]}) + 0.01::DOUBLE * d{_k} * d{_k}")


@query("m35_server_rounds", with_("rounds", f"SELECT dim, -({' + '.join(f'({m}) / (sqrt({v}) + 0.001::DOUBLE)' for m, v in zip(_M, _V))}) AS value, {_M[-1]} AS m, {_V[-1]} AS v FROM rounds"), "value m v")
def m35r(spark, d):
    """Three rounds with carried momentum and scale."""
    return R.serve_rounds(A.updates(spark, d), F.col("client") % 3, 3)


@query("m35_server_momentum", with_("rounds", "SELECT dim, -0.5::DOUBLE * (d0 + (0.9::DOUBLE * d0 + d1) + (0.9::DOUBLE * (0.9::DOUBLE * d0 + d1) + d2)) AS value, 0.9::DOUBLE * (0.9::DOUBLE * d0 + d1) + d2 AS m, 0.0::DOUBLE AS v FROM rounds"), "value m v")
def m35a(spark, d):
    return R.serve_rounds(A.updates(spark, d), F.col("client") % 3, 3, "avgm", rate=0.5)


cte("ring", "dims", "SELECT DISTINCT class AS node, CAST(dim AS INT) AS dim, avg(v) OVER (PARTITION BY class, dim) AS v FROM dims")


#: Nodes of the mesh: clients by number; links of a ring and one more each; one node in seven is dead.
NODES = 64
cte("node", "updates", f"SELECT DISTINCT client % {NODES} AS node FROM updates")
cte("link", "node", f"SELECT DISTINCT * FROM (SELECT node AS src, (node + 1) % {NODES} AS dst FROM node UNION ALL SELECT node, (node * 37 + 11) % {NODES} FROM node) WHERE src <> dst")
cte("twoway", "link node", "SELECT DISTINCT src, dst FROM (SELECT src, dst FROM link UNION ALL SELECT dst, src FROM link) WHERE src % 7 <> 3 AND dst % 7 <> 3 AND src IN (SELECT node FROM node) AND dst IN (SELECT node FROM node)")
cte("weights", "twoway node", """SELECT src, dst, w FROM (SELECT b.src, b.dst, 1.0::DOUBLE / (1 + greatest(x.d, y.d)) AS w FROM twoway b JOIN (SELECT src, count(*) AS d FROM twoway GROUP BY 1) x ON x.src = b.src JOIN (SELECT src, count(*) AS d FROM twoway GROUP BY 1) y ON y.src = b.dst)
 UNION ALL SELECT node, node, 1 - coalesce((SELECT sum(1.0::DOUBLE / (1 + greatest(x.d, y.d))) FROM twoway b JOIN (SELECT src, count(*) AS d FROM twoway GROUP BY 1) x ON x.src = b.src JOIN (SELECT src, count(*) AS d FROM twoway GROUP BY 1) y ON y.src = b.dst WHERE b.src = node), 0) FROM node""")
cte("mesh0", "updates", f"SELECT client % {NODES} AS node, dim - 1 AS dim, avg(vector[dim]) AS v FROM updates, (SELECT unnest(range(1, 65)) AS dim) WHERE dim <= len(vector) GROUP BY ALL")
for _step in (1, 2, 3):
    cte(f"mesh{_step}", f"weights mesh{_step - 1}", f"SELECT w.dst AS node, m.dim, sum(w.w * m.v) AS v FROM weights w JOIN mesh{_step - 1} m ON m.node = w.src GROUP BY ALL")


def mesh(spark, d):
    """Models of the nodes, their links and the live ones."""
    u = A.updates(spark, d).withColumn("node", F.col("client") % NODES)
    models = u.select("node", F.posexplode("vector").alias("dim", "v")).groupBy("node", "dim").agg(F.avg("v").alias("v"))
    nodes = u.select("node").distinct()
    aims = F.explode(F.array((F.col("node") + 1) % NODES, (F.col("node") * 37 + 11) % NODES)).alias("dst")
    return models, nodes, nodes.select(F.col("node").alias("src"), aims), nodes.where("node % 7 <> 3")


@query("m36_peer_mixing", with_("mesh3", "SELECT node, dim, v FROM mesh3"), "v")
def m36(spark, d):
    models, nodes, links, live = mesh(spark, d)
    return M.mix(models, M.metropolis(nodes, links, live), 3)


@query("m36_consensus_distance", with_("mesh3", """SELECT avg(d) / (SELECT sqrt(sum(m * m)) FROM (SELECT avg(v) AS m FROM mesh3 WHERE node % 7 <> 3 GROUP BY dim)) AS distance, count(*) AS nodes
 FROM (SELECT node, sqrt(sum((v - m) ^ 2)) AS d FROM (SELECT *, avg(v) OVER (PARTITION BY dim) AS m FROM mesh3 WHERE node % 7 <> 3) GROUP BY 1)"""), "distance")
def m36d(spark, d):
    models, nodes, links, live = mesh(spark, d)
    return M.consensus_distance(M.mix(models, M.metropolis(nodes, links, live), 3), live)


@query("m36_components", "WITH RECURSIVE e AS (SELECT DISTINCT vec_id AS a, vec_id + 1 AS b FROM embeddings), walk AS (SELECT DISTINCT vec_id AS node, vec_id AS root FROM embeddings WHERE vec_id % 50 <> 7 UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.node WHERE e.b % 50 <> 7 AND e.b IN (SELECT vec_id FROM embeddings)) SELECT node, min(root) AS root FROM walk GROUP BY 1")
def m36c(spark, d):
    """A line of all clients, broken where one in fifty is dead."""
    clients = A.updates(spark, d).select(F.col("client").alias("node"))
    return M.components(clients.where("node % 50 <> 7"), clients.select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst")))
