"""Queries of integrity gates and detector protocols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as Q, geometry as G, learn as L, neighbours as N, partition as P, reports as R
from ..sources import adapters as A
from .ctes import cte, with_
from .reports_q import pred
from .registry import query

FS = ["app_quantity", "app_price", "phy_discount", "phy_tax"]
Y = "label_attackId"
cte("quant", "corpus", "SELECT label_attackId, label_txNodeId, " + ", ".join(f"round_even({f} / 0.01::DOUBLE, 0) * 0.01::DOUBLE AS {f}" for f in FS) + " FROM corpus")


@query("q01_duplicates", with_("quant", f'SELECT label_attackId, "rows", "distinct", 1 - "distinct" / CAST("rows" AS DOUBLE) AS duplicates FROM (SELECT label_attackId, count(*) AS "rows", count(DISTINCT ({", ".join(FS)})) AS "distinct" FROM quant GROUP BY 1 UNION ALL SELECT NULL, count(*), count(DISTINCT ({", ".join(FS)})) FROM quant)'), "duplicates")
def q01(spark, d):
    return Q.gate_duplicates(A.corpus(spark, d), FS, Y)


@query("q02_variation", with_("corpus", "SELECT label_attackId, " + " + ".join(f"CAST(coalesce(abs(stddev_samp({f}) / nullif(abs(avg({f})), 0)), 0) < 0.01 AS INT)" for f in FS) + " AS flat FROM corpus GROUP BY 1"))
def q02(spark, d):
    return Q.gate_variation(A.corpus(spark, d), FS, Y)


@query("q03_overlap", with_("quant", f"SELECT avg(CAST((app_quantity, phy_discount, phy_tax) IN (SELECT (app_quantity, phy_discount, phy_tax) FROM quant WHERE label_txNodeId % 5 > 0) AS INT)) AS overlap FROM quant WHERE label_txNodeId % 5 = 0"), "overlap")
def q03(spark, d):
    df = A.corpus(spark, d)
    return Q.gate_overlap(df.where("label_txNodeId % 5 > 0"), df.where("label_txNodeId % 5 = 0"), ["app_quantity", "phy_discount", "phy_tax"])


@query("q04_nearest_neighbour")
def q04(spark, d):
    df = A.corpus(spark, d)
    return R.metrics_of_counts(N.nearest_counts(df.where("label_txNodeId % 5 > 0"), df.where("label_txNodeId % 5 = 0"), FS, Y))


@query("q04_small_tree")
def q04b(spark, d):
    from pyspark.ml.classification import DecisionTreeClassifier

    df = A.corpus(spark, d)
    m = L.fit(df.where("label_txNodeId % 5 > 0"), FS, Y, DecisionTreeClassifier(labelCol="idx", maxDepth=3))
    return R.metrics(L.score(m, df.where("label_txNodeId % 5 = 0"), FS, [F.col(Y).alias("y")]))


@query("q05_range", with_("corpus", " UNION ALL ".join(f"SELECT '{f}' AS feature, {c} AS class, avg(CAST({f} < lo OR {f} > hi AS INT)) AS outside FROM corpus, (SELECT min({f}) AS lo, max({f}) AS hi FROM corpus WHERE label_attackId = {c}) WHERE label_attackId <> {c}" for f in FS for c in (1, 11))), "outside")
def q05(spark, d):
    return Q.gate_range(A.corpus(spark, d), FS, Y)


_DEAD = [*FS, "app_flat", "phy_none", "app_two"]
cte("flats", "corpus", "SELECT *, CASE WHEN label_attackId = 0 THEN 1.0::DOUBLE ELSE phy_tax END AS app_flat, CAST(NULL AS DOUBLE) AS phy_none, CASE WHEN key_rxNodeId % 7 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS app_two FROM corpus")


@query("q06_dead_features", with_("flats", " UNION ALL ".join(f"SELECT '{f}' AS feature FROM flats WHERE label_attackId = 0 HAVING count(DISTINCT {f}) <= 1" for f in _DEAD)))
def q06(spark, d):
    """Features planted beside the given ones: one flat on benign rows only, one without values, one of two values."""
    two = F.when(F.col("key_rxNodeId") % 7 == 0, 2.0).otherwise(1.0)
    df = A.corpus(spark, d).withColumn("app_flat", F.when(F.col(Y) == 0, 1.0).otherwise(F.col("phy_tax"))).withColumn("phy_none", F.lit(None).cast("double")).withColumn("app_two", two)
    return Q.gate_dead(df, _DEAD, Y)


@query("q06_balance", with_("corpus", "SELECT label_attackId, n / CAST(sum(n) OVER () AS DOUBLE) AS share, n / CAST(sum(n) OVER () AS DOUBLE) < 0.9::DOUBLE AS ok FROM (SELECT label_attackId, count(*) AS n FROM corpus GROUP BY 1)"), "share")
def q06b(spark, d):
    return Q.gate_balance(A.corpus(spark, d), Y)


@query("q07_check_release")
def q07(spark, d):
    df = A.corpus(spark, d)
    one = df.withColumn("label_txNodeId", F.col("label_txNodeId"))
    return Q.check_release(one, P.assign(P.station_table(one)).select(*P.STATION, "split"), one.count(), FS)


@query("q08_check_campaign")
def q08(spark, d):
    return Q.check_campaign(A.tx(spark, d), A.stations(spark, d), A.WEEK_MS)


def alarm_sql(p: str) -> str:
    """The alarm for predictions ``p``: macro F1 over the classes that occur, at least 0.9."""
    return with_("pred", f"""SELECT (SELECT avg(CAST(y = p AS INT)) FROM c) AS accuracy, avg(f1) >= 0.9::DOUBLE AS alarm FROM (SELECT k, 2 * count(*) FILTER (y = k AND p = k) / CAST(count(*) FILTER (y = k) + count(*) FILTER (p = k) AS DOUBLE) AS f1
 FROM c, (SELECT y AS k FROM c UNION SELECT p FROM c) GROUP BY 1)""").replace("SELECT (SELECT", f", c AS (SELECT y, {p} AS p FROM pred) SELECT (SELECT", 1)


@query("q09_leakage_alarm", alarm_sql("p"), "accuracy")
def q09(spark, d):
    return Q.leakage_alarm(R.metrics(pred(spark, d))).select("accuracy", "alarm")


LEAK = "CASE WHEN key_rxNodeId % 50 = 0 THEN p ELSE y END"


@query("q09_leakage_alarm_planted", alarm_sql(LEAK), "accuracy")
def q09p(spark, d):
    """Predictions that see the label in 49 rows of 50."""
    return Q.leakage_alarm(R.metrics(pred(spark, d).withColumn("p", F.expr(LEAK)))).select("accuracy", "alarm")




@query("m23_fit_score")
def m23(spark, d):
    df = A.corpus(spark, d)
    m = L.fit(df.where("label_txNodeId % 5 > 0"), FS, Y)
    return L.score(m, df.where("label_txNodeId % 5 = 0"), FS, ["key_seed", "key_rxNodeId", F.col(Y).alias("y")]).drop("prob", "chances")


@query("m24_out_of_fold")
def m24(spark, d):
    return L.out_of_fold(A.corpus(spark, d), FS, Y, "label_txNodeId", keep=["key_seed", "key_rxNodeId"]).drop("prob", "chances")


@query("m24_fold_seeds")
def m24s(spark, d):
    """Predictions from probabilities averaged over three fold seeds; order and line name a row."""
    key = ["key_seed", "key_rxNodeId"]
    return L.likeliest_of(L.mean_chances(A.corpus(spark, d), FS, Y, "label_txNodeId", key), key)


@query("m25_benchmark")
def m25(spark, d):
    df = A.corpus(spark, d)
    return L.benchmark(df, {k: v for k, v in P.blocks_of(df, ["phy_discount"]).items() if k in ("app", "phy", "fused")}, Y, "label_txNodeId", inert=[11])


@query("m25_importances")
def m25i(spark, d):
    return L.importances(A.corpus(spark, d), FS, Y)


def receivers(spark, d):
    return A.units(spark, d).withColumn("away", F.hypot(F.col("rxX") - F.col("claimedX"), F.col("rxY") - F.col("claimedY"))).withColumn("label_tx", F.col("key_claimedStationId"))


@query("m27_pool_arms")
def m27(spark, d):
    return L.all_arms(receivers(spark, d), ["away", "phy_rsrp_mean"], G.TRIPLE, "label", "label_tx")


@query("m27_receiver_sweep")
def m27s(spark, d):
    return L.receiver_sweep(receivers(spark, d), ["away", "phy_rsrp_mean"], G.TRIPLE, "label", "label_tx", [6, 24])


@query("m29_select_in_fold")
def m29(spark, d):
    return L.select_in_fold(A.corpus(spark, d), FS, Y, "label_txNodeId", [1, 3])


@query("m29_stability")
def m29s(spark, d):
    return L.stability(L.select_in_fold(A.corpus(spark, d), FS, Y, "label_txNodeId", [2]))


@query("m30_families")
def m30(spark, d):
    return R.metrics_of_counts(L.families(A.corpus(spark, d), FS, Y, "label_txNodeId", counts=True), ["family"])


@query("m30_best_family")
def m30b(spark, d):
    return L.best_family(R.scores_of_counts(L.families(A.corpus(spark, d), FS, Y, "label_txNodeId", counts=True), ["family"]))


@query("m31_cross_scenario")
def m31(spark, d):
    df = A.corpus(spark, d).withColumn("scenario", F.when(F.col("label_txNodeId") % 2 == 0, "dense").otherwise("sparse"))
    return L.cross_scenario(df, "scenario", FS, Y)


@query("m32_temporal")
def m32(spark, d):
    df = A.corpus(spark, d)
    return L.temporal(df, "key_window", {k: v for k, v in P.blocks_of(df, ["phy_discount"]).items() if k in ("app", "phy", "fused")}, Y)


@query("m32_prequential")
def m32p(spark, d):
    return L.prequential(A.corpus(spark, d), "key_window", 10, FS, Y)


@query("m34_separability")
def m34(spark, d):
    return L.separability(A.corpus(spark, d), FS, Y, [1, 11], "label_txNodeId")


@query("m38_road_and_region_arms")
def m38(spark, d):
    """On-road units only against all, at the threshold that gives the same false-flag rate."""
    f = G.claim_fit(A.units(spark, d)).select("key_seed", "key_claimedStationId", F.col("claim_rmse").alias("score"), (F.col("key_claimedStationId") % 5 == 0).cast("int").alias("y"), (F.col("key_claimedStationId") % 7 - 3).alias("off"))
    out = None
    for arm, rows in (("all", f), ("on-road", f.where(F.abs("off") <= 2))):
        t = R.matched_threshold(rows.where("y = 0"), ["key_seed", "key_claimedStationId"], 0.05).first()["threshold"]
        one = rows.groupBy("y").agg(F.lit(arm).alias("arm"), F.lit(t).alias("threshold"), F.avg((F.col("score") > t).cast("int")).alias("flagged"))
        out = one if out is None else out.unionByName(one)
    return out


@query("m38_region_arms")
def m38r(spark, d):
    """Regions of four roadside units; one region alone and any region at the same benign false-flag rate."""
    u = A.units(spark, d)
    rsu = u.select("key_seed").distinct().withColumn("nodeId", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("x", F.col("nodeId") * 1500.0).withColumn("y", F.lit(0.0))
    return L.region_arms(G.nearest_region(u, rsu), 0.05)
