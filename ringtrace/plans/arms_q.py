"""Queries of detection arms and of the release bundle; those without a trained model have an SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arms as M, bundle as B, geometry as G, learn as L, partition as P, reports as R
from ..sources import adapters as A, io as IO
from .ctes import cte, with_
from .registry import query
from .scan_q import REL, release

#: Half-width of the road, bands of displacement, classes of constant offset.
HALF, EDGES, LADDER = 4.0, [0.0, 15.0, 30.0, 50.0, 80.0], [1, 11]
SHIFT = "CASE key_claimedStationId % 5 WHEN 0 THEN 1 WHEN 1 THEN 11 ELSE 0 END"
cte("claims", "fit units", f"""SELECT key_seed, key_claimedStationId, key_window, claim_rmse / 4 AS score, {SHIFT} AS label_attackId, y * (1 + key_window % 2) AS claimedY FROM fit JOIN
 (SELECT key_seed, key_claimedStationId, key_window, min(claimedY) AS y FROM units GROUP BY ALL) USING (key_seed, key_claimedStationId, key_window)""")
cte("shift", "claims", "SELECT DISTINCT key_seed, key_claimedStationId, CAST(key_claimedStationId % 97 AS DOUBLE) AS off FROM claims")


def claims(spark, d):
    """Units with their claim's misfit as score; stations claim both lanes in turn, so some are on and off the road."""
    u = A.units(spark, d)
    y = u.groupBy(*G.TRIPLE).agg((F.min("claimedY") * (1 + F.col("key_window") % 2)).alias("claimedY"))
    return G.claim_fit(u).join(y, G.TRIPLE).select(*G.TRIPLE, (F.col("claim_rmse") / 4).alias("score"), F.expr(SHIFT).alias("label_attackId"), "claimedY")


def shifts(rows):
    return rows.select(*M.CLAIM).distinct().withColumn("offset", (F.col("key_claimedStationId") % 97).cast("double"))


@query("m38_road_counts", with_("claims", f"""SELECT CAST(sum(b) AS BIGINT) AS benign, CAST(sum(bo) AS BIGINT) AS benign_off, CAST(sum(c) AS BIGINT) AS "offset", CAST(sum(co) AS BIGINT) AS offset_off, count(*) FILTER (c > 0 AND co = 0) AS stations_on, count(*) FILTER (c > 0 AND co = c) AS stations_off, count(*) FILTER (co > 0 AND co < c) AS stations_mixed
 FROM (SELECT count(*) FILTER (label_attackId = 0) AS b, count(*) FILTER (label_attackId = 0 AND abs(claimedY) > {HALF}) AS bo, count(*) FILTER (label_attackId > 0) AS c, count(*) FILTER (label_attackId > 0 AND abs(claimedY) > {HALF}) AS co FROM claims GROUP BY key_seed, key_claimedStationId)"""))
def m38c(spark, d):
    return M.road_counts(claims(spark, d), HALF, LADDER)


def curve_sql(arm: str, where: str, t: float) -> str:
    det = f"SELECT key_seed, key_claimedStationId, label_attackId, avg(CAST(score > {t}::DOUBLE AS INT)) AS rate, count(*) AS windows FROM claims WHERE {where} GROUP BY ALL"
    band = " + ".join(f"CAST(off >= {e}::DOUBLE AS INT)" for e in EDGES)
    return f"""SELECT '{arm}' AS arm, {t}::DOUBLE AS threshold, {band} AS band, count(*) AS stations, CAST(sum(windows) AS BIGINT) AS windows, CASE WHEN count(*) >= 3 THEN avg(rate) END AS rate, CASE WHEN count(*) >= 3 THEN avg(CAST(rate > 0.5 AS INT)) END AS caught,
 (SELECT avg(rate) FROM ({det}) WHERE label_attackId = 0) AS benign_rate FROM ({det}) JOIN shift USING (key_seed, key_claimedStationId) WHERE label_attackId > 0 GROUP BY 3"""


ROAD_SQL = f"NOT (abs(claimedY) > {HALF} AND label_attackId <> 0)"


@query("m38_displacement_curves", with_("claims shift", f"{curve_sql('all', 'true', 0.5)} UNION ALL {curve_sql('on road', ROAD_SQL, 0.5)} UNION ALL {curve_sql('strict', ROAD_SQL, 1.5)}"), "threshold rate caught benign_rate")
def m38d(spark, d):
    """Misfit of the claim as score: all claims, those a map check passes, and these at a higher threshold."""
    rows = IO.cut(claims(spark, d), "claims")
    road = rows.where(~((F.abs("claimedY") > HALF) & (F.col("label_attackId") != 0)))
    return M.curves({"all": (rows, 0.5), "on road": (road, 0.5), "strict": (road, 1.5)}, shifts(rows), EDGES, 3, LADDER)


@query("m38_onroad_arms")
def m38a(spark, d):
    """Trained on the misfit, mean power and number of receivers, folds by station."""
    rows = claims(spark, d)
    n = A.units(spark, d).groupBy(*G.TRIPLE).agg(F.count("*").alias("pool_n"), F.avg("phy_rsrp_mean").alias("pool_power"))
    units = IO.cut(rows.join(n, G.TRIPLE).withColumn("label_txNodeId", F.col("key_claimedStationId")), "arm-units")
    return M.onroad_arms(units, shifts(units), ["score", "pool_n", "pool_power"], HALF, EDGES, 3, LADDER)


@query("m38_region_curves")
def m38r(spark, d):
    """One region alone and any region, by the misfit of the claim over that region's receivers."""
    obs = A.units(spark, d).withColumn("key_region", F.floor(F.col("rxX") / 1500).cast("long"))
    scored = G.claim_fit(obs, [*G.TRIPLE, "key_region"]).select(*G.TRIPLE, (F.col("claim_rmse") / 4).alias("score"), F.expr(SHIFT).alias("label_attackId"))
    units = IO.cut(claims(spark, d), "region-claims")
    return M.region_curves(IO.cut(scored, "region-units"), 0.05, shifts(units), units, HALF, EDGES, 3, LADDER)


@query("j26_attach_offroad", with_("claims", f"""SELECT key_seed, key_claimedStationId, rate, off_share, CASE WHEN off_share = 0 THEN 'on' WHEN off_share = 1 THEN 'off' ELSE 'mixed' END AS kind
 FROM (SELECT key_seed, key_claimedStationId, avg(CAST(score > 0.5 AS INT)) AS rate, avg(CAST(abs(claimedY) > {HALF} AS INT)) AS off_share FROM claims GROUP BY ALL)"""), "rate off_share")
def j26(spark, d):
    rows = claims(spark, d)
    return M.attach_offroad(R.flag_rates(rows, M.CLAIM, 0.5).drop("windows"), rows, HALF)


def halves(spark, d, t):
    """Station rates of two runs, the second one read at threshold t."""
    rows = IO.cut(claims(spark, d).withColumn("attack", F.col("label_attackId") > 0), "halves")
    return [R.flag_rates(rows.where(f"key_seed {side}"), [*M.CLAIM, "attack"], x).drop("windows") for side, x in (("<= 's3'", 0.4), ("> 's3'", t))]


def borrow_sql(t: float) -> str:
    det = "SELECT key_seed, key_claimedStationId, label_attackId > 0 AS attack, avg(CAST(score > CASE WHEN key_seed <= 's3' THEN 0.4::DOUBLE ELSE {0}::DOUBLE END AS INT)) AS rate, key_seed > 's3' AS borrowed FROM claims GROUP BY ALL".format(t)
    gap = f"(SELECT abs(avg(rate) FILTER (borrowed) - avg(rate) FILTER (NOT borrowed)) FROM ({det}) WHERE NOT attack)"
    return with_("claims", f"SELECT *, {gap} AS gap, {gap} > 0.05::DOUBLE AS refused FROM ({det}) WHERE NOT borrowed OR {gap} <= 0.05::DOUBLE")


@query("j26_borrow_stations", borrow_sql(0.4), "rate gap")
def j26b(spark, d):
    return M.borrow(*halves(spark, d, 0.4), most=0.05)


@query("j26_borrow_refused", borrow_sql(0.1), "rate gap")
def j26r(spark, d):
    """The other run is read at a looser threshold."""
    return M.borrow(*halves(spark, d, 0.1), most=0.05)


@query("q07_check_bundle")
def q07(spark, d):
    """The whole release written, summed and checked from its files, with the figure of the rows it was written from."""
    rows = IO.cut(release(spark, d).select(*REL.names), "release")
    splits = IO.cut(P.assign(P.station_table(release(spark, d))).select(*P.STATION, "split"), "release-splits")
    known = P.attach_split(rows.where("scenario = 'dense'"), splits, P.STATION)
    f1 = B.baseline(known, ["app_quantity"]).first()["macro_f1"]
    folder = B.write_bundle(rows, splits, [0, 1, 11], IO.scratch(spark, "release-bundle"))
    return B.check_bundle(spark, folder, REL, [0, 1, 11], published=f1)
