"""Queries of pooled geometry, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits, geometry as G
from ..operators.quantiles import with_quantiles
from ..sources import adapters as A
from ..sources.io import cut
from .ctes import cte, with_
from .registry import query

T = "key_seed, key_claimedStationId, key_window"
D = "greatest(sqrt((rxX - {x}) ^ 2 + (rxY - {y}) ^ 2), 1.0::DOUBLE)"


def fit_sql(rows: str, keys: str, x: str, y: str, power: str = "phy_rsrp_mean") -> str:
    """Ordinary least squares of power on -10 log10(range) as SQL."""
    return f"""SELECT {keys}, n_obs, c / vl AS claim_exp, my - c / vl * ml AS claim_a, sqrt(greatest(vy - c / vl * c, 0)) AS claim_rmse, 1 - greatest(vy - c / vl * c, 0) / vy AS claim_r2 FROM
 (SELECT {keys}, count(*) AS n_obs, covar_pop(y, l) AS c, var_pop(l) AS vl, var_pop(y) AS vy, avg(y) AS my, avg(l) AS ml FROM
 (SELECT *, {power} AS y, -10 * log10({D.format(x=x, y=y)}) AS l FROM {rows}) GROUP BY {keys}) WHERE n_obs >= 5"""


cte("fit", "units", fit_sql("units", T, "claimedX", "claimedY"))
cte("honest", "units", "SELECT *, sqrt((rxX - trueX) ^ 2 + (rxY - trueY) ^ 2) AS d FROM units WHERE label = 0 AND sqrt((rxX - trueX) ^ 2 + (rxY - trueY) ^ 2) > 1")
cte("law", "honest", "SELECT regr_intercept(phy_rsrp_mean, -10 * log10(d)) AS a, regr_slope(phy_rsrp_mean, -10 * log10(d)) AS n FROM honest")
cte("resid", "honest law", "SELECT honest.*, phy_rsrp_mean - (law.a - 10 * law.n * log10(d)) AS resid FROM honest, law")
BIN = "least(7, greatest(0, " + " + ".join(f"CAST(d >= {e} AS INT)" for e in G.EDGES) + " - 1))"


def cal(rows: str) -> str:
    return f"""SELECT bin, n, CASE WHEN n > 200 THEN m ELSE 0 END AS mu, greatest(coalesce(CASE WHEN n > 200 THEN s END, med), med * 0.5) AS sd FROM
 (SELECT *, quantile_cont(CASE WHEN n > 200 THEN s END, 0.5) OVER () AS med FROM (SELECT {BIN} AS bin, count(*) AS n, avg(resid) AS m, stddev_pop(resid) AS s FROM {rows} GROUP BY ALL))"""


def honest(spark, d):
    df = A.units(spark, d).where("label = 0")
    df = df.withColumn("d", F.hypot(F.col("rxX") - F.col("trueX"), F.col("rxY") - F.col("trueY"))).where("d > 1")
    return G.law_residual(df, F.col("d"), G.fit_law(df, F.col("d")))


@query("p07_window_mean", with_("rx", """SELECT rxNodeId, claimedStationId, CAST(floor(rxTimeMs / 604800000) AS BIGINT) AS "window", avg(claimedX) AS claimedX, avg(claimedY) AS claimedY FROM rx GROUP BY ALL HAVING max(claimedX) - min(claimedX) <= 1000"""), "claimedX claimedY")
def p07(spark, d):
    rows = A.rx(spark, d).withColumn("window", F.floor(F.col("rxTimeMs") / A.WEEK_MS))
    return G.window_mean(rows, ["rxNodeId", "claimedStationId", "window"], ["claimedX", "claimedY"], "claimedX")[0]


@query("g09_geometry_dropped", with_("rx", """SELECT count(*) AS dropped FROM (SELECT 1 FROM rx GROUP BY rxNodeId, claimedStationId, CAST(floor(rxTimeMs / 604800000) AS BIGINT) HAVING max(claimedX) - min(claimedX) > 1000)"""))
def g09(spark, d):
    rows = A.rx(spark, d).withColumn("window", F.floor(F.col("rxTimeMs") / A.WEEK_MS))
    return G.window_mean(rows, ["rxNodeId", "claimedStationId", "window"], ["claimedX", "claimedY"], "claimedX")[1]


@query("j10_attach_geometry", with_("units", f"""SELECT c.key_rxNodeId, {T}, o.rxX, k.claimedX FROM (SELECT rxNodeId AS key_rxNodeId, {T} FROM units) c
 JOIN (SELECT key_seed, key_window, rxNodeId AS key_rxNodeId, avg(rxX) AS rxX FROM units GROUP BY ALL) o USING (key_seed, key_rxNodeId, key_window) JOIN (SELECT {T}, avg(claimedX) AS claimedX FROM units GROUP BY ALL) k USING ({T})"""), "rxX claimedX")
def j10(spark, d):
    u = A.units(spark, d)
    obs = u.groupBy("key_seed", F.col("rxNodeId").alias("key_rxNodeId"), "key_window").agg(F.avg("rxX").alias("rxX"))
    claims = u.groupBy(*G.TRIPLE).agg(F.avg("claimedX").alias("claimedX"))
    return G.attach_geometry(u.select(F.col("rxNodeId").alias("key_rxNodeId"), *G.TRIPLE), obs, claims).select("key_rxNodeId", *G.TRIPLE, "rxX", "claimedX")


@query("j11_require_every_seed", with_("units", "SELECT key_seed, count(*) AS n FROM units GROUP BY 1"))
def j11(spark, d):
    return G.require_every_seed(A.units(spark, d), [f"s{k}" for k in range(1, 8)]).groupBy("key_seed").agg(F.count("*").alias("n"))


@query("j12_nearest_region", with_("units", """SELECT rxNodeId, key_claimedStationId, key_seed, (SELECT first(k ORDER BY sqrt((x - rxX) ^ 2 + (0 - rxY) ^ 2), k) FROM (VALUES (0, 0.0::DOUBLE), (1, 1500.0::DOUBLE), (2, 3000.0::DOUBLE), (3, 4500.0::DOUBLE)) r(k, x)) AS key_region FROM units"""))
def j12(spark, d):
    u = A.units(spark, d)
    rsu = u.select("key_seed").distinct().withColumn("nodeId", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("x", F.col("nodeId") * 1500.0).withColumn("y", F.lit(0.0))
    return G.nearest_region(u, rsu).select("rxNodeId", "key_claimedStationId", "key_seed", "key_region")


@query("p08_having_min", with_("units", f"SELECT {T}, rxNodeId, rxX FROM units WHERE ({T}) IN (SELECT ({T}) FROM units GROUP BY {T} HAVING count(*) >= 80)"), "rxX")
def p08(spark, d):
    return G.having_min(A.units(spark, d), G.TRIPLE, 80).select(*G.TRIPLE, "rxNodeId", "rxX")


cte("stn", "units", "SELECT key_seed, key_claimedStationId, key_window, max(claimedX) AS claimedX, max(claimedY) AS claimedY FROM units GROUP BY ALL")


@query("j23_permute_claims", with_("stn", """SELECT a.key_seed, a.key_claimedStationId, a.key_window, b.claimedX AS newX, b.claimedY AS newY FROM
 (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY key_seed, key_window ORDER BY key_claimedStationId) - 1 AS i FROM stn WINDOW w AS (PARTITION BY key_seed, key_window)) a JOIN
 (SELECT *, row_number() OVER (PARTITION BY key_seed, key_window ORDER BY key_claimedStationId) - 1 AS j FROM stn) b ON a.key_seed = b.key_seed AND a.key_window = b.key_window AND (a.i + 1 + ((a.key_window * 2654435761) % 4294967296) % (a.n - 1)) % a.n = b.j WHERE a.n > 1"""), "newX newY")
def j23(spark, d):
    stn = A.units(spark, d).groupBy(*G.TRIPLE).agg(F.max("claimedX").alias("claimedX"), F.max("claimedY").alias("claimedY"))
    return G.permute_claims(stn).select(*G.TRIPLE, "newX", "newY")


FIT_D = "claim_exp claim_a claim_rmse claim_r2"


@query("m01_claim_fit", with_("fit", "SELECT * FROM fit"), FIT_D)
def m01(spark, d):
    return G.claim_fit(A.units(spark, d))


@query("m01_residual_range_corr", with_("fit units", f"SELECT {T}, coalesce(abs(round(corr(l, r), 6)), 0) AS claim_range_corr FROM (SELECT {T}, 10 * log10({D.format(x='claimedX', y='claimedY')}) AS l, phy_rsrp_mean - claim_a + claim_exp * 10 * log10({D.format(x='claimedX', y='claimedY')}) AS r FROM units JOIN fit USING ({T})) GROUP BY ALL"), "claim_range_corr")
def m01c(spark, d):
    u = A.units(spark, d)
    return G.residual_range_corr(u, G.claim_fit(u)).withColumn("claim_range_corr", F.abs(F.round("claim_range_corr", 6)))


@query("m02_free_fit")
def m02(spark, d):
    return fits.free_fit(A.units(spark, d), halfwidth=18.0)


@query("m03_consensus")
def m03(spark, d):
    return fits.consensus(A.units(spark, d))


@query("m04_pool_means", with_("units", f"""SELECT {T}, count(*) AS n_recv, avg(rxX) AS pm_rxX, avg(phy_rsrp_mean) AS pm_phy_rsrp_mean, first(rxNodeId ORDER BY (rxNodeId * 2654435761) % 4294967296, rxNodeId, rxX, phy_rsrp_mean) AS one_rxNodeId,
 first(rxX ORDER BY (rxNodeId * 2654435761) % 4294967296, rxNodeId, rxX, phy_rsrp_mean) AS one_rxX, first(phy_rsrp_mean ORDER BY (rxNodeId * 2654435761) % 4294967296, rxNodeId, rxX, phy_rsrp_mean) AS one_phy_rsrp_mean FROM units GROUP BY ALL"""), "pm_rxX pm_phy_rsrp_mean one_rxX one_phy_rsrp_mean")
def m04(spark, d):
    return G.pool_means(A.units(spark, d), ["rxX", "phy_rsrp_mean"])


@query("m05_global_law", with_("law", "SELECT * FROM law"), "a n")
def m05(spark, d):
    df = A.units(spark, d).where("label = 0").withColumn("d", F.hypot(F.col("rxX") - F.col("trueX"), F.col("rxY") - F.col("trueY"))).where("d > 1")
    l = -10 * F.log10("d")
    return df.agg(F.regr_intercept(F.col("phy_rsrp_mean"), l).alias("a"), F.regr_slope(F.col("phy_rsrp_mean"), l).alias("n"))


@query("m06_calibrate", with_("resid", cal("resid")), "mu sd")
def m06(spark, d):
    return G.calibrate(honest(spark, d))


@query("m07_curved_law")
def m07(spark, d):
    df = honest(spark, d)
    b = G.fit_law_curved(df)
    l = F.log10("d")
    left = F.col("resid") - sum(F.lit(v) * F.pow(l, k) for k, v in enumerate(b))
    return df.agg(*[F.lit(v).alias(f"b{k}") for k, v in enumerate(b)], F.stddev_pop(left).alias("spread"), F.stddev_pop("resid").alias("base"))


SPLIT = """SELECT sqrt(avg(v)) AS within, sqrt(greatest(var_pop(m) - avg(v / n), 0)) AS between_links, count(*) AS links FROM (SELECT avg(resid) AS m, var_samp(resid) AS v, count(*) AS n FROM resid GROUP BY key_claimedStationId, rxNodeId % 10) WHERE n >= 3"""


@query("m08_variance_split", with_("resid", SPLIT), "within between_links")
def m08(spark, d):
    df = honest(spark, d).withColumn("rx10", F.col("rxNodeId") % 10)
    return G.variance_split(df, ["key_claimedStationId", "rx10"]).withColumnRenamed("between", "between_links")


@query("m09_ambiguity", with_("honest", "SELECT q, distance, distance * (pow(10.0::DOUBLE, 3.0::DOUBLE / 25.0) - 1) AS ambiguity FROM (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS q, unnest(quantile_cont(d, [0.1, 0.25, 0.5, 0.75, 0.9])) AS distance FROM honest)"), "q distance ambiguity")
def m09(spark, d):
    return G.ambiguity(honest(spark, d), 3.0, 2.5)


def bound_sql(rows: str, keys: str) -> str:
    """Position information with intercept and exponent eliminated, as SQL."""
    k = f"(-25.0::DOUBLE / ln(10.0::DOUBLE)) / dd"
    return f"""SELECT {keys}, n_obs, 3.0::DOUBLE * sqrt(j22 / det) AS free_along, 3.0::DOUBLE * sqrt(j11 / det) AS free_across, 3.0::DOUBLE / sqrt(j11) AS road_along, 3.0::DOUBLE / sqrt(det / (h + g)) AS major, 3.0::DOUBLE / sqrt(h + g) AS minor,
 90 - abs(degrees(atan2(2 * j12, j11 - j22)) / 2) AS angle, 3.0::DOUBLE / sqrt(kh - kg) AS major_known FROM (SELECT *, j11 * j22 - j12 * j12 AS det, (j11 + j22) / 2 AS h, sqrt(((j11 - j22) / 2) ^ 2 + j12 ^ 2) AS g, (kaa + kbb) / 2 AS kh, sqrt(((kaa - kbb) / 2) ^ 2 + kab ^ 2) AS kg FROM
 (SELECT {keys}, count(*) AS n_obs, count(*) * (var_pop(a) - covar_pop(a, l) ^ 2 / var_pop(l)) AS j11, count(*) * (covar_pop(a, b) - covar_pop(a, l) * covar_pop(b, l) / var_pop(l)) AS j12,
 count(*) * (var_pop(b) - covar_pop(b, l) ^ 2 / var_pop(l)) AS j22, sum(a * a) AS kaa, sum(a * b) AS kab, sum(b * b) AS kbb FROM
 (SELECT {keys}, {k} * (trueX - rxX) / dd AS a, {k} * (trueY - rxY) / dd AS b, 10 * log10(dd) AS l FROM (SELECT *, {D.format(x='trueX', y='trueY')} AS dd FROM {rows})) GROUP BY {keys})) WHERE n_obs >= 5 AND j11 > 0 AND j22 > 0 AND det > 0"""


LOGS = ["free_along", "free_across", "road_along", "major", "minor", "major_known"]
LOG_SQL = ", ".join(f"ln({c}) AS {c}" for c in LOGS)
cte("bound", "units", bound_sql("units", T))


def logs(df, cols):
    """Bounds span many orders of magnitude; their logarithms compare to a relative precision."""
    return df.withColumns({c: F.log(c) for c in cols})


@query("m10_position_bound", with_("bound", f"SELECT {T}, n_obs, {LOG_SQL}, angle FROM bound"), " ".join(LOGS) + " angle")
def m10(spark, d):
    return logs(G.position_bound(A.units(spark, d), 2.5, 3.0), LOGS)


@query("m12_bound_summary", with_("bound", """SELECT receivers, count(*) AS units, ln(quantile_cont(free_across, 0.5)) AS across, ln(quantile_cont(free_along, 0.5)) AS along, ln(quantile_cont(free_across, 0.5) / quantile_cont(free_along, 0.5)) AS anisotropy, ln(quantile_cont(road_along, 0.5)) AS road, ln(sqrt(avg(trace))) AS rms, ln(sqrt(avg(CASE WHEN trace <= top THEN trace END))) AS rms_trim FROM
 (SELECT *, quantile_cont(trace, 0.99) OVER (PARTITION BY receivers) AS top FROM (SELECT *, free_along ^ 2 + free_across ^ 2 AS trace, CASE WHEN n_obs < 10 THEN '5 to 9' WHEN n_obs < 25 THEN '10 to 24' WHEN n_obs < 85 THEN '25 to 84' ELSE '85 or more' END AS receivers FROM bound)) GROUP BY 1"""), "across along anisotropy road rms rms_trim")
def m12(spark, d):
    return logs(G.bound_summary(G.position_bound(A.units(spark, d), 2.5, 3.0)), ["across", "along", "anisotropy", "road", "rms", "rms_trim"])


cte("moved", "units", """SELECT * REPLACE (CASE WHEN rxNodeId % 4 = 0 THEN CASE WHEN rxNodeId % 8 < 4 THEN o ELSE -o END ELSE rxY END AS rxY), o AS move FROM units, (VALUES (10.0::DOUBLE), (50.0::DOUBLE)) v(o)""")


@query("m13_placement_sweep", with_("moved", f"SELECT move, count(*) AS units, ln(quantile_cont(free_across, 0.5)) AS across, ln(quantile_cont(free_along, 0.5)) AS along FROM ({bound_sql('moved', 'move, ' + T)}) GROUP BY 1"), "move across along")
def m13(spark, d):
    b = G.placement_sweep(A.units(spark, d), [10, 50], F.col("rxNodeId") % 4 == 0, 2.5, 3.0)
    b = cut(b.select("move", "free_across", "free_along"), "sweep")
    values = {c: F.col(c) for c in ("free_across", "free_along")}
    found = with_quantiles(b.groupBy("move").agg(F.count("*").alias("units")), b, ["move"], values, {"across": ("free_across", 0.5), "along": ("free_along", 0.5)})
    return logs(found, ["across", "along"])


@query("m11_median_radial")
def m11(spark, d):
    """Median radial error of each unit's bound over a fixed cloud of 512 points, summed without a join."""
    import math

    b = G.position_bound(A.units(spark, d), 2.5, 3.0)
    k = F.sequence(F.lit(0), F.lit(511))
    # a sunflower of normal radii: quantiles of the radius by rank, angles by the golden section
    cloud = F.transform(k, lambda i: F.hypot(F.col("major") * F.sqrt(-2 * F.log((i + 0.5) / 512.0)) * F.cos(i * (math.pi * (3 - 5**0.5))),
                                             F.col("minor") * F.sqrt(-2 * F.log((i + 0.5) / 512.0)) * F.sin(i * (math.pi * (3 - 5**0.5)))))
    s = F.sort_array(cloud)
    return b.select(*G.TRIPLE, ((F.get(s, F.lit(255)) + F.get(s, F.lit(256))) / 2).alias("median_radial"))


@query("m14_power_evasion", with_("units fit", f"""SELECT {T}, adversary, abs(gap - shift) AS single_resid, claim_rmse AS pooled_rmse, abs(claim_exp - 2.5) AS pooled_exp_dev FROM (SELECT {T}, unnest(['none', 'power-global', 'power-targeted']) AS adversary, unnest([0.0::DOUBLE, al, gap]) AS shift, gap FROM
 (SELECT {T}, avg(p - phy_rsrp_mean) AS al, first(p - phy_rsrp_mean ORDER BY rxNodeId, rxX, p - phy_rsrp_mean) AS gap FROM (SELECT *, -30 - 25 * log10({D.format(x='claimedX', y='claimedY')}) AS p FROM units) GROUP BY ALL)) JOIN fit USING ({T})"""), "single_resid pooled_rmse pooled_exp_dev")
def m14(spark, d):
    return G.power_evasion(A.units(spark, d), (-30.0, 2.5))


cte("lies", "units", """SELECT *, trueX + lv * cos(st * (2 * pi() / 72)) AS cx, trueY + lv * sin(st * (2 * pi() / 72)) AS cy FROM units, (VALUES (25.0::DOUBLE), (50.0::DOUBLE), (100.0::DOUBLE), (200.0::DOUBLE)) l("lv"), range(72) s(st)""")


@query("m15_best_response", with_("lies", f"""SELECT {T}, level, b.r AS best_rmse, b.st * 5.0::DOUBLE AS direction, least(b.st * 5.0::DOUBLE % 180, 180 - b.st * 5.0::DOUBLE % 180) AS off_axis, blocked FROM (SELECT {T}, lv AS level,
 min({{'r': round(claim_rmse, 6), 'st': st}}) FILTER (NOT off) AS b, count(*) FILTER (off) AS blocked FROM ({fit_sql('(SELECT *, abs(cy) > 18 AS off FROM lies)', T + ', lv, st, off', 'cx', 'cy')}) GROUP BY ALL)"""), "level best_rmse direction off_axis")
def m15(spark, d):
    return G.best_response(A.units(spark, d), [25, 50, 100, 200], lateral=18.0)


@query("m15_toward_estimate")
def m15e(spark, d):
    """How near the best lies come to where the free fit puts the sender."""
    u = A.units(spark, d)
    truth = u.groupBy(*G.TRIPLE).agg(F.max("trueX").alias("trueX"), F.max("trueY").alias("trueY"))
    return G.toward_estimate(G.best_response(u, [25, 50, 100, 200], lateral=18.0), truth, fits.free_fit(u, 18.0))


@query("m16_caught", with_("fit", """SELECT key_seed, avg(CAST(claim_rmse > (SELECT quantile_cont(claim_rmse, 0.95) FROM fit WHERE key_claimedStationId % 5 > 0) AS INT)) AS one_sided,
 avg(CAST(claim_rmse < (SELECT quantile_cont(claim_rmse, 0.025) FROM fit WHERE key_claimedStationId % 5 > 0) OR claim_rmse > (SELECT quantile_cont(claim_rmse, 0.975) FROM fit WHERE key_claimedStationId % 5 > 0) AS INT)) AS two_sided FROM fit WHERE key_claimedStationId % 5 = 0 GROUP BY 1"""), "one_sided two_sided")
def m16(spark, d):
    f = G.claim_fit(A.units(spark, d))
    return G.caught(f.where("key_claimedStationId % 5 > 0"), f.where("key_claimedStationId % 5 = 0"), "claim_rmse", ["key_seed"])


@query("m17_estimator_study")
def m17(spark, d):
    df = honest(spark, d)
    cal_ = {r["bin"]: r for r in G.calibrate(df.where("key_seed IN ('s1', 's2')")).collect()}  # at most eight bins
    mu, sd = [cal_[b]["mu"] if b in cal_ else 0.0 for b in range(8)], [cal_[b]["sd"] if b in cal_ else 1.0 for b in range(8)]
    units = A.units(spark, d).where("key_seed NOT IN ('s1', 's2')")
    truth = units.groupBy(*G.TRIPLE).agg(F.max("trueX").alias("trueX"), F.max("trueY").alias("trueY"))
    return fits.estimator_study(units, truth, mu, sd, 18.0)


def pick_sql(side: str) -> str:
    return f"coalesce((SELECT mu FROM ({cal(side)}) c WHERE c.bin = {BIN.replace('d >=', 'b.d >=')}), 0)"


cte("ra", "resid", "SELECT * FROM resid WHERE key_claimedStationId % 2 = 0")
cte("rb", "resid", "SELECT * FROM resid WHERE key_claimedStationId % 2 = 1")
cte("ca", "ra", cal("ra"))
cte("cb", "rb", cal("rb"))


@query("m18_correction_transfer", with_("rb ca cb", f"""SELECT base, own, transferred, (base - transferred) / (base - own) AS share FROM (SELECT stddev_pop(resid) AS base, stddev_pop(resid - coalesce(cb.mu, 0)) AS own, stddev_pop(resid - coalesce(ca.mu, 0)) AS transferred
 FROM (SELECT *, {BIN} AS bin FROM rb) b LEFT JOIN ca ON ca.bin = b.bin LEFT JOIN cb ON cb.bin = b.bin)"""), "base own transferred share")
def m18(spark, d):
    df = honest(spark, d)
    return G.transfer(df.where("key_claimedStationId % 2 = 0"), df.where("key_claimedStationId % 2 = 1"))


@query("m19_confounding", with_("resid", f"""SELECT bin, n, sl AS slope, sl / sqrt((yy - sl ^ 2 * xx) / (n - 2) / xx) AS t, abs(sl) * reach AS spread FROM (SELECT {BIN} AS bin, count(*) AS n, regr_slope(resid, trueX / 1000) AS sl, regr_sxx(resid, trueX / 1000) AS xx, regr_syy(resid, trueX / 1000) AS yy, (max(trueX) - min(trueX)) / 1000 AS reach FROM resid GROUP BY 1) WHERE n >= 500"""), "slope t spread")
def m19(spark, d):
    return G.confounding(honest(spark, d))


@query("m20_localisation_check")
def m20(spark, d):
    u = A.units(spark, d)
    return G.localisation_check(fits.free_fit(u, 18.0), u.groupBy(*G.TRIPLE).agg(F.max("trueX").alias("trueX"), F.max("trueY").alias("trueY"), F.max("label").alias("label")))


@query("m21_detection_floor")
def m21(spark, d):
    f = G.claim_fit(A.units(spark, d))
    st = f.select("key_seed", F.col("key_claimedStationId").alias("station"), (1 + F.col("claim_rmse") * 20).alias("offset"), (F.col("claim_rmse") > 2).alias("caught"))
    return fits.floor_interval(fits.detection_floor(st))


cte("grid", "units", "SELECT *, trueX + gx AS cx, trueY + gy AS cy FROM (SELECT * FROM units), (SELECT unnest([-200, -100, 0, 100, 200]) AS gx), (SELECT unnest([-200, -100, 0, 100, 200]) AS gy)")


@query("m37_response_surface", with_("grid", f"SELECT {T}, gx, gy, claim_rmse, claim_exp FROM ({fit_sql('grid', T + ', gx, gy', 'cx', 'cy')})"), "claim_rmse claim_exp")
def m37(spark, d):
    return G.surface(A.units(spark, d), 200, 100)
