"""Queries of corpus hygiene, splits and samples, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import partition as P
from ..sources import adapters as A
from .ctes import cte, with_
from .registry import query

C = "label_attackId"


def h(x: str, seed: int = 0) -> str:
    return f"(({x} * 2654435761 + {seed * 40503}) % 4294967296)"


cte("st", "corpus", "SELECT key_seed, label_txNodeId, min(label_attackId) AS label_attackId, count(*) AS windows, count(DISTINCT key_claimedStationId) AS claimed_ids FROM corpus GROUP BY ALL")
cte("split", "st", f"""SELECT key_seed, label_txNodeId, label_attackId, CASE WHEN r <= tr THEN 'train' WHEN r <= tr + va THEN 'validation' ELSE 'test' END AS split FROM
 (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(round_even(n * 0.2::DOUBLE, 0), n - tr - 1)) ELSE round_even(n * 0.2::DOUBLE, 0) END AS va FROM
 (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(round_even(n * 0.6::DOUBLE, 0), n - 2)) ELSE round_even(n * 0.6::DOUBLE, 0) END AS tr FROM
 (SELECT *, row_number() OVER (PARTITION BY label_attackId ORDER BY {h('label_txNodeId')}, key_seed, label_txNodeId) AS r, count(*) OVER (PARTITION BY label_attackId) AS n FROM st)))""")


@query("p01_clean", with_("corpus", "SELECT key_seed, count(*) AS n FROM corpus WHERE label_clean = 1 GROUP BY 1"))
def p01(spark, d):
    return P.clean(A.corpus(spark, d)).groupBy("key_seed").agg(F.count("*").alias("n"))


def means(df, names):
    """(feature, mean) of the named columns."""
    row = df.agg(*[F.avg(n).alias(n) for n in names])
    return row.unpivot([], names, "feature", "mean")


def means_sql(rows: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS feature, avg({n}) AS mean FROM {rows}" for n in names)


@query("p02_feature_columns", with_("corpus", means_sql("corpus", ["app_quantity", "app_price", "phy_discount", "phy_tax"])), "mean")
def p02(spark, d):
    df = P.check_features(A.corpus(spark, d), ["app_quantity", "app_price", "phy_discount", "phy_tax"])
    return means(df, P.feature_columns(df))


@query("p04_blocks", with_("corpus", "SELECT avg(app_quantity + app_price) AS app, avg(phy_discount + phy_tax) AS phy, avg(phy_tax) AS radio FROM corpus"), "app phy radio")
def p04(spark, d):
    df = A.corpus(spark, d)
    b = P.blocks_of(df, ["phy_discount"])
    return df.agg(*[F.avg(sum((F.col(c) for c in b[k]), F.lit(0.0))).alias(k) for k in ("app", "phy", "radio")])


@query("p05_matrix", with_("corpus", "SELECT key_rxNodeId, key_seed, CAST(CASE WHEN phy_tax > 0 THEN coalesce(CASE WHEN phy_discount > 0 THEN phy_discount END, -999) ELSE -999 END AS FLOAT) AS phy_discount FROM corpus"))
def p05(spark, d):
    df = A.corpus(spark, d).withColumn("phy_discount", F.when(F.col("phy_tax") > 0, F.when(F.col("phy_discount") > 0, F.col("phy_discount"))).otherwise(float("inf")))
    return P.matrix(df, ["phy_discount"], -999.0).select("key_rxNodeId", "key_seed", "phy_discount")


@query("p06_by_role", with_("corpus", "SELECT count(*) FILTER (key_observer_role = 'rsu') AS kept, count(*) AS total FROM corpus"))
def p06(spark, d):
    return P.by_role(A.corpus(spark, d), "rsu")[1]


@query("p09_seed_offset", with_("corpus", "SELECT key_seed, label_txNodeId % 100000 + CAST(substr(key_seed, 2) AS BIGINT) * 100000 AS id, count(*) AS n FROM corpus GROUP BY ALL"))
def p09(spark, d):
    return P.rebase(A.corpus(spark, d), "label_txNodeId").groupBy("key_seed", F.col("label_txNodeId").alias("id")).agg(F.count("*").alias("n"))


cte("ev", "corpus", "SELECT * FROM corpus WHERE label_txNodeId % 2 = 0")
cte("od", "corpus", "SELECT * FROM corpus WHERE label_txNodeId % 2 = 1")


def halves(spark, d):
    df = A.corpus(spark, d)
    return df.where("label_txNodeId % 2 = 0"), df.where("label_txNodeId % 2 = 1")


@query("p11_union_corpora", with_("ev od", """SELECT key_seed, label_txNodeId, count(*) AS n FROM (SELECT key_seed, label_txNodeId FROM ev UNION ALL SELECT 'b_' || key_seed, label_txNodeId + 1 + (SELECT max(label_txNodeId) FROM ev) FROM od) GROUP BY ALL"""))
def p11(spark, d):
    a, b = halves(spark, d)
    return P.union_corpora(a, b, "b_", ["label_txNodeId"]).groupBy("key_seed", "label_txNodeId").agg(F.count("*").alias("n"))


@query("p12_shared_features", with_("ev", means_sql("ev", ["app_quantity", "phy_tax"])), "mean")
def p12(spark, d):
    a, b = halves(spark, d)
    return means(a, P.shared_features(a, b.select("app_quantity", "phy_tax")))


@query("p13_label_copies", with_("corpus", """SELECT unnest(['app_quantity', 'copy']) AS feature, 'label_attackId' AS label, unnest([bool_and(app_quantity = label_attackId), true]) AS same FROM corpus"""))
def p13(spark, d):
    return P.copies(A.corpus(spark, d).withColumn("copy", F.col(C)), ["app_quantity", "copy"], [C])


@query("p14_key_string", with_("corpus", "SELECT concat_ws(':', key_seed, key_rxNodeId, key_claimedStationId) AS k, count(*) AS n FROM corpus GROUP BY 1"))
def p14(spark, d):
    return A.corpus(spark, d).groupBy(F.concat_ws(":", "key_seed", "key_rxNodeId", "key_claimedStationId").alias("k")).agg(F.count("*").alias("n"))


@query("p15_on_road", with_("rx", "SELECT claimedStationId, avg(CAST(abs(claimedY) <= 1 AS INT)) AS share, CASE avg(CAST(abs(claimedY) <= 1 AS INT)) WHEN 1 THEN 'on' WHEN 0 THEN 'off' ELSE 'mixed' END AS kind FROM rx GROUP BY 1"), "share")
def p15(spark, d):
    return P.on_road(A.rx(spark, d), 1)


@query("j17_attach_split", with_("corpus split", "SELECT split, count(*) AS n FROM corpus LEFT JOIN split USING (key_seed, label_txNodeId) GROUP BY 1"))
def j17(spark, d):
    df = A.corpus(spark, d)
    return P.attach_split(df, P.assign(P.station_table(df)), P.STATION, complete=True).groupBy("split").agg(F.count("*").alias("n"))


@query("j18_held_out", with_("corpus", f"SELECT count(*) AS n, count(DISTINCT label_txNodeId) AS stations FROM corpus WHERE {h('label_txNodeId')} >= 0.2::DOUBLE * 4294967296"))
def j18(spark, d):
    df = A.corpus(spark, d)
    return P.held_out(df, P.holdout(df, "label_txNodeId", 0.2), ["label_txNodeId"])[1].agg(F.count("*").alias("n"), F.count_distinct("label_txNodeId").alias("stations"))


@query("j19_overlap_count", with_("ev od", "SELECT count(*) AS shared FROM (SELECT key_rxNodeId FROM ev INTERSECT SELECT key_rxNodeId FROM od)"))
def j19(spark, d):
    return P.overlap_count(*halves(spark, d), ["key_rxNodeId"])


@query("j20_fingerprint", with_("tx", """SELECT key_seed, sha1(string_agg(part, ',' ORDER BY part)) AS "print" FROM (SELECT key_seed, sha1(string_agg(s, ',' ORDER BY s)) AS part FROM (SELECT key_seed, ((txNodeId * 2654435761) % 4294967296) % 1024 AS bucket, concat_ws(':', txNodeId, CAST(round_even(first(trueX ORDER BY txTimeMs, msgUid) * 100, 0) AS BIGINT), CAST(round_even(first(trueY ORDER BY txTimeMs, msgUid) * 100, 0) AS BIGINT)) AS s FROM tx WHERE attackId = 0 GROUP BY key_seed, txNodeId) GROUP BY key_seed, bucket) GROUP BY 1"""))
def j20(spark, d):
    return P.require_distinct_prints(P.fingerprint(A.tx(spark, d)))


@query("j21_twin_share", with_("tx", """SELECT common, common / CAST(least(na, nb) AS DOUBLE) AS share FROM (SELECT (SELECT count(*) FROM (SELECT round_even(trueX, 0), round_even(trueY, 0) FROM tx WHERE txNodeId % 2 = 0 INTERSECT SELECT round_even(trueX, 0), round_even(trueY, 0) FROM tx WHERE txNodeId % 2 = 1)) AS common,
 (SELECT count(*) FROM (SELECT DISTINCT round_even(trueX, 0), round_even(trueY, 0) FROM tx WHERE txNodeId % 2 = 0)) AS na, (SELECT count(*) FROM (SELECT DISTINCT round_even(trueX, 0), round_even(trueY, 0) FROM tx WHERE txNodeId % 2 = 1)) AS nb)"""), "share")
def j21(spark, d):
    t = A.tx(spark, d)
    return P.twin_share(t.where("txNodeId % 2 = 0"), t.where("txNodeId % 2 = 1"))  # ``require_no_twins`` refuses over half


cte("own", "tx", f"""SELECT txNodeId, CAST(floor(txTimeMs / {A.WEEK_MS}) AS BIGINT) AS "window", avg(claimedX - trueX) AS ex, avg(claimedY - trueY) AS ey, max(attackId) AS attack FROM tx GROUP BY ALL""")
cte("rk", "own", f"""SELECT txNodeId, max(attack) = 0 AS honest, row_number() OVER (PARTITION BY max(attack) = 0 ORDER BY {h('txNodeId')}, txNodeId) - 1 AS r FROM own GROUP BY 1""")


@query("j22_own_error", with_("rk", """SELECT f.txNodeId, f."window", CASE WHEN f.attack = 0 THEN f.ex ELSE o.ex END AS ex, CASE WHEN f.attack = 0 THEN f.ey ELSE o.ey END AS ey FROM own f
 LEFT JOIN rk l ON NOT l.honest AND l.txNodeId = f.txNodeId LEFT JOIN rk d ON d.honest AND d.r = l.r % (SELECT greatest(1, count(*)) FROM rk WHERE honest)
 LEFT JOIN own o ON o.txNodeId = d.txNodeId AND o."window" = f."window" """), "ex ey")
def j22(spark, d):
    return P.own_error(A.tx(spark, d), A.WEEK_MS)


@query("g11_class_counts", with_("corpus", "SELECT label_attackId, count(DISTINCT (key_seed, label_txNodeId)) AS stations, count(*) AS windows FROM corpus GROUP BY 1"))
def g11(spark, d):
    return P.class_counts(A.corpus(spark, d))


@query("g12_station_table", with_("st", "SELECT * FROM st"))
def g12(spark, d):
    return P.station_table(A.corpus(spark, d))


@query("g13_expand", with_("corpus split", "SELECT key_claimedStationId, key_seed, label_txNodeId, split FROM (SELECT DISTINCT key_seed, label_txNodeId, key_claimedStationId FROM corpus) LEFT JOIN split USING (key_seed, label_txNodeId)"))
def g13(spark, d):
    df = A.corpus(spark, d)
    return P.expand(P.assign(P.station_table(df)), df).select("key_claimedStationId", *P.STATION, "split")


@query("g14_pivot", with_("corpus", "SELECT key_seed, count(*) FILTER (label_attackId = 0) AS c0, count(*) FILTER (label_attackId = 1) AS c1, count(*) FILTER (label_attackId = 11) AS c11 FROM corpus GROUP BY 1"))
def g14(spark, d):
    return P.pivot_counts(A.corpus(spark, d), "key_seed", C, [0, 1, 11])


@query("g15_multi", with_("corpus", "SELECT key_seed, label_txNodeId, count(DISTINCT label_attackId) AS n FROM corpus GROUP BY ALL HAVING count(DISTINCT label_attackId) > 1"))
def g15(spark, d):
    return P.multi(A.corpus(spark, d), P.STATION, C)


@query("g46_card_counts", with_("corpus", """SELECT unnest(['windows', 'transmitters', 'benign', 'identities', 'classes', 'seeds']) AS fact, unnest([count(*), count(DISTINCT (key_seed, label_txNodeId)), count(*) FILTER (label_attackId = 0), count(DISTINCT key_claimedStationId), count(DISTINCT label_attackId), count(DISTINCT key_seed)]) AS value FROM corpus"""))
def g46(spark, d):
    return P.card_counts(A.corpus(spark, d))


@query("o02_sample", "SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey LIMIT 500")
def o02(spark, d):
    return P.sample_n(A.table(spark, d, "orders"), 500, "o_orderkey").select("o_orderkey")


cte("bal", "corpus", f"""SELECT *, row_number() OVER (PARTITION BY key_claimedStationId ORDER BY {h('key_rxNodeId')}, key_rxNodeId, key_seed, key_claimedStationId, key_rxNodeId, key_window, key_observer_role) AS r, count(*) OVER (PARTITION BY key_claimedStationId) AS n FROM corpus WHERE label_attackId = 0""")


@query("o03_balanced", with_("corpus bal", """SELECT label_attackId, count(*) AS n FROM (SELECT label_attackId FROM corpus WHERE label_attackId > 0 UNION ALL SELECT label_attackId FROM bal WHERE r <= greatest(1, round_even(n *
 ((SELECT least(round(CAST(1.0::DOUBLE / 3 / (1 - 1.0::DOUBLE / 3) * count(*) FILTER (label_attackId > 0) AS DOUBLE)), count(*) FILTER (label_attackId = 0)) / CAST(count(*) FILTER (label_attackId = 0) AS DOUBLE) FROM corpus)), 0))) GROUP BY 1"""))
def o03(spark, d):
    return P.balanced(A.corpus(spark, d), 1 / 3, "key_claimedStationId", "key_rxNodeId").groupBy(C).agg(F.count("*").alias("n"))


@query("o04_holdout", with_("corpus", f"SELECT DISTINCT label_txNodeId FROM corpus WHERE {h('label_txNodeId', 3)} < 0.25::DOUBLE * 4294967296"))
def o04(spark, d):
    return P.holdout(A.corpus(spark, d), "label_txNodeId", 0.25, 3)


@query("o05_frozen_split", with_("split", "SELECT * FROM split"))
def o05(spark, d):
    return P.assign(P.station_table(A.corpus(spark, d))).select(*P.STATION, C, "split")


@query("o06_stratified_folds", with_("corpus", f"""SELECT label_txNodeId, CAST((row_number() OVER (PARTITION BY y ORDER BY {h('label_txNodeId')}, label_txNodeId) - 1) % 5 AS INT) AS fold FROM
 (SELECT label_txNodeId, first(label_attackId ORDER BY n DESC, label_attackId) AS y FROM (SELECT label_txNodeId, label_attackId, count(*) AS n FROM corpus GROUP BY ALL) GROUP BY 1)"""))
def o06(spark, d):
    return P.grouped_folds(A.corpus(spark, d), "label_txNodeId", 5, C)


@query("o07_grouped_folds", with_("corpus", f"SELECT label_txNodeId, CAST({h('label_txNodeId', 1)} % 4 AS INT) AS fold FROM (SELECT DISTINCT label_txNodeId FROM corpus)"))
def o07(spark, d):
    return P.grouped_folds(A.corpus(spark, d), "label_txNodeId", 4, seed=1)


@query("o08_per_key", with_("units", f"SELECT key_seed, key_claimedStationId, key_window, rxNodeId FROM (SELECT *, row_number() OVER (PARTITION BY key_seed, key_claimedStationId, key_window ORDER BY {h('rxNodeId')}, rxNodeId) AS r FROM units) WHERE r <= 8"))
def o08(spark, d):
    return P.per_key(A.units(spark, d), ["key_seed", "key_claimedStationId", "key_window"], 8, "rxNodeId").select("key_seed", "key_claimedStationId", "key_window", "rxNodeId")


@query("o09_thin", f"SELECT o_custkey, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {h('o_orderkey')}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders) WHERE r <= greatest(3, floor(c * least(1.0::DOUBLE, 4000::DOUBLE / (SELECT count(*) FROM orders)))) GROUP BY 1")
def o09(spark, d):
    return P.thin(A.table(spark, d, "orders"), "o_custkey", 4000, "o_orderkey", 3).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("o10_clients", with_("corpus", f"""SELECT client, n, CASE WHEN {h('client')} / 4294967296::DOUBLE < 0.7 THEN 'train' WHEN {h('client')} / 4294967296::DOUBLE < 0.85 THEN 'validation' ELSE 'test' END AS part FROM (SELECT key_claimedStationId AS client, count(*) AS n FROM corpus GROUP BY 1 HAVING count(*) >= 500)"""))
def o10(spark, d):
    return P.clients(A.corpus(spark, d), "key_claimedStationId", 500)


@query("o10_client_parts", with_("corpus", f"""SELECT key_observer_role, key_seed, part, count(*) AS n FROM (SELECT *, CASE WHEN label_txNodeId % 5 = 0 THEN 'test' WHEN label_txNodeId % 5 = 1 THEN 'validation' ELSE 'train' END AS part,
 count(*) FILTER (label_txNodeId % 5 > 1) OVER (PARTITION BY key_claimedStationId) AS own FROM corpus) WHERE part <> 'train' OR own >= 60 GROUP BY ALL"""))
def o10p(spark, d):
    """Rows of each part for clients by station, those with 60 train rows at least."""
    df = A.corpus(spark, d)
    splits = df.select(*P.STATION).distinct().withColumn("split", F.expr("CASE WHEN label_txNodeId % 5 = 0 THEN 'test' WHEN label_txNodeId % 5 = 1 THEN 'validation' ELSE 'train' END"))
    return P.client_parts(df, splits, "key_claimedStationId", 60).groupBy("key_observer_role", "key_seed", "part").agg(F.count("*").alias("n"))


@query("o11_holdout_transmitters", with_("corpus", f"""SELECT label_txNodeId, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {h('label_txNodeId')}, label_txNodeId) AS r, count(*) OVER (PARTITION BY class) AS n FROM
 (SELECT label_txNodeId, first(label_attackId ORDER BY n DESC, label_attackId) AS class FROM (SELECT label_txNodeId, label_attackId, count(*) AS n FROM corpus GROUP BY ALL) GROUP BY 1)) WHERE r <= ceil(n * 0.3::DOUBLE)"""))
def o11(spark, d):
    return P.holdout_tx(A.corpus(spark, d), 0.3)


def boot_sql(cluster: str, n: int) -> str:
    w = " + ".join(f"CAST(u >= {p!r}::DOUBLE AS INT)" for p in P.POISSON)
    return with_("corpus", f"""SELECT CAST(rep AS INT) AS replicate, sum(s * w) / nullif(CAST(sum(c * w) AS DOUBLE), 0) AS mean FROM (SELECT rep, s, c, {w} AS w FROM
 (SELECT rep, s, c, (((((cl * 7919 + rep * 104729) * 2654435761) % 4294967296) // 4096) * 2654435761 + 40503) % 4294967296 / 4294967296::DOUBLE AS u FROM (SELECT {cluster} AS cl, sum(app_quantity) AS s, count(app_quantity) AS c FROM corpus GROUP BY 1), range(1, {n + 1}) r(rep))) GROUP BY 1""")


@query("o12_bootstrap", boot_sql("label_txNodeId", 2000), "mean")
def o12(spark, d):
    return P.bootstrap(A.corpus(spark, d), 2000, "label_txNodeId", "app_quantity")


@query("o12_seed_bootstrap", boot_sql("CAST(substr(key_seed, 2) AS BIGINT)", 2000), "mean")
def o12s(spark, d):
    """Whole seeds are the clusters, by their number."""
    df = A.corpus(spark, d).withColumn("seed_number", F.substring("key_seed", 2, 9).cast("long"))
    return P.bootstrap(df, 2000, "seed_number", "app_quantity")


@query("o13_overlap_share", with_("corpus", f"SELECT avg(CAST({h('label_txNodeId')} < 0.25::DOUBLE * 4294967296 AS INT)) AS share FROM (SELECT DISTINCT label_txNodeId FROM corpus WHERE label_attackId = 1)"), "share")
def o13(spark, d):
    df = A.corpus(spark, d)
    return P.overlap_share(P.holdout(df, "label_txNodeId", 0.25), df.where("label_attackId = 1"), "label_txNodeId")


@query("u01_union", with_("ev od", "SELECT key_seed, count(*) AS n FROM (SELECT key_seed FROM ev UNION ALL SELECT key_seed FROM od) GROUP BY 1"))
def u01(spark, d):
    a, b = halves(spark, d)
    return a.unionByName(b).groupBy("key_seed").agg(F.count("*").alias("n"))


@query("u02_distinct", with_("corpus", "SELECT DISTINCT key_seed, label_txNodeId, label_attackId FROM corpus"))
def u02(spark, d):
    return A.corpus(spark, d).select(*P.STATION, C).dropDuplicates()


@query("u03_shared_classes", with_("corpus", "SELECT label_attackId, count(*) AS corpora, count(*) = 2 AS shared FROM (SELECT DISTINCT label_attackId, 0 AS k FROM corpus WHERE label_txNodeId % 2 = 0 UNION ALL SELECT DISTINCT label_attackId, 1 FROM corpus WHERE label_txNodeId % 2 = 1 AND label_attackId <> 11) GROUP BY 1"))
def u03(spark, d):
    a, b = halves(spark, d)
    return P.shared_classes([a, b.where("label_attackId <> 11")])


@query("u04_missing", with_("corpus", "SELECT label_txNodeId, label_attackId FROM (SELECT DISTINCT label_txNodeId FROM corpus), (SELECT unnest([0, 1, 5, 11]) AS label_attackId) EXCEPT SELECT label_txNodeId, label_attackId FROM corpus"))
def u04(spark, d):
    return P.missing(A.corpus(spark, d), C, [0, 1, 5, 11], "label_txNodeId")
