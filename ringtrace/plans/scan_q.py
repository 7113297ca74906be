"""Queries of scans and sinks: the given tables are written in the trace formats and read back."""

from __future__ import annotations

import pyspark.sql.types as T
from pyspark.sql import functions as F

from ..operators import partition as P
from ..sources import adapters as A, io as IO
from .ctes import cte, with_
from .registry import query
from .reports_q import pred

RX = T.StructType([T.StructField("msgUid", T.LongType()), T.StructField("rxTimeMs", T.DoubleType()), T.StructField("rxNodeId", T.IntegerType()), T.StructField("claimedX", T.DoubleType())])


def csv_lines(spark, d):
    """Message lines; every 50th has a field too many, every 70th lacks its last, every 90th its time."""
    m = F.col("msgUid")
    t = F.when(m % 90 == 0, F.lit("")).otherwise(F.col("rxTimeMs").cast("string"))
    base = F.concat_ws(",", m, t, "rxNodeId")
    line = F.when(m % 70 == 0, base).otherwise(F.concat_ws(",", base, F.col("claimedX").cast("string")))
    return A.rx(spark, d).select("msgUid", F.when(m % 50 == 0, F.concat(line, F.lit(",9,9"))).otherwise(line).alias("value"))


@query("s01_read_trace", with_("rx", "SELECT msgUid, rxTimeMs, rxNodeId, CASE WHEN msgUid % 70 > 0 THEN claimedX END AS claimedX FROM rx WHERE msgUid % 90 > 0 AND msgUid % 50 > 0 AND rxTimeMs <= 1706000000000"), "rxTimeMs claimedX")
def s01(spark, d):
    path = IO.scratch(spark, "trace")
    lines = csv_lines(spark, d).select(F.col("value").alias(",".join(RX.names)))
    # quotes off: the lines are the file's text as it is
    lines.write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    return IO.read_trace(spark, path, RX, "rxTimeMs", 1_706_000_000_000)


@query("s02_read_runs", with_("rx", "SELECT concat('r', msgUid % 3) AS key_seed, count(*) AS n, sum(claimedX) AS x FROM rx GROUP BY 1"), "x")
def s02(spark, d):
    path = IO.scratch(spark, "runs")
    for k in range(3):  # three tags, a writer each
        A.rx(spark, d).where(F.col("msgUid") % 3 == k).select(*RX.names).write.option("header", True).csv(f"{path}/rx_r{k}.csv")
    return IO.read_runs(spark, path, "rx", RX, "rxTimeMs").groupBy("key_seed").agg(F.count("*").alias("n"), F.sum("claimedX").alias("x"))


@query("s03_road_length", with_("rx", "SELECT count(*) AS n FROM rx WHERE claimedX > 100"))
def s03(spark, d):
    path = IO.scratch(spark, "road")
    A.rx(spark, d).agg(F.lit("6000").alias("value")).write.text(path)
    return A.rx(spark, d).where(F.col("claimedX") > IO.road_length(spark, path) / 60).agg(F.count("*").alias("n"))


@query("s04_read_roles", with_("stations", "SELECT role, count(*) AS n FROM stations GROUP BY 1 UNION ALL SELECT 'unknown', count(*) FROM stations"))
def s04(spark, d):
    path = IO.scratch(spark, "roles")
    A.stations(spark, d).write.option("header", True).csv(path)
    lost = A.stations(spark, d).select("nodeId").join(IO.read_roles(spark, path + "-none").select("nodeId", "role"), "nodeId", "left").select(F.coalesce("role", F.lit("unknown")).alias("role"))
    return IO.read_roles(spark, path).select("role").union(lost).groupBy("role").agg(F.count("*").alias("n"))


@query("s05_corpus_round_trip", with_("corpus", "SELECT key_seed, count(*) AS n, sum(app_price) AS price FROM corpus WHERE key_seed <= 's2' GROUP BY 1"), "price")
def s05(spark, d):
    df = A.corpus(spark, d)
    path = IO.write_corpus(df, IO.scratch(spark, "corpus"))
    return IO.read_corpus(spark, path, df.schema).where("key_seed <= 's2'").groupBy("key_seed").agg(F.count("*").alias("n"), F.sum("app_price").alias("price"))


REL = T.StructType([T.StructField("key_rxNodeId", T.LongType()), T.StructField("label_txNodeId", T.LongType()), T.StructField("label_attackId", T.IntegerType()), T.StructField("app_quantity", T.DoubleType()), T.StructField("scenario", T.StringType()), T.StructField("key_seed", T.StringType())])
cte("rel", "corpus", "SELECT *, CASE WHEN label_txNodeId % 2 = 0 THEN 'dense' ELSE 'sparse' END AS scenario FROM corpus")


def release(spark, d):
    return A.corpus(spark, d).withColumn("scenario", F.when(F.col("label_txNodeId") % 2 == 0, "dense").otherwise("sparse"))


@query("s06_release_round_trip", with_("rel", "SELECT scenario, key_seed, count(*) AS n, sum(app_quantity) AS q FROM rel GROUP BY ALL"), "q")
def s06(spark, d):
    path = IO.write_shards(release(spark, d).select(*REL.names), IO.scratch(spark, "shards"))
    return IO.read_release(spark, path, REL).groupBy("scenario", "key_seed").agg(F.count("*").alias("n"), F.sum("app_quantity").alias("q"))


@query("s07_read_splits", with_("split", "SELECT split, count(*) AS n FROM split GROUP BY 1"))
def s07(spark, d):
    path = IO.scratch(spark, "splits")
    st = P.assign(P.station_table(A.corpus(spark, d))).select("key_seed", "label_txNodeId", "split")
    st.union(st).write.option("header", True).csv(path)
    return IO.read_splits(spark, path).groupBy("split").agg(F.count("*").alias("n"))


@query("s08_read_schema", with_("corpus", " UNION ALL ".join(f"SELECT '{n}' AS name, 'double' AS dtype, '{n[:3]}' AS block, true AS is_feature, count(DISTINCT {n}) AS distinct_values FROM corpus" for n in ("app_quantity", "phy_tax"))))
def s08(spark, d):
    """The release's feature columns, from its schema file, with their distinct values."""
    df, path, names = A.corpus(spark, d), IO.scratch(spark, "schema"), ["app_quantity", "phy_tax"]
    cols = [F.struct(F.lit(n).alias("name"), F.lit("double").alias("dtype"), F.lit(n[:3]).alias("block"), F.lit(True).alias("is_feature")) for n in names]
    df.agg(F.array(*cols).alias("columns")).write.json(path)
    counts = df.agg(*[F.count_distinct(n).alias(n) for n in names]).unpivot([], names, "name", "distinct_values")
    return IO.read_schema(spark, path).join(counts, "name")


@query("s09_read_veremi", with_("rx", """SELECT messageID, sender, rxTimeMs, claimedX, rxX FROM (SELECT msgUid AS messageID, claimedStationId AS sender, rxTimeMs, claimedX, msgUid % 10 = 0 AS own,
 last(CASE WHEN msgUid % 10 = 0 THEN claimedX END IGNORE NULLS) OVER (PARTITION BY rxNodeId ORDER BY rxTimeMs, CASE WHEN msgUid % 10 = 0 THEN 2 ELSE 3 END, msgUid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rxX FROM rx) WHERE NOT own AND rxX IS NOT NULL"""), "rxTimeMs claimedX rxX")
def s09(spark, d):
    path = IO.scratch(spark, "veremi")
    for k in range(2):  # a log folder for each of the two receivers
        A.rx(spark, d).where(F.col("rxNodeId") == k).select(
            F.when(F.col("msgUid") % 10 == 0, 2).otherwise(3).alias("type"), (F.col("rxTimeMs") / 1000).alias("rcvTime"), F.col("claimedStationId").alias("sender"),
            F.col("msgUid").alias("messageID"), F.array("claimedX", "claimedY").alias("pos"), F.array("claimedSpeed", F.lit(0.0)).alias("spd")).write.json(f"{path}/rx{k}")
    return IO.read_veremi(spark, f"{path}/rx*")


@query("s10_read_nextgen", with_("rx", "SELECT msgUid AS messageID, claimedStationId AS sender, CAST(floor(rxTimeMs) AS BIGINT) AS rxTimeMs, claimedX, claimedY FROM rx WHERE msgUid % 25 > 0"), "claimedX claimedY")
def s10(spark, d):
    path = IO.scratch(spark, "nextgen")
    pos = F.when(F.col("msgUid") % 25 == 0, "broken").otherwise(F.concat_ws(",", F.col("claimedX").cast("string"), F.col("claimedY").cast("string"), F.lit("0")))
    A.rx(spark, d).select((F.floor("rxTimeMs") * 1_000_000).alias("rcvTime"), F.col("claimedStationId").cast("string").alias("sender_id"), F.col("msgUid").alias("messageID"), F.struct(pos.alias("pos"), F.lit("0").alias("spd")).alias("sender")).write.json(path)
    return IO.read_nextgen(spark, path).withColumn("rxTimeMs", F.col("rxTimeMs").cast("long"))


@query("s10_nextgen_arrays", with_("rx", """SELECT msgUid, claimedStationId, rxNodeId::BIGINT AS rxNodeId, CAST(CAST(floor(rxTimeMs) AS BIGINT) * 1000000 AS DOUBLE) / 1e6::DOUBLE AS rxTimeMs, claimedX, claimedY, rxX, rxY, claimedSpeed, claimedHeading, CAST(CASE WHEN msgUid % 4 = 0 THEN 2 ELSE 0 END AS INT) AS label_attackId
 FROM rx WHERE msgUid % 25 > 0"""), "rxTimeMs claimedX claimedY rxX rxY claimedSpeed claimedHeading")
def s10a(spark, d):
    """One JSON array a receiver, read in byte ranges; one position in 25 is broken, and the variant stands in the path."""
    def text(*cols):
        return F.concat_ws(",", *[F.col(c).cast("string") for c in cols], F.lit("0"))

    rows = A.rx(spark, d).select(
        "rxNodeId", "msgUid", (F.floor("rxTimeMs").cast("long") * 1_000_000).alias("rcvTime"), F.concat(F.lit("v_"), F.col("claimedStationId").cast("string")).alias("sender_id"),
        F.col("msgUid").alias("messageID"), F.when(F.col("msgUid") % 4 == 0, 1).otherwise(0).alias("attacker"),
        F.struct(F.when(F.col("msgUid") % 25 == 0, "broken").otherwise(text("claimedX", "claimedY")).alias("pos"), F.col("claimedSpeed").cast("string").alias("spd"), F.col("claimedHeading").cast("string").alias("hed")).alias("sender"),
        F.struct(text("rxX", "rxY").alias("pos")).alias("receiver"))
    path = IO.write_json_arrays(rows.drop("msgUid"), "rxNodeId", ["messageID"], IO.scratch(spark, "constantPositionOffset"))
    return IO.read_nextgen_arrays(spark, path, "part-*")


@query("s11_unknown_codes", with_("rx", "SELECT msgType, count(*) AS n FROM rx WHERE msgType NOT IN (1, 2) GROUP BY 1"))
def s11(spark, d):
    return IO.unknown_codes(IO.require_fields(A.rx(spark, d), ["msgUid", "msgType"]), "msgType", [1, 2])


@query("s14_write_sample", with_("rx", "SELECT msgUid, claimedStationId FROM rx ORDER BY claimedStationId, msgUid LIMIT 100"))
def s14(spark, d):
    path = IO.write_sample(A.rx(spark, d).select("msgUid", "claimedStationId"), ["claimedStationId", "msgUid"], 100, IO.scratch(spark, "sample"))
    return spark.read.schema("msgUid long, claimedStationId long").option("header", True).csv(path)


@query("s15_scenario_manifest", with_("rel", 'SELECT scenario, count(*) AS "rows", count(DISTINCT (key_seed, label_txNodeId)) AS transmitters, count(DISTINCT key_seed) AS seeds FROM rel GROUP BY 1'))
def s15(spark, d):
    return IO.scenario_manifest(release(spark, d))


@query("s16_checksums")
def s16(spark, d):
    return IO.checksums(spark, f"{d}/events.parquet")


@query("s16_verify_checksums", "SELECT 'lost.parquet' AS file, 'missing' AS state")
def s16v(spark, d):
    got = IO.checksums(spark, f"{d}/nation.parquet")
    return IO.verify_checksums(got, got.union(got.limit(1).select(F.lit("lost.parquet"), F.lit("0"), F.lit(0))))


@query("s17_export_replay", with_("pred", """SELECT "second", '{"second":' || "second" || ',"cells":[' || string_agg('{"y":' || y || ',"p":' || p || ',"n":' || n || '}', ',' ORDER BY y, p, n) || ']}' AS record FROM (SELECT key_window // 100 AS "second", y, p, count(*) AS n FROM pred GROUP BY ALL) GROUP BY 1"""))
def s17(spark, d):
    return IO.export_replay(pred(spark, d), F.floor(F.col("key_window") / 100))


def split_release(spark, d):
    return release(spark, d).withColumn("split", F.expr("CASE label_txNodeId % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END"))


cte("split_rel", "rel", "SELECT *, CASE label_txNodeId % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM rel")


@query("s15_coverage_gaps", with_("split_rel", "SELECT scenario, \"class\", split FROM (SELECT DISTINCT scenario FROM split_rel), (VALUES (0), (1), (11), (13)) c(\"class\"), (VALUES ('train'), ('validation'), ('test')) p(split) WHERE (scenario, \"class\", split) NOT IN (SELECT (scenario, label_attackId, split) FROM split_rel)"))
def s15g(spark, d):
    return IO.coverage_gaps(split_release(spark, d), [0, 1, 11, 13])


@query("s15_scenario_kinds", with_("split_rel", """SELECT scenario, "rows", transmitters, seeds, gaps, CASE WHEN gaps = 0 THEN 'benchmark' ELSE 'supplementary' END AS kind FROM (SELECT scenario, count(*) AS "rows", count(DISTINCT (key_seed, label_txNodeId)) AS transmitters, count(DISTINCT key_seed) AS seeds, 9 - count(DISTINCT (label_attackId, split)) AS gaps FROM split_rel GROUP BY 1)"""))
def s15k(spark, d):
    return IO.scenario_kinds(split_release(spark, d), [0, 1, 11])
