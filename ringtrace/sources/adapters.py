"""Trace-shaped tables derived from the given ones, so every operator runs on data that grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROAD = 6000.0
WEEK_MS = 604_800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received messages."""
    return table(spark, sf_dir, "events").selectExpr(
        "'r1' AS key_seed", "event_id AS msgUid", "unix_micros(cast(ts AS timestamp)) / 1000.0D AS rxTimeMs",
        "cast(event_id % 2 AS int) AS rxNodeId", "user_id AS claimedStationId",
        "CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 14 ELSE 1 END AS msgType",
        "floor(event_id / 3) AS seqNo", "value * 20 AS claimedX", "cast(event_id % 7 - 3 AS double) AS claimedY",
        "cast(10 + event_id % 21 AS double) AS claimedSpeed", "cast((event_id * 37) % 360 AS double) AS claimedHeading",
        "cast(3000 * (event_id % 2) AS double) AS rxX", "0.0D AS rxY",
    )


def pssch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radio receptions: two of three messages, shifted by up to five minutes."""
    return rx(spark, sf_dir).where("msgUid % 3 <> 0").selectExpr(
        "key_seed", "msgUid AS radioUid", "rxTimeMs + ((msgUid * 7919) % 11 - 5) * 60000 AS timeMs", "rxNodeId",
        "claimedStationId AS txRnti", "claimedX / 200 AS sinr", "(msgUid % 10) / 10.0D AS tbler",
        "cast(msgUid % 5 = 0 AS int) AS corrupt", "cast(msgUid % 16 AS int) AS mcs",
        "-60 - claimedX / 200 AS slRsrpDbm", "cast(1 + msgUid % 3 AS int) AS subChLen",
    )


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sent messages with the truth: one user in five lies by 150 m, one by 12 m."""
    return rx(spark, sf_dir).selectExpr(
        "key_seed", "msgUid", "rxTimeMs AS txTimeMs", "claimedStationId AS txNodeId", "claimedStationId", "msgType",
        "seqNo", "claimedX", "claimedY", "claimedSpeed", "claimedHeading",
        "claimedX - CASE claimedStationId % 5 WHEN 0 THEN 150 WHEN 1 THEN 12 ELSE msgUid % 9 - 4 END AS trueX",
        "claimedY AS trueY", "claimedSpeed AS trueSpeed", "cast((msgUid * 37 + 5) % 360 AS double) AS trueHeading",
        "cast(CASE claimedStationId % 5 WHEN 0 THEN 1 WHEN 1 THEN 11 ELSE 0 END AS int) AS attackId",
        "(msgUid % 100) / 100.0D AS txCbr",
    )


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receptions by other stations: up to eight of the sender's neighbours by number hear a message."""
    return table(spark, sf_dir, "events").selectExpr("'r1' AS key_seed", "event_id AS msgUid", "user_id", "explode(sequence(1, 8)) AS k").where(
        "event_id % (k + 1) = 0").selectExpr("key_seed", "msgUid", "user_id + k AS rxNodeId")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station register: one user in ten is a roadside unit."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS nodeId", "user_id AS stationId", "CASE WHEN user_id % 10 = 0 THEN 'rsu' ELSE 'vehicle' END AS role",
    ).distinct()


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled units: receivers with position and power, and one claim for each unit."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('s', l_linenumber) AS key_seed", "l_suppkey AS key_claimedStationId", "cast(l_linenumber AS long) AS key_window",
        "l_orderkey AS rxNodeId", "cast((l_partkey * 37) % 6000 AS double) AS rxX", "cast(l_orderkey % 25 - 12 AS double) AS rxY",
        "cast((l_suppkey * 613) % 6000 AS double) AS trueX", "cast(l_suppkey % 7 - 3 AS double) AS trueY",
        "(l_suppkey * 613) % 6000 + CASE WHEN l_suppkey % 5 = 0 THEN 150.0D ELSE 0.0D END AS claimedX",
        "cast(l_suppkey % 7 - 3 AS double) AS claimedY", "cast(l_suppkey % 5 = 0 AS int) AS label", "l_quantity AS noise",
    ).selectExpr(
        "*", "-30 - 25 * log10(greatest(hypot(rxX - trueX, rxY - trueY), 1.0D)) + (noise - 25.5D) / 10 AS phy_rsrp_mean",
    ).drop("noise")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows with class, transmitter, seed and window."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('s', l_linenumber) AS key_seed", "l_suppkey AS key_claimedStationId", "l_orderkey AS key_rxNodeId",
        "cast(datediff(cast(l_shipdate AS date), date'1992-01-01') AS long) AS key_window", "l_suppkey AS label_txNodeId",
        "CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 11 END AS label_attackId",
        "cast(l_returnflag <> 'N' AS int) AS label_is_attack", "cast(l_orderkey % 20 <> 0 AS int) AS label_clean",
        "CASE WHEN l_orderkey % 4 = 0 THEN 'rsu' ELSE 'vehicle' END AS key_observer_role",
        "l_quantity AS app_quantity", "l_extendedprice AS app_price", "l_discount AS phy_discount", "l_tax AS phy_tax",
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of (region, station) tracks with a hit flag and a score."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(event_id % 4 AS int) AS key_region", "user_id AS key_claimedStationId", "event_id AS key_window",
        "unix_micros(cast(ts AS timestamp)) / 1000.0D AS timeMs", "value / 100 AS score", "value > 70 AS hit",
        "user_id % 5 = 0 AS attack", "cast(event_id % 3 AS int) AS seed",
    )


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model updates of clients."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS client", "cast(label AS long) AS class", "vec_id % 50 + 1 AS n_rows", "vec_id % 7 + 1 AS n_steps", "embedding AS vector",
    )
