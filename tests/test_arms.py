"""Arms at matched points and bundles with planted faults."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringtrace.operators import arms as M, bundle as B
from ringtrace.sources import io as IO

RATES = "key_seed string, key_claimedStationId long, attack boolean, rate double"
UNITS = "key_seed string, key_claimedStationId long, key_window long, label_attackId int, claimedY double, score double"


def test_borrowing_needs_one_operating_point(spark):
    own = spark.createDataFrame([("a", 1, False, 0.02), ("a", 2, False, 0.04), ("a", 3, True, 0.9)], RATES)
    near = spark.createDataFrame([("b", 1, False, 0.035), ("b", 2, True, 0.5)], RATES)
    far, none = near.withColumn("rate", F.col("rate") + 0.2), near.where("attack")
    got = M.borrow(own, near).collect()
    assert len(got) == 5 and not got[0].refused and got[0].gap == pytest.approx(0.005) and sum(r.borrowed for r in got) == 2
    for other in (far, none):
        got = M.borrow(own, other).collect()
        assert len(got) == 3 and all(r.refused and not r.borrowed for r in got)


def test_road_counts(spark):
    rows = [("a", 1, 1, 0, 9.0, 0.1), ("a", 1, 2, 0, 1.0, 0.1), ("a", 2, 1, 11, 9.0, 0.1), ("a", 2, 2, 11, None, 0.1), ("a", 3, 1, 1, -9.0, 0.9), ("a", 4, 1, 1, 2.0, 0.9)]
    r = M.road_counts(spark.createDataFrame(rows, UNITS), 5.0, [1, 11]).first()
    assert tuple(r) == (2, 1, 4, 2, 1, 1, 1)
    assert tuple(M.road_counts(spark.createDataFrame([], UNITS), 5.0, [1]).first()) == (0, 0, 0, 0, 0, 0, 0)
    kinds = {x.key_claimedStationId: x.kind for x in M.attach_offroad(spark.createDataFrame(rows, UNITS).select(*M.CLAIM).distinct(), spark.createDataFrame(rows, UNITS), 5.0).collect()}
    assert kinds == {1: "mixed", 2: "mixed", 3: "off", 4: "on"}


def test_curves_at_matched_points(spark):
    rng = random.Random(4)
    rows = [("a", v, w, [0, 0, 1, 11][v % 4], float(v % 3 * 4), rng.random() + 0.3 * (v % 4 > 1)) for v in range(40) for w in range(6)]
    units = IO.cut(spark.createDataFrame(rows, UNITS), "curve-units")
    shift = units.select(*M.CLAIM).distinct().withColumn("offset", F.col("key_claimedStationId") * 2.0)
    t = M.matched(units, 0.1)

    def rate(rows, v, t):
        own = [r[5] > t for r in rows if r[1] == v]
        return sum(own) / len(own)

    def benign(t):
        return sum(rate(rows, v, t) for v in range(40) if v % 4 < 2) / 20

    below = max(r[5] for r in rows if r[5] < t)
    assert benign(t) <= 0.1 < benign(below) and M.benign_rate(units, t) == pytest.approx(benign(t))
    got = {r.band: r for r in M.curves({"one": (units, t)}, shift, [0, 20, 40, 75], 2, [1, 11]).collect()}
    bands = {}
    for v in range(40):
        if v % 4 > 1:
            bands.setdefault(sum(2 * v >= e for e in (0, 20, 40, 75)), []).append(rate(rows, v, t))
    assert set(got) == set(bands)
    for b, rates in bands.items():
        assert (got[b].stations, got[b].windows) == (len(rates), 6 * len(rates))
        want = sum(rates) / len(rates) if len(rates) >= 2 else None
        assert got[b].rate == (want if want is None else pytest.approx(want)) and got[b].benign_rate == pytest.approx(benign(t))


def test_onroad_arms(spark):
    rng = random.Random(6)
    rows = [("a", v, w, [0, 0, 1, 11][v % 4], float(v % 3 * 4), rng.random() + (v % 4 > 1)) for v in range(36) for w in range(5)]
    units = spark.createDataFrame(rows, UNITS).withColumn("label_txNodeId", F.col("key_claimedStationId"))
    shift = units.select(*M.CLAIM).distinct().withColumn("offset", F.lit(10.0))
    got = {r.arm: r for r in M.onroad_arms(units, shift, ["score"], 5.0, [0.0], 1, [1, 11], k=2).collect()}
    assert {k: r.windows for k, r in got.items()} == {"all claims": 90, "map check first": 60, "map check first, matched": 60, "scored on road": 60}
    assert all(r.caught > 0.9 for k, r in got.items() if "matched" not in k) and got["all claims"].benign_rate < 0.1


def test_region_curves(spark):
    rng = random.Random(8)
    claims = [("a", v, w, [0, 0, 1, 11][v % 4], float(v % 3 * 4), 0.0) for v in range(24) for w in range(4)]
    scored = [(s, v, w, y, rng.random() + 0.4 * (y > 0)) for s, v, w, y, _, _ in claims for _ in range(rng.randrange(1, 4))]
    shift = spark.createDataFrame([("a", v, 10.0) for v in range(24)], "key_seed string, key_claimedStationId long, offset double")
    rows = spark.createDataFrame(scored, "key_seed string, key_claimedStationId long, key_window long, label_attackId int, score double")
    got = {r.arm: r for r in M.region_curves(rows, 0.2, shift, spark.createDataFrame(claims, UNITS), 5.0, [0.0], 1, [1, 11]).collect()}
    best = {}
    for s, v, w, y, x in scored:
        best[v, w, y] = max(x, best.get((v, w, y), 0.0))

    def rates(units, t, on_road):
        own = {}
        for v, y, x in units:
            if not on_road or v % 3 < 2:
                own.setdefault((v, y > 0), []).append(x > t)
        return [[sum(f) / len(f) for (_, bad), f in own.items() if bad == side] for side in (False, True)]

    for rule, units in (("per region", [(v, y, x) for _, v, _, y, x in scored]), ("any region", [(v, y, x) for (v, _, y), x in best.items()])):
        for arm, on_road in ((rule, False), (f"{rule}, matched", False), (f"{rule}, matched, on road", True)):
            benign, bad = rates(units, got[arm].threshold, on_road)
            assert got[arm].stations == len(bad) and got[arm].rate == pytest.approx(sum(bad) / len(bad)) and got[arm].benign_rate == pytest.approx(sum(benign) / len(benign))
        assert got[rule].threshold == 0.5 and got[f"{rule}, matched"].benign_rate <= 0.2


REL = T.StructType([T.StructField("key_rxNodeId", T.LongType()), T.StructField("label_txNodeId", T.LongType()), T.StructField("label_attackId", T.IntegerType()), T.StructField("app_x", T.DoubleType()), T.StructField("scenario", T.StringType()), T.StructField("key_seed", T.StringType())])


def bundle(spark, name, extra=()):
    rows = [(n, v, v % 2, float(v % 2 * 10 + n % 3), s, "s1") for v in range(12) for n in range(6) for s in (("dense", "thin") if v < 5 else ("dense",))]
    df = spark.createDataFrame(rows, REL)
    splits = spark.createDataFrame([("s1", v, B.PARTS[v // 2 % 3]) for v in range(12)] + list(extra), B.SPLITS)
    return B.write_bundle(df, splits, [0, 1], IO.scratch(spark, name))


def found(spark, folder, **more):
    return {r.check: r.ok for r in B.check_bundle(spark, folder, REL, [0, 1], **more).collect()}


def test_sound_bundle(spark):
    folder = bundle(spark, "sound")
    assert all(found(spark, folder, published=1.0).values())
    assert [k for k, ok in found(spark, folder, published=0.5).items() if not ok] == ["baseline"]
    kinds = {r.scenario: r.kind for r in spark.read.schema(B.SCENARIOS).json(f"{folder}/data/scenarios").collect()}
    assert kinds == {"dense": "benchmark", "thin": "supplementary"}


def test_planted_faults(spark):
    folder = bundle(spark, "faulty")
    df = spark.createDataFrame([(1, 99, 0, 1.0, "dense", "s1")], REL)
    shard = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/data/shards").where("path LIKE '%thin%'").first().path.removeprefix("file:")
    folder_of, name = os.path.split(shard)
    os.remove(f"{folder_of}/.{name}.crc")  # the local file system's own sum would stop the read
    with gzip.open(shard, "wt") as f:  # the file loses all rows but the header
        f.write("key_rxNodeId,label_txNodeId,label_attackId,app_x\n")
    got = found(spark, folder)
    assert not got["checksums"] and not got["rows as declared"] and got["files present"]
    assert not found(spark, folder, subset=True)["checksums"]
    df.write.mode("append").partitionBy("scenario", "key_seed").option("compression", "gzip").option("header", True).csv(f"{folder}/data/shards")
    got = found(spark, folder)
    assert not got["a part for every row"] and not got["rows as declared"]


def test_transmitter_in_two_parts(spark):
    got = found(spark, bundle(spark, "twice", [("s1", 0, "test")]))
    assert [k for k, ok in got.items() if not ok] == ["one part a transmitter"]
