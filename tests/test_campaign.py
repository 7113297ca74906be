"""Campaign reports against plain loops: gaps over slices, rungs, skew on both sides of the rule, splits."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from ringtrace.operators import campaign as C
from ringtrace.operators.asof import gaps

TX = "key_seed string, msgUid long, txNodeId long, txTimeMs double, attackId int, msgType int, claimedX double, claimedY double, trueX double, trueY double, txCbr double"


@pytest.mark.parametrize("slice_ms", [3.0, 50.0, 1e9])
def test_gaps_over_slices(spark, slice_ms):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), float(rng.randrange(200))) for _ in range(150)] + [("a", None)]
    got = gaps(spark.createDataFrame(rows, "k string, t double").withColumn("part", F.lit(1)), ["k"], "t", slice_ms)
    want = [("a", None, None)]
    for k in {r[0] for r in rows}:
        ts = sorted(t for s, t in rows if s == k and t is not None)
        want += [(k, b, None if a is None else b - a) for a, b in zip([None, *ts], ts)]
    assert sorted(map(str, ((r.k, r.t, r.gap) for r in got.collect()))) == sorted(map(str, want))


def sent(rows):
    return [(s, n, v, float(n), c, 2, e, 0.0, 0.0, 0.0, 0.1) for n, (s, v, c, e) in enumerate(rows)]


def test_rungs_and_overlap(spark):
    rows = [("a", 1, 0, 1.0), ("a", 1, 0, 3.0), ("a", 2, 11, 2.0), ("a", 2, 11, 8.0), ("b", 2, 11, 12.0), ("a", 3, 13, 10.0), ("a", 4, 1, 50.0), ("a", 4, 1, 70.0), ("a", 5, 6, 0.5)]
    tx = spark.createDataFrame(sent(rows), TX)
    got = {r.attackId: r for r in C.magnitude_rungs(tx).collect()}
    assert (got[11].stations, got[11].measured, got[11].least, got[11].most) == (2, 2, 8.0, 12.0)
    assert (got[1].p50, got[6].stations, got[6].measured, got[6].p50) == (60.0, 1, 0, None)
    whole = {r.attackId: r for r in C.magnitude_rungs(tx, lying=False).collect()}
    assert (whole[11].least, whole[6].measured, whole[6].inside) == (5.0, 1, 1)
    meets = {(r.attackId, r.other): r.overlap for r in C.rung_overlap(C.magnitude_rungs(tx)).collect()}
    assert meets == {(1, 11): False, (1, 13): False, (11, 13): True}
    assert C.rung_overlap(C.magnitude_rungs(tx.limit(0))).count() == 0


def test_skew_rule_on_both_sides(spark):
    even = [(c, k) for c in range(4) for k in (0, 1, 2) for _ in range(5)]
    apart = [(0, k) for k in (0, 1, 2) for _ in range(5)] + [(c, 0) for c in (1, 2, 3) for _ in range(15)]
    for rows, passed, lack in ((even, False, (0, 0)), (apart, True, (3, 3))):
        r = C.skew_rule(spark.createDataFrame(rows, "client int, class int"), "client", "class").first()
        assert (r.passed, r.clients, r.lack_one, r.lack_two) == (passed, 4, *lack)
    assert r.spread == pytest.approx(2.0) and C.skew_rule(spark.createDataFrame([], "client int, class int"), "client", "class").first().passed is False


def test_client_shares_count_absent_classes(spark):
    rows = [(0, 0)] * 3 + [(0, 1)] + [(1, 0)] * 2
    got = {r["class"]: r for r in C.client_shares(spark.createDataFrame(rows, "client int, class int"), "client", "class").collect()}
    assert (got[1]["mean"], got[1].least, got[1].most) == (0.125, 0.0, 0.25) and got[0]["std"] == pytest.approx(math.sqrt(2) / 8)


def test_intervals_by_busy_ratio(spark):
    rng = random.Random(3)
    rows = [("a", n, rng.randrange(3), float(rng.randrange(5000)), rng.choice([0, 0, 1]), rng.choice([1, 2, 2]), 0.0, 0.0, 0.0, 0.0, rng.choice([0.0, 0.1, 0.3, 0.35, 0.9])) for n in range(200)]
    tx = spark.createDataFrame(rows, TX)
    found = {}
    for v in range(3):
        own = sorted((r[3], r[1], r[10]) for r in rows if r[2] == v and r[4] == 0 and r[5] == 2)
        for a, b in zip(own, own[1:]):
            found.setdefault(b[2], []).append(b[0] - a[0])
    got = {r.bin: (r.n, r.median_ms) for r in C.dcc_interval(tx, 100.0).collect()}
    merged = {0: found[0.1], 1: found[0.3], 2: found[0.35], 6: found[0.9]}
    assert got == {k: (len(v), median(v)) for k, v in merged.items()}
    one = C.cam_interval(tx, 100.0).first()
    assert one.n == sum(map(len, found.values())) and one.kinds == len({g for v in found.values() for g in v})


def test_card_splits(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("a", 2, 3), ("b", 1, 0)], "key_seed string, label_txNodeId long, label_attackId int")
    splits = spark.createDataFrame([("a", 1, "train"), ("a", 1, "train"), ("a", 2, "test")], "key_seed string, label_txNodeId long, split string")
    got = {(r.split, r["class"]): (r.stations, r.windows, r.share) for r in C.card_splits(df, splits).collect()}
    assert got == {("train", 0): (1, 2, 0.5), ("train", None): (1, 2, 0.5), ("test", 3): (1, 1, 0.25), ("test", None): (1, 1, 0.25), (None, 0): (1, 1, 0.25), (None, None): (1, 1, 0.25)}
