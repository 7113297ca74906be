"""Operators that cut a busy key into parts give what one sorted window gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ringtrace.operators import partition as P, reports as R


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot"] * 4 + ["a", None]), float(rng.randrange(100)), n, rng.choice([None, None, 1.0, 2.0, 3.0]), rng.choice([0, 0, 0, 1])) for n in range(400)]
    return spark.createDataFrame(data, "k string, t double, id long, v double, label_attackId int").withColumn("key_id", F.col("id")).cache()


@pytest.mark.parametrize("slice_of", [1.0, 7.0, 1e9])
@pytest.mark.parametrize("horizon", [None, 3.0])
def test_forward_fill(rows, slice_of, horizon):
    got = R.forward_fill(rows, ["k"], "t", "id", "v", horizon, slice_of)
    want = R.forward_fill(rows, ["k"], "t", "id", "v", horizon)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("v IS NULL AND v_held IS NOT NULL").count() > 0


def test_thin_and_balanced(rows):
    def ranked(df, ties):
        w = Window.partitionBy("k")
        return df.withColumn("r", F.row_number().over(w.orderBy(P.hashed("id"), *ties))).withColumn("n", F.count("*").over(w))

    want = ranked(rows, ["id"]).where("r <= greatest(5, floor(n * 0.25))")
    assert sorted(r.id for r in P.thin(rows, "k", 100, "id", 5).collect()) == sorted(r.id for r in want.collect())
    attacks, benign = rows.where("label_attackId = 1"), rows.where("label_attackId = 0")
    share = min(round(1 / 3 / (1 - 1 / 3) * attacks.count()), benign.count()) / benign.count()
    want = ranked(benign, ["id"]).where(F.col("r") <= F.greatest(F.lit(1.0), F.rint(F.col("n") * share))).unionByName(attacks, allowMissingColumns=True)
    assert sorted(r.id for r in P.balanced(rows, 1 / 3, "k", "id").collect()) == sorted(r.id for r in want.collect())


def test_few_rows_a_key_are_cut_before_the_shuffle(rows):
    plan = P.per_key(rows, ["k"], 3, "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_matched_vote(spark):
    rng = random.Random(9)
    data = [(s, rng.randrange(1, 9), 8, rng.random() < 0.2, rng.random() < 0.3) for s in "abc" for _ in range(30)] + [("d", 8, 8, True, True)]
    v = spark.createDataFrame(data, "seed string, k int, n int, attack boolean, flag boolean")
    shares, want = [0.3, 0.6, 0.9, 1.0], {}
    for out in "abc":
        others = [r for r in data if r[0] != out and not r[3]]
        goal = sum(r[4] for r in others)
        fitting = [s for s in shares if sum(r[1] >= -(-r[2] * s // 1) for r in others) <= goal]
        if fitting:
            want[out] = min(fitting)
    assert {r.seed: r.share for r in R.matched_vote(v, v, shares).collect()} == want and want
    assert R.matched_vote(v.where("seed = 'a'"), v.where("seed = 'a'"), shares).count() == 0


def test_client_parts(spark):
    df = spark.createDataFrame([("s", t, c) for t in range(6) for c in "xxy"] + [("s", 0, "z")], "key_seed string, label_txNodeId long, client string")
    parts = [("s", t, ["train", "train", "train", "validation", "test", "test"][t]) for t in range(6)]
    splits = spark.createDataFrame(parts, "key_seed string, label_txNodeId long, split string")
    got = {(r.client, r.part): r["count"] for r in P.client_parts(df, splits, "client", 3).groupBy("client", "part").count().collect()}
    assert got == {("x", "train"): 6, ("y", "train"): 3, ("x", "validation"): 2, ("y", "validation"): 1, ("x", "test"): 4, ("y", "test"): 2}
    for bad in (splits.where("label_txNodeId > 0"), splits.union(spark.createDataFrame([("s", 1, "test")], splits.schema))):
        with pytest.raises(ValueError):
            P.client_parts(df, bad, "client", 3)


@pytest.mark.parametrize("slice_of", [1, 4, 1000])
def test_resample(rows, slice_of):
    frames = R.last_per_frame(rows, ["k"], "t", "id", 3.0, ["v"]).where("frame % 5 <> 2")
    got, want = (R.resample(frames, ["k"], "v", 10.0, n) for n in (slice_of, None))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("gap").count() > 0
