"""The learner protocols on planted data with small forests: what carries the class is found, what doesn't is not."""

import random

import pytest

from ringtrace.operators import learn as L, partition as P, reports as R

KEYS = "key_seed string, key_rxNodeId long, label_txNodeId long, label_attackId int, scenario string, app_a double, phy_b double"


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(1)
    rows = []
    for k in range(360):
        y = (0, 1, 11)[k % 3]
        rows.append((f"s{k % 4}", k, k // 6 * 3 + k % 3, y, "dense" if k // 6 % 2 else "sparse", {0: 0.0, 1: 5.0, 11: 10.0}[y] + rng.random(), rng.random()))
    return spark.createDataFrame(rows, KEYS).repartition(2).cache()


@pytest.fixture(autouse=True)
def small(monkeypatch):
    whole = L.forest
    monkeypatch.setattr(L, "forest", lambda *a, **k: whole(3, 3))


def test_blocks_and_selection(planted):
    got = {r.block: r for r in L.benchmark(planted, {"app": ["app_a"], "phy": ["phy_b"]}, "label_attackId", "label_txNodeId", inert=[11]).collect()}
    assert got["app"].macro_f1 > 0.95 > 0.6 > got["phy"].macro_f1 and got["app"].macro_f1_active > 0.95
    picked = L.select_in_fold(planted, ["app_a", "phy_b"], "label_attackId", "label_txNodeId", [1])
    assert {(r.features, r.macro_f1 > 0.95) for r in picked.collect()} == {("app_a", True)}
    assert [tuple(r) for r in L.stability(picked).collect()] == [(1, "app_a", 2)]


def test_families_and_the_best_of_each_class(planted):
    scored = L.families(planted, ["app_a", "phy_b"], "label_attackId", "label_txNodeId")
    per = {r.family: r.macro_f1 for r in R.metrics(scored, ["family"]).collect()}
    assert set(per) == {"forest", "boosting", "perceptron", "logistic"} and per["forest"] > 0.95 and per["boosting"] > 0.95 and per["logistic"] > 0.95
    best = L.best_family(R.class_scores(scored, ["family"])).collect()
    assert {r["class"] for r in best} == {0, 1, 11} and all(r.f1 > 0.95 for r in best)


def test_scenarios_and_separability(planted):
    got = {(r.scenario, r.arm): r.macro_f1 for r in L.cross_scenario(planted, "scenario", ["app_a"], "label_attackId").collect()}
    assert set(got) == {(s, a) for s in ("dense", "sparse") for a in ("other", "same")}
    assert all(v > 0.8 for v in got.values()), got  # three small trees
    auc = {r["class"]: r.auc for r in L.separability(planted, ["app_a"], "label_attackId", [1, 11], "label_txNodeId").collect()}
    assert auc[1] > 0.95 and auc[11] > 0.95 and abs(auc[-1] - 0.5) < 0.35  # the control is benign against benign


def test_time_costs_nothing_where_nothing_drifts(planted):
    row = L.temporal(planted.withColumn("t", planted.key_rxNodeId * 1.0), "t", {"app": ["app_a"]}, "label_attackId").first()
    assert row.late_f1 > 0.95 and row.control_f1 > 0.95 and row.late + row.control == 90
    bins = L.prequential(planted.withColumn("t", planted.key_rxNodeId * 1.0), "t", 3, ["app_a"], "label_attackId", least=10).collect()
    assert len(bins) == 3 and all(r.macro_f1 > 0.95 for r in bins)


def test_model_is_asked_once_for_all_scores(spark):
    """The scores read the counts several times; each row is to be predicted once."""
    from pyspark.sql import functions as F

    asked = spark.sparkContext.accumulator(0)

    def predict(x):
        asked.add(1)
        return x % 3

    rows = spark.range(60).select((F.col("id") % 2).cast("int").alias("y"), F.udf(predict, "int")(F.col("id").cast("int")).alias("p"))
    assert R.metrics(rows).count() == 1 and asked.value == 60
    assert R.class_scores(rows).count() == 3 and asked.value == 120


@pytest.mark.parametrize("n", [0, 1, 3, 250, 399, 400, 1000])
def test_large_samples_are_the_first_rows_by_hash(spark, monkeypatch, n):
    from ringtrace.operators import partition as P

    df = spark.createDataFrame([(None if k % 50 == 0 else k * 7919,) for k in range(400)], "key long")
    want = sorted(str(r.key) for r in P.sample_n(df, n, "key", 3).collect())
    monkeypatch.setattr(P, "TOP", 2)
    got = P.sample_n(df, n, "key", 3)
    assert sorted(str(r.key) for r in got.collect()) == want and len(want) == min(n, 400)


def test_large_sample_does_not_pass_one_task(spark):
    from pyspark.sql import functions as F

    from ringtrace.operators import partition as P

    df = spark.range(0, 200_000, 1, 8).withColumnRenamed("id", "key")
    got = P.sample_n(df, 120_000, "key")
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 120_000 and max(sizes) < 30_000


def test_scores_read_a_table_of_counts(spark):
    """A search or a model behind the rows is not part of the scores' plan, where it would stand several times."""
    from pyspark.sql import functions as F

    rows = spark.range(60).select((F.col("id") % 2).cast("int").alias("y"), F.udf(lambda x: x % 3, "int")(F.col("id").cast("int")).alias("p"))
    for scores in (R.metrics(rows), R.class_scores(rows)):
        plan = scores._jdf.queryExecution().toString()
        assert "Python" not in plan and "parquet" in plan.lower()


def test_trees_of_counts_are_the_trees_of_the_rows(spark, planted):
    """Equal rows go in as one weighted kind; up to ``DRAWN`` rows a forest still draws each on its own."""
    from pyspark.sql import functions as F

    cols = ["app_a", "phy_b"]
    rows = planted.withColumn("app_a", F.round("app_a", 0)).withColumn("phy_b", F.round("phy_b", 1))  # few values: bins of one value each
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50))))
    tree = lambda: L.DecisionTreeClassifier(labelCol="idx", maxDepth=4)
    one, all_ = (L.fit(x, cols, "label_attackId", tree()).stages[-1].toDebugString.split("\n", 1)[1] for x in (rows, many))
    assert one == all_
    got = {(r.y, r.p): r.n for r in L.score_counts(L.fit(rows, cols, "label_attackId", tree()), many, cols, "label_attackId").collect()}
    scored = L.score(L.fit(rows, cols, "label_attackId", tree()), many, cols, [F.col("label_attackId").alias("y")])
    assert got == {(r.y, r.p): r["count"] for r in scored.groupBy("y", "p").count().collect()} and sum(got.values()) == 18_000


def test_training_table_of_a_forest_stops_growing(spark, planted, monkeypatch):
    from pyspark.sql import functions as F

    sizes = []
    whole = L.cut
    monkeypatch.setattr(L, "cut", lambda df, name: sizes.append((name, whole(df, name))) or sizes[-1][1])
    monkeypatch.setattr(L, "DRAWN", 1000)
    many = planted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(100))))  # 36,000 rows of 360 kinds
    fitted = L.fit(many, ["app_a", "phy_b"], "label_attackId")
    drawn = dict(sizes)["drawn"].agg(F.count("*"), F.sum("weight"), F.max("weight")).first()
    assert drawn[0] <= 1000 + 360 and abs(drawn[1] - 36_000) < 1e-6 and drawn[2] <= 36
    assert L.R.metrics_of_counts(L.score_counts(fitted, many, ["app_a", "phy_b"], "label_attackId")).first().macro_f1 > 0.95


@pytest.mark.parametrize("values, bins, want", [([1.0] * 5 + [2.0] * 3 + [9.0], 32, [1.5, 5.5]), ([3.0] * 9, 4, []), ([], 4, []), ([float(v) for v in range(100)], 4, [24.5, 49.5, 74.5]), ([0.0] * 90 + [float(v) for v in range(1, 11)], 4, [0.5, 1.5, 2.5])])
def test_bins_of_a_feature(values, bins, want):
    assert L._edges(values, bins) == want


def test_mean_chances_equal_separate_runs(planted):
    """One table of all fold seeds, no shuffle: each row has the mean of its three models, as separate runs give it."""
    cols, key = ["app_a", "phy_b"], ["key_rxNodeId"]
    got = {r.key_rxNodeId: r for r in L.mean_chances(planted, cols, "label_attackId", "label_txNodeId", key).collect()}
    sums = {}
    for s in (0, 1, 2):
        for r in L.out_of_fold(planted, cols, "label_attackId", "label_txNodeId", 2, key, seed=s).collect():
            for c, v in r.chances.items():
                sums.setdefault(r.key_rxNodeId, {}).setdefault(c, []).append(v)
    assert set(got) == set(sums) and len(got) == 360
    assert all(set(got[k].chances) == set(m) and all(len(v) == 3 and abs(got[k].chances[c] - sum(v) / 3) < 0.25 for c, v in m.items()) for k, m in sums.items())
    called = {r.key_rxNodeId: r.p for r in L.likeliest_of(L.mean_chances(planted, cols, "label_attackId", "label_txNodeId", key), key).collect()}
    assert sum(called[k] == r.y for k, r in got.items()) > 340


def test_receiver_sweep_picks_once(spark, monkeypatch):
    """Each size is picked from the next larger one and written; the picks are those of the whole table."""
    rows = [("s", u, 0, n, float(n * 37 % 11), u % 2) for u in range(4) for n in range(9)]
    obs = spark.createDataFrame(rows, "key_seed string, key_claimedStationId long, key_window long, rxNodeId long, v double, label int")
    keys, seen = ["key_seed", "key_claimedStationId", "key_window"], {}
    monkeypatch.setattr(L, "all_arms", lambda kept, *a, **k: seen.setdefault(len(seen), kept).limit(1).select("v"))
    L.receiver_sweep(obs, ["v"], keys, "label", "key_claimedStationId", [2, 5])
    assert len(seen) == 2 and all("Window" not in kept._jdf.queryExecution().optimizedPlan().toString() for kept in seen.values())
    for kept, n in zip(seen.values(), (5, 2)):
        want = P.per_key(obs, keys, n, "rxNodeId")
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))
