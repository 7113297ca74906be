"""Closed forms against brute force, invariants of splits, planted signals and edge rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from ringtrace.functions import scalars as S
from ringtrace.operators import asof, features as X, fits, gates as Q, geometry as G, learn as L, neighbours as N, partition as P, reports as R
from ringtrace.operators.ranks import hash_rank
from ringtrace.sources import adapters as A, io as IO

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("slice_of", [None, 7.0, 1000.0])
@pytest.mark.parametrize("tolerance", [None, 5.0])
def test_asof_equals_pandas(spark, tolerance, slice_of):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"id": range(800), "k": rng.integers(0, 4, 800), "t": rng.integers(0, 300, 800).astype(float)})
    right = pd.DataFrame({"rid": range(800), "k": rng.integers(0, 5, 800), "t2": rng.integers(0, 300, 800).astype(float)})
    right["v"] = right.rid * 10
    want = pd.merge_asof(left.sort_values(["t", "id"]), right.sort_values(["t2", "rid"]), left_on="t", right_on="t2", by="k", direction="nearest", tolerance=tolerance)
    lost = spark.createDataFrame([(9001, None, 5.0)], "id long, k long, t double")
    got = asof.asof_nearest(spark.createDataFrame(left).union(lost), spark.createDataFrame(right), "t", "t2", {"k": "k"}, ["v"], "id", "rid", tolerance, slice_of)
    got = {r.id: r.v for r in got.collect()}
    assert got.pop(9001) is None
    assert got == {i: None if pd.isna(v) else int(v) for i, v in zip(want.id, want.v)}


def test_claim_fit_equals_least_squares(spark):
    u = A.units(spark, SF)
    got = {(r.key_seed, r.key_claimedStationId): r for r in G.claim_fit(u, least=3).collect()}
    pdf = u.toPandas()
    for (seed, station), g in pdf.groupby(["key_seed", "key_claimedStationId"]):
        if len(g) < 3:
            continue
        l = -10 * np.log10(np.maximum(np.hypot(g.rxX - g.claimedX, g.rxY - g.claimedY), 1))
        beta, *_ = np.linalg.lstsq(np.c_[np.ones(len(g)), l], g.phy_rsrp_mean, rcond=None)
        r = g.phy_rsrp_mean - np.c_[np.ones(len(g)), l] @ beta
        assert got[seed, station].claim_exp == pytest.approx(beta[1], rel=1e-7)
        assert got[seed, station].claim_rmse == pytest.approx(np.sqrt((r**2).mean()), rel=1e-6)


def test_planted_lies_raise_the_residual(spark):
    u = A.units(spark, "/root/testdata/sf0.01")
    med = {r.label: r.m for r in G.claim_fit(u).join(u.select(*G.TRIPLE, "label").distinct(), G.TRIPLE).groupBy("label").agg(F.percentile("claim_rmse", F.lit(0.5)).alias("m")).collect()}
    assert med[1] > 2 * med[0]
    moved = G.permute_claims(u.groupBy(*G.TRIPLE).agg(F.max("claimedX").alias("claimedX"), F.max("claimedY").alias("claimedY")))
    wrong = u.drop("claimedX", "claimedY").join(moved.select(*G.TRIPLE, F.col("newX").alias("claimedX"), F.col("newY").alias("claimedY")), G.TRIPLE)
    assert G.claim_fit(wrong).agg(F.percentile("claim_rmse", F.lit(0.5))).first()[0] > med[1]


def test_free_fit_finds_planted_positions():
    rng = np.random.default_rng(3)
    for _ in range(10):
        ox, oy = rng.uniform(0, 2000, 40), rng.uniform(-200, 200, 40)
        x, y = rng.uniform(300, 1700), rng.uniform(-15, 15)
        power = -30 - 25 * np.log10(np.maximum(np.hypot(ox - x, oy - y), 1))
        px, py, a, n, rmse = fits.gauss_newton(ox, oy, power, halfwidth=18.0)
        assert np.hypot(px - x, py - y) < 1 and abs(n - 2.5) < 0.05 and rmse < 0.1


def test_thin_units_are_undefined(spark):
    few = A.units(spark, SF).where("key_window = 1").groupBy(*G.TRIPLE).agg(F.first("rxNodeId").alias("rxNodeId"), F.first("rxX").alias("rxX"), F.first("rxY").alias("rxY"), F.first("phy_rsrp_mean").alias("phy_rsrp_mean"))
    assert all(r.estX is None for r in fits.free_fit(few).collect())


def test_auc_counts_pairs(spark):
    rng = np.random.default_rng(0)
    v, y = rng.integers(0, 6, 120), rng.integers(0, 2, 120)
    got = R.auc(spark.createDataFrame(pd.DataFrame({"v": v, "y": y})), ["v"], "y", [1]).first().auc
    pos, neg = v[y == 1], v[y == 0]
    assert got == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))


def test_splits_never_share_a_station(spark):
    df = A.corpus(spark, SF)
    split = P.assign(P.station_table(df)).select(*P.STATION, "label_attackId", "split").cache()
    assert P.multi(split, P.STATION, "split").count() == 0
    assert {r.split for r in split.collect()} == {"train", "validation", "test"}
    assert P.attach_split(df, split.select(*P.STATION, "split"), P.STATION).where("split IS NULL").count() == 0
    folds = P.grouped_folds(df, "label_txNodeId", 3, "label_attackId")
    assert folds.groupBy("label_txNodeId").count().where("count > 1").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3])
def test_small_classes_reach_every_part(spark, n):
    st_ = spark.createDataFrame([("s1", k, 7) for k in range(n)], "key_seed string, label_txNodeId long, label_attackId int")
    parts = {r.split for r in P.assign(st_).collect()}
    assert parts == {"train", "validation", "test"} if n == 3 else len(parts) >= 1


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-2e4, 2e4), min_size=1, max_size=30))
def test_ring_and_angles(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    row = df.agg(F.max(F.abs(S.unwrap("x", 6000))).alias("u"), F.max(S.angle_gap("x", F.lit(0.0))).alias("g"), F.min(S.signed_angle("x")).alias("lo"), F.max(S.signed_angle("x")).alias("hi")).first()
    assert row.u <= 3000 and 0 <= row.g <= 180 and -180 <= row.lo and row.hi < 180


def test_edges_of_scalars(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (None,), (60.0,), (0.0,)], "x double")
    rows = [tuple(r) for r in df.select(S.quantise("x", 1.0), S.cut_bins("x", [0, 1, 60]), S.digitize("x", [0.5, 60]), S.at_least("x", 1.0), S.to_db("x")).collect()]
    assert [r[0] for r in rows] == [0.0, 2.0, 2.0, None, 60.0, 0.0]
    assert [r[1] for r in rows] == [0, 1, 1, None, 1, None]
    assert [r[2] for r in rows] == [1, 1, 1, None, 2, 0]
    assert rows[3][3] is None and rows[5][4] is None


def test_ring_crossing_and_standing_still(spark):
    cols = "key_seed string, msgUid long, rxTimeMs double, rxNodeId int, claimedStationId long, seqNo long, claimedX double, claimedY double, claimedSpeed double, claimedHeading double, rxX double, rxY double"
    rows = [("r", 1, 0.0, 0, 1, 5, 5990.0, 0.0, 20.0, 90.0, 0.0, 0.0), ("r", 2, 1000.0, 0, 1, 9, 10.0, 0.0, 20.0, 90.0, 0.0, 0.0), ("r", 3, 1000.0, 0, 1, 2, 11.0, 0.0, 20.0, 90.0, 0.0, 0.0), ("r", 4, 0.0, 0, 2, 1, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0)]
    got = X.seq_gap(X.message_residuals(spark.createDataFrame(rows, cols))).orderBy("msgUid").collect()
    assert got[1].dx == 20.0 and abs(got[1].predict) < 1e-9 and abs(got[1].heading) < 1e-9
    assert got[2].dt == 0.0 and got[2].ssc is None and got[2].accel is None and got[2].heading is None
    assert got[3].dt is None and [g.seq_gap for g in got] == [2, 3, None, None]


def test_wrapped_windows_are_dropped(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1000.0), (2, 0.0), (2, 1000.1)], "k long, x double")
    kept, lost = G.window_mean(df, ["k"], ["x"], "x")
    assert [r.k for r in kept.collect()] == [1] and lost.first().dropped == 1


def test_guards_fail_loudly(spark):
    df = A.corpus(spark, SF)
    with pytest.raises(ValueError):
        P.check_features(df, ["app_quantity"])
    with pytest.raises(ValueError):
        G.require_every_seed(A.units(spark, SF), ["s1", "nowhere"])
    with pytest.raises(ValueError):
        P.assert_disjoint(df, df, ["key_seed"])
    with pytest.raises(ValueError):
        IO.require_fields(df, ["nothing"])
    with pytest.raises(ValueError):
        P.rebase(spark.createDataFrame([("s1", 5), ("s1", 200_000)], "key_seed string, id long"), "id")


def test_metrics_without_attacks(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.9)], "y int, score double")
    row = R.threshold_table(df, [0.5], 0.01, 1.0).first()
    assert row.fpr == 0.5 and row.recall == 0 and row.mcc == 0
    same = spark.createDataFrame([(1.0, 1), (1.0, 0)], "v double, y int")
    assert R.auc(same, ["v"], "y", [1]).first().auc == 0.5


def test_empty_register_gives_unknown_roles(spark):
    rows = X.attach_roles(A.rx(spark, SF), IO.read_roles(spark, "/nowhere/stations.csv"))
    assert {r[0] for r in rows.select("key_observer_role").distinct().collect()} == {"unknown"}


def test_duplicates_and_dead_features(spark):
    df = spark.createDataFrame([(0, 1.001, 2.0), (0, 1.002, 2.0), (1, 5.0, 3.0)], "y int, app_a double, app_b double")
    whole = Q.gate_duplicates(df, ["app_a", "app_b"], "y").where("y IS NULL").first()
    assert whole.duplicates == pytest.approx(1 / 3)
    assert [r.feature for r in Q.gate_dead(df, ["app_a", "app_b"], "y").collect()] == ["app_b"]


@pytest.mark.parametrize("crowded", [3, 1000])
def test_voiceprint_equals_all_pairs(spark, crowded):
    rng = np.random.default_rng(5)
    rows = [("s", int(rng.integers(0, 2)), k, 1, None if k % 11 == 0 else float(rng.normal(-80, 5)), None if k % 13 == 0 else float(rng.uniform(0, 400))) for k in range(120)]
    rows += [("s", 0, 500, 1, rows[1][4], rows[1][5]), ("s", 1, 1, 2, -50.0, 10.0)]
    df = spark.createDataFrame(rows, "key_seed string, rxNodeId int, claimedStationId long, window long, phy_rsrp_mean double, app_claimed_dist_mean double")
    got = {(r.rxNodeId, r.claimedStationId, r.window): r.phy_rsrp_voiceprint_min for r in X.voiceprint(df, crowded=crowded).collect()}
    for _, n, k, w, r, x in rows:
        gaps = [abs(r - r2) for _, n2, k2, w2, r2, x2 in rows if None not in (r, r2, x, x2) and (n, w) == (n2, w2) and k != k2 and abs(x - x2) >= 30.0]
        assert got[n, k, w] == (pytest.approx(min(gaps)) if gaps else None)


def test_families_of_all_codes(spark):
    named = {1: "spoofing", 3: "spoofing", 11: "spoofing", 13: "spoofing", 7: "flooding", 12: "flooding", 4: "replay", 0: "benign", 5: "other", 6: "other", 8: "other"}
    df = spark.createDataFrame([(y, p) for y in named for p in (0, y, 11)], "y int, p int")
    got = {r.family: r for r in R.family_scores(df).collect()}
    assert set(got) == set(named.values())
    assert got["benign"].flagged == pytest.approx(1 / 3) and got["replay"].named == pytest.approx(1 / 3) and got["spoofing"].named == pytest.approx(2 / 3)


def test_gates_can_fail(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0, 0.5), (1, 2.0, 0.5), (1, 3.0, 0.7)], "y int, app_a double, app_b double")
    assert [r.feature for r in Q.gate_dead(df, ["app_a", "app_b"], "y").collect()] == ["app_a", "app_b"]
    assert {r.y: r.ok for r in Q.gate_balance(spark.createDataFrame([(0,)] * 95 + [(1,)] * 5, "y int"), "y").collect()} == {0: False, 1: True}
    sure = spark.createDataFrame([(k % 3, k % 3) for k in range(30)], "y int, p int")
    assert Q.leakage_alarm(R.metrics(sure)).first().alarm and not Q.leakage_alarm(R.metrics(sure.withColumn("p", F.lit(1)))).first().alarm
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    made = IO.checksums(spark, str(tmp_path)).collect()
    listed = spark.createDataFrame(made, IO.checksums(spark, str(tmp_path)).schema)
    (tmp_path / "b.txt").write_text("changed")
    (tmp_path / "c.txt").write_text("new")
    bad = IO.verify_checksums(IO.checksums(spark, str(tmp_path)), listed).first()
    assert any(v for v in bad.asDict().values() if v) and not all(v == 0 for v in bad.asDict().values())


def test_residual_correlation_of_another_law(spark):
    u = A.units(spark, SF)
    wrong = G.claim_fit(u).withColumn("claim_exp", F.col("claim_exp") + 1.0)
    assert all(abs(r.claim_range_corr) > 0.5 for r in G.residual_range_corr(u, wrong).collect() if r.claim_range_corr != 0) and G.residual_range_corr(u, wrong).where("abs(claim_range_corr) > 0.5").count() > 0


def test_guards_refuse_shared_scenarios(spark):
    ids = "key_seed string, id long"
    for rows in ([("s1", 5), ("t1", 6)], [("nothing", 5)]):
        with pytest.raises(ValueError):
            P.rebase(spark.createDataFrame(rows, ids), "id")
    tx = A.tx(spark, SF)
    twice = tx.unionByName(tx.withColumn("key_seed", F.lit("r2")))
    with pytest.raises(ValueError):
        P.require_distinct_prints(P.fingerprint(twice))
    with pytest.raises(ValueError):
        P.require_no_twins(tx, tx)
    df = A.corpus(spark, SF)
    with pytest.raises(ValueError):
        P.attach_split(df, P.assign(P.station_table(df)).where("label_txNodeId % 2 = 0"), P.STATION, complete=True)


def test_floor_finds_a_planted_crossing(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(600):
        offset = float(np.exp(rng.uniform(1, 6)))
        rows.append((f"s{k % 8}", k, offset, bool(rng.random() < 1 / (1 + np.exp(-3 * (np.log(offset) - np.log(47.0)))))))
    st_ = spark.createDataFrame(rows, "key_seed string, station long, offset double, caught boolean")
    got = {r.cluster: r for r in fits.floor_interval(fits.detection_floor(st_, replicates=200)).collect()}
    for r in got.values():
        assert r.low < r.crossing < r.high and r.low < 47 < r.high and r.high - r.low < 30 and r.failed == 0
    none = fits.detection_floor(st_.withColumn("caught", F.lit(False)), replicates=3)
    assert all(r.crossing is None for r in none.where("replicate = 0").collect())


@pytest.mark.parametrize("per_cell", [40, 10**6])
def test_nearest_class_equals_plain_search(spark, per_cell):
    df = A.corpus(spark, SF)
    fs = ["app_quantity", "app_price", "phy_discount", "phy_tax"]
    train, test = df.where("label_txNodeId % 5 > 0"), df.where("label_txNodeId % 5 = 0")
    a, b = train.toPandas(), test.toPandas()
    m, s = a[fs].mean(), a[fs].std(ddof=0)
    x, q = ((t[fs] - m).to_numpy() / s.to_numpy() for t in (a, b))
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    want = [a.label_attackId[row <= row.min() + 2e-9].min() for row in d]
    got = N.nearest_class(train, test, fs, "label_attackId", per_cell).groupBy("y", "p").count().collect()
    assert {(r.y, r.p): r["count"] for r in got} == pd.Series(list(zip(b.label_attackId, want))).value_counts().to_dict()


def test_nearest_counts_are_those_of_the_rows(spark):
    df = A.corpus(spark, SF)
    fs = ["app_quantity", "app_price", "phy_discount", "phy_tax"]
    train, test = df.where("label_txNodeId % 5 > 0"), df.where("label_txNodeId % 5 = 0")
    found = N.nearest_counts(train, test.union(test), fs, "label_attackId")
    want = N.nearest_class(train, test, fs, "label_attackId").groupBy("y", "p").count().collect()
    assert {(r.y, r.p): r.n for r in found.collect()} == {(r.y, r.p): 2 * r["count"] for r in want}
    none = N.nearest_counts(train.limit(0), test, fs, "label_attackId").collect()
    assert all(r.p is None for r in none) and sum(r.n for r in none) == test.count()


def test_floor_reads_its_table_once(spark, tmp_path):
    """The table behind the stations is gone after the first scan; the steps read their own rows."""
    import os
    import shutil

    path = str(tmp_path / "stations")
    rows = [(f"s{k % 8}", k, 1.0 + k, k % 3 > 0) for k in range(60)]
    spark.createDataFrame(rows, "key_seed string, station long, offset double, caught boolean").write.parquet(path)
    was = fits.cut
    try:
        fits.cut = lambda df, name: (was(df, name), shutil.rmtree(path))[0]
        assert fits.detection_floor(spark.read.parquet(path), replicates=20).count() == 42
    finally:
        fits.cut = was
    assert not os.path.exists(path)


@pytest.mark.parametrize("late_ms", [0, 3 * 86_400_000])
def test_streams_hold_rows_for_order_and_drop_later_ones(spark, late_ms):
    from ringtrace.streaming import jobs as J

    rx = J.with_time(A.rx(spark, SF), "rxTimeMs")
    want = {r.msgUid: r for r in X.message_residuals(A.rx(spark, SF)).collect()}
    times = {r.msgUid: int(r.rxTimeMs) for r in want.values()}
    end = max(times.values()) - late_ms
    src = J.file_stream(spark, rx, "late", files=5, time="ts", late_ms=late_ms)
    got = {r.msgUid: r for r in J.run_to_table(J.residuals_stream(src, f"{late_ms} milliseconds"), "late-out").collect()}
    assert set(got) == {m for m, t in times.items() if t < end}
    for m, r in got.items():
        for c in J.RESIDUALS:
            assert (r[c] is None) == (want[m][c] is None) and (r[c] is None or r[c] == pytest.approx(want[m][c], abs=1e-6))
    if late_ms:  # half the lateness that the rows have: some are dropped, none comes out twice
        src = J.file_stream(spark, rx, "late", files=5, time="ts", late_ms=late_ms)
        less = [r.msgUid for r in J.run_to_table(J.residuals_stream(src, "1 hour"), "later-out").collect()]
        assert len(less) == len(set(less)) < len(times)


def test_soft_votes_follow_the_mean_chance(spark):
    from ringtrace.operators import learn as L

    rows = [("u", 1, 7, 3, {3: 0.6, 7: 0.4}), ("u", 2, 7, 3, {3: 0.55, 7: 0.45}), ("u", 3, 7, 7, {3: 0.1, 7: 0.9})]
    df = spark.createDataFrame(rows, "key string, rxNodeId long, y int, p int, chances map<int,double>")
    got = {r.arm: r.p for r in L.pool_arms(df, ["key"]).collect()}
    assert got["vote"] == 3 and got["vote-soft"] == 7 and got["single"] in (3, 7)


def test_nextgen_arrays(spark, tmp_path):
    import json

    home = tmp_path / "constantPositionOffset" / "logs"
    home.mkdir(parents=True)
    good = {"rcvTime": 2_500_000, "sender_id": "veh_7", "messageID": 5, "attacker": 1, "sender": {"pos": "1.5,2,0", "spd": "3", "hed": "-90"}, "receiver": {"pos": "4,5,0"}}
    (home / "veh_3.json").write_text(json.dumps([good, good | {"sender": {"pos": "x,2", "spd": "3", "hed": "0"}}, good | {"receiver": None}, good | {"attacker": 0, "messageID": 6}]))
    (home / "veh_4.json").write_text("[]")
    rows = {r.msgUid: r for r in IO.read_nextgen_arrays(spark, str(tmp_path)).collect()}
    assert set(rows) == {5, 6} and (rows[5].label_attackId, rows[6].label_attackId) == (2, 0)
    assert tuple(rows[5])[:9] == (2.5, 7, 5, 1.5, 2.0, 4.0, 5.0, 3.0, 270.0) and rows[5].rxNodeId == 3
    (tmp_path / "randomPositionOffset").mkdir()
    (tmp_path / "randomPositionOffset" / "veh_1.json").write_text("[]")
    with pytest.raises(ValueError, match="names"):
        IO.read_nextgen_arrays(spark, str(tmp_path))


def campaign_tx(spark, heading, lies):
    """Ten benign stations with errors up to 4 m, and stations of the classes in ``lies`` with their offsets."""
    rows = [(s, t, t * 7 + s, 2, 0, float(t % 5), heading) for s in range(10) for t in range(0, 50)]
    rows += [(100 * c + k, t, t * 7, 2, c, off, 0.0) for c, offs in lies.items() for k, off in enumerate(offs) for t in range(20)]
    df = pd.DataFrame(rows, columns=["txNodeId", "msgUid", "txTimeMs", "msgType", "attackId", "claimedX", "claimedHeading"])
    df["txTimeMs"] = df.msgUid**2 % 97
    return spark.createDataFrame(df.assign(claimedY=0.0, trueX=0.0, trueY=0.0, trueHeading=0.0))


@pytest.mark.parametrize("heading, lies, failed", [
    (359.0, {1: [150.0], 11: [12.0, 14.0], 13: [40.0]}, set()),
    (0.5, {11: [12.0], 13: [40.0]}, {"heading"}),
    (2.0, {11: [12.0, 50.0], 13: [40.0]}, {"bands"}),
    (2.0, {1: [0.0, 0.0, 90.0]}, {"silent"}),
    (2.0, {}, {"attackers"}),
])
def test_campaign_problems(spark, heading, lies, failed):
    stations = spark.createDataFrame([(1, 1, "rsu")], "nodeId long, stationId long, role string")
    assert {r.check for r in Q.check_campaign(campaign_tx(spark, heading, lies), stations).collect() if not r.ok} == failed


def test_region_arms_match_rates(spark):
    u = A.units(spark, SF).withColumn("key_region", F.col("rxNodeId") % 3)
    got = {(r.rule, r.y): r for r in L.region_arms(u, 0.2).collect()}
    s = G.claim_fit(u, [*G.TRIPLE, "key_region"]).withColumn("y", (F.col("key_claimedStationId") % 5 == 0).cast("int")).toPandas()
    best = s.groupby([*G.TRIPLE, "y"], as_index=False).claim_rmse.max()
    for rule, rows in (("per region", s), ("any region", best)):
        t = got[rule, 0].threshold
        rate = rows.assign(f=rows.claim_rmse > t).groupby(["key_seed", "key_claimedStationId", "y"]).f.mean().groupby("y").mean()
        assert rate[0] <= 0.2 and got[rule, 0].flagged == pytest.approx(rate[0]) and got[rule, 1].flagged == pytest.approx(rate[1])


def test_choices_of_learners(spark):
    picked = spark.createDataFrame([(0, 2, "a,b"), (1, 2, "b,c"), (0, 1, "b")], "fold int, size int, features string")
    assert {tuple(r) for r in L.stability(picked).collect()} == {(2, "a", 1), (2, "b", 2), (2, "c", 1), (1, "b", 1)}
    f1 = spark.createDataFrame([(0, "forest", 0.5), (0, "boosting", 0.5), (1, "forest", 0.9), (1, "boosting", 0.2)], "class int, family string, f1 double")
    assert {tuple(r) for r in L.best_family(f1).collect()} == {(0, "boosting", 0.5), (1, "forest", 0.9)}
    ch = spark.createDataFrame([("r", 0, 0, 0.4), ("r", 0, 1, 0.4), ("r", 0, 11, 0.2)], "k string, y int, class int, chance double")
    assert [tuple(r) for r in L.likeliest(ch, ["k"]).collect()] == [("r", 0, 0)]


def test_distance_of_lies_to_the_estimate(spark):
    key = "key_seed string, key_claimedStationId long, key_window long"
    lies = spark.createDataFrame([("s", 1, 1, 10.0, 90.0), ("s", 2, 1, 10.0, None)], key + ", level double, direction double")
    truth = spark.createDataFrame([("s", 1, 1, 5.0, 0.0), ("s", 2, 1, 0.0, 0.0)], key + ", trueX double, trueY double")
    est = spark.createDataFrame([("s", 1, 1, 5.0, 4.0)], key + ", estX double, estY double")
    rows = {r.key_claimedStationId: r for r in G.toward_estimate(lies, truth, est).collect()}
    assert rows[1].claim_to_estimate == pytest.approx(6.0) and rows[1].truth_to_estimate == pytest.approx(4.0)
    assert rows[2].claim_to_estimate is None and rows[2].truth_to_estimate is None


@pytest.mark.parametrize("bits", [1, 12])
def test_hash_rank_is_a_row_number(spark, bits):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(None if k == 3 else int(k), int(i)) for i, k in enumerate(rng.choice(4, 500, p=[0.7, 0.1, 0.1, 0.1]))], "k int, id long")
    h = P.hashed("id") % 50 * 85899345  # ties, over the whole range
    got = {r.id: (r.r, r.n) for r in hash_rank(df, ["k"], h, ["id"], "r", "n", bits).collect()}
    g = Window.partitionBy("k")
    want = {r.id: (r.r, r.n) for r in df.withColumn("r", F.row_number().over(g.orderBy(h, "id"))).withColumn("n", F.count("*").over(g)).collect()}
    assert got == want and hash_rank(df.limit(0), ["k"], h, ["id"], "r", "n").count() == 0


def test_power_bins_do_not_hang_on_last_bits(spark):
    """A mean of -64.5 is halfway between two bins of 3 dB, however its terms were added up."""
    means = [-64.5, np.nextafter(-64.5, 0), np.nextafter(-64.5, -100), -66.0]
    agg = spark.createDataFrame([("s", n, float(m), float(n)) for n, m in enumerate(means)], "key_seed string, n int, phy_rsrp_mean double, v double")
    got = {r.n: r.d for r in X.versus_bin(agg, "v", "d").collect()}
    assert got == {0: -1.5, 1: -0.5, 2: 0.5, 3: 1.5}
