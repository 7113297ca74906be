"""Peer averaging, components, JSON arrays in byte ranges, best response of hot units, temporal hold-out."""

import random

import pytest
from pyspark.sql import functions as F

from ringtrace.operators import geometry as G, learn as L, mesh as M
from ringtrace.sources import io as IO


def reach(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        if a in up and b in up:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_mesh_keeps_the_mean_and_finds_components(spark):
    rng = random.Random(1)
    nodes, dead = list(range(0, 120, 3)), {9, 30, 60}
    frame = spark.createDataFrame([(n,) for n in nodes], "node long")
    links = M.ring_and_random(frame, 2, 5)
    made = {(r.src, r.dst) for r in links.collect()}
    assert all((a, b) in made for a, b in zip(nodes, [*nodes[1:], nodes[0]])) and all(a != b and b in nodes for a, b in made)
    assert made == {(r.src, r.dst) for r in M.ring_and_random(frame, 2, 5).collect()}
    edges = [*made, (3, 3), (3, None), (3, 7777), (6, 9)] + [(6, 12)] * 3
    edges = [(a, b) for a, b in edges if 18 not in (a, b)]  # 18 has no neighbour
    models = spark.createDataFrame([(n, d, rng.uniform(-1, 1)) for n in nodes for d in range(3)], "node long, dim int, v double")
    live = frame.where(~F.col("node").isin(dead))
    w = M.metropolis(frame, spark.createDataFrame(edges, "src long, dst long"), live)
    weights = {(r.src, r.dst): r.w for r in w.collect()}
    for n in nodes:
        assert sum(v for (a, _), v in weights.items() if a == n) == pytest.approx(1) and sum(v for (_, b), v in weights.items() if b == n) == pytest.approx(1)
    assert all(weights[n, n] == 1 for n in (*dead, 18))
    before = {(r.node, r.dim): r.v for r in models.collect()}
    after = {(r.node, r.dim): r.v for r in M.mix(models, w, 25).collect()}
    alive = [n for n in nodes if n not in dead]
    for d in range(3):
        assert sum(after[n, d] for n in alive) == pytest.approx(sum(before[n, d] for n in alive))
        assert all(after[n, d] == before[n, d] for n in dead | {18})
    far, near = (M.consensus_distance(spark.createDataFrame([(*k, v) for k, v in m.items() if k[0] != 18], "node long, dim int, v double"), live).first() for m in (before, after))
    assert near.distance < far.distance / 5 and near.nodes == len(alive) - 1


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    nodes = [n for n in range(520) if n % 70 != 69]
    got = M.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.root for r in got.collect()} == reach(nodes, edges)
    assert M.components(spark.createDataFrame([], "node long"), spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_large_array_is_many_tasks(spark, tmp_path):
    rows = [f'{{"id": {k}, "in": {{"id2": "a,b], {{"}}, "t": "{"x" * (k % 50)}"}}' for k in range(3000)]
    rows[70] = '{"t": "first", "id": 70}'  # opens in another way
    rows[90] = '{"id": 90, "in": {broken}}'
    (tmp_path / "a.json").write_text("[\n" + ",\n".join(rows) + "\n]\n")
    (tmp_path / "b.json").write_text("[]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = IO.read_json_arrays(spark, str(tmp_path), "id long, t string", opens='{"id"')
        assert got.rdd.getNumPartitions() > 5
        assert sorted(r.r.id for r in got.collect()) == [k for k in range(3000) if k != 90]
        assert IO.read_json_arrays(spark, str(tmp_path), "id long, t string").count() == 2999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_best_response_of_hot_and_other_units(spark):
    rng = random.Random(3)
    rows = [("s", u, 1, rng.uniform(0, 900), rng.uniform(-9, 9), 400.0 + u, float(u), rng.uniform(-90, -60)) for u in range(4) for _ in range([4, 7, 40, 2100][u])] + [("s", 1, 1, None, 1.0, 401.0, 1.0, -70.0)]
    units = spark.createDataFrame(rows, "key_seed string, key_claimedStationId long, key_window long, rxX double, rxY double, trueX double, trueY double, phy_rsrp_mean double")
    one, two = ({(r.key_claimedStationId, r.level): tuple(r)[4:] for r in G.best_response(units, [25, 100], lateral=20.0, hot=h).collect()} for h in (10**6, 30))
    assert one.keys() == two.keys() and {k for k, _ in one} == {1, 2, 3}
    assert all(one[k] == pytest.approx(two[k], abs=2e-6) for k in one)
    assert G.best_response(units, [500], lateral=0.0).where("best_rmse IS NOT NULL AND direction NOT IN (0, 180)").count() == 0


def test_seeds_are_held_out_as_well_as_time(spark):
    df = spark.createDataFrame([(f"s{k % 6}", float(k % 100), k) for k in range(600)], "key_seed string, t double, k int")
    train, late, control, held = L.seed_and_time(df, "t", 0.5)
    seeds = lambda x: {r[0] for r in x.select("key_seed").distinct().collect()}
    assert seeds(train) == {"s0", "s1", "s2", "s3"} and seeds(late) == seeds(control) == seeds(held) == {"s4", "s5"}
    assert train.agg(F.max("t")).first()[0] < 49.5 <= late.agg(F.min("t")).first()[0] and held.count() == late.count() + control.count()
    train, late, control, _ = L.seed_and_time(df.where("key_seed = 's1'"), "t", 0.5)
    assert seeds(train) == seeds(late) == seeds(control) == {"s1"}
