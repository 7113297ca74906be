"""Positions at a time, pairs in reach, nearest attackers, exact quantiles and stateful streams against brute force."""

import math
import random
from bisect import bisect_left

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringtrace.operators import asof, quantiles as Q, spacetime as P
from ringtrace.streaming import jobs as J

TX = "key_seed string, msgUid long, txNodeId long, txTimeMs double, trueX double, trueY double, attackId int"


def trace(seed, n, nodes, span=1000, seeds="ab"):
    rng = random.Random(seed)
    rows = [(rng.choice(seeds), k, rng.randrange(nodes), float(rng.randrange(span)), rng.uniform(-300, 300), rng.uniform(-300, 300), 0) for k in range(n)]
    return [(s, k, v, t, x, y, int(v % 4 == 0)) for s, k, v, t, x, y, _ in rows]


def place(rows):
    """(seed, node, t) to the place of the first message at or after t, past the end the last; of equal times the smallest id."""
    tracks = {}
    for s, k, v, t, x, y, _ in sorted(rows, key=lambda r: (r[3], r[1])):
        at = tracks.setdefault((s, v), ([], []))
        if not at[0] or at[0][-1] != t:
            at[0].append(t)
            at[1].append((x, y))
    return lambda s, v, t: None if (s, v) not in tracks else tracks[s, v][1][min(bisect_left(tracks[s, v][0], t), len(tracks[s, v][0]) - 1)]


@pytest.mark.parametrize("slice_ms, reach", [(7.0, 80.0), (5000.0, 500.0)])
def test_pairs_in_reach(spark, slice_ms, reach):
    rows = trace(1, 160, 9) + [("a", 500, 3, None, 1.0, 1.0, 0), ("a", 501, 3, 10.0, None, 1.0, 0), ("c", 502, 3, 10.0, 0.0, 0.0, 0)]
    rng = random.Random(2)
    heard = [(s, k, rng.randrange(9)) for s, k, *_ in rows for _ in range(3)]
    known = [r for r in rows if None not in r]
    at, ears = place(known), set(heard)
    want = []
    for s, k, v, t, x, y, _ in known:
        for other in {r[2] for r in known if r[0] == s} - {v}:
            d = math.dist((x, y), at(s, other, t))
            if d <= reach:
                want.append((s, k, v, other, round(d, 6), (s, k, other) in ears))
    tx = spark.createDataFrame(rows, TX).withColumn("slice", F.lit(1)).withColumn("d", F.lit(1))
    got = P.prr_pairs(tx, spark.createDataFrame(heard, "key_seed string, msgUid long, rxNodeId long"), reach, slice_ms)
    assert sorted((r.key_seed, r.msgUid, r.sender, r.receiver, round(r.d, 6), r.ok) for r in got.collect()) == sorted(want) and want
    assert P.prr_by_distance(got, [0, reach]).first().pairs == len(want)


@pytest.mark.parametrize("reach, edges, scale", [(80.0, [0, 20, 50, 200], 1.0), (500.0, [0, 50, 100, 150, 200, 300, 400, 500], 1.0), (500.0, [0, 100, 300], 0.01), (30.0, [10, 20], 0.0)])
def test_counts_of_pairs_without_pairs(spark, monkeypatch, reach, edges, scale):
    from ringtrace.operators import sweep

    monkeypatch.setattr(sweep, "RUN", 5)
    rows = [(s, k, v, t, float(round(x)), y * scale, a) for s, k, v, t, x, y, a in trace(11, 400, 15)] + [("a", 900, 3, None, 1.0, 1.0, 0), ("a", 901, None, 9.0, 1.0, 1.0, 0), ("c", 902, 3, 10.0, 0.0, 0.0, 0), (None, 903, 3, 10.0, 0.0, 0.0, 0)]
    rows.append(rows[7])  # a repeated message
    rng = random.Random(12)
    heard = spark.createDataFrame([(s, k, rng.randrange(17)) for s, k, *_ in rows for _ in range(4)], "key_seed string, msgUid long, rxNodeId long")
    tx = spark.createDataFrame(rows, TX)
    pairs = P.prr_pairs(tx, heard, reach, 100.0).cache()
    key = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    order = lambda df: sorted(map(str, map(key, df.collect())))
    assert pairs.count() and order(P.prr_bands(tx, heard, reach, edges, 100.0)) == order(P.prr_by_distance(pairs, edges))
    want = pairs.groupBy("key_seed", "sender", "receiver").agg(F.count("*").alias("sent"), F.count_if("ok").alias("got"), F.avg("d").alias("d_mean"))
    assert order(P.prr_stats(tx, heard, reach)) == order(want)
    none = tx.limit(0)
    assert P.prr_stats(none, heard, reach).count() == 0 and P.prr_bands(none, heard, reach, edges, 100.0).count() == 0


def test_large_slice_costs_no_pairs():
    """A slice of 30,000 moments and 60,000 places: all pairs would be 1.8 billion."""
    import time

    import pyarrow as pa

    from ringtrace.operators import sweep

    rng = np.random.default_rng(5)
    n = 30_000
    t, x, y = np.sort(rng.uniform(0, 1000, n)), rng.uniform(0, 3000, n), rng.integers(-3, 4, n).astype(float)
    turn = rng.uniform(0, 1000, n)  # every station moves once
    px = rng.uniform(0, 3000, 2 * n)
    ends = {"from": np.r_[np.full(n, -np.inf), turn], "to": np.r_[turn, np.full(n, np.inf)]}
    places = pa.table({**ends, "px": px, "py": np.zeros(2 * n)})
    began = time.time()
    found, near = sweep.within(t, x, y, places, [0.0, 100.0, 500.0]), sweep.nearest(t, x, y, places, 50.0)
    assert time.time() - began < 60
    here, totals = np.arange(0, n, 1000), np.zeros(3, int)
    for k in here:
        on = (ends["from"] < t[k]) & (t[k] <= ends["to"])
        d = np.hypot(px[on] - x[k], y[k])
        assert near[k] == d.min()
        totals += [(d <= e).sum() for e in (0.0, 100.0, 500.0)]
    some = sum(sweep.within(t[k : k + 1], x[k : k + 1], y[k : k + 1], places, [0.0, 100.0, 500.0]) for k in here)
    assert list(some) == list(totals) and found[2] > found[1] > found[0] == 0


def test_pairs_of_nothing(spark):
    none = spark.createDataFrame([], TX)
    assert P.prr_pairs(none, spark.createDataFrame([], "key_seed string, msgUid long, rxNodeId long"), 10.0, 5.0).count() == 0


@pytest.mark.parametrize("cell, slice_ms", [(1.0, 60.0), (1000.0, 1e6)])
def test_nearest_attacker(spark, cell, slice_ms):
    rows = trace(3, 120, 12)
    rng = random.Random(4)
    obs = [(rng.choice("abz"), k, rng.randrange(14), float(rng.randrange(-50, 1100))) for k in range(60)] + [("a", 99, None, 5.0)]
    at = place(rows)
    bad = {(r[0], r[2]) for r in rows if r[6]}
    want = {}
    for s, k, v, t in obs:
        here = at(s, v, t) if v is not None else None
        ds = [math.dist(here, at(a, b, t)) for a, b in bad if a == s] if here else []
        want[k] = round(min(ds), 6) if ds else None
    got = P.nearest_attacker(spark.createDataFrame(obs, "key_seed string, oid long, rxNodeId long, t double"), spark.createDataFrame(rows, TX), F.col("attackId") == 1, cell, slice_ms)
    assert {r.oid: None if r.d is None else round(r.d, 6) for r in got.collect()} == want
    assert P.nearest_attacker(spark.createDataFrame(obs, "key_seed string, oid long, rxNodeId long, t double"), spark.createDataFrame(rows, TX), F.lit(False), cell, slice_ms).where("d IS NOT NULL").count() == 0


def test_positions_in_slices_equal_positions_whole(spark):
    rows = [r for r in trace(5, 150, 5)]
    asked = spark.createDataFrame([("a" if k % 2 else "b", k, k % 7, float(k * 13 % 1200 - 60)) for k in range(80)], "key_seed string, oid long, txNodeId long, t double")
    tx = spark.createDataFrame(rows, TX).dropDuplicates(["key_seed", "txNodeId", "txTimeMs"])
    one, two = (sorted(map(tuple, asof.position_at(asked, tx, ["key_seed", "txNodeId"], "t", "txTimeMs", ["trueX"], "oid", s).collect())) for s in (None, 50.0))
    assert str(one) == str(two)


@pytest.mark.parametrize("few, buckets", [(2, 3), (1000, 1024)])
def test_quantiles_equal_percentile(spark, few, buckets):
    rng = random.Random(6)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, 1e300, -1e300, 5e-324]
    rows = [(rng.choice(["x", "y", None]), rng.choice([rng.gauss(0, 1), float(rng.randrange(4)), rng.choice(odd)]), rng.uniform(0, 9)) for _ in range(300)]
    rows += [("one", 4.0, None), ("same", 2.0, 2.0), ("same", 2.0, 2.0), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double").withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    wanted = {"a": ("v", 0.0), "b": ("v", 0.5), "c": ("v", 0.95), "d": ("w", 0.33), "e": ("w", 1.0)}
    plain = [F.percentile(s, F.lit(q)).alias(k) for k, (s, q) in wanted.items()]
    values = {"v": F.col("v"), "w": F.col("w")}
    order = lambda rs: sorted((str(tuple(r)) for r in rs))
    got = Q.exact_quantiles(df, ["g"], values, wanted, buckets, few, 3)
    assert order(got.collect()) == order(df.groupBy("g").agg(*plain).where("g IS NULL OR g <> 'none'").collect())
    whole = Q.exact_quantiles(df, [], values, wanted, buckets, few).first()
    assert str(tuple(whole)) == str(tuple(df.agg(*plain).first()))
    assert tuple(Q.exact_quantiles(df.limit(0), [], values, wanted).first()) == (None,) * 5 and Q.exact_quantiles(df.limit(0), ["g"], values, wanted).count() == 0


def test_nearest_stream_gives_one_row_a_message(spark):
    rng = random.Random(7)
    at = lambda k: 1_700_000_000_000 + k
    messages = [(k, 0 if k % 9 else None, at(rng.randrange(4000)) + 0.5 * (k % 2)) for k in range(60)] + [(60, 0, at(9000.0)), (61, 0, at(20000.0))]
    heard = [(k, rng.randrange(2), at(rng.randrange(0, 4000, 10)), float(k), int(rng.random() < 0.5)) for k in range(80)] + [(80, 0, at(20000.0), 1.0, 0)]
    m = J.with_time(spark.createDataFrame(messages, "msgUid long, radio long, t double"), "t")
    h = J.with_time(spark.createDataFrame([(*r[:2], float(r[2]), *r[3:]) for r in heard], "radioUid long, rnti long, t double, sinr double, corrupt int"), "t")
    out = J.nearest_stream(
        J.file_stream(spark, m, "m", files=3, time="ts", late_ms=900), J.file_stream(spark, h, "h", files=3, time="ts", late_ms=900),
        {"radio": "rnti"}, ("msgUid", "radioUid"), ("t", "t"), ["msgUid"], {"": (F.lit(True), ["sinr"]), "ok_": (F.col("corrupt") == 0, ["sinr"])}, 50, "900 milliseconds")
    report = []
    got = J.run_to_table(out, "nearest-out", report=report).collect()
    best = lambda t, key, test: min(((abs(r[2] - t), r[2] > t, -r[0] if r[2] <= t else r[0], r[3]) for r in heard if r[1] == key and abs(r[2] - t) <= 50 and test(r)), default=[None])[-1]
    want = {k: (best(t, key, lambda r: True), best(t, key, lambda r: not r[4])) for k, key, t in messages if t < at(19000)}
    assert {r.msgUid: (r.sinr, r.ok_sinr) for r in got if r.msgUid < 61} == want and len([r for r in got if r.msgUid < 61]) == len(want)
    assert report and all(rows >= 0 for _, _, rows, _, _ in report)


def test_keys_of_a_stream_share_buckets(spark, monkeypatch):
    """Spark sees a bucket as a key, so that many small keys do not each pay for their calls of the state; keys do not mix in it."""
    from ringtrace.streaming import stateful

    monkeypatch.setattr(stateful, "BUCKETS", 2)
    rows = spark.range(120).selectExpr("'r' AS key_seed", "cast(id % 3 AS int) AS rxNodeId", "nullif(id % 10, 9) AS claimedStationId", "id AS msgUid", "1e6D + id * 1000.0D AS rxTimeMs",
                                       "id * 2.0D AS claimedX", "0.0D AS claimedY", "1.0D AS claimedSpeed", "0.0D AS claimedHeading", "0.0D AS rxX", "0.0D AS rxY")
    out = J.residuals_stream(J.file_stream(spark, J.with_time(rows, "rxTimeMs"), "shared", files=3, time="ts", late_ms=5000), "5 seconds")
    assert out._jdf.queryExecution().analyzed().toString().count("bucket#") > 0
    got = {r.msgUid: r.dt for r in J.run_to_table(out, "shared-out").collect()}
    assert set(got) == set(range(114))  # those the last watermark has passed
    assert all(got[k] == (30.0 if k >= 30 else None) for k in got)
