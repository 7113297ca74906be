"""Work that must not grow faster than the input: what the plan may not hold, and jobs on many rows of one key."""

from pyspark.sql import functions as F

from ringtrace.operators import features as X
from ringtrace.operators.asof import asof_nearest, position_at


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def looks_ahead(df):
    """A frame from the row on to the end is read anew for each row by Spark: the square of the partition."""
    return ", unboundedfollowing$()" in plan(df)


def test_asof_joins_have_no_frame_that_looks_ahead(spark):
    left = spark.range(6).selectExpr("id AS u", "1 AS k", "id * 10.0D AS t")
    right = spark.range(4).selectExpr("id AS v", "1 AS k", "id * 17.0D AS t", "id AS x")
    for width in (None, 20.0):
        near = asof_nearest(left, right, "t", "t", {"k": "k"}, ["x"], "u", "v", slice_of=width)
        at = position_at(left, right, ["k"], "t", "t", ["x"], "u", width)
        assert not looks_ahead(near) and not looks_ahead(at)
        assert [r.x for r in near.orderBy("u").collect()] == [0, 1, 1, 2, 2, 3]
        assert [r.x for r in at.orderBy("u").collect()] == [0, 1, 2, 2, 3, 3]


def test_voiceprint_of_a_crowd_has_no_frame_that_looks_ahead(spark):
    agg = spark.range(90).selectExpr("'r' AS key_seed", "1 AS rxNodeId", "id AS claimedStationId", "0L AS window", "cast((id * 7) % 31 AS double) AS phy_rsrp_mean", "cast((id * 13) % 200 AS double) AS app_claimed_dist_mean")
    out = X.voiceprint(agg, crowded=8)
    assert not looks_ahead(out)
    rows = agg.collect()
    want = {a.claimedStationId: min((abs(a.phy_rsrp_mean - b.phy_rsrp_mean) for b in rows if b.claimedStationId != a.claimedStationId and abs(a.app_claimed_dist_mean - b.app_claimed_dist_mean) >= 30), default=None) for a in rows}
    assert {r.claimedStationId: r.phy_rsrp_voiceprint_min for r in out.collect()} == want


def test_fits_of_many_units_at_once_equal_one_at_a_time(spark):
    import numpy as np

    from ringtrace.operators import fits

    rng = np.random.default_rng(3)
    sizes, mu, sd = rng.integers(5, 49, 40), rng.normal(0, 1, 8), rng.uniform(1, 3, 8)
    held = np.arange(48) < sizes[:, None]
    ox, oy = rng.uniform(0, 2000, held.shape), rng.uniform(-12, 12, held.shape)
    power = -30 - 25 * np.log10(np.maximum(np.hypot(ox - 700, oy), 1)) + rng.normal(0, 2, held.shape)
    # without bounds on y the fit itself is ill-posed here: the order of the receivers alone moves one fit in five
    for how in ({"halfwidth": 18.0}, {"halfwidth": 18.0, "mu": mu, "sd": sd}, {"halfwidth": 18.0, "huber": True}):
        many = fits.gauss_newton_many(ox, oy, power, held, **how)
        one = np.array([fits.gauss_newton(*[v[i, :n] for v in (ox, oy, power)], **how) for i, n in enumerate(sizes)])
        same = np.isclose(many, one, rtol=1e-4, atol=1e-3).all(axis=1)
        assert same.mean() >= 0.95 and np.allclose(many[:, 4], one[:, 4], rtol=1e-2)


def test_free_fit_makes_no_group_of_each_unit(spark):
    from ringtrace.operators import fits

    units = spark.range(400).selectExpr("'s' AS key_seed", "id % 3 AS key_claimedStationId", "0L AS key_window", "id AS rxNodeId", "cast((id * 37) % 2000 AS double) AS rxX", "cast(id % 9 AS double) AS rxY", "-40 - 25 * log10(1 + abs((id * 37) % 2000 - 900.0D)) AS phy_rsrp_mean")
    few = units.where("key_claimedStationId > 0 OR rxNodeId < 12")
    found = fits.free_fit(few, 18.0)
    assert "flatmapgroups" not in plan(found)
    got = {r.key_claimedStationId: r for r in found.collect()}
    assert {k: r.n_obs for k, r in got.items()} == {0: 4, 1: 133, 2: 133}
    assert got[0].estX is None and abs(got[1].estX - 900) < 5


def receivers(spark, n):
    """Units of ``n`` receivers each, the sender of which stands at 900."""
    noise = "(hash(id, 7) % 100) / 50.0D"
    return spark.range(3 * n).selectExpr("'s' AS key_seed", "id % 3 AS key_claimedStationId", "0L AS key_window", "id AS rxNodeId", "cast((id * 37) % 2000 AS double) AS rxX", "cast(id % 9 AS double) AS rxY",
                                         f"-40 - 25 * log10(greatest(hypot((id * 37) % 2000 - 900.0D, id % 9), 1.0D)) + {noise} AS phy_rsrp_mean")


def test_free_fit_reads_every_receiver(spark, monkeypatch):
    import numpy as np

    from ringtrace.operators import fits

    units = receivers(spark, 90)
    whole = {r.key_claimedStationId: r for r in fits.free_fit(units, 18.0).collect()}
    for k, one in units.toPandas().groupby("key_claimedStationId"):
        want = fits.gauss_newton(one.rxX.to_numpy(), one.rxY.to_numpy(), one.phy_rsrp_mean.to_numpy(), 18.0)
        got = whole[k]
        assert got.n_obs == 90 and np.allclose([got.estX, got.estY, got.estA, got.estN, got.free_rmse], want, rtol=1e-3, atol=1e-2)
    # a crowded unit is fitted by passes over its rows
    more = units.union(receivers(spark, 20).withColumn("key_window", F.lit(1)))
    for how in ({"halfwidth": 18.0}, {"halfwidth": 18.0, "huber": True, "mu": [0.1] * 8, "sd": [1.5] * 8}):
        monkeypatch.setattr(fits, "CROWDED", 4096)
        at_once = {(r.key_claimedStationId, r.key_window): r for r in fits.free_fit(more, **how).collect()}
        monkeypatch.setattr(fits, "CROWDED", 50)
        apart = {(r.key_claimedStationId, r.key_window): r for r in fits.free_fit(more, **how).collect()}
        assert len(apart) == 6 and apart.keys() == at_once.keys()
        assert all(np.allclose(list(apart[k])[3:], list(at_once[k])[3:], rtol=1e-3, atol=1e-2) for k in apart)
