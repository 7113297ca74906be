"""Nonlinear fits of small groups: damped Gauss-Newton in Arrow batches, many groups at a time."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import EDGES, MIN_OBS, TRIPLE, claim_fit, residual_range_corr
from .quantiles import with_quantiles
from ..sources.io import cut

#: Places of the padded arrays of units that are fitted together in a task.
TOGETHER = 1 << 16
#: Receivers from which a unit is crowded: it is fitted by passes over its rows, of which no task holds all.
CROWDED = 4096


def gauss_newton(ox, oy, power, halfwidth=None, mu=None, sd=None, huber=False, rounds: int = 60):
    """(x, y, A, n, rmse) of power = A - 10 n log10(range), from the loudest receiver; box constraints by projection."""
    import numpy as np

    k = int(np.argmax(power))
    p = np.array([ox[k], oy[k], power.max() + 20.0, 2.5])
    low = np.array([-np.inf, -np.inf if halfwidth is None else -halfwidth, -np.inf, 0.5 if halfwidth is not None else -np.inf])
    high = np.array([np.inf, np.inf if halfwidth is None else halfwidth, np.inf, 6.0 if halfwidth is not None else np.inf])
    p = np.clip(p, low, high)

    def model(q):
        dx, dy = q[0] - ox, q[1] - oy
        d = np.maximum(np.hypot(dx, dy), 1.0)
        pred = q[2] - 10 * q[3] * np.log10(d)
        bins = np.clip(np.digitize(d, EDGES) - 1, 0, len(EDGES) - 2)
        if mu is not None:
            pred = pred + np.asarray(mu)[bins]
        w = np.ones(len(d)) if sd is None else 1 / np.asarray(sd)[bins]
        r = (power - pred) * w
        if huber:
            w = w * np.sqrt(np.minimum(1.0, 1.5 / np.maximum(np.abs(r), 1e-12)))
            r = (power - pred) * w
        g = -10 * q[3] / np.log(10) / d**2
        return r, np.c_[g * dx, g * dy, np.ones(len(d)), -10 * np.log10(d)] * w[:, None], power - pred

    damp, (r, jac, raw) = 1e-2, model(p)
    for _ in range(rounds):
        a, b = jac.T @ jac, jac.T @ r
        step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-9), b, rcond=None)[0]
        q = np.clip(p + step, low, high)
        r2, jac2, raw2 = model(q)
        if r2 @ r2 < r @ r:
            done = r @ r - r2 @ r2 < 1e-10 * (r @ r)
            p, r, jac, raw, damp = q, r2, jac2, raw2, max(damp / 5, 1e-9)
            if done:
                break
        else:
            damp *= 5
            if damp > 1e9:
                break
    return [float(v) for v in p] + [float(np.sqrt(np.mean(raw**2)))]


def _box(n: int, halfwidth: float | None):
    """Lower and upper bounds of (x, y, A, n) for ``n`` units."""
    import numpy as np

    low = np.array([-np.inf, -np.inf if halfwidth is None else -halfwidth, -np.inf, 0.5 if halfwidth is not None else -np.inf])
    high = np.array([np.inf, np.inf if halfwidth is None else halfwidth, np.inf, 6.0 if halfwidth is not None else np.inf])
    return np.tile(low, (n, 1)), np.tile(high, (n, 1))


def _terms(q, ox, oy, power, mu, sd, huber):
    """(r, jac, raw) at parameters ``q``, whose columns broadcast against the receivers: weighted residuals, their four derivatives and plain residuals."""
    import numpy as np

    dx, dy = q[0] - ox, q[1] - oy
    d = np.maximum(np.hypot(dx, dy), 1.0)
    pred = q[2] - 10 * q[3] * np.log10(d)
    w = np.ones_like(d)
    if mu is not None or sd is not None:
        bins = np.clip(np.digitize(d, EDGES) - 1, 0, len(EDGES) - 2)
        pred = pred if mu is None else pred + np.asarray(mu)[bins]
        w = w if sd is None else w / np.asarray(sd)[bins]
    raw = power - pred
    r = raw * w
    if huber:
        w = w * np.sqrt(np.minimum(1.0, 1.5 / np.maximum(np.abs(r), 1e-12)))
        r = raw * w
    g = -10 * q[3] / np.log(10) / d**2
    return r, [g * dx * w, g * dy * w, w, -10 * np.log10(d) * w], raw


def _descend(p, box, sums, rounds: int):
    """Damped Gauss-Newton of many units at once; ``sums(q, live)`` gives (a, b, cost, raw) of the units ``live`` at ``q``.  (x, y, A, n, sum of raw squares) by row."""
    import numpy as np

    p, live = np.clip(p, *box), np.arange(len(p))
    a, b, cost, raw = sums(p, live)
    damp = np.full(len(p), 1e-2)
    for _ in range(rounds):
        if not len(live):
            break
        m = np.nan_to_num(a[live])
        m[:, range(4), range(4)] += damp[live, None] * (m[:, range(4), range(4)] + 1e-9)
        step = np.einsum("uij,uj->ui", np.linalg.pinv(m, rcond=4 * np.finfo(float).eps), np.nan_to_num(b[live]))
        q = np.clip(p[live] + step, box[0][live], box[1][live])
        a2, b2, cost2, raw2 = sums(q, live)
        better = cost2 < cost[live]
        done = np.where(better, cost[live] - cost2 < 1e-10 * cost[live], damp[live] * 5 > 1e9)
        won = live[better]
        p[won], cost[won], raw[won], a[won], b[won] = q[better], cost2[better], raw2[better], a2[better], b2[better]
        damp[live] = np.where(better, np.maximum(damp[live] / 5, 1e-9), damp[live] * 5)
        live = live[~done]
    return np.c_[p, raw]


def gauss_newton_many(ox, oy, power, held, halfwidth=None, mu=None, sd=None, huber=False, rounds: int = 60):
    """The same for many groups at once: a row a group, padded where ``held`` is false; (x, y, A, n, rmse) by row."""
    import numpy as np

    ox, oy, power = (np.where(held, v, 0.0) for v in (ox, oy, power))
    rows = np.arange(len(ox))
    k = np.where(held, power, -np.inf).argmax(axis=1)

    def sums(q, live):
        there = held[live]
        r, jac, raw = _terms(q.T[:, :, None], ox[live], oy[live], power[live], mu, sd, huber)
        r, raw = np.where(there, r, 0.0), np.where(there, raw, 0.0)
        jac = np.stack(jac, axis=2) * there[:, :, None]
        return np.swapaxes(jac, 1, 2) @ jac, np.einsum("uki,uk->ui", jac, r), (r**2).sum(axis=1), (raw**2).sum(axis=1)

    found = _descend(np.c_[ox[rows, k], oy[rows, k], power[rows, k] + 20.0, np.full(len(ox), 2.5)], _box(len(ox), halfwidth), sums, rounds)
    return np.c_[found[:, :4], np.sqrt(found[:, 4] / held.sum(axis=1))]


def fit_rows(units: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(triple, n_obs, obs): a row a unit with all its receivers as one array; apart, (triple, x, y, power) of crowded units, None without any."""
    rows = units.where("phy_rsrp_mean IS NOT NULL").select(*TRIPLE, F.struct(F.col("rxX").cast("double").alias("x"), F.col("rxY").cast("double").alias("y"), F.col("phy_rsrp_mean").cast("double").alias("power")).alias("o"))
    crowds = cut(rows.groupBy(*TRIPLE).agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).drop("n"), "crowded-units")
    crowd = None
    if not crowds.isEmpty():
        same = [F.col(f"u.{c}").eqNullSafe(F.col(f"c.{c}")) for c in TRIPLE]
        crowd = cut(rows.alias("u").join(crowds.alias("c"), same, "left_semi").select(*TRIPLE, "o.x", "o.y", "o.power"), "crowded-rows")
        rows = rows.alias("u").join(crowds.alias("c"), same, "left_anti")
    # sums of doubles depend on the order of their terms
    return rows.groupBy(*TRIPLE).agg(F.count("*").alias("n_obs"), F.sort_array(F.collect_list("o")).alias("obs")), crowd


_NAMES = ["estX", "estY", "estA", "estN", "free_rmse"]


def fitted(rows: DataFrame, crowd: DataFrame | None = None, halfwidth: float | None = None, mu=None, sd=None, huber: bool = False) -> DataFrame:
    """(triple, n_obs, estX, estY, estA, estN, free_rmse) of what ``fit_rows`` gives, many units at a time."""

    def run(batches):
        import numpy as np

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(c) for c in (*TRIPLE, "n_obs", "obs")], [*TRIPLE, "n_obs", "obs"])
            order = np.argsort(np.asarray(batch.column("n_obs")), kind="stable")
            at = 0
            while at < len(order):
                # units are in order of size, so that few places are padding
                size = np.asarray(batch.column("n_obs"))[order[at:]]
                fits = np.flatnonzero(size * np.arange(1, len(size) + 1) <= TOGETHER)
                many = max(1, int(fits[-1]) + 1 if len(fits) else 1)
                part = batch.take(pa.array(order[at : at + many]))
                at += many
                n, flat = np.asarray(part.column("n_obs")), part.column("obs").flatten()
                held = np.arange(max(n.max(), 1)) < n[:, None]
                values = []
                for field in ("x", "y", "power"):
                    values.append(np.zeros(held.shape))
                    values[-1][held] = flat.field(field).to_numpy(zero_copy_only=False)
                enough, found = n >= MIN_OBS, np.full((len(n), 5), np.nan)
                if enough.any():
                    found[enough] = gauss_newton_many(*[v[enough] for v in values], held[enough], halfwidth, mu, sd, huber)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(v, mask=~enough) for v in found.T]], [*TRIPLE, "n_obs", *_NAMES])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in (*TRIPLE, "n_obs")] + [f"{n} double" for n in _NAMES]))
    return out if crowd is None else out.unionByName(_fitted_apart(crowd, halfwidth, mu, sd, huber))


def _fitted_apart(crowd: DataFrame, halfwidth, mu, sd, huber, rounds: int = 60) -> DataFrame:
    """The same for crowded units: a step is one pass in which tasks return a few sums for each of them."""
    import numpy as np

    spark = crowd.sparkSession
    loudest = F.max(F.struct("power", (-F.col("x")).alias("x"), (-F.col("y")).alias("y")))
    first = crowd.groupBy(*TRIPLE).agg(F.count("*").alias("n"), loudest.alias("l")).collect()  # a row a crowded unit
    start = np.array([[-r["l"]["x"], -r["l"]["y"], r["l"]["power"] + 20.0, 2.5] for r in first])
    kinds = ", ".join(f"{c} {t}" for c, t in crowd.dtypes if c in TRIPLE)
    number = spark.createDataFrame([(*[r[c] for c in TRIPLE], k) for k, r in enumerate(first)], kinds + ", u int")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"k.{c}")) for c in TRIPLE]
    rows = cut(crowd.alias("o").join(number.alias("k"), same).select("k.u", "o.x", "o.y", "o.power"), "crowded-numbered")
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]

    def sums(q, live):
        full, asked = np.zeros((len(first), 4)), np.zeros(len(first), bool)
        full[live], asked[live] = q, True

        def run(batches):
            import numpy as np

            total = np.zeros((16, len(full)))
            for batch in batches:
                u = np.asarray(batch.column("u"))
                keep = asked[u]
                u, (x, y, power) = u[keep], (batch.column(c).to_numpy(zero_copy_only=False)[keep] for c in ("x", "y", "power"))
                r, jac, raw = _terms(full[u].T, x, y, power, mu, sd, huber)
                for k, v in enumerate([*[jac[i] * jac[j] for i, j in pairs], *[j * r for j in jac], r**2, raw**2]):
                    total[k] += np.bincount(u, v, len(full))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(full)), pa.int32()), pa.array(list(total.T), pa.list_(pa.float64()))], ["u", "sums"])

        parts = rows.mapInArrow(run, "u int, sums array<double>").select("u", F.posexplode("sums")).groupBy("u", "pos").agg(F.sum("col").alias("v"))
        t = np.zeros((len(full), 16))
        for r in parts.collect():  # sixteen sums a crowded unit
            t[r["u"], r["pos"]] = r["v"]
        t = t[live]
        a = np.zeros((len(live), 4, 4))
        for k, (i, j) in enumerate(pairs):
            a[:, i, j] = a[:, j, i] = t[:, k]
        return a, t[:, 10:14], t[:, 14], t[:, 15]

    found = _descend(start, _box(len(first), halfwidth), sums, rounds)
    out = [(*[r[c] for c in TRIPLE], r["n"], *map(float, v[:4]), float(np.sqrt(v[4] / r["n"]))) for r, v in zip(first, found)]
    return spark.createDataFrame(out, kinds + ", n_obs long, " + ", ".join(f"{n} double" for n in _NAMES))


def free_fit(units: DataFrame, halfwidth: float | None = None, mu=None, sd=None, huber: bool = False) -> DataFrame:
    """(triple, n_obs, estX, estY, estA, estN, free_rmse); a unit's fit uses all its receivers."""
    return fitted(*fit_rows(units), halfwidth, mu, sd, huber)


def consensus(units: DataFrame, halfwidth: float | None = None) -> DataFrame:
    """Claim fit and free fit side by side: the consensus statistics of a unit."""
    claim = units.groupBy(*TRIPLE).agg(F.first("claimedX").alias("cx"), F.first("claimedY").alias("cy"))
    claimed = claim_fit(units)
    span = units.where("phy_rsrp_mean IS NOT NULL").groupBy(*TRIPLE).agg((F.max("rxX") - F.min("rxX")).alias("obs_span"))
    both = claimed.drop("n_obs").join(free_fit(units, halfwidth), TRIPLE).join(claim, TRIPLE).join(span, TRIPLE).join(residual_range_corr(units, claimed), TRIPLE)
    return both.select(
        *TRIPLE, "n_obs", "obs_span", F.col("claim_range_corr").alias("claim_resid_corr"), "claim_rmse", "claim_r2", "claim_exp", "free_rmse", F.try_divide("claim_rmse", "free_rmse").alias("rmse_ratio"),
        F.hypot(F.col("estX") - F.col("cx"), F.col("estY") - F.col("cy")).alias("mlat_err"), (F.col("estX") - F.col("cx")).alias("mlat_dx"),
        F.col("estN").alias("mlat_exp"))


def estimator_study(units: DataFrame, truth: DataFrame, mu, sd, halfwidth: float | None = None) -> DataFrame:
    """Error quantiles of plain, weighted, robust and debiased fits on the same units."""
    arms = {"plain": {}, "weighted": {"sd": sd}, "huber": {"huber": True}, "weighted-huber": {"sd": sd, "huber": True},
            "debiased": {"mu": mu}, "debiased-weighted": {"mu": mu, "sd": sd}, "debiased-huber": {"mu": mu, "huber": True}}
    rows, crowd = fit_rows(units)
    rows, out = cut(rows, "estimator-units"), None
    for name, how in arms.items():
        one = fitted(rows, crowd, halfwidth, **how).join(truth, TRIPLE).select(
            F.lit(name).alias("arm"), F.hypot(F.col("estX") - F.col("trueX"), F.col("estY") - F.col("trueY")).alias("err"))
        out = one if out is None else out.union(one)
    out = cut(out, "estimator-study")  # every fit once
    stats = out.groupBy("arm").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("err") ** 2)).alias("rms"), F.count_if(F.col("err") > 500).alias("diverged"))
    found = with_quantiles(stats, out, ["arm"], {"e": F.col("err")}, {"median": ("e", 0.5), "p75": ("e", 0.75), "p90": ("e", 0.9)})
    return found.select("arm", "n", "median", "p75", "p90", "rms", "diverged")


def _poisson(unit, replicates: int):
    """Poisson(1) counts of every unit in every replicate, by hash; replicate 0 counts each unit once."""
    import numpy as np

    with np.errstate(over="ignore"):
        z = unit.astype(np.uint64)[:, None] + np.arange(replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    steps = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(12)])
    w = np.zeros(u.shape, np.uint8)
    for step in steps:  # quicker than a binary search in twelve steps
        w += (u > step).view(np.uint8)
    w = w.astype(float)
    w[:, 0] = 1.0
    return w


def detection_floor(stations: DataFrame, replicates: int = 2000, rounds: int = 25) -> DataFrame:
    """(cluster, replicate, crossing): where a logistic curve of caught on log displacement crosses one half.

    ``stations`` is (key_seed, station, offset, caught); replicate 0 is the whole table, others weigh every
    station, or every seed, by a Poisson count drawn from a hash.  All replicates are fitted together: each Newton
    step is one pass in which tasks return a few sums for each replicate, so no resample is ever written or moved.
    """
    import numpy as np

    unit = F.concat_ws(":", "key_seed", F.col("station").cast("string"))
    rows = stations.where("offset > 0 AND caught IS NOT NULL").select(
        F.xxhash64(F.lit(1), unit).alias("s"), F.xxhash64(F.lit(2), "key_seed").alias("k"), F.log("offset").alias("x"), F.col("caught").cast("double").alias("y"))
    rows = cut(rows.repartition(128), "floor-rows")  # every step reads them, and a row costs thousands of draws
    wide = replicates + 1
    beta = {c: np.zeros((wide, 2)) for c in ("station", "seed")}
    schema = "cluster string, sums array<double>"

    def sums_at(beta):
        def run(batches):
            import numpy as np

            total = {c: np.zeros((5, wide)) for c in beta}
            for batch in batches:
                s, k, x, y = (np.asarray(batch.column(c)) for c in range(4))
                order = np.argsort(k, kind="stable")
                s, k, x, y = s[order], k[order], x[order], y[order]
                for at in range(0, len(x), 32):
                    part = slice(at, at + 32)
                    xs = x[part]
                    powers = np.stack([np.ones_like(xs), xs, xs**2])
                    for c, key in (("station", s), ("seed", k)):
                        keys, back = np.unique(key[part], return_inverse=True)  # rows of a seed share their draws
                        w = _poisson(keys, replicates)[back]
                        p = 1 / (1 + np.exp(-np.clip(beta[c][:, 0] + xs[:, None] * beta[c][:, 1], -30, 30)))
                        # products with the powers of x are sums over the rows
                        total[c][:2] += powers[:2] @ (w * (y[part, None] - p))
                        total[c][2:] += powers @ (w * (p * (1 - p)))
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([t.ravel() for t in total.values()], pa.list_(pa.float64()))], ["cluster", "sums"])

        parts = rows.mapInArrow(run, schema).select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("v"))
        out = {c: np.zeros(5 * wide) for c in beta}
        found = parts.toArrow()  # five sums a replicate
        cluster, pos, v = (found.column(c).to_numpy() for c in ("cluster", "pos", "v"))
        for c in out:
            out[c][pos[cluster == c]] = v[cluster == c]
        return {c: v.reshape(5, wide) for c, v in out.items()}

    for _ in range(rounds):
        moved = 0.0
        for c, (g0, g1, h00, h01, h11) in sums_at(beta).items():
            b = beta[c]
            g0, g1, h00, h11 = g0 - 1e-6 * b[:, 0], g1 - 1e-6 * b[:, 1], h00 + 1e-6, h11 + 1e-6
            det = h00 * h11 - h01**2
            step = np.stack([(h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det], axis=1)
            step *= np.minimum(1, 5 / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-12))  # a long step may overshoot
            beta[c] = b + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-7:
            break
    out = [(c, k, float(np.exp(-b0 / b1)) if b1 > 1e-9 and -b0 / b1 < 700 else None) for c, b in beta.items() for k, (b0, b1) in enumerate(b)]
    return stations.sparkSession.createDataFrame(out, "cluster string, replicate int, crossing double")


def floor_interval(replicates: DataFrame) -> DataFrame:
    """(cluster, crossing, low, high, failed): the whole table's crossing, the middle 95 % of the replicates, and how many have none."""
    one = F.col("replicate") > 0
    drawn = F.percentile(F.when(one, F.col("crossing")), F.array(F.lit(0.025), F.lit(0.975)))
    g = replicates.groupBy("cluster").agg(F.max(F.when(~one, F.col("crossing"))).alias("crossing"), drawn.alias("q"), F.count_if(one & F.col("crossing").isNull()).alias("failed"))
    return g.select("cluster", "crossing", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "failed")
