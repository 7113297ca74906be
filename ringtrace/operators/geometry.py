"""Pooled geometry: positions per window, propagation fits, position information and adversaries.

Fits are closed forms of grouped sums with map-side combine; only constant-size results (a law, a
correction curve) reach the driver, as literals for the next step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.io import cut
from .quantiles import exact_quantiles, quantile_numbers, with_quantiles

TRIPLE = ["key_seed", "key_claimedStationId", "key_window"]
WRAP_SPAN_M, MIN_OBS = 1000.0, 5
#: Range bins of the calibrated correction, in metres.
EDGES = [0.0, 60.0, 100.0, 200.0, 400.0, 700.0, 1000.0, 1500.0, 1e9]


def window_mean(df: DataFrame, keys: list[str], cols: list[str], xcol: str) -> tuple[DataFrame, DataFrame]:
    """Mean positions per key, and how many keys were dropped because their x spans more than a window allows."""
    g = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols], (F.max(xcol) - F.min(xcol)).alias("__span"))
    return g.where(F.col("__span") <= WRAP_SPAN_M).drop("__span"), g.agg(F.count_if(F.col("__span") > WRAP_SPAN_M).alias("dropped"))


def attach_geometry(corpus: DataFrame, observers: DataFrame, claims: DataFrame) -> DataFrame:
    """Corpus rows with the observer's position and the claim of the window; rows without either go."""
    return corpus.join(observers, ["key_seed", "key_rxNodeId", "key_window"]).join(claims, TRIPLE)


def require_every_seed(df: DataFrame, seeds: list[str]) -> DataFrame:
    """Fails if a requested seed has no row left."""
    wanted = df.sparkSession.createDataFrame([(s,) for s in seeds], "key_seed string")
    lost = [r[0] for r in wanted.join(df.select("key_seed").distinct(), "key_seed", "left_anti").collect()]
    if lost:
        raise ValueError(f"no rows left for seeds {sorted(lost)}")
    return df


def nearest_region(obs: DataFrame, rsu: DataFrame, x: str = "rxX", y: str = "rxY") -> DataFrame:
    """Adds ``key_region``: number of the nearest roadside unit of the seed, units numbered by node id.

    The units of a seed are a short list joined once, so rows are not multiplied.
    """
    lists = rsu.groupBy("key_seed").agg(F.sort_array(F.collect_list(F.struct("nodeId", F.col("x"), F.col("y")))).alias("__units"))
    away = F.transform("__units", lambda u, k: F.struct(F.hypot(u["x"] - F.col(x), u["y"] - F.col(y)).alias("d"), k.alias("k")))
    return obs.join(lists, "key_seed").withColumn("key_region", F.array_min(away)["k"]).drop("__units")


def having_min(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of keys with at least ``n`` rows."""
    return df.join(df.groupBy(*keys).count().where(F.col("count") >= n).select(*keys), keys, "left_semi")


def permute_claims(units: DataFrame) -> DataFrame:
    """Every station of a (seed, window) with the claim of another one, never its own; lone stations go."""
    group = Window.partitionBy("key_seed", "key_window")
    base = units.withColumn("n", F.count("*").over(group)).withColumn("i", F.row_number().over(group.orderBy("key_claimedStationId")) - 1)
    base = base.where("n > 1")
    shift = F.expr("1 + ((key_window * 2654435761) % 4294967296) % (n - 1)")
    other = base.select("key_seed", "key_window", F.col("i").alias("j"), F.col("claimedX").alias("newX"), F.col("claimedY").alias("newY"))
    return base.withColumn("j", ((F.col("i") + shift) % F.col("n")).cast("int")).join(other, ["key_seed", "key_window", "j"]).drop("n", "i", "j")


def _range(cx, cy) -> Column:
    return S.at_least(F.hypot(F.col("rxX") - S._c(cx), F.col("rxY") - S._c(cy)), 1.0)


def claim_fit(units: DataFrame, keys: list[str] = TRIPLE, cx="claimedX", cy="claimedY", power="phy_rsrp_mean", least: int = MIN_OBS) -> DataFrame:
    """Exponent, intercept, RMSE, R2 of power on -10 log10(range to the claim), from one pass of sums."""
    rows = units.where(S._c(power).isNotNull()).select(*keys, S._c(power).alias("y"), (-10 * F.log10(_range(cx, cy))).alias("l"))
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), F.covar_pop("y", "l").alias("c"), F.var_pop("l").alias("vl"), F.var_pop("y").alias("vy"),
        F.avg("y").alias("my"), F.avg("l").alias("ml"))
    slope = F.try_divide("c", "vl")
    left = S.at_least(F.col("vy") - F.coalesce(slope * F.col("c"), F.lit(0.0)), 0.0)
    return g.where(F.col("n_obs") >= least).select(
        *keys, "n_obs", slope.alias("claim_exp"), (F.col("my") - slope * F.col("ml")).alias("claim_a"), F.sqrt(left).alias("claim_rmse"),
        F.when(F.col("vy") > 0, 1 - left / F.col("vy")).otherwise(0.0).alias("claim_r2"))


def residual_range_corr(units: DataFrame, fitted: DataFrame) -> DataFrame:
    """Correlation of the claim's residual with log range; 0 where undefined."""
    rows = units.join(fitted, TRIPLE).withColumn("l", 10 * F.log10(_range("claimedX", "claimedY")))
    rows = rows.withColumn("r", F.col("phy_rsrp_mean") - F.col("claim_a") + F.col("claim_exp") * F.col("l"))
    return rows.groupBy(*TRIPLE).agg(F.covar_pop("l", "r").alias("c"), F.stddev_pop("l").alias("a"), F.stddev_pop("r").alias("b")).select(
        *TRIPLE, F.coalesce(F.try_divide(F.col("c"), F.col("a") * F.col("b")), F.lit(0.0)).alias("claim_range_corr"))


def fit_law(df: DataFrame, d: Column, power: str = "phy_rsrp_mean") -> tuple[float, float]:
    """(A, n) of power = A - 10 n log10(d) over all rows: two numbers."""
    l = -10 * F.log10(S.at_least(d, 1.0))
    row = df.where(F.col(power).isNotNull()).agg(F.regr_intercept(F.col(power), l).alias("a"), F.regr_slope(F.col(power), l).alias("n")).first()
    return row["a"], row["n"]


def law_residual(df: DataFrame, d: Column, law: tuple[float, float]) -> DataFrame:
    return df.withColumn("d", d).withColumn("resid", F.col("phy_rsrp_mean") - (law[0] - 10 * law[1] * F.log10(S.at_least(F.col("d"), 1.0))))


def range_bin(d) -> Column:
    return F.least(F.lit(len(EDGES) - 2), F.greatest(F.lit(0), S.digitize(d, EDGES) - 1))


def calibrate(df: DataFrame, least: int = 200) -> DataFrame:
    """(bin, n, mu, sd) of the residual in each range bin; thin bins get 0 and the median spread."""
    g = df.groupBy(range_bin("d").alias("bin")).agg(F.count("*").alias("n"), F.avg("resid").alias("mu0"), F.stddev_pop("resid").alias("sd0"))
    ok = F.col("n") > least
    med = g.agg(F.percentile(F.when(ok, F.col("sd0")), F.lit(0.5)).alias("m")).first()["m"]
    med = F.lit(med).cast("double")
    return g.select("bin", "n", F.when(ok, F.col("mu0")).otherwise(0.0).alias("mu"),
                    F.greatest(F.coalesce(F.when(ok, F.col("sd0")), med), med * 0.5).alias("sd"))


def pick(d, curve: dict[int, float]) -> Column:
    """The correction at a range: a few literals."""
    out = F.when(F.lit(False), F.lit(0.0))
    for b, v in sorted(curve.items()):
        out = out.when(range_bin(d) == b, F.lit(v))
    return out.otherwise(0.0)


def curve_of(calibrated: DataFrame) -> dict[int, float]:
    return {r["bin"]: r["mu"] for r in calibrated.collect()}  # at most eight bins


def fit_law_curved(df: DataFrame) -> list[float]:
    """Coefficients of the residual on 1, L, L^2, L^3 with L = log10(d): power sums, then a 4 x 4 system."""
    import numpy as np

    l = F.log10(S.at_least(F.col("d"), 1.0))
    row = df.agg(*[F.sum(F.pow(l, k)).alias(f"s{k}") for k in range(7)], *[F.sum(F.pow(l, k) * F.col("resid")).alias(f"t{k}") for k in range(4)]).first()
    gram = np.array([[row[f"s{i + j}"] for j in range(4)] for i in range(4)])
    return np.linalg.lstsq(gram, np.array([row[f"t{k}"] for k in range(4)]), rcond=None)[0].tolist()


def variance_split(df: DataFrame, link: list[str]) -> DataFrame:
    """Residual spread within links and between them, over links with three or more rows."""
    g = df.groupBy(*link).agg(F.avg("resid").alias("m"), F.var_samp("resid").alias("v"), F.count("*").alias("n")).where("n >= 3")
    raw = F.var_pop("m") - F.avg(F.col("v") / F.col("n"))
    return g.agg(F.sqrt(F.avg("v")).alias("within"), F.sqrt(S.at_least(raw, 0.0)).alias("between"), F.count("*").alias("links"))


def ambiguity(df: DataFrame, between: float, n_exp: float, qs=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """What the persistent floor is worth in metres at quantiles of the link distance."""
    names = {f"q{k}": ("d", q) for k, q in enumerate(qs)}
    at = exact_quantiles(df, [], {"d": F.col("d")}, names).select(F.array(*names).alias("p"))
    ratio = 10.0 ** (between / (10.0 * n_exp)) - 1.0
    return at.select(F.posexplode("p").alias("k", "distance")).select(
        F.get(F.array(*[F.lit(q) for q in qs]), F.col("k")).alias("q"), "distance", (F.col("distance") * ratio).alias("ambiguity"))


def position_bound(units: DataFrame, n_exp: float, sigma: float, keys: list[str] = TRIPLE, px="trueX", py="trueY", least: int = MIN_OBS) -> DataFrame:
    """Position error bound per unit, intercept and exponent eliminated (``known`` columns: not eliminated)."""
    dx, dy = F.col(px) - F.col("rxX"), F.col(py) - F.col("rxY")
    d = S.at_least(F.hypot(dx, dy), 1.0)
    k = F.lit(-10.0 * n_exp / math.log(10.0)) / d
    rows = units.select(*keys, (k * dx / d).alias("a"), (k * dy / d).alias("b"), (10 * F.log10(d)).alias("l"))
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), *[F.covar_pop(x, y).alias(x + y) for x, y in ("aa", "ab", "bb", "al", "bl", "ll")],
        F.sum(F.col("a") * F.col("a")).alias("kaa"), F.sum(F.col("a") * F.col("b")).alias("kab"), F.sum(F.col("b") * F.col("b")).alias("kbb"))

    def rest(xy: str, xl: str, yl: str) -> Column:
        return F.col("n_obs") * (F.col(xy) - F.try_divide(F.col(xl) * F.col(yl), F.col("ll")))

    g = g.where(F.col("n_obs") >= least).select(
        *keys, "n_obs", rest("aa", "al", "al").alias("j11"), rest("ab", "al", "bl").alias("j12"), rest("bb", "bl", "bl").alias("j22"), "kaa", "kab", "kbb")
    det = F.col("j11") * F.col("j22") - F.col("j12") * F.col("j12")
    half, gap = (F.col("j11") + F.col("j22")) / 2, F.hypot((F.col("j11") - F.col("j22")) / 2, F.col("j12"))
    khalf, kgap = (F.col("kaa") + F.col("kbb")) / 2, F.hypot((F.col("kaa") - F.col("kbb")) / 2, F.col("kab"))
    ok = (F.col("j11") > 0) & (F.col("j22") > 0) & (det > 0)
    return g.where(ok).select(
        *keys, "n_obs", (sigma * F.sqrt(F.col("j22") / det)).alias("free_along"), (sigma * F.sqrt(F.col("j11") / det)).alias("free_across"),
        (sigma / F.sqrt(F.col("j11"))).alias("road_along"), (sigma / F.sqrt(det / (half + gap))).alias("major"), (sigma / F.sqrt(half + gap)).alias("minor"),
        (90 - F.abs(F.degrees(F.atan2(2 * F.col("j12"), F.col("j11") - F.col("j22"))) / 2)).alias("angle"),
        (sigma / F.sqrt(khalf - kgap)).alias("major_known"))


def bound_summary(bounds: DataFrame) -> DataFrame:
    """Medians, anisotropy (median across over median along) and root mean squares of the bounds by number of
    receivers; ``rms_trim`` leaves out units over the 99th percentile of their bin."""
    label = F.when(F.col("n_obs") < 10, "5 to 9").when(F.col("n_obs") < 25, "10 to 24").when(F.col("n_obs") < 85, "25 to 84").otherwise("85 or more")
    rows = bounds.select(label.alias("receivers"), "free_across", "free_along", "road_along", (F.col("free_along") ** 2 + F.col("free_across") ** 2).alias("trace"))
    rows = cut(rows, "bounds")
    values = {c: F.col(c) for c in ("free_across", "free_along", "road_along", "trace")}
    tops = exact_quantiles(rows, ["receivers"], values, {"across": ("free_across", 0.5), "along": ("free_along", 0.5), "road": ("road_along", 0.5), "top": ("trace", 0.99)})  # a row a bin
    return rows.join(tops, "receivers").groupBy("receivers").agg(
        F.count("*").alias("units"), F.max("across").alias("across"), F.max("along").alias("along"), F.try_divide(F.max("across"), F.max("along")).alias("anisotropy"),
        F.max("road").alias("road"), F.sqrt(F.avg("trace")).alias("rms"), F.sqrt(F.avg(F.when(F.col("trace") <= F.col("top"), F.col("trace")))).alias("rms_trim"))


def placement_sweep(units: DataFrame, offsets: list[float], is_rsu: Column, n_exp: float, sigma: float) -> DataFrame:
    """The bound with roadside units moved to either side of the road by each offset, sides by node parity."""
    each = units.withColumn("move", F.explode(F.array(*[F.lit(float(o)) for o in offsets])))
    side = F.when(F.col("rxNodeId") % 8 < 4, F.col("move")).otherwise(-F.col("move"))
    return position_bound(each.withColumn("rxY", F.when(is_rsu, side).otherwise(F.col("rxY"))), n_exp, sigma, ["move", *TRIPLE])


def power_evasion(units: DataFrame, law: tuple[float, float]) -> DataFrame:
    """Statistics of each unit under no, global and targeted constant power shifts.

    The targeted receiver is the one with the smallest node id.
    """
    pred = law[0] - 10 * law[1] * F.log10(_range("claimedX", "claimedY"))
    rows = units.withColumn("pred", pred)
    aim = rows.groupBy(*TRIPLE).agg(F.avg(F.col("pred") - F.col("phy_rsrp_mean")).alias("all"),
                                    F.min(F.struct("rxNodeId", "rxX", (F.col("pred") - F.col("phy_rsrp_mean")).alias("gap"))).alias("one"))
    fit = claim_fit(units)
    # a constant shift moves the intercept only, so the pooled fit is the same for all three
    arm = F.explode(F.array(*[F.struct(F.lit(n).alias("adversary"), s.alias("shift")) for n, s in (("none", F.lit(0.0)), ("power-global", F.col("all")), ("power-targeted", F.col("one.gap")))]))
    return fit.join(aim, TRIPLE).withColumn("arm", arm).select(
        *TRIPLE, "arm.adversary", F.abs(F.col("one.gap") - F.col("arm.shift")).alias("single_resid"),
        F.col("claim_rmse").alias("pooled_rmse"), F.abs(F.col("claim_exp") - law[1]).alias("pooled_exp_dev"))


#: Receivers of a unit from which it is not summed in one task, and rows of which the matrices of directions are held at once.
HOT_UNIT, CHUNK = 200_000, 1024


def best_response(units: DataFrame, levels: list[float], angles: int = 72, lateral: float | None = None, least: int = MIN_OBS, hot: int = HOT_UNIT) -> DataFrame:
    """Smallest pooled RMSE of a lie of each length over all directions, the direction it lies in, its angle from
    the road, and how many directions leave the road.

    Receivers move once, by unit.  Where they are, each gives a row of a matrix over lengths and directions, whose sums a unit
    are the closed form of its fits; nothing is unfolded.  Units of over ``hot`` receivers are unfolded and summed
    where their rows lie, before any exchange.  A unit has one true place.  Units of fewer than ``least`` receivers with
    power have no row; where all directions leave the road the best is null.
    """
    rows = units.where("phy_rsrp_mean IS NOT NULL AND rxX IS NOT NULL AND rxY IS NOT NULL AND trueX IS NOT NULL AND trueY IS NOT NULL")
    rows = rows.select(*TRIPLE, *[F.col(c).cast("double").alias(c) for c in ("rxX", "rxY", "trueX", "trueY", "phy_rsrp_mean")])
    large = cut(rows.groupBy(*TRIPLE).count().where(F.col("count") > hot).select(*TRIPLE), "hot-units")
    found = _response_sums(rows.join(large, TRIPLE, "left_anti"), levels, angles, lateral, least)
    if not large.isEmpty():
        found = found.union(_response_unfolded(rows.join(large, TRIPLE, "left_semi"), levels, angles, lateral, least))
    degrees = F.col("step") * (360.0 / angles)
    return found.select(*TRIPLE, "level", "best_rmse", degrees.alias("direction"),
                        F.least(F.pmod(degrees, F.lit(180.0)), 180.0 - F.pmod(degrees, F.lit(180.0))).alias("off_axis"), "blocked")


def _response_unfolded(rows: DataFrame, levels: list[float], angles: int, lateral: float | None, least: int) -> DataFrame:
    """(unit, level, best_rmse, step, blocked) by unfolding all lies of each receiver, with partial sums before the exchange."""
    rows = rows.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(angles - 1)))).withColumn("th", F.col("step") * (2 * math.pi / angles))
    rows = rows.withColumn("claimedX", F.col("trueX") + F.col("level") * F.cos("th")).withColumn("claimedY", F.col("trueY") + F.col("level") * F.sin("th"))
    off = F.lit(False) if lateral is None else F.abs(F.col("claimedY")) > lateral
    fits = claim_fit(rows.withColumn("off", off), [*TRIPLE, "level", "step", "off"], least=least)
    # equal to a millionth of a decibel: the smaller direction
    best = F.min(F.when(~F.col("off"), F.struct(F.round("claim_rmse", 6).alias("rmse"), "step")))
    g = fits.groupBy(*TRIPLE, "level").agg(best.alias("b"), F.count_if(F.col("off")).alias("blocked"))
    return g.select(*TRIPLE, "level", F.col("b.rmse").alias("best_rmse"), "b.step", "blocked")


def _response_sums(rows: DataFrame, levels: list[float], angles: int, lateral: float | None, least: int) -> DataFrame:
    """The same by matrices (receivers x lies), a chunk at a time, from rows that lie sorted by unit."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        th = np.arange(angles) * (2 * math.pi / angles)
        length = np.repeat(np.array(levels, float), angles)
        east, north = length * np.tile(np.cos(th), len(levels)), length * np.tile(np.sin(th), len(levels))

        def sums(x, y, tx, ty, power, starts):
            dist = np.hypot(x[:, None] - tx[:, None] - east, y[:, None] - ty[:, None] - north)
            l = -10 * np.log10(np.maximum(dist, 1.0))
            cols = [np.ones(len(x))[:, None], power[:, None], (power**2)[:, None], l, l * l, l * power[:, None]]
            return np.concatenate([np.add.reduceat(c, starts, axis=0) for c in cols], axis=1)

        def solved(keys, places, total):
            """Best lies of finished units: ``total`` has a row a unit."""
            n, width = total[:, :1], len(length)
            keep = n[:, 0] >= least
            keys, places, total, n = [k[keep] for k in keys], places[keep], total[keep], n[keep]
            if not len(n):
                return None
            my, ml = total[:, 1:2] / n, total[:, 3 : 3 + width] / n
            vy = total[:, 2:3] / n - my * my
            vl, c = total[:, 3 + width : 3 + 2 * width] / n - ml * ml, total[:, 3 + 2 * width :] / n - my * ml
            slope = np.divide(c, vl, out=np.zeros_like(c), where=vl > 1e-12)
            rmse = np.floor(np.sqrt(np.maximum(vy - slope * c, 0.0)) * 1e6 + 0.5) / 1e6  # equal to a millionth: the smaller direction
            off = np.zeros(rmse.shape, bool) if lateral is None else np.abs(places[:, 1:2] + north) > lateral
            rmse = np.where(off, np.inf, rmse).reshape(len(n), len(levels), angles)
            step = rmse.argmin(axis=2)
            best = rmse.min(axis=2)
            cols = [pa.array(np.repeat(k, len(levels)), t) for k, t in zip(keys, kinds)]
            none = np.isinf(best).ravel()
            cols += [pa.array(np.tile(np.array(levels, float), len(n))), pa.array(best.ravel(), mask=none), pa.array(step.ravel().astype(np.int32), mask=none)]
            return pa.RecordBatch.from_arrays([*cols, pa.array(off.reshape(rmse.shape).sum(axis=2).ravel().astype(np.int64))], out)

        held = None  # the unit that may go on: keys, place, sums
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in range(3)]
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                keys = [part.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
                x, y, tx, ty, power = (part.column(k).to_numpy(zero_copy_only=False) for k in range(3, 8))
                new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
                starts = np.flatnonzero(new)
                total = sums(x, y, tx, ty, power, starts)
                heads, places = [k[starts] for k in keys], np.stack([tx, ty], axis=1)[starts]
                if held is not None:
                    if all(h[0] == k[0] for h, k in zip(held[0], heads)):
                        total[0] += held[2][0]
                        places[0] = held[1][0]
                    elif (done := solved(*held)) is not None:
                        yield done
                if len(starts) > 1 and (done := solved([k[:-1] for k in heads], places[:-1], total[:-1])) is not None:
                    yield done
                held = ([k[-1:] for k in heads], places[-1:], total[-1:])
        if held is not None and (done := solved(*held)) is not None:
            yield done

    out = [*TRIPLE, "level", "best_rmse", "step", "blocked"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in TRIPLE) + ", level double, best_rmse double, step int, blocked long"
    return rows.repartition(*TRIPLE).sortWithinPartitions(*TRIPLE).mapInArrow(run, schema)


def toward_estimate(lies: DataFrame, truth: DataFrame, estimates: DataFrame) -> DataFrame:
    """``lies`` of ``best_response`` with the distance of the best claim, and of the truth, to the unit's estimated position.

    Units without an estimate, or without a claim on the road, keep null distances.
    """
    j = lies.join(truth.select(*TRIPLE, "trueX", "trueY"), TRIPLE).join(estimates.select(*TRIPLE, "estX", "estY"), TRIPLE, "left")
    th = F.radians("direction")
    x, y = F.col("trueX") + F.col("level") * F.cos(th), F.col("trueY") + F.col("level") * F.sin(th)
    return j.select(*TRIPLE, "level", "direction", F.hypot(x - F.col("estX"), y - F.col("estY")).alias("claim_to_estimate"),
                    F.hypot(F.col("trueX") - F.col("estX"), F.col("trueY") - F.col("estY")).alias("truth_to_estimate"))


def caught(honest: DataFrame, lies: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Share of lies over the honest 95th percentile, and outside the middle 95 % of honest values."""
    at = quantile_numbers(honest, {"v": F.col(value)}, {"low": ("v", 0.025), "top": ("v", 0.95), "high": ("v", 0.975)})
    v = F.col(value)
    return lies.groupBy(*by).agg(F.avg((v > at["top"]).cast("int")).alias("one_sided"), F.avg(((v < at["low"]) | (v > at["high"])).cast("int")).alias("two_sided"))


def transfer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Residual spread of ``b`` raw, under its own correction and under that of ``a``."""
    own, other = curve_of(calibrate(b)), curve_of(calibrate(a))
    s = b.agg(F.stddev_pop("resid").alias("base"), F.stddev_pop(F.col("resid") - pick("d", own)).alias("own"),
              F.stddev_pop(F.col("resid") - pick("d", other)).alias("transferred"))
    return s.withColumn("share", F.try_divide(F.col("base") - F.col("transferred"), F.col("base") - F.col("own")))


def confounding(a: DataFrame, least: int = 500) -> DataFrame:
    """Slope and t of the residual on the along-road position, for each range bin."""
    x = F.col("trueX") / 1000.0
    g = a.groupBy(range_bin("d").alias("bin")).agg(
        F.count("*").alias("n"), F.regr_slope(F.col("resid"), x).alias("slope"), F.regr_sxx(F.col("resid"), x).alias("sxx"),
        F.regr_syy(F.col("resid"), x).alias("syy"), (F.max(x) - F.min(x)).alias("reach")).where(F.col("n") >= least)
    se = F.sqrt((F.col("syy") - F.col("slope") ** 2 * F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    return g.select("bin", "n", "slope", F.try_divide(F.col("slope"), se).alias("t"), (F.abs("slope") * F.col("reach")).alias("spread"))


def surface(unit: DataFrame, reach: int, step: int) -> DataFrame:
    """Pooled RMSE of one unit for claims on a grid around the truth."""
    xs = F.explode(F.sequence(F.lit(-reach), F.lit(reach), F.lit(step)))
    rows = unit.repartition(*TRIPLE).withColumn("gx", xs).withColumn("gy", F.explode(F.sequence(F.lit(-reach), F.lit(reach), F.lit(step))))
    rows = rows.withColumn("claimedX", F.col("trueX") + F.col("gx")).withColumn("claimedY", F.col("trueY") + F.col("gy"))
    return claim_fit(rows, [*TRIPLE, "gx", "gy"]).select(*TRIPLE, "gx", "gy", "claim_rmse", "claim_exp")


def pool_means(units: DataFrame, features: list[str], keys: list[str] = TRIPLE) -> DataFrame:
    """Means of all features over the receivers of a unit, and the row of one receiver picked by hash."""
    pick_one = F.min(F.struct(F.expr("(rxNodeId * 2654435761) % 4294967296").alias("h"), "rxNodeId", *features))
    g = units.groupBy(*keys).agg(F.count("*").alias("n_recv"), *[F.avg(f).alias(f"pm_{f}") for f in features], pick_one.alias("one"))
    return g.select(*keys, "n_recv", *[f"pm_{f}" for f in features], *[F.col(f"one.{f}").alias(f"one_{f}") for f in ["rxNodeId", *features]])


def localisation_check(fits: DataFrame, truth: DataFrame) -> DataFrame:
    """Error of estimated positions against the truth, by class; for evaluation only."""
    j = fits.join(truth, TRIPLE).withColumn("err", F.hypot(F.col("estX") - F.col("trueX"), F.col("estY") - F.col("trueY")))
    j = cut(j.select("label", "err"), "localisation")
    return with_quantiles(j.groupBy("label").agg(F.count("*").alias("n")), j, ["label"], {"e": F.col("err")}, {"median": ("e", 0.5), "p90": ("e", 0.9)})
