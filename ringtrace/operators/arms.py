"""The detection floor by arm: claims on the road, stations of another run, regions, each read at a matched operating point."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learn as L, reports as R
from ..functions import scalars as S
from ..sources.io import cut

UNIT, CLAIM = ["key_seed", "key_claimedStationId", "key_window"], ["key_seed", "key_claimedStationId"]


def road_counts(units: DataFrame, halfwidth: float, ladder: list[int], label: str = "label_attackId") -> DataFrame:
    """One row: benign units and those off the road, constant-offset units and those off it, and their stations wholly on,
    wholly off and mixed.  A unit whose claim is null is on the road, as no map check rejects it."""
    off, bad = F.coalesce(F.abs("claimedY") > halfwidth, F.lit(False)), F.col(label).isin(*ladder)
    per = units.groupBy(*CLAIM).agg(F.count_if(F.col(label) == 0).alias("b"), F.count_if((F.col(label) == 0) & off).alias("bo"), F.count_if(bad).alias("c"), F.count_if(bad & off).alias("co"))
    n = F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("bo"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("co"), F.lit(0))
    mine = F.col("c") > 0
    return per.agg(*[c.alias(k) for c, k in zip(n, ("benign", "benign_off", "offset", "offset_off"))], F.count_if(mine & (F.col("co") == 0)).alias("stations_on"),
                   F.count_if(mine & (F.col("co") == F.col("c"))).alias("stations_off"), F.count_if(mine & (F.col("co") > 0) & (F.col("co") < F.col("c"))).alias("stations_mixed"))


def attach_offroad(det: DataFrame, units: DataFrame, halfwidth: float) -> DataFrame:
    """Station rates with ``off_share``, the share of the station's units that claim a place off the road, and ``kind``
    (on, off, mixed); stations without units keep nulls."""
    off = F.coalesce(F.abs("claimedY") > halfwidth, F.lit(False)).cast("int")
    per = units.groupBy(*CLAIM).agg(F.avg(off).alias("off_share"))
    kind = F.when(F.col("off_share") == 0, "on").when(F.col("off_share") == 1, "off").when(F.col("off_share").isNotNull(), "mixed")
    return det.join(per, CLAIM, "left").withColumn("kind", kind)


def borrow(own: DataFrame, other: DataFrame, most: float = 0.01) -> DataFrame:
    """Station rates of this run and, if both runs work at the same point, those of another one.

    Rows have an ``attack`` flag and a ``rate``; added are ``borrowed``, ``gap``, the difference of the mean benign rates,
    and ``refused``.  With a gap over ``most``, or no benign station on a side, nothing is borrowed.
    """
    benign = [df.agg(F.avg(F.when(~F.col("attack"), F.col("rate"))).alias("r")).first()["r"] for df in (own, other)]  # one number a side
    gap = None if None in benign else abs(benign[0] - benign[1])
    refused = gap is None or gap > most
    rows = own.withColumn("borrowed", F.lit(False))
    if not refused:
        rows = rows.unionByName(other.withColumn("borrowed", F.lit(True)))
    return rows.withColumn("gap", F.lit(gap).cast("double")).withColumn("refused", F.lit(refused))


def displacement_curve(det: DataFrame, offsets: DataFrame, edges: list[float], least: int, ladder: list[int], label: str = "label_attackId") -> DataFrame:
    """(band, stations, windows, rate, caught, benign_rate): constant-offset stations by displacement [lo, hi).

    A station is caught if most of its windows are flagged.  Bands with under ``least`` stations keep their sizes and
    have null rates; stations without an offset take no part.
    """
    att = det.where(F.col(label).isin(*ladder)).join(offsets.select(*CLAIM, "offset").dropDuplicates(CLAIM), CLAIM).where("offset IS NOT NULL")
    benign = det.agg(F.avg(F.when(F.col(label) == 0, F.col("rate"))).alias("benign_rate"))
    g = att.groupBy(S.digitize("offset", edges).alias("band")).agg(F.count("*").alias("stations"), F.sum("windows").alias("windows"), F.avg("rate").alias("rate"), F.avg((F.col("rate") > 0.5).cast("int")).alias("caught"))
    enough = F.col("stations") >= least
    return g.crossJoin(benign).select("band", "stations", "windows", *[F.when(enough, F.col(c)).alias(c) for c in ("rate", "caught")], "benign_rate")  # one row


def benign_rate(scored: DataFrame, t: float) -> float | None:
    """Mean over benign stations of the share of windows over the threshold."""
    return R.flag_rates(scored.where("label_attackId = 0"), CLAIM, t).agg(F.avg("rate")).first()[0]


def curves(arms: dict[str, tuple[DataFrame, float]], offsets: DataFrame, edges: list[float], least: int, ladder: list[int]) -> DataFrame:
    """The displacement curve of every arm: its scored units (``CLAIM``, label_attackId, score) and its threshold."""
    parts = []
    for name, (rows, t) in arms.items():
        det = R.flag_rates(rows, [*CLAIM, "label_attackId"], t)
        parts.append(displacement_curve(det, offsets, edges, least, ladder).select(F.lit(name).alias("arm"), F.lit(float(t)).alias("threshold"), "*"))
    return reduce(DataFrame.unionByName, parts)


def matched(scored: DataFrame, target: float | None) -> float:
    """Smallest threshold at which the mean benign station is flagged at most ``target``; infinity if there is none."""
    found = R.matched_threshold(scored.where("label_attackId = 0"), CLAIM, target or 0.0).first()["threshold"]
    return float("inf") if found is None else float(found)


def onroad_arms(units: DataFrame, offsets: DataFrame, cols: list[str], halfwidth: float, edges: list[float], least: int, ladder: list[int], k: int = 5, model=None) -> DataFrame:
    """Four curves on out-of-fold scores with folds by transmitter: all claims; a map check first, so off-road attack units
    neither train nor count, at the detector's own point and at the benign rate of the first; all claims trained, on-road
    ones scored.  ``units`` has ``UNIT``, label_txNodeId, label_attackId, claimedY and ``cols``."""
    road = ~(F.coalesce(F.abs("claimedY") > halfwidth, F.lit(False)) & (F.col("label_attackId") != 0))

    def scored(rows: DataFrame, name: str) -> DataFrame:
        out = L.out_of_fold(rows, cols, "label_attackId", "label_txNodeId", k, [*UNIT, "claimedY"], model=model)
        chance = 1 - F.coalesce(F.try_element_at("chances", F.lit(0)), F.lit(0.0))
        return cut(out.select(*UNIT, "claimedY", F.col("y").alias("label_attackId"), chance.alias("score")), name)

    full, kept = scored(units, "arm-full"), scored(units.where(road), "arm-road")
    return curves({"all claims": (full, 0.5), "map check first": (kept, 0.5), "map check first, matched": (kept, matched(kept, benign_rate(full, 0.5))), "scored on road": (full.where(road), 0.5)},
                  offsets, edges, least, ladder)


def region_curves(scored: DataFrame, target: float, offsets: DataFrame, units: DataFrame, halfwidth: float, edges: list[float], least: int, ladder: list[int]) -> DataFrame:
    """Curves of one region alone and of any region (the largest score of a station's window), each at its own threshold of
    0.5 and matched to ``target``, the matched ones also without stations that claim places off the road.

    ``scored`` has ``UNIT``, label_attackId and score, a row a region; ``units`` the claims.
    """
    off = attach_offroad(units.select(*CLAIM).distinct(), units, halfwidth).where("off_share > 0").select(*CLAIM)
    arms = {}
    for rule, rows in (("per region", scored), ("any region", cut(R.any_region(scored, [*UNIT, "label_attackId"]), "any-region"))):
        t = matched(rows, target)
        arms |= {f"{rule}": (rows, 0.5), f"{rule}, matched": (rows, t), f"{rule}, matched, on road": (rows.join(off, CLAIM, "left_anti"), t)}
    return curves(arms, offsets, edges, least, ladder)
