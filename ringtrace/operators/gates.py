"""Dataset integrity gates: each returns rows of figures, or (check, ok, detail) verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import partition as P
from .asof import gaps
from .quantiles import quantile_numbers


#: Codes of the constant, small and medium position offsets.
POSITION = [1, 11, 13]


def step_of(name: str) -> float:
    """The precision a measurement carries, by the words in its name."""
    if any(w in name for w in ("rsrp", "sinr", "tbler")):
        return 1.0
    if "iat" in name:
        return 0.001
    if any(w in name for w in ("dist", "predict", "dmv")):
        return 1.0
    if any(w in name for w in ("speed", "ssc", "accel")):
        return 0.1
    return 1.0 if "heading" in name else 0.01


def quantise(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.rint(F.col(f) / step_of(f)) * step_of(f) for f in features})


def gate_duplicates(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows and distinct vectors at measurement precision, per class and (class null) overall."""
    q = quantise(df, features).select(label, F.xxhash64(*features).alias("h"))
    per = q.groupBy(label, "h").agg(F.count("*").alias("n"))
    each = per.groupBy(label).agg(F.sum("n").alias("rows"), F.count("*").alias("distinct"))
    whole = per.groupBy("h").agg(F.sum("n").alias("n")).agg(F.lit(None).cast("int").alias(label), F.sum("n").alias("rows"), F.count("*").alias("distinct"))
    return each.unionByName(whole).withColumn("duplicates", 1 - F.col("distinct") / F.col("rows"))


def gate_variation(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """How many features are effectively constant in each class."""
    flat = [F.coalesce(F.abs(F.try_divide(F.stddev_samp(f), F.abs(F.avg(f)))), F.lit(0.0)) < 0.01 for f in features]
    return df.groupBy(label).agg(reduce(lambda a, b: a + b, [c.cast("int") for c in flat]).alias("flat"))


def gate_overlap(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """Share of quantised test rows that occur in training."""
    tr = quantise(train, features).select(*features).distinct().withColumn("hit", F.lit(1))
    return quantise(test, features).join(tr, features, "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("overlap"))


def gate_range(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Share of other rows outside a class's range, for every feature and class but the benign."""
    lim = df.groupBy(label).agg(*[F.struct(F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f) for f in features])
    lists = {r[label]: r for r in lim.collect()}  # a row a class
    rows = df.agg(*[F.avg(F.when(F.col(label) != c, ((F.col(f) < r[f]["lo"]) | (F.col(f) > r[f]["hi"])).cast("int"))).alias(f"{f}|{c}") for c, r in lists.items() if c != 0 for f in features])
    out = rows.unpivot([], rows.columns, "k", "outside")
    return out.select(F.substring_index("k", "|", 1).alias("feature"), F.substring_index("k", "|", -1).cast("int").alias("class"), "outside")


def gate_dead(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Features with at most one value on benign rows; min and max decide, so nothing is counted apart."""
    row = df.where(F.col(label) == 0).agg(*[F.coalesce(F.min(f) == F.max(f), F.lit(True)).alias(f) for f in features])
    return row.unpivot([], features, "feature", "dead").where("dead").select("feature")


def gate_balance(df: DataFrame, label: str, most: float = 0.9) -> DataFrame:
    g = df.groupBy(label).agg(F.count("*").alias("n"))
    s = g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row a class
    return s.select(label, "share", (F.col("share") < most).alias("ok"))


def check_campaign(tx: DataFrame, stations: DataFrame, slice_ms: float = 60_000.0) -> DataFrame:
    """(check, ok, detail): roadside units present, CAM at least CPM, gaps not deterministic, errors not zero, attackers
    speak, headings err by a degree at least, most position attackers lie, magnitude bands do not overlap.

    A message lies beyond the largest benign error; the band of a class is its range of station medians of lies.
    """
    err = F.hypot(F.col("claimedX") - F.col("trueX"), F.col("claimedY") - F.col("trueY"))
    turn = F.abs(F.pmod(F.col("claimedHeading") - F.col("trueHeading") + 180.0, F.lit(360.0)) - 180.0)
    p95 = quantile_numbers(tx, {"e": F.when(F.col("attackId") == 0, err)}, {"p95": ("e", 0.95)})["p95"] or 0.0
    e = tx.agg(F.max(F.when(F.col("attackId") == 0, turn)).alias("turn"),
               F.count_if(F.col("msgType") == 2).alias("cam"), F.count_if(F.col("msgType") == 14).alias("cpm"), F.count_if(F.col("attackId") > 0).alias("attack"),
               F.max(F.when(F.col("attackId") == 0, err)).alias("err")).first()
    rsu = stations.where("role = 'rsu'").count()
    kinds = gaps(tx, ["txNodeId"], "txTimeMs", slice_ms, ["msgUid"]).agg(F.count_distinct("gap").alias("n")).first()["n"]
    lying = tx.where(F.col("attackId").isin(*POSITION)).groupBy("attackId", "txNodeId").agg(
        F.percentile(err, F.lit(0.99)).alias("top"), F.percentile(F.when(err > (e["err"] or 0.0), err), F.lit(0.5)).alias("lie"))
    bands = {r["attackId"]: r for r in lying.groupBy("attackId").agg(
        F.count("*").alias("n"), F.count_if(F.col("top") < p95).alias("silent"), F.min("lie").alias("lo"), F.max("lie").alias("hi")).collect()}  # a row a class
    n, silent = sum(r["n"] for r in bands.values()), sum(r["silent"] for r in bands.values())
    small, medium = (bands.get(c) for c in POSITION[1:])
    apart = not (small and medium and small["hi"] is not None and medium["lo"] is not None) or small["hi"] <= medium["lo"]
    rows = [("rsu", rsu > 0, str(rsu)), ("cpm", e["cpm"] <= e["cam"], f"{e['cpm']} of {e['cam']}"), ("gaps", kinds > 3, str(kinds)),
            ("error", (e["err"] or 0) > 0, f"{e['err'] or 0:.3f}"), ("attackers", e["attack"] > 0, str(e["attack"])),
            ("heading", e["turn"] is None or e["turn"] >= 1.0, f"{e['turn'] or 0:.3f}"), ("silent", silent <= n / 2, f"{silent} of {n}"), ("bands", apart, str(len(bands)))]
    return tx.sparkSession.createDataFrame(rows, "check string, ok boolean, detail string")


def check_release(df: DataFrame, splits: DataFrame, declared: int, features: list[str]) -> DataFrame:
    """(check, ok): declared rows, schema, a partition for each row, no transmitter in two, every class in every part."""
    joined = P.attach_split(df, splits, P.STATION)
    cover = joined.where("split IS NOT NULL").groupBy("label_attackId").agg(F.count_distinct("split").alias("n")).agg(F.min("n")).first()[0]
    rows = [("rows", df.count() == declared), ("schema", P.feature_columns(df) == features), ("partition", joined.where("split IS NULL").limit(1).count() == 0),
            ("disjoint", P.multi(splits, P.STATION, "split").limit(1).count() == 0), ("coverage", cover == 3)]
    return df.sparkSession.createDataFrame([(n, bool(v)) for n, v in rows], "check string, ok boolean")


def leakage_alarm(metrics: DataFrame, limit: float = 0.9) -> DataFrame:
    return metrics.withColumn("alarm", F.col("macro_f1") >= limit)
