"""A release as a folder that stands alone: shards, schema, scenarios, splits, checksums; and the checks a reader makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import learn as L, partition as P, reports as R
from ..sources import io as IO

PARTS = ["train", "validation", "test"]
SPLITS = "key_seed string, label_txNodeId long, split string"
SCENARIOS = "scenario string, rows long, kind string"
SCHEMA = "name string, dtype string, is_feature boolean"
SUMS = "file string, sha256 string"


def tree_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha256, bytes) of all data files under a folder, named by their path in it; an empty file is not seen."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    top = F.lit("/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/")
    return files.select(F.element_at(F.split("path", top, 2), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def write_bundle(df: DataFrame, splits: DataFrame, declared: list[int], folder: str) -> str:
    """Shards by scenario and seed, the schema, scenarios with rows and kind, frozen splits, and checksums of it all.

    A scenario in which every declared class has a transmitter in every part is a benchmark, others are supplementary.
    """
    IO.write_shards(df, f"{folder}/data/shards")
    spark = df.sparkSession
    features = set(P.feature_columns(df))
    columns = [(f.name, f.dataType.simpleString(), f.name in features) for f in df.schema]
    spark.createDataFrame(columns, SCHEMA).coalesce(1).write.json(f"{folder}/data/schema")
    kinds = IO.scenario_kinds(P.attach_split(df, splits, P.STATION), declared).select("scenario", "rows", "kind")
    kinds.coalesce(1).write.json(f"{folder}/data/scenarios")
    splits.select(*P.STATION, "split").write.option("header", True).csv(f"{folder}/data/splits")
    tree_checksums(spark, f"{folder}/data").select("file", "sha256").write.json(f"{folder}/sums")
    return folder


def baseline(rows: DataFrame, features: list[str], model=None) -> DataFrame:
    """Metrics on the test part of a model fitted on the train part."""
    fitted = L.fit(rows.where("split = 'train'"), features, "label_attackId", model)
    return R.metrics(L.score(fitted, rows.where("split = 'test'"), features, [F.col("label_attackId").alias("y")]))


def check_bundle(spark: SparkSession, folder: str, schema: T.StructType, declared: list[int], published: float | None = None, tolerance: float = 0.10, subset: bool = False, model=None) -> DataFrame:
    """(check, ok, detail) of a bundle, from its files alone.

    Checksums (all files there, none changed; with ``subset`` files may be absent, whole scenarios too), declared
    scenarios and their rows, columns as the schema says, a part for every row, three parts, no transmitter in two,
    every declared class in every part of every benchmark scenario counted from the rows, and, where a figure is
    ``published``, macro F1 of a model trained on the first benchmark scenario within ``tolerance`` of it.
    """
    data = f"{folder}/data"
    state = {r["state"]: r["n"] for r in IO.verify_checksums(tree_checksums(spark, data), spark.read.schema(SUMS).json(f"{folder}/sums")).groupBy("state").agg(F.count("*").alias("n")).collect()}
    lost, changed = state.get("missing", 0), state.get("differs", 0)
    rows = [("files present", subset or lost == 0, f"{lost} missing"), ("checksums", changed == 0, f"{changed} differ")]

    splits = spark.read.schema(SPLITS).option("header", True).csv(f"{data}/splits")
    df = IO.cut(P.attach_split(IO.read_release(spark, f"{data}/shards", schema), splits, P.STATION), "bundle")
    scenarios = spark.read.schema(SCENARIOS).json(f"{data}/scenarios").collect()  # a row a scenario
    counts = {r["scenario"]: r for r in df.groupBy("scenario").agg(F.count("*").alias("n"), F.count_if(F.col("split").isNull()).alias("lost")).collect()}
    judged = [s for s in scenarios if s["scenario"] in counts or not subset]
    wrong = [s["scenario"] for s in judged if s["scenario"] not in counts or counts[s["scenario"]]["n"] != s["rows"]] + [s for s in counts if s not in {x["scenario"] for x in scenarios}]
    rows += [("scenarios declared", bool(scenarios), f"{len(scenarios)}"), ("rows as declared", not wrong, ", ".join(sorted(wrong)))]
    promised = {r["name"]: r for r in spark.read.schema(SCHEMA).json(f"{data}/schema").collect()}  # a row a column
    head = {c for c in spark.read.option("header", True).csv(f"{data}/shards").columns}
    rows.append(("columns", head == set(promised), ", ".join(sorted(head ^ set(promised)))))
    unassigned = sum(r["lost"] for r in counts.values())
    parts = sorted(r[0] for r in df.where("split IS NOT NULL").select("split").distinct().collect())
    twice = P.multi(splits, P.STATION, "split").count()
    rows += [("a part for every row", unassigned == 0, f"{unassigned} unassigned"), ("three parts", parts == sorted(PARTS), ", ".join(parts)), ("one part a transmitter", twice == 0, f"{twice} in two")]
    bench = sorted(s["scenario"] for s in judged if s["kind"] == "benchmark")
    holes = IO.coverage_gaps(df.where(F.col("scenario").isin(*bench)), declared).count() if bench else 0
    rows.append(("classes in every part", bool(bench) and holes == 0, f"{holes} empty, {len(bench)} benchmark scenarios"))
    if published is not None:
        features = [n for n, r in promised.items() if r["is_feature"]]
        f1 = baseline(df.where(F.col("scenario") == bench[0]), features, model).first()["macro_f1"] if bench else None
        rows.append(("baseline", f1 is not None and abs(f1 - published) <= tolerance, "no benchmark scenario" if f1 is None else "within" if abs(f1 - published) <= tolerance else f"{f1:.4f} against {published:.4f}"))
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")
