"""Scans and sinks of traces, corpora, releases and external logs.  Schemas are given, never inferred."""

from __future__ import annotations

import tempfile
import uuid

import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder all machines share: under ``spark.checkpoint.dir``, or a temporary one for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/ringtrace-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new shared folder and read back: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_trace(spark: SparkSession, path: str, schema: T.StructType, time_col: str, max_time_ms: float | None = None, cols: list[str] | None = None) -> DataFrame:
    """Trace CSV: lines with too many fields go, short ones are padded with nulls unless the time is missing."""
    kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    df = spark.read.schema(kept).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    fields = F.size(F.split(CORRUPT, ","))
    df = df.where(F.col(time_col).isNotNull() & (F.col(CORRUPT).isNull() | (fields <= len(schema))))
    if max_time_ms is not None:
        df = df.where(F.col(time_col) <= max_time_ms)
    return df.select(*(cols or schema.names))


def read_runs(spark: SparkSession, folder: str, table: str, schema: T.StructType, time_col: str) -> DataFrame:
    """All seeds of a table in one scan; the seed tag comes from the file or folder name."""
    df = read_trace(spark, f"{folder}/{table}_*.csv", schema, time_col)
    return df.withColumn("key_seed", F.regexp_extract(F.input_file_name(), rf"{table}_([^_/]+)\.csv", 1))


def road_length(spark: SparkSession, path: str, override: float | None = None) -> float:
    """The given length, else the number in the side file, else an error."""
    if override is not None:
        return float(override)
    row = spark.read.text(path).where("trim(value) <> ''").first()
    if row is None:
        raise ValueError(f"no road length in {path}")
    return float(row[0])


def read_roles(spark: SparkSession, path: str) -> DataFrame:
    """Station register; empty, with its schema, if there is none."""
    schema = "nodeId long, stationId long, role string"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
    return spark.read.schema(schema).option("header", True).csv(path) if there else spark.createDataFrame([], schema)


def write_corpus(df: DataFrame, path: str) -> str:
    df.write.partitionBy("key_seed").parquet(path)
    return path


def read_corpus(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_shards(df: DataFrame, path: str) -> str:
    """One folder of gzip CSV for each scenario and seed; a salt spreads a large seed over files."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(4))
    df.repartition("scenario", "key_seed", salt).write.partitionBy("scenario", "key_seed").option("compression", "gzip").option("header", True).csv(path)
    return path


def read_release(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Split manifest, one row for each physical transmitter."""
    schema = "key_seed string, label_txNodeId long, split string"
    return spark.read.schema(schema).option("header", True).csv(path).groupBy("key_seed", "label_txNodeId").agg(F.min("split").alias("split"))


def read_schema(spark: SparkSession, path: str) -> DataFrame:
    """Columns of a release's schema file."""
    kind = "columns array<struct<name string, dtype string, block string, is_feature boolean>>"
    return spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("columns").alias("c")).select("c.*")


def read_veremi(spark: SparkSession, path: str) -> DataFrame:
    """External JSON lines: receptions (type 3) with the receiver's latest own position (type 2) before them."""
    schema = "type int, rcvTime double, sender long, messageID long, pos array<double>, spd array<double>"
    rows = spark.read.schema(schema).json(path).withColumn("receiver", F.regexp_extract(F.input_file_name(), r"rx(\d+)", 1).cast("long"))
    w = Window.partitionBy("receiver").orderBy("rcvTime", "type", "messageID").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.last(F.when(F.col("type") == 2, F.col("pos")), True).over(w))
    return rows.where("type = 3 AND own IS NOT NULL").select(
        "messageID", "sender", (F.col("rcvTime") * 1000).alias("rxTimeMs"), F.get("pos", F.lit(0)).alias("claimedX"), F.get("own", F.lit(0)).alias("rxX"))


def read_nextgen(spark: SparkSession, path: str) -> DataFrame:
    """External JSON arrays, positions as text, nanoseconds; records that don't parse go."""
    schema = "rcvTime long, sender_id string, messageID long, sender struct<pos string, spd string>"
    rows = spark.read.schema(schema).json(path)
    xy = F.split("sender.pos", ",")
    out = rows.select("messageID", F.expr("try_cast(sender_id AS long)").alias("sender"), (F.expr("rcvTime div 1000") / 1000.0).alias("rxTimeMs"),
                      F.get(xy, F.lit(0)).try_cast("double").alias("claimedX"), F.get(xy, F.lit(1)).try_cast("double").alias("claimedY"))
    return out.where("messageID IS NOT NULL AND sender IS NOT NULL AND claimedX IS NOT NULL AND claimedY IS NOT NULL")


#: Attack code of each variant of these logs, which only the path names.
NEXTGEN_VARIANTS = {"constantPositionOffset": 2, "randomPositionOffset": 1}


def read_json_arrays(spark: SparkSession, path: str, record: str, glob: str = "*.json", opens: str | None = None) -> DataFrame:
    """(r, file): the records of files that hold one JSON array each, parsed by the schema ``record``.

    ``opens`` is the text a record starts with up to its first colon, by default that of the first record found.  Spark's text reader
    takes it as the line separator, so a large file is cut into byte ranges like any other text and each task
    starts at the next record.  A record that opens in another way is read with the one before it;
    a piece that does not parse goes, alone.  No inner object may open like a record.
    """
    files = {"recursiveFileLookup": True, "pathGlobFilter": glob}
    if opens is None:
        head = spark.read.options(**files, lineSep=":").text(path).where("value LIKE '%{%'").limit(1).collect()  # up to a first colon
        if not head:
            return spark.createDataFrame([], f"r struct<{record}>, file string")
        opens = "{" + head[0][0].split("{")[-1]
    pieces = spark.read.options(**files, lineSep=opens).text(path).select("value", F.input_file_name().alias("file"))
    body = F.regexp_replace("value", r"[,\]\s]+$", "")
    rest = pieces.where(~F.col("value").rlike(r"^[\[\s]*$"))
    text = F.when(F.col("value").rlike(r"^\s*\["), F.concat(body, F.lit("]"))).otherwise(F.concat(F.lit("[" + opens), body, F.lit("]")))
    parsed = F.from_json(text, f"array<struct<{record}>>")
    return rest.select(F.explode(parsed).alias("r"), "file").where("r IS NOT NULL")


#: Attack code of each variant of these logs, which only the path names.
NEXTGEN_VARIANTS = {"constantPositionOffset": 2, "randomPositionOffset": 1}


def read_nextgen_arrays(spark: SparkSession, path: str, glob: str = "veh_*.json") -> DataFrame:
    """A folder with one JSON array for each receiver (``veh_N.json``): positions as text, times in nanoseconds.

    The variant, hence the attack code, comes from the path; fails if it names none or both.  Records
    without sender, receiver or a number go.  The receiver's number stands behind ``veh_`` or ``veh=`` in the path.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path")
    named = listed.agg(*[F.count_if(F.contains("path", F.lit(v))).alias(v) for v in NEXTGEN_VARIANTS]).first()
    found = [v for v in NEXTGEN_VARIANTS if named[v]]
    if len(found) != 1:
        raise ValueError(f"the path names {found or 'none'} of {sorted(NEXTGEN_VARIANTS)}")
    record = "rcvTime string, sender_id string, messageID string, attacker string, sender struct<pos string, spd string, hed string>, receiver struct<pos string>"
    rows = read_json_arrays(spark, path, record, glob).select("r.*", "file")

    def part(column: str, k: int):
        return F.get(F.split(column, ","), F.lit(k)).try_cast("double")

    out = rows.select(
        (F.col("rcvTime").try_cast("double") / 1e6).alias("rxTimeMs"), F.regexp_extract("sender_id", "([^_]*)$", 1).try_cast("long").alias("claimedStationId"), F.col("messageID").try_cast("long").alias("msgUid"),
        part("sender.pos", 0).alias("claimedX"), part("sender.pos", 1).alias("claimedY"), part("receiver.pos", 0).alias("rxX"), part("receiver.pos", 1).alias("rxY"),
        F.col("sender.spd").try_cast("double").alias("claimedSpeed"), F.pmod(F.col("sender.hed").try_cast("double"), F.lit(360.0)).alias("claimedHeading"),
        F.when(F.coalesce(F.col("attacker").try_cast("int"), F.lit(0)) != 0, NEXTGEN_VARIANTS[found[0]]).otherwise(0).alias("label_attackId"),
        F.regexp_extract("file", r"veh[_=](\d+)", 1).try_cast("long").alias("rxNodeId"))
    return out.na.drop(subset=[c for c in out.columns if c != "rxNodeId"])


def write_json_arrays(df: DataFrame, receiver: str, order: list[str], path: str) -> str:
    """One JSON array of records for each value of ``receiver``, in a folder ``veh=N``, in the order of ``order``."""
    w = Window.partitionBy(receiver).orderBy(*order)
    rows = df.withColumn("__first", F.row_number().over(w) == 1).withColumn("__last", F.lead(F.lit(1)).over(w).isNull())
    record = F.to_json(F.struct(*[c for c in df.columns if c != receiver]))
    value = F.concat(F.when(F.col("__first"), "[").otherwise(""), record, F.when(F.col("__last"), "]").otherwise(", "))
    out = rows.select(value.alias("value"), F.col(receiver).alias("veh"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)])
    out = out.repartition("veh").sortWithinPartitions("veh", *[f"__o{k}" for k in range(len(order))])
    out.select("value", "veh").write.partitionBy("veh").text(path)
    return path


def require_fields(df: DataFrame, cols: list[str]) -> DataFrame:
    lacking = [c for c in cols if c not in df.columns]
    if lacking:
        raise ValueError(f"missing fields {lacking}")
    return df


def unknown_codes(df: DataFrame, column: str, known: list) -> DataFrame:
    """Codes that are not in the list, with their counts."""
    return df.where(~F.col(column).isin(known)).groupBy(column).agg(F.count("*").alias("n"))


def write_sample(df: DataFrame, keys: list[str], n: int, path: str) -> str:
    df.orderBy(*keys).limit(n).write.option("header", True).csv(path)
    return path


def scenario_manifest(df: DataFrame) -> DataFrame:
    return df.groupBy("scenario").agg(F.count("*").alias("rows"), F.count_distinct("key_seed", "label_txNodeId").alias("transmitters"), F.count_distinct("key_seed").alias("seeds"))


def coverage_gaps(df: DataFrame, declared: list[int], splits=("train", "validation", "test")) -> DataFrame:
    """(scenario, class, split) without a transmitter, over every declared class and not only those present."""
    grid = df.select("scenario").distinct().select("scenario", F.explode(F.array(*[F.lit(c) for c in declared])).alias("class"))
    grid = grid.select("*", F.explode(F.array(*[F.lit(s) for s in splits])).alias("split"))
    return grid.join(df.select("scenario", F.col("label_attackId").alias("class"), "split").distinct(), ["scenario", "class", "split"], "left_anti")


def scenario_kinds(df: DataFrame, declared: list[int]) -> DataFrame:
    """``scenario_manifest`` with the number of coverage gaps, and the kind: a benchmark has none."""
    gaps = coverage_gaps(df, declared).groupBy("scenario").agg(F.count("*").alias("gaps"))
    out = scenario_manifest(df).join(gaps, "scenario", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))
    return out.withColumn("kind", F.when(F.col("gaps") == 0, "benchmark").otherwise("supplementary"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify_checksums(got: DataFrame, manifest: DataFrame, subset: bool = False) -> DataFrame:
    """Files that are missing, differ or, unless ``subset``, are not listed."""
    j = manifest.select("file", F.col("sha256").alias("want")).join(got.select("file", "sha256"), "file", "full")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("want") != F.col("sha256"), "differs")
    out = j.select("file", state.alias("state")).where("state IS NOT NULL")
    return out.where("state <> 'missing'") if subset else out


def export_replay(pred: DataFrame, second) -> DataFrame:
    """One JSON record a second with its confusion cells; ``operators.replay`` has verdicts, frames and scores."""
    rows = pred.withColumn("second", second)
    cells = rows.groupBy("second", "y", "p").agg(F.count("*").alias("n"))
    cells = cells.groupBy("second").agg(F.sort_array(F.collect_list(F.struct("y", "p", "n"))).alias("cells"))  # at most K x K cells
    return cells.select("second", F.to_json(F.struct("second", "cells")).alias("record"))
