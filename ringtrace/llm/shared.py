"""Small helpers every operator of this subpackage uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves a local master only; on a cluster each machine would have
    one of its own, so that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="ringtrace-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    This cuts the lineage: what follows reads files that survive the loss of any executor, and
    an expensive column (a Python pass over all texts) is computed once however often it is read.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """At most ``rows`` rows in a batch between Spark and Python, which is a setting of the session.

    A batch of texts is held on both sides, so the default of 10,000 rows costs a task some hundred megabytes.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame that ``cut`` returned, once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, lengthened until none of them clashes with a column in ``taken`` (case aside)."""
    known = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs in a text, as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tidy() -> None:
    """Give freed memory of a Python worker back to the machine; workers live on for later tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
