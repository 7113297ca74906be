"""Every registered query of the trace engine with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to four decimals, with an odd offset so that no decimal tie is decided by the last bit."""
    doubles = {c for c, t in df.dtypes if t == "double"}
    return df.select(*[(F.floor(F.col(c) * 10000 + 0.50031) / 10000).alias(c) if c in doubles else F.col(c) for c in df.columns])


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Decorator: register ``f(spark, sf_dir)`` as ``name``, with the DuckDB SQL of the same rows.

    ``doubles`` names the SQL's double columns; both sides are rounded alike, since sums of
    doubles depend on the order of their terms.
    """

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            parts = [f"floor({c} * 10000 + 0.50031) / 10000 AS {c}" for c in doubles.split()]
            _ORACLES[name] = f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql})" if parts else sql
        return f

    return add


def _load() -> None:
    from . import arms_q, campaign_q, features_q, gates_q, geometry_q, partition_q, replay_q, reports_q, scan_q, spacetime_q, stream_q  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
