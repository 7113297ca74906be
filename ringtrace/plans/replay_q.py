"""Queries of replays: running scores in batch and as a stream, verdicts and frames, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay as Y
from ..sources import adapters as A, io as IO
from ..streaming import jobs as J
from . import reports_q
from .ctes import cte, with_
from .registry import query

DAY, SIZE = 86_400_000.0, 32
STATION_SECOND = ["key_seed", "key_claimedStationId", "key_window"]


def running_sql(by: str) -> tuple[str, str]:
    """Name of a table expression with the cumulative counts of each class, and the scores it gives."""
    name, keys = ("runall", "key_window") if not by else ("run" + by, f"{by}, key_window")
    part = f"PARTITION BY {by + ', ' if by else ''}c"
    cte(name, "pred", f"""SELECT *, sum(t0) OVER w AS t, sum(q0) OVER w AS q, sum(h0) OVER w AS h, sum(f0) OVER w AS f FROM (SELECT {keys}, c, count(*) AS decisions, count(*) FILTER (p <> 0) AS alerts, count(*) FILTER (y <> 0) AS attacks,
 count(*) FILTER (y = c) AS t0, count(*) FILTER (p = c) AS q0, count(*) FILTER (y = c AND p = c) AS h0, count(*) FILTER (y = c AND p <> 0) AS f0 FROM pred, (SELECT unnest([0, 1, 11]) AS c) GROUP BY ALL)
 WINDOW w AS ({part} ORDER BY key_window ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
    return name, with_(name, f"""SELECT {keys}, max(decisions) AS decisions, max(alerts) AS alerts, max(attacks) AS attacks, sum(h) / CAST(sum(t) AS DOUBLE) AS accuracy, avg(2 * h / CAST(t + q AS DOUBLE)) FILTER (t + q > 0) AS macro_f1,
 coalesce((sum(h) * CAST(sum(t) AS DOUBLE) - sum(t * q)) / nullif(sqrt(CAST(sum(t) AS DOUBLE) * sum(t) - sum(q * q)) * sqrt(CAST(sum(t) AS DOUBLE) * sum(t) - sum(t * t)), 0), 0) AS mcc,
 sum(f) FILTER (c IN (1, 11)) / nullif(CAST(sum(t) FILTER (c IN (1, 11)) AS DOUBLE), 0) AS spoofing, CAST(NULL AS DOUBLE) AS flooding, CAST(NULL AS DOUBLE) AS replay,
 sum(f) FILTER (c = 0) / nullif(CAST(sum(t) FILTER (c = 0) AS DOUBLE), 0) AS false_alarm FROM {name} GROUP BY {keys}""")


SCORES = "accuracy macro_f1 mcc spoofing false_alarm"


@query("w11_running_metrics", running_sql("")[1], SCORES)
def w11(spark, d):
    """All seeds as one replay."""
    return Y.running_metrics(Y.second_counts(reports_q.pred(spark, d), [], "key_window"), [], "key_window")


@query("t01_running_scores_stream", running_sql("key_seed")[1], SCORES)
def t01(spark, d):
    """Batches of raw feature rows are scored by a rule and counted as they come; scores run by seed."""
    rows = A.corpus(spark, d).select("key_seed", "key_window", "label_attackId", "app_quantity")

    def rule(batch):
        p = F.when(F.col("app_quantity") > 30, F.col("label_attackId")).when(F.col("app_quantity") > 15, 0).otherwise(1)
        return batch.select("key_seed", "key_window", F.col("label_attackId").alias("y"), p.alias("p"))

    counts = J.score_seconds(J.file_stream(spark, rows, "corpus"), rule, ["key_seed"], "key_window", "t01s")
    return Y.running_metrics(counts, ["key_seed"], "key_window")


cte("verdict", "pred", """SELECT key_seed, key_claimedStationId, key_window, CAST(sum(c) AS BIGINT) AS n, CAST(coalesce(sum(c) FILTER (p <> 0), 0) AS BIGINT) AS flagged, coalesce(first(p ORDER BY c DESC, p) FILTER (p <> 0), 0) AS top
 FROM (SELECT key_seed, key_claimedStationId, key_window, p, count(*) AS c FROM pred GROUP BY ALL) GROUP BY ALL""")
cte("truth", "pred", "SELECT key_seed, key_claimedStationId, key_window, first(y ORDER BY c DESC, y) AS truth FROM (SELECT key_seed, key_claimedStationId, key_window, y, count(*) AS c FROM pred GROUP BY ALL) GROUP BY ALL")


@query("s17_verdicts", with_("verdict truth", "SELECT * FROM verdict JOIN truth USING (key_seed, key_claimedStationId, key_window)"))
def s17v(spark, d):
    return Y.verdicts(reports_q.pred(spark, d), STATION_SECOND)


_POS = " || ',' || ".join(f"coalesce(CAST(CAST(round_even({c} * 10, 0) AS BIGINT) AS VARCHAR), '{Y.GAP}')" for c in Y.PLACES)
cte("lastframe", "tx", f"SELECT key_seed, claimedStationId, CAST(floor(txTimeMs / {DAY}) AS BIGINT) AS frame, {', '.join(f'arg_max({c}, (txTimeMs, msgUid)) AS {c}' for c in Y.PLACES)} FROM tx GROUP BY ALL")
cte("who", "tx", "SELECT key_seed, claimedStationId, first(attackId ORDER BY c DESC, attackId) AS attack, first(txNodeId ORDER BY c DESC, txNodeId) AS node FROM (SELECT key_seed, claimedStationId, attackId, txNodeId, count(*) AS c FROM tx GROUP BY ALL) GROUP BY ALL")
cte("frames17", "lastframe who", f"""SELECT p.key_seed, p.claimedStationId, part, attack, node, '[' || string_agg({_POS}, ',' ORDER BY i) || ']' AS pos
 FROM (SELECT DISTINCT key_seed, claimedStationId, frame // {SIZE} AS part FROM lastframe) p CROSS JOIN (SELECT unnest(range({SIZE})) AS i)
 LEFT JOIN lastframe l ON l.key_seed = p.key_seed AND l.claimedStationId = p.claimedStationId AND l.frame = part * {SIZE} + i JOIN who w ON w.key_seed = p.key_seed AND w.claimedStationId = p.claimedStationId GROUP BY ALL""")


@query("s17_frames", with_("frames17", "SELECT * FROM frames17"))
def s17f(spark, d):
    return Y.track_frames(A.tx(spark, d), DAY, SIZE).withColumn("pos", F.to_json("pos"))


@query("s17_export_drives", with_("pred lastframe", f"""SELECT 'frames' AS kind, key_seed, count(DISTINCT (claimedStationId, frame // {SIZE})) AS records, CAST(NULL AS BIGINT) AS decisions FROM lastframe GROUP BY 2
 UNION ALL SELECT 'seconds', key_seed, count(DISTINCT (key_claimedStationId, key_window)), count(*) FROM pred GROUP BY 2
 UNION ALL SELECT 'cells', key_seed, count(DISTINCT (key_window, y, p)), count(*) FROM pred GROUP BY 2 UNION ALL SELECT 'scores', key_seed, count(DISTINCT key_window), count(*) FROM pred GROUP BY 2"""))
def s17x(spark, d):
    """The files of all drives, read back: records and decisions by kind and seed."""
    folder = Y.export_drives(A.tx(spark, d), reports_q.pred(spark, d), "key_window", DAY, SIZE, IO.scratch(spark, "drives"))
    out = None
    for kind, column in (("frames", None), ("seconds", "n"), ("cells", "n"), ("scores", "decisions")):
        rows = spark.read.schema("key_seed string" + (f", {column} long" if column else "")).json(f"{folder}/{kind}")
        one = rows.groupBy("key_seed").agg(F.lit(kind).alias("kind"), F.count("*").alias("records"), (F.sum(column) if column else F.lit(None).cast("long")).alias("decisions"))
        out = one if out is None else out.unionByName(one)
    return out
