"""Streaming queries: the given tables as file streams, run to the end, compared with batch SQL on closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learn as L
from ..sources import adapters as A
from ..streaming import jobs as J
from .ctes import cte, rsrp, with_
from .features_q import APP, APP_D, LINK, PHY, PHY_D, TOL
from .gates_q import FS, Y
from .registry import query
from .reports_q import pred

DAY = 86_400_000
#: Rows reach the jobs up to two days late, mixed over six files that are read one a batch.
LATE_MS, LATE = 2 * DAY, "2 days"


def stream(spark, rows, ms, name):
    return J.file_stream(spark, J.with_time(rows, ms), name, time="ts", late_ms=LATE_MS)


def closed(out, rows, ms, width):
    """Windows that the final watermark has passed; the others stay open until later rows arrive, and both sides leave them out."""
    last = rows.agg(F.max(F.col(ms).cast("long"))).first()[0]
    return out.where(F.col("start_ms") + width <= last - LATE_MS)


cte("rxd", "rx", f"SELECT *, CAST(floor(rxTimeMs / {DAY}) AS BIGINT) * {DAY} AS start_ms, sqrt((claimedX - rxX) ^ 2 + (claimedY - rxY) ^ 2) AS d FROM rx")
RX_END = f"start_ms + {DAY} <= (SELECT max(CAST(trunc(rxTimeMs) AS BIGINT)) FROM rx) - {LATE_MS}"


@query("t01_score_stream", with_("pred", "SELECT y, p, count(*) AS n FROM pred GROUP BY ALL"))
def t01(spark, d):
    return J.score_stream(J.file_stream(spark, pred(spark, d), "pred"), lambda b: b, "t01")


@query("t01_score_stream_model")
def t01m(spark, d):
    df = A.corpus(spark, d)
    m = L.fit(df.where("label_txNodeId % 5 > 0"), FS, Y)
    return J.score_stream(J.file_stream(spark, df.where("label_txNodeId % 5 = 0"), "corpus"), lambda b: L.score(m, b, FS, [F.col(Y).alias("y")]), "t01m")


cte("g01day", "fullrx", f"""SELECT {LINK}, start_ms // {DAY} AS "window", {APP}{PHY} FROM (SELECT *, CAST(floor(rxTimeMs / {DAY}) AS BIGINT) * {DAY} AS start_ms, CASE WHEN sinr > 0 THEN 10 * log10(sinr) END AS db, slRsrpDbm - {rsrp('claimedDist')} AS rr FROM fullrx)
 WHERE start_ms + {DAY} + {TOL} <= least((SELECT max(CAST(trunc(rxTimeMs) AS BIGINT)) FROM rx), (SELECT max(CAST(trunc(timeMs) AS BIGINT)) FROM pssch)) - {LATE_MS} GROUP BY ALL""")


@query("t02_window_features_stream", with_("g01day", "SELECT * FROM g01day"), f"{APP_D} {PHY_D}")
def t02(spark, d):
    rx, p = A.rx(spark, d), A.pssch(spark, d)
    out = J.run_to_table(J.link_features_stream(stream(spark, rx, "rxTimeMs", "rx"), stream(spark, p.drop("claimedStationId"), "timeMs", "pssch"), DAY, TOL, LATE), "t02")
    # both sides leave out windows that the final watermark, the lesser of the two streams', has not passed
    last = min(df.agg(F.max(F.col(c).cast("long"))).first()[0] for df, c in ((rx, "rxTimeMs"), (p, "timeMs")))
    return out.where((F.col("window") + 1) * DAY + TOL <= last - LATE_MS)


@query("t03_residuals_stream", with_("res", f"SELECT msgUid, {', '.join(J.RESIDUALS)} FROM res WHERE CAST(trunc(rxTimeMs) AS BIGINT) < (SELECT max(CAST(trunc(rxTimeMs) AS BIGINT)) FROM rx) - {LATE_MS}"), " ".join(J.RESIDUALS))
def t03(spark, d):
    return J.run_to_table(J.residuals_stream(stream(spark, A.rx(spark, d), "rxTimeMs", "rx"), LATE), "t03")


@query("t04_cbr_sliding_stream", with_("pssch", f"""SELECT rxNodeId, start_ms, least(1.0::DOUBLE, sum(subChLen) / 2000.0::DOUBLE) AS cbr, CAST(count(DISTINCT txRnti) AS INT) AS neighbours, count(*) FILTER (corrupt = 1) AS corrupt,
 first(slRsrpDbm ORDER BY timeMs DESC, radioUid DESC) AS last_power FROM (SELECT *, (CAST(floor(timeMs / {DAY}) AS BIGINT) - k) * {DAY} AS start_ms FROM pssch, (SELECT unnest([0, 1]) AS k))
 WHERE start_ms + {2 * DAY} <= (SELECT max(CAST(trunc(timeMs) AS BIGINT)) FROM pssch) - {LATE_MS} GROUP BY ALL"""), "cbr last_power")
def t04(spark, d):
    p = A.pssch(spark, d)
    return closed(J.run_to_table(J.cbr_sliding_stream(stream(spark, p, "timeMs", "pssch"), capacity=2000.0, late=LATE), "t04"), p, "timeMs", 2 * DAY)


@query("t05_alerts_stream", with_("fired", f"SELECT key_window, fired, edge FROM (SELECT key_window, timeMs, fired, fired AND NOT coalesce(lag(fired) OVER (PARTITION BY key_region, key_claimedStationId ORDER BY timeMs, key_window), false) AS edge FROM fired) WHERE CAST(trunc(timeMs) AS BIGINT) < (SELECT max(CAST(trunc(timeMs) AS BIGINT)) FROM fired) - {LATE_MS}"))
def t05(spark, d):
    return J.run_to_table(J.alerts_stream(stream(spark, A.tracks(spark, d), "timeMs", "tracks"), 3, 5, LATE), "t05")


@query("t06_asof_stream", with_("rx pssch near_radio", f"""SELECT rx.msgUid, n.sinr FROM rx LEFT JOIN near_radio n USING (msgUid) WHERE CAST(trunc(rxTimeMs) AS BIGINT) + {TOL} <
 least((SELECT max(CAST(trunc(rxTimeMs) AS BIGINT)) FROM rx), (SELECT max(CAST(trunc(timeMs) AS BIGINT)) FROM pssch)) - {LATE_MS}"""), "sinr")
def t06(spark, d):
    rx, p = stream(spark, A.rx(spark, d), "rxTimeMs", "rx"), stream(spark, A.pssch(spark, d), "timeMs", "pssch")
    return J.run_to_table(J.asof_stream(rx, p, TOL, LATE), "t06")


@query("t07_vote_stream", with_("rxd", f"SELECT claimedStationId, start_ms, count(*) AS n, count(*) FILTER (msgType <> 1) AS k, count(*) FILTER (msgType <> 1) >= ceil(count(*) * 0.5::DOUBLE) AS alert FROM rxd WHERE {RX_END} GROUP BY ALL"))
def t07(spark, d):
    v = A.rx(spark, d).withColumn("p", F.when(F.col("msgType") != 1, 1).otherwise(0))
    return closed(J.run_to_table(J.vote_stream(stream(spark, v, "rxTimeMs", "votes"), 0.5, late=LATE), "t07"), v, "rxTimeMs", DAY)
