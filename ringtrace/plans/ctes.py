"""SQL common table expressions that the oracles share: the adapters and a few operators, in DuckDB's dialect."""

from __future__ import annotations

CTES: dict[str, tuple[str, str]] = {}


def cte(name: str, needs: str, sql: str) -> None:
    CTES[name] = (needs, sql)


def with_(names: str, select: str) -> str:
    """``select`` after the named expressions and all they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in CTES[name][0].split():
                add(n)
            order.append(name)

    for n in names.split():
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({CTES[n][1]})" for n in order) + " " + select


def pmod(x: str, n: str = "360.0::DOUBLE") -> str:
    return f"(CASE WHEN ({x}) % {n} < 0 THEN (({x}) % {n} + {n}) % {n} ELSE ({x}) % {n} END)"


def unwrap(d: str) -> str:
    return f"(({d}) - round_even(({d}) / 6000.0::DOUBLE, 0) * 6000.0::DOUBLE)"


def gap(a: str, b: str) -> str:
    g = pmod(f"abs(({a}) - ({b}))")
    return f"least({g}, 360.0::DOUBLE - {g})"


def rsrp(d: str) -> str:
    return f"(23.0::DOUBLE - (20 * log10(greatest({d}, 1.0::DOUBLE)) + 20 * log10(5.89e9::DOUBLE) - 147.55::DOUBLE))"


cte("rx", "", """SELECT 'r1' AS key_seed, event_id AS msgUid, epoch_us(ts) / 1000.0::DOUBLE AS rxTimeMs, CAST(event_id % 2 AS INT) AS rxNodeId,
 user_id AS claimedStationId, CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 14 ELSE 1 END AS msgType,
 event_id // 3 AS seqNo, value * 20 AS claimedX, CAST(event_id % 7 - 3 AS DOUBLE) AS claimedY,
 CAST(10 + event_id % 21 AS DOUBLE) AS claimedSpeed, CAST((event_id * 37) % 360 AS DOUBLE) AS claimedHeading,
 CAST(3000 * (event_id % 2) AS DOUBLE) AS rxX, 0.0::DOUBLE AS rxY FROM events""")
cte("pssch", "rx", """SELECT key_seed, msgUid AS radioUid, rxTimeMs + ((msgUid * 7919) % 11 - 5) * 60000 AS timeMs, rxNodeId,
 claimedStationId AS txRnti, claimedX / 200 AS sinr, (msgUid % 10) / 10.0::DOUBLE AS tbler, CAST(msgUid % 5 = 0 AS INT) AS corrupt,
 CAST(msgUid % 16 AS INT) AS mcs, -60 - claimedX / 200 AS slRsrpDbm, CAST(1 + msgUid % 3 AS INT) AS subChLen FROM rx WHERE msgUid % 3 <> 0""")
cte("tx", "rx", """SELECT key_seed, msgUid, rxTimeMs AS txTimeMs, claimedStationId AS txNodeId, claimedStationId, msgType, seqNo, claimedX, claimedY,
 claimedSpeed, claimedHeading, claimedX - CASE claimedStationId % 5 WHEN 0 THEN 150 WHEN 1 THEN 12 ELSE msgUid % 9 - 4 END AS trueX,
 claimedY AS trueY, claimedSpeed AS trueSpeed, CAST((msgUid * 37 + 5) % 360 AS DOUBLE) AS trueHeading,
 CAST(CASE claimedStationId % 5 WHEN 0 THEN 1 WHEN 1 THEN 11 ELSE 0 END AS INT) AS attackId, (msgUid % 100) / 100.0::DOUBLE AS txCbr FROM rx""")
cte("ears", "", "SELECT 'r1' AS key_seed, event_id AS msgUid, user_id + k AS rxNodeId FROM events, (SELECT unnest(range(1, 9)) AS k) WHERE event_id % (k + 1) = 0")
cte("stations", "", """SELECT DISTINCT user_id AS nodeId, user_id AS stationId, CASE WHEN user_id % 10 = 0 THEN 'rsu' ELSE 'vehicle' END AS role FROM events""")
cte("units0", "", """SELECT concat('s', l_linenumber) AS key_seed, l_suppkey AS key_claimedStationId, CAST(l_linenumber AS BIGINT) AS key_window,
 l_orderkey AS rxNodeId, CAST((l_partkey * 37) % 6000 AS DOUBLE) AS rxX, CAST(l_orderkey % 25 - 12 AS DOUBLE) AS rxY,
 CAST((l_suppkey * 613) % 6000 AS DOUBLE) AS trueX, CAST(l_suppkey % 7 - 3 AS DOUBLE) AS trueY,
 (l_suppkey * 613) % 6000 + CASE WHEN l_suppkey % 5 = 0 THEN 150.0::DOUBLE ELSE 0.0::DOUBLE END AS claimedX,
 CAST(l_suppkey % 7 - 3 AS DOUBLE) AS claimedY, CAST(l_suppkey % 5 = 0 AS INT) AS label, l_quantity AS noise FROM lineitem""")
cte("units", "units0", """SELECT * EXCLUDE (noise), -30 - 25 * log10(greatest(sqrt((rxX - trueX) ^ 2 + (rxY - trueY) ^ 2), 1.0::DOUBLE)) + (noise - 25.5::DOUBLE) / 10 AS phy_rsrp_mean FROM units0""")
cte("corpus", "", """SELECT concat('s', l_linenumber) AS key_seed, l_suppkey AS key_claimedStationId, l_orderkey AS key_rxNodeId,
 CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS key_window, l_suppkey AS label_txNodeId,
 CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 11 END AS label_attackId, CAST(l_returnflag <> 'N' AS INT) AS label_is_attack,
 CAST(l_orderkey % 20 <> 0 AS INT) AS label_clean, CASE WHEN l_orderkey % 4 = 0 THEN 'rsu' ELSE 'vehicle' END AS key_observer_role,
 l_quantity AS app_quantity, l_extendedprice AS app_price, l_discount AS phy_discount, l_tax AS phy_tax FROM lineitem""")
cte("tracks", "", """SELECT CAST(event_id % 4 AS INT) AS key_region, user_id AS key_claimedStationId, event_id AS key_window,
 epoch_us(ts) / 1000.0::DOUBLE AS timeMs, value / 100 AS score, value > 70 AS hit, user_id % 5 = 0 AS attack, CAST(event_id % 3 AS INT) AS seed FROM events""")
cte("updates", "", """SELECT vec_id AS client, CAST(label AS BIGINT) AS class, vec_id % 50 + 1 AS n_rows, vec_id % 7 + 1 AS n_steps, embedding AS vector FROM embeddings""")
