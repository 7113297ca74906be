"""Scalar expressions on columns: geometry on a ring road, powers, windows and bins.

All are null in, null out unless said otherwise, and stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CARRIER_HZ, TX_DBM = 5.89e9, 23.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def distance(dx, dy) -> Column:
    return F.hypot(_c(dx), _c(dy))


def unwrap(d, road_length) -> Column:
    """A difference along a ring road taken the short way round; unchanged without a length."""
    return _c(d) if road_length is None else _c(d) - F.rint(_c(d) / F.lit(float(road_length))) * float(road_length)


def angle_gap(a, b) -> Column:
    """Smallest angle between two headings in degrees."""
    gap = F.pmod(F.abs(_c(a) - _c(b)), F.lit(360.0))
    return F.least(gap, 360.0 - gap)


def signed_angle(a) -> Column:
    """An angle difference in [-180, 180)."""
    return F.pmod(_c(a) + 180.0, F.lit(360.0)) - 180.0


def bearing(dx, dy) -> Column:
    """Direction of motion in degrees, 0 along +y, clockwise."""
    return F.pmod(F.degrees(F.atan2(_c(dx), _c(dy))), F.lit(360.0))


def dead_reckon(x, y, speed, heading, dt) -> tuple[Column, Column]:
    """Where a station should be ``dt`` seconds on."""
    way, turn = _c(speed) * _c(dt), F.radians(_c(heading))
    return _c(x) + way * F.sin(turn), _c(y) + way * F.cos(turn)


def predicted_rsrp(d, hz: float = CARRIER_HZ, dbm: float = TX_DBM) -> Column:
    """Free-space received power at a distance of at least one metre."""
    near = F.when(_c(d) < 1, 1.0).otherwise(_c(d))
    return F.lit(dbm) - (20 * F.log10(near) + 20 * F.log10(F.lit(hz)) - 147.55)


def to_db(x) -> Column:
    return F.when(_c(x) > 0, 10 * F.log10(_c(x)))


def window_index(t, width) -> Column:
    return F.floor(_c(t) / _c(width)).cast("long")


def at_least(x, low) -> Column:
    """Clip from below; null stays null."""
    return F.when(_c(x) < low, F.lit(low)).otherwise(_c(x))


def cut_bins(x, edges: list[float]) -> Column:
    """Index of the bin (lo, hi] that holds x, from 0; null outside."""
    out = F.when(F.lit(False), F.lit(0))
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        out = out.when((_c(x) > lo) & (_c(x) <= hi), k)
    return out


def digitize(x, edges: list[float]) -> Column:
    """Number of edges at or under x: bins are [lo, hi)."""
    return F.when(_c(x).isNotNull(), sum(((_c(x) >= e).cast("int") for e in edges), F.lit(0)))


def quantise(x, step: float) -> Column:
    return F.rint(_c(x) / step) * step


def code_map(x, names: dict) -> Column:
    """Codes to names; unknown codes to null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, name in names.items():
        out = out.when(_c(x) == code, name)
    return out


def polar(vx, vy) -> tuple[Column, Column]:
    """Speed and heading of a velocity."""
    return F.hypot(_c(vx), _c(vy)), bearing(vx, vy)


def entropy_terms(p) -> Column:
    """-p ln p, 0 at 0; summed over shares it is the entropy and exp of it the effective count."""
    return F.when(_c(p) > 0, -_c(p) * F.log(_c(p))).otherwise(0.0)


#: Message and class codes of the traces.
MESSAGE = {1: "DENM", 2: "CAM", 14: "CPM", 16: "VAM", 20: "MCM"}
CLASS = {0: "benign", 1: "const_offset", 3: "random_offset", 4: "replay", 5: "speed", 6: "sybil", 7: "dos", 8: "sps",
         11: "small_offset", 12: "low_rate_dos", 13: "medium_offset"}
FAMILY = {1: "spoofing", 3: "spoofing", 11: "spoofing", 13: "spoofing", 7: "flooding", 12: "flooding", 4: "replay"}
