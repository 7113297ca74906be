"""Stateful operators of the streams: rows of a key in event order, and the nearest reception of a message.

Keys are dealt to ``BUCKETS`` buckets by hash, and a bucket is what Spark sees as a key: every call of a state costs a round trip
to the JVM, which a key of a few rows a batch would pay for alone.  Both operators keep a bucket's rows in list state, which new rows are
appended to, and act on one event-time timer: what waits is read once the watermark has passed some of it.  State lives in RocksDB.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from operator import itemgetter
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

BUCKETS = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(df: DataFrame) -> None:
    """These operators need the RocksDB state store, which is a setting of the session."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def moment(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, tz=timezone.utc)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the ``bucket`` of its key."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))


def by_key(rows: list[tuple], width: int) -> dict[tuple, list[tuple]]:
    """Rows that begin with ``width`` key columns, without them, by key."""
    found: dict[tuple, list[tuple]] = {}
    for r in rows:
        found.setdefault(r[:width], []).append(r[width:])
    return found


class OneTimer(StatefulProcessor):
    """A processor whose buckets have one timer each, the earliest asked for, so that what waits is not read for nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def wake(self, at: int) -> None:
        had = self.due.get()
        if had is None or at < had[0]:
            if had is not None:
                self.handle.deleteTimer(had[0])
            self.handle.registerTimer(at)
            self.due.update((at,))

    def woken(self, at: int | None) -> None:
        """After a timer: the next one, if any."""
        if at is None:
            self.due.clear()
        else:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def close(self) -> None:
        pass


class InOrder(OneTimer):
    """Rows of a key in order through ``step(row, last) -> (values, last)``, once the watermark has passed them.

    ``last`` is what a key keeps, a tuple or None; it goes ``hold_ms`` after the key's last row.  ``places`` are those of the key and
    of ``columns`` in a row.
    """

    def __init__(self, places: list[int], columns: list[str], order: list[str], step: Callable[[dict, tuple | None], tuple[tuple, tuple]], waiting: str, kept: str, out: list[str], hold_ms: int, first: bool):
        self.places, self.columns, self.step, self.waiting, self.kept, self.hold_ms, self.first = places, columns, step, waiting, kept, hold_ms, first
        self.width, self.order = len(places) - len(columns), itemgetter(*[columns.index(c) for c in order])
        self.row = Row(*out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.wait = handle.getListState("wait", self.waiting)
        self.last = handle.getListState("last", self.kept)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        mark, pick, at = timerValues.getCurrentWatermarkInMs(), itemgetter(*self.places), self.width
        # later rows are dropped; an operator before has done so already, and gives its rows once the watermark has passed them
        new = [r for r in (pick(tuple(row)) for row in rows) if not self.first or r[at] >= mark]
        if new:
            self.wait.appendList(new)
            self.wake(min(r[at] for r in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        mark, w = timerValues.getCurrentWatermarkInMs(), self.width
        held = [tuple(r) for r in self.wait.get()]
        rest = [r for r in held if r[w] >= mark]
        state = {k: rows[0] for k, rows in by_key([tuple(r) for r in self.last.get()], w).items()}
        before = len(state)
        ready = by_key([r for r in held if r[w] < mark], w)
        for k, rows in ready.items():
            rows.sort(key=self.order)
            last = state[k][1:] if k in state else None
            for r in rows:
                values, last = self.step(dict(zip(self.columns, r)), last)
                yield self.row(*values)
            state[k] = (max(r[0] for r in rows), *last)
        waits = {r[:w] for r in rest}
        kept = {k: v for k, v in state.items() if k in waits or v[0] + self.hold_ms >= mark}
        if len(rest) < len(held):
            self.wait.put(rest) if rest else self.wait.clear()
        if ready or len(kept) < before:
            self.last.put([(*k, *v) for k, v in kept.items()]) if kept else self.last.clear()
        ahead = [r[w] + 1 for r in rest] + [max(mark, v[0] + self.hold_ms) + 1 for v in kept.values()]
        self.woken(min(ahead, default=None))


def in_order(df: DataFrame, keys: list[str], order: list[str], columns: list[str], step: Callable, kept: str, out: str, late: str, hold_ms: int, event_time: str = "") -> DataFrame:
    """``df`` with an event time ``ts`` through ``step``, a key at a time and in ``order``.

    ``columns`` are what ``step`` sees of a row; ``kept`` is the schema of what it keeps.  The watermark is set
    here unless ``late`` is empty, where a stateful operator before has one already.  A row behind it is dropped,
    so what comes out never depends on the batches.
    """
    use_rocksdb(df)
    if late:
        df = df.withWatermark("ts", late)
    rows = df.withColumn("ms", F.unix_millis("ts"))
    columns = ["ms", *columns]
    kinds = dict(rows.dtypes)
    key = ", ".join(f"key{n} {kinds[c]}" for n, c in enumerate(keys))
    waiting = ", ".join([key, *[f"{c} {kinds[c]}" for c in columns]])
    names = [c.split()[0] for c in out.split(", ")]
    shown = dealt(rows, keys).select(*dict.fromkeys(["bucket", *keys, *columns, "ts"]))
    places = [shown.columns.index(c) for c in [*keys, *columns]]
    work = InOrder(places, columns, order, step, waiting, f"{key}, seen long, {kept}", names, hold_ms, bool(late))
    return shown.groupBy("bucket").transformWithState(work, out, "append", "eventTime", eventTimeColumnName=event_time)


class Nearest(OneTimer):
    """Messages of a key, each with the nearest reception within ``within`` ms, once the watermark has passed that interval.

    Receptions stay while a message that may still come can need them.  ``picks`` says which receptions count for which
    values: (place of a flag in a reception, places of the values).  ``message`` and ``values`` are places in a row, after those of the key.
    """

    def __init__(self, side: int, width: int, message: list[int], values: list[int], picks: list[tuple[int, list[int]]], schemas: tuple[str, str], within: int, out: list[str]):
        self.side, self.width, self.message, self.values, self.picks, self.schemas, self.within = side, width, message, values, picks, schemas, within
        self.row = Row(*out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.messages = handle.getListState("messages", self.schemas[0])
        self.heard = handle.getListState("heard", self.schemas[1])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        mark, at = timerValues.getCurrentWatermarkInMs(), self.width
        pick = itemgetter(*self.message), itemgetter(*self.values)
        new: tuple[list, list] = [], []
        for row in rows:
            row = tuple(row)
            side = row[self.side]
            r = pick[side](row)
            if r[at] >= mark:
                new[side].append(r)
        for state, some in zip((self.messages, self.heard), new):
            if some:
                state.appendList(some)
        if any(new):
            self.wake(max(mark, min(r[at] for some in new for r in some) + self.within) + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        mark, w = timerValues.getCurrentWatermarkInMs(), self.width
        held = [[tuple(r) for r in state.get()] for state in (self.messages, self.heard)]
        messages, heard = (by_key(rows, w) for rows in held)
        left: tuple[list, list] = [], []
        for k in messages.keys() | heard.keys():
            mine, theirs = messages.get(k, []), heard.get(k, [])
            ready = [m for m in mine if m[0] + self.within < mark]
            rest = [m for m in mine if m[0] + self.within >= mark]
            if ready:
                found = []
                for flag, at in self.picks:
                    some = sorted((h for h in theirs if h[flag]), key=lambda h: (h[1], h[2]))
                    found.append((some, [h[1] for h in some], at))
                for m in ready:
                    got = []
                    for some, times, at in found:
                        near = self._near(m[1], some, times)
                        got += [None if near is None else near[i] for i in at]
                    yield self.row(moment(m[0] + self.within), *m[1:], *got)
            # a message may come from the watermark on, and needs what is up to ``within`` before it
            times = sorted(m[1] for m in rest)
            left[0].extend(k + m for m in rest)
            left[1].extend(k + h for h in theirs if h[0] + self.within >= mark or self._wanted(h[1], times))
        for state, now, before in zip((self.messages, self.heard), left, held):
            if not now:
                if before:
                    state.clear()
            elif len(now) < len(before):
                state.put(now)
        waits = [r[w] + self.within for now in left for r in now]
        self.woken(max(mark, min(waits)) + 1 if waits else None)

    def _wanted(self, t: float, times: list[float]) -> bool:
        after = bisect_left(times, t)
        return any(abs(t - m) <= self.within for m in times[max(after - 1, 0) : after + 1])

    def _near(self, t: float, rows: list[tuple], times: list[float]) -> tuple | None:
        """The nearest in time: the earlier at equal distance; of equal times the largest id before the message, the smallest after it."""
        after = bisect_right(times, t)
        back = rows[after - 1] if after else None
        ahead = rows[after] if after < len(rows) else None
        if back is not None and ahead is not None:
            near = back if t - back[1] <= ahead[1] - t else ahead
        else:
            near = back or ahead
        return near if near is not None and abs(near[1] - t) <= self.within else None


def nearest_stream(
    messages: DataFrame, heard: DataFrame, keys: dict[str, str], ids: tuple[str, str], times: tuple[str, str], carry: list[str], picks: dict[str, tuple[Column, list[str]]], within_ms: int, late: str,
) -> DataFrame:
    """(ready, columns of ``messages`` in ``carry``, picked values): one row a message, with nothing left to reduce.

    ``keys`` maps columns of ``messages`` to those of ``heard``; both have an event time ``ts``.  ``picks`` maps a prefix
    to (condition on a reception, its columns).  ``ready`` is the message's time plus ``within_ms``, and the event time of what comes out, since
    rows come out that much later.  A message with a null key, or with nothing near, has nulls.
    """
    use_rocksdb(messages)
    names = [f"k{n}" for n in range(len(keys))]
    wanted = list(dict.fromkeys(c for _, cols in picks.values() for c in cols))
    flags = [f"f{n}" for n in range(len(picks))]
    kinds, other = dict(messages.dtypes), dict(heard.dtypes)
    own = messages.withWatermark("ts", late).select(
        "ts", F.unix_millis("ts").alias("ms"), F.lit(0).alias("side"), *[F.col(c).alias(k) for c, k in zip(keys, names)], F.col(times[0]).cast("double").alias("t"), F.col(ids[0]).cast("long").alias("uid"), *carry)
    theirs = heard.withWatermark("ts", late).select(
        "ts", F.unix_millis("ts").alias("ms"), F.lit(1).alias("side"), *[F.col(c).alias(k) for c, k in zip(keys.values(), names)], F.col(times[1]).cast("double").alias("t"), F.col(ids[1]).cast("long").alias("uid"),
        *[F.coalesce(test, F.lit(False)).alias(f) for f, (test, _) in zip(flags, picks.values())], *[F.col(c).alias(f"v_{c}") for c in wanted])
    theirs = theirs.where(" AND ".join(f"{k} IS NOT NULL" for k in names))
    # a message without a key meets nothing; its id spreads such rows
    apart = F.when(F.lit(False), F.lit(0).cast("long"))
    for k in names:
        apart = apart.when(F.col(k).isNull(), F.col("uid"))
    own = own.withColumn("apart", F.coalesce(apart, F.lit(0).cast("long")))
    both = own.unionByName(theirs.withColumn("apart", F.lit(0).cast("long")), allowMissingColumns=True)
    message, values = ["ms", "t", "uid", *carry], ["ms", "t", "uid", *flags, *[f"v_{c}" for c in wanted]]
    keys_of = [*names, "apart"]
    shown = dealt(both, keys_of)
    shown = shown.select(*dict.fromkeys(["bucket", *keys_of, *shown.columns]))
    types = dict(shown.dtypes)
    base = ", ".join([*[f"key{n} {types[k]}" for n, k in enumerate(keys_of)], "ms long, t double, uid long"])
    schemas = (", ".join([base, *[f"{c} {kinds[c]}" for c in carry]]), ", ".join([base, *[f"{f} boolean" for f in flags], *[f"v_{c} {other[c]}" for c in wanted]]))
    places = [(values.index(f), [values.index(f"v_{c}") for c in cols]) for f, (_, cols) in zip(flags, picks.values())]
    out = ["ready timestamp", "t double", "uid long", *[f"{c} {kinds[c]}" for c in carry], *[f"{p}{c} {other[c]}" for p, (_, cols) in picks.items() for c in cols]]
    at = shown.columns.index
    work = Nearest(at("side"), len(keys_of), [at(c) for c in [*keys_of, *message]], [at(c) for c in [*keys_of, *values]], places, schemas, within_ms, [c.split()[0] for c in out])
    return shown.groupBy("bucket").transformWithState(work, ", ".join(out), "append", "eventTime", eventTimeColumnName="ready")
