"""Stateful operators of the streams: a flight's predecessors, and flights that fell silent.

Both keep keyed rows in the state store, so that a row touches what lies near it and not all
that its key has: predecessors a row an hour of a flight, silence a row a flight.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from punctuality.params import SETTLED

LATE_MS = 2 * 86_400_000
HOUR = 3_600_000_000
STALE = "STALE"
FLIGHT = ("flight_number", "origin_iata", "destination_iata", "flight_date_local")
SNAP = ("observation_id", "status", "delay_minutes", "gate", "terminal", "scheduled")
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Keyed rows need a store that has them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def plain(x):
    """A value of a pandas cell as JSON knows it."""
    return None if x is None or pd.isna(x) else x if isinstance(x, str) else int(x)


class Predecessors(StatefulProcessor):
    """The rows of a flight whose predecessor is new or not what was told before.

    State: for each hour of the flight its snapshots by time and id, each with how often it was
    told; and which hours there are. A new row reads its own hour and, where it is the first
    or the last of it, the hour next to it. Hours are kept from the last one on that the watermark has
    passed (it has the predecessor of rows still to come), all until the watermark has passed the last by two days.
    A row that is there is no new one."""

    columns = (*FLIGHT, *SNAP, "seen", "data_source", "revision", *(f"p{i}" for i in range(len(SNAP))))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour long", "rows string")
        self.there = handle.getValueState("there", "hours string")

    def _load(self, hour: int) -> list[list]:
        if hour not in self.read:
            self.read[hour] = json.loads(self.hours.getValue((hour,))[0])
        return self.read[hour]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        there: list[int] = json.loads(self.there.get()[0]) if self.there.exists() else []
        self.read: dict[int, list[list]] = {}  # [time, id, snapshot, seen, source, times told]
        new: dict[int, set[int]] = {}
        for part in rows:
            for r in part.itertuples(index=False):
                hour, one = int(r.micros) // HOUR, int(r.observation_id)
                at = bisect_left(there, hour)
                if at == len(there) or there[at] != hour:
                    there.insert(at, hour)
                    self.read[hour] = []
                held = self._load(hour)
                if all(one != h[1] for h in held):
                    new.setdefault(hour, set()).add(one)
                    held.append([int(r.micros), one, [plain(getattr(r, c)) for c in SNAP], r.seen, r.data_source, 0])
        out, changed = [], set(new)
        for hour in new:
            self.read[hour].sort(key=lambda r: (r[0], r[1]))
        for hour, ids in new.items():
            at, held = there.index(hour), self.read[hour]
            before = self._load(there[at - 1])[-1] if at and held[0][1] in ids else None
            for last, row in zip([before, *held], held, strict=False):
                if row[1] in ids or (last is not None and last is not before and last[1] in ids):
                    out.append(self._told(key, row, last))
            follows = there[at + 1] if at + 1 < len(there) else None
            if held[-1][1] in ids and follows is not None:
                row = self._load(follows)[0]
                if row[1] not in new.get(follows, ()):  # else it is told with its own hour
                    out.append(self._told(key, row, held[-1]))
                    changed.add(follows)
        passed = [h for h in there if (h + 1) * HOUR // 1000 <= timerValues.getCurrentWatermarkInMs()]
        for hour in passed[:-1]:
            there.remove(hour)
            changed.discard(hour)
            if self.hours.containsKey((hour,)):
                self.hours.removeKey((hour,))
        for hour in changed:
            self.hours.updateValue((hour,), (json.dumps(self.read[hour]),))
        if there:
            self.there.update((json.dumps(there),))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), (there[-1] + 1) * HOUR // 1000) + LATE_MS)
        yield pd.DataFrame(out, columns=list(self.columns), dtype=object)

    @staticmethod
    def _told(key: tuple, row: list, last: list | None) -> tuple:
        row[5] += 1
        return (*key, *row[2], row[3], row[4], row[5] - 1, *(last[2] if last else (None,) * len(SNAP)))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.hours.clear()
        self.there.clear()
        yield pd.DataFrame([], columns=list(self.columns), dtype=object)

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """Flights that the boards of their origin have stopped telling of, over two inputs: rows of
    flights, and boards that were read (kind "read"). Keys are an origin and a bucket of its
    flights, so that no origin is one task's alone.

    State: of each flight the time, id and status of its last row; and of each hour the flights whose last
    row was of it. A board that was read sets a timer; when the watermark has passed it, all rows
    of before are there, and flights whose last one is open and older than the limit go stale: those
    of the hours that no board before has looked at. Boards that failed set no timer. Flights are
    forgotten when the watermark has passed their last row by two days."""

    columns = (*FLIGHT, "status", "event_type")

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        names = "flight_number string, destination_iata string, flight_date_local string"
        self.flights = handle.getMapState("flights", names, "micros long, observation_id long, status string")
        self.hours = handle.getMapState("hours", "hour long", "flights string")
        self.span = handle.getValueState("span", "hours string, checked long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        newest: dict[tuple, tuple] = {}
        timers = set()
        for part in rows:
            for r in part.itertuples(index=False):
                if r.kind == "read":
                    timers.add(int(r.micros) // 1000)
                    continue
                flight, at = (r.flight_number, r.destination_iata, r.flight_date_local), (int(r.micros), int(r.observation_id), r.status)
                newest[flight] = max(newest.get(flight, at), at)
        there, checked = self._span()
        moved: dict[int, list] = {}
        for flight, at in newest.items():
            held = self.flights.getValue(flight) if self.flights.containsKey(flight) else None
            if held is None or at[:2] > tuple(held[:2]):
                self.flights.updateValue(flight, at)
                if held is None or held[0] // HOUR != at[0] // HOUR:
                    moved.setdefault(at[0] // HOUR, []).append(flight)
        for hour, flights in moved.items():
            old = json.loads(self.hours.getValue((hour,))[0]) if hour in there else []
            self.hours.updateValue((hour,), (json.dumps([*old, *flights]),))
        self.span.update((json.dumps(sorted({*there, *moved})), min([checked, *(h - 1 for h in moved)])))
        for at in timers:
            if at > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(at)
        yield pd.DataFrame([], columns=list(self.columns), dtype=object)

    def _span(self) -> tuple[list[int], int]:
        """The hours that have flights, and the last of them that a board has looked at."""
        held = self.span.get() if self.span.exists() else ("[]", -1)
        return json.loads(held[0]), held[1]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        hour_ms, (there, checked) = HOUR // 1000, self._span()
        due, old = now - self.limit, now - LATE_MS
        for hour in there.copy():
            forget = (hour + 1) * hour_ms <= old
            if hour * hour_ms > due or not (forget or hour > checked):
                continue
            for number, destination, day in json.loads(self.hours.getValue((hour,))[0]):
                flight = (number, destination, day)
                micros, one, status = self.flights.getValue(flight) if self.flights.containsKey(flight) else (None, 0, None)
                if micros is None or micros // HOUR != hour:
                    continue  # it was told again
                if status not in SETTLED and status != STALE and micros // 1000 < due:
                    out.append((number, key[0], destination, day, status, "WENT_STALE"))
                    self.flights.updateValue(flight, (micros, one, STALE))
                if forget:
                    self.flights.removeKey(flight)
            if forget:
                self.hours.removeKey((hour,))
                there.remove(hour)
            if (hour + 1) * hour_ms <= due:
                checked = max(checked, hour)
        self.span.update((json.dumps(there), checked))
        yield pd.DataFrame(out, columns=list(self.columns), dtype=object)

    def close(self) -> None:
        pass
