"""Streams with state of their own kinds: exact sessions, listening streaks and bounded batches of changes.

The processors keep list, map and value states with timers, as transformWithState gives them; their state lives in RocksDB
(:func:`use_rocksdb`), so it may outgrow memory and survives a restart with the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from listenlake.streaming.playback import PREFERENCE_FIELDS, SESSIONS, _row, affected, step

#: Hours until a session without end is given up, seconds and events until a batch of changes is handed on.
ABANDONED_H, DEBOUNCE_S, BATCH_EVENTS = 6, 2, 200
_KEPT = "event_id string, sha_id string, song_duration_ms long, event_type string, position_ms long, reason string, at long"
STREAKS = "user_id long, start_date date, end_date date, length_days long, gone boolean"
BATCHES = "library string, kinds array<string>, events long, preferences_known boolean"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _folded(events: Iterable[tuple]) -> tuple | None:
    """A session's state after its events in order of time; of repeated event ids the first counts."""
    state, once = None, {}
    for e in events:
        once.setdefault(e[0], e)
    for event_id, sha_id, length, kind, position, reason, at in sorted(once.values(), key=lambda e: (e[6], e[0])):
        state = step(state, SimpleNamespace(event_id=event_id, sha_id=sha_id, song_duration_ms=length, event_type=kind, position_ms=position, reason=reason, timestamp=pd.Timestamp(at, unit="us")))
    return state


class Sessions(StatefulProcessor):
    """Keeps a session's events until no earlier one can come, then folds them in order of time: late events count as if they were in time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", _KEPT)
        self.closed = handle.getValueState("closed", "at long")

    def _keep(self, rows: pd.DataFrame) -> None:
        null = lambda v: None if pd.isna(v) else v
        number = lambda v: None if pd.isna(v) else int(v)
        for r in rows.itertuples():
            self.events.appendValue((r.event_id, null(r.sha_id), number(r.song_duration_ms), r.event_type, number(r.position_ms), null(r.reason), r.timestamp.value // 1000))

    def _wake(self, timers) -> None:
        """One timer: when the watermark passes the session's end, or when it is given up."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        held = list(self.events.get())
        state = _folded(held)
        if state is not None and state[2] is not None:
            at = state[2] // 1000 + 1
        else:
            at = min(e[6] for e in held) // 1000 + ABANDONED_H * 3_600_000
        self.handle.registerTimer(max(at, timers.getCurrentWatermarkInMs() + 1))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._keep(initialState)
        self._wake(timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.closed.exists():
            for part in rows:
                self._keep(part)
            self._wake(timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.closed.exists():
            self.closed.clear()
            return
        state = _folded(self.events.get())
        self.events.clear()
        if state is not None:
            if state[2] is not None:  # later events of an ended session have no effect while it is remembered
                self.closed.update((state[2],))
                self.handle.registerTimer(max(state[2] // 1000 + ABANDONED_H * 3_600_000, timerValues.getCurrentWatermarkInMs() + 1))
            yield _row(key[0], state)

    def close(self) -> None: ...


def exact_sessions(events: DataFrame, late: str = "2 hours", open_events: DataFrame | None = None) -> DataFrame:
    """Sessions from a stream of events, as the batch fold makes them, once the watermark has passed their end.

    ``open_events`` are stored events of sessions that had not ended when the stream begins anew (a new checkpoint). Sessions without an
    end come out un-ended when they are given up; events without a start make none.
    """
    marked = events.withWatermark("timestamp", late).groupBy("session_id")
    initial = None if open_events is None else open_events.groupBy("session_id")
    return marked.transformWithStateInPandas(Sessions(), SESSIONS, "Append", "EventTime", initialState=initial)


class Streaks(StatefulProcessor):
    """Keeps a listener's runs of days; a day that comes late grows a run or joins two."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "first int", "last int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = {k[0]: v[0] for k, v in self.runs.iterator()}
        ends = {last: first for first, last in runs.items()}
        old = dict(runs)
        for day in sorted({int(d) for part in rows for d in part["day"]}):
            if any(first <= day <= last for first, last in runs.items()):
                continue
            first, last = ends.pop(day - 1, day), runs.pop(day + 1, day)
            runs[first], ends[last] = last, first
        changed = [(k, v) for k, v in runs.items() if old.get(k) != v]
        gone = [k for k in old if k not in runs]
        for k in gone:
            self.runs.removeKey((k,))
        for k, v in changed:
            self.runs.updateValue((k,), (v,))
        date = lambda n: pd.Timestamp(n, unit="D").date()
        out = [(key[0], date(a), date(b), b - a + 1, False) for a, b in changed] + [(key[0], date(k), date(old[k]), old[k] - k + 1, True) for k in gone]
        if out:
            yield pd.DataFrame(out, columns=["user_id", "start_date", "end_date", "length_days", "gone"])

    def close(self) -> None: ...


def _listening_days(plays: DataFrame) -> DataFrame:
    """(user_id, day): days since 1970 with a play that was completed or reached 10 percent."""
    return plays.where("completed OR completion_percent >= 10").select("user_id", F.unix_date(F.to_date("started_at")).alias("day")).where("user_id IS NOT NULL AND day IS NOT NULL")


def streaks_stream(plays: DataFrame) -> DataFrame:
    """Changes of each listener's runs of days (update mode): a run by its first day, as it is now, or ``gone`` where a late day joined it to an earlier one."""
    return _listening_days(plays).groupBy("user_id").transformWithStateInPandas(Streaks(), STREAKS, "Update", "None")


def user_streaks(plays: DataFrame) -> DataFrame:
    """The runs of days of each listener in stored plays: (user_id, start_date, end_date, length_days)."""
    days = _listening_days(plays).distinct()
    island = days.withColumn("k", F.col("day") - F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    runs = island.groupBy("user_id", "k").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count(F.lit(1)).cast("long").alias("length_days"))
    return runs.select("user_id", F.date_from_unix_date("a").alias("start_date"), F.date_from_unix_date("b").alias("end_date"), "length_days")


class Batches(StatefulProcessor):
    """Gathers changes until ``seconds`` have passed since the first or ``most`` have come; remembers whether preferences ever came."""

    def __init__(self, seconds: float, most: int):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "kinds array<string>, events long")
        self.known = handle.getValueState("preferences", "known boolean")

    def _batch(self, key, kinds: set, events: int) -> pd.DataFrame:
        return pd.DataFrame([{"library": key[0], "kinds": sorted(kinds), "events": events, "preferences_known": self.known.exists()}])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else ([], 0)
        kinds, events, out = set(held[0]), held[1], []
        for part in rows:
            for kind in part["kind"]:
                kinds.add(kind)
                events += 1
                if kind == "preference" and not self.known.exists():
                    self.known.update((True,))
                if events == self.most:
                    out.append(self._batch(key, kinds, events))
                    kinds, events = set(), 0
        if out or not held[1]:  # the time runs from the first change that is held
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if events:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.seconds * 1000))
        if events:
            self.held.update((sorted(kinds), events))
        else:
            self.held.clear()
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            kinds, events = self.held.get()
            self.held.clear()
            yield self._batch(key, set(kinds), events)

    def close(self) -> None: ...


def batched_changes(events: DataFrame, seconds: float = DEBOUNCE_S, most: int = BATCH_EVENTS) -> DataFrame:
    """Changes (library, kind) of a stream in batches (library, kinds, events, preferences_known)."""
    return events.groupBy("library").transformWithStateInPandas(Batches(seconds, most), BATCHES, "Append", "ProcessingTime")


def to_refresh(playlists: dict[str, set[str]], kinds: set[str], preferences_known: bool) -> list[str]:
    """The playlists that a batch touches; those that ask for preferences wait until any were seen."""
    return [p for p in affected(playlists, kinds) if preferences_known or not playlists[p] & PREFERENCE_FIELDS]


def refresh_on_batches(events: DataFrame, playlists: dict[str, set[str]], refresh, checkpoint: str, seconds: float = DEBOUNCE_S, most: int = BATCH_EVENTS):
    """Start a query that refreshes what each batch of changes touches; ``refresh`` takes a library and ids."""

    def run(df: DataFrame, _: int) -> None:
        for r in df.collect():  # a row a batch and library
            if ids := to_refresh(playlists, set(r.kinds), r.preferences_known):
                refresh(r.library, ids)

    return batched_changes(events, seconds, most).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start()
