"""Play events to sessions: a stateful stream, its batch twin, and event-driven refreshes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The share of a song that completes it, and the share under which a jump to the next song is a skip.
COMPLETED, SKIPPED = 80.0, 30.0
EVENTS = "event_id string, session_id string, sha_id string, song_duration_ms long, event_type string, position_ms long, reason string, timestamp timestamp"
SESSIONS = "session_id string, sha_id string, started_at timestamp, ended_at timestamp, duration_played_ms long, song_duration_ms long, completion_percent double, completed boolean, skipped boolean"
_STATE = "sha_id string, started long, ended long, position long, duration long, percent double, completed boolean, skipped boolean"


def step(state: tuple | None, e) -> tuple | None:
    """One event's effect on a session's state; events before the start or after the end have none."""
    at = e.timestamp.value // 1000
    pos = None if pd.isna(e.position_ms) else int(e.position_ms)
    if e.event_type == "start":
        length = None if pd.isna(e.song_duration_ms) else int(e.song_duration_ms)
        return state or (e.sha_id, at, None, pos or 0, length, None, False, False)
    if state is None or state[2] is not None:
        return state
    sha, started, _, last, length, *_ = state
    pos = last if pos is None else pos
    if e.event_type in ("pause", "skip"):
        return (sha, started, None, pos, length, None, False, False)
    if e.event_type == "complete":
        return (sha, started, at, pos, length, min(100.0, pos * 100.0 / length) if length else 100.0, True, False)
    if e.event_type == "end":
        pct = min(100.0, pos * 100.0 / length) if length else 0.0
        return (sha, started, at, pos, length, pct, pct >= COMPLETED, pct < SKIPPED and e.reason == "next_song")
    return state


def _row(session: str, s: tuple) -> pd.DataFrame:
    sha, started, ended, pos, length, pct, completed, skipped = s
    ts = lambda v: pd.NaT if v is None else pd.Timestamp(v, unit="us")
    return pd.DataFrame([{"session_id": session, "sha_id": sha, "started_at": ts(started), "ended_at": ts(ended), "duration_played_ms": pos, "song_duration_ms": length, "completion_percent": pct, "completed": completed, "skipped": skipped}])


def _stateful(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    if group.hasTimedOut:  # abandoned: never ended
        state = tuple(group.get)
        group.remove()
        if state[2] is None:
            yield _row(key[0], state)
        return
    state = tuple(group.get) if group.exists else None
    ended = state is not None and state[2] is not None
    chunks = list(batches)  # one session's events of one trigger, which may come in several chunks
    for e in pd.concat(chunks).sort_values(["timestamp", "event_id"]).itertuples() if chunks else ():
        state = step(state, e)
    if state is not None:
        group.update(state)
        group.setTimeoutTimestamp(max(group.getCurrentWatermarkMs() + 1, state[1] // 1000 + 6 * 3_600_000))
        if state[2] is not None and not ended:
            yield _row(key[0], state)


def sessions_stream(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Sessions as they end, from a stream of events; repeats are dropped within the watermark, abandoned sessions come out un-ended."""
    once = events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("session_id").applyInPandasWithState(_stateful, SESSIONS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sessions_batch(events: DataFrame) -> DataFrame:
    """The same fold over stored events, with the first terminal event of each session found by window functions."""
    e = events.dropDuplicates(["event_id"])
    key = F.struct("timestamp", "event_id")
    first = lambda c, *cols: F.min_by(F.struct(*cols), F.when(c, key))
    terminal = F.col("event_type").isin("complete", "end")
    starts = e.groupBy("session_id").agg(first(F.col("event_type") == "start", "sha_id", "timestamp", "position_ms", "song_duration_ms", "event_id").alias("s")).where("s IS NOT NULL")
    after = e.join(starts, "session_id").where(F.struct("timestamp", "event_id") > F.struct("s.timestamp", "s.event_id"))
    ends = after.groupBy("session_id").agg(first(terminal, "timestamp", "event_id", "event_type", "position_ms", "reason").alias("t"))
    moves = after.join(ends, "session_id").where(F.col("event_type").isin("pause", "skip") & F.col("position_ms").isNotNull() & (F.col("t").isNull() | (F.struct("timestamp", "event_id") < F.struct("t.timestamp", "t.event_id"))))
    last = moves.groupBy("session_id").agg(F.max_by("position_ms", F.struct("timestamp", "event_id")).alias("p"))
    x = starts.join(ends, "session_id", "left").join(last, "session_id", "left")
    pos = F.coalesce("t.position_ms", "p", "s.position_ms", F.lit(0))
    length = F.col("s.song_duration_ms")
    known = length.isNotNull() & (length > 0)
    pct = F.least(F.lit(100.0), pos * 100.0 / F.nullif(length, F.lit(0)))
    done = F.col("t.event_type") == "complete"
    percent = F.when(F.col("t").isNull(), None).when(known, pct).otherwise(F.when(done, 100.0).otherwise(0.0))
    return x.select(
        "session_id", F.col("s.sha_id").alias("sha_id"), F.col("s.timestamp").alias("started_at"), F.col("t.timestamp").alias("ended_at"), pos.cast("long").alias("duration_played_ms"), length.alias("song_duration_ms"), percent.alias("completion_percent"),
        F.coalesce(done | (percent >= COMPLETED), F.lit(False)).alias("completed"), F.coalesce(~done & (percent < SKIPPED) & (F.col("t.reason") == "next_song"), F.lit(False)).alias("skipped"),
    )


#: Fields that a kind of event can change.
PLAYBACK_FIELDS = {"play_count", "last_played", "skip_count", "completion_rate", "last_week_plays", "trending", "declining"}
PREFERENCE_FIELDS = {"is_liked", "is_disliked"}


def affected(playlists: dict[str, set[str]], kinds: set[str]) -> list[str]:
    """Playlists (id to its rule's fields) to refresh after events of some kinds: metadata touches all, playback and preferences those that use them."""
    touched = set(playlists) if "metadata" in kinds else set()
    for kind, fields in (("playback", PLAYBACK_FIELDS), ("preference", PREFERENCE_FIELDS)):
        if kind in kinds:
            touched |= {p for p, used in playlists.items() if used & fields}
    return sorted(touched)


def refresh_on_events(events: DataFrame, playlists: dict[str, set[str]], refresh, checkpoint: str, every: str = "2 seconds"):
    """Start a query that refreshes the affected playlists once a micro-batch; ``refresh`` takes the ids."""

    def batch(df: DataFrame, _: int) -> None:
        kinds = {r[0] for r in df.select("kind").distinct().collect()}  # three kinds
        if ids := affected(playlists, kinds):
            refresh(ids)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def of_types(events: DataFrame, types: list[str] | None) -> DataFrame:
    """Events of some types, stored or streamed; all without a list."""
    return events.where(F.col("event_type").isin(types)) if types else events


def live_overview(changes: DataFrame, overview, show, checkpoint: str, every: str = "30 seconds"):
    """Start a query that shows the headline figures anew after each micro-batch of plays; ``overview`` makes the one-row frame."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            show(overview().first().asDict())

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
