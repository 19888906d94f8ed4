"""Status tracking as Structured Streaming.

Observations (id, status, conclusion, observed_at, run_id) arrive in micro-batches. A key's state is its last
status and how often it was seen; a final row is emitted once, on completion or on time-out by event
time, so results do not depend on when batches happen to run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarryline.sources.versions import BUCKETS, merge_batch

FINAL = "id string, outcome string, polls int, first_seen timestamp, last_seen timestamp"
STATE = "polls int, first_seen timestamp, last_seen timestamp, done boolean"
WINDOW_MINUTES = 375


def track(observations: DataFrame, window_minutes: int = WINDOW_MINUTES, late: str = "1 hour") -> DataFrame:
    """One final row per id: its conclusion when completed, ``timed_out`` when the window passes first."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            polls, first, last, done = state.get
            state.remove()
            if not done:
                yield pd.DataFrame({"id": [key[0]], "outcome": ["timed_out"], "polls": [polls], "first_seen": [first], "last_seen": [last]})
            return
        polls, first, last, done = state.get if state.exists else (0, None, None, False)
        rows = pd.concat(list(batches)).sort_values("observed_at", kind="stable")
        outcome = None
        if not done:
            over = (rows["status"] == "completed").to_numpy()
            rows = rows.iloc[: int(over.argmax()) + 1] if over.any() else rows
            polls += len(rows)
            first = rows["observed_at"].min() if first is None else min(first, rows["observed_at"].min())
            last = rows["observed_at"].max() if last is None else max(last, rows["observed_at"].max())
            if over.any():
                done, outcome = True, rows["conclusion"].iloc[-1]
        state.update((polls, first, last, done))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(first).timestamp() * 1000) + window_minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        if outcome is not None:
            yield pd.DataFrame({"id": [key[0]], "outcome": [outcome], "polls": [polls], "first_seen": [first], "last_seen": [last]})

    keyed = observations.filter("id is not null and observed_at is not null").withWatermark("observed_at", late)
    return keyed.groupBy("id").applyInPandasWithState(step, FINAL, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def final_status(observations: DataFrame) -> DataFrame:
    """The same by a batch query: first completed observation per id, else the last one seen as waiting."""
    done = F.when(F.col("status") == "completed", F.struct("observed_at", "conclusion"))
    out = observations.filter("id is not null and observed_at is not null").groupBy("id").agg(F.min(done).alias("d"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_any"), F.count("*").alias("n"))
    return out.select("id", F.coalesce("d.conclusion", F.lit("waiting")).alias("outcome"), "first_seen", F.coalesce("d.observed_at", "last_any").alias("last_seen"))


def delays(runs: DataFrame) -> DataFrame:
    """Seconds of waiting, running and until detection from created_at, started_at, updated_at, observed_at."""
    between = lambda a, b: (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1e6
    return runs.withColumn("queue_s", between("created_at", "started_at")).withColumn("run_s", between("started_at", "updated_at")).withColumn("detect_s", between("updated_at", "observed_at"))


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = BUCKETS):  # noqa: ANN201
    """Keeps the newest row per key under ``path`` (read by ``versions.read_table``). A batch rewrites the buckets that it touches; a repeated batch and a crash at any point lose and change nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, path, keys, order, buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, width: str, slide: str | None, by: list[str], late: str = "1 day") -> DataFrame:
    """Counts per event-time window, tumbling or sliding; the same plan in batch and streaming."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str = "1 day") -> DataFrame:
    """Sessions of a key that end after a gap without events."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")
