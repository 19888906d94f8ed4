"""Queries of status tracking and event time (R of the inventory), by the batch plan of each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.plans import base
from quarryline.plans.registry import Registry
from quarryline.session import table
from quarryline.streaming import status as op

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "purchase", "completed").otherwise("in_progress")
    return e.select(F.col("user_id").cast("string").alias("id"), state.alias("status"), F.lit("success").alias("conclusion"), F.col("ts").alias("observed_at"))


@_R.add("r01_final_status", "WITH o AS (SELECT CAST(user_id AS VARCHAR) AS id, event_type = 'purchase' AS done, ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) SELECT id, CASE WHEN bool_or(done) THEN 'success' ELSE 'waiting' END AS outcome, min(ts) AS first_seen, coalesce(min(ts) FILTER (done), max(ts)) AS last_seen FROM o GROUP BY 1")
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final state of every key."""
    return op.final_status(_observations(spark, sf_dir))


@_R.add("r04_waiting", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 95 AND user_id IS NOT NULL)")
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is waiting, derived anew from the source."""
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    return e.select("user_id").distinct().join(e.filter("event_type = 'error' and value > 95").select("user_id"), "user_id", "left_anti").select(F.col("user_id").cast("string").alias("id"))


@_R.add("r08_delays", "SELECT DISTINCT call_id, (epoch_us(ingested_at) - epoch_us(called_at)) / 1000000.0 AS delay_s FROM llm_call_record WHERE called_at IS NOT NULL AND ingested_at IS NOT NULL")
def r08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event time to arrival time."""
    rows = base.calls(spark, sf_dir).filter("called_at is not null and ingested_at is not null")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.select("call_id", ((us("ingested_at") - us("called_at")) / 1e6).alias("delay_s")).distinct()


@_R.add("r11_tumbling_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.windowed_counts(table(spark, sf_dir, "events").select("ts", "event_type"), "ts", "6 hours", None, ["event_type"])


@_R.add("r12_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sessions(table(spark, sf_dir, "events").select("ts", "user_id"), "ts", "2 hours", ["user_id"])
