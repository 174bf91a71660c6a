"""Queries for the streaming operators, on the batch of all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times as T
from ..sources import bindings as B
from ..sources.scratch import shared_path
from ..streaming import live as S
from .base import query, rounded


def _events(spark, sf_dir):
    return B.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _local(df, *times):
    """Timestamps as zone-free ones, as the oracle has them."""
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c in times else F.col(c) for c in df.columns))


@query("t01_tumbling", "SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 3) AS total, round(max(value), 3) AS most FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    """T01."""
    return _local(rounded(S.tumbling(_events(spark, sf_dir)), 3), "start")


@query("t02_sliding", "SELECT user_id, date_trunc('hour', ts) - to_hours(CAST(i AS INT)) AS start, count(*) AS n, round(sum(value), 3) AS total FROM events CROSS JOIN (SELECT unnest(range(4)) AS i) GROUP BY ALL")
def sliding(spark, sf_dir):
    """T02."""
    return _local(rounded(S.sliding(_events(spark, sf_dir)), 3), "start")


@query(
    "t03_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, sid""",
)
def sessions(spark, sf_dir):
    """T03."""
    return _local(S.sessions(_events(spark, sf_dir)), "start", "end")


@query(
    "t04_paired_sessions",
    f"""WITH {B.EV}, sc AS (SELECT user_id, ms, event_type = 'click' AS opens, event_id FROM ev WHERE event_type IN ('click', 'view')), l AS (SELECT *, lag(opens) OVER w AS before, lag(ms) OVER w AS start_ms FROM sc WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))
    SELECT user_id, start_ms, ms AS end_ms FROM l WHERE NOT opens AND before AND ms > start_ms AND ms - start_ms <= 10800000""",
)
def paired(spark, sf_dir):
    """A stream over the events, run to its end, with the open unlock of each user as state."""
    ev = S.source(spark, f"{sf_dir}/events.parque[t]")  # a pattern: a stream's plain path would have to be a folder
    states = ev.where(F.col("event_type").isin("click", "view")).select("user_id", "ts", T.epoch_ms(F.col("ts")).alias("ms"), F.when(F.col("event_type") == "click", "unlocked").otherwise("locked").alias("state"), "event_id")
    with S.with_state_store(spark):
        return S.run_to_table(S.paired_sessions(states), shared_path(spark, "paired"), shared_path(spark, "paired-checkpoint"))


@query("t05_prompt_signal_join", "SELECT p.event_id AS prompt_id, p.user_id, s.event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') s ON s.user_id = p.user_id AND s.ts >= p.ts - INTERVAL 4 HOUR AND s.ts < p.ts")
def prompt_signals(spark, sf_dir):
    """T05, J02."""
    return S.prompts_with_signals(_events(spark, sf_dir))


@query("t06_latest", "SELECT user_id, event_type, date_trunc('hour', ts) AS start, arg_max(event_id, (value, event_id)) AS event_id, max(value) AS value FROM events GROUP BY ALL")
def latest(spark, sf_dir):
    """T06."""
    return _local(S.latest(_events(spark, sf_dir)), "start")
