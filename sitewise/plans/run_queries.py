"""Rate and failure plans over the events log: a user is a client, an event a call."""

from pyspark.sql import functions as F

from sitewise.operators import runs
from sitewise.plans.registry import query, table

_RATE = """
WITH c AS (
  SELECT event_id, user_id, ts,
         count(*) OVER (PARTITION BY user_id ORDER BY ts
                        RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n,
         count(*) OVER (PARTITION BY user_id, ts) AS ties,
         row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS place
  FROM events)
SELECT event_id, user_id AS client, n - 1 - (ties - place) AS in_window,
       n - 1 - (ties - place) >= 2 AS at_limit
FROM c
"""

_STREAK = """
WITH o AS (
  SELECT event_id, user_id, event_type = 'error' AS failed,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
k AS (SELECT *, max(CASE WHEN NOT failed THEN place END)
        OVER (PARTITION BY user_id ORDER BY place) AS ok FROM o)
SELECT event_id, user_id AS client, (place - coalesce(ok, 0))::BIGINT AS streak,
       place - coalesce(ok, 0) >= 3 AS opens
FROM k
"""


def _calls(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("client"), (F.col("event_type") == "error").alias("failed")
    )


@query("rate_window", _RATE)
def rate_window(spark, folder):
    calls = _calls(spark, folder).drop("failed")
    return runs.rate_window(calls, limit=2, frame_seconds=3600).select(
        "event_id", "client", "in_window", "at_limit"
    )


@query("failure_streak", _STREAK)
def failure_streak(spark, folder):
    return runs.failure_streak(_calls(spark, folder), threshold=3).select(
        "event_id", "client", "streak", "opens"
    )
