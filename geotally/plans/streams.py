"""Windowed and session counts; the same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from geotally.plans.base import Tables
from geotally.plans.registry import query
from geotally.streaming.windows import sessions, windowed_counts


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1, 2")
def daily_windows(t: Tables) -> DataFrame:
    """Daily counts by type."""
    from pyspark.sql import functions as F

    return windowed_counts(t.events).withColumn("total", F.col("total").cast("double"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(t: Tables) -> DataFrame:
    """Sessions of users, twelve hours apart."""
    return sessions(t.events, gap="12 hours")
