"""Streaming queries; their SQL is the batch result."""

from __future__ import annotations

from ..session import table
from ..streaming import responses as r


def queries() -> dict:
    stream = lambda s, d: r.response_stream(s, d, "events.parquet")
    return {
        "stream_daily_grades": lambda s, d: r.run_available(r.daily_grades(stream(s, d)), "daily", ["day", "category"]),
        "stream_sliding_activity": lambda s, d: r.run_available(r.sliding_activity(stream(s, d)), "sliding", ["start"]),
        "daily_grades": lambda s, d: r.daily_grades(table(s, d, "events")),
        "stream_sessions": lambda s, d: r.stream_sessions(stream(s, d)),
        "session_activity": lambda s, d: r.session_activity(table(s, d, "events")),
    }


def oracle_sql() -> dict[str, str]:
    daily = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS category, count(*) AS total, count(*) FILTER (value >= 20) AS correct FROM events GROUP BY ALL"
    sessions = """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
          b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM b GROUP BY user_id, k"""
    return {
        "stream_sessions": sessions + " HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
        "session_activity": sessions,
        "stream_daily_grades": daily,
        "daily_grades": daily,
        "stream_sliding_activity": "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1",
    }
