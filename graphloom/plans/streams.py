"""Queries over event time and sessions, in batch; tests run the same functions on streams."""

from __future__ import annotations

from ..streaming import incremental
from .fixture import table
from .registry import query


@query("t7_windows", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2")
def t7(spark, d):
    return incremental.windowed(table(spark, d, "events"))


@query("t7_sliding", "SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w, date_trunc('day', ts) AS d FROM events) GROUP BY 1")
def t7s(spark, d):
    return incremental.sliding(table(spark, d, "events"))


@query("t7_sessions", "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, g")
def t7n(spark, d):
    return incremental.sessions(table(spark, d, "events"))


@query("t6_conversations", "SELECT conv_id, list(role || ': ' || text ORDER BY turn, role, text) AS history FROM conversations GROUP BY 1")
def t6(spark, d):
    return incremental.conversation_history(table(spark, d, "conversations"))
