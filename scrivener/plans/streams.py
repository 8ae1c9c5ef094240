"""Batch twins of the timed streams, over events: a user is a job or a group, an event a message, a task or a call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.operators import jobs as J
from scrivener.plans.jobs import STATE_SQL
from scrivener.registry import query
from scrivener.session import table

SENT_SQL = "CASE event_type WHEN 'error' THEN 'done' WHEN 'click' THEN 'progress' ELSE 'log' END"


@query(
    "subscription_heartbeats",
    f"""WITH e AS (SELECT user_id, event_id, ts, {SENT_SQL} AS kind FROM events),
w AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following, count(*) FILTER (kind = 'done') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dones, max(ts) OVER () AS until FROM e),
s AS (SELECT * FROM w WHERE dones = 0)
SELECT user_id, ts AS sent_at, kind, event_id FROM s
UNION ALL SELECT user_id, sent_at, 'heartbeat', NULL FROM (SELECT user_id, unnest(generate_series(ts + INTERVAL 90 MINUTE, coalesce(following, until), INTERVAL 90 MINUTE)) AS sent_at, following FROM s WHERE kind <> 'done') WHERE following IS NULL OR sent_at < following""",
)
def subscription_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What subscribers get: events up to the first done, and a heartbeat after each ninety minutes of silence."""
    events = table(spark, sf_dir, "events").withColumn("kind", F.expr(SENT_SQL)).select("user_id", "event_id", "ts", "kind")
    until = F.broadcast(events.agg(F.max("ts").alias("until")))  # one row
    return J.heartbeats(events.crossJoin(until), "user_id", "event_id", "ts", "kind", "90 MINUTES", F.col("until")).withColumnsRenamed({"sequence": "event_id", "at": "sent_at"})


@query(
    "task_retention",
    f"""WITH t AS (SELECT user_id, event_id, ts, {STATE_SQL} AS status, (SELECT max(ts) FROM events) AS now FROM events),
f AS (SELECT *, ts <= now - INTERVAL 20 DAY AS old FROM t JOIN (SELECT event_id, value < 5 AS watched FROM events) USING (event_id) WHERE status IN ('completed', 'failed') AND NOT watched),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, old ORDER BY ts DESC, event_id DESC) AS place FROM f)
SELECT user_id, event_id, CASE WHEN old THEN 'expired' ELSE 'overflow' END AS reason FROM r WHERE old OR place > 12""",
)
def task_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished tasks that go: after twenty days, and beyond the newest twelve of a user; watched ones stay."""
    events = table(spark, sf_dir, "events").withColumn("status", F.expr(STATE_SQL))
    tasks = events.select("user_id", "event_id", "ts", "status", (F.col("value") < 5).cast("int").alias("watchers"))
    tasks = tasks.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))  # one row
    return J.retention(tasks, "event_id", "user_id", F.col("status"), F.col("ts"), F.col("ts"), F.col("watchers"), F.col("now"), "20 DAYS", 12).select("user_id", "event_id", "reason")


@query(
    "guarded_calls",
    """WITH c AS (SELECT user_id, event_id, coalesce((props->>'$.k')::BIGINT, 0) AS tokens, event_type NOT IN ('error', 'purchase') AS ok, CASE WHEN event_type = 'purchase' THEN 'authentication' ELSE 'timeout' END AS category FROM events),
n AS (SELECT *, row_number() OVER o AS n, sum(tokens) OVER o AS total, count(*) OVER (o ROWS 11 PRECEDING) AS seen, avg((NOT ok)::INT) OVER (o ROWS 11 PRECEDING) AS rate, sum((ok OR category <> 'authentication')::INT) OVER o AS run FROM c WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, count(*) FILTER (NOT ok AND category = 'authentication') OVER (PARTITION BY user_id, run ORDER BY event_id) AS fatal FROM n),
t AS (SELECT *, CASE WHEN n > 40 THEN 'request_budget_exceeded' WHEN total > 1500 THEN 'input_token_budget_exceeded' END AS before, CASE WHEN fatal >= 3 THEN 'consecutive_authentication' WHEN seen >= 8 AND rate > 0.6 THEN 'failure_rate_exceeded' END AS after FROM f),
g AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY user_id ORDER BY event_id), before) AS opened FROM t),
r AS (SELECT user_id, event_id, coalesce(first_value(opened IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), '') AS reason FROM g)
SELECT user_id, event_id, reason, reason <> '' AS refused FROM r""",
)
def guarded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that a job's budgets or its circuit breaker refuse."""
    calls = table(spark, sf_dir, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("long"))
    failed = F.col("event_type").isin("error", "purchase")
    category = F.when(F.col("event_type") == "purchase", "authentication").otherwise("timeout")
    rows = J.guarded(calls, "user_id", "event_id", F.col("tokens"), ~failed, category, requests=40, most_tokens=1500, window=12, least=8, rate=0.6, fatal=3)
    return rows.select("user_id", "event_id", "reason", "refused")
