"""Job and event-log queries over events: a user is a job, the event type its state or kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.operators import jobs as J
from scrivener.operators import records as R
from scrivener.registry import query
from scrivener.session import table

STATES = {"view": "queued", "click": "running", "signup": "completed", "error": "failed", "purchase": "cancelling"}
STATE_SQL = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelling' END"
KIND_SQL = "CASE event_type WHEN 'view' THEN 'log' WHEN 'click' THEN 'progress' WHEN 'signup' THEN 'result' WHEN 'error' THEN 'error' ELSE 'log' END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.withColumn("status", F.expr(STATE_SQL)).withColumn("kind", F.expr(KIND_SQL)).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@query(
    "usage_summary",
    """SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures, sum(coalesce(k, 0))::BIGINT AS prompt_tokens, sum(CASE WHEN event_type = 'view' THEN 0 ELSE 3 END)::BIGINT AS completion_tokens,
sum(coalesce(CASE WHEN k % 2 = 0 THEN k * 2 END, coalesce(k, 0) + CASE WHEN event_type = 'view' THEN 0 ELSE 3 END))::BIGINT AS total_tokens FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events) GROUP BY user_id""",
)
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, failures and tokens per job."""
    k = F.col("k")
    completion = F.when(F.col("event_type") != "view", F.lit(3).cast("long"))
    return J.usage(_events(spark, sf_dir), F.col("event_type") != "error", k, completion, F.when(k % 2 == 0, k * 2), ["user_id"])


@query("error_histogram", "SELECT coalesce(CASE WHEN value > 50 THEN 'slow' WHEN value > 10 THEN 'bad' END, 'unknown') AS category, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by category, most first."""
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return J.histogram(errors, F.when(F.col("value") > 50, "slow").when(F.col("value") > 10, "bad")).orderBy(F.desc("n"), "category")


@query("latest_state", f"SELECT user_id, arg_max({STATE_SQL}, event_id) AS status, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's state after its last event."""
    return J.latest_state(_events(spark, sf_dir), "user_id", "event_id", "status")


@query("latest_active_per_key", f"SELECT user_id, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM (SELECT *, {STATE_SQL} AS status FROM events) WHERE status IN ('queued', 'running', 'cancelling')) WHERE r = 1")
def latest_active_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest active job per key."""
    return J.latest_active(_events(spark, sf_dir).select("user_id", "event_id", "status"), ["user_id"], "status", F.col("event_id"))


@query("trim_last_n_events", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 10")
def trim_last_n_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest ten events of each job."""
    return R.keep_newest(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], F.col("event_id"), 10)


@query(
    "stale_jobs",
    f"""WITH j AS (SELECT user_id, arg_max({STATE_SQL}, event_id) AS status, max(ts) FILTER (event_type = 'click') AS beat, min(ts) AS started FROM events GROUP BY user_id), m AS (SELECT max(ts) AS t FROM events)
SELECT user_id, CASE WHEN status IN ('running', 'cancelling') AND coalesce(beat, started) < t - INTERVAL 2 HOUR THEN 'interrupted' ELSE status END AS state FROM j, m""",
)
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by state; active ones without a sign of life for two hours are interrupted."""
    events = _events(spark, sf_dir)
    jobs = events.groupBy("user_id").agg(F.max_by("status", "event_id").alias("status"), F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("beat"), F.min("ts").alias("started"))
    now = F.broadcast(events.agg(F.max("ts").alias("now")))  # one row
    return J.stale(jobs.crossJoin(now), F.col("status"), ["beat", "started"], F.col("now") - F.expr("INTERVAL 2 HOURS")).select("user_id", "state")


@query("progress_fold", "SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS stage, arg_max(event_type, event_id) FILTER (value > 20) AS message FROM events GROUP BY user_id")
def progress_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's last stage and message that are set."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("stage"), F.when(F.col("value") > 20, F.col("event_type")).alias("message"))
    return J.fold_progress(events, "user_id", "event_id", ["stage", "message"])


@query(
    "failure_window",
    """WITH f AS (SELECT user_id, event_id, (event_type = 'error')::INT AS f FROM events), w AS (SELECT *, avg(f) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING) AS rate, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING) AS c, sum(1 - f) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f)
SELECT user_id, event_id, round(rate, 4) AS rate, c = 10 AND rate > 0.3 AS open, sum(f) OVER (PARTITION BY user_id, run ORDER BY event_id)::BIGINT AS consecutive FROM w""",
)
def failure_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure rate of each job's last ten events, open circuits and runs of failures."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return J.failure_window(events, "user_id", "event_id", F.col("event_type") == "error", 10, 0.3).select("user_id", "event_id", F.round("rate", 4).alias("rate"), "open", "consecutive")


@query(
    "history_overflow",
    f"""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM (SELECT *, {STATE_SQL} AS status FROM events) WHERE status IN ('completed', 'failed')) WHERE r > 20 OR value < 1""",
)
def history_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished jobs beyond the newest twenty of a key, and expired ones."""
    return J.overflow(_events(spark, sf_dir), F.col("status"), F.col("event_id"), 20, F.col("value") < 1, ["user_id"]).select("user_id", "event_id")


CRITICAL_SQL = "('job', 'result', 'error', 'done')"


@query(
    "event_buffer_twin",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id AS s, {KIND_SQL} AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT user_id, 0::BIGINT AS r, []::STRUCT(s BIGINT, k VARCHAR, d BIGINT)[] AS held, 0::BIGINT AS dropped FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, r, CASE WHEN kept IS NULL THEN held ELSE list_append(kept, {{'s': s, 'k': k, 'd': dropped}}) END, dropped + (crowded AND k = 'log')::BIGINT FROM (
 SELECT *, CASE WHEN k IN {CRITICAL_SQL} OR NOT crowded THEN CASE WHEN len(held) >= 32 AND oldest IS NOT NULL THEN list_filter(held, lambda x: x.s <> oldest) ELSE held END
   WHEN k = 'progress' AND newest IS NOT NULL THEN list_filter(held, lambda x: x.s <> newest) END AS kept FROM (
 SELECT f.user_id, e.r, f.held, f.dropped, e.s, e.k, len(list_filter(f.held, lambda x: x.k NOT IN {CRITICAL_SQL})) >= 28 AS crowded, list_min(list_transform(list_filter(f.held, lambda x: x.k NOT IN {CRITICAL_SQL}), lambda x: x.s)) AS oldest,
   list_max(list_transform(list_filter(f.held, lambda x: x.k = 'progress'), lambda x: x.s)) AS newest FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)))
SELECT user_id, h.s AS event_id, h.k AS kind, h.d AS dropped FROM (SELECT user_id, unnest(held) AS h FROM (SELECT user_id, arg_max(held, r) AS held FROM f GROUP BY user_id))""",
)
def event_buffer_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bounded buffer of thirty-two events holds for each job."""
    return J.bounded_buffer(_events(spark, sf_dir).select("user_id", "event_id", "kind"), "user_id", "event_id", "kind", 32)


@query("event_cursor", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 1200 AND user_id = 7 ORDER BY event_id LIMIT 50")
def event_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a job's events after a cursor."""
    return table(spark, sf_dir, "events").filter("event_id > 1200 and user_id = 7").orderBy("event_id").limit(50).select("event_id", "user_id", "event_type")


@query("queued_fifo", f"SELECT event_id, user_id FROM events WHERE {STATE_SQL} = 'queued' ORDER BY ts, event_id LIMIT 100")
def queued_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting jobs, the oldest first."""
    return _events(spark, sf_dir).filter("status = 'queued'").orderBy("ts", "event_id").limit(100).select("event_id", "user_id")


@query("auto_resume", "SELECT user_id, sum(n) FILTER (category <> 'purchase')::BIGINT AS transient, coalesce(sum(n) FILTER (category = 'purchase'), 0)::BIGINT AS fatal, coalesce(sum(n) FILTER (category <> 'purchase'), 0) > 0 AND coalesce(sum(n) FILTER (category = 'purchase'), 0) <= 15 AS resume FROM (SELECT user_id, event_type AS category, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def auto_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a job's failures allow it to go on."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("category")).agg(F.count("*").alias("n"))
    return J.auto_resume(counts, "user_id", "category", "n", ["view", "click", "signup", "error"], 15)


@query("dedupe_within_window", "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY event_type, user_id, time_bucket(INTERVAL 1 HOUR, ts)")
def dedupe_within_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of a kind per job and hour."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type", "user_id", F.window("ts", "1 hour")).agg(F.min("event_id").alias("event_id")).select("event_type", "user_id", "event_id")


@query("outcome_counters", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def outcome_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by outcome, one column each."""
    kinds = ["click", "error", "purchase"]
    counted = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return counted.select("user_id", *(F.coalesce(k, F.lit(0)).alias(k) for k in kinds))
