"""Job and event-log operators: latest state, trimming, stale jobs, usage, failure windows, bounded buffers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("queued", "running", "cancelling")
TERMINAL = ("completed", "failed", "cancelled", "interrupted")
CRITICAL = ("job", "result", "error", "done")
#: Failures after which another call fails too.
FATAL = ("authentication", "quota_exhausted", "not_found")


def latest_state(events: DataFrame, job: str, sequence: str, state: str) -> DataFrame:
    """The state of each job after its last event."""
    return events.groupBy(job).agg(F.max_by(state, sequence).alias(state), F.max(sequence).alias(sequence))


def latest_active(jobs: DataFrame, key: Sequence[str], status: str, newest: Column, active: Sequence[str] = ACTIVE) -> DataFrame:
    """The newest active job of each key."""
    return jobs.filter(F.col(status).isin(*active)).groupBy(*key).agg(F.max_by(F.struct(*jobs.columns), newest).alias("__r")).select("__r.*")


def stale(jobs: DataFrame, status: Column, beats: Sequence[str], before: Column) -> DataFrame:
    """Adds state: an active job whose last sign of life is too old is interrupted."""
    return jobs.withColumn("state", F.when(status.isin("running", "cancelling") & (F.coalesce(*beats) < before), "interrupted").otherwise(status))


def fold_progress(events: DataFrame, job: str, sequence: str, fields: Sequence[str]) -> DataFrame:
    """Per job the last value of each field that isn't null."""
    return events.groupBy(job).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(sequence))).alias(f) for f in fields))


def usage(calls: DataFrame, ok: Column, prompt: Column, completion: Column, total: Column, by: Sequence[str] = ()) -> DataFrame:
    """Calls, failures and tokens; a missing total is prompt plus completion."""
    zero = F.lit(0)
    return calls.groupBy(*by).agg(
        F.count("*").alias("calls"),
        F.count_if(~ok).alias("failures"),
        F.sum(F.coalesce(prompt, zero)).alias("prompt_tokens"),
        F.sum(F.coalesce(completion, zero)).alias("completion_tokens"),
        F.sum(F.coalesce(total, F.coalesce(prompt, zero) + F.coalesce(completion, zero))).alias("total_tokens"),
    )


def histogram(df: DataFrame, category: Column) -> DataFrame:
    return df.groupBy(F.coalesce(category, F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


def failure_window(events: DataFrame, group: str, order: str, failed: Column, width: int, limit: float) -> DataFrame:
    """Adds the failure rate of the last events, whether it opens the circuit, and the run of failures so far."""
    w = Window.partitionBy(group).orderBy(order)
    out = events.withColumn("__f", failed.cast("int")).withColumn("rate", F.avg("__f").over(w.rowsBetween(-width + 1, 0)))
    full = F.count("*").over(w.rowsBetween(-width + 1, 0)) == width
    out = out.withColumn("open", full & (F.col("rate") > limit)).withColumn("__run", F.sum(1 - F.col("__f")).over(w))
    run = F.sum("__f").over(Window.partitionBy(group, "__run").orderBy(order))
    return out.withColumn("consecutive", run).drop("__f", "__run")


def overflow(jobs: DataFrame, status: Column, newest: Column, keep: int, expired: Column, group: Sequence[str] = ()) -> DataFrame:
    """Terminal jobs beyond the newest `keep` of their group, or expired. Without a group the jobs of the newest `keep`
    values are found by a limit, so that no task ranks all jobs."""
    ended = jobs.filter(status.isin(*TERMINAL))
    if group:
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(newest.desc()))
        return ended.withColumn("__rank", rank).filter((F.col("__rank") > keep) | expired).drop("__rank")
    last = ended.select(newest.alias("__v")).orderBy(F.desc("__v")).limit(keep).agg(F.min("__v").alias("__v"), F.count("*").alias("__n"))
    return ended.crossJoin(F.broadcast(last)).filter(((F.col("__n") >= keep) & (newest < F.col("__v"))) | expired).drop("__v", "__n")  # one row


def admit(held: list[tuple[int, str]], kind: str, capacity: int) -> tuple[bool, int | None]:
    """Whether an event enters a buffer, and the place in held of the one that leaves for it.

    Critical events always enter. Of the others capacity - 4 have room; beyond, only a progress event enters, in the place
    of the newest one. If the buffer is full when an event enters, the oldest event that isn't critical leaves.
    """
    capacity = max(8, capacity)
    others = [k for k, (_, x) in enumerate(held) if x not in CRITICAL]
    if kind in CRITICAL or len(others) < capacity - 4:
        return True, others[0] if others and len(held) >= capacity else None
    progress = [k for k in others if held[k][1] == "progress"]
    return (True, progress[-1]) if kind == "progress" and progress else (False, None)


def bounded_buffer(events: DataFrame, job: str, sequence: str, kind: str, capacity: int) -> DataFrame:
    """What a reader that comes late finds in each job's buffer: sequence, kind, and dropped, the logs lost before it.

    Events pass sorted by job and sequence, and a task holds one job's buffer at a time.
    """
    rows = events.select(job, F.col(sequence).cast("long").alias(sequence), kind).repartition(job).sortWithinPartitions(job, sequence)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, lost, dropped = None, [], [], 0
        for batch in batches:
            out = []
            for j, s, k in batch.itertuples(index=False):
                if j != at:
                    out += [(at, *x, n) for x, n in zip(held, lost, strict=True)]
                    at, held, lost, dropped = j, [], [], 0
                enters, leaves = admit(held, k, capacity)
                if leaves is not None:
                    del held[leaves], lost[leaves]
                if enters:
                    held.append((s, k))
                    lost.append(dropped)
                dropped += not enters and k == "log"
            yield pd.DataFrame(out, columns=[job, sequence, kind, "dropped"])
        yield pd.DataFrame([(at, *x, n) for x, n in zip(held, lost, strict=True)], columns=[job, sequence, kind, "dropped"])

    return rows.mapInPandas(run, f"`{job}` {events.schema[job].dataType.simpleString()}, `{sequence}` long, `{kind}` string, dropped long")


def auto_resume(failures: DataFrame, group: str, category: str, n: str, transient: Sequence[str], most_fatal: int = 0) -> DataFrame:
    """Per group whether to go on: some failures are transient and at most `most_fatal` are not."""
    passing = F.col(category).isin(*transient)
    sums = failures.groupBy(group).agg(F.sum(F.when(passing, F.col(n)).otherwise(0)).alias("transient"), F.sum(F.when(~passing, F.col(n)).otherwise(0)).alias("fatal"))
    return sums.withColumn("resume", (F.col("transient") > 0) & (F.col("fatal") <= most_fatal))


def heartbeats(events: DataFrame, job: str, sequence: str, ts: str, kind: str, idle: str, until: Column) -> DataFrame:
    """What a subscriber of each job is sent: its events up to the first `done`, and a heartbeat after each `idle` without
    an event, as job, at, kind and sequence (null for heartbeats). Jobs without a `done` go on until `until`."""
    w = Window.partitionBy(job).orderBy(ts, sequence)
    ended = F.max(F.when(F.col(kind) == "done", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    sent = events.select(job, F.col(ts).alias("at"), F.col(kind).alias("kind"), F.col(sequence).alias("sequence"), F.lead(ts).over(w).alias("__next"), F.coalesce(ended, F.lit(0)).alias("__ended"), until.alias("__until")).filter("__ended = 0")
    step = F.expr(f"INTERVAL {idle}")
    # An event at the very end of the silence comes first, so the last heartbeat is before it.
    last = F.when(F.col("kind") == "done", F.col("at")).otherwise(F.coalesce(F.col("__next") - F.expr("INTERVAL 1 MICROSECOND"), "__until"))
    beats = sent.filter(F.col("at") + step <= last).select(job, F.explode(F.sequence(F.col("at") + step, last, step)).alias("at"))
    return sent.select(job, "at", "kind", "sequence").unionByName(beats.withColumns({"kind": F.lit("heartbeat"), "sequence": F.lit(None).cast(events.schema[sequence].dataType)}))


def retention(tasks: DataFrame, task: str, group: str, status: Column, finished: Column, created: Column, subscribers: Column, now: Column, ttl: str, most: int) -> DataFrame:
    """Terminal tasks that go, with `reason`: `expired` after ttl, else `overflow` beyond the group's newest `most`. Tasks with
    subscribers stay and don't count. Of tasks finished at once the smaller `task` counts as
    the older. Only the newest `most` of a group are ranked; Spark drops others before the shuffle."""
    since = F.coalesce(finished, created)
    rows = tasks.withColumn("__since", since).withColumn("__old", F.coalesce(finished <= now - F.expr(f"INTERVAL {ttl}"), F.lit(False)))
    able = rows.filter(status.isin(*TERMINAL) & (subscribers == 0)).withColumn("__id", F.struct("__since", task))
    newest = able.filter(~F.col("__old")).withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("__id").desc()))).filter(F.col("__rank") <= most)
    cut = newest.groupBy(group).agg(F.min("__id").alias("__cut"), F.count("*").alias("__n"))
    beyond = (F.col("__n") >= most) & (F.col("__id") < F.col("__cut"))
    out = able.join(cut, group, "left").withColumn("reason", F.when(F.col("__old"), "expired").when(beyond, "overflow"))
    return out.filter("reason is not null").select(*tasks.columns, "reason")


class CallGuard:
    """Budgets and a circuit breaker for one job's calls, fed in order. Once open it stays open.

    A call is refused if it would exceed the number of requests or the sum of input tokens (0: no limit). A call that was
    made opens the circuit after so many fatal failures in a row, or when of the last `window` calls, `least` at least,
    more than `rate` failed.
    """

    def __init__(self, requests: int = 0, tokens: int = 0, window: int = 20, least: int = 10, rate: float = 0.5, fatal: int = 3, fatal_kinds: Sequence[str] = FATAL):
        self.limits, self.fatal_kinds = (requests, tokens, least, rate, fatal), tuple(fatal_kinds)
        self.requests = self.tokens = self.fatal = 0
        self.recent, self.reason = deque(maxlen=window), ""

    def call(self, tokens: int, ok: bool, category: str) -> str:
        """Why the call is refused; empty if it is made."""
        most_requests, most_tokens, least, rate, most_fatal = self.limits
        if not self.reason:
            if most_requests and self.requests + 1 > most_requests:
                self.reason = "request_budget_exceeded"
            elif most_tokens and self.tokens + max(0, tokens) > most_tokens:
                self.reason = "input_token_budget_exceeded"
        if self.reason:
            return self.reason
        self.requests, self.tokens = self.requests + 1, self.tokens + max(0, tokens)
        self.recent.append(ok)
        self.fatal = self.fatal + 1 if not ok and category in self.fatal_kinds else 0
        if self.fatal >= most_fatal:
            self.reason = f"consecutive_{category}"
        elif len(self.recent) >= least and self.recent.count(False) / len(self.recent) > rate:
            self.reason = "failure_rate_exceeded"
        return ""


def guarded(calls: DataFrame, job: str, order: str, tokens: Column, ok: Column, category: Column, requests: int = 0, most_tokens: int = 0, window: int = 20, least: int = 10, rate: float = 0.5, fatal: int = 3, fatal_kinds: Sequence[str] = FATAL) -> DataFrame:
    """Adds refused and reason, as CallGuard gives them to each call of a job in order.

    Up to the call at which a circuit opens all calls are made, so their counts, sums and rates are running ones; the first
    reason in order then holds for all later calls.
    """
    w = Window.partitionBy(job).orderBy(order)
    last = w.rowsBetween(1 - window, 0)
    out = calls.withColumns({"__n": F.row_number().over(w), "__t": F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)), "__bad": (~ok).cast("int"), "__fatal": ~ok & F.coalesce(category.isin(*fatal_kinds), F.lit(False)), "__c": category})
    out = out.withColumns({"__sum": F.sum("__t").over(w), "__run": F.col("__n") - F.coalesce(F.max(F.when(~F.col("__fatal"), F.col("__n"))).over(w), F.lit(0)), "__seen": F.count("*").over(last), "__rate": F.sum("__bad").over(last) / F.count("*").over(last)})
    before = F.when(F.lit(requests > 0) & (F.col("__n") > requests), "request_budget_exceeded").when(F.lit(most_tokens > 0) & (F.col("__sum") > most_tokens), "input_token_budget_exceeded")
    after = F.when(F.col("__run") >= fatal, F.concat(F.lit("consecutive_"), "__c")).when((F.col("__seen") >= least) & (F.col("__rate") > rate), "failure_rate_exceeded")
    out = out.withColumn("__after", after).withColumn("__first", F.coalesce(F.lag("__after").over(w), before))
    reason = F.coalesce(F.first("__first", ignorenulls=True).over(w), F.lit(""))
    return out.withColumn("reason", reason).withColumn("refused", F.col("reason") != "").drop("__n", "__t", "__bad", "__fatal", "__c", "__sum", "__run", "__seen", "__rate", "__after", "__first")
