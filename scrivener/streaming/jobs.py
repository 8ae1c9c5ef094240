"""Job and event streams: bounded buffers, one active job per key, latest state, silent jobs.

Order within a job is its sequence number. State is small: a few numbers per job, or its bounded buffer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scrivener.operators.jobs import admit

EVENT = "job string, sequence long, kind string, payload string, ts timestamp"
ADMITTED = "job string, sequence long, kind string, admitted boolean, replaces long"


def ndjson(spark: SparkSession, path: str, schema: str = EVENT, files_per_trigger: int = 1000) -> DataFrame:
    """Events from JSON lines as files arrive; what a trigger takes is bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def one_active_per_key(jobs: DataFrame, keys: Sequence[str], ts: str = "ts", within: str = "24 hours") -> DataFrame:
    """The first submission of each key within the watermark."""
    return jobs.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def latest_states(events: DataFrame) -> DataFrame:
    """The newest kind of each job, for update mode."""
    return events.groupBy("job").agg(F.max_by("kind", "sequence").alias("state"), F.max("sequence").alias("sequence"))


def bounded_buffer(events: DataFrame, capacity: int = 256) -> DataFrame:
    """Whether each event enters its job's buffer, and which event leaves it for that. The state of a job is its buffer."""

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("sequence", kind="stable")
        admitted, replaces = [], []
        for sequence, kind in zip(rows["sequence"], rows["kind"], strict=True):
            enters, leaves = admit(held, kind, capacity)
            admitted.append(enters)
            replaces.append(held.pop(leaves)[0] if leaves is not None else None)
            if enters:
                held.append((int(sequence), kind))
        state.update(([s for s, _ in held], [k for _, k in held]))
        yield rows[["job", "sequence", "kind"]].assign(admitted=admitted, replaces=pd.array(replaces, dtype="Int64"))

    rows = events.select("job", "sequence", "kind").filter("job is not null and sequence is not null")
    return rows.groupBy("job").applyInPandasWithState(each, ADMITTED, "sequences array<long>, kinds array<string>", "append", GroupStateTimeout.NoTimeout)


def silent_jobs(events: DataFrame, ts: str = "ts", silence: str = "20 seconds", late: str = "10 seconds") -> DataFrame:
    """One row per session of a job's events, once it has been silent for so long: the job, its last event's time and count."""
    sessions = events.withWatermark(ts, late).groupBy("job", F.session_window(ts, silence).alias("session"))
    return sessions.agg(F.max(ts).alias("last_ts"), F.count("*").alias("events"), F.max_by("kind", "sequence").alias("kind"))
