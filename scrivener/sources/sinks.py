"""Writers: tables published by key prefix, and full rewrites that readers never see half done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.operators import records


def publish_sharded(df: DataFrame, path: str, key: str, rows_per_file: int = 5_000_000) -> None:
    """Parquet in folders by the first two hex digits of the key's hash; a shard is written by as many tasks as its rows need."""
    sharded = df.withColumn("shard", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2))
    parts = max(1, -(-df.count() // (256 * rows_per_file)))
    salted = sharded.repartition(256 * parts, "shard", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts))) if parts > 1 else sharded.repartition("shard")
    salted.write.mode("overwrite").partitionBy("shard").parquet(path)


def merge_into(df: DataFrame, old_path: str, new_path: str, keys: list[str]) -> None:
    """A new version of a table: old rows, replaced by those of df with the same key. The old version stays as it is."""
    old = df.sparkSession.read.parquet(old_path)
    records.upsert(old, df, keys).write.mode("errorifexists").parquet(new_path)


def append_trimmed(events: DataFrame, log: DataFrame, job: str, sequence: str, most: int) -> DataFrame:
    """A log with new events, the newest `most` of each job."""
    return records.keep_newest(log.unionByName(events), [job], F.col(sequence), most)
