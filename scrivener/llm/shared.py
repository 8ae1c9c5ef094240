"""What the training-data operators share: scratch tables, batches and packed arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from scrivener.session import Scratch, fresh, prepare

__all__ = ["Scratch", "arrow_batches", "crc32_of_id", "fresh", "low_labels", "ranges", "utf8"]

#: Rows and bytes of one Arrow batch, so that a worker holds few long texts at once.
BATCH_ROWS, BATCH_BYTES = 20_000, 8 << 20


def arrow_batches(spark: SparkSession, most_bytes: int = BATCH_BYTES) -> SparkSession:
    """Bound what one Arrow batch brings into a Python worker. Settings of the session: the next operator sets them anew."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)
    return spark


def crc32_of_id(column: str = "doc_id") -> Column:
    """CRC-32 of an id written as decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def low_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (a, b) reach, itself included."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        keep = la != lb
        if not keep.any():
            break
        a, b, la, lb = a[keep], b[keep], la[keep], lb[keep]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            deeper = label[label]
            if (deeper == label).all():
                break
            label = deeper
    return label
