"""Target-distribution importance resampling over hashed word n-grams.

One scan of each document emits its features' buckets: the scan keeps the running CRC-32 states of the last n starts in a
ring and extends each by a space and the next word, so no n-gram is ever built as a text. The buckets are written, two or
four bytes a feature; the corpus counts and every document's weight are taken from that table, not from the texts.

A bucket's gain compares its share in the target with its share in the corpus; a document's weight is the sum of its
features' gains, its score the weight plus Gumbel noise from a hash of its id, and the highest scores are drawn: sampling
without replacement in proportion to the importance weights.

The ranks are taken by a distributed sort: rows are dealt by ranges of the score, and each range's first rank is the
number of rows in those before it, so only one count per range comes to the driver. The gains have one entry per bucket.

Null and empty texts have no features and weight 0. A null doc_id counts as an empty one in the noise, and is drawn after
others of its score. Repeated rows are scored each by itself; rows that tie in score and id rank by features, then at will.
An empty table gives no rows; an empty target gives every bucket the gain of none. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.shared import Scratch, arrow_batches, utf8

#: Bytes as words see them: A-Z in lower case; digits, a-z and all beyond ASCII as they are; the rest is space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SLICE = 1 << 20


def slices(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            space = text.find(b" ", end)
            end = len(text) if space < 0 else space
        yield text[at:end]
        at = end


def ring_buckets(text: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the buckets of all runs of one to `longest` words."""
    crc, ring, words, parts = zlib.crc32, [], 0, []
    for part in slices(text.translate(TABLE)):
        split = part.split()
        words += len(split)
        if longest == 1:
            states = np.fromiter(map(crc, split), np.uint32, len(split))
        else:
            out: list[int] = []
            for word in split:
                step = b" " + word
                ring = [crc(step, state) for state in ring[1 - longest :]]
                ring.append(crc(word))
                out += ring
            states = np.array(out, np.uint32)
        parts.append(states % np.uint32(buckets))
    return words, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def features(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """Per row of texts (id, text): id, n_words, n_features and the buckets as little-endian numbers."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, found = [], []
            for text in utf8(batch.column(1)):
                n, numbers = ring_buckets(text, longest, buckets)
                words.append(n)
                found.append(numbers.astype(kind).tobytes())
            size = np.dtype(kind).itemsize
            lengths = [len(x) // size for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(lengths, pa.int64()), pa.array(found, pa.binary())], ["id", "n_words", "n_features", "buckets"])

    return texts.mapInArrow(run, "id long, n_words long, n_features long, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows are in each bucket: summed within tasks, then over them."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for numbers in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(numbers, kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out[counted["bucket"]] = counted["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) per bucket, with one added to each count."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """rows with weight, the sum of their buckets' gains, in place of the buckets."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = shared.value
        for batch in batches:
            weights = [int(by_bucket[np.frombuffer(x, kind)].sum()) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], ["id", "n_words", "n_features", "weight"])

    return rows.select("id", "n_words", "n_features", "buckets").mapInArrow(run, "id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, scratch: Scratch, *order) -> DataFrame:
    """rows with `rank`, their place (from 1) in the order of all rows, by a distributed sort."""
    place = F.monotonically_increasing_id()  # of sorted rows: the partition above, the place in it in the low 33 bits
    placed = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place))
    part, within = F.shiftright("place", 33).cast("int"), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row per range
    before, firsts = 0, []
    for r in counts:
        firsts.append((r["part"], before))
        before += r["n"]
    first = rows.sparkSession.createDataFrame(firsts, "part int, first long")
    return placed.withColumn("part", part).join(F.broadcast(first), "part").withColumn("rank", F.col("first") + within + 1).drop("part", "first", "place")


def noise(seed: str) -> Column:
    """Gumbel noise from the id, in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_features, weight, score and rank, which is null for documents that aren't drawn.
    Drawn are `percent` of the documents with at least `min_words` words, those of the highest scores."""
    spark = arrow_batches(docs.sparkSession)
    scratch = Scratch(spark)
    found = scratch.save(features(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), longest, buckets))
    wanted = features(target.select(F.lit(0).cast("long"), F.col("text").cast("string")), longest, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    rows = weighed(found, gain).withColumnRenamed("id", "doc_id").withColumn("score", F.col("weight") + noise(seed))
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))
    scratch.drop(found)
    able = rows.filter(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("row").asc()]
    best = ranked(able, scratch, *order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return best.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
