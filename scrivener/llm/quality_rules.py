"""Quality rules: counts per document, and a hashed n-gram log-likelihood ratio between trusted target and raw corpus.

Two multinomials over hashed byte n-grams are estimated: one from all documents (the raw corpus), one from trusted
documents (the target). A document's verdict is the mean over its n-grams of log p(target) - log p(raw): the
log-likelihood ratio, normalised by length. It is kept if the ratio reaches the threshold; nothing is drawn at random.

The target is all documents that labels mark as good; raw counts are taken over the whole corpus. The tables have one
entry per bucket, whatever the size of the corpus, which bounds what is gathered and broadcast.

Null texts have no words. Texts of fewer bytes than an n-gram have ratio 0. Repeated rows are judged each by itself.
Without trusted documents the ratio of every document is 0. A doc_id that labels name twice counts once, and as good
only if no row says otherwise. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.shared import arrow_batches, utf8

#: Fixed by the contract of the base rules.
SYMBOLS, MIN_WORDS, MOST_REPEATS_PERCENT = b"#*$%&|<>", 50, 50
BUCKET_BITS, NGRAM, SLICE = 16, 4, 1 << 20
#: Trusted ids up to which they are sent to the documents (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio"]


def buckets(text: bytes) -> np.ndarray:
    """Bucket of every byte n-gram of a text."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(raw) < NGRAM:
        return np.zeros(0, np.uint32)
    code = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def slices(text: bytes) -> Iterator[bytes]:
    """A long text in parts that overlap so that each n-gram is in just one."""
    for at in range(0, max(1, len(text) - NGRAM + 1), SLICE):
        yield text[at : at + SLICE + NGRAM - 1]


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, words in repeated three-word windows."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined)
    if not text.isascii():
        chars -= int(((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80).sum())
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        twice = np.fromiter((counts[w] > 1 for w in windows), bool, n - 2)
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= twice
        repeats = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def ngram_counts(docs: DataFrame) -> DataFrame:
    """bucket, n and n_target summed over all rows of docs (text, target)."""
    size = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            texts, targets = utf8(batch.column(0)), batch.column(1).to_pylist()
            for into, chosen in ((raw, False), (good, True)):
                held, n = [], 0
                for t, target in zip(texts, targets, strict=True):
                    if chosen and not target:
                        continue
                    for part in slices(t):
                        held.append(buckets(part))
                        n += len(part)
                        if n > SLICE:
                            into += np.bincount(np.concatenate(held), minlength=size)
                            held, n = [], 0
                if held:
                    into += np.bincount(np.concatenate(held), minlength=size)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(good[used])], ["bucket", "n", "n_target"])

    counted = docs.select("text", "target").mapInArrow(run, "bucket int, n long, n_target long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids that labels mark as good."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return known.filter("quality = 1").select("doc_id")


def log_ratios(docs: DataFrame, trusted: DataFrame, pseudo_count: float = 1.0) -> np.ndarray:
    """log p(target) - log p(raw) per bucket: a table of fixed size."""
    small = trusted.count() <= BROADCAST_IDS
    marks = trusted.withColumn("target", F.lit(True))
    marked = docs.join(F.broadcast(marks) if small else marks, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    table = ngram_counts(marked).toPandas()
    size = 1 << BUCKET_BITS
    if not table["n_target"].sum():
        return np.zeros(size)
    raw, good = np.full(size, pseudo_count), np.zeros(size)
    raw[table["bucket"]] += table["n"]
    good[table["bucket"]] += table["n_target"]
    # The prior of the target is the raw corpus, so that n-grams which a small sample lacks aren't held against a text.
    good += pseudo_count * size * raw / raw.sum()
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def judged(docs: DataFrame, labels: DataFrame, threshold: float = -0.45, row: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed, log_ratio and kept. Another column can be given instead of
    doc_id to name the rows by; labels are looked up by doc_id all the same."""
    spark = arrow_batches(docs.sparkSession)
    named, docs = docs.select(F.col(row).cast("long"), F.col("text").cast("string")), docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = spark.sparkContext.broadcast(log_ratios(docs, trusted_ids(labels)).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        for batch in batches:
            texts = utf8(batch.column(1))
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            score = np.zeros(len(texts))
            for i, t in enumerate(texts):
                total = sum(float(ratios[buckets(part)].sum(dtype=np.float64)) for part in slices(t))
                score[i] = round(total / max(1, len(t) - NGRAM + 1), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T.copy()), pa.array(score)], [row, *NAMES[1:]])

    rows = named.mapInArrow(run, f"`{row}` long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ratio double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))
