"""Substring deduplication by sliding sentence spans.

A text is cut into sentences: after a word that ends with . ! or ?, closing quotes and brackets aside, and at line ends.
Only sentences of more than `LONG` words, as in text without stops, are cut further, after each word whose hash is the
smallest among its `REACH` neighbours on both sides. All of it depends on nearby words alone, so a passage has the same
sentences wherever it stands, but for the one it begins and the one it ends in. From each sentence on, a span is the
shortest run of `run` sentences or more with `least` words or more. Every span is hashed (A-Z lower-cased, words joined
by blanks) to 128 bits, and spans are joined globally on the hash; of each repeated span the occurrence with the smallest
(doc_id, position) stays, those without an id behind all others, and sentences that any other occurrence covers are
removed, with the white space behind them.

Counting pre-aggregates per task. Spans with more than a thousandth of all occurrences are a thousand keys at most; they
are joined by broadcast and the others by shuffle, so no key meets in one task. Nothing is gathered but one document's
positions.

Null texts stay null, empty ones empty; a text with no whole span is left alone; an empty table gives no rows. Rows that
share both doc_id (or have none) and text count as one document; those that share an id alone are documents of their
own, told apart by a hash of the text. Other columns stay, but for those named like a result column, which the result
replaces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.shared import Scratch, arrow_batches, fresh, utf8

#: Sentences of a span, and words of a span, at the least.
RUN, LEAST = 2, 16
#: Words of a sentence that isn't cut further, and neighbours on each side that a word's hash is compared with.
LONG, REACH = 16, 3
STOPS, CLOSERS = np.frombuffer(b".!?", np.uint8), b"\"')]}"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sentence_ends(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a lower-cased text, and after how many words each sentence ends."""
    lines = [x.split() for x in text.lower().split(b"\n")]
    words = [w for x in lines for w in x]
    n = len(words)
    if not n:
        return words, np.zeros(0, np.int64)
    cut = np.isin(np.fromiter((w[-1] if w[-1] not in CLOSERS else (w.rstrip(CLOSERS) or w)[-1] for w in words), np.uint8, n), STOPS)
    line_ends = np.cumsum([len(x) for x in lines])
    cut[line_ends[line_ends > 0] - 1] = True
    cut[-1] = True
    ends = np.flatnonzero(cut) + 1
    sizes = np.diff(ends, prepend=0)
    if sizes.max() <= LONG:
        return words, ends
    h = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    low = np.ones(n, bool)
    for k in range(1, min(REACH, n - 1) + 1):
        low[k:] &= h[k:] < h[:-k]
        low[:-k] &= h[:-k] <= h[k:]
    cut |= low & np.repeat(sizes > LONG, sizes)
    return words, np.flatnonzero(cut) + 1


def span_ends(ends: np.ndarray, run: int, least: int) -> np.ndarray:
    """The last sentence of the span that starts with each sentence, as far as there are whole spans."""
    starts = np.concatenate([[0], ends[:-1]])
    last = np.maximum(np.searchsorted(ends, starts + least), np.arange(len(ends)) + run - 1)
    return last[last < len(ends)]


def span_hashes(text: bytes, run: int = RUN, least: int = LEAST) -> np.ndarray:
    """Hash of every span in two halves, by its first sentence."""
    words, ends = sentence_ends(text)
    if not len(ends):
        return np.zeros((0, 2), np.int64)
    stops = ends[span_ends(ends, run, least)].tolist()
    digest, starts = xxhash.xxh3_128_digest, [0, *ends.tolist()]
    return np.frombuffer(b"".join([digest(b" ".join(words[a:b])) for a, b in zip(starts, stops, strict=False)]), np.int64).reshape(-1, 2)


def without(text: bytes, positions: list[int], run: int = RUN, least: int = LEAST) -> tuple[bytes, int, int]:
    """The text without the sentences that spans from the positions cover; sentences in all, and removed."""
    _, ends = sentence_ends(text)
    last = span_ends(ends, run, least)
    covered = sorted({s for p in positions for s in range(p, last[p] + 1)})
    places = [m.start() for m in WORD.finditer(text)] + [len(text)]
    starts = [0, *ends[:-1].tolist()]
    out, at = [], 0
    for s in covered:
        out.append(text[at : max(at, places[starts[s]])])
        at = places[ends[s]]
    out.append(text[at:])
    return b"".join(out), len(ends), len(covered)


def spans(docs: DataFrame, run: int, least: int) -> DataFrame:
    """h1, h2, doc_id, variant and pos of every span of every document (doc_id, variant, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [span_hashes(t, run, least) for t in utf8(batch.column(2))]
            n = np.array([len(h) for h in hashes], np.int64)
            row = pa.array(np.repeat(np.arange(len(n)), n))
            h = np.concatenate([np.zeros((0, 2), np.int64), *hashes])
            pos = np.concatenate([np.zeros(0, np.int32), *(np.arange(k, dtype=np.int32) for k in n)])
            columns = [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), batch.column(0).take(row), batch.column(1).take(row), pa.array(pos)]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc_id", "variant", "pos"])

    return docs.select("doc_id", "variant", "text").mapInArrow(each, "h1 long, h2 long, doc_id long, variant long, pos int")


def variant(docs: DataFrame) -> Column:
    """What tells rows with one doc_id apart: a hash of the text, or 0 where every id stands for one text."""
    by_text = F.xxhash64(F.col("text").cast("string"))
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(by_text).alias("a"), F.max(by_text).alias("b"))
    return F.when(F.col("doc_id").isNull(), by_text).otherwise(F.lit(0) if ids.filter("a <> b").isEmpty() else by_text).cast("long")


def repeated_spans(docs: DataFrame, scratch: Scratch, run: int = RUN, least: int = LEAST) -> DataFrame:
    """doc_id, variant and pos of every span that occurs before, in an earlier document or place."""
    rows = scratch.save(spans(docs, run, least))
    total = rows.count()
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "variant", "pos")
    h = ["h1", "h2"]
    groups = rows.groupBy(*h).agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    groups = scratch.save(groups)
    # More than a thousandth of all rows: at most a thousand keys.
    is_hot = F.col("n") > max(1000, total / 1000)
    hot = F.broadcast(groups.filter(is_hot))
    by_hot = rows.join(hot, h)
    by_rest = rows.join(F.broadcast(groups.filter(is_hot).select(*h)), h, "left_anti").join(groups.filter(~is_hot), h)
    found = by_hot.unionByName(by_rest)
    return found.filter(place != F.col("first")).select("doc_id", "variant", "pos")


def deduplicated(docs: DataFrame, run: int = RUN, least: int = LEAST) -> DataFrame:
    """docs with repeated passages cut from its text, n_sentences and n_removed."""
    scratch = Scratch(arrow_batches(docs.sparkSession))
    which = variant(docs)
    found = repeated_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), which.alias("variant"), F.col("text").cast("string").alias("text")), scratch, run, least)
    id_, variant_, pos = fresh(docs, "id"), fresh(docs, "variant"), fresh(docs, "pos")
    per_doc = found.groupBy(F.col("doc_id").alias(id_), F.col("variant").alias(variant_)).agg(F.collect_set("pos").alias(pos))
    kept = [c for c in docs.columns if c not in ("text", "n_sentences", "n_removed")]
    rows = docs.select(*kept, F.col("text").cast("string").alias("text")).join(per_doc, F.col("doc_id").eqNullSafe(F.col(id_)) & (which == F.col(variant_)), "left").drop(id_, variant_)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column("text").cast(pa.binary()).to_pylist(), batch.column(pos).to_pylist()
            new, n, gone = [], [], []
            for t, p in zip(texts, places, strict=True):
                if t is None or not p:
                    new.append(t)
                    n.append(len(sentence_ends(t)[1]) if t is not None else 0)
                    gone.append(0)
                else:
                    x, total, removed = without(t, p, run, least)
                    new.append(x)
                    n.append(total)
                    gone.append(removed)
            rest = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(new, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*kept, "text", "n_sentences", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return rows.mapInArrow(cut, f"{schema}, text string, n_sentences long, n_removed long")
