"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; bit i is 1 if more than half of the document's shingle hashes have it. To find all pairs
with at most four differing bits, the bits are cut into m blocks, of which s together make a window: in one of the
windows two such fingerprints differ by at most t = 4 s / m rounded down, here one bit. The more fingerprints there are,
the wider the windows: (m, s) is (3, 1), (5, 2) or (7, 3), which changes the work and not the result. In a window, the
anchors are the words of a covering code: the [15, 11] Hamming code on the first fifteen bits, every word on the rest.
The code's covering radius is R = 1, so each fingerprint has a home anchor within R, and whatever differs from it by t
bits or fewer lies within R + t = 2 of that anchor. Fingerprints are replicated to every anchor within R + t, and
compared per anchor with those at home there.

Equal fingerprints are compared once. At an anchor with very many fingerprints, both those at home and those that visit
are dealt into parts, and each part of the one is compared with each part of the other. In a pair of parts, matches are reduced to a spanning forest, so a group of n
near copies yields about n links rather than n * n. Components come from large-star/small-star steps.

Null and wordless texts have fingerprint zero and are linked like others. Repeated rows get one result each. A null
doc_id gets its fingerprint and the component of its group, which is null only if the group has no other id. An empty
table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.components import connected_components
from scrivener.llm.shared import Scratch, arrow_batches, low_labels, utf8

#: Bits of a shingle hash that are counted at a time, to bound memory on very long texts.
COUNT_AT_ONCE = 1 << 15
CODE_BITS = 15


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles joined by blanks."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n, k = max(1, len(words) - shingle + 1), min(shingle, len(words))
    starts, ends = (ends - lengths)[:n].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, COUNT_AT_ONCE):
        part = hashes[at : at + COUNT_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


#: Blocks and blocks of a window, and the number of fingerprints up to which they are used: a window of 21, 26 or 27 bits.
LAYOUTS = ((3, 1, 20_000_000), (5, 2, 2_000_000_000), (7, 3, None))
Window = list[tuple[int, int]]


def windows_of(blocks: int, chosen: int, bits: int = 64) -> list[Window]:
    """For every choice of blocks the offset and width of each."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    return [list(w) for w in combinations([(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], chosen)]


def layout(n: int) -> list[Window]:
    """The windows for n fingerprints."""
    return next(windows_of(m, s) for m, s, most in LAYOUTS if most is None or n <= most)


def in_window(fps: np.ndarray, window: Window) -> tuple[np.ndarray, int]:
    """The bits of each fingerprint in a window, one after another, and how many they are."""
    out, at = np.zeros(len(fps), np.int64), 0
    for start, width in window:
        out |= ((fps.view(np.uint64) >> np.uint64(start)).view(np.int64) & ((1 << width) - 1)) << at
        at += width
    return out, at


def anchor_masks(width: int, reach: int) -> list[np.ndarray]:
    """For each syndrome of the Hamming code the masks that lead from a word to all anchors within reach."""
    pairs = [(0, 0, 0)]
    for size in range(1, reach + 1):
        for places in combinations(range(width), size):
            syndrome = 0
            for p in places:
                syndrome ^= p + 1 if p < CODE_BITS else 0
            pairs.append((syndrome, sum(1 << p for p in places), size))
    return [np.array([mask for s, mask, _ in pairs if s == syndrome], np.int64) for syndrome in range(16)]


def syndromes(words: np.ndarray) -> np.ndarray:
    """Syndrome of the first fifteen bits; zero for an anchor, else one more than the place of the bit to flip."""
    out = np.zeros(len(words), np.int64)
    for p in range(CODE_BITS):
        out ^= np.where(words >> p & 1, p + 1, 0)
    return out


def anchors(fps: np.ndarray, windows: list[Window], radius: int = 1, threshold: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key (window and anchor), fingerprint and whether it is at home there, for all anchors that it is sent to."""
    keys, owners, home = [], [], []
    for k, window in enumerate(windows):
        words, width = in_window(fps, window)
        syndrome = syndromes(words)
        own = np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome - 1, 0)), words)
        keys.append((k << 40) | own)
        owners.append(fps)
        home.append(np.ones(len(fps), bool))
        for s, masks in enumerate(anchor_masks(width, radius + threshold)):
            chosen = np.flatnonzero(syndrome == s)
            keys.append(((k << 40) | (words[chosen][:, None] ^ masks)).ravel())
            owners.append(np.repeat(fps[chosen], len(masks)))
            home.append(np.zeros(len(keys[-1]), bool))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(home)


def _replicate(windows: list[Window]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 2000):
                key, fp, home = anchors(fps[at : at + 2000], windows)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(home)], ["key", "fp", "home"])

    return run


def forest(homes: np.ndarray, visitors: np.ndarray, most_bits: int, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what matches between homes and visitors: the spanning forest of a part of an anchor."""
    both, place = np.unique(np.concatenate([homes, visitors]), return_inverse=True)
    at_home, visiting = place[: len(homes)], place[len(homes) :]
    label = np.arange(len(both))
    step = max(1, at_once // max(1, len(homes)))
    for at in range(0, len(visitors), step):
        near = np.bitwise_count(homes.view(np.uint64)[:, None] ^ visitors[at : at + step].view(np.uint64)[None, :]) <= most_bits
        here = visiting[at : at + step]
        near &= label[at_home][:, None] != label[here][None, :]
        while near.any():
            # Each visitor takes the smallest label around it, and each home the smallest of its visitors.
            shown = np.where(near, label[at_home][:, None], len(both)).min(0)
            matched = np.flatnonzero(shown < len(both))
            a, b = label[here[matched]], shown[matched]
            rows = np.flatnonzero(near.any(1))
            first = near[rows].argmax(1)
            label = low_labels(len(both), np.concatenate([label, a, at_home[rows]]), np.concatenate([np.arange(len(both)), b, here[first]]))
            near &= label[at_home][:, None] != label[here][None, :]
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def _compare(most_bits: int):
    """Rows come sorted by key and salt, those at home first."""

    def links(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        homes = np.add.reduceat(home.astype(np.int64), starts)
        sizes = ends - starts
        small = (homes > 0) & (homes * (sizes - homes) <= 64)
        # Small anchors, nearly all of them, are compared together: each visitor with each at home.
        s, h, v = starts[small], homes[small], (sizes - homes)[small]
        for at in range(0, len(s), 50_000):
            s1, h1, v1 = s[at : at + 50_000], h[at : at + 50_000], v[at : at + 50_000]
            pair = ranges_(h1 * v1)
            owner = np.repeat(np.arange(len(s1)), h1 * v1)
            i, j = s1[owner] + pair // v1[owner], s1[owner] + h1[owner] + pair % v1[owner]
            x, y = fp[i], fp[j]
            near = (x != y) & (np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= most_bits)
            yield x[near], y[near]
        for g in np.flatnonzero((homes > 0) & ~small & (sizes > homes)):
            mid = starts[g] + homes[g]
            yield forest(fp[starts[g] : mid], fp[mid : ends[g]], most_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            for a, b in links(*(np.concatenate(c) for c in zip(*parts, strict=True))):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            key, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1])) if key[0] <= key[-1] else 0
            if last == 0 and held and held[-1][0][-1] == key[-1]:
                held.append((key, fp, home))
                continue
            if last:
                held.append((key[:last], fp[:last], home[:last]))
            if held:
                yield from flush(held)
            held = [(key[last:], fp[last:], home[last:])]
        if held:
            yield from flush(held)

    return run


def ranges_(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each length."""
    ends = np.cumsum(lengths)
    return np.arange(int(lengths.sum())) - np.repeat(ends - lengths, lengths)


def near_links(fps: DataFrame, scratch: Scratch, most_bits: int = 4, windows: list[Window] | None = None, part: int = 2048) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints fp with at most most_bits differing bits."""
    windows = windows or layout(fps.count())
    covered = sum(width for w in windows for _, width in w)
    if most_bits * covered // (64 * len(windows)) > 1:
        raise ValueError("some window must have one differing bit at most: use narrower ones")
    rows = scratch.save(fps.mapInArrow(_replicate(windows), "key long, fp long, home boolean"))
    # Anchors beyond a part are dealt into a grid of parts: of those at home times of those that visit.
    sizes = rows.groupBy("key").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visits")).filter((F.col("homes") > part) | ((F.col("visits") > 16 * part) & (F.col("homes") > 0)))
    grid = scratch.save(sizes.select("key", F.ceil(F.col("homes") / part).cast("int").alias("rows_"), F.ceil(F.col("visits") / (16 * part)).cast("int").alias("columns_")))
    dealt = rows.join(grid, "key", "left").withColumns({"rows_": F.coalesce("rows_", F.lit(1)), "columns_": F.coalesce(F.greatest("columns_", F.lit(1)), F.lit(1))})
    one = lambda n, seed: F.array(F.pmod(F.xxhash64("fp", F.lit(seed)), n).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    dealt = dealt.withColumn("row", F.explode(F.when(F.col("home"), one(F.col("rows_"), 1)).otherwise(every(F.col("rows_")))))
    dealt = dealt.withColumn("column", F.explode(F.when(F.col("home"), every(F.col("columns_"))).otherwise(one(F.col("columns_"), 2))))
    # Places of an anchor beyond the first are told apart by a hash; a clash only compares more.
    place = F.when((F.col("row") == 0) & (F.col("column") == 0), F.col("key")).otherwise(F.xxhash64("key", "row", "column")).alias("place")
    sorted_ = dealt.select(place, "fp", "home").repartition("place").sortWithinPartitions("place", F.desc("home"))
    return sorted_.mapInArrow(_compare(most_bits), "a long, b long")


def near_duplicates(docs: DataFrame, most_bits: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id of its group) of every row."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(fingerprints(docs, shingle))
    classes = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    links = near_links(classes.select("fp"), scratch, most_bits)
    roots = connected_components(links, scratch)
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    grouped = scratch.save(grouped)
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lows, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
