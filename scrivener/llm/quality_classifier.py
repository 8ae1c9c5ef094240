"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of its hashed byte n-grams, and of n-grams over the marks "same word as before" and
"line seen before". Each indicator is scaled by its class log-count ratio, r = log((p / |p|) / (q / |q|)) with p and q
the smoothed document counts in the good and the bad class; rows are scaled to length one. A linear hinge-loss model
is fitted by dual coordinate descent over all rows of the sample, until the duality gap is at most `gap` of the objective.
The margin becomes a probability by a logistic curve, fitted to margins of rows that a model hasn't seen: the rows are in
three parts, and each part's margins come from a model of the other two. The four models are four tasks.

A sample beyond `shard_rows` is descended on in rounds instead, by shards: each on its own dual variables, against the
weights of all, and the shards' steps are added up. Each shard takes its steps as if the others took the same ones, so
that the sum never overshoots, and the rounds come to the one solution for all rows; they too go on until the gap is met.

Labelled rows are a bounded sample: those with the smallest hash of their id, `most_labelled` at most; equal rows count
once, with a weight. Ids whose CRC-32 modulo `folds` is 0 are held out and never learned from. Only the text is an input
of a score.

Null texts count as empty, and an empty text gets the score of a text without features. Repeated rows are scored each
by itself; a doc_id that labels name twice counts once, as good only if no row says otherwise. Without labels of both
classes every score is the smoothed share of good rows; an empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.quality_rules import BUCKET_BITS, buckets, slices
from scrivener.llm.shared import Scratch, arrow_batches, crc32_of_id, utf8

HASHED = 1 << BUCKET_BITS
PARTS = 3  # of the sample, for margins of rows that a model hasn't seen
MARKS = 16  # eight 3-grams of equal words, eight of repeated lines
SIZE = HASHED + MARKS


def features(text: bytes) -> np.ndarray:
    """The sorted features that a text has."""
    found = [np.unique(buckets(part)) for part in slices(text)]
    hashed = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    words = text.split()
    seen: set[bytes] = set()
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = [x in seen or seen.add(x) is not None for x in lines]
    marks = []
    for base, flags in ((0, [a == b for a, b in zip(words, words[1:], strict=False)]), (8, again)):
        f = np.array(flags, np.int64)
        if len(f) >= 3:
            marks.append(base + np.unique(4 * f[:-2] + 2 * f[1:-1] + f[2:]))
    return np.concatenate([hashed.astype(np.int32), *(HASHED + m.astype(np.int32) for m in marks)])


def scaled(x: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """The values of a row's indicators, of length one."""
    v = ratio[x]
    return v / max(1e-9, np.sqrt((v**2).sum()))


def descend(rows: list[np.ndarray], labels: np.ndarray, alpha: np.ndarray, w: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One round of a shard: its dual variables and its share of the weights after some epochs, against the weights w.

    A step counts `shards` times in the shard's own view of the weights, which makes it safe to add all shards' steps.
    """
    values, rng = [scaled(x, ratio) for x in rows], np.random.default_rng(seed)
    view, alpha = w.copy(), alpha.copy()
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v, y = rows[i], values[i], labels[i]
            gradient = y * (view[x] @ v + view[SIZE]) - 1
            # A row's squared length with the constant is two; a row without indicators has the constant alone.
            new = min(max(alpha[i] - gradient / (shards * (2 if len(x) else 1)), 0.0), cost)
            if new != alpha[i]:
                step = shards * (new - alpha[i]) * y
                view[x] += step * v
                view[SIZE] += step
                alpha[i] = new
    share = np.zeros(SIZE + 1)
    for x, v, y, a in zip(rows, values, labels, alpha, strict=True):
        if a:
            share[x] += a * y * v
            share[SIZE] += a * y
    return alpha, share


def _round(shared, cost: float, epochs: int, shards: int, seed: int):
    def run(part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("order", kind="stable")
        ratio, w = shared.value
        x, y = [np.asarray(f, np.int64) for f in part["feats"]], np.where(part["good"].to_numpy() > 0, 1.0, -1.0)
        alpha = np.array(before["alpha"].iloc[0]) if len(before) else np.zeros(len(x))
        alpha, share = descend(x, y, alpha, w, ratio, cost, epochs, shards, seed)
        return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "alpha": [alpha], "share": [share]})

    return run


def descended(rows: DataFrame, ratio: np.ndarray, scratch: Scratch, cost: float, rounds: int, epochs: int, enough: float = 0.0) -> tuple[np.ndarray, dict[int, np.ndarray], float]:
    """Weights (over scaled indicators, the last for the constant), each shard's share of them, and the duality gap
    relative to the objective, after so many rounds or once the gap is small enough. rows: good, shard, feats and order, by
    which a shard's rows are sorted."""
    context = rows.sparkSession.sparkContext
    shards = rows.select("shard").distinct().count()
    w, state, shares, gap = np.zeros(SIZE + 1), None, {}, 0.0
    for k in range(rounds):
        shared = context.broadcast((ratio, w))

        prior = state.select("shard", "alpha") if state is not None else rows.sparkSession.createDataFrame([], "shard int, alpha array<double>")
        state = scratch.save(rows.select("good", "shard", "feats", "order").groupBy("shard").cogroup(prior.groupBy("shard")).applyInPandas(_round(shared, cost, epochs, shards, 7 + k), "shard int, alpha array<double>, share array<double>"))
        found = state.orderBy("shard").toPandas()
        shares = {int(s): np.array(x) for s, x in zip(found["shard"], found["share"], strict=True)}
        w = sum(shares.values())
        dual = float(sum(np.sum(a) for a in found["alpha"])) - float(w @ w) / 2
        if k + 1 == rounds or enough and k % 8 == 7:
            gap = _gap(rows, ratio, w, cost, dual)
            if gap <= enough:
                break
    return w, shares, gap


def _gap(rows: DataFrame, ratio: np.ndarray, w: np.ndarray, cost: float, dual: float) -> float:
    """How far the weights' objective is above the dual one, relative to it."""
    last = rows.sparkSession.sparkContext.broadcast((ratio, w))

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, w = last.value
        for batch in batches:
            out = [max(0.0, 1 - (1 if g else -1) * margin(x.values.to_numpy(), ratio, w)) for g, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["loss"])

    primal = float(w @ w) / 2 + cost * rows.select("good", "feats").mapInArrow(losses, "loss double").agg(F.sum("loss")).first()[0]
    return (primal - dual) / max(primal, 1e-9)


def margin(x: np.ndarray, ratio: np.ndarray, w: np.ndarray) -> float:
    return float(w[x] @ scaled(x, ratio) + w[SIZE])


def logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's curve, by Newton steps with his smoothed targets."""
    n1, n0 = good.sum(), (1 - good).sum()
    target = np.where(good > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(g * margins).sum(), g.sum()]))
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def sample(docs: DataFrame, labels: DataFrame, folds: int, most_labelled: int) -> DataFrame:
    """good, part (0 to 2), feats, order and weight of the sampled labelled rows: equal rows of one id are one, with their number
    as its weight."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("good"))
    known = known.filter(F.pmod(crc32_of_id(), F.lit(folds)) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    rows = docs.join(F.broadcast(known), "doc_id").select("good", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)).cast("int").alias("part"), "text", F.xxhash64("doc_id", "text").alias("order"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats = pa.array([features(t) for t in utf8(batch.column(2))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), feats, batch.column(3)], ["good", "part", "feats", "order"])

    found = rows.mapInArrow(run, "good int, part int, feats array<int>, order long")
    return found.groupBy("order", "good", "part").agg(F.first("feats").alias("feats"), F.count("*").cast("int").alias("weight"))


def count_ratio(rows: DataFrame, smoothing: float) -> tuple[np.ndarray, int, int]:
    """The class log-count ratio of every feature, and the rows of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE + 1), np.int64)
        for batch in batches:
            for good, x, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                counts[good, x.values.to_numpy()] += n
                counts[good, SIZE] += n
        at = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], ["f", "bad", "good"])

    table = rows.select("good", "feats", "weight").mapInArrow(run, "f int, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    counts = np.zeros((2, SIZE + 1))
    counts[0, table["f"]], counts[1, table["f"]] = table["bad"], table["good"]
    p, q = counts[1, :SIZE] + smoothing, counts[0, :SIZE] + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum()), int(counts[1, SIZE]), int(counts[0, SIZE])


def solved(flat: np.ndarray, ends: np.ndarray, y: np.ndarray, weight: np.ndarray, ratio: np.ndarray, cost: float, gap: float, most_epochs: int, seed: int) -> tuple[np.ndarray, float, int]:
    """The weights of all rows' hinge-loss model, its duality gap relative to the objective, and the epochs that it took. Rows are
    the features flat[ends[i - 1]:ends[i]]; a row of weight n is n rows."""
    n, values = len(ends), ratio[flat].astype(np.float32)
    starts = np.concatenate([[0], ends[:-1]])
    full = ends > starts
    norms = np.ones(n)
    norms[full] = np.maximum(1e-9, np.sqrt(np.add.reduceat(values.astype(float) ** 2, starts[full])))
    values /= np.repeat(norms, ends - starts).astype(np.float32)
    rows = [(flat[a:b], values[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    squares = np.where(full, 2.0, 1.0)  # with the constant
    w, alpha, most, rng = np.zeros(SIZE), np.zeros(n), cost * weight, np.random.default_rng(seed)
    bias, reached = 0.0, np.inf
    for epoch in range(1, most_epochs + 1):
        for i in rng.permutation(n).tolist():
            x, v = rows[i]
            new = min(max(alpha[i] - (y[i] * (float(w[x] @ v) + bias) - 1) / squares[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
        margins = np.full(n, bias)
        margins[full] += np.add.reduceat(w[flat] * values, starts[full])
        square = float(w @ w) + bias * bias
        primal = square / 2 + cost * float(weight @ np.maximum(0.0, 1 - y * margins))
        reached = (primal - (float(alpha.sum()) - square / 2)) / max(primal, 1e-9)
        if reached <= gap:
            break
    return np.append(w, bias), reached, epoch


def models(rows: DataFrame, ratio: np.ndarray, cost: float, gap: float, most_epochs: int) -> dict[int, tuple[np.ndarray, float, int]]:
    """A model of each pair of the sample's parts, by the part that it lacks, and one of all, by PARTS: weights, gap, epochs. A
    model is one task, over a sample that is bounded."""
    shared = rows.sparkSession.sparkContext.broadcast(ratio)

    def each(key, group):
        group = group.combine_chunks().sort_by("order")
        feats = group.column("feats").combine_chunks()
        flat, ends = feats.flatten().to_numpy(), np.cumsum(feats.value_lengths().to_numpy())
        y = np.where(group.column("good").to_numpy() > 0, 1.0, -1.0)
        w, reached, epochs = solved(flat, ends, y, group.column("weight").to_numpy().astype(float), shared.value, cost, gap, most_epochs, 7)
        return pa.table({"model": key[0].cast(pa.int32()).as_py() * np.ones(1, np.int32), "w": pa.array([w]), "gap": [reached], "epochs": pa.array([epochs], pa.int32())})

    every = F.filter(F.sequence(F.lit(0), F.lit(PARTS)), lambda m: m != F.col("part"))
    found = rows.withColumn("model", F.explode(every)).groupBy("model").applyInArrow(each, "model int, w array<double>, gap double, epochs int")
    return {r["model"]: (np.array(r["w"]), r["gap"], r["epochs"]) for r in found.collect()}


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, folds: int, most_labelled: int, smoothing: float = 1.0, cost: float = 1.0, gap: float = 0.01, most_epochs: int = 300, shard_rows: int = 20_000, most_rounds: int = 200) -> tuple:
    """ratio, weights, slope and offset of the model."""
    rows = scratch.save(sample(docs, labels, folds, most_labelled))
    ratio, n_good, n_bad = count_ratio(rows, smoothing)
    if not n_good or not n_bad:
        return np.zeros(SIZE), np.zeros(SIZE + 1), 0.0, float(np.log((n_good + 1) / (n_bad + 1)))
    context, n = docs.sparkSession.sparkContext, rows.count()
    if n <= shard_rows:
        found = {k: x[0] for k, x in models(rows, ratio, cost, gap, most_epochs).items()}
    else:
        each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight")))).withColumn("shard", F.pmod(F.xxhash64("order", "copy"), F.lit(-(-n // shard_rows))).cast("int"))
        found = {k: descended(each.filter(F.col("part") != k), ratio, scratch, cost, most_rounds, 3, gap)[0] for k in range(PARTS + 1)}
    w = found[PARTS]
    shared, crossed = context.broadcast(ratio), context.broadcast({k: found.get(k, w) for k in range(PARTS)})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [margin(x.values.to_numpy(), shared.value, crossed.value[s]) for s, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), batch.column(0), batch.column(3)], ["m", "good", "weight"])

    seen = rows.select("good", "part", "feats", "weight").mapInArrow(judge, "m double, good int, weight int").toPandas()
    return ratio, w, *logistic(*(np.repeat(seen[c].to_numpy(float), seen["weight"]) for c in ("m", "good")))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, most_labelled: int = 20_000, **fitting: float) -> DataFrame:
    """doc_id, held_out, score (higher: better text) and predicted of every row."""
    spark = arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ratio, w, slope, offset = fit(docs, labels, Scratch(spark), folds, most_labelled, **fitting)
    shared = spark.sparkContext.broadcast((ratio.astype(np.float32), w.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, w = shared.value
        for batch in batches:
            m = np.array([margin(features(t), ratio, w) for t in utf8(batch.column(1))], np.float64)
            score = np.round(1 / (1 + np.exp(-np.clip(slope * m + offset, -30, 30))), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    out = docs.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (F.pmod(crc32_of_id(), F.lit(folds)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
