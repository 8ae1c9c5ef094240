"""Language-model scores by Brown's class-based bigrams.

Training counts every word of every training text, in Spark. The most frequent words, `heads`, and the endings of all
others are the types of a first clustering by exchange: one type after another moves to the class where the likelihood
of the class bigram model grows most. Several starts run in parallel, each on the whole table of neighbouring types,
whose size is bounded by the number of types; the likeliest clustering is taken. Then every other training word, however
rare, is exchanged too: its counts of classes before and behind are summed in Spark, and it moves from the class of its
ending to its own best class. These words are judged in parallel, each against the class bigram counts as they stand,
less its own. Only words that training doesn't have keep the class of their ending.

A token's probability is weight * P(class | class before) * P(word | class) + (1 - weight) * P0(word). P0 is the
additively smoothed unigram of the base score. In P(word | class), the share of words seen once goes to unseen words,
which count as one event per class. The text before the first token, and the end of a text, are the end token.

Five passes read the texts: word counts, neighbouring types, neighbouring classes of each word, class bigrams, scores.
The counts and classes of all words are a table and needn't fit anywhere: the last two passes look up the `most_lookup`
most frequent words in a broadcast table of that bounded size; a token that is, or follows, a rarer word becomes a row
that is joined with the table by shuffle. Words are carried as 64-bit hashes.

Null texts are empty; an empty text is its end token alone. Repeated rows are counted and scored each by itself. Ties
in frequency are broken by hash. Without training texts all counts are zero; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.shared import Scratch, arrow_batches, crc32_of_id

ENDINGS = 256
PUNCTUATION = string.punctuation.encode()
#: Counts up to which a word's gains are looked up, and words judged at once.
TABLED, JUDGED = 16, 4096


def ending(word: bytes) -> int:
    """A number for the last letters of a word."""
    return zlib.crc32((word.rstrip(PUNCTUATION) or word)[-3:]) % ENDINGS


class Tokens:
    """The words of some texts: each different one once, and for each token its number among them and its text."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        self.words = coded.dictionary.cast(pa.binary()).to_pylist()
        self.at, self.text = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        if b"" in self.words:  # before white space at the start of a text, or behind it at the end
            inside = self.at != self.words.index(b"")
            self.at, self.text = self.at[inside], self.text[inside]
        self.sizes = np.bincount(self.text, minlength=len(texts)).astype(np.int64)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words)).view(np.int64)

    def endings(self, chosen: np.ndarray) -> np.ndarray:
        """Numbers of the endings of the chosen words."""
        return np.fromiter((ending(self.words[i]) for i in chosen.tolist()), np.int64, len(chosen))

    def path(self, values: np.ndarray, end) -> np.ndarray:
        """The value of each token, with the end's before the first text and behind each."""
        out = np.full(len(self.at) + len(self.sizes) + 1, end, values.dtype)
        out[np.arange(len(self.at)) + self.text + 1] = values[self.at]
        return out


def find(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, -1)


def word_counts(texts: DataFrame) -> DataFrame:
    """h, ending and c of every word of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Tokens(batch.column(0))
            c = np.bincount(t.at, minlength=len(t.words))
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(t.hashes[used]), pa.array(t.endings(used).astype(np.int16)), pa.array(c[used])], ["h", "ending", "c"])

    return texts.select("text").mapInArrow(run, "h long, ending short, c long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


def types_of(t: Tokens, heads: np.ndarray) -> np.ndarray:
    """The type of each word: its place among the sorted heads, or its ending behind them."""
    out = find(heads, t.hashes)
    tail = np.flatnonzero(out < 0)
    out[tail] = len(heads) + t.endings(tail)
    return out


def neighbour_counts(texts: DataFrame, heads: np.ndarray) -> DataFrame:
    """a, b and n: how often type b follows type a. Types: the sorted heads, then the endings, then the end token."""
    types = len(heads) + ENDINGS + 1
    shared = texts.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(types * types, np.int64)
        for batch in batches:
            t = Tokens(batch.column(0))
            one = t.path(types_of(t, shared.value), types - 1)
            total += np.bincount(one[:-1] * types + one[1:], minlength=types * types)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((used // types).astype(np.int32)), pa.array((used % types).astype(np.int32)), pa.array(total[used])], ["a", "b", "n"])

    return texts.select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_class(a: int, left: np.ndarray, right: np.ndarray, own: float, matrix: np.ndarray, sizes: np.ndarray, n: float) -> int:
    """The class that gives the class bigram model the highest likelihood if a type of class a moves there.

    left, right: how often the type stands behind and before each class; own: before itself; n: how often at all.
    """
    left, right = left.copy(), right.copy()
    rest, counts = matrix.copy(), sizes.copy()
    rest[a, :] -= right
    rest[:, a] -= left
    rest[a, a] += own
    counts[a] -= n
    left[a] -= own
    right[a] -= own
    before = xlogx(rest)
    gain = (xlogx(rest + right[None, :]) - before).sum(1) + (xlogx(rest + left[:, None]) - before).sum(0)
    d, b = np.diag(rest), np.diag(before)
    gain += (xlogx(d + right + left + own) - b) - (xlogx(d + right) - b) - (xlogx(d + left) - b)
    gain -= 2 * (xlogx(counts + n) - xlogx(counts))
    gain[-1] = -np.inf  # the end token's class is its own
    return a if gain[a] >= gain.max() - 1e-9 else int(gain.argmax())


def exchange(pairs: np.ndarray, classes: int, sweeps: int, start: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Classes of types, class bigram counts and likelihood, from how often type b follows type a.

    Types move one after another, the most frequent first, until a sweep moves none or `sweeps` are done. The last
    type is the end token, alone in the last class.
    """
    types, n = len(pairs), pairs.sum(0)
    of = np.arange(types) % (classes - 1) if start == 0 else np.random.default_rng(start).integers(0, classes - 1, types)
    of[types - 1] = classes - 1
    one = np.zeros((types, classes))
    one[np.arange(types), of] = 1
    ahead = np.ascontiguousarray(pairs.T)
    left, right = ahead @ one, pairs @ one
    matrix = one.T @ right
    sizes = matrix.sum(0)
    for _ in range(sweeps):
        moved = 0
        for t in np.argsort(-n, kind="stable"):
            if t == types - 1 or not n[t]:
                continue
            a, own = of[t], pairs[t, t]
            b = best_class(a, left[t], right[t], own, matrix, sizes, n[t])
            if a == b:
                continue
            from_left, from_right = left[t].copy(), right[t].copy()
            matrix[a, :] -= from_right
            matrix[:, a] -= from_left
            matrix[a, a] += own
            from_left[a] -= own
            from_right[a] -= own
            matrix[b, :] += from_right
            matrix[:, b] += from_left
            matrix[b, b] += own
            sizes[a] -= n[t]
            sizes[b] += n[t]
            left[:, a] -= pairs[t]
            left[:, b] += pairs[t]
            right[:, a] -= ahead[t]
            right[:, b] += ahead[t]
            of[t], moved = b, moved + 1
        if not moved:
            break
    return of, matrix, float(xlogx(matrix).sum() - 2 * xlogx(sizes).sum())


def cluster(pairs: DataFrame, types: int, classes: int, sweeps: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The best clustering of several starts, each in a task of its own.

    What a task gets is bounded by the number of types, whatever the corpus: types * types counts at the most.
    """
    rows = pairs.groupBy("a").agg(F.collect_list("b").alias("b"), F.collect_list("n").alias("n"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((types, types))
        for a, b, n in zip(part["a"], part["b"], part["n"], strict=True):
            table[a, b] = n
        of, matrix, likelihood = exchange(table, classes, sweeps, int(part["start"].iloc[0]))
        return pd.DataFrame({"start": [part["start"].iloc[0]], "likelihood": [likelihood], "of": [of.tolist()], "matrix": [matrix.ravel().tolist()]})

    each = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))).groupBy("start")
    found = each.applyInPandas(run, "start int, likelihood double, of array<int>, matrix array<double>").toPandas()
    if not len(found):
        of = np.arange(types) % (classes - 1)
        of[types - 1] = classes - 1
        return of, np.zeros((classes, classes))
    best = found.sort_values(["likelihood", "start"], ascending=[False, True]).iloc[0]
    return np.array(best["of"], np.int64), np.array(best["matrix"]).reshape(classes, classes)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts: as many counts as together have `most` words at the most."""
    sizes = counts.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c")).limit(100_000).toPandas()
    inside = sizes["words"].cumsum() <= most
    return counts.filter(F.col("c") >= int(sizes["c"][inside].min())) if inside.any() else counts.limit(0)


def neighbouring_classes(texts: DataFrame, heads: np.ndarray, of: np.ndarray, classes: int) -> DataFrame:
    """h, first (the class of the ending), slots and counts of every word but the heads: how often each class stands
    before it (slot: the class) and behind it (slot: classes + the class). Packed: a byte and two bytes a slot."""
    shared = texts.sparkSession.sparkContext.broadcast((heads, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, of = shared.value
        for batch in batches:
            t = Tokens(batch.column(0))
            type_ = types_of(t, heads)
            path, words = t.path(of[type_].astype(np.int64), classes - 1), t.path(np.where(type_ < len(heads), -1, np.arange(len(type_))), -1)
            here = np.flatnonzero(words >= 0)
            key, n = np.unique(np.concatenate([words[here] * 2 * classes + path[here - 1], words[here] * 2 * classes + classes + path[here + 1]]), return_counts=True)
            times = -(-n // 0xFFFF)  # a count beyond two bytes takes several slots
            key, part = np.repeat(key, times), np.minimum(np.repeat(n, times) - 0xFFFF * (np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)), 0xFFFF)
            word, starts = np.unique(key // (2 * classes), return_index=True)
            ends = np.append(starts, len(key)).astype(np.int32)
            slots = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer((key % (2 * classes)).astype(np.uint8).tobytes())])
            counts = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer((2 * ends).tobytes()), pa.py_buffer(part.astype("<u2").tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(t.hashes[word]), pa.array(of[type_[word]].astype(np.int16)), slots, counts], ["h", "first", "slots", "counts"])

    return texts.select("text").mapInArrow(run, "h long, first short, slots binary, counts binary")


def best_classes(word: np.ndarray, slot: np.ndarray, n: np.ndarray, first: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The class of the highest likelihood for each word, by its counts n of slots; word numbers ascend from 0.

    A word's gain in a class is what its counts add to the sums of x log x over the class bigrams and sizes; its present
    class, `first`, is taken without the word. Of equals the present class stays, else the smallest is taken.
    """
    classes = len(matrix)
    table = np.concatenate([matrix, matrix.T])  # row: slot; column: the word's class
    base = xlogx(table)
    steps = np.stack([xlogx(table + k) - base for k in range(TABLED)])
    gain = np.empty((len(word), classes))
    low = n < TABLED
    gain[low] = steps[n[low], slot[low]]
    gain[~low] = xlogx(table[slot[~low]] + n[~low, None]) - base[slot[~low]]
    own = first[word]
    at = np.arange(len(word))
    gain[at, own] = base[slot, own] - xlogx(np.maximum(table[slot, own] - n, 0))
    total = np.add.reduceat(gain, np.flatnonzero(np.diff(word, prepend=-1)), axis=0)
    count, sizes = np.bincount(word, n * (slot < classes))[:, None], matrix.sum(0)
    each, me = np.arange(len(first)), first
    cost = 2 * (xlogx(sizes + count) - xlogx(sizes))
    cost[each, me] = 2 * (xlogx(sizes[me]) - xlogx(np.maximum(sizes[me] - count[:, 0], 0)))
    total -= cost
    total[:, -1] = -np.inf  # the end token's class is its own
    best = total.argmax(1)
    return np.where(total[each, me] >= total[each, best] - 1e-9, me, best)


def exchanged(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    """h, c and class of every word of neighbouring_classes. A word's rows follow each other, so that sums need no group."""
    classes = len(matrix)
    shared = rows.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # h, first, and the sums of slots of the word that may go on

        def judge(h: np.ndarray, first: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            word, slot = np.nonzero(sums)
            cls = best_classes(word, slot, sums[word, slot], first, shared.value)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(sums[:, :classes].sum(1)), pa.array(cls.astype(np.int16))], ["h", "c", "class"])

        for batch in batches:
            for at in range(0, batch.num_rows, JUDGED):
                part = batch.slice(at, JUDGED)
                h, first = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = pc.binary_length(part.column(2)).to_numpy(zero_copy_only=False)
                slot = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).astype(np.int64)
                n = np.frombuffer(b"".join(part.column(3).to_pylist()), "<u2").astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                word = np.repeat(np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])), sizes)
                sums = np.bincount(word * 2 * classes + slot, n, 2 * classes * len(starts)).astype(np.int64).reshape(-1, 2 * classes)
                h, first = h[starts], first[starts]
                if held is not None and held[0][0] == h[0]:
                    sums[0] += held[2][0]
                elif held is not None:
                    yield judge(*held)
                if len(h) > 1:
                    yield judge(h[:-1], first[:-1], sums[:-1])
                held = [h[-1:], first[-1:], sums[-1:]]
        if held is not None:
            yield judge(*held)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, c long, class short")


class Lookup:
    """What a task knows of words: count and class of the most frequent ones, the class of every ending."""

    def __init__(self, top: pa.Table, ending_class: np.ndarray):
        order = np.argsort(top["h"].to_numpy())
        self.h, self.c, self.cls = (top[k].to_numpy()[order] for k in ("h", "c", "class"))
        self.ending_class = ending_class

    def __call__(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of each word; the count is -1 where only the ending is known."""
        at = find(self.h, t.hashes)
        rare = np.flatnonzero(at < 0)
        cls, count = (x[at].copy() if len(x) else np.zeros(len(at), np.int64) for x in (self.cls.astype(np.int64), self.c.astype(np.int64)))
        cls[rare], count[rare] = self.ending_class[t.endings(rare)], -1
        return cls, count


def hidden(h: np.ndarray, rare: np.ndarray) -> pa.Array:
    """Hashes of rare words; null for others."""
    return pa.array(h, mask=~rare)


def class_bigrams(texts: DataFrame, words: DataFrame, lookup, classes: int, scratch: Scratch) -> np.ndarray:
    """How often a word of class b follows one of class a, by the classes of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            t = Tokens(batch.column(0))
            cls, count = lookup.value(t)
            path, known, h = t.path(cls, classes - 1), t.path(count >= 0, True), t.path(t.hashes, 0)
            both = known[1:] & known[:-1]
            total += np.bincount((path[:-1] * classes + path[1:])[both], minlength=classes * classes)
            open_ = np.flatnonzero(~both)
            yield pa.RecordBatch.from_arrays(
                [hidden(h[open_], ~known[open_]), pa.array(path[open_].astype(np.int16)), hidden(h[open_ + 1], ~known[open_ + 1]), pa.array(path[open_ + 1].astype(np.int16)), pa.array(np.ones(len(open_), np.int64))], ["ha", "a", "hb", "b", "n"]
            )
        used = np.flatnonzero(total)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array((used // classes).astype(np.int16)), none, pa.array((used % classes).astype(np.int16)), pa.array(total[used])], ["ha", "a", "hb", "b", "n"])

    rows = texts.select("text").mapInArrow(run, "ha long, a short, hb long, b short, n long")
    # First one row per pair of classes and rare words, written as it is read four times; then their classes.
    rows = scratch.save(rows.groupBy("ha", "a", "hb", "b").agg(F.sum("n").alias("n")))
    found = with_classes(rows, words.select("h", "class"), "ha", "a", "hb", "b").groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((classes, classes))
    out[found["a"], found["b"]] = found["n"]
    return out


def with_classes(rows: DataFrame, words: DataFrame, *pairs: str) -> DataFrame:
    """Rows with the classes that words has for their hashes. pairs: hash column, class column, and so on. Rows without a
    hash take no part in its join, so they aren't a hot key; other columns of words are joined at the last pair."""
    for at in range(0, len(pairs), 2):
        h, cls = pairs[at : at + 2]
        more = [c for c in words.columns if c not in ("h", "class")] if at + 2 == len(pairs) else []
        known = words.select(F.col("h").alias(h), F.col("class").alias("__found"), *more)
        joined = rows.filter(F.col(h).isNotNull()).join(known, h, "left").withColumn(cls, F.coalesce("__found", cls)).drop("__found")
        others = rows.filter(F.col(h).isNull())
        for c in more:
            others = others.withColumn(c, F.lit(None).cast(words.schema[c].dataType))
        rows = joined.unionByName(others)
    return rows


def by_class(values: np.ndarray, cls: str) -> Column:
    """A number for each class: classes are few."""
    return F.get(F.array(*(F.lit(float(v)) for v in values)), F.col(cls).cast("int"))


def class_model_scores(docs: DataFrame, folds: int = 10, classes: int = 64, heads: int = 2048, sweeps: int = 6, starts: int = 2, most_lookup: int = 1_000_000, weight: float = 0.95, alpha: float = 0.1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row (log10)."""
    if not 2 <= classes <= 128:
        raise ValueError("classes must be 2 to 128")
    # A batch's tokens become some arrays of eight bytes each: less than the usual size keeps workers small.
    spark = arrow_batches(docs.sparkSession, 6 << 20)
    scratch, context = Scratch(spark), spark.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.pmod(crc32_of_id(), F.lit(folds)) == 0).alias("held_out"))
    train = rows.filter("not held_out").select("text")

    counts = scratch.save(word_counts(train))
    texts = train.count()
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] + texts, totals["v"] + (texts > 0)
    floor = n + alpha * (v + 1)
    head = np.sort(counts.orderBy(F.desc("c"), "h").limit(heads).toPandas()["h"].to_numpy(np.int64))
    types = len(head) + ENDINGS + 1

    of, matrix = cluster(scratch.save(neighbour_counts(train, head)), types, classes, sweeps, starts)
    is_head = F.broadcast(spark.createDataFrame([(int(h), int(of[i])) for i, h in enumerate(head)], "h long, class short"))
    words = scratch.save(exchanged(neighbouring_classes(train, head, of, classes), matrix).unionByName(counts.join(is_head, "h").select("h", "c", "class")))
    per_class = words.groupBy("class").agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once")).toPandas()
    size, once = np.zeros(classes), np.zeros(classes)
    size[per_class["class"]], once[per_class["class"]] = per_class["c"], per_class["once"]
    size[classes - 1] += texts
    unseen = (once + 0.5) / (size + 1)
    unseen[classes - 1] = 0.0

    lookup = context.broadcast(Lookup(most_frequent(words, most_lookup).toArrow(), of[len(head) : len(head) + ENDINGS]))
    matrix = class_bigrams(train, words, lookup, classes, scratch)
    after = (matrix + 0.5) / (matrix.sum(1, keepdims=True) + 0.5 * classes)
    model = context.broadcast((after, unseen, np.maximum(size, 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, unseen, size = model.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            t = Tokens(batch.column(1))
            cls, count = lookup.value(t)
            # One place per token and per end; the end before the first text only precedes.
            path, seen, h = t.path(cls, classes - 1), t.path(count, texts), t.path(t.hashes, 0)
            emits = t.path((1 - unseen[cls]) * count / size[cls], 1.0)
            text, known = np.repeat(np.arange(len(t.sizes)), t.sizes + 1), seen >= 0
            p0 = np.where(known, (seen + alpha) / floor, 1.0)[1:]
            both = known[1:] & known[:-1]
            p = np.where(both, weight * after[path[:-1], path[1:]] * emits[1:] + (1 - weight) * p0, 1.0)
            sums = [np.bincount(text, x, len(t.sizes)) for x in (known[1:] & (seen[1:] > 0), np.log10(p0), np.log10(p))]
            ids = np.arange(row, row + len(t.sizes))
            open_ = np.flatnonzero(~both)
            known_ = known[open_ + 1]
            k, m = len(ids), len(open_)
            head = [batch.column(0), batch.column(2), pa.array(t.sizes + 1), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            rare = [
                hidden(h[open_], ~known[open_]), pa.array(path[open_].astype(np.int16)), hidden(h[open_ + 1], ~known_), pa.array(path[open_ + 1].astype(np.int16)),
                pa.array(emits[open_ + 1], mask=~known_), pa.array(p0[open_], mask=~known_),
            ]
            columns = [pa.array(np.concatenate([ids, ids[text[open_]]])), *(pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in head), *(pa.concat_arrays([pa.nulls(k, c.type), c]) for c in rare)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(k + m) >= k)], [c.split()[0] for c in MADE.split(", ")])
            row += k

    made = scratch.save(rows.select("doc_id", "text", "held_out").mapInArrow(score, MADE))
    rare = with_classes(made.filter("rare").select("row", "ha", "a", "hb", "b", "emits", "p0"), words, "ha", "a", "hb", "b")
    step = F.broadcast(spark.createDataFrame([(a, b, float(after[a, b])) for a in range(classes) for b in range(classes)], "a short, b short, step double"))
    count, is_rare = F.coalesce("c", F.lit(0)), F.col("hb").isNotNull()
    emits = F.when(count > 0, (1 - by_class(unseen, "b")) * count / by_class(np.maximum(size, 1), "b")).otherwise(by_class(unseen, "b"))
    rare = rare.select("row", "a", "b", is_rare.alias("is_rare"), count.alias("c"), F.when(is_rare, emits).otherwise(F.col("emits")).alias("emits"), F.when(is_rare, (count + alpha) / F.lit(float(floor))).otherwise(F.col("p0")).alias("p0"))
    p = weight * F.col("step") * F.col("emits") + (1 - weight) * F.col("p0")
    sums = rare.join(step, ["a", "b"]).groupBy("row").agg(
        F.count_if(F.col("is_rare") & (F.col("c") > 0)).alias("r_known"), F.sum(F.when(F.col("is_rare"), F.log10("p0")).otherwise(0.0)).alias("r_base"), F.sum(F.log10(p)).alias("r_score")
    )
    whole = made.filter("not rare").join(sums, "row", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("r_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        F.round(F.col("base") + F.coalesce("r_base", F.lit(0.0)), 6).alias("base_score"), F.round(F.col("score") + F.coalesce("r_score", F.lit(0.0)), 6).alias("score"),
    )


#: Rows of the last pass: one per text, then one per token that is or follows a rare word.
MADE = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, ha long, a short, hb long, b short, emits double, p0 double, rare boolean"
