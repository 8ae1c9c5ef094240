"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Documents are tokenised, closed with an end id and, only where longer than a sequence, cut. The pieces are dealt by
hash of their place in the written table into blocks of bounded size, since packings of a few thousand pieces already
come to within a sequence of the bound. A block has some sequences' worth of tokens at least.

A block's goal is ceil(tokens / capacity) sequences of which all but one are full: then nothing is lost but what the
last sequence lacks. Best-fit decreasing is tried first, once. Blocks that miss the goal, mostly by sequences that
lack a few tokens, are solved by several islands in parallel. An island starts from that packing and noisy best-fit packings. Its crossover injects whole well-filled sequences of one parent into the other, removes
the sequences that hold duplicates, opens some with room, exchanges pieces of the others for displaced ones that fill
them better, and best-fits what is left. After each epoch every island's elite takes the place of the worst packing of the
next island of its block. A block ends as soon as an island meets the goal.

The least filled sequence of every block is opened again and its pieces are packed together in a further round, so
that what blocks lose at their ends doesn't add up; each round has an eighth of the tokens of the one before, or less.

Null texts are empty; an empty text is the end id alone; an empty table gives no rows. Repeated rows are packed each by
itself. Ties in length are dealt in the order of (doc_id, piece), no id first. Columns other than the id and the text
are not read. Memory is bounded by a block, the largest text and a word cache of fixed size.
"""

from __future__ import annotations

import os
import random
import re
import string
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrivener.llm.shared import Scratch, arrow_batches, ranges

#: Words that a worker keeps with their ids, words without their punctuation, and the longest word that it keeps.
CACHE_WORDS, CACHE_STEMS, CACHE_CHARS = 1_000_000, 500_000, 40
#: Missing words that are encoded in one call.
ENCODE_AT_ONCE = 2000
#: Sequences' worth of tokens in a block, on average and at the least.
LEAST_SEQUENCES = 8
#: Unicode's white space without these, which str.split() and Arrow take for blanks too: they have tokens of their own.
SEPARATORS, WORD = "[\x1c-\x1f]", re.compile(r"[\S\x1c-\x1f]+")

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
_tokenizers: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """A tokenizer that drops white space, applied word by word: no token spans a blank, so words can be cached.

    The cache is columns: the words, and for each where its ids stand in one array of ids, and how many there are. A batch's
    distinct words are looked up in one call, and only those that aren't known become Python's.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.first, self.many, self.pool = pa.array([""]), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")
        self.stems: dict[str, bytes] = {"": b""}

    def _ids(self, words: list[str]) -> dict[str, bytes]:
        """Words of small ASCII letters are one unit of the model, as they are; others take all its steps."""
        out = {w: np.array([t.id for t in self.model.tokenize(w)], "<u4").tobytes() for w in words if w.isascii() and w.isalpha() and w.islower()}
        rest = [w for w in words if w not in out]
        return out | {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True)}

    def _learn(self, missing: list[str]) -> list[bytes]:
        """The ids of words that aren't known, little-endian unsigned 32-bit numbers."""
        if len(self.stems) > CACHE_STEMS:  # what came first is mostly what comes often
            self.stems = dict(islice(self.stems.items(), CACHE_STEMS // 2))
        stems, out = self.stems, []
        for at in range(0, len(missing), ENCODE_AT_ONCE):
            part = missing[at : at + ENCODE_AT_ONCE]
            cut = [_stem(w) for w in part]
            tails = [w[len(s) :] for w, s in zip(part, cut, strict=True)]
            new = self._ids(list({x for x in (*cut, *tails) if x not in stems}))
            out += [(new[s] if s in new else stems[s]) + (new[t] if t in new else stems[t]) for s, t in zip(cut, tails, strict=True)]
            stems.update((x, ids) for x, ids in new.items() if len(x) <= CACHE_CHARS)
        return out

    def _keep(self, words: list[str], first: np.ndarray, many: np.ndarray, ids: np.ndarray) -> None:
        """Learn words for later batches; what came last goes where there are too many."""
        short = np.fromiter((len(w) <= CACHE_CHARS for w in words), bool, len(words))
        kept = ids[ranges(first[short], many[short])]
        self.words = pa.concat_arrays([self.words, pa.array([w for w, k in zip(words, short.tolist(), strict=True) if k], pa.string())])
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(many[short]) - many[short]])
        self.many, self.pool = np.concatenate([self.many, many[short]]), np.concatenate([self.pool, kept])
        if len(self.words) > CACHE_WORDS:
            n = CACHE_WORDS // 2
            self.words, self.pool = pa.concat_arrays([self.words.slice(0, n)]), self.pool[: self.first[n]].copy()
            self.first, self.many = self.first[:n].copy(), self.many[:n].copy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text ends."""
        texts = texts.fill_null("")
        if pc.any(pc.match_substring_regex(texts, SEPARATORS)).as_py():
            split = pa.array([WORD.findall(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        place = pc.index_in(words, value_set=self.words)
        known = place.fill_null(0).to_numpy()
        first, many, pool = self.first[known], self.many[known], self.pool
        if place.null_count:
            unknown = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
            missing = words.take(pa.array(unknown)).to_pylist()
            found = self._learn(missing)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), "<u4")
            first[unknown], many[unknown], pool = len(pool) + starts, sizes, np.concatenate([pool, ids])
            self._keep(missing, starts, sizes, ids)
        ids = pool[ranges(first[at], many[at])]
        token_ends = np.concatenate([[0], np.cumsum(many[at])])
        word_ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        return ids, token_ends[word_ends.astype(np.int64)]


def _stem(word: str) -> str:
    """The word without a tail of punctuation and, where it is ASCII, in lower case: the same ids but for the tail's.

    The tokenizer lower-cases and never joins a letter or digit to punctuation. Left whole are words with an apostrophe,
    with the start of a special token, or whose last sign, in lower case, ends in a mark.
    """
    if "'" in word or "<|" in word:
        return word
    stem = word.rstrip(string.punctuation)
    if not stem or not (stem[-1].lower().isalpha() or stem[-1] in string.digits) or len(word) - len(stem) > 8:
        stem = word
    return stem.lower() if stem.isascii() else stem


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = _tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, ends = tokenizer.encode(batch.column(1))
            raw, rows, begin = memoryview(ids.tobytes()), [], 0
            for doc, stop in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                for piece, start in enumerate(range(0, stop - begin + 1, capacity)):
                    stops = min(stop - begin, start + capacity)
                    crc, last = zlib.crc32(raw[4 * (begin + start) : 4 * (begin + stops)]), stops - start < capacity
                    rows.append((doc, piece, start, stops - start + last, zlib.crc32(end, crc) if last else crc))
                begin = stop
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)] if rows else [pa.array([], t) for t in KINDS]
            yield pa.RecordBatch.from_arrays(columns, NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Bin = tuple[int, tuple[int, ...]]  # how full it is, and its pieces


def best_fit(lengths: list[int], items: list[int], bins: list[Bin], capacity: int) -> list[Bin]:
    """Put each item, in the order given, into the fullest bin that has room, else into a new one. Room and bin are one
    number each, in order."""
    held, left = [list(b) for _, b in bins], [capacity - fill for fill, _ in bins]
    spaces = sorted(space << 20 | k for k, space in enumerate(left) if space)
    for i in items:
        need = lengths[i]
        at = bisect_left(spaces, need << 20)
        if at < len(spaces):
            code = spaces.pop(at)
            k, space = code & 0xFFFFF, (code >> 20) - need
            held[k].append(i)
            left[k] = space
        else:
            k, space = len(held), capacity - need
            held.append([i])
            left.append(space)
        if space:
            insort(spaces, space << 20 | k)
    return [(capacity - s, tuple(b)) for s, b in zip(left, held, strict=True)]


def fitness(bins: list[Bin]) -> tuple[int, int]:
    """Fewer bins first, then more uneven filling: full bins, and one that is as empty as can be."""
    return -len(bins), sum(fill * fill for fill, _ in bins)


def exchange_pieces(lengths: list[int], bins: list[Bin], free: list[int], capacity: int) -> tuple[list[Bin], list[int]]:
    """In each bin with room change one piece for the longest free one that fits, if that fills the bin better. Returns
    the bins and what is free then."""
    sizes, out = sorted((lengths[i], i) for i in free), []
    for fill, items in bins:
        room, best = capacity - fill, None
        if room and sizes:
            for k, i in enumerate(items):
                at = bisect_right(sizes, (lengths[i] + room, 1 << 40)) - 1
                if at >= 0 and sizes[at][0] > lengths[i] and (best is None or sizes[at][0] - lengths[i] > best[0]):
                    best = sizes[at][0] - lengths[i], at, k
            if best:
                gain, at, k = best
                _, new = sizes.pop(at)
                insort(sizes, (lengths[items[k]], items[k]))
                fill, items = fill + gain, (*items[:k], new, *items[k + 1 :])
        out.append((fill, items))
    return out, [i for _, i in sizes]


def crossover(lengths: list[int], into: list[Bin], donor: list[Bin], capacity: int, rng: random.Random) -> list[Bin]:
    """Inject well-filled bins of the donor, drop the bins with duplicates, fit what is displaced. Full bins that stay are
    passed on as they are; only those with room are looked at again."""
    good = [b for b in donor if b[0] == capacity] or sorted(donor, reverse=True)[: max(1, len(donor) // 2)]
    injected = rng.sample(good, max(1, int(len(good) * rng.uniform(0.1, 0.5))))
    held = {i for _, b in injected for i in b}
    full, part, displaced = [], [], []
    for bin_ in into:
        if not held.isdisjoint(bin_[1]):
            displaced += [i for i in bin_[1] if i not in held]
        elif bin_[0] == capacity:
            full.append(bin_)
        else:
            part.append(bin_)
    # Mutation: the least filled bins, and some more, are opened too.
    part.sort()
    n = len(part) + len(full)
    few = max(1, n // 20)
    opened = {*range(min(few, n)), *(rng.sample(range(few, n), few) if n > 2 * few else ())}
    for k in opened:
        displaced += (part[k] if k < len(part) else full[k - len(part)])[1]
    first = len(part)
    part = [b for k, b in enumerate(part) if k not in opened]
    full = [b for k, b in enumerate(full, first) if k not in opened]
    part, displaced = exchange_pieces(lengths, part, displaced, capacity)
    displaced.sort(key=lengths.__getitem__, reverse=True)
    room = [b for b in injected if b[0] < capacity]
    return [b for b in injected if b[0] == capacity] + full + best_fit(lengths, displaced, room + part, capacity)


def meets_goal(bins: list[Bin], capacity: int) -> bool:
    """As few bins as can be, and all but one of them full."""
    return sum(fill < capacity for fill, _ in bins) <= 1


def evolved(lengths: list[int], given: list[list[int]], seed: int, capacity: int, population: int, generations: int) -> list[list[Bin]]:
    """One epoch of one island: its packings, the best first. Those that it begins with are given as the bin of each item;
    noisy best-fit packings fill them up."""
    rng, order, people = random.Random(seed), sorted(range(len(lengths)), key=lambda i: -lengths[i]), []
    for one in given:
        bins: dict[int, list[int]] = {}
        for i, k in enumerate(one):
            bins.setdefault(k, []).append(i)
        people.append([(sum(lengths[i] for i in b), tuple(b)) for b in bins.values()])
    while len(people) < population:
        people.append(best_fit(lengths, sorted(order, key=[-n * rng.uniform(0.7, 1) for n in lengths].__getitem__), [], capacity))
    fit = sorted(((fitness(p), p) for p in people), key=itemgetter(0), reverse=True)
    for _ in range(generations):
        if meets_goal(fit[0][1], capacity):
            break
        parents = [p for _, p in fit[: max(2, population // 2)]]
        children = [crossover(lengths, *rng.sample(parents, 2), capacity, rng) for _ in range(population // 2)]
        fit = sorted([*fit, *((fitness(p), p) for p in children)], key=itemgetter(0), reverse=True)[:population]
    return [p for _, p in fit[:population]]


def evolve(lengths: list[int], elites: list[list[int]], seed: int, capacity: int, population: int, generations: int) -> list[Bin]:
    """The best packing of one island's epoch."""
    return evolved(lengths, elites, seed, capacity, population, generations)[0]


def numbered(bins: list[Bin], n: int) -> list[int]:
    """The bin of each item; the least filled bin comes last."""
    out = [0] * n
    for k, (_, items) in enumerate(sorted(bins, reverse=True)):
        for i in items:
            out[i] = k
    return out


def _first(capacity: int):
    """Best-fit decreasing of one block: adds nth (its place in the order of lengths), bin and goal."""

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", *(c for c in NAMES if c != "length")], ascending=[False] + [True] * 4, kind="stable", na_position="first").reset_index(drop=True)
        lengths = items["length"].tolist()
        bins = best_fit(lengths, list(range(len(lengths))), [], capacity)
        items["nth"], items["bin"], items["goal"] = np.arange(len(lengths)), numbered(bins, len(lengths)), meets_goal(bins, capacity)
        return items

    return run


ISLAND = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int32())), ("people", pa.list_(pa.list_(pa.int32()))), ("rank", pa.int64()), ("goal", pa.bool_())])


def _islands(capacity: int, population: int, generations: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                people = evolved(r["lengths"], r["people"], hash((r["block"], r["island"], epoch)), capacity, population, generations)
                # What a packing loses: whole sequences, then what its least filled sequence holds.
                rank = len(people[0]) * capacity + min(fill for fill, _ in people[0])
                row = {"block": r["block"], "island": r["island"], "lengths": r["lengths"], "people": [numbered(p, len(r["lengths"])) for p in people], "rank": rank, "goal": meets_goal(people[0], capacity)}
                yield pa.RecordBatch.from_pylist([row], schema=ISLAND)

    return run


def pack_lengths(blocks: DataFrame, scratch: Scratch, capacity: int = 4096, islands: int = 3, epochs: int = 3, population: int = 8, generations: int = 12) -> DataFrame:
    """blocks: block long, lengths array<int>, elite array<int> (the bin of each length in a first packing). Returns
    block and elite: the best packing that an island found. An island keeps its packings from epoch to epoch; its neighbour's
    best one takes the place of its worst."""
    best, cores = None, 4 * blocks.sparkSession.sparkContext.defaultParallelism
    now = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.array("elite").alias("people"))
    for epoch in range(epochs):
        # Few bytes but much work: a number of partitions that is stated isn't coalesced.
        tasks = max(1, min(cores, now.select("block").count()))
        now = now.select("block", "island", "lengths", "people").repartition(tasks, "block", "island")
        now = scratch.save(now.mapInArrow(_islands(capacity, population, generations, epoch), "block long, island int, lengths array<int>, people array<array<int>>, rank long, goal boolean"))
        found = now.select("block", "island", "rank", F.element_at("people", 1).alias("elite"))
        best = found if best is None else best.unionByName(found)
        going = now.groupBy("block").agg(F.bool_or("goal").alias("any")).filter(~F.col("any")).select("block")
        if epoch + 1 == epochs or going.isEmpty():
            break
        migrants = found.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("guest"))
        now = now.join(migrants, ["block", "island"]).join(going, "block", "left_semi").withColumn("people", F.concat(F.slice("people", 1, population - 1), F.array("guest")))
    return best.groupBy("block").agg(F.min_by("elite", F.struct("rank", "island")).alias("elite"))


def n_blocks(count: int, tokens: int, capacity: int, block_size: int) -> int:
    """Blocks of about block_size pieces, but of LEAST_SEQUENCES sequences' worth of tokens, at the least.

    A round leaves less than a sequence of each block open, so the open tokens fall by that factor from round to round.
    """
    return max(1, min(-(-count // block_size), tokens // (LEAST_SEQUENCES * capacity)))


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = 4096, block_size: int = 2048, **search: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (with the columns of token_pieces)."""
    # Pieces are dealt by their number, as any number of rows can share an id. Written, the numbers don't change.
    pieces, out, of_round = scratch.save(pieces.select(*NAMES, F.monotonically_increasing_id().alias("row"))), None, 0
    while True:
        size = pieces.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        n = n_blocks(size["n"], size["tokens"], capacity, block_size)
        items = pieces.withColumn("block", F.pmod(F.xxhash64("row", F.lit(of_round)), F.lit(n)).cast("long"))
        kind = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, block long, nth int, bin int, goal boolean"
        placed = scratch.save(items.groupBy("block").applyInPandas(_first(capacity), kind))
        of_block = F.array_sort(F.collect_list(F.struct("nth", F.col("length").cast("int").alias("length"), "bin")))  # a block is bounded
        missed = placed.filter(~F.col("goal")).groupBy("block").agg(of_block.alias("x")).select("block", F.transform("x", lambda s: s["length"]).alias("lengths"), F.transform("x", lambda s: s["bin"]).alias("elite"))
        evolved = pack_lengths(missed, scratch, capacity, **search).select("block", F.posexplode("elite").alias("nth", "new"))
        placed = placed.join(evolved, ["block", "nth"], "left").withColumn("bin", F.coalesce("new", "bin"))
        # A bin's pieces: one sequence's worth at most. The least filled bin of a block has the last number.
        in_bin = Window.partitionBy("block", "bin").orderBy("nth")
        placed = placed.withColumn("offset", F.sum("length").over(in_bin) - F.col("length")).withColumn("sequence_id", F.lit(of_round << 56) + F.col("block") * (1 << 20) + F.col("bin"))
        if n == 1:
            closed = placed.select(*NAMES, "sequence_id", "offset")
            return closed if out is None else out.unionByName(closed)
        fill, last = F.sum("length").over(Window.partitionBy("block", "bin")), F.max("bin").over(Window.partitionBy("block"))
        placed = scratch.save(placed.withColumn("open", (F.col("bin") == last) & (fill < capacity)).select(*NAMES, "row", "sequence_id", "offset", "open"))
        closed = placed.filter(~F.col("open")).select(*NAMES, "sequence_id", "offset")
        out = closed if out is None else out.unionByName(closed)
        pieces, of_round = placed.filter("open").select(*NAMES, "row"), of_round + 1


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, **search: int) -> DataFrame:
    """All documents in sequences of at most `capacity` tokens."""
    scratch = Scratch(docs.sparkSession)
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), scratch, capacity, **search)
