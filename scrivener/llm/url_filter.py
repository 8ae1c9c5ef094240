"""URL filter: longest matching rule, and a cascade of Bloom filters for the list of blocked hosts.

The cascade is built over the complete universe of keys, all hosts of the corpus. Level 0 encodes the listed keys;
level 1 encodes the other keys that level 0 lets pass by mistake; level 2 the listed keys that level 1 lets pass by
mistake, and so on until a level makes no mistake. A key's membership is read off the first level that doesn't have
it, exactly, for every key of the universe and without a join. Levels are built by Spark: each one is a bit_or over
words of 64 bits. What is broadcast at once is bounded by `most_bytes`: a cascade that would exceed it is cut into parts
by key hash, each a cascade of its own, and each part judges its keys in a pass of its own.

Null urls and urls without `://` have an empty host and path, no rule, and the empty host is never listed. Repeated
rows are judged each by itself; other columns are not read. An empty list blocks nothing, nor do listed keys that no url
has; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.shared import Scratch, arrow_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: False-positive rates of the first level and of the others, as usual for such cascades.
FIRST_RATE, NEXT_RATE, MOST_LEVELS = 0.03, 0.5, 64
Rule = tuple[str, str, str]


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url."""
    text = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER), F.regexp_extract(text, PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(at + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _sizes(n: int, rate: float) -> tuple[int, int]:
    """Words of 64 bits and hash functions of a filter for n keys."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    return -(-bits // 64), max(1, round(-math.log2(rate)))


def _places(level: int, words: int, hashes: int) -> list[Column]:
    """Bit places of a key from its two hashes."""
    m = F.lit(64 * words)
    return [F.pmod(F.xxhash64("h1", "h2", F.lit(level), F.lit(j)), m) for j in range(hashes)]


class Level:
    """One Bloom filter, as words of bits."""

    def __init__(self, level: int, bits: np.ndarray, hashes: int):
        self.level, self.bits, self.hashes = level, bits, hashes

    def has(self, places: np.ndarray) -> np.ndarray:
        """places: one row per hash function."""
        return ((self.bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(0)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    """The keys that the level lets pass."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.array([batch.column(2 + j).to_numpy(zero_copy_only=False) for j in range(shared.value.hashes)])
            yield batch.select(["h1", "h2"]).filter(pa.array(shared.value.has(places)))

    columns = [c.alias(f"p{j}") for j, c in enumerate(_places(level.level, len(level.bits), level.hashes))]
    return keys.select("h1", "h2", *columns).mapInArrow(run, "h1 long, h2 long")


def cascade(hashed: DataFrame, scratch: Scratch) -> list[Level]:
    """Levels for hashed keys (h1, h2, listed), one row per key of the universe."""
    own, other = hashed.filter("listed").select("h1", "h2"), hashed.filter("not listed").select("h1", "h2")
    levels: list[Level] = []
    while n := own.count():
        words, hashes = _sizes(n, FIRST_RATE if not levels else NEXT_RATE)
        if len(levels) == MOST_LEVELS:
            raise ValueError("two keys of the universe share both hashes")
        place = own.select(F.explode(F.array(*_places(len(levels), words, hashes))).alias("p"))
        set_bits = place.groupBy(F.shiftrightunsigned("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toPandas()
        bits = np.zeros(words, np.uint64)
        bits[set_bits["word"].to_numpy(np.int64)] = set_bits["bits"].to_numpy(np.int64).view(np.uint64)
        levels.append(Level(len(levels), bits, hashes))
        own, other = scratch.save(_passing(other, levels[-1])), own
    return levels


def n_parts(listed: int, others: int, most_bytes: int) -> int:
    """Parts of which each one's cascade, and its levels while they are built, stay below most_bytes, on average."""
    # The first level, the others that it lets pass, and as much again for all further levels.
    bits = listed * -math.log(FIRST_RATE) / math.log(2) ** 2 + 3 * (FIRST_RATE * others + NEXT_RATE * listed) / math.log(2)
    return max(1, math.ceil(bits / 8 / most_bytes))


def member(levels: list[Level], places: list[np.ndarray]) -> np.ndarray:
    """Whether keys of the universe are listed; places: per level, one row per hash function."""
    n = places[0].shape[1] if places else 0
    verdict, open_ = np.full(n, len(levels) % 2 == 1), np.ones(n, bool)
    for level, at in zip(levels, places, strict=True):
        stops = open_ & ~level.has(at)
        verdict[stops] = level.level % 2 == 1
        open_ &= ~stops
    return verdict


def hashes_of(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("second")).alias("h2")]


def _marked(rows: DataFrame, levels: list[Level]) -> DataFrame:
    """rows (page_id, host, path, h1, h2) with listed instead of the hashes."""
    if not levels:
        return rows.select("page_id", "host", "path", F.lit(False).alias("listed"))
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places = 3, []
            for level in shared.value:
                places.append(np.array([batch.column(at + j).to_numpy(zero_copy_only=False) for j in range(level.hashes)]))
                at += level.hashes
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(member(shared.value, places))], ["page_id", "host", "path", "listed"])

    columns = [c.alias(f"p{x.level}_{j}") for x in levels for j, c in enumerate(_places(x.level, len(x.bits), x.hashes))]
    return rows.select("page_id", "host", "path", *columns).mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, listed boolean")


def judged_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict and listed. rules: (block or allow, host, path); listed: key."""
    scratch = Scratch(arrow_batches(pages.sparkSession))
    host, path = url_parts()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    blocked = listed.filter("key is not null and key <> ''").select("key").distinct().withColumn("listed", F.lit(True))
    keys = rows.select(F.col("host").alias("key")).distinct().join(blocked, "key", "left")
    hashed = scratch.save(keys.select(*hashes_of("key"), F.coalesce("listed", F.lit(False)).alias("listed")))
    sizes = hashed.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("others")).first()
    parts = n_parts(sizes["listed"], sizes["others"], most_bytes)
    rows, marked = rows.select("*", *hashes_of("host")), None
    for k in range(parts):
        mine = F.pmod("h2", F.lit(parts)) == k
        levels = cascade(hashed.filter(mine) if parts > 1 else hashed, scratch)
        part = _marked(rows.filter(mine) if parts > 1 else rows, levels)
        marked = part if marked is None else marked.unionByName(part)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed")
