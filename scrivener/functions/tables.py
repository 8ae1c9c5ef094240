"""Text to rows: sections, chunks, windows, references and citation contexts.

What can be said with split, explode and windows is. Packing and window cutting depend on what was cut before, so they
fold over one text at a time, in Arrow batches; a text is never spread over tasks and texts are never gathered.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions import text as X

HEADING = r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
# Nothing is given back: in Java, runs like a.b.c of thousands of parts would fill the stack otherwise.
WEIGHED = re.compile(r"[㐀-䶿一-鿿]|[A-Za-z0-9]++(?:[+._/\-][A-Za-z0-9]++)*+|[^\s]")
SENTENCE = re.compile(r".+?(?:[。！？!?；;.](?=\s|$)|$)", re.S)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from one) and content of every line."""
    return df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, section (0 before the first heading), level, heading, line and content, from ATX headings."""
    rows = lines(df, key, text)
    is_heading = F.col("content").rlike(HEADING)
    # A window over the lines of one text: a text is one row of the input.
    numbered = rows.withColumn("section", F.sum(is_heading.cast("int")).over(Window.partitionBy(key).orderBy("line")))
    parts = numbered.groupBy(key, "section").agg(
        F.min("line").alias("line"),
        F.max(F.when(is_heading, F.length(F.regexp_extract("content", HEADING, 1)))).alias("level"),
        F.max(F.when(is_heading, F.regexp_extract("content", HEADING, 2))).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~is_heading, F.struct("line", "content")))), lambda s: s["content"]), "\n").alias("content"),
    )
    content = F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))
    return parts.select(key, "section", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("heading", F.lit("")).alias("heading"), "line", content.alias("content")).filter("heading <> '' or content <> ''")


def heading_paths(df: DataFrame, key: str) -> DataFrame:
    """Sections with the path of the headings above them, outermost first.

    Per level the last heading, which counts as long as no heading of a higher level came after it: six windows over one
    text's sections, and no list of what came before.
    """
    w = Window.partitionBy(key).orderBy("section")
    last = lambda level: F.last(F.when(F.col("level") == level, F.struct("section", "heading")), True).over(w)
    out = df.withColumns({f"__h{level}": last(level) for level in range(1, 7)})
    kept = []
    for level in range(1, 7):
        above = [F.coalesce(F.col(f"__h{k}.section"), F.lit(-1)) for k in range(1, level)]
        open_ = F.col(f"__h{level}.section") > (F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(-1))
        kept.append(F.when(open_, F.col(f"__h{level}.heading")))
    return out.withColumn("path", F.concat_ws(" > ", *kept)).drop(*(f"__h{level}" for level in range(1, 7)))


def continuity(df: DataFrame, structure: list[str], sequence: str) -> DataFrame:
    """Per structure the neighbours of each part, its number, the count, and whether it starts or ends the structure."""
    w = Window.partitionBy(*structure).orderBy(sequence)
    out = df.withColumn("continues_from", F.lag(sequence).over(w)).withColumn("continues_to", F.lead(sequence).over(w))
    out = out.withColumn("part", F.row_number().over(w)).withColumn("parts", F.count("*").over(Window.partitionBy(*structure)))
    return out.withColumn("is_start", F.col("continues_from").isNull()).withColumn("is_end", F.col("continues_to").isNull())


def islands(df: DataFrame, partition: list[str], order: str, same: list[str]) -> DataFrame:
    """Adds island: a number that grows whenever one of the columns differs from the row before."""
    w = Window.partitionBy(*partition).orderBy(order)
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    return df.withColumn("__new", F.when(F.row_number().over(w) == 1, 0).otherwise(differs.cast("int"))).withColumn("island", F.sum("__new").over(w)).drop("__new")


#: Characters, and rows, of results that a task's Python holds before it hands them on.
MOST_HELD, MOST_ROWS = 1 << 20, 4096
ARROW = {"int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def in_small_batches(batches: Iterable[pa.RecordBatch], f: Callable[[str], Iterable[tuple]], names: list[str], types: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows that f makes of each text of batches (key, text), with its key. One text is opened at a time and results are handed
    on as soon as there are some, so that what is held grows with the longest text, not with the batch."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        owners: list[int] = []
        rows: list[tuple] = []
        held = 0

        def made(owners: list[int], rows: list[tuple], keys: pa.Array = keys) -> pa.RecordBatch:
            values = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(owners, pa.int32())), *(pa.array(v, ARROW[t]) for v, t in zip(values, types, strict=True))], names=names)

        for i, text in enumerate(texts):
            for row in f(text.as_py()):
                owners.append(i)
                rows.append(row)
                held += sum(len(x) for x in row if isinstance(x, (str, list)))
                if held > MOST_HELD or len(rows) >= MOST_ROWS:
                    yield made(owners, rows)
                    owners, rows, held = [], [], 0
        if rows:
            yield made(owners, rows)


def _per_text(df: DataFrame, key: str, text: str, schema: str, f: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """Rows that f makes of each text, with its key."""
    kind, fields = df.schema[key].dataType.simpleString(), [c.split() for c in schema.split(", ")]
    names, types = [key, *(n for n, _ in fields)], [t for _, t in fields]
    cut = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return cut.mapInArrow(lambda batches: in_small_batches(batches, f, names, types), f"{key} {kind}, {schema}")


def weighed(tokens: list[str]) -> int:
    """The estimate of listed tokens: a run of letters and digits is one for four characters, any other token is one character."""
    return sum([(len(t) + 3) >> 2 for t in tokens])


def weight(text: str) -> int:
    """Estimated tokens of a text."""
    return weighed(WEIGHED.findall(text))


def hard_split(text: str, limit: int) -> list[str]:
    """A text in parts of at most `limit` tokens; a longer token in parts of four characters each."""
    most = 4 * limit
    spans = [(i, min(m.end(), i + most), m.end() - m.start() <= most) for m in WEIGHED.finditer(text) for i in range(m.start(), m.end(), most)]
    # A whole token weighs by its length; what is cut from one may be several.
    sums = list(accumulate(((b - a + 3) >> 2 if whole else weight(text[a:b]) for a, b, whole in spans), initial=0))
    out, first = [], 0
    while first < len(spans):
        # As many tokens as fit, by their running sum; one at the least.
        last = max(first + 1, bisect_right(sums, sums[first] + limit) - 1)
        out.append(text[spans[first][0] : spans[last - 1][1]].strip())
        first = last
    return [p for p in out if p]


#: A unit of a text, its estimated tokens, and these as they are listed.
Unit = tuple[str, int, list[str]]


def weighed_units(text: str, limit: int) -> Iterator[Unit]:
    """Paragraphs; where one is too long its sentences; where one of those is, parts of it. Tokens are listed once: a blank
    follows a sentence's end, so a paragraph has the tokens of its sentences."""
    for paragraph in filter(str.strip, re.split(r"\n\s*\n", text)):
        listed = ((m.group(), WEIGHED.findall(m.group())) for m in SENTENCE.finditer(paragraph))
        sentences = ((piece, weighed(found), found) for piece, found in listed)
        begin, size = [], 0
        while size <= limit and (unit := next(sentences, None)):
            begin.append(unit)
            size += unit[1]
        if size <= limit:
            yield paragraph.strip(), size, [t for _, _, found in begin for t in found]
            continue
        for piece, size, found in chain(begin, sentences):
            if size > limit:
                yield from ((part, weighed(ts), ts) for part in hard_split(piece, limit) for ts in [WEIGHED.findall(part)])
            elif piece := piece.strip():
                yield piece, size, found


def semantic_units(text: str, limit: int) -> list[str]:
    """The units alone."""
    return [unit for unit, _, _ in weighed_units(text, limit)]


def pack_weighed(units: Iterable[Unit], target: int, most: int, overlap: int) -> Iterator[tuple[list[Unit], int, int]]:
    """Chunks of units up to the target and never over the limit, one new unit at the least; each starts with the tail of the
    one before, whole units of `overlap` tokens at most that leave room for the next one. The units of a chunk, its tokens
    and those of its tail; one chunk is held at a time."""
    held: list[Unit] = []
    size = carried = fresh_ = 0
    for unit in units:
        if fresh_ and (size >= target or size + unit[1] > most):
            yield held, size, carried
            first = 0
            while first < len(held) and (size > overlap or size + unit[1] > most):
                size -= held[first][1]
                first += 1
            held, carried, fresh_ = held[first:], size, 0
        held.append(unit)
        size += unit[1]
        fresh_ += 1
    if held:
        yield held, size, carried


def pack_units(units: list[str], target: int, most: int, overlap: int) -> list[tuple[str, int, int]]:
    """Text, tokens and tokens of the tail of each chunk."""
    return [("\n\n".join(u for u, _, _ in held), size, carried) for held, size, carried in pack_weighed(((u, weight(u), []) for u in units), target, most, overlap)]


def token_chunks(df: DataFrame, key: str, text: str, target: int = 500, most: int = 700, overlap: int = 80) -> DataFrame:
    """key, chunk, content, tokens and overlap_tokens: each text packed into chunks with controlled overlap."""

    def pack(t: str) -> Iterator[tuple[int, str, int, int]]:
        for i, (held, size, carried) in enumerate(pack_weighed(weighed_units(t, most), target, most, overlap)):
            yield i, "\n\n".join(u for u, _, _ in held), size, carried

    return _per_text(df, key, text, "chunk int, content string, tokens int, overlap_tokens int", pack)


BREAKS = {"paragraph": re.compile(r"\n\n"), "sentence": re.compile(r"。|\. ")}


def windows(text: str, size: int, overlap: int) -> list[tuple[int, str, int]]:
    """Character windows with overlap: number, text and line. All places where a window may end are listed once; a
    window takes the last paragraph break in its second half, else the last sentence end there, else its full size."""
    ends = [np.fromiter((m.start() + (name == "sentence") for m in p.finditer(text)), np.int64) for name, p in BREAKS.items()]
    newlines = np.fromiter((m.start() for m in re.finditer("\n", text)), np.int64)
    out, start = [], 0
    while start < len(text):
        stop = start + size
        if stop < len(text):
            # The last place of each list that is below the full size, and in the second half.
            lasts = [e[k - 1] for e in ends if (k := np.searchsorted(e, stop)) and e[k - 1] > start + size // 2]
            stop = int(lasts[0]) if lasts else stop
        if part := text[start:stop].strip():
            out.append((len(out) + 1, part, 1 + int(np.searchsorted(newlines, start))))
        if stop >= len(text):
            return out
        start = max(start + 1, stop - overlap)
    return out


def text_windows(df: DataFrame, key: str, text: str, size: int = 6000, overlap: int = 400) -> DataFrame:
    """key, window, content and line of each window."""
    return _per_text(df, key, text, "window int, content string, line int", lambda t: windows(t.strip(), size, overlap))


REFERENCE = re.compile(r"(?m)^\s*(?:\[(\d{1,4})\]|(\d{1,4})[.)])\s+")
CITATION = re.compile(r"\[(\d{1,4}(?:\s*[-–,;]\s*\d{1,4})*)\]")


def references(text: str) -> list[tuple[int, str, int]]:
    """Numbered entries of a reference list, else its paragraphs: number, text, line."""
    found = list(REFERENCE.finditer(text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    out = [(int(m.group(1) or m.group(2)), " ".join(text[m.end() : e].split()), text.count("\n", 0, m.start()) + 1) for m, e in zip(found, ends, strict=True)]
    if found:
        return [r for r in out if r[1]]
    spans = [m for m in re.finditer(r"(?:(?!\n\s*\n)[\s\S])+", text) if m.group().strip()]
    return [(i + 1, " ".join(m.group().split()), text.count("\n", 0, m.start()) + 1) for i, m in enumerate(spans)]


def reference_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    return _per_text(df, key, text, "number int, entry string, line int", references)


def citation_contexts(df: DataFrame, key: str, text: str, around: int = 180) -> DataFrame:
    """One row per cited number and place: its line and the text around it."""

    def find(t: str) -> Iterator[tuple[str, int, str]]:
        ends = [m.start() for m in re.finditer("\n", t)]
        for m in CITATION.finditer(t):
            yield m.group(1), bisect_left(ends, m.start()) + 1, " ".join(t[max(0, m.start() - around) : m.end() + around].split())

    rows = _per_text(df, key, text, "marker string, line int, quote string", find)
    return rows.select(key, F.explode(X.expand_numbers(F.col("marker"))).alias("number"), "line", "quote")


def split_references(text: Column) -> tuple[Column, Column]:
    """What stands before and after a heading of references."""
    heading = r"(?im)^\s{0,3}(?:#{1,6}\s*)?(?:\d+\.?\s*)?(?:references|bibliography|参考文献)\s*:?\s*$"
    at = F.regexp_instr(text, F.lit(heading))
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.regexp_replace(F.substring(text, at, F.length(text)), heading, "")).otherwise(F.lit(""))


def greedy_batches(df: DataFrame, key: str, order: str, cost: str, most_cost: int, most_rows: int) -> DataFrame:
    """Adds batch: rows of a key packed in order, by count and by cost. The fold is over one key's array."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c"))))
    kind = "struct<b:int,n:int,c:bigint,out:array<int>>"
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("c"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        new = (s["n"] > 0) & ((s["n"] >= most_rows) | (s["c"] + r["c"] > most_cost))
        b = F.when(new, s["b"] + 1).otherwise(s["b"])
        return F.struct(b.alias("b"), F.when(new, 1).otherwise(s["n"] + 1).alias("n"), F.when(new, r["c"]).otherwise(s["c"] + r["c"]).alias("c"), F.concat(s["out"], F.array(b)).alias("out")).cast(kind)

    packed = df.groupBy(key).agg(ordered.alias("r")).withColumn("b", F.aggregate("r", start.cast(kind), step)["out"])
    rows = packed.select(key, F.explode(F.arrays_zip("r", "b")).alias("z"))
    return rows.select(key, F.col("z.r.o").alias(order), F.col("z.r.c").alias(cost), F.col("z.b").alias("batch"))
