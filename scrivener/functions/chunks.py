"""The structure-aware chunker: blocks of a document to retrieval chunks, and how much neighbouring chunks share.

An island is a run of neighbouring blocks with the same heading path, structure and kind. Islands are found by windows;
each is packed by a fold of its own, so no chunk spans two of them; a task streams its documents' islands and holds one at a time. A tail of the chunk before begins the next
one, but not within a structure (an algorithm, a table, code), whose chunks name their neighbours instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions.markdown import FENCE
from scrivener.functions.tables import SENTENCE, WEIGHED, _per_text, continuity, hard_split, islands, pack_weighed, weighed_units, weight

#: The path of text without headings, what joins summaries, and their longest.
NO_HEADING, GLUE, LONGEST_SUMMARY = "正文", "；", 500
BLOCK_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")


def normalized_block(text: str) -> str:
    """Line ends as \\n, no blanks at line ends, one empty line for several outside of code fences, none at the ends."""
    out, fenced = [], False
    for line in re.split(r"\r\n|\r|\n", text):
        line = line.rstrip()
        fenced ^= line.lstrip().startswith("```")
        if line or fenced or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


def without_leading_headings(text: str, path: str) -> str:
    """A block without the headings at its beginning that its path has already."""
    titles = {t.strip() for t in path.split(">")} - {""}
    while (m := BLOCK_HEADING.match(text.partition("\n")[0].strip())) and m[2].strip() in titles:
        text = text.partition("\n")[2].lstrip()
    return text.strip()


def filled(pieces: list[str], limit: int) -> list[str]:
    """Pieces joined by a blank as long as they fit; a longer one is split hard and stays apart from its neighbours."""
    out, sizes, first = [], [weight(p) for p in pieces], 0
    while first < len(pieces):
        if sizes[first] > limit:
            out += hard_split(pieces[first], limit)
            first += 1
            continue
        last = first + 1
        while last < len(pieces) and sum(sizes[first : last + 1]) <= limit:
            last += 1
        out.append(" ".join(pieces[first:last]).strip())
        first = last
    return out


def units(text: str, limit: int) -> list[str]:
    """Paragraphs; where one is too long, as many of its sentences as fit; where one of those is too long, parts of it."""
    out = []
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n+", text))):
        out += [paragraph] if weight(paragraph) <= limit else filled([s.strip() for s in SENTENCE.findall(paragraph) if s.strip()], limit)
    return out


def tail(held: list[tuple[str, int]], overlap: int) -> list[tuple[str, int]]:
    """The last units that have `overlap` tokens together; of a last unit that is longer, its last part."""
    sums = np.cumsum([0, *(size for _, size in reversed(held))])
    n = int(np.searchsorted(sums, overlap, "right")) - 1
    if overlap <= 0 or not held:
        return []
    if n:
        return held[len(held) - n :]
    return [(part, weight(part)) for part in hard_split(held[-1][0], overlap)[-1:]]


def carried_and_packed(texts: list[str], target: int, most: int, overlap: int) -> Iterator[tuple[int, list[tuple[str, int]]]]:
    """Units in chunks: a chunk is closed when the next unit doesn't fit or the target is reached, and the next one begins
    with its tail, less what doesn't fit beside the next unit. How many units are such a tail comes with each chunk: texts
    that repeat don't tell."""
    held: list[tuple[str, int]] = []
    carried = 0
    for unit in ((t, weight(t)) for t in texts):
        total = sum(size for _, size in held)
        if held and (total >= target or total + unit[1] > most):
            yield carried, held
            held = tail(held, overlap)
            while held and sum(size for _, size in held) + unit[1] > most:
                held = held[1:]
            carried = len(held)
        held = [*held, unit]
    if held:
        yield carried, held


def packed(texts: list[str], target: int, most: int, overlap: int) -> list[list[tuple[str, int]]]:
    """The chunks alone."""
    return [held for _, held in carried_and_packed(texts, target, most, overlap)]


def shared(before: list[str], after: list[str], most: int) -> int:
    """How many of the last tokens of `before` are the first of `after`, `most` at most. Slices are only compared where their
    first and last tokens are equal."""
    head, end = after[:most], before[-most:] if most else []
    lengths = range(min(len(head), len(end)), 0, -1)
    return next((k for k in lengths if head[k - 1] == end[-1] and end[-k] == head[0] and end[-k:] == head[:k]), 0)


def tokens(text: str) -> list[str]:
    return WEIGHED.findall(text)


def structured_chunks(blocks: DataFrame, key: str, target: int = 500, most: int = 700, overlap: int = 80) -> DataFrame:
    """Chunks of blocks (key, ordinal, content, path, summary, kind, structure), as key, chunk, section, kind, structure,
    content, tokens, overlap_tokens, blocks (their ordinals), summary and, within a structure, its continuity.

    A null or empty path is text without headings; a null or empty structure is none. Blocks without content are left out.
    """
    target, overlap = max(1, min(target, most)), max(0, min(overlap, most // 3))
    text = lambda c, default: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", default).otherwise(F.col(c)).alias(c)
    rows = blocks.filter(F.coalesce(F.col("content"), F.lit("")).rlike(r"\S")).select(key, F.col("ordinal").cast("long").alias("ordinal"), "content", text("path", NO_HEADING), text("kind", "prose"), text("structure", ""), F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), r"\s+", " ")).alias("summary"))
    kind = blocks.schema[key].dataType.simpleString()

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(content=[without_leading_headings(normalized_block(t), p) for t, p in zip(pdf["content"], pdf["path"], strict=True)])

    cleaned = rows.mapInPandas(clean, rows.schema).filter("content <> ''")
    grouped = islands(cleaned, [key], "ordinal", ["path", "structure", "kind"])

    def pack(head: tuple, blocks: list[tuple[int, str, str]]) -> list[tuple]:
        """The chunks of one island: head is its key, number, path, kind and structure, blocks its ordinals, texts and summaries."""
        owner: list[int] = []
        texts: list[str] = []
        for n, t, _ in blocks:
            found = units(t, most)
            texts += found
            owner += [n] * len(found)
        who, island, path, what, structure = head
        summary = GLUE.join(dict.fromkeys(s for _, _, s in blocks if s))[:LONGEST_SUMMARY]
        out, before, used = [], [], 0
        for tail_units, held in carried_and_packed(texts, target, most, 0 if structure else overlap):
            content = "\n\n".join(t for t, _ in held).strip()
            now = tokens(content)
            fresh, carried = len(held) - tail_units, owner[used - tail_units : used]
            out.append((who, island, len(out), path, what, structure, content, sum(s for _, s in held), shared(before, now, overlap), sorted({*carried, *owner[used : used + fresh]}), summary))
            before, used = now, used + fresh
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Islands follow each other, sorted by document and ordinal; one is held at a time."""
        names = [key, "island", "part_of_island", "section", "kind", "structure", "content", "tokens", "overlap_tokens", "blocks", "summary"]
        head, blocks = None, []
        for pdf in batches:
            out = []
            for who, island, path, what, structure, n, t, s in pdf.itertuples(index=False, name=None):
                if head is None or (who, island) != head[:2]:
                    out += pack(head, blocks) if head else []
                    head, blocks = (who, island, path, what, structure), []
                blocks.append((int(n), t, s))
            yield pd.DataFrame(out, columns=names)
        if head:
            yield pd.DataFrame(pack(head, blocks), columns=names)

    schema = f"`{key}` {kind}, island long, part_of_island int, section string, kind string, structure string, content string, tokens int, overlap_tokens int, blocks array<long>, summary string"
    # The windows above have dealt the rows by document already.
    ordered = grouped.select(key, "island", "path", "kind", "structure", "ordinal", "content", "summary").repartition(key).sortWithinPartitions(key, "island", "ordinal")
    out = ordered.mapInPandas(run, schema)
    numbered = out.withColumn("chunk", F.row_number().over(Window.partitionBy(key).orderBy("island", "part_of_island")) - 1)
    within = continuity(numbered, [key, "structure"], "chunk")
    named = F.col("structure") != ""
    place = lambda c: F.when(named & F.col(c).isNotNull(), F.concat("structure", F.lit(":"), (F.col("part") - 1 + (1 if c == "continues_to" else -1)).cast("string")))
    return within.select(
        key, "chunk", "section", "kind", "structure", "content", "tokens", "overlap_tokens", "blocks", "summary", F.when(named, F.col("part") - 1).alias("sequence"), place("continues_from").alias("continues_from"), place("continues_to").alias("continues_to"),
        (named & F.col("is_start")).alias("is_start"), (named & F.col("is_end")).alias("is_end"),
    )


def overlap_of(before: Column, after: Column, most: int = 80) -> Column:
    """How many of the last tokens of one text are the first of the next, by comparing slices of the arrays of tokens."""
    n = F.least(F.size(before), F.size(after), F.lit(most))
    first, last = F.get(after, F.lit(0)), F.try_element_at(before, F.lit(-1))
    # Slices are only compared where their first and last tokens are equal.
    ends = lambda word, i: (word == last) & (F.get(before, F.size(before) - i - 1) == first)
    same = F.transform(F.slice(after, F.lit(1), n), lambda word, i: F.when(ends(word, i) & (F.slice(before, -i - 1, i + 1) == F.slice(after, F.lit(1), i + 1)), i + 1))
    return F.when(n >= 1, F.coalesce(F.array_max(same), F.lit(0))).otherwise(0)


def with_overlaps(chunks: DataFrame, key: str, order: str, text: str, most: int = 80) -> DataFrame:
    """chunks with shared: the tokens that each shares with the one before it, in the order of its key. text is a string, or an
    array of the tokens."""
    listed = chunks.schema[text].dataType.typeName() == "array"
    found = F.coalesce(F.col(text), F.array().cast("array<string>")) if listed else F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WEIGHED.pattern), F.lit(0))
    # Only the tokens at the ends go through the window, and those that are in both ends once.
    last = lambda c: F.slice(c, F.greatest(F.size(c) - most + 1, F.lit(1)), F.lit(most))
    ends = chunks.withColumn("__t", found).withColumn("__t", F.when(F.size("__t") <= 2 * most, F.col("__t")).otherwise(F.concat(F.slice("__t", 1, most), last(F.col("__t")))))
    before = F.lag("__t").over(Window.partitionBy(key).orderBy(order))
    return ends.withColumn("__before", before).withColumn("shared", F.when(F.col("__before").isNull(), 0).otherwise(overlap_of(F.col("__before"), F.col("__t"), most))).drop("__t", "__before")


def measured_chunks(df: DataFrame, key: str, text: str, target: int = 500, most: int = 700, overlap: int = 80, longest: int = 80) -> DataFrame:
    """key, chunk, tokens, overlap_tokens and shared of token_chunks: what with_overlaps finds, but measured where a text is cut,
    as its chunks stand side by side there; neither they nor their tokens become rows."""

    def pack(t: str) -> Iterator[tuple[int, int, int, int]]:
        before: list[str] = []
        for i, (held, size, carried) in enumerate(pack_weighed(weighed_units(t, most), target, most, overlap)):
            now = [token for _, _, found in held for token in found]
            yield i, size, carried, shared(before, now, longest)
            before = now

    return _per_text(df, key, text, "chunk int, tokens int, overlap_tokens int, shared int", pack)


def overlap_statistics(chunks: DataFrame, by: list[str], key: str, tokens_column: str, structure: Column) -> DataFrame:
    """Of chunks with their measured overlaps: how many, of how many documents, mean and most tokens, how many share some
    tokens with the one before and how many those are, and how many belong to a structure."""
    return chunks.groupBy(*by).agg(
        F.count("*").alias("chunks"), F.countDistinct(key).alias("documents"), F.round(F.avg(tokens_column), 4).alias("mean_tokens"), F.max(tokens_column).alias("most_tokens"),
        F.count_if(F.col("shared") > 0).alias("overlapping"), F.sum("shared").alias("shared_tokens"), F.count_if(structure).alias("structured"),
    )


# The names of text without a heading of its own.
FRONT, WHOLE_TEXT = "文档首页", NO_HEADING
SECTION_HEADING = re.compile(r"(?m)^(#{1,6})\s+(.+?)\s*$")


def section_windows(text: str, size: int, overlap: int) -> list[tuple[int, str, int, str]]:
    """Number, section, line and text of windows of at most `size` characters: sections by heading, each cut at the last
    paragraph break in the second half of a window, else at the last sentence end there, else where it is full; the next window
    begins `overlap` characters before."""
    heads = list(SECTION_HEADING.finditer(text))
    newlines = [m.start() for m in re.finditer("\n", text)]
    line_of = lambda at: int(np.searchsorted(newlines, at)) + 1
    stops = [m.start() for m in heads[1:]] + [len(text)]
    parts = [(m[2].strip(), text[m.end() : stop].strip(), line_of(m.start())) for m, stop in zip(heads, stops, strict=False)]
    front = text[: heads[0].start()].strip() if heads else text.strip()
    parts.insert(0, (FRONT if heads else WHOLE_TEXT, front, 1))
    out: list[tuple[int, str, int, str]] = []
    for name, body, line in parts:
        breaks = [np.fromiter((m.start() for m in re.finditer(r"(?=\n\n)", body)), np.int64), np.sort(np.fromiter((m.start() + 1 for m in re.finditer(r"(?=。|\. )", body)), np.int64))]
        lines, at = np.fromiter((m.start() for m in re.finditer("\n", body)), np.int64), 0
        while at < len(body):
            full, half = at + size, at + size // 2
            end = min(len(body), full)
            if full < len(body):
                # A break of two signs lies in the window as a whole; a sentence's end may be the window's.
                for places, last in ((breaks[0], full - 2), (breaks[1], full)):
                    k = int(np.searchsorted(places, last, "right"))
                    found = int(places[k - 1]) if k else -1
                    if places is breaks[1] and k and body[found - 1] == "." and found + 1 > full:
                        found = int(places[k - 2]) if k > 1 else -1
                    if found > half or places is breaks[0] and found == half and half > at:
                        end = found if found > half else end
                        break
            if piece := body[at:end].strip():
                out.append((len(out) + 1, name, line + int(np.searchsorted(lines, at)), piece))
            if end >= len(body):
                break
            at = max(at + 1, end - overlap)
    return out


def graph_windows(df: DataFrame, key: str, text: str, size: int = 6000, overlap: int = 400) -> DataFrame:
    """key, window, section, line and content of the windows of each text. Null and blank texts give no rows."""
    return _per_text(df, key, text, "window int, section string, line int, content string", lambda t: section_windows(t, size, overlap))
