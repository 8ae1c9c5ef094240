"""Evidence selection: assembly under budgets, coverage-aware greedy choice, structure completion, evaluation.

Greedy selection is sequential by nature. It runs per question over that question's best candidates, a number that is
bounded before, so that a task holds few rows; questions are dealt over tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.operators.search import top_by


def overlap(a: set, b: set) -> float:
    """Jaccard similarity of two token sets; zero if either is empty."""
    return len(a & b) / len(a | b) if a and b else 0.0


def per_question(candidates: DataFrame, question: str, order: Sequence[Column], most: int, choose: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """The rows that choose takes of each question's best `most` candidates, in its order, with their place."""
    best = top_by(candidates, [question], order, most, "__rank")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__rank").reset_index(drop=True)
        taken = choose(rows)
        return rows.iloc[taken].drop(columns="__rank").assign(place=range(len(taken)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)
    return best.groupBy(question).applyInPandas(run, f"{schema}, place long")


def per_paper_cap(configured: int, evidence: int, papers: int) -> int:
    """How many groups a paper may give: enough to reach the evidence that is asked for."""
    return max(configured, -(-evidence // max(1, papers)))


def assemble(candidates: DataFrame, order: Sequence[Column], most: int = 100, per_paper: int = 3, alike: float = 0.82, most_groups: int = 12, most_chars: int = 18_000) -> DataFrame:
    """candidates: question, paper, tokens (array), chars and more. Walks each question's candidates in order and takes
    what its paper's cap, the similarity to what is taken, and the budgets of groups and characters allow."""

    def choose(rows: pd.DataFrame) -> list[int]:
        taken, chars, of_paper, sets = [], 0, Counter(), []
        for i, (paper, tokens, size) in enumerate(zip(rows["paper"], rows["tokens"], rows["chars"], strict=True)):
            mine = set(tokens)
            if len(taken) == most_groups:
                break
            if of_paper[paper] < per_paper and chars + size <= most_chars and all(overlap(mine, s) <= alike for s in sets):
                taken.append(i)
                of_paper[paper] += 1
                sets.append(mine)
                chars += size
        return taken

    return per_question(candidates, "question", order, most, choose)


def select_covering(candidates: DataFrame, order: Sequence[Column], target: int, most: int = 100, most_chars: int = 18_000) -> DataFrame:
    """candidates: question, locked (boolean), slots (array of what it supports directly), partial (array), relevance,
    source, period, tokens (array), chars. Locked ones come first; then, again and again, the one that adds most for its
    length, until all slots are covered and `target` are taken, or nothing fits.

    What a candidate adds: 8 a slot not yet covered, 0.5 a slot in part, 0.35 log1p(relevance), 0.3 a new source, 0.3 a new
    period, less 1.25 of its similarity to what is taken, all by the root of its thousands of characters.
    """

    def choose(rows: pd.DataFrame) -> list[int]:
        slots, parts, sets = [set(x) for x in rows["slots"]], [set(x) for x in rows["partial"]], [set(x) for x in rows["tokens"]]
        wanted = set().union(*slots) if slots else set()
        taken, covered, sources, periods, chars = [], set(), set(), set(), 0

        def take(i: int) -> None:
            nonlocal chars
            taken.append(i)
            covered.update(slots[i])
            sources.add(rows["source"][i])
            periods.add(rows["period"][i])
            chars += rows["chars"][i]

        def gain(i: int) -> float:
            new = rows["source"][i] not in sources, rows["period"][i] not in periods
            like = max((overlap(sets[i], sets[k]) for k in taken), default=0.0)
            value = 8 * len(slots[i] - covered) + 0.5 * len(parts[i] - covered) + 0.35 * math.log1p(max(0.0, rows["relevance"][i])) + 0.3 * new[0] + 0.3 * new[1] - 1.25 * like
            return value / math.sqrt(max(1.0, rows["chars"][i] / 1000))

        for i in [i for i in range(len(rows)) if rows["locked"][i]]:
            if chars + rows["chars"][i] <= most_chars:
                take(i)
        while not (wanted <= covered and len(taken) >= target):
            gains = {i: gain(i) for i in range(len(rows)) if i not in taken and chars + rows["chars"][i] <= most_chars}
            best = max(gains, key=lambda i: (gains[i], -i), default=None)
            if best is None or (gains[best] <= 0 and wanted <= covered):
                break
            take(best)
        return taken

    return per_question(candidates, "question", order, most, choose)


def facets_first(candidates: DataFrame, order: Sequence[Column], per_facet: int, per_section: int = 2, most_groups: int = 12, most_chars: int = 18_000, most: int = 100) -> DataFrame:
    """candidates: question, facet, paper, section, chars. First each facet's best `per_facet`, facets by name, then the
    best of all; a section gives `per_section` at the most."""

    def choose(rows: pd.DataFrame) -> list[int]:
        taken, of_section, chars = [], Counter(), 0
        rounds = [[i for i in range(len(rows)) if rows["facet"][i] == f] for f in sorted(set(rows["facet"]))]
        for k, ids in enumerate([*rounds, range(len(rows))]):
            added = 0
            for i in ids:
                place = rows["paper"][i], rows["section"][i]
                if i in taken or of_section[place] >= per_section or chars + rows["chars"][i] > most_chars or len(taken) == most_groups or (k < len(rounds) and added == per_facet):
                    continue
                taken.append(i)
                of_section[place] += 1
                chars += rows["chars"][i]
                added += 1
        return taken

    return per_question(candidates, "question", order, most, choose)


def completed(seeds: DataFrame, parts: DataFrame, structure: str, sequence: str, size: str, budget: int) -> DataFrame:
    """Every part of the seeds' structures; of a structure beyond the budget the parts around its seed, nearest first,
    behind before ahead, whose sizes together stay within it. seeds: structure and sequence; of several the first."""
    first = seeds.groupBy(structure).agg(F.min(sequence).alias("__seed"))
    rows = parts.join(first, structure)
    near = Window.partitionBy(structure).orderBy(F.abs(F.col(sequence) - F.col("__seed")), F.desc(sequence))
    rows = rows.withColumn("__sum", F.sum(size).over(near))
    return rows.filter((F.col("__sum") <= budget) | (F.col(sequence) == F.col("__seed"))).drop("__sum", "__seed")


def grouped_in_order(items: DataFrame, group: Sequence[str], ordinal: str, sequence: str) -> DataFrame:
    """Adds place, the rank of the group by its first item, and nth, the item's rank in it."""
    firsts = items.groupBy(*group).agg(F.min(ordinal).alias("__first"))
    ranks = firsts.withColumn("__slice", F.floor(F.col("__first") / 1_000_000))
    # Groups are numbered slice by slice of their ordinals, so that no task ranks all of them.
    before = ranks.groupBy("__slice").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = ranks.join(F.broadcast(before), "__slice").withColumn("place", (F.row_number().over(Window.partitionBy("__slice").orderBy("__first", *group)) + F.col("__before")).cast("long"))
    out = items.join(ranks.select(*group, "place"), list(group))
    return out.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(sequence, ordinal)))


def sufficiency(counts: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """counts with the names of the checks that fail, and whether none does."""
    reasons = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks)), lambda x: x.isNotNull())
    return counts.withColumn("reasons", reasons).withColumn("sufficient", F.size("reasons") == 0)


def merge_evaluations(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Assessments of several lists, of each key the one in the last list."""
    rows = None
    for i, part in enumerate(parts):
        part = part.withColumn("__list", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    columns = [c for c in rows.columns if c != "__list"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "__list").alias("__r")).select("__r.*")


def normalized_assessments(rows: DataFrame, allowed: DataFrame, known_refs: DataFrame, key: str = "id") -> DataFrame:
    """rows (id, ord, status, refs): ids of the allow-list, the first of each; unknown statuses are unsupported, unknown
    references go, and support without a reference left is none."""
    first = rows.join(allowed.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min_by(F.struct("status", "refs"), "ord").alias("r")).select(key, "r.*")
    refs = first.select(key, F.explode(F.array_distinct("refs")).alias("ref")).join(known_refs.select("ref").distinct(), "ref", "left_semi").groupBy(key).agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    out = first.drop("refs").join(refs, key, "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<bigint>")))
    status = F.when(F.lower("status").isin("supported", "partial", "unsupported"), F.lower("status")).otherwise("unsupported")
    return out.withColumn("status", F.when((status == "supported") & (F.size("refs") == 0), "unsupported").otherwise(status))


def rendered(rows: DataFrame, group: str, place: str, *parts: Column) -> DataFrame:
    """Per group one text: each row as [place] and its parts, joined by middle dots, one line each, in order."""
    line = F.concat(F.lit("["), F.col(place).cast("string"), F.lit("] "), F.concat_ws(" · ", *parts))
    lines = F.array_sort(F.collect_list(F.struct(F.col(place).alias("o"), line.alias("l"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(lines, lambda s: s["l"]), "\n").alias("context"))
