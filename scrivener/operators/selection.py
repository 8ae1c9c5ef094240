"""Evidence selection without a limit on candidates: greedy rounds over all of them, for all questions at once.

A greedy choice looks at every candidate, takes one, and looks again. Here each look is one distributed pass: candidates meet
their question's state (what is taken, covered and spent: a row per question), the best of each question is found by an
aggregate that Spark pre-aggregates, and the new state is a written table. There are as many passes as a question may take
groups, a dozen by default, whatever the number of candidates, and no task holds a question's candidates.

Candidates are groups: the members of one structure, or one chunk. A group has `question`, `grp`, `record`, `ord` (its place in
the ranking), `tokens` (distinct), `chars`, `relevance`, `locked`, and `support`: what it says of each slot.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions import text as X
from scrivener.session import Scratch

#: Questions up to which their states are sent to the candidates, instead of those being dealt out by question.
FEW_QUESTIONS = 100
#: Candidates of a question that are looked at together, at first and at most.
FIRST_BLOCK, MOST_BLOCK = 256, 2048
SUPPORT = "array<struct<slot:string,status:string,confidence:double,period:string>>"


@dataclass(frozen=True)
class Weights:
    """What a candidate's gains are worth."""

    coverage: float = 8.0
    partial: float = 0.5
    relevance: float = 0.35
    sources: float = 0.3
    periods: float = 0.3
    redundancy: float = 1.25


def _map(key: str, value: str, when: Column | None = None) -> Column:
    entry = F.struct(key, value)
    return F.map_from_entries(F.array_sort(F.collect_set(entry if when is None else F.when(when, entry))))


def _sent(questions: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How what is known of questions meets their candidates: few are sent to them, as one question may have most of the rows."""
    return F.broadcast if questions.limit(FEW_QUESTIONS + 1).count() <= FEW_QUESTIONS else lambda df: df


def budgets(requirements: DataFrame, questions: DataFrame, least: int = 4, most: int = 12, chars: int = 18_000) -> DataFrame:
    """A budget per question: least, target, most, chars, and as maps what is needed: needs (direct evidence per slot),
    parents (a slot's requirement), sources and periods (distinct ones per requirement).

    requirements: question, slot, parent, need, sources, periods. questions: question and, if it is given, requested, the
    number of groups asked for. The target is the largest of the least, what is requested and the sum of needs, up to `most`.
    """
    most = max(least, most)
    of = requirements.groupBy("question").agg(F.sum("need").alias("__sum"), _map("slot", "need").alias("needs"), _map("slot", "parent").alias("parents"))
    per_parent = requirements.groupBy("question", "parent").agg(F.max("sources").cast("int").alias("sources"), F.max("periods").cast("int").alias("periods"))
    wide = per_parent.groupBy("question").agg(_map("parent", "sources").alias("sources"), _map("parent", "periods").alias("periods"))
    asked = F.coalesce(F.col("requested"), F.lit(0)) if "requested" in questions.columns else F.lit(0)
    out = questions.select("question", asked.alias("__asked")).distinct().join(of, "question", "left").join(wide, "question", "left")
    numbers, names = F.create_map().cast("map<string,int>"), F.create_map().cast("map<string,string>")
    target = F.greatest(F.lit(least), F.col("__asked"), F.coalesce("__sum", F.lit(0)))
    return out.select(
        "question", F.lit(least).alias("least"), F.least(target, F.lit(most)).cast("int").alias("target"), F.lit(most).alias("most"), F.lit(max(1000, chars)).alias("chars"),
        F.coalesce(F.col("needs").cast("map<string,int>"), numbers).alias("needs"), F.coalesce("parents", names).alias("parents"), F.coalesce("sources", numbers).alias("sources"), F.coalesce("periods", numbers).alias("periods"),
    )


def merged_support(assessments: DataFrame, keys: list[str]) -> DataFrame:
    """Per group (keys) its support: of each slot the highest status, of those the highest confidence. assessments: keys,
    slot, status, confidence, period."""
    rank = F.when(F.col("status") == "direct", 2).when(F.col("status") == "partial", 1).otherwise(0)
    best = assessments.groupBy(*keys, "slot").agg(F.max_by(F.struct("status", "confidence", "period"), F.struct(rank, F.coalesce("confidence", F.lit(0.0)))).alias("b"))
    entry = F.struct("slot", F.col("b.status").alias("status"), F.coalesce(F.col("b.confidence"), F.lit(0.0)).alias("confidence"), F.coalesce(F.col("b.period"), F.lit("")).alias("period"))
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).cast(SUPPORT).alias("support"))  # a group's slots



def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _n(values: Column, value: Column, field: str | None = None) -> Column:
    return F.size(F.filter(values, lambda x: (x[field] if field else x) == value))


def _scored(w: Weights) -> tuple[Column, Column]:
    """A candidate's score against its question's state, and the period-aware parents it would add to."""
    support, needs, covered, told, dated = (F.col(c) for c in ("support", "needs", "covered", "told", "dated"))
    short = lambda s: F.coalesce(needs[s["slot"]], F.lit(0)) > _n(covered, s["slot"])
    parent = lambda s: F.coalesce(F.col("parents")[s["slot"]], s["slot"])
    direct = lambda s: s["status"] == "direct"
    full = F.size(F.filter(support, lambda s: direct(s) & short(s)))
    part = F.aggregate(F.filter(support, lambda s: (s["status"] == "partial") & short(s)), F.lit(0.0), lambda a, s: a + s["confidence"])
    new = lambda seen, wanted, value: lambda s: direct(s) & (value(s) != "") & (_n(seen, parent(s), "parent") < F.coalesce(F.col(wanted)[parent(s)], F.lit(1))) & ~F.exists(seen, lambda x: (x["parent"] == parent(s)) & (x["value"] == value(s)))
    by_source = F.size(F.array_distinct(F.transform(F.filter(support, new(told, "sources", lambda s: F.col("record"))), parent)))
    by_period = F.size(F.array_distinct(F.transform(F.filter(support, new(dated, "periods", lambda s: s["period"])), parent)))
    fresh = F.when((F.col("record") != "") & ~F.array_contains("records", F.col("record")), 1).otherwise(0)
    like = F.coalesce(F.array_max(F.transform("sets", lambda t: X.jaccard(F.col("hashes"), t))), F.lit(0.0))
    raw = w.coverage * full + w.partial * part + w.relevance * F.log1p(F.greatest(F.lit(0.0), F.col("relevance"))) + w.sources * (fresh + by_source) + w.periods * by_period - w.redundancy * like
    return raw / F.sqrt(F.greatest(F.lit(1.0), F.col("chars") / 1000)), like


def _covered_all() -> Column:
    """Whether a state has all that its budget needs."""
    enough = lambda wanted, seen, field: F.forall(F.map_entries(F.col(wanted)), lambda e: _n(F.col(seen), e["key"], field) >= e["value"])
    return enough("needs", "covered", None) & enough("sources", "told", "parent") & enough("periods", "dated", "parent")


def select_covering(groups: DataFrame, budget: DataFrame, weights: Weights | None = None) -> DataFrame:
    """question, grp and place of what is selected, for each question.

    Locked groups come first, in their order, as far as they fit. Then, again and again, the one that adds most for its length,
    the first of equal ones: until all is covered and the least number is reached, the target is, nothing fits, or nothing adds
    anything beyond the least number. Without needs the target is filled. A group counts for a slot once, up to the number needed.
    """
    scratch, w = Scratch(groups.sparkSession), weights or Weights()
    hashed = groups.select("question", "grp", F.coalesce("record", F.lit("")).alias("record"), "ord", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"), "chars", F.coalesce("relevance", F.lit(0.0)).alias("relevance"), F.coalesce("locked", F.lit(False)).alias("locked"), F.coalesce(F.col("support"), _empty(SUPPORT)).alias("support"))
    all_ = scratch.save(hashed)
    limits = scratch.save(budget.withColumnRenamed("chars", "room"))
    sent = _sent(limits)
    rounds = limits.agg(F.max("most").alias("m")).first()["m"] or 0
    pairs = "array<struct<parent:string,value:string>>"
    state = limits.select("question", _empty("array<string>").alias("taken"), _empty("array<array<bigint>>").alias("sets"), _empty("array<string>").alias("records"), _empty("array<string>").alias("covered"), _empty(pairs).alias("told"), _empty(pairs).alias("dated"), F.lit(0).cast("bigint").alias("spent"))
    out = None
    for place in range(rounds):
        now = state.join(limits, "question")
        able = all_.join(sent(now), "question").filter(~F.array_contains("taken", F.col("grp")) & (F.col("spent") + F.col("chars") <= F.col("room")) & (F.size("taken") < F.col("most")))
        score, _ = _scored(w)
        # Locked ones go before all others, by their place; of the others the best score counts, then the place.
        row = F.struct("grp", "record", "chars", "support", "locked", "score")
        order = F.struct("locked", F.when(F.col("locked"), -F.col("ord").cast("double")).otherwise(F.col("score")), -F.col("ord"))
        best = able.withColumn("score", score).groupBy("question").agg(F.max_by(row, order).alias("b"))
        # The best one's tokens are fetched afterwards: of the others they needn't be sorted.
        key = scratch.save(best)
        tokens = all_.select("question", "grp", "hashes").join(sent(key.select("question", F.col("b.grp").alias("grp"))), ["question", "grp"]).groupBy("question").agg(F.first("hashes").alias("hashes"))
        best = key.join(tokens, "question").join(now, "question")
        n = F.size("taken")
        stop = F.when(F.size("needs") == 0, n >= F.col("target")).otherwise((_covered_all() & (n >= F.col("least"))) | (n >= F.col("target")) | ((F.col("b.score") <= 0) & (n >= F.col("least"))))
        best = best.filter(F.col("b.locked") | ~stop)
        counts = F.filter(F.col("b.support"), lambda s: (s["status"] == "direct") & F.col("needs")[s["slot"]].isNotNull())
        told = F.transform(counts, lambda s: F.struct(F.coalesce(F.col("parents")[s["slot"]], s["slot"]).alias("parent"), F.col("b.record").alias("value")))
        dated = F.transform(counts, lambda s: F.struct(F.coalesce(F.col("parents")[s["slot"]], s["slot"]).alias("parent"), s["period"].alias("value")))
        some = lambda a: F.filter(a, lambda x: x["value"] != "")
        state = scratch.save(best.select(
            "question", F.concat("taken", F.array("b.grp")).alias("taken"), F.concat("sets", F.array("hashes")).alias("sets"), F.array_union("records", F.filter(F.array("b.record"), lambda r: r != "")).alias("records"),
            F.concat("covered", F.transform(counts, lambda s: s["slot"])).alias("covered"), F.array_union("told", some(told)).alias("told"), F.array_union("dated", some(dated)).alias("dated"), (F.col("spent") + F.col("b.chars")).alias("spent"),
        ))
        if state.isEmpty():
            break
        taken = state.select("question", F.element_at("taken", -1).alias("grp"), F.lit(place).alias("place"))
        out = taken if out is None else out.unionByName(taken)
    return out if out is not None else all_.select("question", "grp", F.lit(0).alias("place")).limit(0)


def coverage_report(groups: DataFrame, chosen: DataFrame, budget: DataFrame) -> DataFrame:
    """Per question what a selection reached: candidates, selected, chars, the slots that lack direct evidence, and the
    requirements that lack some, or sources or periods."""
    taken = chosen.join(groups, ["question", "grp"])
    counts = groups.groupBy("question").agg(F.count("*").alias("candidates"))
    sums = taken.groupBy("question").agg(F.count("*").alias("selected"), F.sum("chars").alias("chars"))
    direct = taken.select("question", "record", F.explode("support").alias("s")).filter("s.status = 'direct'").select("question", "record", F.col("s.slot").alias("slot"), F.col("s.period").alias("period"))
    slots = budget.select("question", F.explode("needs").alias("slot", "need"), "parents").withColumn("parent", F.coalesce(F.col("parents")[F.col("slot")], F.col("slot"))).drop("parents")
    per_slot = slots.join(direct, ["question", "slot"], "left").groupBy("question", "slot", "need", "parent").agg(F.count("record").alias("n"))
    # A group supports a slot once, so its rows are its groups.
    missing = per_slot.filter(F.col("n") < F.col("need"))
    per_parent = slots.join(direct, ["question", "slot"]).groupBy("question", "parent").agg(F.countDistinct(F.when(F.col("record") != "", F.col("record"))).alias("n_sources"), F.countDistinct(F.when(F.col("period") != "", F.col("period"))).alias("n_periods"))
    wide = None
    for wanted, have in (("sources", "n_sources"), ("periods", "n_periods")):
        part = budget.select("question", F.explode(wanted).alias("parent", "want")).join(per_parent, ["question", "parent"], "left").filter(F.coalesce(have, F.lit(0)) < F.col("want")).select("question", "parent")
        wide = part if wide is None else wide.unionByName(part)
    lists = missing.groupBy("question").agg(F.array_sort(F.collect_set("slot")).alias("missing_slots"))
    unmet = missing.select("question", "parent").unionByName(wide).groupBy("question").agg(F.array_sort(F.collect_set("parent")).alias("unsupported"))
    out = budget.select("question", "least", "target", "most")
    for part in (counts, sums, lists, unmet):
        out = out.join(part, "question", "left")
    zero, none = F.lit(0).cast("long"), _empty("array<string>")
    return out.select("question", "least", "target", "most", *(F.coalesce(c, zero).alias(c) for c in ("candidates", "selected", "chars")), *(F.coalesce(c, none).alias(c) for c in ("missing_slots", "unsupported")))


def per_paper(groups: DataFrame, configured: int, least: int) -> DataFrame:
    """question and cap: how many groups a paper may give, so that `least` can be reached with the papers that there are."""
    papers = groups.groupBy("question").agg(F.countDistinct("record").alias("n"))
    return papers.select("question", F.greatest(F.lit(configured), F.when(F.lit(least) > 0, F.ceil(F.lit(least) / F.col("n"))).otherwise(0)).cast("int").alias("cap"))


def fitted(sizes: list[int], seed: int, chunks: int, chars: int) -> tuple[int, int]:
    """The part of a structure around its seed that fits into chunks and chars, as begin and end: `chunks` members around the
    seed, then less and less from the side on which more is left."""
    if len(sizes) <= chunks and sum(sizes) <= chars:
        return 0, len(sizes)
    width = min(chunks, len(sizes))
    begin = max(0, min(seed - width // 2, len(sizes) - width))
    end = begin + width
    while begin < end and sum(sizes[begin:end]) > chars:
        if end - begin == 1:
            return 0, 0
        if 2 * (seed - begin) >= end - begin:
            begin += 1
        else:
            end -= 1
    return begin, end


def assemble(members: DataFrame, cap: DataFrame, alike: float = 0.82, most_chunks: int = 12, most_chars: int = 18_000) -> DataFrame:
    """question, grp, chunk and place of the evidence that is put together from ranked groups.

    members: question, grp, record, chunk, seq (the place in its structure), ord (the rank of its chunk, null if it wasn't found
    itself), structured, tokens, chars. Groups go by their best chunk, the seed. One is taken if its paper's cap allows it, no
    group taken before is more than `alike` it, and it fits: whole, or, of a structure, the part around its seed that does.
    """
    scratch = Scratch(members.sparkSession)
    seed = F.min_by(F.struct("chunk", "seq", "chars"), F.coalesce("ord", F.lit(2**62)))
    of = members.groupBy("question", "grp").agg(
        F.first("record").alias("record"), F.bool_or("structured").alias("structured"), F.min("ord").alias("ord"), seed.alias("seed"),
        F.array_sort(F.collect_list(F.struct("seq", "chunk", F.col("chars").cast("long").alias("chars")))).alias("parts"), F.array_distinct(F.flatten(F.collect_list(F.transform("tokens", lambda t: F.xxhash64(t))))).alias("hashes"),
    )
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["chars"])
    groups = scratch.save(of.filter("ord is not null").withColumn("least", F.when(F.col("structured"), F.col("seed.chars")).otherwise(whole)))
    state = scratch.save(cap.select("question", "cap", _empty("array<string>").alias("taken"), _empty("array<array<bigint>>").alias("sets"), _empty("array<string>").alias("records"), F.lit(most_chunks).alias("chunks"), F.lit(most_chars).cast("long").alias("chars_left"), F.lit(None).cast(groups.select(F.struct("ord", "grp").alias("s")).schema["s"].dataType).alias("seen")))
    sent, size, out = _sent(state), FIRST_BLOCK, None

    @F.pandas_udf("struct<begin:int,stop:int>")
    def window(sizes: pd.Series, at: pd.Series, chunks: pd.Series, chars: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fitted([int(x) for x in s], int(a), int(n), int(c)) for s, a, n, c in zip(sizes, at, chunks, chars, strict=True)], columns=["begin", "stop"])

    # What was refused once is refused ever after: caps, likeness and room only get tighter. So the first that may is next, and
    # candidates are looked at in blocks, in their order; a block that was gone through isn't opened again.
    may = ~F.array_contains("taken", F.col("grp")) & (F.col("chunks") > 0) & (_n(F.col("records"), F.col("record")) < F.col("cap")) & (F.col("least") <= F.col("chars_left"))
    while not state.filter("chunks > 0").isEmpty():
        ahead = groups.select("question", "grp", "record", "ord", "least").join(sent(state.drop("sets")), "question").filter(may & (F.col("seen").isNull() | (F.struct("ord", "grp") > F.col("seen"))))
        next_ = ahead.select("question", "grp", "ord").withColumn("__n", F.row_number().over(Window.partitionBy("question").orderBy("ord", "grp"))).filter(F.col("__n") <= size)
        block = scratch.save(groups.join(sent(next_.select("question", "grp")), ["question", "grp"]))
        if block.isEmpty():
            break
        found = False
        while True:
            able = block.join(sent(state), "question").filter(may).filter(~F.exists("sets", lambda t: X.jaccard(F.col("hashes"), t) > alike))
            first = able.groupBy("question").agg(F.min_by(F.struct("grp", "record", "hashes", "parts", "seed"), F.struct("ord", "grp")).alias("b")).join(state, "question")
            at = F.array_position(F.transform("b.parts", lambda p: p["chunk"]), F.col("b.seed.chunk")) - 1
            first = first.withColumn("w", window(F.transform("b.parts", lambda p: p["chars"]), at, F.col("chunks"), F.col("chars_left")))
            kept = F.slice("b.parts", F.col("w.begin") + 1, F.col("w.stop") - F.col("w.begin"))
            new = scratch.save(first.withColumn("kept", kept).select(
                "question", "cap", F.concat("taken", F.array("b.grp")).alias("taken"), F.concat("sets", F.array("b.hashes")).alias("sets"), F.concat("records", F.array("b.record")).alias("records"),
                (F.col("chunks") - F.size("kept")).alias("chunks"), (F.col("chars_left") - F.aggregate("kept", F.lit(0).cast("long"), lambda a, p: a + p["chars"])).alias("chars_left"), "seen", "kept",
            ))
            if new.isEmpty():
                break
            found = True
            part = new.select("question", F.element_at("taken", -1).alias("grp"), F.explode("kept").alias("p"), (F.size("taken") - 1).alias("place")).select("question", "grp", F.col("p.chunk").alias("chunk"), "place")
            out = part if out is None else out.unionByName(part)
            state = scratch.save(state.join(new.select("question"), "question", "left_anti").unionByName(new.drop("kept")))
        ends = block.groupBy("question").agg(F.max(F.struct("ord", "grp")).alias("__end"))
        state = scratch.save(state.join(ends, "question", "left").withColumn("seen", F.coalesce("__end", "seen")).drop("__end"))
        size = size if found else min(2 * size, MOST_BLOCK)
    return out if out is not None else members.select("question", "grp", "chunk", F.lit(0).alias("place")).limit(0)
