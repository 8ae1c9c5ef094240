"""Cards of papers: what an extractor's payload has that can be verified, how cards and relations are stored, and evidence as text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.operators.knowledge import map_id
from scrivener.sources.nested import exploded, get, is_kind

# Longest parts, and what stands for those that are missing.
LONGEST = {"subject": 1000, "predicate": 300, "object": 2000, "kind": 120, "quote": 1000, "type": 300, "label": 1000, "facet": 200, "value": 1000, "summary": 4000, "language": 40}
STATEMENT, UNRESOLVED = "statement", "unresolved_label"


@dataclass(frozen=True)
class Cards:
    cards: DataFrame
    facets: DataFrame
    claims: DataFrame
    relations: DataFrame
    diagnostics: DataFrame


def _text(v: Column, *paths: str) -> Column:
    """The first of a VARIANT's fields that has a text, trimmed; else an empty one."""
    return F.coalesce(*(F.nullif(F.trim(get(v, p)), F.lit("")) for p in paths), F.lit(""))


def _sure(v: Column) -> Column:
    return F.least(F.greatest(F.coalesce(get(v, "$.confidence", "double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _items(payloads: DataFrame, *paths: str) -> DataFrame:
    """paper, at and value of the objects in the first of a payload's fields that is a list."""
    array = F.lit(None)
    for p in reversed(paths):
        array = F.when(is_kind(F.col("v"), p, "ARRAY"), get(F.col("v"), p, "variant")).otherwise(array) if p != paths[-1] else F.when(is_kind(F.col("v"), p, "ARRAY"), get(F.col("v"), p, "variant"))
    rows = exploded(payloads.select("paper", array.alias("a")).filter("a is not null"), F.col("a"))
    return rows.filter(is_kind(F.col("value"), "$", "OBJECT")).select("paper", F.col("pos").alias("at"), "value")


def _verified(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """paper, at and refs: an item's references whose quote stands in the evidence that it names, once each, in order."""
    listed = items.filter(is_kind(F.col("value"), "$.evidence", "ARRAY")).select("paper", "at", get(F.col("value"), "$.evidence", "variant").alias("e"))
    each = exploded(listed, F.col("e")).filter(is_kind(F.col("value"), "$", "OBJECT")).select("paper", "at", "pos", _text(F.col("value"), "$.ref").alias("ref"), _text(F.col("value"), "$.quote").alias("quote"))
    found = each.filter("quote <> ''").join(evidence.select("paper", "ref", "section", "origin", "confidence", one_line(F.col("text")).alias("__t")), ["paper", "ref"])
    found = found.filter(F.contains("__t", one_line(F.col("quote"))))
    once = found.groupBy("paper", "at", "ref", "quote").agg(F.min("pos").alias("pos"), F.first("section").alias("section"), F.first("origin").alias("origin"), F.first("confidence").alias("confidence"))
    entry = F.struct("pos", "ref", F.substring("quote", 1, LONGEST["quote"]).alias("quote"), "section", "origin", "confidence")
    return once.groupBy("paper", "at").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("pos")).alias("refs"))  # an item's references


def normalized_cards(payloads: DataFrame, evidence: DataFrame) -> Cards:
    """Payloads (paper, v: VARIANT) held against evidence (paper, ref, section, text, origin, confidence).

    Claims need a subject, a predicate and an object, relations a type and a target, and both a quote that stands in the evidence it
    names; others are rejected, with the reason. Facets have a name and distinct values; the last of a name counts. Long parts are
    cut. Payloads that aren't objects give a card without anything.
    """
    cut = lambda c, part: F.substring(c, 1, LONGEST[part])
    v = F.col("v")
    cards = payloads.select("paper", cut(_text(v, "$.summary"), "summary").alias("summary"), cut(_text(v, "$.source_language", "$.sourceLanguage"), "language").alias("language"))

    named = _items(payloads, "$.facets").select("paper", "at", cut(_text(F.col("value"), "$.name"), "facet").alias("name"), get(F.col("value"), "$.values", "array<string>").alias("values"))
    values = F.array_distinct(F.filter(F.transform("values", lambda x: F.substring(F.trim(x), 1, LONGEST["value"])), lambda x: x.isNotNull() & (x != "")))
    facets = named.withColumn("values", values).filter("name <> '' and size(values) > 0").groupBy("paper", "name").agg(F.max_by("values", "at").alias("values"))

    value = F.col("value")
    claims = _items(payloads, "$.claims")
    claims = claims.join(_verified(claims, evidence), ["paper", "at"], "left").select(
        "paper", "at", cut(F.coalesce(F.nullif(_text(value, "$.kind"), F.lit("")), F.lit(STATEMENT)), "kind").alias("kind"), _text(value, "$.kind").alias("__kind"), _text(value, "$.subject").alias("subject"), _text(value, "$.predicate").alias("predicate"),
        _text(value, "$.object").alias("object"), _sure(value).alias("confidence"), "refs",
    )
    ident = map_id("claim", F.col("paper"), F.col("__kind"), F.col("subject"), F.col("predicate"), F.col("object"))
    claims = claims.withColumn("id", ident).withColumn("reason", F.when((F.col("subject") == "") | (F.col("predicate") == "") | (F.col("object") == ""), "missing_part").when(F.col("refs").isNull(), "unverified"))

    relations = _items(payloads, "$.relation_candidates", "$.relationCandidates")
    relations = relations.join(_verified(relations, evidence), ["paper", "at"], "left").select(
        "paper", "at", _text(value, "$.relation_type", "$.relationType").alias("type"), _text(value, "$.target_label", "$.targetLabel").alias("target"), _text(value, "$.target_paper_id", "$.targetPaperId").alias("target_paper"),
        F.coalesce(F.nullif(_text(value, "$.target_type", "$.targetType"), F.lit("")), F.lit(UNRESOLVED)).alias("target_type"), _sure(value).alias("confidence"), "refs",
    )
    relations = relations.withColumn("reason", F.when((F.col("type") == "") | (F.col("target") == ""), "missing_part").when(F.col("refs").isNull(), "unverified"))

    counts = lambda df, name: df.groupBy("paper").agg(F.count_if(F.col("reason").isNull()).alias(f"accepted_{name}"), F.count_if(F.col("reason") == "missing_part").alias(f"incomplete_{name}"), F.count_if(F.col("reason") == "unverified").alias(f"unverified_{name}"))
    told = payloads.select("paper").distinct().join(counts(claims, "claims"), "paper", "left").join(counts(relations, "relations"), "paper", "left")
    told = told.na.fill(0)
    kept = claims.filter("reason is null").select("id", "paper", "at", "kind", cut(F.col("subject"), "subject").alias("subject"), cut(F.col("predicate"), "predicate").alias("predicate"), cut(F.col("object"), "object").alias("object"), "confidence", "refs")
    linked = relations.filter("reason is null").select("paper", "at", cut(F.col("type"), "type").alias("type"), cut(F.col("target"), "label").alias("target"), "target_paper", "target_type", "confidence", "refs")
    return Cards(cards, facets, kept, linked, told)


# How cards are stored


def saved(old: DataFrame, new: DataFrame, key: str, created: str, now: Column) -> DataFrame:
    """Rows after new ones took the place of those with their key; when a row was first there stays."""
    first = old.select(key, F.col(created).alias("__c"))
    fresh = new.drop(created).join(first, key, "left").withColumn(created, F.coalesce("__c", now)).drop("__c")
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(fresh.select(*old.columns))


def rewritten(old: DataFrame, new: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows after all of the scope (keys) went and new ones came, also where the scope gets none; new rows beyond the scope are
    left out."""
    ids = scope.select(*keys).distinct()
    return old.join(ids, list(keys), "left_anti").unionByName(new.join(ids, list(keys), "left_semi").select(*old.columns))


def committed(staged: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Staged extractions with the status `committed` where they were `validated` and are done; others stay as they are."""
    hit = done.select(*keys).distinct().withColumn("__done", F.lit(True))
    out = staged.join(hit, list(keys), "left")
    return out.withColumn("status", F.when(F.col("__done") & (F.col("status") == "validated"), "committed").otherwise(F.col("status"))).drop("__done")


def replaced_members(members: DataFrame, wanted: DataFrame, papers: DataFrame, eligible: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """members (project, paper) after those of the projects in wanted (project, paper) were replaced, and the exclusions: eligible
    papers (project, paper) of those projects that aren't wanted. A wanted paper that doesn't exist is an error that names ten."""
    asked = wanted.select("project", "paper").distinct()
    unknown = asked.join(papers.select("paper").distinct(), "paper", "left_anti").select("paper").distinct().orderBy("paper").limit(10).collect()
    if unknown:
        raise ValueError("no such papers: " + ", ".join(str(r["paper"]) for r in unknown))
    projects = asked.select("project").distinct()
    rows = members.select("project", "paper").join(projects, "project", "left_anti").unionByName(asked)
    left = (eligible if eligible is not None else asked.limit(0)).select("project", "paper").distinct().join(projects, "project", "left_semi").join(asked, ["project", "paper"], "left_anti")
    return rows, left


# Evidence as text


def context(evidence: DataFrame, group: str, order: str) -> DataFrame:
    """Per group one text of its evidence (title, year, section, structure, kind, seq, continues_from, continues_to, by_graph, text) in
    order: a number, what is known of it between middle dots, and its text; pieces are parted by rules."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))  # a context's pieces
    some = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    before, after = some("continues_from").isNotNull(), some("continues_to").isNotNull()
    link = F.when(before & after, "，前后均有连续片段").when(before, "，承接上一片段").when(after, "，后续仍有连续片段").otherwise("")
    structure = F.when(some("structure").isNotNull(), F.concat(F.lit("连续结构："), F.coalesce(some("kind"), F.lit("structure")), F.lit(" 第 "), (F.coalesce("seq", F.lit(0)) + 1).cast("string"), F.lit(" 段"), link))
    marks = F.concat_ws(" · ", F.coalesce(some("title"), F.lit("未命名文献")), some("year"), F.concat(F.lit("章节："), some("section")), structure, F.when(F.col("by_graph"), "检索路径：知识图谱导航后已回查原文"))
    block = F.concat(F.lit("["), F.col("__n").cast("string"), F.lit("] "), marks, F.lit("\n"), F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    listed = F.array_sort(F.collect_list(F.struct(F.col("__n").alias("o"), block.alias("b"))))
    return evidence.withColumn("__n", n).groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n---\n\n").alias("context"))


# Builds


def build_states(log: DataFrame, paper: str, sequence: str, kind: str, versions: Sequence[str], status: str, error: str, at: str, longest_error: int = 4000) -> DataFrame:
    """Per paper its build after a log of `started` and `finished`: the versions of the last start, status, error, started_at and
    completed_at. A start begins a build anew as `running`; what finishes afterwards, the last of several, ends it. What finishes
    without a start is no build."""
    begun = log.filter(F.col(kind) == "started").groupBy(paper).agg(F.max_by(F.struct(F.col(sequence).alias("__s"), *versions, F.col(at).alias("started_at")), sequence).alias("b"))
    ends = log.filter(F.col(kind) == "finished").join(begun.select(paper, F.col("b.__s").alias("__from")), paper).filter(F.col(sequence) > F.col("__from"))
    done = ends.groupBy(paper).agg(F.max_by(F.struct(F.col(status).alias("status"), F.substring(F.coalesce(error, F.lit("")), 1, longest_error).alias("error"), F.col(at).alias("completed_at")), sequence).alias("e"))
    out = begun.join(done, paper, "left")
    return out.select(paper, *(F.col(f"b.{v}").alias(v) for v in versions), F.coalesce("e.status", F.lit("running")).alias("status"), F.coalesce("e.error", F.lit("")).alias("error"), "b.started_at", F.col("e.completed_at").alias("completed_at"))


def statuses_of(builds: DataFrame, paper: str, asked: Sequence[str]) -> DataFrame:
    """The builds of some papers in the order in which they are asked for, each once; those without a build are left out."""
    wanted = list(dict.fromkeys(k for a in asked if (k := str(a or "").strip())))
    places = builds.sparkSession.createDataFrame([(k, i) for i, k in enumerate(wanted)], f"`{paper}` string, place int")
    return builds.join(F.broadcast(places), paper).orderBy("place")  # the papers that are asked for
