"""Operators of a knowledge graph and of the plans that use it, with columns and limits as arguments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions.text import folded


# Ids


def map_id(prefix: str, *parts: Column) -> Column:
    """prefix:hash of the parts, whatever their case and the blanks around them; a null part is an empty one."""
    plain = [folded(F.regexp_replace(F.coalesce(p.cast("string"), F.lit("")), r"^\s+|\s+$", "")) for p in parts]
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat_ws("\x1f", *plain), 256), 1, 24))


def structure_id(headings: Column, kind: Column, ordinal: Column, content: Column) -> Column:
    """A structure's id, from the headings above it, its kind, which of its section's it is, and its text."""
    path = F.array_join(F.filter(F.transform(headings, lambda h: F.trim(h)), lambda h: h != ""), " > ")
    return F.concat(F.lit("structure-"), kind, F.lit("-"), F.substring(F.sha1(F.concat_ws("\n", path, kind, ordinal.cast("string"), content).cast("binary")), 1, 16))


# Entities


def merged_attributes(rows: DataFrame, entity: str, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """rows (entity, name, value, unit and more) once per name, value and unit: the first of each in order, with how many there
    were. A null value or unit is a value of its own."""
    first = F.min_by(F.struct(*dict.fromkeys((*keep, *order))), F.struct(*order))
    out = rows.groupBy(entity, "name", "value", "unit").agg(first.alias("__r"), F.count("*").alias("mentions"))
    return out.select(entity, "name", "value", "unit", "mentions", *(F.col(f"__r.{c}").alias(c) for c in keep))


@dataclass(frozen=True)
class Found:
    nodes: DataFrame
    relations: DataFrame
    evidence: DataFrame
    counts: DataFrame


def holds(df: DataFrame, text: str) -> Column:
    """Whether any field of a row has a text in it, whatever the case."""
    return F.contains(F.lower(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in df.columns)))), F.lit(text.lower()))


def graph_query(nodes: DataFrame, relations: DataFrame, evidence: DataFrame, text: str = "", limit: int = 20, order: str = "id") -> Found:
    """A sample or a search of a graph: nodes (id ...), relations (id, source, target ...) and evidence (id ...), `limit` of each
    (1 to 50), by id, and counts: how many there are and how many are returned.

    Without a text the first of each. With one the nodes and the evidence that have it in some field, and the relations that do or
    that one of the returned nodes is an end of.
    """
    limit, wanted = max(1, min(limit, 50)), text.strip()
    first = lambda df: df.orderBy(order).limit(limit)
    if not wanted:
        found = [first(df) for df in (nodes, relations, evidence)]
    else:
        some = first(nodes.filter(holds(nodes, wanted)))
        ids = F.broadcast(some.select(F.col("id").alias("__n")))  # `limit` rows
        near = None
        for end in ("source", "target"):
            part = relations.join(ids, F.col(end) == F.col("__n"), "left_semi")
            near = part if near is None else near.unionByName(part)
        # Of each kind the first ones are enough.
        both = first(near.distinct()).unionByName(first(relations.filter(holds(relations, wanted)))).distinct()
        found = [some, first(both), first(evidence.filter(holds(evidence, wanted)))]
    counts = None
    for name, of, got in zip(("nodes", "relations", "evidence"), (nodes, relations, evidence), found, strict=True):
        row = of.agg(F.count("*").alias("total")).crossJoin(got.agg(F.count("*").alias("returned"))).select(F.lit(name).alias("kind"), "total", "returned")  # one row each
        counts = row if counts is None else counts.unionByName(row)
    return Found(*found, counts)


# Plans


METHOD_WORDS = "method framework protocol algorithm implementation"  # fixed value: what a mechanism's queries look for too


def refinements(facets: DataFrame, requirements: DataFrame, assessments: DataFrame, proposals: DataFrame | None = None, missing: DataFrame | None = None, methods: DataFrame | None = None, most: int = 4) -> DataFrame:
    """What to look for next, per question: question, place, id, query and goal, `most` of them at most.

    The proposals (question, id, query, goal, ord) of known ids, if there are any; else a query for every assessment (question, id,
    status, query, ord) that isn't `supported`: its own, else that of its facet (question, id, query, goal, ord) or the description
    of its requirement (question, id, description); else the facets that are missing (question, id); else, for questions of
    `methods` (question), all facets with words of methods.
    """
    known = facets.select("question", "id").unionByName(requirements.select("question", "id")).distinct()
    f = facets.select("question", "id", F.col("query").alias("__fq"), F.col("goal").alias("__fg"), F.lit(True).alias("__is"))
    r = requirements.select("question", "id", F.col("description").alias("__rd"))
    gaps = assessments.filter(~F.col("status").eqNullSafe("supported")).join(f, ["question", "id"], "left").join(r, ["question", "id"], "left")
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    query = F.coalesce(some(F.col("query")), some(F.col("__fq")), some(F.col("__rd")))
    generated = gaps.withColumn("__q", query).filter("__q is not null").select("question", F.when(F.col("__is"), F.col("id")).otherwise(F.concat(F.lit("requirement-"), "id")).alias("id"), F.col("__q").alias("query"), F.coalesce(some(F.col("__fg")), some(F.col("__rd")), F.col("__q")).alias("goal"), F.col("ord"))
    tiers = [generated]
    if proposals is not None:
        tiers.insert(0, proposals.join(known, ["question", "id"], "left_semi").select("question", "id", "query", "goal", "ord"))
    own = facets.select("question", "id", "query", "goal", "ord")
    if missing is not None:
        tiers.append(own.join(missing.select("question", "id").distinct(), ["question", "id"], "left_semi"))
    if methods is not None:
        able = own.join(methods.select("question").distinct(), "question", "left_semi").filter(F.trim("query") != "").withColumn("__n", F.row_number().over(Window.partitionBy("question").orderBy("ord")))
        tiers.append(able.select("question", F.concat(F.lit("refine-method-"), F.col("__n").cast("string")).alias("id"), F.concat_ws("\n", "query", F.coalesce("goal", F.lit("")), F.lit(METHOD_WORDS)).alias("query"), "goal", "ord"))
    rows = None
    for n, tier in enumerate(tiers):
        tier = tier.withColumn("__tier", F.lit(n))
        rows = tier if rows is None else rows.unionByName(tier)
    # Of a question's tiers the first that has any; a plan's rows are few.
    w = Window.partitionBy("question")
    best = rows.withColumn("__best", F.min("__tier").over(w)).filter(F.col("__tier") == F.col("__best"))
    place = F.row_number().over(w.orderBy("ord", "id")) - 1
    return best.withColumn("place", place).filter(F.col("place") < most).select("question", "place", "id", "query", "goal")


def conversation_view(turns: DataFrame, conversation: str, order: str, role: str, text: str, last: int = 6, chars: int = 1000, sources: str | None = None, most_sources: int = 20) -> DataFrame:
    """Per conversation what its user wanted, and the last answers with their sources: intents and answers (text, trusted: never,
    sources), in order. Blank turns and other roles are left out, long texts are cut."""
    rows = turns.filter(F.col(role).isin("user", "assistant") & (F.trim(F.coalesce(text, F.lit(""))) != ""))
    rows = rows.withColumn("__t", F.substring(F.trim(text), 1, chars)).withColumn("__r", F.row_number().over(Window.partitionBy(conversation, role).orderBy(F.col(order).desc())))
    cited = F.slice(F.coalesce(F.col(sources), F.array().cast("array<string>")), 1, most_sources) if sources else F.array().cast("array<string>")
    listed = lambda who, c: F.transform(F.array_sort(F.collect_list(F.when((F.col(role) == who) & (F.col("__r") <= last), F.struct(F.col(order).alias("o"), c.alias("c"))))), lambda s: s["c"])
    return rows.groupBy(conversation).agg(listed("user", F.col("__t")).alias("intents"), listed("assistant", F.struct(F.col("__t").alias("text"), F.lit(False).alias("trusted"), cited.alias("sources"))).alias("answers"))


def histograms(nodes: DataFrame, entities: DataFrame, cards: DataFrame, node_type: str = "type", entity_type: str = "type", claims: str = "claims") -> DataFrame:
    """kind, type and n: how many nodes and entities there are of each type (`unknown` for a blank one), and the sum of claims."""
    typed = lambda df, c, kind: df.groupBy(F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("unknown")).alias("type")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    total = cards.agg(F.coalesce(F.sum(claims), F.lit(0)).cast("long").alias("n")).select(F.lit("claims").alias("kind"), F.lit("all").alias("type"), "n")
    return typed(nodes, node_type, "node").unionByName(typed(entities, entity_type, "entity")).unionByName(total)


def restricted(requested: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """What is requested, if all of it is allowed; an error names ten that aren't. Nothing requested is all that is allowed."""
    asked = requested.select(key).distinct()
    beyond = asked.join(allowed.select(key).distinct(), key, "left_anti").orderBy(key).limit(10).collect()
    if beyond:
        raise ValueError("beyond the scope: " + ", ".join(str(r[key]) for r in beyond))
    return allowed.select(key).distinct() if asked.isEmpty() else asked


def sources_within(turns: DataFrame, allowed: DataFrame, keys: list[str], sources: str, record: str = "record") -> DataFrame:
    """turns with only those of their sources (an array of structs) whose record is allowed."""
    each = turns.select(*keys, F.posexplode(sources).alias("__i", "__s"))
    kept = each.join(allowed.select(F.col(record).alias("__r")).distinct(), F.col(f"__s.{record}") == F.col("__r"), "left_semi").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__s"))), lambda x: x["__s"]).alias("__kept"))
    out = turns.join(kept, keys, "left")
    return out.withColumn(sources, F.coalesce("__kept", F.filter(sources, lambda s: F.lit(False)))).drop("__kept")
