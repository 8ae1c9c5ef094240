"""Adapters between how things are stored and what operators take: evidence of papers, documents for a tree, sources of tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions.splitter import section_rows
from scrivener.sources.nested import get, is_kind

# Where evidence comes from, by the kind of its chunk, and what may be used.
ORIGINS = {"table": "table", "equation": "equation", "formula": "equation", "figure_caption": "figure_caption", "caption": "figure_caption"}
ALLOWED_ORIGINS = ("paper_text", "table", "equation", "figure_caption")
SEMANTIC_QUESTIONS = ("mechanism", "comparison", "evaluation", "synthesis")


def text_or(c: Column, default: str = "") -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit(default))


# Evidence


def evidence_chunks(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """record, chunk, section, text, origin and confidence of papers (record, markdown).

    A paper's split chunks (record, chunk, content, headings, kind) are its evidence; a paper without any that has text gives
    the sections of its Markdown. Sections are paths of headings. Papers without a record, and blank texts, are left out.
    """
    named = papers.select(text_or(F.col("record")).alias("record"), "markdown").filter("record <> ''")
    origin = F.lit("paper_text")
    for kind, name in ORIGINS.items():
        origin = F.when(F.lower(text_or(F.col("kind"))) == kind, name).otherwise(origin)
    path = F.array_join(F.filter(F.transform(F.coalesce("headings", F.array().cast("array<string>")), lambda h: F.trim(h)), lambda h: h != ""), " > ")
    split = chunks.select(text_or(F.col("record")).alias("record"), F.col("chunk").cast("int").alias("chunk"), path.alias("section"), text_or(F.col("content")).alias("text"), origin.alias("origin")).filter("text <> ''")
    split = split.join(named.select("record").distinct(), "record", "left_semi")
    bare = named.join(split.select("record").distinct(), "record", "left_anti")
    read = section_rows(bare, "record", "markdown").filter("content <> ''").select("record", F.col("section").alias("chunk"), F.col("heading").alias("section"), F.col("content").alias("text"), F.lit("paper_text").alias("origin"))
    return split.unionByName(read).withColumn("confidence", F.lit(1.0))


def gated(evidence: DataFrame, own: Column, allowed: Sequence[str] = ALLOWED_ORIGINS, section_chars: int = 200, text_chars: int = 4000) -> DataFrame:
    """Evidence that an extractor may see: of the record `own`, of an allowed origin, with text; ref names it, long sections and
    texts are cut, confidences are brought into 0..1 (1 if there is none)."""
    record = F.coalesce(F.nullif(text_or(F.col("record")), F.lit("")), own)
    rows = evidence.withColumn("record", record).filter((F.col("record") == own) & (text_or(F.col("text")) != "") & F.coalesce("origin", F.lit("paper_text")).isin(*allowed))
    sure = F.least(F.greatest(F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return rows.select(
        "record", F.concat_ws(":", "record", F.coalesce("chunk", F.lit(0)).cast("string")).alias("ref"), F.substring(F.coalesce("section", F.lit("")), 1, section_chars).alias("section"),
        F.substring(F.trim("text"), 1, text_chars).alias("text"), F.coalesce("origin", F.lit("paper_text")).alias("origin"), sure.alias("confidence"),
    )


def materialized(base: DataFrame, prepared: DataFrame, key: str, order: str, first: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Prepared chunks with the metadata of the paper they come from: chunk numbers from 0 in order; of `first`, what a chunk has
    itself counts before the paper's."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = prepared.withColumn("chunk", number).join(base.select(key, *(F.col(c).alias(f"__{c}") for c in (*first, *columns))), key)
    own = [F.coalesce(c, f"__{c}").alias(c) if c in prepared.columns else F.col(f"__{c}").alias(c) for c in first]
    return rows.select(key, "chunk", *own, *(F.col(f"__{c}").alias(c) for c in columns), *(c for c in prepared.columns if c not in (key, order, *first)))


def paper_sections(chunks: DataFrame, record: str, chunk: str, text: str, most: int = 20, excerpt: int = 1200) -> DataFrame:
    """The first chunks of each paper, 1 to 50 of them, with the beginning of their texts."""
    first = chunks.withColumn("__n", F.row_number().over(Window.partitionBy(record).orderBy(chunk))).filter(F.col("__n") <= max(1, min(most, 50)))
    return first.withColumn("excerpt", F.substring(text, 1, excerpt)).drop("__n", text)


# Values and contracts


def split_values(c: Column) -> Column:
    """Parts of a text at commas and semicolons, without blanks and empty ones."""
    return F.filter(F.transform(F.split(c, r"\s*(?:,|;|，|；|、)\s*"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def unique_trimmed(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.isNotNull() & (x != "")))


def complexity(said: Column, question_type: Column, facets: Column, requirements: Column, broad: Column | None = None) -> Column:
    """complex, where a plan says so or asks for more than one simple fact; else simple."""
    wide = (F.lower(text_or(said)) == "complex") | question_type.isin(*SEMANTIC_QUESTIONS) | (facets > 1) | (requirements > 1)
    return F.when(F.coalesce(wide if broad is None else wide | broad, F.lit(False)), "complex").otherwise("simple")


def requires_validation(question_type: Column, facets: Column, requirements: Column) -> Column:
    """Whether an answer has to be held against its contract."""
    return F.coalesce((requirements > 0) | question_type.isin(*SEMANTIC_QUESTIONS) | (facets > 1), F.lit(False))


def query_texts(question: Column, facets: Column, most: int = 20) -> Column:
    """The first distinct texts to look for: the question, then of each facet (goal, query, concepts, phrases) all there is."""
    of = lambda f: F.concat(F.array(f["goal"], f["query"]), F.coalesce(f["concepts"], F.array().cast("array<string>")), F.coalesce(f["phrases"], F.array().cast("array<string>")))
    rest = F.flatten(F.transform(F.coalesce(facets, F.array().cast(facets_type())), of))
    return F.slice(unique_trimmed(F.concat(F.array(question), rest)), 1, most)


def facets_type() -> str:
    return "array<struct<goal:string,query:string,concepts:array<string>,phrases:array<string>>>"


def entity_text(name: Column, kind: Column, aliases: Column, attributes: Column) -> Column:
    """What an entity is found by; attributes: array of (name, value)."""
    pairs = F.transform(F.coalesce(attributes, F.array().cast("array<struct<name:string,value:string>>")), lambda a: F.concat_ws(" ", F.coalesce(a["name"], F.lit("")), F.coalesce(a["value"], F.lit(""))))
    return F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(kind, F.lit("")), F.array_join(F.coalesce(aliases, F.array().cast("array<string>")), " "), F.array_join(pairs, " "))


def relation_claim(source: Column, predicate: Column, target: Column) -> Column:
    parts = F.filter(F.array(*(F.trim(F.coalesce(c, F.lit(""))) for c in (source, predicate, target))), lambda x: x != "")
    return F.array_join(parts, " ")


# Documents of a tree


def keywords(metadata: Column, markdown: Column) -> Column:
    """The keywords of a record's metadata (VARIANT; a list or a text), else of the line that begins with them."""
    trimmed = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    parts = lambda c: trimmed(F.split(c, "[;；,，|]"))
    out = F.when(F.regexp_extract(F.coalesce(markdown, F.lit("")), r"(?im)^keywords?\s*:\s*(.+)$", 1) != "", parts(F.regexp_extract(markdown, r"(?im)^keywords?\s*:\s*(.+)$", 1)))
    for name in ("keywordList", "keywords"):
        listed = trimmed(get(metadata, f"$.{name}", "array<string>"))
        told = F.when(is_kind(metadata, f"$.{name}", "ARRAY") & (F.size(listed) > 0), listed).when(is_kind(metadata, f"$.{name}", "STRING") & (F.trim(get(metadata, f"$.{name}")) != ""), parts(get(metadata, f"$.{name}")))
        out = F.coalesce(told, out)
    return F.coalesce(out, F.array().cast("array<string>"))


def headings(markdown: Column) -> Column:
    """Levels and titles of a text's headings, the first of those that agree in level and, but for case, in title."""
    lines = F.filter(F.transform(F.split(F.coalesce(markdown, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^#{1,6}\s+\S"))
    found = F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, r"^(#+)", 1)).alias("level"), F.regexp_replace(F.regexp_extract(x, r"^#+\s+(.*)$", 1), r"\s+", " ").alias("title")))
    same = lambda a, b: (a["level"] == b["level"]) & (F.lower(a["title"]) == F.lower(b["title"]))
    return F.aggregate(found, F.array().cast("array<struct<level:int,title:string>>"), lambda seen, h: F.when(F.exists(seen, lambda s: same(s, h)), seen).otherwise(F.array_append(seen, h)))


def tree_documents(papers: DataFrame, ids: DataFrame, files: DataFrame) -> DataFrame:
    """record, title, abstract, keywords and headings of the papers (record, title, metadata as JSON text) that are asked for and
    have a Markdown file (record, markdown)."""
    rows = papers.join(ids.select("record").distinct(), "record", "left_semi").join(files.select("record", "markdown"), "record").filter("markdown is not null")
    rows = rows.withColumn("m", F.coalesce(F.try_parse_json("metadata"), F.parse_json(F.lit("{}"))))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    title = F.coalesce(some(get(F.col("m"), "$.title")), some(F.col("title")), F.col("record").cast("string"))
    return rows.select("record", title.alias("title"), F.coalesce(F.trim(get(F.col("m"), "$.abstract")), F.lit("")).alias("abstract"), keywords(F.col("m"), F.col("markdown")).alias("keywords"), headings(F.col("markdown")).alias("headings"))


def resumable(snapshot: DataFrame, members: DataFrame, group: str, key: str) -> DataFrame:
    """Per group whether a build can go on: its members are those of the snapshot; lost and added count those that aren't."""
    old, new = (df.select(group, key).distinct().withColumn(c, F.lit(1)) for df, c in ((snapshot, "__old"), (members, "__new")))
    both = old.join(new, [group, key], "full").groupBy(group).agg(F.count_if(F.col("__new").isNull()).alias("lost"), F.count_if(F.col("__old").isNull()).alias("added"))
    return both.withColumn("resumable", (F.col("lost") == 0) & (F.col("added") == 0))


# Tools


def tool_sources(results: DataFrame, group: str, order: str) -> DataFrame:
    """The sources that tools have named (group, order, record, chunk, title, excerpt and more), one per record, chunk and title:
    in the order in which they came first, with the longest excerpt, of those the first; index counts from 1."""
    keyed = results.withColumns({"record": F.coalesce("record", F.lit("")), "chunk": F.coalesce("chunk", F.lit(0)), "title": F.coalesce("title", F.lit(""))})
    longest = F.struct(F.length(F.coalesce("excerpt", F.lit(""))), -F.col(order))
    rest = [c for c in results.columns if c not in (group, order, "record", "chunk", "title")]
    best = keyed.groupBy(group, "record", "chunk", "title").agg(F.min(order).alias("__first"), F.max_by(F.struct(*rest), longest).alias("r"))
    index = F.row_number().over(Window.partitionBy(group).orderBy("__first"))  # the sources of one conversation
    return best.select(group, index.alias("index"), "record", "chunk", "title", "r.*")


def research_seeds(sources: DataFrame, group: str) -> DataFrame:
    """The records and chunks of tool sources that a retrieval starts from, once each, the first index of each."""
    return sources.filter("record <> ''").groupBy(group, "record", "chunk").agg(F.min("index").alias("index"))


def available(pdf: Column, abstract: Column, full_text: Column) -> Column:
    """What there is of a paper."""
    parts = F.array(F.lit("metadata"), F.when(abstract, "abstract"), F.when(pdf, "pdf"), F.when(full_text, "parsed_full_text"))
    return F.filter(parts, lambda p: p.isNotNull())
