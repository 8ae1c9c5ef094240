"""Queries of evidence selection, evaluation and section splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import markdown as M
from scrivener.functions import splitter as P
from scrivener.functions import tables as T
from scrivener.functions import text as X
from scrivener.operators import evidence as E
from scrivener.operators import selection as L
from scrivener.registry import query
from scrivener.session import spread, table


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence for four questions, one per language."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    marks = F.array(F.when(F.col("doc_id") % 3 == 0, "a"), F.when(F.col("doc_id") % 4 == 0, "b"), F.when(F.col("doc_id") % 5 == 0, "c"), F.when(F.col("quality") == 1, "d"))
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    return docs.select(
        F.col("lang").alias("question"), "doc_id", F.col("source").alias("paper"), F.col("source").alias("source"), (F.col("doc_id") % 7).alias("period"), (F.col("doc_id") % 2).cast("string").alias("section"), (F.col("doc_id") % 3).cast("string").alias("facet"),
        F.slice(X.retrieval_tokens(F.col("text")), 1, 60).alias("tokens"), F.length("text").alias("chars"), (F.col("n_chars") % 100 / 10.0).alias("relevance"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("locked"),
        some(marks).alias("slots"), some(F.array(F.when(F.col("doc_id") % 2 == 0, "a"), F.when(F.col("doc_id") % 6 == 1, "b"))).alias("partial"),
    ).filter("chars > 0")


def best_first() -> list:
    return [F.desc("relevance"), F.col("doc_id")]


@query("evidence_assembly")
def evidence_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each question within the caps of papers, similarity, groups and characters. Greedy, so not in SQL."""
    return E.assemble(candidates(spark, sf_dir), best_first()).select("question", "doc_id", "place")


@query("coverage_selection")
def coverage_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each question that covers its slots, by what each piece adds for its length. Greedy, so not in SQL."""
    return E.select_covering(candidates(spark, sf_dir), best_first(), 8).select("question", "doc_id", "place")


@query("facet_selection")
def facet_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each question, facets first, few pieces per section. Greedy, so not in SQL."""
    return E.facets_first(candidates(spark, sf_dir), best_first(), 2).select("question", "doc_id", "place")


@query(
    "structure_completion",
    """WITH s AS (SELECT conv_id, min(turn) AS seed FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
p AS (SELECT conv_id, turn, seed, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY abs(turn - seed), turn DESC ROWS UNBOUNDED PRECEDING) AS c FROM conversations JOIN s USING (conv_id))
SELECT conv_id, turn FROM p WHERE c <= 600 OR turn = seed""",
)
def structure_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole structures of seeds, or what fits around them."""
    turns = table(spark, sf_dir, "conversations").withColumn("chars", F.length("text"))
    return E.completed(turns.filter("role = 'assistant'").select("conv_id", "turn"), turns.select("conv_id", "turn", "chars"), "conv_id", "turn", "chars", 600).select("conv_id", "turn")


@query("evidence_order", "SELECT l_orderkey, l_linenumber, l_suppkey, dense_rank() OVER (ORDER BY f, l_suppkey) AS place, row_number() OVER (PARTITION BY l_suppkey ORDER BY q, o)::INT AS nth FROM (SELECT *, min(o) OVER (PARTITION BY l_suppkey) AS f FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_orderkey * 10 + l_linenumber AS o, sum(l_quantity) AS q FROM lineitem GROUP BY ALL))")
def evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in the order of its groups' first pieces, and of sequence within."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.sum("l_quantity").alias("q")).withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return E.grouped_in_order(items, ["l_suppkey"], "o", "q").select("l_orderkey", "l_linenumber", "l_suppkey", "place", "nth")


@query("chunk_overlap_stats", "SELECT count(*) AS chunks, count(DISTINCT conv_id) AS records, round(avg(length(text)), 4) AS mean_chars, max(length(text))::INT AS most_chars, count(*) FILTER (turn > 1) AS overlapping FROM conversations")
def chunk_overlap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a retrieval's chunks: how many, how long, how many that follow another."""
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    return rows.agg(F.count("*").alias("chunks"), F.countDistinct("conv_id").alias("records"), F.round(F.avg("n"), 4).alias("mean_chars"), F.max("n").alias("most_chars"), F.count_if(F.col("turn") > 1).alias("overlapping"))


@query(
    "evidence_sufficiency",
    "SELECT source, array_to_string(list_filter([CASE WHEN count(*) < 60 THEN 'too_few_groups' END, CASE WHEN count(DISTINCT lang) < 4 THEN 'too_few_papers' END, CASE WHEN coalesce(avg(quality) >= 0.5, false) = false THEN 'low_quality' END], lambda x: x IS NOT NULL), ',') AS reasons, NOT (count(*) < 60 OR count(DISTINCT lang) < 4 OR NOT coalesce(avg(quality) >= 0.5, false)) AS sufficient FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
)
def evidence_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a source's evidence isn't enough."""
    counts = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("papers"), F.avg("quality").alias("q"))
    out = E.sufficiency(counts, [("too_few_groups", F.col("n") >= 60), ("too_few_papers", F.col("papers") >= 4), ("low_quality", F.col("q") >= 0.5)])
    return out.select("source", F.array_join("reasons", ",").alias("reasons"), "sufficient")


@query("facet_coverage", "SELECT lang, round(avg((coalesce(quality, 0) = 1)::INT), 4) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def facet_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of supported facets."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.round(F.avg((F.coalesce("quality", F.lit(0)) == 1).cast("int")), 4).alias("coverage"))


@query("evaluation_merge", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'third' WHEN p_size > 20 THEN 'second' ELSE 'first' END AS status FROM part")
def evaluation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments of three lists, the last of each id."""
    part = table(spark, sf_dir, "part")
    lists = [part.filter(F.col("p_size") > least).select("p_partkey", F.lit(name).alias("status")) for name, least in (("first", 0), ("second", 20), ("third", 40))]
    return E.merge_evaluations(lists, "p_partkey")


@query(
    "assessment_normalize",
    """WITH r AS (SELECT l_orderkey AS id, (l_linenumber, l_partkey, l_returnflag) AS ord, CASE l_returnflag WHEN 'A' THEN 'SUPPORTED' WHEN 'N' THEN 'partial' ELSE 'maybe' END AS status, l_partkey AS ref FROM lineitem),
f AS (SELECT id, arg_min(status, ord) AS status, arg_min(ref, ord) AS ref FROM r WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY id)
SELECT id, CASE WHEN lower(status) = 'partial' THEN 'partial' WHEN lower(status) = 'supported' AND p_partkey IS NOT NULL THEN 'supported' ELSE 'unsupported' END AS status, (p_partkey IS NOT NULL)::INT AS refs FROM f LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 25) ON p_partkey = ref""",
)
def assessment_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments of allowed ids with known references."""
    status = F.when(F.col("l_returnflag") == "A", "SUPPORTED").when(F.col("l_returnflag") == "N", "partial").otherwise("maybe")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("ord"), status.alias("status"), F.array("l_partkey").alias("refs"))
    allowed = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    known = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("ref"))
    return E.normalized_assessments(rows, allowed, known).select("id", "status", F.size("refs").alias("refs"))


@query("context_rendering", "SELECT conv_id, string_agg('[' || turn || '] ' || role || ' · ' || left(text, 40), chr(10) ORDER BY turn) AS context FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def context_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence as one numbered text per question."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    return E.rendered(turns, "conv_id", "turn", F.col("role"), F.substring("text", 1, 40))


@query("section_pieces")
def section_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pieces by section, small sections together, structures apart. Each piece depends on what waits before it."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return P.section_pieces(docs, "doc_id", "text").select("doc_id", "piece", "headings", "category", "kind", "structure", "part", "parts", "continues_from", "continues_to", "content")


@query("document_pieces")
def document_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split at headings, by size and by kind of text. A fold over lines, so not in SQL."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(r"concat('Abstract - ', text, '\n\n1 Our Method\n', left(text, 300), '\n\n```\na = 1\n\n\nb = 2\n```\n\nReferences\n[1] A\n')").alias("text"))
    found = M.document_pieces(spread(docs), "doc_id", "text")
    return found.select("doc_id", "piece", "heading", "level", "category", "kind", "part", "parts", F.sha2("content", 256).alias("content"))


@query("markdown_normalize", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10))) AS content FROM documents WHERE text IS NOT NULL AND NOT contains(text, '```') AND NOT contains(text, '~~~') AND NOT regexp_matches(text, '[^\x00-\x7f]|\r|[\x0b\x0c\x1c-\x1f]')")
def markdown_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII texts without fences, their lines trimmed and empty lines single."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").filter(~F.contains("text", F.lit("```")) & ~F.contains("text", F.lit("~~~")) & ~F.col("text").rlike(r"[^\x00-\x7f]|\r|[\x0b\x0c\x1c-\x1f]"))
    return M.normalize_markdown(docs, "doc_id", "text").select("doc_id", F.sha2("content", 256).alias("content"))


@query("algorithm_units", "SELECT p_partkey, 3 AS units FROM part")
def algorithm_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic units of texts with an algorithm between two pieces of prose."""
    text = F.concat("p_name", F.lit("\n\n1: do\n2: so\n3: end\n\n"), "p_type")
    rows = T._per_text(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text", "kind string, content string", M.units_of)
    return rows.groupBy("p_partkey").agg(F.count("*").cast("int").alias("units"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence groups for a question per language: whole texts, all of them candidates."""
    docs = table(spark, sf_dir, "documents").filter("text <> ''").join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    says = lambda slot, status: F.struct(F.lit(slot).alias("slot"), status.alias("status"), F.round(F.col("n_chars") % 100 / 100.0, 2).alias("confidence"), F.col("source").alias("period"))
    support = F.array(
        says("long", F.when(F.col("n_chars") > 3000, "direct").when(F.col("n_chars") > 1000, "partial").otherwise("unsupported")), says("good", F.when(F.col("quality") == 1, "direct").otherwise("unsupported")),
        says("short", F.when(F.col("n_chars") < 200, "direct").otherwise("partial")),
    )
    return docs.select(
        F.col("lang").alias("question"), F.col("doc_id").cast("string").alias("grp"), F.col("source").alias("record"), F.col("doc_id").alias("ord"), F.array_distinct(X.retrieval_tokens(F.col("text"))).alias("tokens"),
        F.length("text").cast("long").alias("chars"), (F.col("n_chars") % 37 / 10.0).alias("relevance"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("locked"), support.cast(L.SUPPORT).alias("support"),
    )


def _budget(spark: SparkSession, groups: DataFrame) -> DataFrame:
    needs = groups.select("question").distinct().withColumn("s", F.explode(F.array(*(F.struct(F.lit(slot).alias("slot"), F.lit(parent).alias("parent"), F.lit(n).alias("need"), F.lit(2).alias("sources"), F.lit(p).alias("periods")) for slot, parent, n, p in (("long", "size", 2, 2), ("short", "size", 1, 2), ("good", "worth", 3, 1))))))
    return L.budgets(needs.select("question", "s.*"), groups.select("question").distinct(), 4, 12, 18_000)


@query("coverage_rounds")
def coverage_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each question that covers its requirements, chosen among all documents. Greedy, so not in SQL."""
    groups = _groups(spark, sf_dir)
    return L.select_covering(groups, _budget(spark, groups))


@query("assembly_rounds")
def assembly_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each question from all documents, best first, by papers, likeness and budgets. Greedy, so not in SQL."""
    groups = _groups(spark, sf_dir)
    members = groups.select("question", "grp", "record", F.col("ord").alias("chunk"), F.lit(0).alias("seq"), "ord", F.lit(False).alias("structured"), "tokens", F.col("chars").cast("int").alias("chars"))
    return L.assemble(members, L.per_paper(members, 2, 8), 0.5, 12, 18_000)
