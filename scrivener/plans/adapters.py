"""Queries of the adapters: evidence of papers, contracts, documents of a tree, sources of tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.operators import adapters as A
from scrivener.registry import query
from scrivener.session import table


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as papers with split chunks, benchmark items as papers in Markdown."""
    turns = table(spark, sf_dir, "conversations")
    record = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    kind = F.when(F.col("role") == "system", "Caption").when(F.col("role") == "user", "formula").otherwise("prose")
    chunks = turns.select(record.alias("record"), F.col("turn").alias("chunk"), F.col("text").alias("content"), F.array("role", F.lit(" "), F.lit("part")).alias("headings"), kind.alias("kind"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("record"), F.concat(F.lit("# Item\n"), "text", F.lit("\n\n## Other one\nend")).alias("markdown"))
    papers = turns.select(record.alias("record")).distinct().withColumn("markdown", F.lit("# unused\ntext")).union(items)
    return A.evidence_chunks(papers, chunks)


EVIDENCE_SQL = """SELECT 'c' || conv_id AS record, turn::INT AS chunk, role || ' > part' AS section, trim(text) AS text, CASE role WHEN 'system' THEN 'figure_caption' WHEN 'user' THEN 'equation' ELSE 'paper_text' END AS origin, 1.0::DOUBLE AS confidence FROM conversations WHERE trim(text) <> ''
UNION ALL SELECT 'b' || item_id, 0, 'Item', trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'paper_text', 1.0 FROM benchmark
UNION ALL SELECT 'b' || item_id, 1, 'Other one', 'end', 'paper_text', 1.0 FROM benchmark"""


@query("evidence_chunks", EVIDENCE_SQL)
def evidence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of papers: their split chunks, else the sections of their Markdown."""
    return _evidence(spark, sf_dir)


@query(
    "gated_evidence",
    f"SELECT record, record || ':' || chunk AS ref, left(section, 10) AS section, left(text, 300) AS text, origin, 1.0::DOUBLE AS confidence FROM ({EVIDENCE_SQL}) WHERE origin IN ('paper_text', 'equation') AND length(section) <> 10",
)
def gated_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of allowed origins and of the papers' own, cut to what an extractor may see."""
    rows = _evidence(spark, sf_dir).withColumn("own", F.when(F.length("section") == 10, "another").otherwise(F.col("record")))
    return A.gated(rows, F.col("own"), ("paper_text", "equation"), 10, 300)


@query("paper_sections", "SELECT conv_id, turn, role, left(text, 40) AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3")
def paper_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three chunks of each paper, with the beginning of their texts."""
    return A.paper_sections(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 3, 40)


@query("materialized_chunks", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chunk, coalesce(CASE WHEN length(text) > 200 THEN role END, title) AS title, turns, text FROM conversations JOIN (SELECT conv_id, 'of ' || min(role) AS title, count(*) AS turns FROM conversations GROUP BY conv_id) USING (conv_id)")
def materialized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the metadata of their papers, their own where they have some."""
    turns = table(spark, sf_dir, "conversations")
    base = turns.groupBy("conv_id").agg(F.concat(F.lit("of "), F.min("role")).alias("title"), F.count("*").alias("turns"))
    return A.materialized(base, turns.select("conv_id", "turn", F.when(F.length("text") > 200, F.col("role")).alias("title"), "text"), "conv_id", "turn", ["title"], ["turns"])


@query(
    "delimited_values",
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\s*(?:,|;|，|；|、)\s*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS v FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(v)::INT AS parts, len(list_distinct(v))::INT AS different FROM p""",
)
def delimited_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of texts at commas and semicolons, and how many of them differ."""
    parts = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", A.split_values(F.col("text")).alias("v"))
    return parts.select("doc_id", F.size("v").alias("parts"), F.size(A.unique_trimmed(F.col("v"))).alias("different"))


@query(
    "plan_contracts",
    """WITH e AS (SELECT event_id, event_type, (props->>'$.k')::INT AS k FROM events), p AS (SELECT event_id, k > 90 AS said, CASE event_type WHEN 'error' THEN 'mechanism' ELSE event_type END AS kind, k // 20 AS facets, k % 3 AS needs FROM e)
SELECT event_id, CASE WHEN said OR kind = 'mechanism' OR facets > 1 OR needs > 1 THEN 'complex' ELSE 'simple' END AS complexity, needs > 0 OR kind = 'mechanism' OR facets > 1 AS validated FROM p""",
)
def plan_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which plans are complex, and which answers have to be held against their contract."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "error", "mechanism").otherwise(F.col("event_type"))
    facets, needs = F.floor(k / 20).cast("int"), k % 3
    return table(spark, sf_dir, "events").select("event_id", A.complexity(F.when(k > 90, " Complex").otherwise("simple"), kind, facets, needs).alias("complexity"), A.requires_validation(kind, facets, needs).alias("validated"))


@query(
    "graph_query_texts",
    r"""WITH v AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, [regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g'), lang, source, 'the ' || source] AS t FROM documents WHERE text IS NOT NULL)),
d AS (SELECT doc_id, x, min(i) AS i FROM v WHERE x <> '' GROUP BY doc_id, x) SELECT doc_id, list(x ORDER BY i) AS texts FROM d GROUP BY doc_id""",
)
def graph_query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that a graph is searched for: the question, then what its facets name, each once."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    facet = F.struct(F.col("lang").alias("goal"), F.concat(F.lit(" "), "source").alias("query"), F.array("lang", F.lit(" ")).alias("concepts"), F.array(F.concat(F.lit("the "), "source"), F.lit(None).cast("string")).alias("phrases"))
    return docs.select("doc_id", A.query_texts(F.substring_index("text", "\n", 1), F.array(facet, facet)).alias("texts"))


@query("entity_search_texts", "SELECT 'p' || p_partkey AS id, p_name || ' part ' || p_brand || ' ' || lower(p_brand) || ' size ' || p_size AS text FROM part UNION ALL SELECT 'l' || l_suppkey || '-' || l_partkey, s_name || ' supplies ' || p_name FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey")
def entity_search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entities and relations are found by."""
    part = table(spark, sf_dir, "part")
    attributes = F.array(F.struct(F.lit("size").alias("name"), F.col("p_size").cast("string").alias("value")))
    entities = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), A.entity_text(F.col("p_name"), F.lit("part"), F.array(F.col("p_brand"), F.lower("p_brand")), attributes).alias("text"))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    named = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    claims = named.select(F.concat(F.lit("l"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")), A.relation_claim(F.col("s_name"), F.lit(" supplies "), F.col("p_name")))
    return entities.union(claims)


@query(
    "tree_documents",
    r"""WITH m AS (SELECT doc_id AS record, lang, source, n_chars, '# ' || source || chr(10) || text || chr(10) || '#  ' || upper(source) || chr(10) || '## End  of it' || chr(10) || 'Keywords: ' || lang || ', ' || source || ' | x' AS md FROM documents WHERE text IS NOT NULL),
l AS (SELECT record, unnest(w) AS line, generate_subscripts(w, 1) AS i FROM (SELECT record, regexp_split_to_array(md, '\r?\n') AS w FROM m)),
h AS (SELECT record, length(regexp_extract(trim(line), '^(#+)', 1))::INT AS level, regexp_replace(regexp_extract(trim(line), '^#+\s+(.*)$', 1), '\s+', ' ', 'g') AS title, i FROM l WHERE regexp_matches(trim(line), '^#{1,6}\s+\S')),
d AS (SELECT record, level, arg_min(title, i) AS title, min(i) AS i FROM h GROUP BY record, level, lower(title)),
s AS (SELECT record, list({'level': level, 'title': title} ORDER BY i) AS headings FROM d GROUP BY record)
SELECT record, CASE WHEN n_chars > 500 THEN 'Long ' || lang ELSE source END AS title, CASE WHEN n_chars > 500 THEN 'About ' || source ELSE '' END AS abstract,
 CASE WHEN n_chars > 2000 THEN ['own', lang] WHEN n_chars > 1000 THEN ['a', 'b c'] WHEN regexp_matches(md, '(?im)^keywords?\s*:\s*.+$') THEN list_filter(list_transform(regexp_split_to_array(regexp_extract(md, '(?im)^keywords?\s*:\s*(.+)$', 1), '[;；,，|]'), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS keywords, headings
FROM m JOIN s USING (record)""",
)
def tree_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for a tree: titles, abstracts, keywords and headings, from records and their Markdown."""
    docs = table(spark, sf_dir, "documents")
    long_, listed = F.when(F.col("n_chars") > 500, F.concat(F.lit("Long "), "lang")), F.when(F.col("n_chars") > 2000, F.array(F.lit(" own"), F.col("lang"), F.lit(" ")))
    told = F.when((F.col("n_chars") > 1000) & (F.col("n_chars") <= 2000), "a; b c ;")
    with_list = F.to_json(F.struct(long_.alias("title"), F.concat(F.lit("About "), "source", F.lit(" ")).alias("abstract"), listed.alias("keywords")))
    with_text = F.to_json(F.struct(long_.alias("title"), F.concat(F.lit("About "), "source").alias("abstract"), told.alias("keywords")))
    papers = docs.select(F.col("doc_id").alias("record"), F.col("source").alias("title"), F.when(F.col("n_chars") > 2000, with_list).when(F.col("n_chars") > 500, with_text).otherwise("broken").alias("metadata"))
    markdown = F.concat(F.lit("# "), "source", F.lit("\n"), "text", F.lit("\n#  "), F.upper("source"), F.lit("\n## End  of it\nKeywords: "), "lang", F.lit(", "), "source", F.lit(" | x"))
    return A.tree_documents(papers, docs.select(F.col("doc_id").alias("record")), docs.select(F.col("doc_id").alias("record"), markdown.alias("markdown")))


@query(
    "resumable_builds",
    """WITH o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity < 30), n AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_discount < 0.05)
SELECT coalesce(o.l_orderkey, n.l_orderkey) AS l_orderkey, count(*) FILTER (n.l_suppkey IS NULL) AS lost, count(*) FILTER (o.l_suppkey IS NULL) AS added, count(*) FILTER (n.l_suppkey IS NULL OR o.l_suppkey IS NULL) = 0 AS resumable FROM o FULL JOIN n ON o.l_orderkey = n.l_orderkey AND o.l_suppkey = n.l_suppkey GROUP BY 1""",
)
def resumable_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds whose members are still those of their snapshot."""
    lines = table(spark, sf_dir, "lineitem")
    return A.resumable(lines.filter("l_quantity < 30"), lines.filter("l_discount < 0.05"), "l_orderkey", "l_suppkey")


@query(
    "tool_sources",
    """WITH k AS (SELECT user_id, event_type AS record, 0 AS chunk, '' AS title, min(event_id) AS first, arg_max(excerpt, (length(excerpt), -event_id)) AS excerpt FROM (SELECT *, left(value::VARCHAR, 4) AS excerpt FROM events) GROUP BY ALL)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first)::INT AS index, record, chunk, title, excerpt FROM k""",
)
def tool_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that tools have named, once each, with the longest excerpt."""
    events = table(spark, sf_dir, "events")
    results = events.select("user_id", "event_id", F.col("event_type").alias("record"), F.lit(None).cast("int").alias("chunk"), F.lit(None).cast("string").alias("title"), F.substring(F.col("value").cast("string"), 1, 4).alias("excerpt"))
    return A.tool_sources(results, "user_id", "event_id")
