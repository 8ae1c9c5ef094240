"""Queries of records, scopes, harvest, facets, claims, trees and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import text as X
from scrivener.operators import citations as C
from scrivener.operators import library as L
from scrivener.operators import records as R
from scrivener.registry import query
from scrivener.session import table


@query("capability_filter", "SELECT doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE (l.doc_id IS NOT NULL) = true AND (n_chars >= 500) = true AND (lang = 'fr') = false")
def capability_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the capabilities that are asked for, and without those that are ruled out."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    return L.with_capabilities(docs, {"label": True, "long": True, "french": False, "any": None}, label=F.col("has"), long=F.col("n_chars") >= 500, french=F.col("lang") == "fr").select("doc_id")


@query("cleanup_confirmed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT conv_id FROM conversations)")
def cleanup_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a file, of those that a person confirmed."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    return L.cleanup(docs, "doc_id", F.col("has"), table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"))).select("doc_id")


@query("repair_candidates", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND o_totalprice > 100000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def repair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose status is stale by four signs."""
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_orderpriority <> '5-LOW' and o_totalprice > 100000").join(returned, "o_orderkey", "left_semi").select("o_orderkey")


@query("requirement_normalize", "SELECT p_partkey, CASE WHEN lower(p_brand) IN ('brand#1', 'brand#2', 'brand#3') THEN lower(p_brand) ELSE 'finding' END AS kind, greatest(1, least(4, CASE WHEN p_size % 7 = 0 THEN 2 ELSE p_size - 10 END))::INT AS direct, greatest(1, least(6, p_size))::INT AS slots FROM part")
def requirement_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements with their kind from a list and numbers within bounds."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", L.one_of(F.col("p_brand"), ["brand#1", "brand#2", "brand#3"], "finding").alias("kind"), L.clamped(F.when(size % 7 != 0, size - 10), 1, 4, 2).cast("int").alias("direct"), L.clamped(size, 1, 6, 1).cast("int").alias("slots"))


@query("slot_flatten", "SELECT l_partkey AS slot, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS requirement FROM lineitem GROUP BY l_partkey")
def slot_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of all requirements, each id once, from the first that names it."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("slot"), F.col("l_orderkey").alias("requirement"), F.col("l_linenumber").alias("n"))
    return R.first_by(rows, ["slot"], F.struct("requirement", "n")).select("slot", "requirement")


@query("section_aliases", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'method' END, CASE WHEN p_size % 3 = 0 THEN 'result' END], lambda x: x IS NOT NULL), ',') AS kinds FROM part")
def section_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section kinds by their aliases, each once, in order."""
    size = F.col("p_size")
    given = F.array(F.when(size % 2 == 0, " Methodology "), F.when(size % 3 == 0, "findings"), F.when(size % 2 == 0, "METHOD"), F.lit("nothing"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(L.aliased(given, {"method": "method", "methodology": "method", "findings": "result", "result": "result"}), ",").alias("kinds"))


@query(
    "facet_binding",
    """WITH f AS (SELECT DISTINCT l_orderkey AS facet, l_partkey AS id, p_size > 40 AS ok FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT facet, count(*) FILTER (ok)::INT AS valid, count(*) FILTER (NOT ok)::INT AS invalid, CASE WHEN bool_or(ok) THEN 'required' ELSE 'exploratory' END AS role FROM f GROUP BY facet""",
)
def facet_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets bound to the requirements that exist."""
    facets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("facet")).agg(F.collect_list("l_partkey").alias("ids"))
    known = table(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_partkey").alias("id"))
    return L.bound(facets, "facet", "ids", known, "id").select("facet", F.size("valid").alias("valid"), F.size("invalid").alias("invalid"), "role")


@query("relation_scan", "SELECT l_partkey AS source, l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey = 7 ORDER BY l_partkey, l_orderkey * 10 + l_linenumber LIMIT 5000")
def relation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by the filters that are set."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("target"))
    for name, value in {"kind": "A", "target": 7, "source": ""}.items():
        rows = rows.filter(F.col(name) == value) if value != "" else rows
    return rows.orderBy("source", "id").limit(5000).select("source", "id")


@query("cards_with_claims", "SELECT o_orderkey, count(l_linenumber) AS claims, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS listed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'N' WHERE o_orderstatus = 'O' GROUP BY o_orderkey")
def cards_with_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of a status with their claims nested: one join instead of a fetch per card."""
    claims = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("c"))
    cards = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey").join(claims, "o_orderkey", "left")
    return cards.select("o_orderkey", F.coalesce(F.size("c"), F.lit(0)).cast("long").alias("claims"), F.coalesce(F.array_join(F.col("c").cast("array<string>"), ","), F.lit("")).alias("listed")).withColumn("claims", F.when(F.col("claims") < 0, 0).otherwise(F.col("claims")))


@query("conversation_upsert", "SELECT conv_id, coalesce(nullif(max(CASE WHEN conv_id % 2 = 0 THEN 'kept' ELSE '' END), ''), arg_min(left(text, 20), turn)) AS title, count(*) AS messages FROM conversations GROUP BY conv_id")
def conversation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations after new messages: a title that is set stays, else the first message gives one."""
    turns = table(spark, sf_dir, "conversations")
    old = turns.select("conv_id").distinct().withColumn("title", F.when(F.col("conv_id") % 2 == 0, "kept").otherwise(""))
    new = turns.groupBy("conv_id").agg(F.min_by(F.substring("text", 1, 20), "turn").alias("new"), F.count("*").alias("messages"))
    return old.join(new, "conv_id", "full").select("conv_id", F.when(F.coalesce("title", F.lit("")) == "", F.col("new")).otherwise(F.col("title")).alias("title"), "messages")


@query("memory_normalize", "SELECT p_partkey, CASE WHEN lower(p_brand) IN ('brand#1', 'brand#5') THEN lower(p_brand) ELSE 'note' END AS kind, round(greatest(0, least(1, p_size / 40.0)), 4)::DOUBLE AS confidence, left(trim(p_name), 8) AS text, least(8, p_size)::INT AS tags FROM part")
def memory_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories as they are stored: kinds of a list, confidences and sizes within bounds."""
    tags = F.slice(F.sequence(F.lit(1), F.col("p_size").cast("int")), 1, 8)
    return table(spark, sf_dir, "part").select("p_partkey", L.one_of(F.col("p_brand"), ["brand#1", "brand#5"], "note").alias("kind"), X.clamp_confidence((F.col("p_size") / 40.0).cast("string")).alias("confidence"), F.substring(F.trim("p_name"), 1, 8).alias("text"), F.size(tags).alias("tags"))


@query("evidence_locators", "SELECT l_orderkey AS evidence_id, o_custkey AS document, count(DISTINCT l_partkey)::INT AS relations, max(l_quantity) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def evidence_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with its document and the relations that rest on it."""
    relations = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("score")).agg(F.collect_set("l_orderkey").alias("evidence_ids")).withColumn("claim", F.col("id").cast("string"))
    evidence = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("document"))
    return L.locators(relations, evidence).select("evidence_id", "document", F.size("relations").alias("relations"), "score")


@query(
    "citation_documents",
    r"""WITH d AS (SELECT item_id AS document, left(text, 30) AS title, '10.1/' || item_id AS doi, ' ' || trim(regexp_replace(lower(left(text, 30)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS p FROM benchmark),
c AS (SELECT doc_id AS citation, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t, CASE WHEN doc_id % 50 = 0 THEN '10.1/' || doc_id % 40 ELSE '' END AS doi FROM documents),
h AS (SELECT citation, min(document) AS a FROM c JOIN d ON contains(t, p) AND length(trim(p)) >= 12 GROUP BY citation), e AS (SELECT citation, min(document) AS b FROM c JOIN d USING (doi) GROUP BY citation)
SELECT citation, coalesce(a, b) AS document FROM c LEFT JOIN h USING (citation) LEFT JOIN e USING (citation)""",
)
def citation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local document that each citation names by title, else by DOI."""
    docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("document"), F.substring("text", 1, 30).alias("title"), F.concat(F.lit("10.1/"), F.col("item_id").cast("string")).alias("doi"))
    doi = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("10.1/"), (F.col("doc_id") % 40).cast("string"))).otherwise("")
    return L.local_document(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("citation"), "text", doi.alias("doi")), docs)


@query("topic_documents", "SELECT DISTINCT r_regionkey AS topic, p_partkey AS document FROM region, part WHERE list_has_any(string_split(lower(p_name), ' '), [CASE r_regionkey % 3 WHEN 0 THEN 'bolt' WHEN 1 THEN 'red' ELSE 'gear' END, lower(r_name)])")
def topic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a token with each topic."""
    key = F.col("r_regionkey")
    topics = table(spark, sf_dir, "region").select(key.alias("topic"), F.array(F.when(key % 3 == 0, "bolt").when(key % 3 == 1, "red").otherwise("gear"), F.lower("r_name")).alias("tokens"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document"), F.split(F.lower("p_name"), " ").alias("tokens"))
    return L.sharing_token(topics, docs, "topic", "document", "tokens")


@query("relation_denormalize", "SELECT l_orderkey, l_linenumber, coalesce(p_name, 'unknown') AS source_name, coalesce(s_name, 'unknown') AS target_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey")
def relation_denormalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with the names of both ends, a default where one is gone."""
    parts = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(parts, "l_partkey", "left").join(suppliers, "l_suppkey", "left")
    return out.select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("unknown")).alias("source_name"), F.coalesce("s_name", F.lit("unknown")).alias("target_name"))


@query("domains_through_topics", "SELECT DISTINCT c_mktsegment AS domain, l_suppkey AS document FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def domains_through_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains and documents that share a topic."""
    topics = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey")
    left = topics.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("domain")), "o_custkey").select("o_orderkey", "domain")
    return left.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("document")).distinct(), "o_orderkey").select("domain", "document").distinct()


@query("evidence_availability", "SELECT d.source, count(*) AS selected, count(l.doc_id) AS known, count(*) FILTER (l.doc_id IS NOT NULL AND n_chars >= 800) AS full_text FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def evidence_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the selected evidence is known, and known in full text."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("selected"), F.count("known").alias("known"), F.count_if(F.col("known") & (F.col("n_chars") >= 800)).alias("full_text"))


@query("parser_results", "SELECT d.doc_id, coalesce(a.result, b.result) AS result FROM documents d LEFT JOIN (SELECT doc_id AS k, min(quality) AS result FROM labels WHERE doc_id % 2 = 0 GROUP BY 1) a ON a.k = d.doc_id LEFT JOIN (SELECT source, min(quality) AS result FROM labels JOIN documents USING (doc_id) GROUP BY source) b ON b.source = d.source")
def parser_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results joined by key, else by name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    found = table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("doc_id"), "source", F.col("quality").alias("result"))
    return L.matched_or_named(found, docs, "doc_id", "source").select("doc_id", "result")


@query("sync_decisions", "SELECT d.doc_id, CASE WHEN d.lang = 'de' THEN 'unavailable' WHEN l.doc_id IS NOT NULL AND l.quality = 1 AND l.toxic = 0 THEN 'unchanged' WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 'metadata_updated' ELSE 'parse' END AS decision FROM documents d LEFT JOIN labels l USING (doc_id)")
def sync_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental sync does with each item."""
    docs = table(spark, sf_dir, "documents")
    items = docs.select("doc_id", (F.col("lang") != "de").alias("has_file"), F.lit(1).alias("hash"), F.lit(0).alias("version"))
    return L.sync_decision(items, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("hash"), F.col("toxic").alias("version")), "doc_id")


@query("scope_snapshot", "SELECT c_custkey AS item, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), 'unfiled') AS collections FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def scope_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items once, with all their collections."""
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("collection"))
    return L.scoped(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item")), members, "item", "collection").select("item", F.array_join("collections", ",").alias("collections"))


HARVEST_SQL = """WITH f AS (SELECT source, sha256(text) AS key, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, lang = 'en' AS has_file FROM documents WHERE source IN ('src0', 'src1', 'src2')),
k AS (SELECT sha256(text) AS key FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
r AS (SELECT *, CASE WHEN has_file THEN ceil(rank / 8)::INT ELSE 5 END AS round FROM f WHERE rank <= 40 AND key NOT IN (SELECT key FROM k)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round, source, rank) AS n FROM r) WHERE n = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round, has_file DESC, rank) AS nth FROM o)
SELECT source, key, round, nth::INT AS nth FROM t WHERE nth <= 8"""


@query("harvest_rounds", HARVEST_SQL)
def harvest_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a harvest of three sources in five rounds saves."""
    docs = table(spark, sf_dir, "documents").filter(F.col("source").isin("src0", "src1", "src2"))
    from pyspark.sql import Window

    found = docs.select("source", F.sha2("text", 256).alias("key"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"), (F.col("lang") == "en").alias("has_file"))
    known = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").select(F.sha2("text", 256).alias("key"))
    return L.harvest(found, known, {"src0": 8, "src1": 8, "src2": 8})


@query("import_precedence", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_name END), ''), p_type) AS title, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, 'none') AS venue FROM part")
def import_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a person gives before those that were parsed."""
    given = X.blank_to_null(F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(given, "p_type").alias("title"), F.coalesce(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.lit("none")).alias("venue"))


@query("type_histogram", "SELECT label, sum(n)::BIGINT AS after, count(*) AS before FROM (SELECT lower(split_part(p_type, ' ', 1)) AS label, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY label")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types after normalisation, and how many spellings each had."""
    rows = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return rows.groupBy(X.type_label(F.substring_index("p_type", " ", 1)).alias("label")).agg(F.sum("n").alias("after"), F.count("*").alias("before"))


@query("facet_canonical", "SELECT o_custkey AS record, facet, string_agg(v, ',' ORDER BY o) AS values FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'method' WHEN 'O' THEN 'method' ELSE 'other' END AS facet, o_orderpriority AS v, min(o_orderkey) AS o FROM orders GROUP BY ALL) GROUP BY ALL")
def facet_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets under canonical names, values once and in order."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderstatus").alias("facet"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("ord"))
    return L.canonical_facets(rows, {"f": "method", "o": "method"}).select("record", "facet", F.array_join("values", ",").alias("values"))


@query("vocabulary_normalize", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_name ILIKE 'red %' THEN 'crimson' ELSE replace(lower(p_name), ' ', '_') END AS canonical, CASE WHEN p_size % 5 = 0 THEN 0.0::DOUBLE WHEN p_name ILIKE 'red %' THEN 1.0 ELSE 0.8 END AS confidence FROM part")
def vocabulary_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by an alias table, else by their lexical key."""
    labels = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, " - ").otherwise(F.col("p_name")).alias("label"))
    aliases = table(spark, sf_dir, "part").filter(F.col("p_name").ilike("red %")).select(F.upper("p_name").alias("alias"), F.lit("crimson").alias("canonical")).distinct()
    return L.vocabulary(labels, aliases, "label").select("p_partkey", "canonical", "confidence")


@query("claim_acceptance", "SELECT conv_id * 1000 + turn AS claim, 2 AS quotes, (1 + (turn % 2 = 0)::INT)::BIGINT AS verified, role = 'user' AS accepted FROM conversations WHERE length(trim(text)) >= 30")
def claim_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with all their parts and a quote that stands in its chunk."""
    turns = table(spark, sf_dir, "conversations")
    quote = lambda q: F.struct(F.col("turn").alias("chunk"), q.alias("quote"))
    claims = turns.filter("length(trim(text)) >= 30").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("claim"), F.col("conv_id").alias("record"), F.lit("s").alias("subject"), F.when(F.col("role") == "user", "p").alias("predicate"), F.lit("o").alias("object"),
        F.array(quote(F.substring("text", 3, 10)), quote(F.when(F.col("turn") % 2 == 0, F.substring("text", 5, 9)).otherwise("not there!"))).alias("quotes"),
    )
    return L.accepted_claims(claims, turns.select(F.col("conv_id").alias("record"), F.col("turn").alias("chunk"), "text"))


@query("tree_stable_ids", "SELECT c_custkey, left(sha256('p' || chr(0) || c_nationkey || chr(0) || lower(c_mktsegment) || chr(0) || (row_number() OVER (PARTITION BY c_nationkey, lower(c_mktsegment) ORDER BY c_custkey) - 1)), 20) AS stable_id FROM customer")
def tree_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of tree nodes that don't change with their order elsewhere."""
    return L.tree_ids(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", "c_mktsegment", "c_custkey", "p").select("c_custkey", "stable_id")


@query(
    "heading_limits",
    """WITH t AS (SELECT r_regionkey AS node, r_name AS label, row_number() OVER (ORDER BY r_name, r_regionkey) AS i FROM region ORDER BY i LIMIT 3),
k AS (SELECT n_nationkey AS node, n_regionkey AS up, n_name AS label, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, n_nationkey) AS j FROM nation)
SELECT 'r' || node AS node, i::VARCHAR AS number, label FROM t UNION ALL SELECT 'n' || k.node, i || '.' || j, k.label FROM k JOIN t ON t.node = k.up WHERE j <= 2""",
)
def heading_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three primary headings with their first two children, numbered anew."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.col("n_name"))
    return L.limited_headings(region.union(nation).withColumn("ord", F.col("label")), "parent", "label", "ord", 3, 2)


@query("type_mapping_problems", "SELECT DISTINCT p_type AS type, 'missing' AS problem FROM part WHERE p_size > 48 AND p_type NOT IN (SELECT p_type FROM part WHERE p_size <= 5) UNION ALL SELECT DISTINCT p_type, 'invented' FROM part WHERE p_size <= 5 AND p_type NOT IN (SELECT p_type FROM part WHERE p_size > 48) UNION ALL SELECT p_type, 'twice' FROM part WHERE p_size <= 5 GROUP BY p_type HAVING count(DISTINCT p_brand) > 1")
def type_mapping_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a proposed mapping of types from being a partition of them."""
    part = table(spark, sf_dir, "part")
    return L.mapped_types(part.filter("p_size > 48").select(F.col("p_type").alias("type")), part.filter("p_size <= 5").select(F.col("p_type").alias("type"), F.col("p_brand").alias("canonical")))


@query("phrases_of_titles", "SELECT phrase, count(*) AS n FROM (SELECT unnest([p_name, p_type || ' of ' || p_brand]) AS phrase FROM part) GROUP BY phrase")
def phrases_of_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate phrases of all titles."""
    text = F.concat("p_name", F.lit("; the of, "), "p_type", F.lit(" of "), "p_brand", F.lit(": "))
    rows = table(spark, sf_dir, "part").select(F.explode(L.candidate_phrases(text, ["the", "of", "a"])).alias("phrase"))
    return rows.filter(~F.col("phrase").rlike(r"^[A-Z][A-Z0-9]{1,9}$")).groupBy("phrase").agg(F.count("*").alias("n"))


@query("answer_grounding", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '1,3' ELSE '' END AS cited, CASE WHEN p_size % 2 = 0 THEN '9' ELSE '' END AS invalid, 1 + (p_size % 3 = 0)::INT AS uncited, CASE WHEN p_size % 2 = 0 THEN 'invalid_citation,uncited_claim' ELSE 'no_citation,uncited_claim' END AS reasons FROM part")
def answer_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against answers: citations that are missing or wrong, strong claims without one."""
    size = F.col("p_size")
    answer = F.concat("p_name", F.when(size % 2 == 0, " is so [1, 3]. It is the best [9]. ").otherwise(" is so. "), F.lit("This always holds. "), F.when(size % 3 == 0, "It never fails.").otherwise("Fine."))
    rows = table(spark, sf_dir, "part").select("p_partkey", answer.alias("answer"), F.lit(4).alias("sources"))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return L.grounding(rows, "p_partkey", "answer", "sources").select("p_partkey", join("cited"), join("invalid"), "uncited", join("reasons"))


@query("adjacent_blocks", "SELECT conv_id, block::BIGINT AS block, role, count(*)::INT AS blocks, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w = role THEN 0 ELSE 1 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))) GROUP BY ALL")
def adjacent_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of one role as one block."""
    rows = table(spark, sf_dir, "conversations").withColumn("summary", F.col("role"))
    return L.adjacent_blocks(rows, "conv_id", "turn", ["role"], "text", "summary").select("conv_id", "block", "role", "blocks", "text")


@query("repeated_headings", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'body of ' || p_type ELSE p_type || chr(10) || 'body' END AS content, p_brand || CASE WHEN p_size % 4 > 1 THEN ' - Part 2/' || p_size % 4 ELSE '' END AS summary FROM part")
def repeated_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents without a first line that repeats their heading, summaries with their part."""
    content = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("## 2.1 "), F.upper("p_name"), F.lit("\n\nbody of "), "p_type")).otherwise(F.concat("p_type", F.lit("\nbody")))
    path = F.concat(F.lit("Top > "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", L.without_repeated_heading(content, path).alias("content"), L.part_summary(F.col("p_brand"), F.lit(2), F.col("p_size") % 4).alias("summary"))


@query(
    "document_versions",
    """SELECT conv_id, sha256(concat_ws(chr(30), concat_ws(chr(31), coalesce(min(role), ''), count(*)::VARCHAR), string_agg(concat_ws(chr(31), turn::VARCHAR, sha256(text)), chr(30) ORDER BY turn))) AS version FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""",
)
def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each document's fields and chunks."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    docs = turns.groupBy("conv_id").agg(F.min("role").alias("first_role"), F.count("*").alias("turns"))
    return L.document_version(docs, turns.select("conv_id", "turn", F.col("text").alias("content")), "conv_id", ["turns", "first_role"], ["turn"])


@query("bind_citations", "SELECT claim_id, string_agg(DISTINCT id, ',' ORDER BY id) AS citation_ids FROM (SELECT conv_id * 100 + turn AS claim_id, conv_id || ':' || n AS id FROM conversations, (VALUES (1), (2), (3), (4), (5)) AS v(n) WHERE text IS NOT NULL AND (n = turn % 5 + 1 OR abs(turn - n * 3) <= 2 OR n = 5)) GROUP BY claim_id")
def bind_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims bound to citations by number, by nearness of lines, or by year and surname."""
    from scrivener.operators import graphs as G

    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    quote = F.concat("text", F.lit(" ["), (F.col("turn") % 5 + 1).cast("string"), F.lit("] as in Miller 1995"))
    claims = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("claim_id"), F.col("conv_id").alias("document"), F.col("turn").alias("line"), F.concat(F.regexp_replace(quote, r"\d{4}(?!$)|\[(?!\d\] as)", ""), F.lit("")).alias("quote"))
    numbers = turns.select(F.col("conv_id").alias("document")).distinct().withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(5))))
    contexts = numbers.withColumn("line", F.col("number") * 3)
    citations = numbers.select(F.concat_ws(":", F.col("document").cast("string"), F.col("number").cast("string")).alias("id"), "document", "number", F.when(F.col("number") == 5, 1995).otherwise(1800).alias("year"), F.array(F.lit("miller")).alias("surnames"))
    return G.bind_citations(claims, contexts, citations, 2).select("claim_id", F.array_join("citation_ids", ",").alias("citation_ids"))


def _cited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines cite by number and by name, with three references: one to another document, by its first line."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    title = F.regexp_replace(F.substring(F.substring_index("text", "\n", 1), 1, 60), r"\s+", " ")
    named = docs.select("doc_id", "lang", "source", title.alias("title"), "text")
    one = named.groupBy("lang", "source").agg(F.min_by("title", "doc_id").alias("cited_title"))
    body = F.regexp_replace("text", r"[.]\n", " [2, 4-5], as Lee et al. (2001) say [1].\n## Part\n")
    refs = F.concat(F.lit("[1] Miller, J. 1999. "), "cited_title", F.lit(". In Proceedings\n[2] Lee, Ann: A study of "), "source", F.lit(" things 2001. doi:10.1/x"), F.lit("\n[3]  Third 2010. doi:10.1000/no."), "source")
    return named.join(F.broadcast(one), ["lang", "source"]).select("doc_id", "title", "cited_title", body.alias("body"), refs.alias("refs"))


@query("document_citations")
def document_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of documents, what they are, and how often the text cites them; read from whole texts."""
    docs = _cited_documents(spark, sf_dir)
    library = docs.select(F.col("doc_id").alias("record"), "title", F.lit("").alias("doi"), F.lit(None).cast("int").alias("year"), F.array().cast("array<string>").alias("authors"))
    return C.citations_of(docs, library, "doc_id", "body", "refs").select("doc_id", "number", "title", "authors", "year", "doi", "document", "source", "quality", "contexts", "cited")


@query(
    "bound_claims",
    r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') AS text FROM conversations WHERE text IS NOT NULL), q AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS w FROM t),
n AS (SELECT conv_id, turn AS number, list_distinct(w) AS cw, turn * 3 + 1 AS ctx FROM q)
SELECT DISTINCT q.conv_id * 100 + q.turn AS claim, q.conv_id || ':' || n.number AS citation FROM q JOIN n ON n.conv_id = q.conv_id AND abs(q.turn + 1 - ctx) <= 4 WHERE len(w) >= 6 AND len(list_filter(w, lambda x: list_contains(cw, x))) / len(w) >= 0.72
UNION SELECT conv_id * 100 + turn, conv_id || ':' || (turn % 3) FROM t WHERE trim(text) <> '' AND turn % 3 IN (SELECT turn FROM t u WHERE u.conv_id = t.conv_id)""",
)
def bound_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as claims that cite a number; turns as contexts of citations, three lines apart."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    plain = turns.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    claims = plain.select((F.col("conv_id") * 100 + F.col("turn")).alias("claim"), F.col("conv_id").alias("document"), (F.col("turn") + 1).cast("int").alias("line"), "text", "turn")
    marked = claims.select(F.col("claim"), "document", F.lit(None).cast("int").alias("line"), F.format_string("[%s]", (F.col("turn") % 3).cast("string")).alias("quote"))
    both = claims.select("claim", "document", "line", F.col("text").alias("quote")).unionByName(marked)
    contexts = turns.select(F.col("conv_id").alias("document"), F.col("turn").cast("int").alias("number"), (F.col("turn") * 3 + 1).cast("int").alias("line"), F.col("text").alias("quote"))
    citations = turns.select(F.format_string("%s:%s", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("citation"), F.col("conv_id").alias("document"), F.col("turn").cast("int").alias("number"), F.lit(None).cast("int").alias("year"), F.array().cast("array<string>").alias("author_keys"))
    return C.bound(both, contexts, citations)
