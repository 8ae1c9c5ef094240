"""Queries of stores and services' tables: caches, updates, revisions, views, lookups, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivener.functions import tables as T
from scrivener.functions import text as X
from scrivener.plans.topics import topic_phrase
from scrivener.registry import query
from scrivener.session import table


@query("vector_cache_hits", "SELECT p_partkey AS key, label FROM part JOIN embeddings ON vec_id = p_partkey WHERE p_size > 25")
def vector_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested vectors that the cache has, by one join instead of batches of keys."""
    wanted = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("key"))
    return wanted.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label"), "key")


@query("vector_cache_misses", "SELECT p_partkey AS key FROM part WHERE p_size > 25 AND p_partkey NOT IN (SELECT vec_id FROM embeddings)")
def vector_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested vectors that have to be made."""
    wanted = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("key")).distinct()
    return wanted.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key")), "key", "left_anti")


@query("index_sources", "SELECT doc_id, CASE WHEN n > 0 THEN 'chunks' WHEN trim(coalesce(text, '')) <> '' THEN 'markdown' ELSE 'abstract' END AS origin, CASE WHEN n > 0 THEN n ELSE 1 END AS pieces FROM (SELECT d.doc_id, d.text, (SELECT count(*) FROM conversations c WHERE c.conv_id = d.doc_id) AS n FROM documents d)")
def index_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each record is indexed from: saved chunks, else its text, else its abstract."""
    chunks = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(chunks, "doc_id", "left")
    origin = F.when(F.col("n") > 0, "chunks").when(F.trim(F.coalesce("text", F.lit(""))) != "", "markdown").otherwise("abstract")
    return rows.select("doc_id", origin.alias("origin"), F.coalesce("n", F.lit(1)).alias("pieces"))


@query("update_by_id", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, p_brand AS brand, CASE WHEN p_size % 3 = 0 THEN 'now' ELSE 'then' END AS updated FROM part")
def update_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after a shallow merge of updates: fields that an update names, and when."""
    part = table(spark, sf_dir, "part")
    updates = part.filter("p_size % 3 = 0").select("p_partkey", F.upper("p_name").alias("new_name"), F.lit(None).cast("string").alias("new_brand"), F.lit("now").alias("at"))
    return part.join(updates, "p_partkey", "left").select("p_partkey", F.coalesce("new_name", "p_name").alias("name"), F.coalesce("new_brand", "p_brand").alias("brand"), F.coalesce("at", F.lit("then")).alias("updated"))


@query("revision_conflicts", "SELECT o_custkey AS project, count(*) AS patches, count(*) FILTER (o_orderkey % 5 <> rev) AS conflicts FROM (SELECT *, o_custkey % 5 AS rev FROM orders) GROUP BY o_custkey")
def revision_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches per project, and those that were made against another revision than the stored one."""
    revisions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 5).alias("rev"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 5).alias("expected")).join(revisions, "o_custkey")
    return rows.groupBy(F.col("o_custkey").alias("project")).agg(F.count("*").alias("patches"), F.count_if(F.col("expected") != F.col("rev")).alias("conflicts"))


@query("deletion_impact", "SELECT p_partkey, count(l_orderkey) AS relations, count(DISTINCT l_suppkey) AS others FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_size > 45 GROUP BY p_partkey")
def deletion_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a deletion would take along, before it is done."""
    doomed = table(spark, sf_dir, "part").filter("p_size > 45").select("p_partkey")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_suppkey")
    return doomed.join(edges, "p_partkey", "left").groupBy("p_partkey").agg(F.count("l_orderkey").alias("relations"), F.countDistinct("l_suppkey").alias("others"))


@query("source_lookup", "SELECT min(s_suppkey) AS id, lower(trim(s_name)) AS scope FROM supplier WHERE lower(trim(s_name)) IN (SELECT lower(s_name) FROM supplier WHERE s_suppkey % 7 = 0) GROUP BY 2")
def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sources with exactly the scopes that are asked for."""
    suppliers = table(spark, sf_dir, "supplier")
    asked = suppliers.filter("s_suppkey % 7 = 0").select(F.lower(F.trim(F.concat(F.lit("  "), F.upper("s_name")))).alias("scope")).distinct()
    stored = suppliers.select("s_suppkey", F.lower(F.trim("s_name")).alias("scope"))
    return stored.join(asked, "scope", "left_semi").groupBy("scope").agg(F.min("s_suppkey").alias("id")).select("id", "scope")


@query("planner_views", "SELECT conv_id, coalesce(string_agg(left(text, 30), '|' ORDER BY turn) FILTER (role = 'user'), '') AS intents, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id")
def planner_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a planner sees them: what the user wants, and how many answers there were."""
    turns = table(spark, sf_dir, "conversations")
    asked = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", F.substring("text", 1, 30).alias("t")))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(asked, lambda x: x["t"]), "|").alias("intents"), F.count_if(F.col("role") == "assistant").alias("answers"))


@query("sync_metadata", "SELECT p_partkey, 'lib:item:1:' || p_partkey AS id, 'Ann ' || p_brand || '; Org' AS creators, (1990 + p_size)::INT AS year, sha256(p_name) AS file_hash FROM part")
def sync_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of synced items: id, creators, year and the file's hash."""
    person = lambda first, last: F.struct(first.alias("first"), last.alias("last"))
    creators = F.array(person(F.lit("Ann"), F.col("p_brand")), person(F.lit(None).cast("string"), F.lit("Org")))
    names = F.array_join(F.transform(creators, lambda c: F.concat_ws(" ", c["first"], c["last"])), "; ")
    year = X.parse_year(F.concat(F.lit("June "), (1990 + F.col("p_size")).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(":", F.lit("lib"), F.lit("item"), F.lit("1"), F.col("p_partkey").cast("string")).alias("id"), names.alias("creators"), year.alias("year"), F.sha2("p_name", 256).alias("file_hash"))


@query("existing_guard", "SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM labels) AS may_import FROM documents")
def existing_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each record may still be imported."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.col("known").isNull().alias("may_import"))


@query("latest_parse_task", "SELECT user_id AS parse_key, max(event_id) AS task FROM events WHERE event_type <> 'error' GROUP BY user_id")
def latest_parse_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest task of each key that didn't fail."""
    return table(spark, sf_dir, "events").filter("event_type <> 'error'").groupBy(F.col("user_id").alias("parse_key")).agg(F.max("event_id").alias("task"))


@query("tree_anchors", "SELECT node, place::BIGINT AS place FROM (SELECT 'r' || r_regionkey AS node, row_number() OVER (ORDER BY r_name, c) AS place FROM (SELECT r_regionkey, r_name, '' AS c FROM region UNION ALL SELECT NULL, r_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey)) WHERE node IS NOT NULL".replace("SELECT 'r' || r_regionkey AS node", "SELECT CASE WHEN c = '' THEN 'r:' || r_name ELSE 'n:' || c END AS node") + " AND place <= 20")
def tree_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first nodes of a tree, parents before their children, siblings by name."""
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name").join(region, "r_regionkey")
    nodes = region.select(F.concat(F.lit("r:"), "r_name").alias("node"), "r_name", F.lit("").alias("c")).unionByName(nation.select(F.concat(F.lit("n:"), "n_name").alias("node"), "r_name", F.col("n_name").alias("c")))
    first = nodes.orderBy("r_name", "c").limit(20)
    return first.withColumn("place", F.row_number().over(Window.orderBy("r_name", "c")).cast("long")).select("node", "place")  # the few that are left


@query("citations_per_document", "SELECT doc_id, 3 AS entries, (n * 2)::BIGINT AS cited FROM (SELECT doc_id, len(regexp_extract_all(text, '[.]\\n')) AS n FROM documents WHERE text IS NOT NULL)".replace("\\\\", "\\").replace("(n * 2)", "CASE WHEN n > 0 THEN 1 ELSE 0 END"))
def citations_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each document's reference list, and how many of them its body cites."""
    from scrivener.plans.functions import _cited

    body, refs = T.split_references(F.col("text"))
    docs = _cited(spark, sf_dir).filter("text is not null").select("doc_id", body.alias("body"), refs.alias("refs"))
    entries = T.reference_entries(docs, "doc_id", "refs").select("doc_id", "number")
    cited = T.citation_contexts(docs, "doc_id", "body").select("doc_id", "number").distinct().withColumn("hit", F.lit(1))
    return entries.join(cited, ["doc_id", "number"], "left").groupBy("doc_id").agg(F.count("*").cast("int").alias("entries"), F.count("hit").alias("cited"))


@query("evidence_budgets", "SELECT o_custkey AS question, greatest(4, least(24, sum(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END)))::BIGINT AS target, least(18000, 1500 * greatest(4, least(24, sum(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END))))::BIGINT AS chars FROM orders GROUP BY o_custkey")
def evidence_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much evidence each question may take, by what its requirements need."""
    needs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("question")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", 2).otherwise(1)).alias("need"))
    target = F.greatest(F.lit(4), F.least(F.lit(24), F.col("need"))).cast("long")
    return needs.select("question", target.alias("target"), F.least(F.lit(18000), 1500 * target).cast("long").alias("chars"))


@query(
    "heuristic_tree",
    """WITH t AS (SELECT p_brand AS topic, 6 * count(*) AS score FROM part GROUP BY p_brand ORDER BY score DESC, topic LIMIT 5),
c AS (SELECT p_brand AS topic, p_type AS child, count(*) AS n FROM part GROUP BY ALL)
SELECT topic, child, r::INT AS place FROM (SELECT c.*, row_number() OVER (PARTITION BY c.topic ORDER BY n DESC, child) AS r FROM c JOIN t ON t.topic = c.topic) WHERE r <= 6""",
)
def heuristic_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree without a model: the topics of the highest scores, and below each what stands beside it most often."""
    rows = table(spark, sf_dir, "part").select(topic_phrase(F.col("p_brand")).alias("topic"), topic_phrase(F.col("p_type")).alias("child"))
    top = rows.groupBy("topic").agg((6 * F.count("*")).alias("score")).orderBy(F.desc("score"), "topic").limit(5).select("topic")
    pairs = rows.join(F.broadcast(top), "topic", "left_semi").groupBy("topic", "child").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "child"))
    return pairs.withColumn("place", nth).filter("place <= 6").select("topic", "child", "place")
