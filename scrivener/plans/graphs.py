"""Graph, tree, evidence and map queries, over the star schema as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.operators import graphs as G
from scrivener.operators import search as S
from scrivener.plans.search import BM25_CTE
from scrivener.registry import query
from scrivener.session import spread, table


@query(
    "entity_merge_set_union",
    """WITH m AS (SELECT lower(p_name) AS key, p_name AS name, p_type AS type, p_brand AS alias, p_partkey AS ord FROM part),
v AS (SELECT key, arg_min(type, (-n, type)) AS type FROM (SELECT key, type, count(*) AS n FROM m GROUP BY ALL) GROUP BY key)
SELECT key, arg_min(name, ord) AS name, any_value(v.type) AS type, array_to_string(list_sort(list(DISTINCT alias)), ',') AS aliases, count(*) AS mentions FROM m JOIN v USING (key) GROUP BY key""",
)
def entity_merge_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of a name merged: sorted aliases, the type of most, the first spelling."""
    parts = table(spark, sf_dir, "part")
    mentions = parts.select(F.lower("p_name").alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("alias"), F.col("p_partkey").alias("evidence"), F.col("p_size").alias("document"), F.col("p_partkey").alias("ord"))
    return G.merge_entities(mentions).select("key", "name", "type", F.array_join("aliases", ",").alias("aliases"), "mentions")


RELATIONS_SQL = "SELECT l_partkey AS source, lower(l_returnflag) AS predicate, l_suppkey AS target, max(1 - l_discount) AS confidence, arg_min(l_linestatus, l_orderkey * 10 + l_linenumber) AS kind, count(DISTINCT l_orderkey) AS evidence FROM lineitem GROUP BY ALL"


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("source"), F.col("l_returnflag").alias("predicate"), F.col("l_suppkey").alias("target"), F.col("l_linestatus").alias("kind"), (1 - F.col("l_discount")).alias("confidence"),
        F.col("l_orderkey").alias("evidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    return G.merge_relations(rows)


@query("relation_max_conf", f"SELECT source, predicate, target, round(confidence, 4) AS confidence, evidence FROM ({RELATIONS_SQL})")
def relation_max_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations merged by source, predicate and target, with the highest confidence and all evidence."""
    return _relations(spark, sf_dir).select("source", "predicate", "target", F.round("confidence", 4).alias("confidence"), F.size("evidence_ids").cast("long").alias("evidence"))


@query("relation_endpoints", "SELECT l_partkey AS source, l_suppkey AS target, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL")
def relation_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose both ends are still there."""
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).agg(F.count("*").alias("n"))
    parts = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("__id"))
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("__id"))
    return edges.join(parts, F.col("source") == F.col("__id"), "left_semi").join(suppliers, F.col("target") == F.col("__id"), "left_semi")


@query("quote_verification", "SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def quote_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that stand verbatim in documents."""
    return G.contained_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query(
    "quote_locator",
    r"""WITH c AS (SELECT conv_id AS record, turn AS chunk, role AS section, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations),
q AS (SELECT conv_id * 1000 + turn AS quote_id, conv_id AS record, trim(regexp_replace(substr(text, 5, 12), '\s+', ' ', 'g')) AS q FROM conversations WHERE length(text) > 20),
h AS (SELECT quote_id, c.record, chunk, 1 + CASE WHEN section = 'assistant' THEN 0.15 ELSE 0 END AS score FROM q JOIN c USING (record) WHERE contains(t, q) AND q <> '')
SELECT quote_id, record, chunk, round(score::DOUBLE, 2) AS score FROM (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY score DESC, chunk) AS r FROM h) WHERE r = 1""",
)
def quote_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn of a conversation that holds each quote; turns of the named role are better."""
    turns = table(spark, sf_dir, "conversations")
    quotes = turns.filter("length(text) > 20").select((F.col("conv_id") * 1000 + F.col("turn")).alias("quote_id"), F.col("conv_id").alias("record"), F.substring("text", 5, 12).alias("quote"), F.lit("assistant").alias("section"))
    chunks = turns.select(F.col("conv_id").alias("record"), F.col("turn").alias("chunk"), F.col("role").alias("section"), "text")
    return G.verify_quotes(quotes, chunks).withColumn("score", F.round("score", 2))


@query(
    "range_join_band4",
    "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_suppkey = o_custkey % 100 AND abs(datediff('day', DATE '1992-01-01', l_shipdate::DATE) - datediff('day', DATE '1992-01-01', o_orderdate::DATE)) <= 4 GROUP BY o_orderkey",
)
def range_join_band4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and lines of a supplier within four days."""
    days = lambda c: F.datediff(F.col(c), F.lit("1992-01-01").cast("date"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("k"), days("o_orderdate").alias("a"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), days("l_shipdate").alias("b"))
    return G.band_join(orders, lines, ["k"], "a", "b", 4).groupBy("o_orderkey").agg(F.count("*").alias("n"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions above nations above customers."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.col("n_name"))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.col("c_name"))
    return region.union(nation).union(customer)


TREE_CTE = """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS node, NULL::VARCHAR AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
up AS (SELECT node AS ancestor, node, parent, 0 AS depth FROM e UNION ALL SELECT u.parent, u.node, e.parent, u.depth + 1 FROM up u JOIN e ON e.node = u.parent)"""


@query(
    "subtree_distinct_counts",
    f"""{TREE_CTE}, m AS (SELECT 'c' || o_custkey AS node, o_orderkey AS member FROM orders)
SELECT e.node, count(DISTINCT CASE WHEN depth = 0 THEN member END) AS direct, count(DISTINCT member) AS total FROM e JOIN up ON up.ancestor = e.node LEFT JOIN m ON m.node = up.node GROUP BY e.node""",
)
def subtree_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each tree node, and of its whole subtree."""
    members = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), F.col("o_orderkey").alias("member"))
    return G.subtree_counts(_tree(spark, sf_dir), members, "node", "parent", "member")


@query("tree_paths", f"{TREE_CTE} SELECT up.node, max(depth)::INT AS depth, string_agg(a.name, '/' ORDER BY depth DESC) AS path FROM up JOIN e a ON a.node = up.ancestor GROUP BY up.node")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and path of every tree node."""
    return G.tree_paths(_tree(spark, sf_dir), "node", "parent", "name")


CURATED_SQL = """WITH e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'renamed' ELSE p_name END AS name FROM part WHERE p_partkey % 11 <> 0),
r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS source, l_suppkey AS target FROM lineitem)"""


def _curated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    ids = parts.select("id")
    patches = (
        ids.filter("id % 11 = 0").select(F.lit("entity").alias("kind"), F.col("id").alias("target_id"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("name"))
        .union(ids.filter("id % 5 = 0").select(F.lit("entity"), "id", F.lit("patch"), F.lit("renamed")))
        .union(lines.filter("id % 13 = 0").select(F.lit("relation"), "id", F.lit("delete"), F.lit(None).cast("string")).distinct())
        .union(ids.filter("id < 5").select(F.lit("entity"), F.col("id") + 10**9, F.lit("patch"), F.lit("nobody")))
    )
    return G.curate(parts, lines, patches)


@query("curation_overlay", f"{CURATED_SQL} SELECT id, name FROM e")
def curation_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities after patches and deletions."""
    return _curated(spark, sf_dir)[0]


@query("curation_relations", f"{CURATED_SQL} SELECT id, source, target FROM r WHERE id % 13 <> 0 AND source IN (SELECT id FROM e) AND target IN (SELECT id FROM e)")
def curation_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations after patches, without those that lost an end."""
    return _curated(spark, sf_dir)[1]


@query("curation_orphans", "SELECT 'entity' AS kind, p_partkey + 1000000000 AS target_id FROM part WHERE p_partkey < 5")
def curation_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches that found nothing to patch."""
    return _curated(spark, sf_dir)[2].select("kind", "target_id")


@query(
    "version_rebuild_decision",
    """WITH b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS version, CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'ready' END AS status FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, CASE WHEN b.status IS NULL THEN 'extract' WHEN b.version = sha256(d.text) AND b.status = 'ready' THEN 'reuse' WHEN b.version = sha256(d.text) THEN 'replay' ELSE 'extract' END AS decision FROM documents d LEFT JOIN b USING (doc_id)""",
)
def version_rebuild_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to be built again, by content hash."""
    docs = table(spark, sf_dir, "documents")
    now = docs.select("doc_id", F.sha2("text", 256).alias("version"))
    was = docs.filter("doc_id % 5 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("version"), F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("ready").alias("status"))
    return G.rebuild_decision(now, was, "doc_id", ["version"])


MATRIX_SQL = """WITH refs AS (SELECT doc_id AS ref, source, lang AS period FROM documents),
slots(slot, requirement, need, sources, periods) AS (VALUES ('a', 'x', 2, 2, 1), ('b', 'x', 1, 2, 1), ('c', 'y', 3, 1, 2), ('d', 'z', 100000, 1, 1), ('e', 'w', 1, 1, 1)),
m AS (SELECT d.doc_id AS ref, CASE d.doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE CASE WHEN d.doc_id % 2 = 0 THEN 'c' ELSE 'd' END END AS slot, CASE WHEN quality = 1 THEN 'direct' WHEN toxic = 1 THEN 'partial' ELSE 'unsupported' END AS status, round(d.n_chars % 100 / 100.0, 2)::DOUBLE AS confidence
 FROM documents d JOIN labels USING (doc_id)),
cov AS (SELECT ref, slot, coalesce(status, 'unsupported') AS status, coalesce(confidence, 0) AS confidence FROM (SELECT ref, slot FROM refs, slots) LEFT JOIN m USING (ref, slot))"""


def _coverage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    refs = docs.select(F.col("doc_id").alias("ref"), "source", F.col("lang").alias("period"))
    slots = spark.createDataFrame([("a", "x", 2, 2, 1), ("b", "x", 1, 2, 1), ("c", "y", 3, 1, 2), ("d", "z", 100000, 1, 1), ("e", "w", 1, 1, 1)], "slot string, requirement string, need int, sources int, periods int")
    slot = F.expr("CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE CASE WHEN doc_id % 2 = 0 THEN 'c' ELSE 'd' END END")
    matrix = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("ref"), slot.alias("slot"), F.when(F.col("quality") == 1, "direct").when(F.col("toxic") == 1, "partial").otherwise("unsupported").alias("status"), F.round(F.col("n_chars") % 100 / 100.0, 2).alias("confidence")
    )
    return G.coverage(matrix, refs, slots), slots, refs


@query("coverage_matrix_complete", f"{MATRIX_SQL} SELECT ref, slot, status, confidence FROM cov")
def coverage_matrix_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference with every slot; what nobody judged is unsupported."""
    return _coverage(spark, sf_dir)[0]


@query(
    "requirement_rollup",
    f"""{MATRIX_SQL}, r AS (SELECT * FROM slots LEFT JOIN cov USING (slot) LEFT JOIN refs USING (ref)),
p AS (SELECT requirement, slot, count(*) FILTER (status = 'direct') AS n, max(need) AS need, bool_or(status <> 'unsupported') AS a FROM r GROUP BY ALL),
q AS (SELECT requirement, bool_and(n >= need) AS f, bool_or(a) AS a, count(*) FILTER (n < need) AS missing FROM p GROUP BY requirement),
s AS (SELECT requirement, count(DISTINCT source) FILTER (status = 'direct') AS n_sources, count(DISTINCT period) FILTER (status = 'direct') AS n_periods, max(sources) AS ms, max(periods) AS mp FROM r GROUP BY requirement)
SELECT requirement, CASE WHEN f AND n_sources >= ms AND n_periods >= mp THEN 'supported' WHEN a THEN 'partial' ELSE 'unsupported' END AS status, missing, n_sources, n_periods FROM q JOIN s USING (requirement)""",
)
def requirement_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements by the support of their slots, sources and periods."""
    return G.roll_up(*_coverage(spark, sf_dir))


@query(
    "relation_candidate_merge",
    """WITH c AS (SELECT l_returnflag AS type, trim(both '_' FROM regexp_replace(regexp_replace(lower(p_name), '[\\s\\-/]+', '_', 'g'), '[^a-z0-9_]', '', 'g')) AS target_key, p_type AS target_type, 1 - l_discount AS confidence, 1 - l_tax AS tc, l_orderkey AS record, l_linenumber AS chunk, l_linestatus AS quote FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT type, target_key, target_type, round(max(least(confidence, tc)), 4) AS confidence, count(*) AS candidates, count(DISTINCT (record, chunk, quote)) AS evidence FROM c GROUP BY ALL""".replace("\\\\", "\\"),
)
def relation_candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation candidates merged by type and target."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("type"), F.col("p_name").alias("target"), F.col("p_type").alias("target_type"), (1 - F.col("l_discount")).alias("confidence"), (1 - F.col("l_tax")).alias("target_confidence"),
        F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("chunk"), F.col("l_linestatus").alias("quote"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    return G.merge_candidates(rows).select("type", "target_key", "target_type", F.round("confidence", 4).alias("confidence"), "candidates", "evidence")


@query(
    "graph_navigation",
    f"""WITH rel AS (SELECT source, predicate, target, confidence, p_name || ' ' || predicate AS claim, p_name FROM ({RELATIONS_SQL}) JOIN part ON p_partkey = source),
s AS (SELECT *, CASE WHEN contains(lower(claim), 'red bolt') THEN 3 ELSE 0 END + 1.35 * 0 + len(list_intersect(list_distinct(regexp_extract_all(lower(claim), '[a-z0-9][a-z0-9+._/-]{{1,}}')), ['red', 'bolt'])) * (0.5 + 0.35) AS direct,
 CASE WHEN contains(lower(p_name), 'red bolt') THEN 3 ELSE 0 END + len(list_intersect(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9][a-z0-9+._/-]{{1,}}')), ['red', 'bolt'])) * (0.5 + 0.35) AS around FROM rel)
SELECT source, predicate, target, round(direct + 0.75 * around + 0.1 * confidence, 5)::DOUBLE AS score FROM s WHERE direct > 0 OR around > 0 ORDER BY direct + 0.75 * around + 0.1 * confidence DESC, source, predicate, target LIMIT 40""",
)
def graph_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best relations for a question, by their claim, their ends and their confidence."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    edges = _relations(spark, sf_dir).join(parts.withColumnRenamed("id", "source"), "source")
    edges = edges.select(F.struct("source", "predicate", "target").alias("id"), "source", F.lit(None).cast("long").alias("target"), "confidence", F.concat_ws(" ", "name", "predicate").alias("claim"))
    best = G.navigate(edges, parts, ["red bolt"], 40)
    return best.select("id.source", "id.predicate", "id.target", F.round("score", 5).alias("score"))


@query("group_limit", "SELECT conv_id, turn, place FROM conversations JOIN (SELECT conv_id, row_number() OVER (ORDER BY min(conv_id * 100 + turn))::INT AS place FROM conversations GROUP BY conv_id ORDER BY place LIMIT 12) USING (conv_id)")
def group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve conversations, kept whole."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("o"))
    return G.reading_order(turns, ["conv_id"], "o", 12).select("conv_id", "turn", "place")


@query(
    "structural_graph",
    """SELECT 'region' AS kind, 'r' || r_regionkey AS source, 'n' || n_nationkey AS target FROM region JOIN nation ON n_regionkey = r_regionkey
UNION SELECT 'customer', 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'order', 'c' || o_custkey, o_orderpriority FROM orders""",
)
def structural_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of the catalog as one graph, each once."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation = table(spark, sf_dir, "nation").select(F.lit("region").alias("kind"), key("r", "n_regionkey").alias("source"), key("n", "n_nationkey").alias("target"))
    customer = table(spark, sf_dir, "customer").select(F.lit("customer"), key("n", "c_nationkey"), key("c", "c_custkey"))
    order = table(spark, sf_dir, "orders").select(F.lit("order"), key("c", "o_custkey"), "o_orderpriority")
    return nation.union(customer).union(order).distinct()


@query("map_snapshot", "SELECT source, count(*) AS cards, count(quality) AS built, CASE WHEN count(quality) = 0 THEN 'empty' WHEN count(quality) FILTER (quality = 0) > 2 THEN 'stale' WHEN count(quality) < count(*) THEN 'partial' ELSE 'ready' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def map_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each collection's map is built."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source")
    out = rows.agg(F.count("*").alias("cards"), F.count("quality").alias("built"), F.count_if(F.col("quality") == 0).alias("old"))
    status = F.when(F.col("built") == 0, "empty").when(F.col("old") > 2, "stale").when(F.col("built") < F.col("cards"), "partial").otherwise("ready")
    return out.select("source", "cards", "built", status.alias("status"))


@query("quality_gate", "SELECT lang, count(*) FILTER (l.doc_id IS NOT NULL) AS processed, count(*) AS total, CASE WHEN count(l.doc_id) / count(*) >= 0.95 THEN 'ready' WHEN count(l.doc_id) / count(*) >= 0.4 THEN 'degraded' ELSE 'failed' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether enough of each language was processed."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumn("done", F.lit(True)), "doc_id", "left")
    out = rows.groupBy("lang").agg(F.count("done").alias("processed"), F.count("*").alias("total"))
    share = F.col("processed") / F.col("total")
    return out.withColumn("status", F.when(share >= 0.95, "ready").when(share >= 0.4, "degraded").otherwise("failed"))


@query("topic_domains", "SELECT p_partkey, arg_min(d, (-n, d)) FILTER (n > 0) AS domain FROM (SELECT p_partkey, d, len(list_intersect(string_split(lower(p_name), ' '), k)) AS n FROM part, (VALUES ('colour', ['red', 'blue', 'green']), ('metal', ['bolt', 'gear', 'ring']), ('size', ['small', 'large'])) AS t(d, k)) GROUP BY p_partkey")
def topic_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain that shares most words with each topic; the first of ties, none without a shared word."""
    domains = [("colour", ["red", "blue", "green"]), ("metal", ["bolt", "gear", "ring"]), ("size", ["small", "large"])]  # in the order of their names
    words = F.split(F.lower("p_name"), " ")
    # A domain's place and how many words it shares are one number, so that the smallest is kept in fixed room and without sorting.
    shared = [F.size(F.array_intersect(words, F.array(*map(F.lit, k)))) for _, k in domains]
    codes = [F.when(n > 0, i - n.cast("long") * len(domains)) for i, n in enumerate(shared)]
    best = table(spark, sf_dir, "part").select("p_partkey", F.least(*codes).alias("code")).groupBy("p_partkey").agg(F.min("code").alias("code"))
    return best.select("p_partkey", F.get(F.array(*(F.lit(d) for d, _ in domains)), F.pmod("code", F.lit(len(domains))).cast("int")).alias("domain"))


@query("top_topics", "SELECT word, n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, word LIMIT 6")
def top_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most frequent words of names."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(6)


@query(
    "graph_ranking",
    f"""{BM25_CTE},
b2 AS (SELECT doc_id, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a)) ELSE 0 END) AS score FROM tf JOIN df USING (term), n WHERE term IN ('the', 'that', 'moron') GROUP BY doc_id),
l1 AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 0 AS channel FROM b2 ORDER BY r LIMIT 50),
h AS (SELECT doc_id, count(*)::DOUBLE AS score FROM documents d, benchmark b WHERE contains(d.text, b.text) GROUP BY doc_id),
l2 AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 1 AS channel FROM h ORDER BY r LIMIT 50)
SELECT doc_id, round(sum(1.0 / (60 + r)), 8) AS fusion, round(max(score), 5) AS score, count(DISTINCT channel) AS channels FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY doc_id
ORDER BY sum(1.0 / (60 + r)) DESC, max(score) DESC, doc_id LIMIT 12""",
)
def graph_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and graph evidence fused: documents by BM25 and by the passages that they hold."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lexical = S.ranked(S.bm25(docs, ["the", "that", "moron"]).withColumnRenamed("bm25", "score"), "score", "doc_id", 50)
    held = G.contained_passages(docs, table(spark, sf_dir, "benchmark"), "doc_id", "item_id").groupBy("doc_id").agg(F.count("*").cast("double").alias("score"))
    best = S.rrf([lexical, S.ranked(held, "score", "doc_id", 50)], "doc_id", "score").orderBy(F.desc("fusion"), F.desc("score"), "doc_id").limit(12)
    return best.select("doc_id", F.round("fusion", 8).alias("fusion"), F.round("score", 5).alias("score"), "channels")
