"""Queries of trees, curation, nested artifacts and canonical JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import canonical as K
from scrivener.operators import trees as O
from scrivener.plans.graphs import TREE_CTE, _tree
from scrivener.registry import query
from scrivener.session import table
from scrivener.sources import nested as N


@query(
    "canonical_versions",
    """WITH c AS (SELECT conv_id, turn, sha256('{"role":' || to_json(coalesce(role, ''))::VARCHAR || ',"text":' || to_json(coalesce(text, ''))::VARCHAR || '}') AS h FROM conversations),
d AS (SELECT conv_id, coalesce(arg_min(text, turn), '') AS first_text, count(*) AS turns, coalesce(min(role), '') AS first_role FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256('{"chunks":[' || (SELECT string_agg('"' || h || '"', ',' ORDER BY turn) FROM c WHERE c.conv_id = d.conv_id) || '],"document_text":"' || sha256(first_text) || '","first_role":' || to_json(first_role)::VARCHAR || ',"turns":"' || turns || '"}') AS version FROM d""",
)
def canonical_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each conversation's fields, first text and turns, in canonical JSON."""
    turns = table(spark, sf_dir, "conversations")
    docs = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"), F.count("*").alias("turns"), F.min("role").alias("first_role"))
    return K.content_versions(docs, turns, "conv_id", ["turns", "first_role"], "first_text", ["turn"], ["text", "role"])


@query(
    "cache_keys",
    """SELECT event_id, 'calls:' || sha256('{"a":{"list":[' || user_id || ',' || coalesce((props->>'$.k'), 'null') || '],"x":' || to_json(event_type)::VARCHAR || '},"model":"m","n":' || user_id || '}') AS key FROM events""",
)
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of calls whose payloads are spelled in another order, with blanks, and whole numbers with a point."""
    events = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("null"))
    spelled = F.format_string('{ "n" : %s.0,\n"model":"m", "a": {"x":"%s","list":[%s, %s ]} }', F.col("user_id").cast("string"), F.col("event_type"), F.col("user_id").cast("string"), k)
    return events.select("event_id", K.cache_key("calls", spelled).alias("key"))


@query(
    "landed_collections",
    """SELECT 'r' || r_regionkey AS key, r_name AS name, '' AS parent, 0::BIGINT AS version FROM region
UNION ALL SELECT 'n' || n_nationkey, CASE WHEN length(n_name) > 9 THEN 'n' || n_nationkey ELSE n_name END, 'r' || n_regionkey, n_nationkey::BIGINT FROM nation""",
)
def landed_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections from landed arrays, one array per region: parents are false at the top, names may be blank."""
    nation = table(spark, sf_dir, "nation")
    name = F.when(F.length("n_name") > 9, "").otherwise(F.col("n_name"))
    child = F.format_string('{"key":"n%s","version":%s,"data":{"name":"%s","parentCollection":"r%s"}}', F.col("n_nationkey").cast("string"), F.col("n_nationkey").cast("string"), name, F.col("n_regionkey").cast("string"))
    below = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.array_sort(F.collect_list(child)), ",").alias("below"))  # a few nations
    top = F.format_string('{"data":{"key":"r%s","name":"%s","parentCollection":false}}', F.col("r_regionkey").cast("string"), F.col("r_name"))
    arrays = table(spark, sf_dir, "region").join(below, "r_regionkey", "left").select(F.try_parse_json(F.concat(F.lit("["), F.concat_ws(",", top, "below"), F.lit(", 5, {}]"))).alias("v"))
    return N.collections(arrays, "v")


@query(
    "artifact_tree_nodes",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation),
c AS (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS j, c FROM (SELECT c_nationkey, c_mktsegment, count(*) AS c FROM customer GROUP BY ALL))
SELECT r_name AS region, '1' AS position, '' AS parent_position, 1 AS ordinal, 0 AS depth, r_name AS label, NULL::BIGINT AS customers FROM region
UNION ALL SELECT r_name, '1.' || i, '1', i::INT, 1, n_name, NULL FROM n JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT r_name, '1.' || i || '.' || j, '1.' || i, j::INT, 2, c_mktsegment, c FROM c JOIN n ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def artifact_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as nested trees (nations, segments of their customers) taken apart into nodes."""
    segment = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("customers"))
    segment = segment.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("c_mktsegment").alias("label"), "customers"))).alias("child"))  # a few segments
    nation = table(spark, sf_dir, "nation").join(segment, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("label"), "child"))).alias("child"))
    trees = table(spark, sf_dir, "region").join(nation, "r_regionkey", "left").select(F.col("r_name").alias("region"), F.try_parse_json(F.to_json(F.struct(F.col("r_name").alias("label"), "child"))).alias("v"))
    return N.tree_nodes(trees, "region", "v").select("region", "position", "parent_position", "ordinal", "depth", "label", N.get(F.col("node"), "$.customers", "long").alias("customers"))


def _curation(spark: SparkSession, sf_dir: str) -> O.Curated:
    """The tree of customers with suppliers and parts beside it, after a log: nations named with I go, but those named with
    IRA come back; customers in debt go, rich ones are called by their segment; suppliers in debt go."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    none = F.lit(None).cast("map<string,string>")
    entry = lambda df, n, kind, target, op, fields=none: df.select(F.lit(n).alias("revision"), F.lit(kind).alias("kind"), target.alias("target"), F.lit(op).alias("op"), fields.alias("fields"))
    of = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    log = entry(nation.filter("n_name like 'I%'"), 1, "tree", of("n", "n_nationkey"), "delete")
    log = log.union(entry(nation.filter("n_name like 'IRA%'"), 3, "tree", of("n", "n_nationkey"), "restore"))
    log = log.union(entry(customer.filter("c_acctbal < 0"), 2, "tree", of("c", "c_custkey"), "delete"))
    for n, label in ((4, F.lit("first name")), (5, F.lower("c_mktsegment"))):
        log = log.union(entry(customer.filter("c_acctbal > 9000"), n, "tree", of("c", "c_custkey"), "patch", F.create_map(F.lit("label"), label)))
    log = log.union(entry(supplier.filter("s_acctbal < 0"), 6, "entity", of("s", "s_suppkey"), "delete"))
    log = log.union(entry(supplier.filter("s_acctbal > 9000"), 7, "entity", F.concat(F.lit("unknown"), F.col("s_suppkey").cast("string")), "patch", F.create_map(F.lit("name"), F.lit("x"))))
    tree = _tree(spark, sf_dir).select("node", "parent", F.col("name").alias("label"))
    parts = table(spark, sf_dir, "part").select(of("p", "p_partkey").alias("id"), F.col("p_name").alias("name"))
    entities = supplier.select(of("s", "s_suppkey").alias("id"), F.col("s_name").alias("name")).union(parts)
    lines = table(spark, sf_dir, "lineitem").select(of("s", "l_suppkey").alias("source"), of("p", "l_partkey").alias("target")).distinct()
    return O.curated(tree, entities, lines.select(F.concat_ws("-", "source", "target").alias("id"), "source", "target"), log)


CURATION_SQL = f"""{TREE_CTE}, gone AS (SELECT DISTINCT up.node FROM up WHERE ancestor IN (SELECT 'n' || n_nationkey FROM nation WHERE n_name LIKE 'I%' AND n_name NOT LIKE 'IRA%' UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0)),
t AS (SELECT node, e.parent, coalesce(lower(c_mktsegment), name) AS label FROM e LEFT JOIN customer ON node = 'c' || c_custkey AND c_acctbal > 9000 WHERE node NOT IN (SELECT node FROM gone)),
n AS (SELECT 's' || s_suppkey AS id, s_name AS name FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'p' || p_partkey, p_name FROM part),
r AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem WHERE 's' || l_suppkey IN (SELECT id FROM n) AND 'p' || l_partkey IN (SELECT id FROM n))"""


@query("curation_cascade", f"{CURATION_SQL} SELECT 'tree' AS kind, node AS id, label FROM t UNION ALL SELECT 'entity', id, name FROM n UNION ALL SELECT 'relation', source || '-' || target, NULL FROM r UNION ALL SELECT 'orphan', 'unknown' || s_suppkey, NULL FROM supplier WHERE s_acctbal > 9000")
def curation_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log of patches, deletions and restores leaves of a tree and a graph, and the patches that found nothing."""
    now = _curation(spark, sf_dir)
    row = lambda df, kind, key, label: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), label.alias("label"))
    none = F.lit(None).cast("string")
    return row(now.tree, "tree", "node", F.col("label")).union(row(now.entities, "entity", "id", F.col("name"))).union(row(now.relations, "relation", "id", none)).union(row(now.orphans, "orphan", "target", none))


@query(
    "curated_graph_edges",
    f"{CURATION_SQL} SELECT CASE WHEN parent IS NULL THEN 'project:tpch' ELSE 'domain:' || parent END AS source, 'domain:' || node AS target, CASE WHEN parent IS NULL THEN 'has_domain' ELSE 'has_subdomain' END AS relation FROM t UNION ALL SELECT source, target, 'semantic_relation' FROM r UNION ALL SELECT 's' || s_suppkey, 'domain:n' || s_nationkey, 'in' FROM supplier WHERE 's' || s_suppkey IN (SELECT id FROM n) AND 'n' || s_nationkey IN (SELECT node FROM t)",
)
def curated_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the graph over a curated tree, base edges under new ids included as far as their ends are left."""
    base = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source"), F.concat(F.lit("old:"), F.col("s_nationkey").cast("string")).alias("target"), F.lit("in").alias("relation"))
    ids = table(spark, sf_dir, "nation").select(F.concat(F.lit("old:"), F.col("n_nationkey").cast("string")).alias("old_id"), F.concat(F.lit("domain:n"), F.col("n_nationkey").cast("string")).alias("new_id"))
    return O.knowledge_edges("tpch", _curation(spark, sf_dir), base, ids)


@query(
    "curation_impact",
    f"""{CURATION_SQL}, below AS (SELECT ancestor, count(*) - 1 AS reach FROM up WHERE ancestor IN (SELECT node FROM t) AND node IN (SELECT node FROM t) GROUP BY ancestor),
a AS (SELECT 'tree' AS kind, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'entity', 's' || s_suppkey FROM supplier UNION ALL SELECT DISTINCT 'relation', 's' || l_suppkey || '-p' || l_partkey FROM lineitem)
SELECT kind, a.target, CASE kind WHEN 'tree' THEN reach IS NOT NULL WHEN 'entity' THEN id IS NOT NULL ELSE k IS NOT NULL END AS there, coalesce(CASE kind WHEN 'tree' THEN reach WHEN 'entity' THEN c END, 0) AS reach
FROM a LEFT JOIN below ON kind = 'tree' AND ancestor = a.target LEFT JOIN n ON kind = 'entity' AND id = a.target LEFT JOIN (SELECT source, count(*) AS c FROM r GROUP BY source) s ON kind = 'entity' AND s.source = a.target LEFT JOIN (SELECT source || '-' || target AS k FROM r) x ON kind = 'relation' AND k = a.target""",
)
def curation_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the deletion of each nation, supplier and relation would take along, as things are now."""
    of = lambda t, c, letter, kind: table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.concat(F.lit(letter), F.col(c).cast("string")).alias("target"))
    lines = table(spark, sf_dir, "lineitem").select(F.lit("relation").alias("kind"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("-p"), F.col("l_partkey").cast("string")).alias("target"))
    return O.impact(_curation(spark, sf_dir), of("nation", "n_nationkey", "n", "tree").union(of("supplier", "s_suppkey", "s", "entity")).union(lines))


@query(
    "collection_scope",
    f"""{TREE_CTE}, i AS (SELECT DISTINCT node FROM up WHERE ancestor IN ('r1', 'r3', 'n3')), d AS (SELECT node, max(depth)::INT AS depth FROM up WHERE node IN (SELECT node FROM i) AND ancestor IN (SELECT node FROM i) GROUP BY node),
p AS (SELECT up.node, string_agg(a.name, ' / ' ORDER BY depth DESC) AS path FROM up JOIN e a ON a.node = up.ancestor GROUP BY up.node)
SELECT upper(e.node) AS key, CASE WHEN e.parent IN (SELECT node FROM i) THEN upper(e.parent) ELSE '' END AS parent_key, name, path, depth, length(name)::BIGINT AS version, false AS is_virtual FROM e JOIN d USING (node) JOIN p USING (node)""",
)
def collection_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regions and a nation, one of them below the other, with all that is under them."""
    rows = _tree(spark, sf_dir).select(F.concat(F.lit(" "), F.col("node")).alias("key"), "name", "parent", F.length("name").alias("version"))
    return O.collection_scope(rows, ["r1", "n3", "R3 ", "r1"])


@query(
    "hierarchy_cycles",
    """WITH RECURSIVE f AS (SELECT a.user_id AS node, b.user_id AS parent FROM (SELECT user_id, min(event_id) AS m FROM events GROUP BY user_id) a JOIN events b ON b.event_id = a.m + 1),
w AS (SELECT node AS start, node AS here, [node] AS members FROM f UNION ALL SELECT start, f.parent, list_append(members, f.parent) FROM w JOIN f ON f.node = here WHERE NOT list_contains(members, f.parent))
SELECT start, members, len(members)::INT AS size FROM w JOIN f ON f.node = here WHERE f.parent = start AND start = list_min(members)""",
)
def hierarchy_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles among users, each below the one whose event follows their first."""
    events = table(spark, sf_dir, "events")
    first = events.groupBy("user_id").agg((F.min("event_id") + 1).alias("event_id")).withColumnRenamed("user_id", "node")
    return O.cycles(first.join(events.select("event_id", F.col("user_id").alias("parent")), "event_id"), "node", "parent")


@query(
    "renamed_tree_ids",
    f"""{TREE_CTE}, n AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY name, node) AS i FROM e),
p AS (SELECT node, i::VARCHAR AS position FROM n WHERE parent IS NULL UNION ALL SELECT n.node, position || '.' || i FROM p JOIN n ON n.parent = p.node)
SELECT 'domain:' || position AS old_id, 'domain:' || left(sha256(node), 12) AS new_id FROM p""",
)
def renamed_tree_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by position and the stable ids that take their place."""
    nodes = _tree(spark, sf_dir).withColumn("stable", F.substring(F.sha2("node", 256), 1, 12))
    return O.renamed_ids(nodes, "node", "parent", "name", "stable")
