"""Queries of the knowledge operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.operators import knowledge as K
from scrivener.registry import query
from scrivener.session import table


@query("map_ids", "SELECT doc_id, 'claim:' || left(sha256(coalesce(lower(source), '') || chr(31) || coalesce(lower(lang), '') || chr(31) || doc_id), 24) AS id FROM documents")
def map_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of claims, whatever the case and the blanks around their parts."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", K.map_id("claim", F.concat(F.lit(" "), F.upper("source"), F.lit("\n")), F.initcap("lang"), F.col("doc_id")).alias("id"))


@query("structure_ids", "SELECT conv_id, turn, 'structure-' || role || '-' || left(sha1('Top > ' || role || chr(10) || role || chr(10) || turn || chr(10) || text), 16) AS id FROM conversations WHERE text IS NOT NULL")
def structure_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of turns as structures below two headings."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    return turns.select("conv_id", "turn", K.structure_id(F.array(F.lit("Top "), F.lit(" "), F.col("role")), F.col("role"), F.col("turn"), F.col("text")).alias("id"))


@query(
    "merged_attributes",
    """WITH a AS (SELECT l_partkey AS entity, l_orderkey, l_linenumber, l_suppkey, 'quantity' AS name, l_quantity::BIGINT::VARCHAR AS value, CASE WHEN l_quantity > 25 THEN 'box' END AS unit FROM lineitem UNION ALL SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, 'flag', l_returnflag, l_linestatus FROM lineitem)
SELECT entity, name, value, unit, count(*) AS mentions, arg_min(l_orderkey, (l_orderkey, l_linenumber, l_suppkey)) AS l_orderkey FROM a GROUP BY entity, name, value, unit""",
)
def merged_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of parts once per name, value and unit, with the order that has each first."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    place = ["entity", "l_orderkey", "l_linenumber", "l_suppkey"]
    one = rows.select(*place, F.lit("quantity").alias("name"), F.col("l_quantity").cast("long").cast("string").alias("value"), F.when(F.col("l_quantity") > 25, "box").alias("unit"))
    two = rows.select(*place, F.lit("flag").alias("name"), F.col("l_returnflag").alias("value"), F.col("l_linestatus").alias("unit"))
    return K.merged_attributes(one.union(two), "entity", place[1:], ["l_orderkey"])


GRAPH_SQL = """n AS (SELECT 's' || s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'p' || p_partkey, p_name FROM part),
r AS (SELECT DISTINCT 's' || l_suppkey || '-p' || l_partkey AS id, 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem), e AS (SELECT item_id AS id, text FROM benchmark)"""


def _graph(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    of = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = table(spark, sf_dir, "supplier").select(of("s", "s_suppkey").alias("id"), F.col("s_name").alias("name")).union(table(spark, sf_dir, "part").select(of("p", "p_partkey"), "p_name"))
    relations = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", of("s", "l_suppkey"), of("p", "l_partkey")).alias("id"), of("s", "l_suppkey").alias("source"), of("p", "l_partkey").alias("target")).distinct()
    evidence = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    found = K.graph_query(nodes, relations, evidence, text, 12)
    row = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
    return row(found.nodes, "node").union(row(found.relations, "relation")).union(row(found.evidence, "evidence")).union(found.counts.select(F.concat(F.lit("count "), "kind"), F.concat_ws("/", "returned", "total")))


COUNTS_SQL = "SELECT 'count nodes', (SELECT count(*) FROM fn) || '/' || (SELECT count(*) FROM n) UNION ALL SELECT 'count relations', (SELECT count(*) FROM fr) || '/' || (SELECT count(*) FROM r) UNION ALL SELECT 'count evidence', (SELECT count(*) FROM fe) || '/' || (SELECT count(*) FROM e)"
ROWS_SQL = f"SELECT 'node' AS kind, id FROM fn UNION ALL SELECT 'relation', id FROM fr UNION ALL SELECT 'evidence', id::VARCHAR FROM fe UNION ALL {COUNTS_SQL}"


@query("graph_overview", f"WITH {GRAPH_SQL}, fn AS (SELECT id FROM n ORDER BY id LIMIT 12), fr AS (SELECT id FROM r ORDER BY id LIMIT 12), fe AS (SELECT id FROM e ORDER BY id LIMIT 12) {ROWS_SQL}")
def graph_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each kind, and how many there are."""
    return _graph(spark, sf_dir, " ")


@query(
    "graph_text_search",
    f"""WITH {GRAPH_SQL}, fn AS (SELECT id FROM n WHERE contains(lower(id || chr(31) || name), 's1') ORDER BY id LIMIT 12),
fr AS (SELECT id FROM r WHERE source IN (SELECT id FROM fn) OR target IN (SELECT id FROM fn) OR contains(id || chr(31) || source || chr(31) || target, 's1') ORDER BY id LIMIT 12),
fe AS (SELECT id FROM e WHERE contains(lower(text), 's1') ORDER BY id LIMIT 12) {ROWS_SQL}""",
)
def graph_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, evidence and relations that have a text in some field, and the relations of the nodes."""
    return _graph(spark, sf_dir, " S1 ")


@query(
    "refinement_queries",
    """WITH f AS (SELECT DISTINCT l_suppkey AS question, 'f' || l_linenumber AS id, l_linenumber AS ord, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_returnflag) = 1),
a AS (SELECT * FROM f WHERE l_returnflag <> 'A'), q AS (SELECT s_suppkey AS question, s_acctbal < 0 AS mechanism FROM supplier),
t AS (SELECT question, 1 AS tier, id, 'look for ' || id AS query, 'know ' || id AS goal, ord FROM a UNION ALL SELECT question, 1, 'requirement-r', 'all of it', 'all of it', 100 FROM q WHERE question % 2 = 0
 UNION ALL SELECT question, 3, 'refine-method-' || row_number() OVER (PARTITION BY question ORDER BY ord), 'look for ' || id || chr(10) || 'know ' || id || chr(10) || 'method framework protocol algorithm implementation', 'know ' || id, ord FROM f JOIN q USING (question) WHERE mechanism),
b AS (SELECT * FROM t QUALIFY tier = min(tier) OVER (PARTITION BY question)), p AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY ord, id) - 1 AS place FROM b)
SELECT question, place::INT AS place, id, query, goal FROM p WHERE place < 4""",
)
def refinement_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to look for next: facets and requirements that aren't supported, else, for mechanisms, methods."""
    lines, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    plan = lines.groupBy(F.col("l_suppkey").alias("question"), F.col("l_linenumber").alias("ord")).agg(F.min("l_returnflag").alias("flag")).withColumn("id", F.concat(F.lit("f"), F.col("ord").cast("string")))
    facets = plan.select("question", "id", F.concat(F.lit("look for "), "id").alias("query"), F.concat(F.lit("know "), "id").alias("goal"), "ord")
    even = supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("question"))
    requirements = even.select("question", F.lit("r").alias("id"), F.lit("all of it").alias("description"))
    says = plan.select("question", "id", F.when(F.col("flag") == "A", "supported").otherwise("partial").alias("status"), F.lit(" ").alias("query"), "ord")
    says = says.unionByName(even.select("question", F.lit("r").alias("id"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("query"), F.lit(100).cast(plan.schema["ord"].dataType).alias("ord")))
    return K.refinements(facets, requirements, says, methods=supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("question")))


@query(
    "conversation_views",
    """WITH t AS (SELECT conv_id, turn, role, left(trim(text), 60) AS x, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '')
SELECT conv_id, coalesce(list(x ORDER BY turn) FILTER (role = 'user' AND r <= 2), []) AS intents, coalesce(list(x ORDER BY turn) FILTER (role = 'assistant' AND r <= 2), []) AS answers, coalesce(list(len(string_split_regex(x, '\\s+')) ORDER BY turn) FILTER (role = 'assistant' AND r <= 2), [])::INT[] AS sources FROM t GROUP BY conv_id""".replace("\\\\", "\\"),
)
def conversation_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two wishes and answers of each conversation, cut, with their sources."""
    turns = table(spark, sf_dir, "conversations").withColumn("sources", F.split(F.substring(F.trim("text"), 1, 60), r"\s+"))
    found = K.conversation_view(turns, "conv_id", "turn", "role", "text", 2, 60, "sources", 1000)
    return found.select("conv_id", "intents", F.transform("answers", lambda a: a["text"]).alias("answers"), F.transform("answers", lambda a: F.size(a["sources"])).alias("sources"))


@query(
    "graph_histograms",
    "SELECT 'node' AS kind, c_mktsegment AS type, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'entity', p_brand, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'claims', 'all', (SELECT count(*) FROM lineitem)",
)
def graph_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and entities by type, and the sum of claims."""
    cards = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("claims"))
    return K.histograms(table(spark, sf_dir, "customer"), table(spark, sf_dir, "part"), cards, "c_mktsegment", "p_brand")


@query(
    "sources_in_scope",
    "WITH a AS (SELECT list(s_suppkey) AS l FROM supplier) SELECT conv_id, turn, list_filter([conv_id, turn, conv_id + turn], lambda x: list_contains(l, x)) AS records FROM conversations, a",
)
def sources_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with those of their sources that belong to the scope."""
    turns = table(spark, sf_dir, "conversations")
    sources = F.array(*(F.struct(c.cast("long").alias("record"), F.lit("x").alias("title")) for c in (F.col("conv_id"), F.col("turn"), F.col("conv_id") + F.col("turn"))))
    allowed = K.restricted(table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("record")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record")), "record")
    scope = allowed.unionByName(table(spark, sf_dir, "supplier").filter("s_acctbal <= 0").select(F.col("s_suppkey").alias("record")))
    found = K.sources_within(turns.select("conv_id", "turn", sources.alias("sources")), scope, ["conv_id", "turn"], "sources")
    return found.select("conv_id", "turn", F.transform("sources", lambda s: s["record"]).alias("records"))
