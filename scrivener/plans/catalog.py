"""Catalog queries: listing, de-duplication, merging, quotas, membership, keyed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import text as X
from scrivener.operators import records as R
from scrivener.registry import query
from scrivener.session import table


@query("catalog_list_filtered", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%re%' OR p_brand ILIKE '%re%' ORDER BY p_retailprice DESC, p_partkey LIMIT 200")
def catalog_list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose name or brand contains a keyword, best first, at most two hundred."""
    parts = table(spark, sf_dir, "part").filter(F.col("p_name").ilike("%re%") | F.col("p_brand").ilike("%re%"))
    return parts.orderBy(F.desc("p_retailprice"), "p_partkey").limit(200).select("p_partkey", "p_name", "p_brand")


@query("catalog_count", "SELECT count(*) AS n FROM part WHERE p_name ILIKE '%re%' OR p_brand ILIKE '%re%'")
def catalog_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_name").ilike("%re%") | F.col("p_brand").ilike("%re%")).agg(F.count("*").alias("n"))


@query("lookup_ordered_ids", "SELECT doc_id, place::INT AS place, lang FROM documents JOIN (VALUES (7, 0), (3, 1), (99, 2), (12, 3)) AS v(id, place) ON doc_id = id")
def lookup_ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order in which ids were asked for; repeats and unknown ids drop out."""
    return R.in_order([7, 3, 99, 7, 12, 10**9], table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "place", "lang")


@query("find_by_any_key", "SELECT doc_id, source FROM documents WHERE doc_id = 5 OR sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 8) ORDER BY doc_id LIMIT 1")
def find_by_any_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record that has one of several keys."""
    docs = table(spark, sf_dir, "documents")
    key = F.broadcast(docs.filter("doc_id = 8").select(F.sha2("text", 256).alias("k")))
    return docs.crossJoin(key).filter((F.col("doc_id") == 5) | (F.sha2("text", 256) == F.col("k"))).orderBy("doc_id").limit(1).select("doc_id", "source")


@query("dedupe_first_by_key", "SELECT min(doc_id) AS doc_id, left(sha256(text), 16) AS record_id FROM documents GROUP BY text")
def dedupe_first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per key, the first by id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return R.first_by(docs, ["key"], F.col("doc_id")).select("doc_id", F.substring("key", 1, 16).alias("record_id"))


@query("dedupe_group_sizes", "SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM documents GROUP BY text) GROUP BY n")
def dedupe_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").groupBy(F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("k")).agg(F.count("*").alias("n"))
    return sizes.groupBy("n").agg(F.count("*").alias("groups"))


CANONICAL_SQL = """
WITH s AS (SELECT d.doc_id, d.text, d.source, (coalesce(l.quality, 0) * 2 + (l.doc_id IS NOT NULL)::INT + (trim(d.lang) <> '')::INT + (trim(d.source) <> '')::INT) AS score
           FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, score::INT AS score, n FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY text) AS n FROM s) WHERE r = 1"""


@query("canonical_record_per_group", CANONICAL_SQL)
def canonical_record_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most complete record of each group of copies; ties by id."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    score = R.completeness(["lang", "source", "quality"], extra={"good": F.coalesce(F.col("quality") == 1, F.lit(False))})
    scored = docs.select("doc_id", F.sha2("text", 256).alias("key"), score.alias("score"))
    best = scored.groupBy("key").agg(F.min_by(F.struct("doc_id", "score"), F.struct(-F.col("score"), F.col("doc_id"))).alias("r"), F.count("*").alias("n"))
    return best.select("r.doc_id", "r.score", "n")


@query(
    "merge_group_fields",
    """WITH s AS (SELECT d.doc_id, d.text, d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(quality, doc_id) FILTER (quality IS NOT NULL) AS quality, count(*) AS members,
       array_to_string(list_distinct_ordered, ',') AS sources FROM (SELECT *, (SELECT list(source ORDER BY f) FROM (SELECT source, min(doc_id) AS f FROM s t WHERE t.text = s.text GROUP BY source)) AS list_distinct_ordered FROM s)
GROUP BY text, list_distinct_ordered HAVING count(*) > 1""",
)
def merge_group_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies merged: the first value that isn't blank per field, the ordered union of sources."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.select("doc_id", F.sha2("text", 256).alias("key"), "lang", "quality", F.array("source").alias("sources"))
    merged = R.merge_groups(rows, "key", F.col("doc_id"), ["doc_id", "lang", "quality"], ["sources"]).filter("members > 1")
    return merged.select("doc_id", "lang", "quality", "members", F.array_join("sources", ",").alias("sources"))


@query("quota_per_source_topk", "SELECT source, doc_id, n_chars, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def quota_per_source_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest documents of each source."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return R.quota(docs, "source", [F.desc("n_chars"), F.col("doc_id")], 5)


@query(
    "candidate_filter_rank",
    """WITH h AS (SELECT d.*, l.quality, (contains(lower(text), 'moron')::INT + contains(lower(text), 'threatening')::INT + contains(lower(text), 'tion')::INT) AS hits FROM documents d LEFT JOIN labels l USING (doc_id)),
k AS (SELECT doc_id, source, quality, round(hits / 3, 3) AS relevance FROM h WHERE hits > 0 AND n_chars BETWEEN 200 AND 5000 AND (source = 'src0' OR coalesce(quality >= 1, false)))
SELECT doc_id, source, relevance, CASE WHEN source = 'src0' THEN NULL ELSE quality END AS quality FROM k""",
)
def candidate_filter_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in a range that hold a query token and reach a metric, from which one source is exempt."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    exempt = F.col("source") == "src0"
    kept = R.candidate_filter(docs, ["moron", "threatening", "tion"], (200, 5000), 1, [], exempt, F.col("text"), F.col("n_chars"), F.col("quality"), F.lit(""))
    ranked = kept.withColumn("quality", F.when(~exempt, F.col("quality")))
    return ranked.orderBy(exempt.cast("int"), F.desc("relevance"), F.desc_nulls_last("quality"), "doc_id").select("doc_id", "source", "relevance", "quality")


PHRASES = ["the", "of the", "mo", "in the", "ofthe", "and", "ungen", "el la"]
PHRASE_SQL = """
WITH p(phrase, o) AS (VALUES ('the', 0), ('of the', 1), ('mo', 2), ('in the', 3), ('ofthe', 4), ('and', 5), ('ungen', 6), ('el la', 7)),
t AS (SELECT doc_id, source, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents),
m AS (SELECT doc_id, arg_min(phrase, (-length(phrase), o)) AS matched FROM t JOIN p ON contains(t, ' ' || phrase || ' ') GROUP BY doc_id)"""


@query("longest_phrase_match", f"{PHRASE_SQL} SELECT doc_id, matched FROM t LEFT JOIN m USING (doc_id)")
def longest_phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest catalog phrase that stands in each text as whole words."""
    phrases = spark.createDataFrame([(p, i) for i, p in enumerate(PHRASES)], "phrase string, o int")
    return R.longest_phrase(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), phrases, "phrase", "o")


@query("metric_enrich_bypass", f"{PHRASE_SQL} SELECT doc_id, source, CASE WHEN source = 'src0' THEN '' ELSE coalesce(matched, '') END AS matched, CASE WHEN source <> 'src0' THEN length(matched) END AS metric FROM t LEFT JOIN m USING (doc_id)")
def metric_enrich_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the metric of their longest phrase; one source is left without."""
    docs = table(spark, sf_dir, "documents")
    phrases = spark.createDataFrame([(p, i) for i, p in enumerate(PHRASES)], "phrase string, o int")
    found = docs.select("doc_id", "source").join(R.longest_phrase(docs, "doc_id", F.col("text"), phrases, "phrase", "o"), "doc_id")
    exempt = F.col("source") == "src0"
    return found.select("doc_id", "source", F.when(exempt, "").otherwise(F.coalesce("matched", F.lit(""))).alias("matched"), F.when(~exempt, F.length("matched")).cast("long").alias("metric"))


@query(
    "membership_counts_left",
    """SELECT c_custkey, c_name, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey, c_name""",
)
def membership_counts_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members per group; groups without any count zero."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"))
    joined = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"))


@query(
    "not_exists_auto_members",
    """SELECT c_custkey FROM customer c WHERE c_mktsegment <> 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
)
def not_exists_auto_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records outside a source that no exclusion names."""
    excluded = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").join(excluded, "c_custkey", "left_anti").select("c_custkey")


@query(
    "upsert_keep_last",
    """WITH new AS (SELECT p_partkey, upper(p_name) AS p_name FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey + 1000000, p_name FROM part WHERE p_partkey % 50 = 0)
SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM new) UNION ALL SELECT * FROM new""",
)
def upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog after a batch of updates and inserts."""
    old = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    new = old.filter("p_partkey % 7 = 0").withColumn("p_name", F.upper("p_name")).unionByName(old.filter("p_partkey % 50 = 0").withColumn("p_partkey", F.col("p_partkey") + 1000000))
    return R.upsert(old, new, ["p_partkey"])


@query(
    "insert_or_ignore",
    """SELECT c_nationkey AS nation, c_custkey AS member, 'old' AS origin FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_nationkey, c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0""",
)
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships after an insert that keeps what is there."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("member"))
    old, new = rows.filter("member % 3 = 0").withColumn("origin", F.lit("old")), rows.filter("member % 2 = 0").withColumn("origin", F.lit("new"))
    return R.insert_or_ignore(old, new, ["nation", "member"])


@query(
    "delete_with_cleanup",
    """SELECT o_orderkey, count(l_linenumber) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_partkey % 10 <> 0 WHERE o_custkey % 11 <> 0 GROUP BY o_orderkey""",
)
def delete_with_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines after deleting some customers and some parts."""
    orders = R.delete_rows(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").filter("c_custkey % 11 = 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])
    lines = R.delete_rows(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"])
    counted = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("lines"))
    return orders.select("o_orderkey").join(counted, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("snapshot_states", "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 'active' ELSE 'missing' END AS status, c_custkey % 5 = 0 AND c_custkey % 4 <> 0 AS added FROM customer WHERE NOT (c_custkey % 5 = 0 AND c_custkey % 4 = 0)")
def snapshot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of a collection: what is active, missing, added."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    return R.snapshot_states(rows.filter("c_custkey % 5 <> 0"), rows.filter("c_custkey % 4 <> 0"), "c_custkey")


@query(
    "entity_resolution_status",
    """WITH known AS (SELECT p_partkey::VARCHAR AS id, lower(p_name) AS doi_key, lower(p_brand || p_type) AS title_key FROM part WHERE p_partkey % 3 <> 0),
c AS (SELECT p_partkey AS cand, p_partkey::VARCHAR AS self_id, CASE WHEN p_partkey % 5 = 0 THEN (p_partkey + 1)::VARCHAR END AS id_key, lower(p_name) AS doi_key, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand || p_type) ELSE '' END AS title_key FROM part),
f AS (SELECT cand, id AS target, min(way) AS way FROM (
  SELECT cand, id, 0 AS way FROM c JOIN known ON id = id_key UNION ALL SELECT cand, id, 1 FROM c JOIN known k ON k.doi_key = c.doi_key AND c.doi_key <> ''
  UNION ALL SELECT cand, id, 2 FROM c JOIN known k ON k.title_key = c.title_key AND c.title_key <> '') GROUP BY ALL),
g AS (SELECT cand, count(*) AS n, min(target) AS target, min(way) AS way FROM f GROUP BY cand),
s AS (SELECT c.cand, n, target, way, CASE WHEN n IS NULL THEN 'candidate' WHEN n = 1 AND target = self_id THEN 'rejected' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM c LEFT JOIN g USING (cand))
SELECT cand, status, CASE WHEN n = 1 THEN target END AS target, CASE status WHEN 'candidate' THEN 0.6::DOUBLE WHEN 'rejected' THEN 0.0 WHEN 'ambiguous' THEN 0.4 ELSE CASE WHEN way < 2 THEN 1.0 ELSE 0.9 END END AS confidence FROM s""",
)
def entity_resolution_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates resolved against a catalog by id, name and title key."""
    parts = table(spark, sf_dir, "part")
    keys = parts.select("p_partkey", F.col("p_partkey").cast("string").alias("id"), F.lower("p_name").alias("doi_key"), F.lower(F.concat("p_brand", "p_type")).alias("title_key"))
    candidates = keys.select(
        F.col("p_partkey").alias("cand"), F.col("id").alias("self_id"), F.when(F.col("p_partkey") % 5 == 0, (F.col("p_partkey") + 1).cast("string")).alias("id_key"), "doi_key",
        F.when(F.col("p_partkey") % 2 == 0, F.col("title_key")).otherwise("").alias("title_key"),
    )
    return R.resolve(candidates, keys.filter("p_partkey % 3 <> 0").drop("p_partkey"))


METADATA_CTE = """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name END AS title, CASE p_partkey % 4 WHEN 0 THEN '19' WHEN 1 THEN NULL ELSE (1980 + p_size)::VARCHAR END AS year,
 CASE p_partkey % 5 WHEN 0 THEN lower(p_type) WHEN 1 THEN p_type || chr(10) || p_name WHEN 2 THEN repeat(p_type, 30) ELSE p_type END AS venue, CASE p_partkey % 3 WHEN 0 THEN '10.1234/' || p_partkey WHEN 1 THEN p_brand ELSE '' END AS doi FROM part)"""


@query(
    "metadata_warnings",
    METADATA_CTE + r"""SELECT p_partkey, array_to_string(list_filter([CASE WHEN trim(coalesce(year, '')) <> '' AND NOT (regexp_full_match(trim(year), '\d{4}') AND coalesce(try_cast(trim(year) AS INT) BETWEEN 2000 AND 2030, false)) THEN 'year_out_of_range' END,
 CASE WHEN length(trim(venue)) > 200 OR contains(trim(venue), chr(10)) THEN 'venue_looks_like_body_text' WHEN regexp_matches(trim(venue), '^\p{Ll}') THEN 'venue_may_be_truncated' END,
 CASE WHEN trim(doi) <> '' AND NOT regexp_full_match(trim(doi), '10\.\d{4,9}/\S+') THEN 'doi_format_invalid' END,
 CASE WHEN trim(coalesce(title, '')) = '' THEN 'title_missing' END], lambda x: x IS NOT NULL), ',') AS warnings FROM r""",
)
def metadata_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What looks wrong with each record's fields."""
    part, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    title = F.when(n % 9 == 0, "").otherwise(F.col("p_name"))
    year = F.when(n % 4 == 0, "19").when(n % 4 != 1, (1980 + F.col("p_size")).cast("string"))
    venue = F.when(n % 5 == 0, F.lower("p_type")).when(n % 5 == 1, F.concat("p_type", F.lit("\n"), "p_name")).when(n % 5 == 2, F.repeat("p_type", 30)).otherwise(F.col("p_type"))
    doi = F.when(n % 3 == 0, F.concat(F.lit("10.1234/"), n.cast("string"))).when(n % 3 == 1, F.col("p_brand")).otherwise("")
    return part.select("p_partkey", F.array_join(R.metadata_warnings(title, year, venue, doi, 2000, 2030), ",").alias("warnings"))


@query(
    "metadata_overwrite",
    """SELECT p_partkey, CASE WHEN (p_partkey % 3 <> 0 AND trim(p_type) <> '') OR trim(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END) = '' THEN p_type ELSE CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END END AS name FROM part""",
)
def metadata_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed fields over stored ones, but for those that a person set."""
    manual = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>"))
    current = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", R.overwrite(current, F.col("p_type"), "name", manual).alias("name"))


@query("manifest_diff", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'same' END AS change FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 5 = 0)")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a manifest compared by content hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("version"))
    old = docs.filter("doc_id % 7 <> 0")
    new = docs.filter("doc_id % 5 <> 0").withColumn("version", F.when(F.col("doc_id") % 3 == 0, F.concat("version", F.lit("*"))).otherwise(F.col("version")))
    return R.manifest_diff(old, new, "doc_id", "version")


@query("membership_violations", "SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def membership_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a request names but its scope doesn't hold."""
    allowed = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return R.missing_ids(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), allowed, "c_custkey")


@query("stable_ids", "SELECT p_partkey, 'entity:' || left(sha1(p_name || chr(31) || p_brand), 16) AS id, left(sha256(lower(p_name)), 16) AS record FROM part")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed ids of records."""
    return table(spark, sf_dir, "part").select("p_partkey", X.stable_id("entity", F.col("p_name"), F.col("p_brand")).alias("id"), X.record_id(F.lower("p_name")).alias("record"))


@query("record_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'bolt')")
def record_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a text in any of their fields."""
    return table(spark, sf_dir, "part").filter(F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lit("bolt"))).select("p_partkey")
