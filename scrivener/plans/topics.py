"""Queries of topics, labels, browsing filters and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivener.functions import labels as B
from scrivener.functions import text as X
from scrivener.operators import grounding as V
from scrivener.operators import library as L
from scrivener.registry import query
from scrivener.session import table

#: Titles that name a place in a paper and not its topic; and what such titles start with or hold.
GENERIC = ("abstract", "introduction", "background", "related work", "method", "methods", "results", "discussion", "conclusion", "references", "overview", "summary")
PREFIXES, WITHIN = ("appendix", "additional "), ("acknowledg", "funding", "conflict of interest", "author contribution")


def plain_title(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), r"^\d+(?:\.\d+)*\s*", ""), r"\s+", " "), r"^[ \-_#:.]+|[ \-_#:.]+$", "")


def is_generic(c: Column) -> Column:
    """Whether a title says nothing of its paper's topic."""
    low = F.lower(plain_title(c))
    out = (low == "") | low.isin(*GENERIC)
    for p in PREFIXES:
        out = out | low.startswith(p)
    for p in WITHIN:
        out = out | low.contains(p)
    return F.coalesce(out, F.lit(True))


def topic_phrase(c: Column) -> Column:
    """A phrase as a topic; null if it is generic or too short."""
    plain = F.regexp_replace(plain_title(c), r"^[A-Z]\s+", "")
    return F.when(~is_generic(c) & (F.length(plain) >= 3), plain)


@query("toc_filter", "SELECT p_partkey, p_size % 7 IN (0, 1, 2, 3) AS generic FROM part")
def toc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that are no topics."""
    size = F.col("p_size") % 7
    title = F.when(size == 0, "2.1  Related   Work:").when(size == 1, F.concat(F.lit("Appendix "), "p_name")).when(size == 2, F.concat("p_name", F.lit(" and Funding"))).when(size == 3, "3. ").otherwise(F.concat(F.lit("4 "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", is_generic(title).alias("generic"))


@query("topic_phrases", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_name ELSE p_type END AS phrase FROM part")
def topic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases as topics."""
    size = F.col("p_size") % 3
    given = F.when(size == 0, "1 Summary").when(size == 1, F.concat(F.lit("1.2 # "), "p_name", F.lit(" -"))).otherwise(F.concat(F.lit("B "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", topic_phrase(given).alias("phrase"))


@query("topic_scores", "SELECT topic, sum(w)::BIGINT AS score, count(DISTINCT p_partkey) AS documents FROM (SELECT p_partkey, p_name AS topic, 6 AS w FROM part UNION ALL SELECT p_partkey, p_brand, 1 FROM part UNION ALL SELECT p_partkey, p_type, CASE WHEN p_size % 3 + 1 <= 2 THEN 4 ELSE 1 END FROM part UNION ALL SELECT p_partkey, p_name || ' of ' || p_type, 5 FROM part) GROUP BY topic")
def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by their weighted places: 6 in a title, 1 as a keyword, 4 or 1 as a heading, 5 in an abstract."""
    part, rows = table(spark, sf_dir, "part"), None
    for phrase, worth in ((F.col("p_name"), F.lit(6)), (F.col("p_brand"), F.lit(1)), (F.concat(F.lit("2 "), "p_type"), F.when(F.col("p_size") % 3 + 1 <= 2, 4).otherwise(1)), (F.concat_ws(" of ", "p_name", "p_type"), F.lit(5))):
        one = part.select("p_partkey", topic_phrase(phrase).alias("topic"), worth.alias("w")).filter("topic is not null")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("topic").agg(F.sum("w").alias("score"), F.countDistinct("p_partkey").alias("documents"))


@query("relation_browser", "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE (p_brand = 'Brand#1' OR s_nationkey = 3) AND l_returnflag = 'A' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH') AND contains(lower(p_name || ' ' || s_name), 'r')")
def relation_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by the type of either end, their kind, their documents, and a text in their names."""
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_orderkey", "l_partkey", "l_suppkey")
    rows = rows.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name"), "l_partkey").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "s_name"), "l_suppkey")
    kept = rows.filter(((F.col("p_brand") == "Brand#1") | (F.col("s_nationkey") == 3)) & F.contains(F.lower(F.concat_ws(" ", "p_name", "s_name")), F.lit("r")))
    chosen = table(spark, sf_dir, "orders").filter("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("l_orderkey"))
    return kept.join(chosen, "l_orderkey", "left_semi").select("id", "l_partkey", "l_suppkey")


@query("card_browser", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, (1990 + p_size)::VARCHAR, p_brand, p_type)), 'brand#12')")
def card_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with a text in their title, year, or any facet's values."""
    cards = table(spark, sf_dir, "part").withColumn("facets", F.create_map(F.lit("maker"), F.array("p_brand"), F.lit("kind"), F.array("p_type")))
    text = F.concat_ws(" ", "p_name", (1990 + F.col("p_size")).cast("string"), F.concat_ws(" ", F.flatten(F.map_values("facets"))))
    return cards.filter(F.contains(F.lower(text), F.lit("brand#12"))).select("p_partkey")


@query("validation_inputs", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id % 4 <> 0 AND p.doc_id = d.doc_id AND sha256(p.text) = sha256(d.text)) OR (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def validation_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that is new since the last validation, or that supports what was missing then."""
    now = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    new = now.join(now.filter("doc_id % 4 <> 0"), ["doc_id", "h"], "left_anti").select("doc_id")
    missing = now.join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id")
    return new.union(missing).distinct()


@query("graph_summary", "SELECT 'nodes' AS what, count(*) AS n FROM part UNION ALL SELECT 'entities', count(*) FROM supplier UNION ALL SELECT 'relations', (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM orders) UNION ALL SELECT 'evidence', count(*) FROM documents")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes, entities, relations and pieces of evidence a graph has."""
    out = None
    for what, names in (("nodes", ["part"]), ("entities", ["supplier"]), ("relations", ["lineitem", "orders"]), ("evidence", ["documents"])):
        for name in names:
            one = table(spark, sf_dir, name).agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
            out = one if out is None else out.unionByName(one)
    return out.groupBy("what").agg(F.sum("n").alias("n"))


@query("recency_marker", "SELECT o_orderkey, greatest(strftime(o_orderdate, '%Y-%m-%d'), '1995-06-01', coalesce(max(strftime(l_shipdate, '%Y-%m-%d')), '')) AS marker FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def recency_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of three dates of a record."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(day("l_shipdate")).alias("s"))
    return table(spark, sf_dir, "orders").join(shipped, "o_orderkey", "left").select("o_orderkey", F.greatest(day("o_orderdate"), F.lit("1995-06-01"), F.coalesce("s", F.lit(""))).alias("marker"))


@query(
    "chunk_matches",
    "WITH s AS (SELECT doc_id, length(text)::INT AS chars, CASE WHEN contains(lower(source), 'src1') THEN 8 ELSE 0 END + CASE WHEN contains(lower(left(text, 200)), 'the') THEN 5 ELSE 0 END + CASE WHEN contains(lower(text), 'moron') THEN 3 ELSE 0 END AS score FROM documents) SELECT doc_id, score, chars FROM s WHERE score > 0 ORDER BY score DESC, chars DESC, doc_id LIMIT 18",
)
def chunk_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that fit a label best: by heading, summary and text, then by length."""
    worth = [(F.contains(F.lower("source"), F.lit("src1")), 8.0), (F.contains(F.lower(F.substring("text", 1, 200)), F.lit("the")), 5.0), (F.contains(F.lower("text"), F.lit("moron")), 3.0)]
    rows = table(spark, sf_dir, "documents").select("doc_id", X.worth(worth).cast("int").alias("score"), F.length("text").alias("chars"))
    return rows.filter("score > 0").orderBy(F.desc("score"), F.desc("chars"), "doc_id").limit(18)


@query("entity_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY lower(p_name), p_partkey)::INT AS place FROM part")
def entity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities in the order of their names within each type."""
    return table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_type").orderBy(F.lower("p_name"), "p_partkey")).alias("place"))


@query("scope_union", "SELECT p AS paper, min(o) AS first FROM (SELECT o_custkey AS p, o_orderkey AS o FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, o_orderkey + 1000000000 FROM orders WHERE o_orderpriority = '5-LOW') GROUP BY p")
def scope_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of several projects, each at its first place."""
    orders, rows = table(spark, sf_dir, "orders"), None
    for i, priority in enumerate(("1-URGENT", "5-LOW")):
        one = orders.filter(F.col("o_orderpriority") == priority).select(F.col("o_custkey").alias("paper"), (F.col("o_orderkey") + i * 10**9).alias("o"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("paper").agg(F.min("o").alias("first"))


@query("membership_changes", "SELECT count(*) FILTER (b AND NOT a) AS added, count(*) FILTER (a AND NOT b) AS removed FROM (SELECT c_custkey % 2 = 0 AS a, c_custkey % 3 = 0 AS b FROM customer)")
def membership_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many members a new selection adds and removes."""
    ids = table(spark, sf_dir, "customer").select("c_custkey")
    old, new = ids.filter("c_custkey % 2 = 0"), ids.filter("c_custkey % 3 = 0")
    added, removed = new.join(old, "c_custkey", "left_anti"), old.join(new, "c_custkey", "left_anti")
    return added.select(F.lit(1).alias("a")).unionByName(removed.select(F.lit(0).alias("a"))).agg(F.count_if(F.col("a") == 1).alias("added"), F.count_if(F.col("a") == 0).alias("removed"))


BOOLEAN = r"\b(?:AND|OR|NOT)\b"


@query("facet_queries", "SELECT p_partkey, concat_ws(' ', 'Red', CASE WHEN lower(split_part(p_name, ' ', 1)) <> 'red' THEN split_part(p_name, ' ', 1) END, split_part(p_name, ' ', 2), CASE WHEN lower(p_type) NOT IN ('red', lower(split_part(p_name, ' ', 1)), lower(split_part(p_name, ' ', 2))) THEN p_type END) AS query FROM part")
def facet_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets as queries: no operators, each word once whatever its case."""
    text = F.regexp_replace(F.concat_ws("\n", F.lit("Red AND"), "p_name", F.lit("OR red"), "p_type"), BOOLEAN, " ")
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}#]+"), F.lit(0))
    low = F.transform(words, lambda w: F.lower(w))
    firsts = F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(firsts, " ").alias("query"))


EXPANSIONS = {("overview", "framework", "background"): "complete workflow full framework", ("method", "protocol", "algorithm", "implementation"): "method protocol algorithm implementation steps"}


@query("facet_expansion", "SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN CASE p_size % 3 WHEN 0 THEN chr(10) || 'complete workflow full framework' WHEN 1 THEN chr(10) || 'method protocol algorithm implementation steps' ELSE '' END ELSE '' END AS query FROM part")
def facet_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries about mechanisms, with words for the sections they prefer."""
    kinds = F.array(F.when(F.col("p_size") % 3 == 0, "overview").when(F.col("p_size") % 3 == 1, "protocol").otherwise("result"))
    added = [F.when((F.col("p_size") % 2 == 0) & F.arrays_overlap(kinds, F.array(*map(F.lit, wanted))), words) for wanted, words in EXPANSIONS.items()]
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n", "p_name", *added).alias("query"))


def valid_title(title: Column, raw: Column, author: Column, year: Column) -> Column:
    """Whether a reference's title is one: neither too short or long, nor a number, an author, a year, or all of the reference."""
    compact, whole = F.trim(F.regexp_replace(F.regexp_replace(title, r"\s+", " "), r"^[ .,:;]+|[ .,:;]+$", "")), F.trim(F.regexp_replace(raw, r"\s+", " "))
    name = X.normalize_name(compact)
    bad = ~F.length(compact).between(4, 300) | compact.rlike(r"^\d+$") | (name == X.normalize_name(whole)) | ((F.length(whole) > 80) & (F.length(compact) / F.length(whole) > 0.88)) | (name == year.cast("string")) | (name == X.normalize_name(author))
    return ~F.coalesce(bad, F.lit(True))


@query("reference_titles", "SELECT p_partkey, p_size % 6 = 5 AS valid FROM part")
def reference_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of references that are titles."""
    raw = F.concat("p_brand", F.lit(". "), "p_name", F.lit(". 1999. "), F.repeat("p_type", 3))
    size = F.col("p_size") % 6
    title = F.when(size == 0, "1999").when(size == 1, F.col("p_brand")).when(size == 2, raw).when(size == 3, " x. ").when(size == 4, "123456").otherwise(F.concat("p_name", F.lit(" revisited")))
    return table(spark, sf_dir, "part").select("p_partkey", valid_title(title, raw, F.col("p_brand"), F.lit(1999)).alias("valid"))


@query("author_year_contexts", "SELECT p_partkey, 2 AS places FROM part")
def author_year_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where texts cite an author and a year."""
    text = F.concat("p_name", F.lit(" as Miller et al. (1995) say, MILLER, 1995; but Millers 1995 and Miller 1996 don't "), "p_type")
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:miller|other)\b(?:\s+et\s+al\.?)?\s*[,;(]?\s*\b1995\b"), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", F.least(F.size(found), F.lit(8)).alias("places"))


@query("document_topics", "SELECT p_partkey, concat_ws('|', p_name, CASE WHEN p_size % 2 = 0 THEN p_type END) AS topics FROM part")
def document_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of each document: its title, then its upper headings, each once."""
    heads = F.array(F.struct(F.lit(1).alias("level"), F.concat(F.lit("1 "), "p_name").alias("t")), F.struct((F.col("p_size") % 2 * 2 + 1).alias("level"), F.col("p_type").alias("t")), F.struct(F.lit(1).alias("level"), F.lit("Results").alias("t")))
    shown = F.transform(F.filter(heads, lambda h: h["level"] <= 2), lambda h: topic_phrase(h["t"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(F.filter(F.concat(F.array(topic_phrase(F.col("p_name"))), shown), lambda t: t.isNotNull())), "|").alias("topics"))


@query("catalog_texts", "SELECT p_partkey, 'Title: ' || p_name || chr(10) || 'Venue: ' || p_brand || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Year: ' || (1990 + p_size) ELSE '' END AS text FROM part")
def catalog_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as texts for a manifest, without the fields they lack."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n", line("Title", F.col("p_name")), line("Venue", F.col("p_brand")), F.when(F.col("p_size") % 2 == 0, line("Year", (1990 + F.col("p_size")).cast("string")))).alias("text"))


@query("type_language", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'entity' ELSE lower(p_type) END AS type FROM part")
def type_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types in the language of their map; others are replaced."""
    given = F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit(" 方法"))).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(given.rlike(rf"[{X.CJK}]"), "entity").otherwise(X.type_label(given)).alias("type"))


@query("card_repair", "SELECT p_partkey, lower(p_type) AS type FROM part WHERE p_size % 2 = 1 AND p_type <> lower(p_type)")
def card_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that change when they are normalised anew; the others aren't written."""
    stored = F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", stored.alias("stored"), X.type_label(stored).alias("type"))
    return rows.filter(~F.col("stored").eqNullSafe(F.col("type"))).select("p_partkey", "type")


@query("relation_repair", "SELECT l_returnflag AS type, p_partkey AS target, count(*) AS candidates, round(max(least(1 - l_discount, 1 - l_tax)), 4) AS confidence FROM lineitem JOIN part ON lower(p_name) = (SELECT lower(q.p_name) FROM part q WHERE q.p_partkey = l_partkey) AND p_partkey = (SELECT min(r.p_partkey) FROM part r WHERE lower(r.p_name) = lower(part.p_name)) GROUP BY ALL")
def relation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored relation candidates resolved anew to the first record of their target's name, and merged."""
    part = table(spark, sf_dir, "part")
    first = part.groupBy(X.lexical_key(F.col("p_name")).alias("k")).agg(F.min("p_partkey").alias("target"))
    rows = table(spark, sf_dir, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), X.lexical_key(F.col("p_name")).alias("k")), "l_partkey").join(first, "k")
    return rows.groupBy(F.col("l_returnflag").alias("type"), "target").agg(F.count("*").alias("candidates"), F.round(F.max(F.least(1 - F.col("l_discount"), 1 - F.col("l_tax"))), 4).alias("confidence"))


@query("attribute_merge", "SELECT l_partkey, l_shipmode AS name, first_value, n FROM (SELECT l_partkey, l_shipmode, arg_min(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS first_value, count(*) AS n FROM lineitem GROUP BY ALL)".replace("l_shipmode", "l_linestatus"))
def attribute_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of entities, the first value of each name."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_partkey", F.col("l_linestatus").alias("name")).agg(F.min_by("l_quantity", F.struct("l_orderkey", "l_linenumber", "l_quantity")).alias("first_value"), F.count("*").alias("n"))


@query("refinement_facets", "SELECT l_suppkey AS facet, count(*) AS gaps FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY l_suppkey ORDER BY gaps DESC, facet LIMIT 4")
def refinement_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facets to look for next: the known ones with most gaps."""
    gaps = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("facet")).agg(F.count("*").alias("gaps"))
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("facet"))
    return gaps.join(known, "facet", "left_semi").orderBy(F.desc("gaps"), "facet").limit(4)


@query(
    "graph_search",
    "WITH n AS (SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red')), r AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM n) OR l_returnflag = 'red') SELECT l_partkey AS node, count(*) AS relations, count(DISTINCT l_orderkey) AS evidence FROM r GROUP BY l_partkey",
)
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that match a text, the relations that match or touch them, and their evidence."""
    nodes = table(spark, sf_dir, "part").filter(F.contains(F.lower("p_name"), F.lit("red"))).select(F.col("p_partkey").alias("l_partkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    hits = rows.join(nodes, "l_partkey", "left_semi").union(rows.filter("l_returnflag = 'red'")).select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    return hits.groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("relations"), F.countDistinct("l_orderkey").alias("evidence"))


@query("profile_fingerprints", "SELECT o_custkey, left(sha256(string_agg(DISTINCT o_orderpriority, chr(31) ORDER BY o_orderpriority)), 24) AS fingerprint FROM orders GROUP BY o_custkey")
def profile_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each project's topics, whatever their order."""
    listed = F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "\x1f")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.substring(F.sha2(listed, 256), 1, 24).alias("fingerprint"))


@query("graph_pivots", "SELECT c_mktsegment AS domain, count(DISTINCT c_custkey) AS topics, count(DISTINCT o_orderkey) AS documents FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
def graph_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics and documents of each domain, through its edges."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "left")
    # Two levels, so that a domain's documents are counted where they lie.
    per = rows.groupBy("c_mktsegment", "c_custkey").agg(F.count("o_orderkey").alias("n"))
    return per.groupBy(F.col("c_mktsegment").alias("domain")).agg(F.count("*").alias("topics"), F.sum("n").alias("documents"))


@query("label_replacements", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_type ELSE p_name END AS label FROM part")
def label_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic labels replaced by their first specific candidate."""
    label = F.when(F.col("p_size") % 4 == 0, "Overview").otherwise(F.col("p_name"))
    specific = F.filter(F.array(F.lit("Summary"), F.col("p_type")), lambda c: ~is_generic(c))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(is_generic(label), F.get(specific, F.lit(0))).otherwise(label).alias("label"))


@query("imported_references", "SELECT p_partkey, '10.5/z' || p_partkey AS doi, (1990 + p_size)::INT AS year, p_name AS title, 'Ann B|' || p_brand AS authors FROM part")
def imported_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of references that were pasted as text."""
    raw = F.concat("p_name", F.lit("\nAnn B; "), "p_brand", F.lit("\nVenue "), (1990 + F.col("p_size")).cast("string"), F.lit(", https://doi.org/10.5/Z"), F.col("p_partkey").cast("string"), F.lit("."))
    lines = F.filter(F.split(raw, "\n"), lambda x: F.trim(x) != "")
    doi = X.normalize_doi(F.regexp_extract(raw, r"(10\.\d{1,9}/\S+)", 1))
    return table(spark, sf_dir, "part").select("p_partkey", doi.alias("doi"), X.parse_year(F.regexp_extract(raw, r"Venue .*", 0)).alias("year"), F.get(lines, F.lit(0)).alias("title"), F.array_join(X.author_names(F.get(lines, F.lit(1))), "|").alias("authors"))


GENERIC_SQL = ", ".join(f"'{t}'" for t in B.GENERIC_TITLES)
TOPIC_CTE = rf"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^,;:.()\n]+')) AS phrase FROM documents),
s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(phrase), '^\d+(?:\.\d+)*\s*', ''), '^[A-Z]\s+', ''), '\s+', ' ', 'g'), ' -_#') AS plain FROM l),
k AS (SELECT doc_id, plain, lower(plain) AS low, lower(trim(regexp_replace(regexp_replace(trim(plain), '^\d+(?:\.\d+)*\s*', ''), '\s+', ' ', 'g'), ' -_#:.')) AS core FROM s),
t AS (SELECT doc_id, plain, low FROM k WHERE NOT (low IN ('', {GENERIC_SQL}) OR starts_with(low, 'appendix') OR starts_with(low, 'additional ') OR low IN ('action', 'camera', 'implementation', 'derivation', 'study') OR length(plain) < 3
 OR core IN ('', {GENERIC_SQL}) OR starts_with(core, 'appendix') OR starts_with(core, 'additional ') OR regexp_matches(core, '{"|".join(B.NON_CORE)}')))"""


@query("phrase_topics", f"{TOPIC_CTE} SELECT doc_id, count(*) AS topics, count(DISTINCT low) AS different, count(*) FILTER (low IN ({', '.join(repr(w) for w in B.LABEL_WORDS)})) AS generic FROM t GROUP BY doc_id")
def phrase_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of whole texts that are topics, and how many of them are generic labels."""
    phrases = F.regexp_extract_all("text", F.lit(r"[^,;:.()\n]+"), F.lit(0))
    topics = F.filter(F.transform(phrases, lambda p: F.lower(B.topic(p))), lambda t: t.isNotNull())
    # A text's topics stay one row; only its different ones are shuffled.
    per = table(spark, sf_dir, "documents").select("doc_id", topics.alias("t"))
    per = per.select("doc_id", F.size("t").alias("topics"), F.array_distinct("t").alias("low"), F.size(F.filter("t", lambda t: t.isin(*B.LABEL_WORDS))).alias("generic"))
    found = per.groupBy("doc_id").agg(F.sum("topics").alias("topics"), F.size(F.array_distinct(F.flatten(F.collect_list("low")))).cast("long").alias("different"), F.sum("generic").alias("generic"))
    # Not before the sums: a filter on topics would be pushed down and work them out twice.
    return found.filter("topics > 0").select("doc_id", "topics", "different", "generic")


@query(
    "validated_answers",
    r"""WITH a AS (SELECT conv_id, turn, text || CASE WHEN length(text) > 500 THEN ' 12 % more.' || chr(10) || 'It is the first [2-3]!' WHEN length(text) > 200 THEN ' the fastest [1, 9]' ELSE ' end' END AS t FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
c AS (SELECT *, list_sort(list_distinct(list_filter([CASE WHEN contains(t, '[2-3]') THEN 2 END, CASE WHEN contains(t, '[2-3]') THEN 3 END, CASE WHEN contains(t, '[1, 9]') THEN 1 END], lambda x: x IS NOT NULL))) AS cited, string_split_regex(regexp_replace(t, '([。！？!?])', '\1' || chr(10), 'g'), '\n+') AS s FROM a),
u AS (SELECT *, len(list_filter(s, lambda x: x <> '' AND regexp_matches(x, '(?i)(?:\d+(?:\.\d+)?\s*(?:倍|%|％)|\bfirst\b|\bfastest\b|\bstate[- ]of[- ]the[- ]art\b)') AND NOT contains(x, '[2-3]') AND NOT contains(x, '[1, 9]'))) AS n FROM c)
SELECT conv_id * 1000 + turn AS answer, cited, n::INT AS uncited, array_to_string(list_filter([CASE WHEN len(cited) = 0 THEN 'no_citation' END, CASE WHEN NOT list_contains(cited, 3) THEN 'missing_group:3' END, CASE WHEN n > 0 THEN 'uncited_claim' END], lambda x: x IS NOT NULL), ' ') AS reasons FROM u""",
)
def validated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite some of three sources, of which the last must be cited, with claims that need a citation."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant' and text is not null")
    size = F.length("text")
    text = F.concat("text", F.when(size > 500, " 12 % more.\nIt is the first [2-3]!").when(size > 200, " the fastest [1, 9]").otherwise(" end"))
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer"), text.alias("text"), F.lit(3).alias("n"), F.array(F.array(F.lit(3), F.lit(8)), F.array(F.lit(7))).alias("groups"))
    found = V.validated(rows, "answer", "text", "n", None, F.col("groups"), F.lit(True))
    return found.select("answer", "cited", F.size("uncited").alias("uncited"), F.array_join("reasons", " ").alias("reasons"))
