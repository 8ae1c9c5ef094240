"""Queries of cards: verified payloads, how cards, relations and members are stored, and evidence as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.operators import cards as K
from scrivener.registry import query
from scrivener.session import table


@query(
    "verified_payloads",
    r"""WITH t AS (SELECT conv_id, turn, role, length(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) > 200 AS ok FROM conversations)
SELECT conv_id AS paper, count(*) FILTER (ok AND role <> 'user') AS accepted_claims, count(*) FILTER (role = 'user') AS incomplete_claims, count(*) FILTER (role <> 'user' AND NOT ok) AS unverified_claims, count(*) FILTER (ok) AS accepted_relations, 0::BIGINT AS incomplete_relations, count(*) FILTER (NOT ok) AS unverified_relations FROM t GROUP BY conv_id""",
)
def verified_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each conversation's payload can be verified: a claim and a relation per turn, with a quote of it or of none."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    ref = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    quote = F.when(F.length(F.regexp_replace("text", r"\s+", " ")) > 200, F.substring(F.trim("text"), 1, 50)).otherwise("it stands nowhere")
    evidence = F.array(F.struct(ref.alias("ref"), quote.alias("quote"))).alias("evidence")
    claim = F.struct(F.when(F.col("role") == "user", "").otherwise(F.col("role")).alias("subject"), F.lit("says").alias("predicate"), F.lit("it").alias("object"), F.lit("0.7").alias("confidence"), evidence)
    relation = F.struct(F.lit("cites").alias("relationType"), F.lit("x").alias("target_label"), evidence)
    text = F.to_json(F.struct(F.collect_list(claim).alias("claims"), F.collect_list(relation).alias("relationCandidates")))
    payloads = turns.groupBy(F.col("conv_id").alias("paper")).agg(text.alias("s")).select("paper", F.try_parse_json("s").alias("v"))
    known = turns.select(F.col("conv_id").alias("paper"), ref.alias("ref"), F.col("role").alias("section"), "text", F.lit("paper_text").alias("origin"), F.lit(1.0).alias("confidence"))
    return K.normalized_cards(payloads, known).diagnostics


@query("saved_cards", "SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_brand = 'Brand#1' THEN 'now' ELSE 'then' END AS created FROM part WHERE p_size > 25 OR p_brand <> 'Brand#1'")
def saved_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards after some were written anew: they keep when they were made."""
    part = table(spark, sf_dir, "part")
    old = part.filter("p_brand <> 'Brand#1'").select("p_partkey", F.col("p_name").alias("name"), F.lit("then").alias("created"))
    new = part.filter("p_size > 25").select("p_partkey", F.upper("p_name").alias("name"), F.lit(None).cast("string").alias("created"))
    return K.saved(old, new, "p_partkey", "created", F.lit("now"))


@query(
    "rewritten_relations",
    "SELECT DISTINCT l_suppkey, l_partkey, 'old' AS made FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal >= 0 UNION ALL SELECT DISTINCT l_suppkey, l_partkey, 'new' FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0 AND l_returnflag = 'R'",
)
def rewritten_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations after those of some sources were written anew, also of sources that have none any more."""
    lines = table(spark, sf_dir, "lineitem")
    old, new = lines.select("l_suppkey", "l_partkey").distinct(), lines.filter("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct()
    scope = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return K.rewritten(old.withColumn("made", F.lit("old")), new.withColumn("made", F.lit("new")), scope, ["l_suppkey"])


@query(
    "replaced_members",
    """WITH w AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'), m AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 100000)
SELECT o_custkey AS project, o_orderkey AS paper, 'member' AS state FROM w UNION ALL SELECT o_custkey, o_orderkey, 'member' FROM m WHERE o_custkey NOT IN (SELECT o_custkey FROM w)
UNION ALL SELECT o_custkey, o_orderkey, 'excluded' FROM orders WHERE o_custkey IN (SELECT o_custkey FROM w) AND o_orderkey NOT IN (SELECT o_orderkey FROM w)""",
)
def replaced_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of projects after a replacement, and the papers that are excluded by it."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("paper"), "o_orderstatus", "o_totalprice")
    members, excluded = K.replaced_members(orders.filter("o_totalprice > 100000"), orders.filter("o_orderstatus = 'F'"), orders.select("paper"), orders)
    return members.withColumn("state", F.lit("member")).unionByName(excluded.withColumn("state", F.lit("excluded")))


@query("committed_extractions", "SELECT event_id, CASE WHEN event_type = 'signup' AND value > 20 THEN 'committed' WHEN event_type = 'signup' THEN 'validated' ELSE event_type END AS status FROM events")
def committed_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged extractions after those that are validated and done were committed."""
    staged = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "signup", "validated").otherwise(F.col("event_type")).alias("status"))
    return K.committed(staged, table(spark, sf_dir, "events").filter("value > 20").select("event_id"), ["event_id"])


@query(
    "context_texts",
    r"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS body FROM conversations),
b AS (SELECT conv_id, n, '[' || n || '] ' || concat_ws(' · ', 'Talk ' || conv_id, '章节：' || role, CASE WHEN role = 'assistant' THEN '连续结构：answer 第 ' || (turn + 1) || ' 段' || CASE WHEN turn > 1 THEN '，承接上一片段' ELSE '' END END, CASE WHEN length(text) > 900 THEN '检索路径：知识图谱导航后已回查原文' END) || chr(10) || body AS b FROM t)
SELECT conv_id, sha256(string_agg(b, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n)) AS context FROM b GROUP BY conv_id""",
)
def context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as numbered contexts."""
    answer = F.col("role") == "assistant"
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"), F.lit(None).cast("int").alias("year"), F.col("role").alias("section"), F.when(answer, "s").alias("structure"), F.lit("answer").alias("kind"), F.col("turn").alias("seq"),
        F.when(answer & (F.col("turn") > 1), "s:0").alias("continues_from"), F.lit("").alias("continues_to"), (F.length("text") > 900).alias("by_graph"), "text",
    )
    return K.context(rows, "conv_id", "turn").select("conv_id", F.sha2("context", 256).alias("context"))


@query(
    "build_states",
    """WITH e AS (SELECT user_id, event_id, ts, value, event_type FROM events), s AS (SELECT user_id, max(event_id) AS m FROM e WHERE event_type = 'view' GROUP BY user_id),
f AS (SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(ts, event_id) AS completed_at FROM e JOIN s USING (user_id) WHERE event_type IN ('signup', 'error') AND event_id > m GROUP BY user_id)
SELECT s.user_id, e.value AS version, CASE kind WHEN 'signup' THEN 'ready' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, CASE kind WHEN 'error' THEN 'it failed' ELSE '' END AS error, e.ts AS started_at, completed_at
FROM s JOIN e ON e.user_id = s.user_id AND e.event_id = m LEFT JOIN f ON f.user_id = s.user_id""",
)
def build_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds after a log of starts and ends: a user is a paper, a view a start, a sign-up or an error an end."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "started").when(F.col("event_type").isin("signup", "error"), "finished")
    log = events.select("user_id", "event_id", "ts", F.col("value").alias("version"), kind.alias("kind"), F.when(F.col("event_type") == "signup", "ready").otherwise("failed").alias("status"), F.when(F.col("event_type") == "error", "it failed").alias("error"))
    return K.build_states(log, "user_id", "event_id", "kind", ["version"], "status", "error", "ts")
