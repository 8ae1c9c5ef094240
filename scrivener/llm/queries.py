"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm.class_model import class_model_scores
from scrivener.llm.conversation_repair import damaged, repaired
from scrivener.llm.decontaminate import contaminated
from scrivener.llm.packing import packed_documents
from scrivener.llm.pseudonyms import pseudonymised
from scrivener.llm.quality_classifier import scored
from scrivener.llm.quality_rules import judged
from scrivener.llm.resampling import resampled
from scrivener.llm.sentence_spans import deduplicated
from scrivener.llm.simhash import near_duplicates
from scrivener.llm.sql import OP11_SQL, OP13_SQL
from scrivener.llm.token_counts import token_counts
from scrivener.llm.url_filter import judged_urls
from scrivener.llm.vector_tree import nearest
from scrivener.session import table

#: The rules and the block list of the registered URL query. The list has hosts that the pages have and hosts that they
#: haven't; an operator's caller brings a table of any size.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BLOCK_LIST = [
    f"{sub}{name}.example.{top}"
    for sub in ("", "www.", "m.", "blog.")
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
]

#: The key of the registered query; a caller of the operator brings a secret one.
DEMO_KEY = "a key for demonstration"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, DEMO_KEY)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = spark.createDataFrame([(x,) for x in BLOCK_LIST], "key string")
    return judged_urls(pages, URL_RULES, listed)


def op9_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model_scores(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


def op12_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), wanted=F.col("id") % 50 == 0)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


REGISTERED = (
    op1_feistel_pseudonyms,
    op2_best_fit_packing,
    op3_simhash_near_duplicates,
    op4_decontamination,
    op5_sentence_spans,
    op6_quality_rules,
    op7_token_counts,
    op8_url_filter,
    op9_class_model,
    op10_quality_classifier,
    op11_conversation_repair,
    op12_vector_tree,
    op13_importance_resampling,
)

OP8_SQL = r"""
WITH block_list AS (
  SELECT sub || name || '.example.' || top AS key
  FROM (VALUES (''), ('www.'), ('m.'), ('blog.')) AS s(sub), (VALUES ('ads-track'), ('adult-x'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) AS n(name),
       (VALUES ('com'), ('net'), ('org')) AS t(top)),
parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?:.|\n)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?:.|\n)*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
marked AS (
  SELECT *, host IN (SELECT key FROM block_list) AS listed,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
       listed
FROM marked
"""


def queries() -> dict:
    return {f.__name__: f for f in REGISTERED}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op13_importance_resampling": OP13_SQL}
