"""Text functions over whole tables, one query each: an id and the function's value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import tables as T
from scrivener.functions import text as X
from scrivener.registry import query
from scrivener.session import table
from scrivener.sources import landed

CJK_SQL = r"\x{4e00}-\x{9fff}"
#: Records that look like bibliographic ones: a column each, in Spark SQL that DuckDB reads too.
RECORDS = """SELECT p_partkey AS id, concat(' https://doi.org/10.1000/', upper(p_name), '., ') AS doi, concat('  The ', p_name, ' - ', p_type, '/', p_brand, ' （２） ') AS title,
 concat('seen (', CAST(1890 + p_size * 3 AS VARCHAR(10)), ') then 2', CAST(1000 + p_size AS VARCHAR(10)), '.', CAST(p_partkey % 100000 + 100000 AS VARCHAR(10)), 'v2') AS note,
 concat(p_brand, ', J.; ', p_name, ' & Ann B and ', p_type) AS names, concat('[', CAST(p_size AS VARCHAR(10)), ', 3-', CAST(p_size % 9 AS VARCHAR(10)), '; 7]') AS marks,
 concat('## ', CAST(p_size AS VARCHAR(10)), '. **', p_name, '** [a](b) `c` | ', p_type) AS md, concat('&lt;b&gt; ', p_name, ' &amp;amp;  &#233;&#x41; &nbsp;x &mdash; &unknown; &') AS quoted,
 concat('text {"a": ', CAST(p_size AS VARCHAR(10)), '} end ', p_name) AS answer, p_name AS name, p_type AS type, p_size AS size FROM part"""


def _column_query(name: str, value: Callable[[], Column], sql: str, doc: str) -> None:
    @query(name, f"SELECT id, {sql} AS value FROM ({RECORDS})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table(spark, sf_dir, "part").createOrReplaceTempView("__part")
        rows = spark.sql(RECORDS.replace("FROM part", "FROM __part"))
        return rows.select("id", value().alias("value"))

    run.__doc__ = doc


c = F.col
for _name, _value, _sql, _doc in (
    ("fn_normalize_identifier", lambda: X.normalize_identifier(c("doi")), "replace(replace(lower(trim(doi)), 'https://doi.org/', ''), 'doi:', '')", "Identifiers without their resolver."),
    ("fn_normalize_doi", lambda: X.normalize_doi(c("doi")), r"regexp_replace(regexp_replace(lower(trim(doi)), '^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', ''), '[.,;]+$', '')", "DOIs without resolver and closing signs."),
    ("fn_normalize_title", lambda: X.normalize_title(c("title")), rf"trim(regexp_replace(regexp_replace(lower(title), '\s+', ' ', 'g'), '[^a-z0-9{CJK_SQL} ]', '', 'g'))", "Titles for comparison."),
    ("fn_normalize_name", lambda: X.normalize_name(c("names")), f"regexp_replace(lower(names), '[^a-z0-9{CJK_SQL}]', '', 'g')", "Names for comparison."),
    ("fn_lexical_key", lambda: X.lexical_key(c("title")), r"trim(regexp_replace(regexp_replace(replace(replace(replace(lower(trim(title)), '（', '('), '）', ')'), '２', '2'), '[\s\-/]+', '_', 'g'), '[^\p{L}\p{N}_]', '', 'g'), '_')", "Words joined by underscores."),
    ("fn_type_label", lambda: X.type_label(F.when(c("size") % 5 != 0, F.concat(F.lit(" -"), F.upper("type"), F.lit(": ")))), "CASE WHEN size % 5 = 0 THEN 'entity' ELSE lower(type) END", "Labels of types."),
    ("fn_arxiv_id", lambda: X.arxiv_id(c("note")), r"regexp_extract(note, '(\d{4}\.\d{4,5})(?:v\d+)?', 1)", "Preprint ids."),
    ("fn_parse_year", lambda: X.parse_year(c("note")), r"try_cast(regexp_extract(note, '(?:19|20)\d{2}', 0) AS INT)", "The first year."),
    ("fn_keyword_tokens", lambda: F.array_join(X.keyword_tokens(c("title")), "|"), f"array_to_string(list_filter(string_split_regex(lower(title), '[^a-z0-9{CJK_SQL}]+'), lambda t: length(t) >= 2), '|')", "Keywords of two signs or more."),
    ("fn_word_set", lambda: F.array_join(F.array_sort(X.word_set(c("names"))), "|"), r"array_to_string(list_sort(list_distinct(regexp_extract_all(lower(names), '[\p{L}\p{N}_\-]+'))), '|')", "Distinct words."),
    ("fn_expand_numbers", lambda: F.array_join(X.expand_numbers(F.regexp_extract("marks", r"\[([^\]]*)\]", 1)).cast("array<string>"), ","), "array_to_string(list_sort(list_distinct([size::INT, 7] || CASE WHEN size % 9 >= 3 THEN range(3, size % 9 + 1)::INT[] ELSE []::INT[] END)), ',')", "Citation numbers, spans spelled out."),
    ("fn_normalize_quote", lambda: X.normalize_quote(c("quoted")), "concat('<b> ', name, ' &amp; éA x — &unknown; &')", "Quotes with entities decoded."),
    ("fn_strip_markdown", lambda: X.strip_markdown(c("md")), "concat(size::VARCHAR, '. ', name, ' a c ', type)", "Markdown without its signs."),
    ("fn_heading_key", lambda: X.heading_key(F.regexp_replace("md", r"^#+\s*|[*`|\[\]()]", "")), r"trim(regexp_replace(lower(concat(name, ' ab c  ', type)), '\s+', ' ', 'g'))", "Headings without numbers."),
    ("fn_short_label", lambda: X.short_label(F.concat_ws(" ", "name", "type", "name")), r"CASE WHEN length(array_to_string(string_split_regex(concat_ws(' ', name, type, name), '\s+')[1:4], ' ')) > 35 THEN rtrim(left(array_to_string(string_split_regex(concat_ws(' ', name, type, name), '\s+')[1:4], ' '), 34)) || '…' ELSE array_to_string(string_split_regex(concat_ws(' ', name, type, name), '\s+')[1:4], ' ') END", "Labels of four words."),
    ("fn_slug", lambda: X.slug(c("title")), r"trim(regexp_replace(lower(trim(title)), '[^\p{L}\p{N}]+', '-', 'g'), '-')", "Titles for addresses."),
    ("fn_clamp_confidence", lambda: X.clamp_confidence(F.when(c("size") % 7 == 0, "none").otherwise((c("size") / 30.0 - 0.2).cast("string"))), "CASE WHEN size % 7 = 0 THEN 0.5::DOUBLE ELSE round(greatest(0, least(1, size::DOUBLE / 30 - 0.2)), 4)::DOUBLE END", "Confidences between zero and one."),
    ("fn_claim_confidence", lambda: F.round(X.claim_confidence(c("size") / 50.0, c("size") % 4), 6), "round(least(size::DOUBLE / 50, 0.7 + 0.25 * least(1.0, (size % 4)::DOUBLE / 2)), 6)::DOUBLE", "Confidences capped by their quotes."),
    ("fn_lenient_json", lambda: F.get_json_object(X.lenient_json(c("answer")), "$.a").cast("int"), "size::INT", "A number from JSON within prose."),
    ("fn_author_names", lambda: F.array_join(X.author_names(c("names")), "|"), "concat(split_part(names, ', J.', 1), ', J.|', name, '|Ann B|', type)", "Author names."),
    ("fn_surname_keys", lambda: F.array_join(X.surname_keys(F.array(F.concat("name", F.lit(" Mc")), F.concat("type", F.lit(", Ann")))), "|"), "concat('mc|', lower(type))", "Surnames for comparison."),
    ("fn_is_excluded", lambda: X.is_excluded(F.when(c("size") % 3 == 0, "funding-statement"), F.when(c("size") % 4 == 0, "Acknowledgements"), F.when(c("size") % 5 == 0, F.concat(F.lit("## References\n"), "name")).otherwise(c("name"))), "size % 3 = 0 OR size % 4 = 0 OR size % 5 = 0", "What is no evidence."),
    ("fn_algorithm_block", lambda: X.is_algorithm_block(F.concat(F.when(c("size") % 2 == 0, "Require: x\n").otherwise("so\n"), F.lit("1: a\n2: b\n"), F.when(c("size") % 3 == 0, "3: c").otherwise("end"))), "size % 6 = 0", "Algorithm blocks."),
    ("fn_section_adjustment", lambda: F.round(X.section_adjustment("mechanism", F.when(c("size") % 3 == 0, "method").when(c("size") % 3 == 1, "result").otherwise("overview"), ["overview"]), 4), "CASE size % 3 WHEN 0 THEN 0.18::DOUBLE WHEN 1 THEN -0.15 ELSE 0.4 END", "What a section's kind adds."),
    ("fn_content_adjustment", lambda: F.round(X.content_adjustment("mechanism", F.concat(F.lit("Require: x\n1: a\n2: b\n3: c\n"), F.when(c("size") % 2 == 0, "Ensure: y").otherwise("")), ["method"]), 4), "CASE WHEN size % 2 = 0 THEN 0.65::DOUBLE ELSE 0.53 END", "What an algorithm block adds."),
    ("fn_analysis_language", lambda: X.analysis_language(F.concat("name", F.repeat(F.lit("中"), c("size").cast("int")))), f"CASE WHEN size >= 20 AND size / (size + length(regexp_replace(name, '[^A-Za-z]', '', 'g'))) >= 0.2 THEN 'zh' ELSE 'en' END", "The language of analysis."),
    ("fn_positions_text", lambda: landed.text_of_positions(F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(3)), F.col("name"), F.array(F.lit(0)), F.lit("c"), F.array(F.lit(2)))), "concat(name, ' b c b')", "Texts of inverted indexes."),
    ("fn_usable_text", lambda: landed.usable_text(F.repeat(F.concat("name", F.lit(" ")), c("size").cast("int")), 200), "length(replace(name, ' ', '')) * size >= 200", "Texts with enough signs."),
    ("fn_fingerprint", lambda: X.fingerprint(c("title")), "sha256(title)", "Hashes of texts."),
    ("fn_map_id", lambda: F.substring(F.sha2(F.concat_ws("\x1f", F.lower(F.trim("title")), F.lower(F.trim("name"))), 256), 1, 24), "left(sha256(concat_ws(chr(31), lower(trim(title)), lower(trim(name)))), 24)", "Ids of map entries."),
    ("fn_structure_id", lambda: F.substring(F.sha1(F.concat_ws("\n", F.lit("Root > A"), "type", c("size").cast("string"), "name")), 1, 16), "left(sha1(concat_ws(chr(10), 'Root > A', type, size::VARCHAR, name)), 16)", "Ids of structures."),
):
    _column_query(_name, _value, _sql, _doc)


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with citation marks at the ends of their lines, and a reference list behind them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(r"concat(regexp_replace(text, '[.]\n', ' [2, 4-5].\n'), '\n\n', '## References\n[1] First ', left(text, 20), '\n[2] Second (2001)\n', '[3]  Third\nline\n')").alias("text"))


CITED_SQL = r"concat(regexp_replace(text, '[.]\n', ' [2, 4-5].' || chr(10), 'g'), chr(10), chr(10), '## References', chr(10), '[1] First ', left(text, 20), chr(10), '[2] Second (2001)', chr(10), '[3]  Third', chr(10), 'line', chr(10))"


@query("reference_split", r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '[.]\n', ' [2, 4-5].' || chr(10), 'g'), '\s+$', ''))::INT AS body FROM documents")
def reference_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the reference list of each document starts."""
    body, _ = T.split_references(F.col("text"))
    return _cited(spark, sf_dir).select("doc_id", F.length(F.regexp_replace(body, r"\s+$", "")).alias("body"))


@query("reference_entries", r"SELECT doc_id, u.n::INT AS number, u.e AS entry FROM (SELECT doc_id, unnest([{'n': 1, 'e': trim(regexp_replace('First ' || left(text, 20), '\s+', ' ', 'g'))}, {'n': 2, 'e': 'Second (2001)'}, {'n': 3, 'e': 'Third line'}]) AS u FROM documents WHERE text IS NOT NULL)")
def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every reference list."""
    _, refs = T.split_references(F.col("text"))
    return T.reference_entries(_cited(spark, sf_dir).filter("text is not null").select("doc_id", refs.alias("refs")), "doc_id", "refs").select("doc_id", "number", "entry")


@query("citation_contexts", rf"SELECT doc_id, n::INT AS number, count(*) AS places FROM (SELECT doc_id, unnest([2, 4, 5]) AS n, unnest(range(len(regexp_extract_all(text, '[.]\n')))) AS k FROM documents) AS a(doc_id, n, k) GROUP BY ALL".replace("SELECT doc_id, unnest([2, 4, 5]) AS n, unnest(range(len(regexp_extract_all(text, '[.]\\n')))) AS k FROM documents) AS a(doc_id, n, k)", r"SELECT doc_id, n, k FROM (SELECT doc_id, unnest(range(len(regexp_extract_all(text, '[.]\n')))) AS k FROM documents), (VALUES (2), (4), (5)) AS v(n))"))
def citation_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document cites each number."""
    body, _ = T.split_references(F.col("text"))
    found = T.citation_contexts(_cited(spark, sf_dir).select("doc_id", body.alias("body")), "doc_id", "body")
    return found.groupBy("doc_id", "number").agg(F.count("*").alias("places"))
