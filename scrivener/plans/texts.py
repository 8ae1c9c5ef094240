"""Text queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivener.functions import chunks as C
from scrivener.functions import metadata as D
from scrivener.functions import tables as T
from scrivener.functions import text as X
from scrivener.registry import query
from scrivener.session import spread, table


@query("line_sections", "SELECT doc_id, i AS line, length(content)::INT AS chars FROM (SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))")
def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with its number and length."""
    return T.lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "line", F.length("content").alias("chars"))


@query(
    "token_estimate",
    r"""SELECT doc_id, list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]|[A-Za-z0-9]+(?:[+._/\-][A-Za-z0-9]+)*|[^\s]'), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z0-9]') THEN ceil(length(t) / 4)::BIGINT ELSE 1 END))::BIGINT AS tokens FROM documents""",
)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))


@query(
    "paragraph_summaries",
    r"""WITH l AS (SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
s AS (SELECT doc_id, i, trim(CASE WHEN length(regexp_extract(content, '^(.+?[.!?。！？])(?:\s|$)', 1)) >= 20 THEN regexp_extract(content, '^(.+?[.!?。！？])(?:\s|$)', 1) ELSE content END) AS t FROM l)
SELECT doc_id, i AS line, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(left(t, 117)) || '...' END AS summary FROM s""",
)
def paragraph_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead sentence of every paragraph, cut to a bound."""
    return T.lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "line", X.paragraph_summary(F.col("content")).alias("summary"))


@query("language_script_profile", "SELECT doc_id, (length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')))::BIGINT AS latin, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS script FROM documents")
def language_script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latin letters and script of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.regexp_count("text", F.lit("[A-Za-z]")).cast("long").alias("latin"), X.script_language(F.col("text")).alias("script"))


@query(
    "majority_language_per_source",
    "SELECT source, arg_min(lang, (-n, f)) AS lang, sum(n)::BIGINT AS documents FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL) GROUP BY source",
)
def majority_language_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of most documents per source; of ties the one seen first."""
    votes = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("f"))
    return votes.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("f"))).alias("lang"), F.sum("n").alias("documents"))


@query("html_clean_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without their tags."""
    return table(spark, sf_dir, "pages").select("page_id", X.clean_text(F.col("html")).alias("text"))


@query(
    "page_headings",
    r"""SELECT page_id, i::INT AS place, h[2]::INT AS level, trim(regexp_replace(regexp_replace(regexp_extract(h, '>(.*)<', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS heading
FROM (SELECT page_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<h[1-6][^>]*>[^\n]*?</h[1-6]>') AS a FROM pages)) AS t, LATERAL (SELECT x AS h, string_split(x, '') AS hh) WHERE true""".replace("h[2]::INT", "substr(h, 3, 1)::INT"),
)
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of every page, in order."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<h[1-6][^>]*>[^\n]*?</h[1-6]>"), F.lit(0))).alias("place", "h"))
    return pages.select("page_id", F.col("place") + 1, F.substring("h", 3, 1).cast("int").alias("level"), X.clean_text(F.regexp_extract("h", ">(.*)<", 1)).alias("heading")).toDF("page_id", "place", "level", "heading")


@query("page_links", r"""SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


@query(
    "url_normalize_distinct",
    r"""SELECT regexp_replace(lower(regexp_replace(url, '[?#].*$', '')), '^https?://(?:www\.)?|/+$', '', 'g') AS address, min(page_id) AS page_id, count(*) AS pages FROM pages GROUP BY 1""",
)
def url_normalize_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses without scheme, query and fragment; the first page of each."""
    address = F.regexp_replace(F.lower(F.regexp_replace("url", r"[?#].*$", "")), r"^https?://(?:www\.)?|/+$", "")
    return table(spark, sf_dir, "pages").groupBy(address.alias("address")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages"))


@query(
    "secret_redaction_counts",
    r"""SELECT doc_id, sha256(r) AS redacted FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '(?i)(authorization\s*[:=]\s*bearer\s+)[^\s,;]+', '\1***', 'g'), '(?i)((?:api[_ -]?key|token|secret)\s*[:=]\s*)[^\s,;]+', '\1***', 'g'), '\bsk-[A-Za-z0-9_-]{8,}\b', 'sk-***', 'g') AS r FROM documents) WHERE r <> text""",
)
def secret_redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a credential, and a hash of them without it."""
    masked = table(spark, sf_dir, "documents").select("doc_id", "text", X.redact(F.col("text")).alias("r"))
    return masked.filter("r <> text").select("doc_id", F.sha2("r", 256).alias("redacted"))


@query(
    "chunk_continuity",
    """SELECT conv_id, turn, lag(turn) OVER w AS continues_from, lead(turn) OVER w AS continues_to, row_number() OVER w::INT AS part, count(*) OVER (PARTITION BY conv_id) AS parts, lag(turn) OVER w IS NULL AS is_start, lead(turn) OVER w IS NULL AS is_end
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"),
)
def chunk_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation linked to the ones before and after."""
    return T.continuity(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query(
    "history_projection_last_n",
    """SELECT conv_id, turn, role, left(trim(text), 200) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '') WHERE r <= 8""",
)
def history_projection_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight turns of user and assistant per conversation."""
    turns = table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant') and trim(coalesce(text, '')) <> ''")
    last = turns.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("r <= 8")
    return last.select("conv_id", "turn", "role", F.substring(F.trim("text"), 1, 200).alias("text"))


@query(
    "drop_failed_turns",
    """WITH t AS (SELECT *, role = 'assistant' AND length(text) % 5 = 0 AS failed FROM conversations WHERE role IN ('user', 'assistant')),
n AS (SELECT *, lead(failed) OVER (PARTITION BY conv_id ORDER BY turn) AS next_failed FROM t)
SELECT conv_id, turn, role FROM n WHERE NOT failed AND NOT (role = 'user' AND coalesce(next_failed, false))""",
)
def drop_failed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without failed answers and the questions before them."""
    turns = table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')")
    turns = turns.withColumn("failed", (F.col("role") == "assistant") & (F.length("text") % 5 == 0))
    turns = turns.withColumn("next_failed", F.lead("failed").over(Window.partitionBy("conv_id").orderBy("turn")))
    return turns.filter(~F.col("failed") & ~((F.col("role") == "user") & F.coalesce("next_failed", F.lit(False)))).select("conv_id", "turn", "role")


@query("turn_islands", "SELECT conv_id, island::BIGINT AS island, count(*) AS turns FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT *, CASE WHEN lag(length(text) > 200) OVER w IS NULL OR lag(length(text) > 200) OVER w = (length(text) > 200) THEN 0 ELSE 1 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))) GROUP BY ALL")
def turn_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent turns of a kind grouped: long ones and short ones."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") > 200).alias("long"))
    return T.islands(rows, ["conv_id"], "turn", ["long"]).groupBy("conv_id", "island").agg(F.count("*").alias("turns"))


MARKDOWN_SQL = "'# ' || left(text, 12) || chr(10) || replace(text, '.' || chr(10), '.' || chr(10) || '## Part' || chr(10))"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: a title and a heading before each paragraph."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("concat('# ', left(text, 12), '\n', replace(text, '.\n', '.\n## Part\n'))").alias("text"))


@query(
    "markdown_sections",
    rf"""WITH l AS (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split({MARKDOWN_SQL}, chr(10)) AS l FROM documents)),
h AS (SELECT *, regexp_matches(c, '^\s{{0,3}}(#{{1,6}})\s+(.+?)\s*#*\s*$') AS is_h FROM l),
s AS (SELECT *, sum(is_h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h)
SELECT doc_id, section::BIGINT AS section, coalesce(max(CASE WHEN is_h THEN length(regexp_extract(c, '^\s{{0,3}}(#{{1,6}})', 1)) END), 0)::INT AS level, min(i)::INT AS line, count(*) FILTER (NOT is_h) AS lines FROM s GROUP BY doc_id, section""",
)
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents by heading."""
    found = T.sections(_markdown(spark, sf_dir), "doc_id", "text")
    counted = T.lines(_markdown(spark, sf_dir), "doc_id", "text")
    counted = counted.withColumn("h", F.col("content").rlike(T.HEADING)).withColumn("section", F.sum(F.col("h").cast("int")).over(Window.partitionBy("doc_id").orderBy("line")))
    counted = counted.groupBy("doc_id", "section").agg(F.count_if(~F.col("h")).alias("lines"))
    return found.join(counted, ["doc_id", "section"]).select("doc_id", "section", "level", "line", "lines")


PATH_PARTS = ", ".join(f"CASE WHEN s{k} > greatest(-1{''.join(f', coalesce(s{j}, -1)' for j in range(1, k))}) THEN h{k} END" for k in range(1, 7))
LAST_PARTS = ", ".join(f"max(CASE WHEN level = {k} THEN section END) OVER w AS s{k}, last_value(CASE WHEN level = {k} THEN heading END IGNORE NULLS) OVER w AS h{k}" for k in range(1, 7))


@query(
    "heading_paths",
    rf"""WITH l AS (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split({MARKDOWN_SQL}, chr(10)) AS l FROM documents)),
h AS (SELECT *, regexp_matches(c, '^\s{{0,3}}(#{{1,6}})\s+(.+?)\s*#*\s*$') AS is_h FROM l),
n AS (SELECT *, sum(is_h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h),
s AS (SELECT doc_id, section::BIGINT AS section, coalesce(max(CASE WHEN is_h THEN length(regexp_extract(c, '^\s{{0,3}}(#{{1,6}})', 1)) END), 0)::INT AS level, max(CASE WHEN is_h THEN regexp_extract(c, '^\s{{0,3}}(#{{1,6}})\s+(.+?)\s*#*\s*$', 2) END) AS heading FROM n GROUP BY doc_id, section),
w AS (SELECT doc_id, section, {LAST_PARTS} FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY section))
SELECT doc_id, section, concat_ws(' > ', {PATH_PARTS}) AS path FROM w""",
)
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with the headings above them."""
    return T.heading_paths(T.sections(_markdown(spark, sf_dir), "doc_id", "text"), "doc_id").select("doc_id", "section", "path")


@query("chunk_pack")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into chunks of about five hundred tokens with overlap. Each chunk depends on the one before."""
    return T.token_chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "chunk", "tokens", "overlap_tokens", F.sha2("content", 256).alias("content"))


@query("text_windows")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into overlapping character windows. Each window depends on the one before."""
    return T.text_windows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "window", "line", F.length("content").alias("chars"))


@query(
    "batches_by_cost",
    """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text)::BIGINT AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
f AS (SELECT conv_id, turn, cost, r, 0 AS batch, 1 AS n, cost AS c FROM t WHERE r = 1
UNION ALL SELECT t.conv_id, t.turn, t.cost, t.r, CASE WHEN f.n >= 3 OR f.c + t.cost > 600 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n >= 3 OR f.c + t.cost > 600 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 3 OR f.c + t.cost > 600 THEN t.cost ELSE f.c + t.cost END
FROM f JOIN t ON t.conv_id = f.conv_id AND t.r = f.r + 1) SELECT conv_id, turn, cost, batch FROM f""",
)
def batches_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation packed into batches by count and length."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("cost"))
    return T.greedy_batches(turns, "conv_id", "turn", "cost", 600, 3)


@query("earliest_years", r"SELECT page_id, list_min(list_transform(regexp_extract_all(left(url, 4000), '(?:^|[^0-9])((?:19|20)\d{2})(?:$|[^0-9])', 1), lambda y: y::INT)) AS year FROM pages")
def earliest_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest plausible year in each page's address."""
    return table(spark, sf_dir, "pages").select("page_id", X.earliest_year(F.col("url")).alias("year"))


NAMES = ("Related Work", "Our Approach", "Limitations", "Benchmark Suite", "System Design", "Preface")


@query(
    "section_kinds",
    """SELECT kind, count(*) AS n FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'comparison' WHEN 1 THEN 'method' WHEN 2 THEN 'discussion' WHEN 3 THEN 'experiment' WHEN 4 THEN 'implementation' ELSE 'background' END AS kind FROM part) GROUP BY kind""",
)
def section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the kind of section that their heading path names."""
    path = F.concat(F.lit("A Framework for Training > "), F.get(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 6).cast("int")))
    return table(spark, sf_dir, "part").groupBy(X.section_kind(path).alias("kind")).agg(F.count("*").alias("n"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents below headings as blocks; lines that number steps belong to a structure of their section."""
    found = T.heading_paths(T.sections(_markdown(spark, sf_dir), "doc_id", "text"), "doc_id").filter("content <> ''")
    lines = found.select("doc_id", "section", "path", "heading", F.posexplode(F.split("content", "\n")).alias("at", "content"))
    numbered = F.col("content").rlike(r"^\s*(?:[-*]|\d+[.)])\s")
    return lines.select(
        "doc_id", (F.col("section") * 1_000_000 + F.col("at")).alias("ordinal"), "path", "content", F.col("heading").alias("summary"),
        F.when(numbered, "list").otherwise("prose").alias("kind"), F.when(numbered, F.concat(F.lit("list-"), F.col("section").cast("string"))).alias("structure"),
    )


@query("structured_chunks")
def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of one heading path, structure and kind each. Each chunk depends on the one before."""
    chunks = C.structured_chunks(_blocks(spark, sf_dir), "doc_id")
    return chunks.select("doc_id", "chunk", "section", "kind", "structure", F.sha2("content", 256).alias("content"), "tokens", "overlap_tokens", F.size("blocks").alias("blocks"), "summary", "continues_from", "continues_to")


@query("chunk_overlaps")
def chunk_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that each packed chunk shares with the one before it, as measured on the texts."""
    chunks = C.measured_chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")
    return chunks.select("doc_id", "chunk", "tokens", F.col("overlap_tokens").alias("carried"), "shared")


PIECES_SQL = "SELECT doc_id, source, i AS piece, list_slice(w, 60 * i + 1, 60 * i + 80) AS w FROM (SELECT doc_id, source, w, unnest(range(0, greatest(ceil((len(w) - 20) / 60.0), 1)::INT)) AS i FROM (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[㐀-䶿一-鿿]|[A-Za-z0-9]+(?:[+._/\\-][A-Za-z0-9]+)*|[^ \\t\\n\\x0B\\f\\r]') AS w FROM documents) WHERE len(w) > 0)"


@query(
    "measured_overlap_stats",
    f"""WITH p AS ({PIECES_SQL}), l AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY piece) AS b FROM p),
s AS (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE coalesce(list_max(list_filter(range(1, least(len(w), len(b)) + 1), lambda k: b[len(b) - k + 1:] = w[:k])), 0) END AS shared FROM l)
SELECT source, count(*) AS chunks, count(DISTINCT doc_id) AS documents, round(avg(len(w)), 4) AS mean_tokens, max(len(w))::INT AS most_tokens, count(*) FILTER (shared > 0) AS overlapping, sum(shared)::BIGINT AS shared_tokens, count(*) FILTER (len(w) < 80) AS structured FROM s GROUP BY source""",
)
def measured_overlap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of pieces of eighty tokens that begin every sixty, as measured on their texts: more where a text repeats itself."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(T.WEIGHED.pattern), F.lit(0))
    # Texts are dealt out by document before they are cut, as they are smaller than their pieces; the window takes them as dealt.
    words = table(spark, sf_dir, "documents").select("doc_id", "source", "text").repartition("doc_id").select("doc_id", "source", found.alias("w"))
    n = F.size("w")
    # Texts are cut before they become rows: a row has its piece alone, not all words of its text, and each word is looked up
    # once per piece. A text without words has no pieces; as a filter that would be pushed down to list the words twice.
    piece = lambda i: F.transform(F.sequence(i * 60, F.least(i * 60 + 79, n - 1)), lambda j: F.get("w", j))
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((n - 20) / 60), F.lit(1)).cast("int") - 1), piece))
    pieces = words.select("doc_id", "source", F.posexplode(cut).alias("piece", "w"))
    chunks = C.with_overlaps(pieces.withColumn("tokens", F.size("w")), "doc_id", "piece", "w")
    return C.overlap_statistics(chunks, ["source"], "doc_id", "tokens", F.col("tokens") < 80)


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers in Markdown: authors below the title, an abstract, keywords, and a place where it appeared."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    head = F.concat(F.lit("# "), F.regexp_replace(F.substring("text", 1, 60), r"\s+", " "), F.lit("\n"), F.initcap("source"), F.lit(" A., Ann and "), F.upper("lang"), F.lit("\n\n"))
    place = F.when(F.col("n_chars") > 2000, F.lit("> IEEE Transactions on `Data` Streams ")).when(F.col("n_chars") > 800, F.lit("In Proceedings of the [tenth](http://x.org) Meeting, ")).otherwise(F.lit("Letters "))
    return docs.select("doc_id", F.concat(head, place, (1950 + F.col("n_chars") % 70).cast("string"), F.lit(", doi:10.1234/ab."), F.col("doc_id").cast("string"), F.lit(".\n\nAbstract: "), "text", F.lit("\n  Keywords: a\n"), "text").alias("text"))


@query("markdown_metadata")
def markdown_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, authors, year, DOI, venue and abstract of papers in Markdown."""
    return D.markdown_metadata(_papers(spark, sf_dir), "doc_id", "text")


@query("graph_windows")
def graph_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into windows by section, with a little overlap. Each window depends on the one before."""
    return C.graph_windows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", 2000, 200)
