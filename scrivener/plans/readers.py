"""Readers of landed payloads, over payloads that are written from the catalogue first: a round trip each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.registry import query
from scrivener.session import Scratch, table
from scrivener.sources import landed, sinks

PER_FILE = 500


def _landed(spark: SparkSession, sf_dir: str, item: Column, wrap) -> str:
    """The folder of payload files: items of parts, PER_FILE in each."""
    parts = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / PER_FILE).alias("file"), "p_partkey", item.alias("item"))
    files = parts.groupBy("file").agg(F.collect_list("item").alias("items"))
    path = f"{Scratch(spark).path}/payloads"
    files.select(wrap(F.col("items")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _shown(records: DataFrame) -> DataFrame:
    return records.select("source", "external_id", "title", F.array_join("authors", "|").alias("authors"), "abstract", "year", "venue", "doi", "url", "pdf_url")


def _sql(source: str, **columns: str) -> str:
    names = ("external_id", "title", "authors", "abstract", "year", "venue", "doi", "url", "pdf_url")
    return f"SELECT '{source}' AS source, " + ", ".join(f"{columns.get(n, 'NULL::INT' if n == 'year' else 'NULL::VARCHAR')} AS {n}" for n in names) + " FROM part"


@query("read_crossref", _sql("crossref", external_id="'10.1/P' || p_partkey", title="p_name", authors="'Ann ' || p_brand || '|Bo'", abstract="p_type || ' x'", year="CASE WHEN p_size % 2 = 0 THEN 1990 + p_size ELSE 1970 END::INT", venue="p_brand", doi="lower('10.1/P' || p_partkey)", url="'http://x/' || p_partkey"))
def read_crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of a JSON index, the year of the print before that of the entry."""
    date = lambda y: F.struct(F.array(F.array(y.cast("int"), F.lit(1))).alias("date-parts"))
    item = F.struct(
        F.concat(F.lit("10.1/P"), F.col("p_partkey").cast("string")).alias("DOI"), F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string")).alias("URL"), F.concat(F.lit("<p>"), "p_type", F.lit("</p>\n x")).alias("abstract"),
        F.array(F.concat(F.lit(" "), "p_name")).alias("title"), F.array("p_brand").alias("container-title"), F.array(F.struct(F.lit("Ann").alias("given"), F.col("p_brand").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("Bo").alias("family"))).alias("author"),
        F.when(F.col("p_size") % 2 == 0, date(1990 + F.col("p_size"))).alias("published-print"), date(F.lit(1970)).alias("created"),
    )
    path = _landed(spark, sf_dir, item, lambda items: F.to_json(F.struct(F.struct(items.alias("items")).alias("message"))))
    return _shown(landed.crossref(spark, path))


@query("read_open_index", _sql("open_index", external_id="'W' || p_partkey", title="p_name", authors="p_brand", abstract="split_part(p_name, ' ', 1) || ' b b'", year="(1990 + p_size)::INT", venue="p_type", doi="'10.2/x' || p_partkey", url="'http://y/' || p_partkey", pdf_url="CASE WHEN p_size % 2 = 0 THEN 'pdf' END") + " WHERE p_size % 5 <> 0")
def read_open_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open works of a JSON index, abstracts from inverted indexes, places with their fallbacks."""
    place = lambda pdf: F.struct(pdf.alias("pdf_url"), F.concat(F.lit("http://y/"), F.col("p_partkey").cast("string")).alias("landing_page_url"), F.struct(F.col("p_type").alias("display_name")).alias("source"))
    index = F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(2)), F.substring_index("p_name", " ", 1), F.array(F.lit(0)))
    item = F.struct(
        F.concat(F.lit("https://o.org/W"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("https://doi.org/10.2/X"), F.col("p_partkey").cast("string")).alias("doi"), F.col("p_name").alias("display_name"), (1990 + F.col("p_size")).alias("publication_year"),
        index.alias("abstract_inverted_index"), F.struct((F.col("p_size") % 5 != 0).alias("is_oa")).alias("open_access"), F.array(F.struct(F.struct(F.col("p_brand").alias("display_name")).alias("author"))).alias("authorships"),
        F.when(F.col("p_size") % 2 == 0, place(F.lit("pdf"))).alias("best_oa_location"), place(F.lit(None).cast("string")).alias("primary_location"),
    )
    return _shown(landed.open_index(spark, _landed(spark, sf_dir, item, lambda items: F.to_json(F.struct(items.alias("results"))))))


@query("read_ieee", _sql("ieee", external_id="p_partkey::VARCHAR", title="p_name", authors="'Cy ' || p_brand", abstract="p_type", year="(1990 + p_size)::INT", venue="p_brand", doi="'10.3/i'", url="CASE WHEN p_size % 3 = 0 THEN 'pdf' ELSE 'html' END", pdf_url="'pdf'"))
def read_ieee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a JSON interface."""
    item = F.struct(
        F.col("p_partkey").cast("string").alias("article_number"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"), (1990 + F.col("p_size")).cast("string").alias("publication_year"), F.col("p_brand").alias("publication_title"), F.lit("10.3/I").alias("doi"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise("html").alias("html_url"), F.lit("pdf").alias("pdf_url"), F.struct(F.array(F.struct(F.concat(F.lit("Cy  "), "p_brand").alias("full_name")), F.struct(F.lit(" ").alias("full_name"))).alias("authors")).alias("authors"),
    )
    return _shown(landed.ieee(spark, _landed(spark, sf_dir, item, lambda items: F.to_json(F.struct(items.alias("articles"))))))


@query("read_atom", _sql("atom", external_id="'2101.' || p_partkey", title="p_name || ' two'", authors="p_brand || '|B'", abstract="p_type", year="(1990 + p_size)::INT", url="'http://a/abs/' || p_partkey", pdf_url="'http://a/pdf/' || p_partkey"))
def read_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an Atom feed."""
    key = F.col("p_partkey").cast("string")
    item = F.concat(
        F.lit("<entry><id>http://a/2101."), key, F.lit("</id><title>"), F.col("p_name"), F.lit("\n  two</title><summary> "), F.col("p_type"), F.lit(" </summary><published>"), (1990 + F.col("p_size")).cast("string"), F.lit("-01-02T00:00:00Z</published><author><name>"),
        F.col("p_brand"), F.lit('</name></author><author><name>B</name></author><link href="http://a/abs/'), key, F.lit('" rel="alternate"/><link title="pdf" href="http://a/pdf/'), key, F.lit('" type="application/pdf"/></entry>'),
    )
    return _shown(landed.atom(spark, _landed(spark, sf_dir, item, lambda items: F.concat(F.lit("<feed>"), F.array_join(items, ""), F.lit("</feed>")))))


@query("read_medline", _sql("medline", external_id="p_partkey::VARCHAR", title="p_name", authors="'Jo ' || p_brand || '|The Group'", abstract="'First. ' || p_type", year="CASE WHEN p_size % 2 = 0 THEN 1990 + p_size ELSE 1998 END::INT", venue="p_brand"))
def read_medline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a MEDLINE batch."""
    year = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<Year>"), (1990 + F.col("p_size")).cast("string"), F.lit("</Year>"))).otherwise("<MedlineDate>1998 Dec-1999 Jan</MedlineDate>")
    item = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("p_partkey").cast("string"), F.lit("</PMID><Article><ArticleTitle>"), F.col("p_name"), F.lit("</ArticleTitle><Abstract><AbstractText>First.</AbstractText><AbstractText>"), F.col("p_type"),
        F.lit("</AbstractText></Abstract><AuthorList><Author><LastName>"), F.col("p_brand"), F.lit("</LastName><ForeName>Jo</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList><Journal><Title>"), F.col("p_brand"),
        F.lit("</Title><JournalIssue><PubDate>"), year, F.lit("</PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>"),
    )
    return _shown(landed.medline(spark, _landed(spark, sf_dir, item, lambda items: F.concat(F.lit("<S>"), F.array_join(items, ""), F.lit("</S>")))))


@query("read_journal_metrics", "SELECT p_name AS title, round(max(p_retailprice), 2) AS metric FROM part WHERE p_size % 4 <> 0 GROUP BY p_name")
def read_journal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a CSV with semicolons and decimal commas."""
    path = f"{Scratch(spark).path}/metrics"
    metric = F.when(F.col("p_size") % 4 == 0, "none").otherwise(F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(",")))
    table(spark, sf_dir, "part").select(F.col("p_name").alias("Title"), metric.alias("SJR")).write.option("header", True).option("sep", ";").csv(path)
    return landed.journal_metrics(spark, path).withColumn("metric", F.round("metric", 2))


@query("read_full_texts", "SELECT sha256(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn), '')) AS text, length(regexp_replace(string_agg(text, '' ORDER BY turn), '\\s+', '', 'g')) >= 800 AS usable FROM conversations WHERE text IS NOT NULL GROUP BY conv_id".replace("\\\\", "\\"))
def read_full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as texts, and whether they have enough signs."""
    path = f"{Scratch(spark).path}/texts"
    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    texts = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("value"))
    texts.select("value").write.option("maxRecordsPerFile", 1).option("lineSep", "\u0003").text(path)
    found = landed.full_texts(spark, path).withColumn("text", F.regexp_replace("text", "\u0003$", "")).filter("text <> ''")
    return found.select(F.sha2("text", 256).alias("text"), landed.usable_text(F.col("text")).alias("usable"))


@query("catalog_page", "SELECT p_partkey, p_brand AS short_name, p_name AS full_name, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS level, '会议' AS kind, p_type AS field FROM part")
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of catalogue pages, as lines and as cells."""
    level = F.when(F.col("p_size") % 3 == 0, "A").when(F.col("p_size") % 3 == 1, "B").otherwise("C")
    cells = F.array(F.lit("12"), F.col("p_brand"), F.col("p_name"), level, F.lit("会议"), F.col("p_type"))
    joined = F.array(F.concat(F.lit("7 "), F.col("p_brand")), F.col("p_name"), level, F.lit("会议"), F.col("p_type"))
    html = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<p>x</p><li>"), F.array_join(cells, "  "), F.lit("</li>"))).when(F.col("p_size") % 5 == 0, F.concat(F.lit("<td>"), F.array_join(joined, "</td><td>"), F.lit("</td>"))).otherwise(F.concat(F.lit("<tr><td>"), F.array_join(cells, "</td>\n<td>"), F.lit("</td></tr>")))
    return landed.catalog_page(table(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "p_partkey", "html")


@query("local_files", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '/b/' || p_partkey || '.pdf' ELSE '/a/' || replace(p_name, ' ', '_') || '-x' || p_partkey || '.pdf' END AS path, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 3 END AS score FROM part WHERE p_partkey % 3 = 0 OR p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_name HAVING count(*) = 1)".replace("p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_name HAVING count(*) = 1)", "false"))
def local_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each record, by its id in the file's name."""
    part = table(spark, sf_dir, "part")
    files = part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("/b/"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"))
    return landed.local_files(part, files, "p_partkey", "p_type").select("p_partkey", "path", "score")


@query("sharded_round_trip", "SELECT doc_id, sha256(text) AS text, left(sha256(doc_id::VARCHAR), 2) AS shard FROM documents")
def sharded_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published in shards, read again."""
    path = f"{Scratch(spark).path}/sharded"
    sinks.publish_sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), path, "doc_id")
    return spark.read.schema("doc_id long, text string, shard string").parquet(path).select("doc_id", F.sha2("text", 256).alias("text"), "shard")


@query(
    "best_files",
    """WITH f AS (SELECT '/files/' || n_name || '/' || lower(s_name) || '-' || n_name || '.pdf' AS path, lower(s_name) || '-' || lower(n_name) AS stem FROM supplier JOIN nation ON n_nationkey = s_nationkey),
r AS (SELECT s_suppkey, lower(s_name) AS id, lower(n_name) AS ext FROM supplier JOIN nation ON n_nationkey = s_nationkey),
s AS (SELECT s_suppkey, path, CASE WHEN contains(stem, id) THEN 4 ELSE 0 END + CASE WHEN contains(stem, ext) THEN 3 ELSE 0 END AS score FROM r, f)
SELECT s_suppkey, arg_min(path, (-score, path)) AS path, max(score)::INT AS score FROM s WHERE score > 0 GROUP BY s_suppkey""",
)
def best_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each supplier, by its name and its nation in the file's name."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    files = rows.select(F.concat(F.lit("/files/"), "n_name", F.lit("/"), F.lower("s_name"), F.lit("-"), "n_name", F.lit(".pdf")).alias("path"))
    records = rows.select("s_suppkey", F.col("s_name").alias("record"), F.lit("").alias("title"), F.col("n_name").alias("external_id"), F.lit(None).cast("string").alias("doi"))
    return landed.best_files(records, files, "s_suppkey", name="record")
