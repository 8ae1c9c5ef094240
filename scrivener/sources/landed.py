"""Readers of landed bibliographic payloads. Each returns the columns of RECORD, lazily and with a stated schema.

Fetching is left to whoever lands the files; a reader takes any path that Spark reads and infers nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.session import Scratch

RECORD = ("source", "external_id", "title", "authors", "abstract", "year", "venue", "doi", "url", "pdf_url")
DATE = "struct<`date-parts`: array<array<int>>>"
ATOM = "id string, title string, summary string, published string, author array<struct<name: string>>, link array<struct<_href: string, _rel: string, _title: string, _type: string>>"
MEDLINE = (
    "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>, "
    "AuthorList: struct<Author: array<struct<LastName: string, ForeName: string, CollectiveName: string>>>, "
    "Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string, MedlineDate: string>>>>>"
)
CROSSREF = (
    "message struct<items: array<struct<DOI: string, URL: string, abstract: string, title: array<string>, `container-title`: array<string>, "
    f"author: array<struct<given: string, family: string>>, `published-print`: {DATE}, `published-online`: {DATE}, created: {DATE}>>>"
)
PLACE = "struct<pdf_url: string, landing_page_url: string, source: struct<display_name: string>>"
OPEN_INDEX = (
    "results array<struct<id: string, doi: string, display_name: string, publication_year: int, abstract_inverted_index: map<string, array<int>>, "
    f"open_access: struct<is_oa: boolean>, authorships: array<struct<author: struct<display_name: string>>>, best_oa_location: {PLACE}, primary_location: {PLACE}>>"
)


def squeezed(text: Column) -> Column:
    """White space runs as one blank; an empty text becomes null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def text_of_positions(index: Column) -> Column:
    """The text of an inverted index, word to positions: words in the order of their positions, ties by word."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["word"]), " ")


def plain_doi(doi: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(F.trim(doi), r"^(?i:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")), F.lit(""))


def _record(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    empty = {"authors": F.lit(None).cast("array<string>"), "year": F.lit(None).cast("int")}
    return df.select(F.lit(source).alias("source"), *(columns.get(c, empty.get(c, F.lit(None).cast("string"))).alias(c) for c in RECORD[1:]))


def _link(test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter("link", test), F.lit(0))["_href"]


def atom(spark: SparkSession, path: str) -> DataFrame:
    """Atom entries; the newest come first where the caller sorts by year."""
    df = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    return _record(
        df, "atom", external_id=F.regexp_extract("id", r"([^/]+)$", 1), title=squeezed(F.col("title")), authors=F.transform("author", lambda a: squeezed(a["name"])), abstract=squeezed(F.col("summary")),
        year=F.substring("published", 1, 4).try_cast("int"), url=F.coalesce(_link(lambda x: x["_rel"] == "alternate"), F.col("id")), pdf_url=_link(lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf")),
    )


def medline(spark: SparkSession, path: str) -> DataFrame:
    """Abstract parts are joined; a collective author stands where a person has no name; the year falls back to the free date."""
    df = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(MEDLINE).load(path).select("MedlineCitation.*").select("PMID", "Article.*")
    date = F.col("Journal.JournalIssue.PubDate")
    names = F.transform("AuthorList.Author", lambda a: F.coalesce(squeezed(F.concat_ws(" ", a["ForeName"], a["LastName"])), a["CollectiveName"]))
    return _record(
        df, "medline", external_id=F.col("PMID"), title=squeezed(F.col("ArticleTitle")), authors=F.filter(names, lambda n: n.isNotNull()), abstract=squeezed(F.array_join("Abstract.AbstractText", " ")),
        year=F.coalesce(date["Year"], F.regexp_extract(date["MedlineDate"], r"\d{4}", 0)).try_cast("int"), venue=F.col("Journal.Title"),
    )


def crossref(spark: SparkSession, path: str) -> DataFrame:
    """The year is that of the print, else the online publication, else the entry."""
    df = spark.read.schema(CROSSREF).option("multiLine", True).json(path).select(F.inline("message.items"))
    year = F.coalesce(*(F.get(F.get(F.col(f"`{c}`.`date-parts`"), F.lit(0)), F.lit(0)) for c in ("published-print", "published-online", "created")))
    return _record(
        df, "crossref", external_id=F.col("DOI"), title=squeezed(F.get("title", F.lit(0))), authors=F.transform("author", lambda a: squeezed(F.concat_ws(" ", a["given"], a["family"]))),
        abstract=squeezed(F.regexp_replace("abstract", "<[^>]+>", " ")), year=year, venue=F.get(F.col("`container-title`"), F.lit(0)), doi=plain_doi(F.col("DOI")), url=F.col("URL"),
    )


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """Open-access works; places fall back from the best open one to the first one."""
    df = spark.read.schema(OPEN_INDEX).option("multiLine", True).json(path).select(F.inline("results")).filter("open_access.is_oa")
    either = lambda field: F.coalesce(F.col(f"best_oa_location.{field}"), F.col(f"primary_location.{field}"))
    return _record(
        df, "open_index", external_id=F.regexp_extract("id", r"([^/]+)$", 1), title=squeezed(F.col("display_name")), authors=F.transform("authorships", lambda a: a["author"]["display_name"]),
        abstract=F.nullif(text_of_positions(F.col("abstract_inverted_index")), F.lit("")), year=F.col("publication_year"), venue=either("source.display_name"), doi=plain_doi(F.col("doi")),
        url=F.coalesce(either("landing_page_url"), F.col("id")), pdf_url=either("pdf_url"),
    )


READERS = {"atom": atom, "medline": medline, "crossref": crossref, "open_index": open_index}


def records(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The union of several sources, by reader name."""
    if unknown := sorted(set(paths) - set(READERS)):
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    out = None
    for name, path in paths.items():
        df = READERS[name](spark, path)
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no source is named")
    return out


def journal_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Title and metric of a CSV with semicolons and decimal commas; rows without a number are skipped, the last of a title by value stays."""
    df = spark.read.option("header", True).option("sep", ";").schema("Title string, SJR string").csv(path, enforceSchema=False)
    rows = df.select(squeezed(F.col("Title")).alias("title"), F.replace("SJR", F.lit(","), F.lit(".")).try_cast("double").alias("metric"))
    return rows.filter("title is not null and metric is not null").groupBy("title").agg(F.max("metric").alias("metric"))


def full_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files; bytes that aren't UTF-8 become the replacement character."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.decode("content", "UTF-8").alias("text"))


def usable_text(text: Column, least: int = 800) -> Column:
    """Whether a text has enough characters that aren't white space."""
    return F.coalesce(F.length(F.regexp_replace(text, r"\s+", "")) >= least, F.lit(False))


IEEE = (
    "articles array<struct<article_number: string, title: string, abstract: string, publication_year: string, publication_title: string, doi: string, html_url: string, pdf_url: string, "
    "authors: struct<authors: array<struct<full_name: string>>>>>"
)


def ieee(spark: SparkSession, path: str) -> DataFrame:
    """Articles; a page's address falls back to the file's. The newest come first where the caller sorts by year."""
    df = spark.read.schema(IEEE).option("multiLine", True).json(path).select(F.inline("articles"))
    names = F.filter(F.transform("authors.authors", lambda a: squeezed(a["full_name"])), lambda n: n.isNotNull())
    return _record(
        df, "ieee", external_id=F.col("article_number"), title=squeezed(F.col("title")), authors=names, abstract=squeezed(F.col("abstract")), year=F.col("publication_year").try_cast("int"),
        venue=squeezed(F.col("publication_title")), doi=plain_doi(F.col("doi")), url=F.coalesce(F.nullif("html_url", F.lit("")), "pdf_url"), pdf_url=F.nullif("pdf_url", F.lit("")),
    )


READERS["ieee"] = ieee
#: A catalogue's line: number, short name, full name, level, kind, field.
CATALOG_LINE = r"^\d+ (\S+) (.+) ([ABC]) (会议|期刊) (.+)$"


def catalog_page(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, short_name, full_name, level, kind and field of every entry in pages of tables, whether an entry is one line of
    text or each of its cells is.

    Tags end lines. An entry of cells is found by its level and kind, which follow each other; its names are the two cells
    before them, and its field the one behind.
    """
    text = F.regexp_replace(F.col(html), r"<[^>]+>", "\n")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    listed = pages.select(key, lines.alias("__l"))
    whole = listed.select(key, F.explode(F.filter("__l", lambda x: x.rlike(CATALOG_LINE))).alias("__x"))
    part = lambda i: F.regexp_extract("__x", CATALOG_LINE, i)
    whole = whole.select(key, part(1).alias("short_name"), part(2).alias("full_name"), part(3).alias("level"), part(4).alias("kind"), part(5).alias("field"))
    at = listed.select(key, "__l", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("__l") - 3))).alias("__i"))
    cell = lambda k: F.get("__l", F.col("__i") + k)
    short = F.regexp_replace(cell(-2), r"^\d+ (?=\S)", "")
    numbered = cell(-2).rlike(r"^\d+ \S") | cell(-3).rlike(r"^\d+$")
    cells = at.filter(cell(0).isin("A", "B", "C") & cell(1).isin("会议", "期刊") & cell(2).isNotNull() & F.coalesce(numbered, F.lit(False)))
    return whole.unionByName(cells.select(key, short.alias("short_name"), cell(-1).alias("full_name"), cell(0).alias("level"), cell(1).alias("kind"), cell(2).alias("field")))


def local_files(records: DataFrame, files: DataFrame, key: str, title: str) -> DataFrame:
    """Per record the best file of files (path), if any fits: 4 for its id in the file's name, 3 for all of its title's first
    words there; ties by path. Names meet records on their words, by an equi-join."""
    stem = F.lower(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    named = files.select("path", words(stem).alias("__w"))
    wanted = records.select(key, F.lower(F.col(key).cast("string")).alias("__id"), F.slice(words(F.col(title)), 1, 3).alias("__t"))
    tokens = named.select("path", F.col("__w").alias("__all"), F.explode("__w").alias("__k"))
    hits = wanted.select(key, "__id", "__t", F.explode(F.array_distinct(F.concat(F.array("__id"), F.slice("__t", 1, 1)))).alias("__k")).join(tokens, "__k")
    score = F.when(F.array_contains("__all", F.col("__id")), 4).otherwise(0) + F.when((F.size("__t") > 0) & (F.size(F.array_except("__t", "__all")) == 0), 3).otherwise(0)
    scored = hits.withColumn("score", score).filter("score > 0")
    return scored.groupBy(key).agg(F.min_by(F.struct("path", "score"), F.struct(-F.col("score"), F.col("path"))).alias("b")).select(key, "b.path", "b.score")


GRAMS = (1, 2, 4, 8, 16, 32)


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Pairs of distinct texts of needles (__n) that stand somewhere in hays (__h); empty needles are nowhere.

    A needle's grams are as long as the largest of GRAMS that fits; it meets the hays that have its rarest one, as beginnings
    are often shared by all. Hays are short, as names and titles are: each is cut at every place into grams of each length.
    """
    wanted, signs = needles.filter("__n <> ''").select("__n").distinct(), hays.filter("__h <> ''").select("__h").distinct()

    def grams(text: str, sizes: Column) -> Column:
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.xxhash64(F.substring(F.col(text), i, n)))
        return F.explode(F.array_distinct(F.flatten(F.transform(sizes, cut)))).alias("__g")

    fits = lambda text: F.filter(F.array(*map(F.lit, GRAMS)), lambda n: n <= F.length(text))
    of_hays = signs.select("__h", grams("__h", fits("__h")))
    many = of_hays.groupBy("__g").agg(F.count("*").alias("df"))
    of_needles = wanted.select("__n", grams("__n", F.array(F.array_max(fits("__n"))))).join(many, "__g", "left")
    rarest = of_needles.groupBy("__n").agg(F.min_by("__g", "df").alias("__g"), F.count_if(F.col("df").isNull()).alias("missing")).filter("missing = 0").drop("missing")
    return of_hays.join(rarest, "__g").filter(F.contains("__h", "__n")).select("__n", "__h")


def best_files(records: DataFrame, files: DataFrame, key: str = "record", title: str = "title", external: str = "external_id", doi: str = "doi", name: str | None = None) -> DataFrame:
    """Per record the best file of files (path) by its name without folder and ending: 4 for the record's id (`name`, else
    its key) in it, 3 for its external id, 3 for its DOI with underscores, 2 for its title in the name or the name in the
    title; ties by path. Of a key with several rows, the best of them.

    Of the texts that a record looks for, the one in the most names may be in a large part of them, and so may another
    record's. A file that has that text alone is only of use as the first such path, which is one row per text; all others are
    looked up through the record's rarer texts.
    """
    from scrivener.functions.text import normalize_identifier, normalize_title

    scratch = Scratch(records.sparkSession)
    worth = {"__id": 4, "__ext": 3, "__doi": 3, "__title": 2}
    stems = files.select("path", F.lower(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("stem"))
    stems = scratch.save(stems.groupBy("stem").agg(F.min("path").alias("path")).withColumn("plain", normalize_title(F.col("stem"))))
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    looked = {"__id": low(name or key), "__ext": low(external), "__doi": F.coalesce(F.regexp_replace(normalize_identifier(F.coalesce(F.col(doi), F.lit(""))), "/", "_"), F.lit("")), "__title": normalize_title(F.coalesce(F.col(title), F.lit("")))}
    rows = scratch.save(records.select(F.col(key).alias("__key"), *(c.alias(n) for n, c in looked.items())))
    different = rows.select(*worth).distinct()
    # What is looked for, as (by title, text), and the names that have it.
    texts = rows.select(F.explode(F.array("__id", "__ext", "__doi")).alias("__n"))
    by_stem = contained(texts, stems.select(F.col("stem").alias("__h"))).select(F.lit(False).alias("titled"), F.col("__n").alias("sought"), F.col("__h").alias("stem"))
    titles, plains = rows.select("__title"), stems.select("plain")
    both = contained(titles.toDF("__n"), plains.toDF("__h")).toDF("sought", "plain").unionByName(contained(plains.toDF("__n"), titles.toDF("__h")).toDF("plain", "sought")).distinct()
    by_title = both.join(stems.select("plain", "stem"), "plain").select(F.lit(True).alias("titled"), "sought", "stem")
    hits = scratch.save(by_stem.unionByName(by_title).join(stems, "stem"))
    sizes = scratch.save(hits.groupBy("titled", "sought").agg(F.count("*").alias("n"), F.min("path").alias("first")))
    counted = different
    for kind in worth:
        of_kind = sizes.filter(F.col("titled") == F.lit(kind == "__title")).select(F.col("sought").alias(kind), F.col("n").alias(f"n_{kind}"), F.col("first").alias(f"first_{kind}"))
        counted = counted.join(of_kind, kind, "left")
    # The most frequent text last; of equal ones, any.
    found = F.array_sort(F.filter(F.array(*(F.struct(F.col(f"n_{k}").alias("n"), F.lit(k == "__title").alias("titled"), F.col(k).alias("sought"), F.lit(w).alias("worth"), F.col(f"first_{k}").alias("first")) for k, w in worth.items())), lambda x: x["n"].isNotNull()))
    counted = scratch.save(counted.select(*worth, found.alias("found")).filter("size(found) > 0"))
    alone = counted.select(*worth, F.element_at("found", -1).alias("f")).select(*worth, F.col("f.worth").alias("score"), F.col("f.first").alias("path"))
    rarer = counted.select(*worth, F.explode(F.array_distinct(F.transform(F.slice("found", F.lit(1), F.size("found") - 1), lambda x: F.struct(x["titled"].alias("titled"), x["sought"].alias("sought"))))).alias("f")).select(*worth, "f.titled", "f.sought")
    has = lambda hay, needle: (F.col(needle) != "") & F.contains(hay, F.col(needle))
    fits = {"__id": has("stem", "__id"), "__ext": has("stem", "__ext"), "__doi": has("stem", "__doi"), "__title": has("plain", "__title") | ((F.col("__title") != "") & has("__title", "plain"))}
    score = sum((F.when(fits[k], w).otherwise(0) for k, w in worth.items()), F.lit(0))
    scored = rarer.join(hits, ["titled", "sought"]).select(*worth, score.alias("score"), "path").unionByName(alone)
    first = lambda df, *by: df.groupBy(*by).agg(F.min_by(F.struct("path", "score"), F.struct(-F.col("score"), F.col("path"))).alias("b"))
    best = first(scored, *worth).select(*worth, "b.path", "b.score")
    return first(rows.join(best, list(worth)), "__key").select(F.col("__key").alias(key), "b.path", F.col("b.score").cast("int").alias("score"))


def searched(spark: SparkSession, paths: dict[str, str], limit: int = 50) -> tuple[DataFrame | None, dict[str, str]]:
    """The records of several sources, of each at most `limit` (1 to 200), the newest first, and why sources gave none: unknown
    ones, and those that can't be read. One source's failure doesn't spoil the others; no source at all gives None."""
    limit, out, failed = max(1, min(limit, 200)), None, {}
    for name, path in paths.items():
        if name not in READERS:
            failed[name] = "unknown source"
            continue
        try:
            df = READERS[name](spark, path).orderBy(F.desc_nulls_last("year"), "external_id").limit(limit).cache()
            df.count()  # what can't be read fails here, by itself
        except Exception as e:
            failed[name] = str(e).split("\n")[0][:300]
            continue
        out = df if out is None else out.unionByName(df)
    return out, failed


def hashed_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, size, modified and sha256 of the contents of files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
