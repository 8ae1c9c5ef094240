"""Fields of a paper from the head of its text: pasted references, Markdown, and text of a PDF with its metadata.

All are column expressions. A field that isn't found is null (authors: an empty list).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions.text import earliest_year, let

# Fixed patterns and limits.
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
ABSTRACT = r"(?is)\babstract\b\s*[:.\-]?\s*(.+?)(?:\n\s*(?:keywords|introduction|1\s+introduction)\b|$(?!\n))"
VENUES = (
    r"(?i)(?:proceedings of|in proceedings of)\s+(.{8,160})",
    r"(?i)((?:ACM|IEEE|USENIX|AAAI|ACL|EMNLP|NeurIPS|ICML|ICLR|CVPR|ICCV|ECCV|SIGIR|KDD|WWW|CHI|SIGMOD|VLDB|ICSE|FSE|ASE|PLDI|POPL|SOSP|OSDI|NDSS|CCS|S&P)[^\n]{0,140})",
    r"(?i)((?:Journal|Transactions|Letters|Review) of [^\n]{6,140})",
    r"(?i)((?:IEEE|ACM) Transactions on [^\n]{6,140})",
)
NOISE = ("untitled", "unknown", "microsoft word", "pdf", "document")
AUTHOR_BREAK, NO_TITLE = r"\s*(?:,|;|\band\b|，|、)\s*", r"(?i)^(?:abstract|keywords|doi)\b"
VENUE_LINES, LONGEST_ABSTRACT, SHORTEST_NAME = 120, 4000, 6


def some(c: Column) -> Column:
    """c, or null where it is empty."""
    return let(c, lambda x: F.when(x != "", x))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return some(F.regexp_extract(text, pattern, group))


def stripped(c: Column, signs: str) -> Column:
    return F.btrim(c, F.lit(signs))


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")


def plain_text(markdown: Column) -> Column:
    """Markdown without code blocks, images, the targets of links, and the marks of headings, quotes, lists and tables."""
    steps = (
        (r"\r\n", "\n"), (r"(?s)```.*?```", "\n"), (r"`([^`]+)`", "$1"), (r"!\[[^\]]*\]\([^)]+\)", " "), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"(?m)^\s{0,3}#{1,6}\s*", ""), (r"(?m)^\s{0,3}>\s?", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"\|", " "), (r"\n{3,}", "\n\n"),
    )
    out = F.coalesce(markdown, F.lit(""))
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_replace(out, r"^\s+|\s+$(?!\n)", "")


def authors_of(line: Column, signs: str = " .") -> Column:
    return F.filter(F.transform(F.split(line, AUTHOR_BREAK), lambda a: stripped(a, signs)), lambda a: a != "")


def reference_fields(text: Column) -> dict[str, Column]:
    """doi, url, abstract, year, title and authors of a reference that was pasted as text.

    The title is the first line that isn't a DOI, an address, an abstract or keywords, the authors are the second line
    unless it speaks of those.
    """
    lines = _filled(text)
    return _of_lines(lines, F.array_join(lines, " "))


def _filled(text: Column) -> Column:
    """The lines that aren't blank, without what is blank at their ends."""
    return F.filter(F.transform(_lines(text), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _of_lines(lines: Column, joined: Column) -> dict[str, Column]:
    second = F.get(lines, F.lit(1))
    is_title = lambda x: ~F.lower(x).rlike(r"^(?:doi|http|abstract|keywords)")
    return {
        "doi": F.rtrim(found(joined, DOI), F.lit(".,;")),
        "url": F.rtrim(found(joined, r"https?://\S+"), F.lit(".,;)")),
        "abstract": F.trim(found(joined, r"(?i)\babstract\s*[:.-]\s*(.+)$", 1)),
        "year": found(joined, r"\b(?:19|20)\d{2}\b").cast("int"),
        "title": some(stripped(F.get(F.filter(lines, is_title), F.lit(0)), " .")),
        "authors": F.when(second.isNotNull() & ~second.rlike(r"(?i)\babstract\b|\bdoi\b|https?://"), authors_of(second)).otherwise(F.array().cast("array<string>")),
    }


def venue(text: Column) -> Column:
    """The first of four patterns that finds a name of six to 180 characters in the first 120 lines."""
    return _venue(F.array_join(F.slice(_lines(text), 1, VENUE_LINES), "\n"))


def _venue(head: Column) -> Column:
    names = lambda h: [stripped(F.regexp_replace(F.regexp_extract(h, p, 1), r"\s+", " "), " .,:;") for p in VENUES]
    able = lambda n: F.when(F.length(n).between(6, 180), n)
    return let(head, lambda h: F.coalesce(*(let(n, able) for n in names(h))))


def is_journal(name: Column) -> Column:
    return F.coalesce(name.rlike(r"(?i)\bjournal\b|transactions|letters|review\b"), F.lit(False))


def is_noise(value: Column) -> Column:
    """A title of a PDF's metadata that says nothing."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return low.isin(*NOISE) | (F.length(low) < SHORTEST_NAME)


def _title_below(text: Column, first: int) -> Column:
    able = lambda x: F.length(x).between(12, 220) & ~x.rlike(NO_TITLE)
    return F.get(F.filter(F.transform(F.slice(_lines(text), 1, first), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), able), F.lit(0))


def _whole(text: Column, fields: dict[str, Column], lines: int, place: Column | None = None) -> dict[str, Column]:
    """The fields with the abstract up to the keywords or the introduction, a title from the first lines, and the venue."""
    abstract = some(F.substring(one_line(F.regexp_extract(text, ABSTRACT, 1)), 1, LONGEST_ABSTRACT))
    place = venue(text) if place is None else place
    return fields | {"abstract": F.coalesce(abstract, fields["abstract"]), "title": F.coalesce(fields["title"], _title_below(text, lines)), "venue": place, "journal": F.when(is_journal(place), place)}


def markdown_fields(markdown: Column) -> dict[str, Column]:
    """Fields of a paper's Markdown: those of a reference, the earliest year near the start, and the venue."""
    text = plain_text(markdown)
    return _with_years(text, _whole(text, reference_fields(text), 20))


def _with_years(text: Column, fields: dict[str, Column]) -> dict[str, Column]:
    return fields | {"doi": F.coalesce(F.rtrim(found(text, DOI), F.lit(".,;")), fields["doi"]), "year": F.coalesce(earliest_year(text), fields["year"])}


def markdown_metadata(df: DataFrame, key: str, markdown: str) -> DataFrame:
    """key, the markdown_fields of each text and how many were found, step by step: what several fields need is worked out once."""
    plain = df.select(key, plain_text(F.col(markdown)).alias("__text"))
    lines = plain.select(key, "__text", _filled(F.col("__text")).alias("__lines"), venue(F.col("__text")).alias("__place"))
    joined = lines.withColumn("__joined", F.array_join("__lines", " "))
    text, place = F.col("__text"), F.col("__place")
    fields = _with_years(text, _whole(text, _of_lines(F.col("__lines"), F.col("__joined")), 20, place))
    found = joined.select(key, *(c.alias(n) for n, c in fields.items()))
    return found.select(key, *with_fields({n: F.col(n) for n in fields}))


def pdf_fields(text: Column, title: Column, author: Column, subject: Column, created: Column) -> dict[str, Column]:
    """Fields of a PDF's text and metadata: a title of the metadata that says something comes first, and its authors."""
    fields, own = reference_fields(text), some(F.trim(F.coalesce(title, F.lit(""))))
    own_authors = F.trim(F.coalesce(author, F.lit("")))
    fields["title"] = F.coalesce(F.when(~is_noise(own), own), fields["title"])
    fields["authors"] = F.when(own_authors != "", authors_of(own_authors, " ")).otherwise(fields["authors"])
    fields["abstract"] = F.coalesce(fields["abstract"], some(F.trim(F.coalesce(subject, F.lit("")))))
    fields["year"] = F.coalesce(fields["year"], found(F.coalesce(created, F.lit("")), r"(?:19|20)\d{2}").cast("int"))
    return _whole(text, fields, 30)


def with_fields(fields: dict[str, Column]) -> list[Column]:
    """The fields as columns, with `fields`: how many of them were found."""
    there = [F.size(c) > 0 if n == "authors" else c.isNotNull() for n, c in fields.items()]
    count = F.lit(0)
    for t in there:
        count = count + F.coalesce(t, F.lit(False)).cast("int")
    return [*(c.alias(n) for n, c in fields.items()), count.alias("fields")]
