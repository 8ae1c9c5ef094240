"""Fields of papers from their text, against a plain reader of lines."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from scrivener import registry
from scrivener.functions import metadata as D
from scrivener.plans import texts


def plain_reference(text: str) -> dict:
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    joined, out = " ".join(lines), dict.fromkeys(("doi", "url", "abstract", "year", "title"))
    for name, pattern, group, cut in (("doi", r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b", 0, ".,;"), ("url", r"https?://\S+", 0, ".,;)"), ("abstract", r"(?i)\babstract\s*[:.-]\s*(.+)$", 1, ""), ("year", r"\b(?:19|20)\d{2}\b", 0, "")):
        if m := re.search(pattern, joined):
            out[name] = m[group].rstrip(cut) if cut else m[group].strip()
    out["year"] = int(out["year"]) if out["year"] else None
    out["title"] = next((x.strip(" .") for x in lines if not x.lower().startswith(("doi", "http", "abstract", "keywords"))), None)
    second = lines[1] if len(lines) > 1 else "doi"
    out["authors"] = [] if re.search(r"(?i)\babstract\b|\bdoi\b|https?://", second) else [a.strip(" .") for a in re.split(r"\s*(?:,|;|\band\b|，|、)\s*", second) if a.strip(" .")]
    return out


def plain_venue(text: str) -> str | None:
    head = "\n".join(text.splitlines()[:120])
    for pattern in D.VENUES:
        if (m := re.search(pattern, head)) and 6 <= len(name := re.sub(r"\s+", " ", m[1]).strip(" .,:;")) <= 180:
            return name
    return None


def test_pasted_references(spark):
    samples = [
        "A Study of Things.\nAnn B., C. Dee and E F; G\nJournal of X 2011, doi 10.1000/AB-c(1).\nhttps://x.org/a).\nAbstract: it works. ", "doi:10.1/no\nhttps://only.org\nThe Title Line", "", None, "One line 1850 and 2020",
        "T\nAbstract - here", "Title\n\n  Xi、Yu，Zed ", "a\r\nb, c\r\n1999",
    ]
    df = spark.createDataFrame(list(enumerate(samples)), "i int, t string")
    got = {r["i"]: r.asDict() for r in df.select("i", *(c.alias(n) for n, c in D.reference_fields(F.col("t")).items())).collect()}
    for i, text in enumerate(samples):
        assert {k: v for k, v in got[i].items() if k != "i"} == plain_reference(text or "")


def test_pdf_metadata(spark):
    text = "unknown\nsome line that is long enough\nACM\nText of it"
    rows = [(0, text, " A Real Title ", "X; Y and Z", "subject", "D:20150203"), (1, text, "Untitled", "", None, None), (2, "2001 here", None, None, "subject", "D:2015"), (3, "doi:x\nabstract of it is long enough\nlong enough for a title", "pdf", None, None, None)]
    df = spark.createDataFrame(rows, "i int, t string, title string, author string, subject string, created string")
    fields = D.pdf_fields(F.col("t"), F.col("title"), F.col("author"), F.col("subject"), F.col("created"))
    got = {r["i"]: r for r in df.select("i", *D.with_fields(fields)).collect()}
    assert (got[0]["title"], got[0]["authors"], got[0]["abstract"], got[0]["year"], got[0]["venue"]) == ("A Real Title", ["X", "Y", "Z"], "subject", 2015, None)
    assert (got[1]["title"], got[1]["authors"], got[1]["abstract"]) == ("unknown", ["some line that is long enough"], None)
    assert (got[2]["year"], got[2]["fields"]) == (2001, 3) and got[3]["title"] == "long enough for a title"


def test_venues(spark):
    samples = ["x\nIn Proceedings of the 9th  Conference on Y, 2020.\n", "IEEE\nJournal of Fine Work 3", "Review of odd", "see Transactions of Z and more", "l\n" * 119 + "ACM CHI last", "l\n" * 120 + "ACM CHI late", "the ccs part of words", ""]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(samples)), "i int, t string").orderBy("i").select(D.venue(F.col("t"))).collect()]
    assert got == [plain_venue(t) for t in samples] and got[0] == "the 9th Conference on Y, 2020" and got[5] is None


def test_markdown_of_the_whole_table(spark, sf_dir):
    def clean(text: str) -> str:
        for pattern, by in ((r"(?s)```.*?```", "\n"), (r"`([^`]+)`", r"\1"), (r"!\[[^\]]*\]\([^)]+\)", " "), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"(?m)^\s{0,3}#{1,6}\s*", ""), (r"(?m)^\s{0,3}>\s?", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"\|", " "), (r"\n{3,}", "\n\n")):
            text = re.sub(pattern, by, text)
        return text.strip()

    got = {r["doc_id"]: r.asDict() for r in registry.queries()["markdown_metadata"](spark, sf_dir).collect()}
    seen = set()
    for row in texts._papers(spark, sf_dir).collect():
        text = clean(row["text"])
        want = plain_reference(text)
        m = re.search(r"(?is)\babstract\b\s*[:.\-]?\s*(.+?)(?:\n\s*(?:keywords|introduction|1\s+introduction)\b|$)", text)
        want["abstract"] = re.sub(r"\s+", " ", m[1]).strip()[:4000]
        years = [int(y) for y in re.findall(r"\b(?:19|20)\d{2}\b", text[:4000]) if 1900 <= int(y) <= 2100]
        want["year"] = min(years) if years else want["year"]
        want["venue"] = plain_venue(text)
        mine = got[row["doc_id"]]
        assert {k: mine[k] for k in ("doi", "title", "authors", "venue", "abstract", "url")} == {k: want[k] for k in ("doi", "title", "authors", "venue", "abstract", "url")}, row["doc_id"]
        assert mine["year"] == want["year"] and (mine["journal"] is not None) == bool(want["venue"] and re.search(r"(?i)\bjournal\b|transactions|letters|review\b", want["venue"]))
        seen.add(want["venue"])
    assert len(seen) > 2
