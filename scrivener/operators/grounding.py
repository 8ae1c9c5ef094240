"""Whether an answer rests on its sources: citations, strong claims, and what it says about full texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns: strong claims, and sentences that deny a full text. Spans of citations are 20 numbers wide at most.
STRONG = r"(?i)(?:首次|首个|最快|最优|全面优于|至少\s*\d|\d+(?:\.\d+)?\s*(?:倍|%|％)|显著(?:提升|降低|优于)|\bfirst\b|\bfastest\b|\bstate[- ]of[- ]the[- ]art\b)"
NO_FULL_TEXT = (
    r"(?i)(?:只能|仅能|只能够).{0,20}(?:摘要|abstract)",
    r"(?i)(?:无法|不能|未能).{0,20}(?:获取|访问|读取|检索).{0,12}(?:全文|full[ -]?text)",
    r"(?i)(?:全文|full[ -]?text).{0,12}(?:不可用|不存在|unavailable|not available)",
)
CITED, SENTENCE, WIDEST = r"\[([0-9,，\-–—\s]+)\]", r"(?<=[。！？!?])|\n+", 20


def cited(text: Column, sources: Column) -> Column:
    """The sorted numbers that a text cites, of those that there are."""

    def numbers(group: Column) -> Column:
        def span(part: Column) -> Column:
            ends = F.transform(F.split(part, "-", 2), lambda x: F.when(F.trim(x).rlike(r"^\d{1,9}$"), F.trim(x).cast("int")))
            a, b = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
            one = F.when(a.isNotNull(), F.array(a))
            wide = F.when((b >= a) & (b - a <= WIDEST), F.sequence(a, F.greatest(a, b)))
            return F.coalesce(F.when(part.contains("-"), wide).otherwise(one), F.array().cast("array<int>"))

        return F.flatten(F.transform(F.split(F.regexp_replace(F.regexp_replace(group, "，", ","), "[–—]", "-"), ","), lambda p: span(p)))

    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CITED), F.lit(1)), lambda g: numbers(g)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: n.between(1, sources))))


def uncited_claims(text: Column, sources: Column) -> Column:
    """Sentences with a strong claim and without a citation of their own."""
    return F.filter(F.split(text, SENTENCE), lambda s: (s != "") & s.rlike(STRONG) & (F.size(cited(s, sources)) == 0))


def denies_full_text(text: Column) -> Column:
    out = F.lit(False)
    for pattern in NO_FULL_TEXT:
        out = out | text.rlike(pattern)
    return out


def validated(answers: DataFrame, key: str, answer: str, sources: str, full_text: Column | None = None, groups: Column | None = None, strict: Column | None = None) -> DataFrame:
    """key, cited, uncited (the strong sentences without a citation), reasons and valid.

    full_text: whether full texts were there; then an answer must not deny it. groups: lists of sources of which each must be cited
    by one; numbers beyond the sources don't count, and groups of none of them neither. strict: whether strong claims need a
    citation in their sentence.
    """
    text, n = F.coalesce(F.col(answer), F.lit("")), F.coalesce(F.col(sources), F.lit(0))
    out = answers.select("*", cited(text, n).alias("__cited"), uncited_claims(text, n).alias("__uncited"))
    told = F.coalesce(full_text, F.lit(False)) if full_text is not None else F.lit(False)
    reasons = [F.when((n > 0) & (F.size("__cited") == 0), "no_citation"), F.when(told & denies_full_text(text), "denies_full_text")]
    missed = F.array().cast("array<string>")
    if groups is not None:
        able = F.filter(F.transform(F.coalesce(groups, F.array().cast("array<array<int>>")), lambda g: F.array_sort(F.array_distinct(F.filter(g, lambda x: x.between(1, n))))), lambda g: F.size(g) > 0)
        missed = F.transform(F.filter(able, lambda g: ~F.arrays_overlap(g, F.col("__cited"))), lambda g: F.concat(F.lit("missing_group:"), F.array_join(g.cast("array<string>"), ",")))
    needed = F.coalesce(strict, F.lit(False)) if strict is not None else F.lit(False)
    listed = F.concat(F.filter(F.array(*reasons), lambda r: r.isNotNull()), missed, F.filter(F.array(F.when(needed & (F.size("__uncited") > 0), "uncited_claim")), lambda r: r.isNotNull()))
    return out.select(key, F.col("__cited").alias("cited"), F.col("__uncited").alias("uncited"), listed.alias("reasons")).withColumn("valid", F.size("reasons") == 0)
