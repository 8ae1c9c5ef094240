"""Which headings are topics: sections that every paper has, generic labels, and phrases as topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivener.functions.text import let

# Titles that say nothing of a topic, parts of titles that don't either, and labels of one word that are none.
GENERIC_TITLES = (
    "additional ablation studies", "additional implementation details", "additional mathematical derivation", "abstract", "acknowledgments", "appendix",
    "background", "bibliography", "conclusion", "conclusions", "discussion", "evaluation", "experiment", "experiments", "future work", "implementation",
    "introduction", "limitations", "methodology", "method", "methods", "model", "models", "overview", "preliminaries", "references", "related work",
    "results", "setup", "system model", "technical approach", "technical framework",
)
NON_CORE = (
    "ccf concept", "ccf concepts", "ccs concept", "ccs concepts", "concept term", "concept terms", "index term", "index terms", "keyword", "keywords",
    "subject descriptor", "subject descriptors", "categories and subject descriptors", "classification term", "classification terms", "acm classification",
    "acm computing classification", "mathematics subject classification", "ams subject classification", "msc", "notation", "notations", "symbol", "symbols",
    "abbreviation", "abbreviations", "reference", "references", "bibliography", "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements",
    "funding", "conflict of interest", "conflicts of interest", "declaration", "ethical approval", "author contribution", "author contributions",
    "competing interests", "data availability", "supplementary material", "supplementary materials", "appendix", "journal", "conference",
    "publication info", "copyright",
)
LABEL_WORDS = (
    "algorithm", "algorithms", "analysis", "approach", "approaches", "architecture", "architectures", "background", "evaluation", "experiment", "experiments",
    "framework", "frameworks", "implementation", "implementations", "method", "methods", "methodology", "model", "models", "overview", "pipeline", "pipelines",
    "scheme", "schemes", "setup", "strategy", "strategies", "system", "systems", "workflow", "workflows", "方法", "方法学", "实验", "实验设计", "实验设置",
    "实验结果", "总体方案", "技术路线", "技术框架", "系统框架", "系统设计", "系统模型", "架构设计", "模型设计", "模型结构", "机制设计", "流程设计", "评估", "评价", "背景", "概述",
)
VAGUE_WORDS = ("action", "camera", "implementation", "derivation", "study")
PREFIXES = ("appendix", "additional ")


def _without_number(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^\d+(?:\.\d+)*\s*", "")


def _starts(low: Column) -> Column:
    out = F.lit(False)
    for p in PREFIXES:
        out = out | low.startswith(p)
    return out


def is_non_core(title: Column) -> Column:
    """Whether a section is one that every paper has, or says nothing of its subject."""
    low = F.lower(F.btrim(F.regexp_replace(_without_number(title), r"\s+", " "), F.lit(" -_#:.")))
    # A part is looked for anywhere; those that hold another one needn't be tried.
    parts = "|".join(p for p in NON_CORE if not any(q != p and q in p for q in NON_CORE))
    return let(low, lambda x: (x == "") | x.isin(*GENERIC_TITLES) | _starts(x) | x.rlike(parts))


def topic(phrase: Column) -> Column:
    """A phrase as a topic, without its number or letter; null if it is none."""
    plain = F.btrim(F.regexp_replace(F.regexp_replace(_without_number(phrase), r"^[A-Z]\s+", ""), r"\s+", " "), F.lit(" -_#"))
    bad = lambda p: (F.length(p) < 3) | let(F.lower(p), lambda low: low.isin("", *GENERIC_TITLES) | _starts(low) | low.isin(*VAGUE_WORDS)) | is_non_core(p)
    return let(plain, lambda p: F.when(~bad(p), p))


def is_generic_label(label: Column) -> Column:
    """Whether a label isn't a topic or is a word of those that any paper may have."""
    found = topic(label)
    return let(found, lambda t: t.isNull() | F.lower(t).isin(*LABEL_WORDS))


def specific(label: Column, candidates: Column) -> Column:
    """A generic label's first specific candidate that isn't the label itself; other labels as they are."""
    first = F.get(F.filter(candidates, lambda c: ~is_generic_label(c) & (F.lower(c) != F.lower(F.coalesce(label, F.lit(""))))), F.lit(0))
    return F.when(is_generic_label(label), first).otherwise(label)
