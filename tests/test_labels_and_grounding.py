"""Labels and grounding against plain versions of their rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from scrivener.functions import labels as B
from scrivener.operators import grounding as G

TITLES = [
    "1 Introduction", "2.1  Lattice  Reduction", "A Proofs of it", "Appendix C", "Additional tests", "Keywords:", "MSC 2010", "Index Terms and more", "3.", "", None, " - # ", "Conference Paper", "System", "Systems of nodes",
    "study", "Case study", "x", "B x", "ab", "方法", "1.2 实验设计", "深度学习 方法", "Results", "RESULTS:", "Summary", "Notations used", "Journalism of war", "Overview -", "camera", "Camera ready", "4.5.6", "Author Contributions",
]


def plain_non_core(title: str) -> bool:
    low = re.sub(r"\s+", " ", re.sub(r"^\d+(?:\.\d+)*\s*", "", title.strip(" "))).strip(" -_#:.").lower()
    return not low or low in B.GENERIC_TITLES or low.startswith(("appendix", "additional ")) or any(p in low for p in B.NON_CORE)


def plain_topic(phrase: str) -> str | None:
    c = re.sub(r"\s+", " ", re.sub(r"^[A-Z]\s+", "", re.sub(r"^\d+(?:\.\d+)*\s*", "", phrase.strip(" ")))).strip(" -_#")
    low = c.lower()
    if not c or low in B.GENERIC_TITLES or low.startswith(("appendix", "additional ")) or plain_non_core(c) or len(c) < 3 or low in B.VAGUE_WORDS:
        return None
    return c


def test_titles(spark):
    assert (len(B.GENERIC_TITLES), len(B.NON_CORE), len(B.LABEL_WORDS)) == (32, 49, 53)
    got = spark.createDataFrame(list(enumerate(TITLES)), "i int, t string").orderBy("i").select("t", B.is_non_core(F.col("t")), B.topic(F.col("t")), B.is_generic_label(F.col("t")), B.specific(F.col("t"), F.array(F.lit("Results"), F.col("t"), F.lit("Real thing")))).collect()
    for t, non_core, topic, generic, better in got:
        assert (non_core, topic) == (plain_non_core(t or ""), plain_topic(t or ""))
        assert generic == (topic is None or topic.lower() in B.LABEL_WORDS)
        assert better == ("Real thing" if generic else t)


STRONG = r"(?i)(?:首次|首个|最快|最优|全面优于|至少\s*\d|\d+(?:\.\d+)?\s*(?:倍|%|％)|显著(?:提升|降低|优于)|\bfirst\b|\bfastest\b|\bstate[- ]of[- ]the[- ]art\b)"


def plain_cited(text: str, n: int) -> list[int]:
    out = set()
    for group in re.findall(r"\[([0-9,，\-–—\s]+)\]", text):
        for part in re.sub("[–—]", "-", group.replace("，", ",")).split(","):
            ends = [x.strip() for x in part.split("-", 1)]
            if all(x.isdigit() for x in ends):
                a, b = int(ends[0]), int(ends[-1])
                out |= set(range(a, b + 1)) if b - a <= 20 else set()
    return sorted(x for x in out if 1 <= x <= n)


PIECES = ["This is first", "the fastest [2]", "a claim", "[1]", "[2，4]", "[3–5]", "[1-40]", "[7]", "[x]", "[2-1]", "至少 3 倍", "state-of-the-art", "12.5 % more", "firstly", "无法获取该论文的全文", "全文 unavailable", "only the abstract", "只能依据摘要", ". ", "! ", "？", "\n", "。"]


def test_answers(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))), rng.choice([0, 1, 4, 9]), rng.random() < 0.5, rng.random() < 0.5, [[rng.randint(0, 10) for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 2))]) for i in range(300)] + [(300, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, a string, n int, full boolean, strict boolean, groups array<array<int>>")
    got = {r["i"]: r for r in G.validated(df, "i", "a", "n", F.col("full"), F.col("groups"), F.col("strict")).collect()}
    seen = set()
    for i, a, n, full, strict, groups in rows:
        a, n = a or "", n or 0
        cited, reasons = plain_cited(a, n), []
        sentences = [s for s in re.split(r"(?<=[。！？!?])|\n+", a) if s]
        uncited = [s for s in sentences if re.search(STRONG, s) and not plain_cited(s, n)]
        if n and not cited:
            reasons.append("no_citation")
        if full and any(re.search(p, a) for p in G.NO_FULL_TEXT):
            reasons.append("denies_full_text")
        for g in groups or []:
            able = sorted({x for x in g if 1 <= x <= n})
            if able and not set(able) & set(cited):
                reasons.append("missing_group:" + ",".join(map(str, able)))
        if strict and uncited:
            reasons.append("uncited_claim")
        assert (got[i]["cited"], got[i]["uncited"], got[i]["reasons"], got[i]["valid"]) == (cited, uncited, reasons, not reasons), a
        seen |= {r.split(":")[0] for r in reasons}
    assert seen == {"no_citation", "denies_full_text", "missing_group", "uncited_claim"}
