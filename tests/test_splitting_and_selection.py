"""What SQL cannot say: packing, windows, greedy selection, section splitting, deep trees, many phrases; by plain versions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from scrivener import registry
from scrivener.functions import markdown as M
from scrivener.functions import tables as T
from scrivener.functions import text as X
from scrivener.operators import evidence as E
from scrivener.operators import graphs as G
from scrivener.operators import jobs as J
from scrivener.operators import records as R
from scrivener.operators import search as S

WORDS = "alpha Beta gamma-delta x 中文 epsilon.zeta 42 !".split()


def text_of(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", ". ", "\n", "\n\n", "。"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_units_are_packed_as_the_rule_says(seed):
    """A chunk is closed before a unit that does not fit, or at the target; its tail is carried as far as it fits."""
    rng = random.Random(seed)
    for _ in range(60):
        target, most, overlap = rng.randint(5, 30), rng.randint(30, 60), rng.randint(0, 12)
        units = [u for u in T.semantic_units(text_of(rng, rng.randint(0, 120)), most) if u]
        sizes, out, here, carried = [T.weight(u) for u in units], [], [], 0
        for i, size in enumerate(sizes):
            full = sum(sizes[j] for j in here)
            if len(here) > carried and (full + size > most or full >= target):
                out.append((here, carried))
                tail = []
                for j in reversed(here):
                    if sizes[j] + sum(sizes[k] for k in tail) > overlap:
                        break
                    tail.insert(0, j)
                while tail and sum(sizes[j] for j in tail) + size > most:
                    tail.pop(0)
                here, carried = tail, len(tail)
            here = [*here, i]
        if len(here) > carried:
            out.append((here, carried))
        want = [("\n\n".join(units[i] for i in h), sum(sizes[i] for i in h), sum(sizes[i] for i in h[:c])) for h, c in out]
        assert T.pack_units(units, target, most, overlap) == want


def test_hard_split_keeps_limits_and_text():
    rng = random.Random(2)
    for _ in range(200):
        text, limit = text_of(rng, rng.randint(0, 60)) + "y" * rng.randint(0, 90), rng.randint(1, 9)
        parts = T.hard_split(text, limit)
        assert "".join("".join(parts).split()) == "".join(text.split())
        assert all(T.weight(p) <= limit or len(p) <= 4 * limit for p in parts)  # a long token is cut by characters


def test_windows_follow_the_rule():
    rng = random.Random(3)
    for _ in range(300):
        text, size, overlap = text_of(rng, rng.randint(0, 80)), rng.randint(8, 60), rng.randint(0, 7)
        at, want = 0, []
        while at < len(text):
            end, half = at + size, at + size // 2
            if end < len(text):
                paragraphs = [i for i in range(half + 1, end) if text.startswith("\n\n", i) and i < end]
                sentences = [i + 1 for i in range(half, end - 1) if text[i] == "。" or text.startswith(". ", i)]
                # Non-overlapping paragraph breaks, as a text is cut at each pair of line ends once.
                paragraphs = [i for i in paragraphs if i in {m.start() for m in T.BREAKS["paragraph"].finditer(text)}]
                end = paragraphs[-1] if paragraphs else sentences[-1] if sentences and sentences[-1] > half else end
            if text[at:end].strip():
                want.append((len(want) + 1, text[at:end].strip(), 1 + text.count("\n", 0, at)))
            if end >= len(text):
                break
            at = max(at + 1, end - overlap)
        assert T.windows(text, size, overlap) == want


def test_sections_and_pieces():
    text = "Some Title\n\nAbstract - we do.\n1 Introduction\nprose.\n```\n# no heading\n1 Not A Heading\n```\n2.1\nDeep Part\nmore\n# Results #\n" + "word " * 400 + "\n| a | b |\n| c | d |\n\nReferences\n[1] A\nAppendix A\nlast"
    found = M.categorised(M.sections_of(text))
    assert [(s.level, s.heading, s.category) for s in found] == [
        (0, "", "front_matter"), (1, "Abstract", "abstract"), (1, "1 Introduction", "introduction"), (2, "2.1 Deep Part", "body"), (1, "Results", "result"), (1, "References", "references"),
    ]
    assert "# no heading" in found[2].content and found[1].content == "Abstract - we do."
    pieces = list(M.split_document(text, 100, 600))
    assert {p[3] for p in pieces} == {"section", "prose", "table"} and all(len(p[6]) <= 600 for p in pieces)
    assert "".join("".join(p[6] for p in pieces).split()).count("word") == 400
    for p in pieces:
        assert 1 <= p[4] <= p[5]
    assert M.units_of("a\n\n```\n$$x$$\n```\n$$y$$") == [("prose", "a"), ("code", "```\n$$x$$\n```"), ("equation", "$$y$$")]
    assert M.normalized("a  \r\n\r\n\r\nb\n```\nx  \n\n\ny\n```\n\n\n\nc\n") == "a\n\nb\n```\nx  \n\n\ny\n```\n\nc"
    assert list(M.split_document("")) == [] and M.merged([M.Section(1, "a", 1, "x"), M.Section(1, "b", 2, "y")], 5, 50)[0].content == "x\n\nb\n\ny"


def rows_of(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


def test_assembly_and_coverage_by_plain_loops(spark):
    rng = random.Random(7)
    rows = [(f"q{i % 3}", i, f"p{rng.randint(0, 5)}", [f"t{rng.randint(0, 9)}" for _ in range(6)], rng.randint(100, 4000), round(rng.random(), 3), rng.random() < 0.1, rng.sample("abcde", rng.randint(0, 2)), rng.sample("abcde", 1), f"s{rng.randint(0, 3)}", i % 4, str(i % 2), str(i % 5)) for i in range(120)]
    names = "question string, id long, paper string, tokens array<string>, chars int, relevance double, locked boolean, slots array<string>, partial array<string>, source string, period int, section string, facet string"
    df = spark.createDataFrame(rows, names)
    order = [F.desc("relevance"), F.col("id")]
    got = {(r["question"], r["place"]): r["id"] for r in E.assemble(df, order, per_paper=2, alike=0.5, most_groups=6, most_chars=9000).collect()}
    for q in ("q0", "q1", "q2"):
        best, taken = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[5], r[1])), []
        for r in best:
            alike = [len(set(r[3]) & set(t[3])) / len(set(r[3]) | set(t[3])) for t in taken]
            if len(taken) < 6 and sum(t[2] == r[2] for t in taken) < 2 and sum(t[4] for t in taken) + r[4] <= 9000 and max(alike, default=0) <= 0.5:
                taken.append(r)
        assert [got[q, k] for k in range(len(taken))] == [t[1] for t in taken] and (q, len(taken)) not in got
    chosen = {(r["question"], r["place"]): r["id"] for r in E.select_covering(df, order, 5, most_chars=12000).collect()}
    for q in ("q0", "q1", "q2"):
        best = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[5], r[1]))
        wanted, taken = {s for r in best for s in r[7]}, []
        for r in best:
            if r[6] and sum(t[4] for t in taken) + r[4] <= 12000:
                taken.append(r)
        while not (wanted <= {s for t in taken for s in t[7]} and len(taken) >= 5):
            have = {s for t in taken for s in t[7]}

            def gain(r, have=have, taken=taken):
                like = max((len(set(r[3]) & set(t[3])) / len(set(r[3]) | set(t[3])) for t in taken), default=0)
                v = 8 * len(set(r[7]) - have) + 0.5 * len(set(r[8]) - have) + 0.35 * math.log1p(r[5]) + 0.3 * (r[9] not in {t[9] for t in taken}) + 0.3 * (r[10] not in {t[10] for t in taken}) - 1.25 * like
                return v / math.sqrt(max(1, r[4] / 1000))

            fits = [r for r in best if r not in taken and sum(t[4] for t in taken) + r[4] <= 12000]
            if not fits or (max(map(gain, fits)) <= 0 and wanted <= have):
                break
            taken.append(max(fits, key=lambda r: (gain(r), -best.index(r))))
        assert [chosen[q, k] for k in range(len(taken))] == [t[1] for t in taken] and (q, len(taken)) not in chosen
    picked = E.facets_first(df, order, 1, per_section=2, most_groups=8).collect()
    for q in ("q0", "q1", "q2"):
        mine = sorted((r for r in picked if r["question"] == q), key=lambda r: r["place"])
        assert len(mine) <= 8 and max(sum((x["paper"], x["section"]) == (y["paper"], y["section"]) for y in mine) for x in mine) <= 2
        assert [r["facet"] for r in mine[:5]] == sorted(r["facet"] for r in mine[:5])
    assert E.per_paper_cap(2, 12, 4) == 3 and E.per_paper_cap(2, 12, 0) == 12


def test_trees_of_any_depth_and_cycles(spark):
    """Before, ancestors beyond 63 levels were lost."""
    edges = [(i, i - 1 if i else None, f"n{i}") for i in range(200)] + [(1000 + i, 1000 + (i + 1) % 5, f"c{i}") for i in range(5)]
    df = spark.createDataFrame(edges, "node long, parent long, name string")
    got = {(a, n): d for a, n, d in rows_of(G.closure(df, "node", "parent"))}
    assert {k: d for k, d in got.items() if k[1] < 1000} == {(a, n): n - a for n in range(200) for a in range(n + 1)}
    assert {k: d for k, d in got.items() if k[1] >= 1000} == {(1000 + a, 1000 + n): (a - n) % 5 for a in range(5) for n in range(5)}


def test_phrases_within_words(spark):
    """Before, catalogs of more than a hundred thousand phrases raised, and others met every text."""
    texts = [(0, "xrayed the cabs"), (1, "a"), (2, ""), (3, None), (4, "zz top")]
    phrases = [("ray", 0), ("cab", 1), ("e c", 2), ("a", 3), ("top", 4), ("zz top", 5), ("", 6), ("yed the ca", 7)]
    got = dict(rows_of(R.longest_phrase(spark.createDataFrame(texts, "k long, t string"), "k", F.col("t"), spark.createDataFrame(phrases, "p string, o int"), "p", "o", words=False).filter("matched is not null")))
    assert got == {0: "yed the ca", 1: "a", 4: "zz top"}


def test_overflow_without_a_group(spark):
    rows = [(i, "completed" if i % 2 else "queued") for i in range(40)]
    df = spark.createDataFrame(rows, "n int, status string")
    got = [r["n"] for r in J.overflow(df, F.col("status"), F.col("n"), 5, F.col("n") == 39).orderBy("n").collect()]
    assert got == [*range(1, 31, 2), 39]


def test_critical_events_push_others_out():
    held: list = []
    for k, kind in enumerate(["log"] * 4 + ["progress"] + ["job"] * 6 + ["log"]):
        enters, leaves = J.admit(held, kind, 8)
        if leaves is not None:
            del held[leaves]
        if enters:
            held.append((k, kind))
    assert [k for k, _ in held] == [3, 5, 6, 7, 8, 9, 10, 11] and len(held) == 8


def test_equal_sets_and_small_sets_pair(spark):
    sets = [(0, ["a"]), (1, ["a"]), (2, ["a", "b"]), (3, []), (4, list("abcdefghij")), (5, list("abcdefghik")), (6, list("abcdefghijk"))]
    got = rows_of(S.near_sets(spark.createDataFrame(sets, "k long, t array<string>"), 0.5, "k", "t"))
    assert [(a, b, round(j, 4)) for a, b, j in got] == [(0, 2, 0.5), (4, 5, 0.8182), (4, 6, 0.9091), (5, 6, 0.9091)]


def test_quotes_and_folding(spark):
    df = spark.createDataFrame([("a&#8212;b &copy;&amp;lt; &#xZZ; &", "Ａｂ－ß ﬁn ", None)], "a string, b string, c string")
    assert tuple(df.select(X.normalize_quote(F.col("a")), X.lexical_key(F.col("b")), X.type_label(F.col("c"))).first()) == ("a—b ©&lt; &#xZZ; &", "ab_ss_fin", "entity")


@pytest.mark.parametrize("name", ["hybrid_topk", "tfidf_topk", "bm25_all", "facet_fusion"])
def test_texts_are_cut_once(name, spark, sf_dir):
    """What a ranking query still has to do reads written counts, not texts."""
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "text#" not in plan
