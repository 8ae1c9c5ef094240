"""Retrieval from the shortlist to the selection, stage by stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_selection import plain_selection

from scrivener.operators import retrieval as V
from scrivener.operators import search as S
from scrivener.operators import selection as L
from scrivener.plans import search as plan

WORDS = {1: "quantum lattice cipher", 2: "wheat harvest yield", 3: "lattice reduction attack", 4: "harvest machine engine", 5: "unrelated prose entirely"}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for record, words in WORDS.items():
        for chunk in range(6):
            text = f"{words} part {chunk} " + " ".join(f"w{record}x{chunk}y{i}" for i in range(8 + chunk))
            rows.append((record * 100 + chunk, record, chunk, f"s{chunk}", text, "steps" if chunk in (2, 3) else None, chunk))
    chunks = spark.createDataFrame(rows, "key long, record long, chunk int, section string, text string, structure string, seq int")
    papers = spark.createDataFrame([(r, w, "") for r, w in WORDS.items()], "record long, title string, text string")
    return papers, chunks


def test_shortlist_falls_back_to_all(corpus):
    papers, _ = corpus

    def of(specs: dict, limit: int) -> tuple[list[int], str]:
        found, why = V.shortlisted(papers, specs, limit)
        return sorted(r["record"] for r in found.collect()), why

    assert of({"q": "lattice"}, 5) == ([1, 2, 3, 4, 5], "within_limit")
    assert of({"q": " ", "r": ""}, 2) == ([1, 2, 3, 4, 5], "no_query_specs")
    assert of({"q": "nowhere"}, 2) == ([1, 2, 3, 4, 5], "no_metadata_overlap")
    assert of({"q": "lattice"}, 2) == ([1, 3], "shortlisted")


def test_facade(spark, corpus):
    _, chunks = corpus
    got = V.retrieve(chunks, "lattice cipher missingword", least=4, per_paper=2, alike=0.9, most_chunks=5)
    rows, (d,) = got.evidence.orderBy("place", "chunk").collect(), got.diagnostics.collect()
    assert {r["record"] for r in rows} <= {1, 3} and 3 <= len(rows) <= 5 == d["evidence"] + 5 - len(rows)
    assert rows[0]["record"] == 1 and d["query_coverage"] == round(2 / 3, 4) and d["cap"] == 2 and d["papers"] == 2
    best = S.hybrid(V.grouped(chunks), "lattice cipher missingword", ["lattice", "cipher", "missingword"], "key", "text", None, "section").agg(F.max("score")).first()[0]
    assert d["top_score"] == round(best, 4)
    nothing = V.retrieve(chunks, "nowhere at-all")
    assert nothing.evidence.count() == 0 and nothing.diagnostics.first()["query_coverage"] == 0


def test_fusion_keeps_the_order_of_facets(spark):
    runs = spark.createDataFrame([("a", 1, 0, 0.5), ("b", 1, 0, 0.9), ("c", 1, 3, 0.1), ("b", 2, 1, 0.4)], "question string, key long, place int, score double")
    got = {r["key"]: r for r in V.fused_facets(runs, ["a", "b", "c"]).collect()}
    first = 0.5 + 1 / 21
    assert got[1]["fusion"] == pytest.approx(max(max(first + 0.08, 0.9 + 1 / 21) + 0.08, 0.1 + 1 / 24)) and got[1]["facets"] == ["a", "b", "c"] and got[1]["score"] == 0.9
    assert got[2]["fusion"] == pytest.approx(0.4 + 1 / 22)


FACETS = {"crypt": "lattice cipher", "farm": "harvest yield", "none": "nowhere"}
NEEDS = [("p", "P", 2, 2, 0), ("q", "Q", 1, 1, 1)]


def matrix_of(spark, chunks):
    says = F.array(F.struct(F.lit("p").alias("slot"), F.when(F.col("record") <= 2, "direct").otherwise("partial").alias("status")), F.struct(F.lit("q").alias("slot"), F.when(F.col("chunk") == 1, "direct").otherwise("unsupported").alias("status")))
    return chunks.select("record", "chunk", F.explode(says).alias("s")).select("record", "chunk", "s.slot", "s.status", F.lit(0.5).alias("confidence"), F.lit("2001").alias("period"))


def test_all_stages(spark, corpus):
    papers, chunks = corpus
    needs = spark.createDataFrame(NEEDS, "slot string, parent string, need int, sources int, periods int")
    seeds = spark.createDataFrame([(2, 5, 0.3), (5, 1, 0.2), (99, 0, 0.9)], "record long, chunk int, score double")
    graph = spark.createDataFrame([(4, 0, 0.7)], "record long, chunk int, score double")
    targets = spark.createDataFrame([(3, 5, 0), (3, 2, 1)], "record long, chunk int, place int")
    got = V.evidence_for(papers, chunks, "lattice or harvest", FACETS, needs, matrix_of(spark, chunks), seeds, graph, targets, requested=9, limit=10, least=3)
    rows, (d,) = got.evidence.orderBy("place", "chunk").collect(), got.diagnostics.collect()
    by_place = [r["grp"] for r in rows]
    assert by_place[0] == "3|c:5" and rows[0]["locked"] and "3|s:steps" in by_place  # what is asked for comes first
    assert (d["shortlist"], d["strategy"], d["missing_facets"], d["covered_facets"]) == ("within_limit", "coverage_aware", ["farm", "none"], ["crypt"])  # one group gives what both needs lack
    assert d["missing_slots"] == [] and d["unsupported"] == [] and d["evidence"] == len(rows) and d["facet_coverage"] == round(1 / 3, 4)
    assert len({r["record"] for r in rows if r["record"] <= 2}) == 2  # two sources for p
    # Without an evaluation everything is kept; without requirements the best groups are.
    kept = V.evidence_for(papers, chunks, "lattice or harvest", FACETS, needs, None, seeds, graph, targets, limit=10)
    assert kept.diagnostics.first()["strategy"] == "preserve_all" and kept.evidence.select("grp").distinct().count() == kept.diagnostics.first()["candidates"]
    few = V.evidence_for(papers, chunks, "lattice or harvest", FACETS, targets=targets, limit=10, least=3)
    assert few.diagnostics.first()["strategy"] == "limited" and few.evidence.select("grp").distinct().count() == 3
    assert few.evidence.filter("place = 0").first()["grp"] == "3|c:5"


def test_seeds_that_are_verified_are_locked(spark, corpus):
    papers, chunks = corpus
    needs = spark.createDataFrame(NEEDS, "slot string, parent string, need int, sources int, periods int")
    seeds = spark.createDataFrame([(2, 5, 0.3), (5, 4, 0.2)], "record long, chunk int, score double")
    rows = {r["grp"]: r for r in V.evidence_for(papers, chunks, "lattice", {"crypt": "lattice cipher"}, needs, matrix_of(spark, chunks), seeds, limit=10).evidence.collect()}
    assert rows["2|c:5"]["locked"] and rows["2|c:5"]["existing"] and rows["2|c:5"]["place"] == 0
    assert "5|c:4" not in rows or not rows["5|c:4"]["locked"]


def test_selection_of_the_whole_table_equals_the_plain_loop(spark, sf_dir, monkeypatch):
    """The groups that reach the selection, selected by the plain loop."""
    seen = {}

    def spy(groups, budget, weights=None):
        seen["groups"], seen["budget"] = groups.collect(), budget.first().asDict()
        return chosen(groups, budget, weights)

    chosen = L.select_covering
    monkeypatch.setattr(V.L, "select_covering", spy)
    got = plan.evidence_retrieval(spark, sf_dir).collect()
    groups = [g.asDict(recursive=True) for g in seen["groups"]]
    want = plain_selection(groups, seen["budget"])
    order = sorted({(r["place"], r["record"]) for r in got})
    assert [int(g.split("|")[0]) for g in want] == [r for _, r in order] and len(want) == len(order)
