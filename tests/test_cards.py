"""Cards of payloads, how they are stored, and contexts, against plain versions."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from scrivener.operators import cards as K

TEXTS = {"p1:0": "We  propose Alpha\nfor fast search.", "p1:1": "Beta beats Alpha by 3 %.", "p2:0": "Gamma is old."}


def payload(rng: random.Random) -> object:
    quote = lambda: rng.choice([*["propose Alpha for fast", "Beta beats", "Gamma is old."] * 3, "nowhere", "", " fast\n search. "])
    refs = lambda: rng.choice([None, "text"] if rng.random() < 0.1 else [[rng.choice([5, {"ref": rng.choice([*TEXTS, "p1:0", "p1:1", "p2:0", "p9:0", ""]), "quote": quote()}]) for _ in range(rng.randint(1, 6))]])
    word = lambda: rng.choice(["Alpha", "beats", " Beta ", "Alpha", "is", "Beta", "", None, 7])
    claims = [rng.choice([5, {"kind": rng.choice(["", "result", None]), "subject": word(), "predicate": word(), "object": word(), "confidence": rng.choice([0.5, 7, -1, "x", None]), "evidence": refs()}]) for _ in range(rng.randint(0, 40))]
    relations = [{rng.choice(["relation_type", "relationType"]): word(), rng.choice(["target_label", "targetLabel"]): word(), "targetType": rng.choice(["paper", "", None]), "evidence": refs()} for _ in range(rng.randint(0, 25))]
    facets = [rng.choice([1, {"name": rng.choice(["task", "", "data"]), "values": rng.choice([["a", " a ", "", "b"], [], None])}]) for _ in range(rng.randint(0, 4))]
    return rng.choice([*[{"summary": " s ", "sourceLanguage": "en", "claims": claims, rng.choice(["relation_candidates", "relationCandidates"]): relations, "facets": facets}] * 3, {"claims": claims}, [1], "no"])


def text_of(x) -> str:
    return "" if x is None else str(x).strip()


def plain_refs(paper: str, raw) -> list[tuple]:
    out = []
    for r in raw if isinstance(raw, list) else []:
        if isinstance(r, dict) and text_of(r["quote"]) and text_of(r["ref"]).startswith(paper) and text_of(r["ref"]) in TEXTS:
            if " ".join(text_of(r["quote"]).split()) in " ".join(TEXTS[r["ref"]].split()) and (r["ref"], text_of(r["quote"])) not in out:
                out.append((r["ref"], text_of(r["quote"])))
    return out


def test_payloads(spark):
    rng = random.Random(12)
    seen = 0
    for _ in range(10):
        rows = [("p1", payload(rng)), ("p2", payload(rng)), ("p3", payload(rng))]
        df = spark.createDataFrame([(p, json.dumps(v)) for p, v in rows], "paper string, s string").select("paper", F.try_parse_json("s").alias("v"))
        evidence = spark.createDataFrame([(r.split(":")[0], r, "sec", t, "paper_text", 1.0) for r, t in TEXTS.items()], "paper string, ref string, section string, text string, origin string, confidence double")
        got = K.normalized_cards(df, evidence)
        claims, relations = got.claims.collect(), got.relations.collect()
        told = {r["paper"]: r for r in got.diagnostics.collect()}
        want_claims, want_relations = [], []
        for paper, v in rows:
            v = v if isinstance(v, dict) else {}
            rejected = 0
            for at, c in enumerate(v.get("claims", [])):
                if isinstance(c, dict):
                    s, p, o, refs = text_of(c["subject"]), text_of(c["predicate"]), text_of(c["object"]), plain_refs(paper, c["evidence"])
                    if s and p and o and refs:
                        ident = hashlib.sha256("\x1f".join(x.strip().casefold() for x in (paper, c["kind"] or "", s, p, o)).encode()).hexdigest()[:24]
                        sure = c["confidence"] if isinstance(c["confidence"], (int, float)) else 0
                        want_claims.append((paper, at, f"claim:{ident}", c["kind"] or "statement", max(0, min(1, sure)), refs))
                    else:
                        rejected += 1
            for at, r in enumerate(v.get("relation_candidates", v.get("relationCandidates", []))):
                kind, target, refs = text_of(r.get("relation_type", r.get("relationType"))), text_of(r.get("target_label", r.get("targetLabel"))), plain_refs(paper, r["evidence"])
                if kind and target and refs:
                    want_relations.append((paper, at, kind, target, r["targetType"] or "unresolved_label", refs))
            assert told[paper]["incomplete_claims"] + told[paper]["unverified_claims"] == rejected
        assert sorted((c["paper"], c["at"], c["id"], c["kind"], c["confidence"], [(x["ref"], x["quote"]) for x in c["refs"]]) for c in claims) == sorted(want_claims)
        assert sorted((r["paper"], r["at"], r["type"], r["target"], r["target_type"], [(x["ref"], x["quote"]) for x in r["refs"]]) for r in relations) == sorted(want_relations)
        for paper, v in rows:
            names = {text_of(f["name"]): list(dict.fromkeys(text_of(x) for x in f["values"] if text_of(x))) for f in (v.get("facets", []) if isinstance(v, dict) else []) if isinstance(f, dict) and f["values"] and any(map(text_of, f["values"])) and text_of(f["name"])}
            assert {r["name"]: r["values"] for r in got.facets.filter(F.col("paper") == paper).collect()} == names
        seen += len(claims) + len(relations)
    assert seen > 5


def test_storing(spark):
    old = spark.createDataFrame([("a", 1, "then"), ("b", 2, "then")], "k string, n int, created string")
    new = spark.createDataFrame([("b", 3, None), ("c", 4, None)], old.schema)
    assert sorted(map(tuple, K.saved(old, new, "k", "created", F.lit("now")).collect())) == [("a", 1, "then"), ("b", 3, "then"), ("c", 4, "now")]
    scope = spark.createDataFrame([("a",), ("c",)], "k string")
    assert sorted(map(tuple, K.rewritten(old, new, scope, ["k"]).collect()), key=str) == [("b", 2, "then"), ("c", 4, None)]
    staged = spark.createDataFrame([(1, "validated"), (2, "validated"), (3, "failed")], "k int, status string")
    assert sorted(map(tuple, K.committed(staged, spark.createDataFrame([(1,), (3,)], "k int"), ["k"]).collect())) == [(1, "committed"), (2, "validated"), (3, "failed")]
    pairs = lambda *x: spark.createDataFrame(list(x), "project string, paper string")
    papers = spark.createDataFrame([(p,) for p in "xyz"], "paper string")
    members, excluded = K.replaced_members(pairs(("P", "x"), ("P", "y"), ("Q", "x")), pairs(("P", "z"), ("P", "z")), papers, pairs(("P", "x"), ("P", "z"), ("Q", "y")))
    assert sorted(map(tuple, members.collect())) == [("P", "z"), ("Q", "x")] and [tuple(r) for r in excluded.collect()] == [("P", "x")]
    with pytest.raises(ValueError, match="w"):
        K.replaced_members(members, pairs(("P", "w")), papers)


def test_context(spark):
    rows = [("q", 2, None, None, None, "s", None, 1, "s:0", "s:2", True, " two "), ("q", 1, "T", "1999", "Intro", None, None, None, None, None, False, "one\n"), ("q", 3, "U", "", "", "s", "table", 0, None, "s:1", None, "three")]
    df = spark.createDataFrame(rows, "g string, o int, title string, year string, section string, structure string, kind string, seq int, continues_from string, continues_to string, by_graph boolean, text string")
    assert K.context(df, "g", "o").first()["context"] == "[1] T · 1999 · 章节：Intro\none\n\n---\n\n[2] 未命名文献 · 连续结构：structure 第 2 段，前后均有连续片段 · 检索路径：知识图谱导航后已回查原文\ntwo\n\n---\n\n[3] U · 连续结构：table 第 1 段，后续仍有连续片段\nthree"


def test_builds(spark):
    log = [("a", 1, "finished", "v0", "ready", None), ("a", 2, "started", "v1", None, None), ("a", 3, "finished", "v1", "failed", "x" * 9), ("a", 4, "finished", "v1", "ready", None), ("b", 1, "started", "v1", None, None), ("b", 2, "finished", "v1", "ready", None), ("b", 3, "started", "v2", None, None), ("c", 1, "finished", "v1", "ready", None), ("d", 1, "started", "v1", None, None), ("d", 2, "finished", "v1", "failed", "long error")]
    df = spark.createDataFrame(log, "paper string, n int, kind string, version string, status string, error string").withColumn("at", F.col("n"))
    builds = K.build_states(df, "paper", "n", "kind", ["version"], "status", "error", "at", 4)
    assert sorted(map(tuple, builds.collect())) == [("a", "v1", "ready", "", 2, 4), ("b", "v2", "running", "", 3, None), ("d", "v1", "failed", "long", 1, 2)]
    assert [r["paper"] for r in K.statuses_of(builds, "paper", ["d", " a ", "", None, "zz", "a", "d"]).collect()] == ["d", "a"]


def test_scopes_sources_and_files(spark, tmp_path):
    from scrivener.operators import knowledge as N
    from scrivener.sources import landed

    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "record string")
    assert sorted(r[0] for r in N.restricted(ids("b", "b"), ids("a", "b"), "record").collect()) == ["b"]
    assert sorted(r[0] for r in N.restricted(ids("b").limit(0), ids("a", "b"), "record").collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="c, d"):
        N.restricted(ids("d", "a", "c"), ids("a"), "record")
    turns = spark.createDataFrame([(1, [("a", 1), ("z", 2), ("b", 3)]), (2, []), (3, None), (4, [("z", 1)])], "k int, sources array<struct<record:string,chunk:int>>")
    got = {r["k"]: r["sources"] for r in N.sources_within(turns, ids("a", "b"), ["k"], "sources").collect()}
    assert [x["record"] for x in got[1]] == ["a", "b"] and got[2] == [] and not got[3] and got[4] == []

    items = [{"DOI": f"10.1/{i}", "title": ["T"], "published-online": {"date-parts": [[2000 + i]]}} for i in range(5)]
    (tmp_path / "c.json").write_text(json.dumps({"message": {"items": items}}))
    rows, failed = landed.searched(spark, {"crossref": str(tmp_path / "c.json"), "nobody": "x", "atom": str(tmp_path / "missing.xml")}, 2)
    assert [r["year"] for r in rows.orderBy("year").collect()] == [2003, 2004] and set(failed) == {"nobody", "atom"} and failed["nobody"] == "unknown source"
    assert landed.searched(spark, {"nobody": "x"}) == (None, {"nobody": "unknown source"})
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.pdf").write_bytes(b"\x00content")
    (tmp_path / "d/b.txt").write_bytes(b"other")
    (f,) = landed.hashed_files(spark, str(tmp_path)).collect()
    assert f["path"].endswith("d/a.pdf") and (f["size"], f["sha256"]) == (8, hashlib.sha256(b"\x00content").hexdigest())
