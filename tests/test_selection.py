"""Coverage selection and assembly by rounds, against plain loops over all candidates."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from scrivener.operators import selection as S


def like(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def plain_selection(groups: list[dict], budget: dict) -> list[str]:
    """All that is known is recounted from what is taken, at each step."""
    parent = lambda slot: budget["parents"].get(slot, slot)

    def facts(taken):
        direct = [(s["slot"], g["record"], s["period"]) for g in taken for s in g["support"] if s["status"] == "direct" and s["slot"] in budget["needs"]]
        covered = {slot: sum(d[0] == slot for d in direct) for slot in budget["needs"]}
        sources = {(parent(slot), record) for slot, record, _ in direct if record}
        periods = {(parent(slot), period) for slot, _, period in direct if period}
        return covered, sources, periods

    def score(g, taken):
        covered, sources, periods = facts(taken)
        short = {s for s, n in budget["needs"].items() if covered[s] < n}
        direct = [s for s in g["support"] if s["status"] == "direct"]
        full = sum(s["slot"] in short for s in direct)
        part = sum(s["confidence"] for s in g["support"] if s["status"] == "partial" and s["slot"] in short)
        new_sources = {parent(s["slot"]) for s in direct if g["record"] and (parent(s["slot"]), g["record"]) not in sources and sum(p == parent(s["slot"]) for p, _ in sources) < budget["sources"].get(parent(s["slot"]), 1)}
        new_periods = {parent(s["slot"]) for s in direct if s["period"] and (parent(s["slot"]), s["period"]) not in periods and sum(p == parent(s["slot"]) for p, _ in periods) < budget["periods"].get(parent(s["slot"]), 1)}
        fresh = g["record"] != "" and g["record"] not in {t["record"] for t in taken}
        value = 8 * full + 0.5 * part + 0.35 * math.log1p(max(0, g["relevance"])) + 0.3 * (fresh + len(new_sources)) + 0.3 * len(new_periods) - 1.25 * max((like(set(g["tokens"]), set(t["tokens"])) for t in taken), default=0)
        return value / math.sqrt(max(1, g["chars"] / 1000))

    def all_covered(taken):
        covered, sources, periods = facts(taken)
        return all(covered[s] >= n for s, n in budget["needs"].items()) and all(sum(p == r for p, _ in sources) >= n for r, n in budget["sources"].items()) and all(sum(p == r for p, _ in periods) >= n for r, n in budget["periods"].items())

    groups, taken = sorted(groups, key=lambda g: g["ord"]), []
    fits = lambda g: sum(t["chars"] for t in taken) + g["chars"] <= budget["chars"]
    for g in groups:
        if g["locked"] and fits(g) and len(taken) < budget["most"]:
            taken.append(g)
    while len(taken) < budget["most"]:
        if budget["needs"] and (all_covered(taken) and len(taken) >= budget["least"] or len(taken) >= budget["target"]):
            break
        if not budget["needs"] and len(taken) >= budget["target"]:
            break
        left = [g for g in groups if g not in taken and fits(g)]
        if not left:
            break
        best = max(left, key=lambda g: (round(score(g, taken), 10), -g["ord"]))
        if budget["needs"] and score(best, taken) <= 0 and len(taken) >= budget["least"]:
            break
        taken.append(best)
    return [g["grp"] for g in taken]


SLOTS = ["a", "b", "c", "d"]


def made(rng: random.Random, question: str, n: int) -> list[dict]:
    out = []
    for i in range(n):
        support = [{"slot": s, "status": rng.choice(["direct", "partial", "unsupported"]), "confidence": round(rng.random(), 2), "period": rng.choice(["", "1999", "2001"])} for s in rng.sample([*SLOTS, "other"], rng.randint(0, 3))]
        out.append({"question": question, "grp": f"g{i}", "record": rng.choice(["", "p1", "p2", "p3"]), "ord": i, "tokens": sorted({rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))}), "chars": rng.choice([200, 900, 2500, 7000]), "relevance": rng.choice([0.0, 0.4, 2.0]), "locked": rng.random() < 0.1, "support": support})
    return out


SCHEMA = f"question string, grp string, record string, ord long, tokens array<string>, chars long, relevance double, locked boolean, support {S.SUPPORT}"


def test_selection_equals_the_plain_loop(spark):
    rng = random.Random(11)
    groups = {f"q{k}": made(rng, f"q{k}", rng.choice([0, 3, 25, 150])) for k in range(14)}
    needs = [{"question": q, "slot": s, "parent": rng.choice(["R", "T", s]), "need": rng.randint(1, 2), "sources": rng.choice([1, 2]), "periods": rng.choice([0, 1, 2])} for q in groups if q not in ("q0", "q1") for s in rng.sample(SLOTS, rng.randint(1, 4))]
    requirements = spark.createDataFrame(needs, "question string, slot string, parent string, need int, sources int, periods int")
    budget = S.budgets(requirements, spark.createDataFrame([(q, rng.choice([None, 9])) for q in groups], "question string, requested int"), 4, 12, 9000)
    df = spark.createDataFrame([g for gs in groups.values() for g in gs], SCHEMA)
    got: dict[str, list[str]] = {}
    chosen = S.select_covering(df, budget)
    for r in chosen.orderBy("question", "place").collect():
        got.setdefault(r["question"], []).append(r["grp"])
    for b in budget.collect():
        assert got.get(b["question"], []) == plain_selection(groups[b["question"]], b.asDict()), b["question"]
    report = {r["question"]: r for r in S.coverage_report(df, chosen, budget).collect()}
    for b in budget.collect():
        q, r = b["question"], report[b["question"]]
        taken = [g for g in groups[q] if g["grp"] in got.get(q, [])]
        direct = [(s["slot"], g["record"], s["period"]) for g in taken for s in g["support"] if s["status"] == "direct" and s["slot"] in b["needs"]]
        missing = sorted(s for s, n in b["needs"].items() if sum(d[0] == s for d in direct) < n)
        parent = lambda s, b=b: b["parents"][s]
        unmet = {parent(s) for s in missing} | {p for p, n in b["sources"].items() if len({d[1] for d in direct if parent(d[0]) == p and d[1]}) < n} | {p for p, n in b["periods"].items() if len({d[2] for d in direct if parent(d[0]) == p and d[2]}) < n}
        assert (r["candidates"], r["selected"], r["missing_slots"], r["unsupported"]) == (len(groups[q]), len(taken), missing, sorted(unmet))
    assert sum(map(len, got.values())) > 40


def test_budgets(spark):
    """Four requirements with two pieces each want eight groups; a chronology has slots of its own."""
    rows = [("q", f"r{i}", f"r{i}", 2, 1, 0) for i in range(4)] + [("t", s, "time", 1, 2, 3) for s in ("early", "mid", "late")]
    requirements = spark.createDataFrame(rows, "question string, slot string, parent string, need int, sources int, periods int")
    got = {r["question"]: r for r in S.budgets(requirements, spark.createDataFrame([("q",), ("t",), ("none",)], "question string"), 3, 12, 10).collect()}
    assert (got["q"]["target"], got["q"]["most"], got["q"]["chars"], got["q"]["needs"]["r1"]) == (8, 12, 1000, 2)
    assert (got["t"]["target"], got["t"]["sources"], got["t"]["periods"], got["t"]["parents"]["mid"]) == (3, {"time": 2}, {"time": 3}, "time")
    assert (got["none"]["target"], got["none"]["needs"]) == (3, {})


def test_support_of_a_group(spark):
    rows = [("g", "a", "partial", 0.9, "x"), ("g", "a", "direct", 0.2, "y"), ("g", "a", "direct", 0.5, "z"), ("g", "b", "unsupported", None, None)]
    (r,) = S.merged_support(spark.createDataFrame(rows, "grp string, slot string, status string, confidence double, period string"), ["grp"]).collect()
    assert [tuple(s) for s in r["support"]] == [("a", "direct", 0.5, "z"), ("b", "unsupported", 0.0, "")]


# Assembly


def plain_assembly(members: list[dict], cap: int, alike: float, chunks: int, chars: int) -> list[tuple[str, int]]:
    out, sets, papers = [], [], {}
    by_group = {}
    for m in members:
        by_group.setdefault(m["grp"], []).append(m)
    found = [(min(m["ord"] for m in ms if m["ord"] is not None), g) for g, ms in by_group.items() if any(m["ord"] is not None for m in ms)]
    for ord_, g in sorted(found):
        ms = sorted(by_group[g], key=lambda m: m["seq"])
        seed = next(i for i, m in enumerate(ms) if m["ord"] == ord_)
        words = {t for m in ms for t in m["tokens"]}
        if papers.get(ms[0]["record"], 0) >= cap or any(like(words, s) > alike for s in sets):
            continue
        room, space = chunks - len(out), chars - sum(c for *_, c in out)
        take = ms
        if len(ms) > room or sum(m["chars"] for m in ms) > space:
            if not ms[0]["structured"]:
                continue
            k = min(room, len(ms))
            low = max(0, min(seed - k // 2, len(ms) - k))
            take = ms[low : low + k]
            while sum(m["chars"] for m in take) > space and len(take) > 1:
                take = take[1:] if take.index(ms[seed]) >= len(take) / 2 else take[:-1]
            if sum(m["chars"] for m in take) > space:
                continue
        out += [(g, m["chunk"], m["chars"]) for m in take]
        sets.append(words)
        papers[ms[0]["record"]] = papers.get(ms[0]["record"], 0) + 1
        if len(out) >= chunks:
            break
    return [(g, c) for g, c, _ in out]


def test_assembly_equals_the_plain_walk(spark):
    rng = random.Random(5)
    members: dict[str, list[dict]] = {}
    for q in (f"q{k}" for k in range(10)):
        rows, chunk = [], 0
        for g in range(rng.choice([2, 12, 60])):
            n = rng.choice([1, 1, 1, 4, 9])
            rank = rng.sample(range(1000 * g, 1000 * g + n), n)
            record = f"p{rng.randrange(6)}"
            for i in range(n):
                rows.append({"question": q, "grp": f"g{g}", "record": record, "chunk": chunk, "seq": i, "ord": rank[i] if n == 1 or rng.random() < 0.5 else None, "structured": n > 1, "tokens": [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 5))], "chars": rng.choice([100, 800, 2500])})
                chunk += 1
        rng.shuffle(rows)
        members[q] = rows
    df = spark.createDataFrame([m for ms in members.values() for m in ms], "question string, grp string, record string, chunk int, seq int, ord long, structured boolean, tokens array<string>, chars int")
    cap = S.per_paper(df, 2, 8)
    caps = {r["question"]: r["cap"] for r in cap.collect()}
    got: dict[str, list] = {}
    for r in S.assemble(df, cap, 0.6, 7, 6000).orderBy("question", "place", "chunk").collect():
        got.setdefault(r["question"], []).append((r["grp"], r["chunk"]))
    for q, ms in members.items():
        papers = len({m["record"] for m in ms})
        assert caps[q] == max(2, math.ceil(8 / papers))
        assert got.get(q, []) == plain_assembly(ms, caps[q], 0.6, 7, 6000), q
    assert S.assemble(df.limit(0), cap.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_window_around_the_seed(seed):
    rng = random.Random(seed)
    for _ in range(300):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(1, 12))]
        at, chunks, chars = rng.randrange(len(sizes)), rng.randint(1, 12), rng.randint(1, 60)
        begin, end = S.fitted(sizes, at, chunks, chars)
        if sizes[at] > chars and not (len(sizes) <= chunks and sum(sizes) <= chars):
            assert (begin, end) == (0, 0)
        else:
            assert begin <= at < end and end - begin <= chunks and sum(sizes[begin:end]) <= chars


def test_facets_first_equals_the_plain_walk(spark):
    from scrivener.operators import evidence as E

    rng = random.Random(8)
    rows = [(f"q{q}", i, rng.choice("abc"), rng.choice(["p", "r"]), rng.choice(["1", "2"]), rng.choice([100, 900, 5000]), rng.random()) for q in range(8) for i in range(rng.choice([1, 10, 60]))]
    df = spark.createDataFrame(rows, "question string, id int, facet string, paper string, section string, chars int, relevance double")
    got: dict[str, list[int]] = {}
    for r in E.facets_first(df, [F.desc("relevance"), F.col("id")], 2, 2, 9, 9000).orderBy("question", "place").collect():
        got.setdefault(r["question"], []).append(r["id"])
    for q in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[6], r[1]))
        taken: list[tuple] = []

        def fits(r, taken=taken):
            return r not in taken and len(taken) < 9 and sum(t[5] for t in taken) + r[5] <= 9000 and sum(t[3:5] == r[3:5] for t in taken) < 2

        for facet in sorted({r[2] for r in mine}):
            before = len(taken)
            for r in mine:
                if r[2] == facet and len(taken) - before < 2 and fits(r):
                    taken.append(r)
        for r in mine:
            if fits(r):
                taken.append(r)
        assert got.get(q, []) == [r[1] for r in taken]


def test_queries_over_whole_tables_equal_the_plain_loops(spark, sf_dir):
    from scrivener import registry
    from scrivener.plans import evidence as plan

    rows = [r.asDict(recursive=True) for r in plan._groups(spark, sf_dir).collect()]
    budget = {b["question"]: b.asDict() for b in plan._budget(spark, plan._groups(spark, sf_dir)).collect()}
    got: dict[str, list] = {}
    for r in registry.queries()["coverage_rounds"](spark, sf_dir).orderBy("question", "place").collect():
        got.setdefault(r["question"], []).append(r["grp"])
    assert len(rows) > 100 and len(got) == 4
    for q, b in budget.items():
        assert got[q] == plain_selection([r for r in rows if r["question"] == q], b)
    put: dict[str, list] = {}
    for r in registry.queries()["assembly_rounds"](spark, sf_dir).orderBy("question", "place").collect():
        put.setdefault(r["question"], []).append((r["grp"], r["chunk"]))
    for q in budget:
        mine = [{**r, "chunk": r["ord"], "seq": 0, "structured": False} for r in rows if r["question"] == q]
        cap = max(2, math.ceil(8 / len({r["record"] for r in mine})))
        assert put[q] == plain_assembly(mine, cap, 0.5, 12, 18_000)
