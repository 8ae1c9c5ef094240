"""Findings of round 4: what is sent through the driver, what is shuffled, and what is counted, each with its result."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from scrivener import registry
from scrivener.operators import citations as C
from scrivener.operators import library as L
from scrivener.operators import search as S
from scrivener.plans import library as plan


def test_tables_that_are_small_on_disk_are_not_sent_through_the_driver(spark, tmp_path):
    """60,000 references and titles are some hundred kB on disk, by which Spark sent them whole to every task."""
    n = L.MOST_SENT + 10_000
    spark.range(n).selectExpr("id as citation", "concat('Lee. The theory of part ', id, '. In it') as text", "concat('10.1/', id) as doi").write.parquet(f"{tmp_path}/refs")
    spark.range(n).selectExpr("id as document", "concat('the theory of part ', id) as title", "concat('10.1/', id) as doi").write.parquet(f"{tmp_path}/titles")
    refs, titles = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("refs", "titles"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = L.local_document(refs, titles)
        joins = found._jdf.queryExecution().executedPlan().toString()
        inner = [line for line in joins.splitlines() if "Join" in line and "Inner" in line]
        assert len(inner) == 2 and all("SortMergeJoin" in line for line in inner)
        assert found.filter("document = citation").count() == n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_contexts_are_counted_as_they_are_listed(spark, monkeypatch):
    """counts equal those of the listed contexts, and leave a text as numbers: no quote is written or shuffled."""
    saved, save = [], C.Scratch.save
    monkeypatch.setattr(C.Scratch, "save", lambda self, df: saved.append(df.columns) or save(self, df))
    rng = random.Random(4)
    say = ["word", "\n# Head\n", "[1]", "[2, 4-6]", "[3;9–8]", "Smith-Jones et al. (1995)", "O'Brien, 2001", "brien 2001", "Vries said 1995", "MILLER 1995.", "ſmith 2001 "]
    texts = [(i, " ".join(rng.choice(say) for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(80, None), (81, "Miller 1995 [1]")]
    refs = [(i, n, rng.choice([1995, 2001, None]), rng.sample(["Miller", "O'Brien", "Jones", "Smith-Jones", "Vries", "Li"], rng.randint(0, 5))) for i in range(82) for n in (1, 2, 5, 5)]
    docs, references = spark.createDataFrame(texts, "d int, t string"), spark.createDataFrame(refs, "d int, number int, year int, author_keys array<string>")
    got = {(r["d"], r["number"]): r["contexts"] for r in C.context_counts(docs, references, "d", "t").collect()}
    want = {(r["d"], r["number"]): r["count"] for r in C.contexts_of(docs, references, "d", "t").groupBy("d", "number").count().collect()}
    assert got == want and len(want) > 100 and saved == [["d", "marker", "name", "year", "at"]]


def test_names_are_found_from_behind_as_from_the_front():
    """a long run of letters took the square of its length, and each text was read twice."""
    front = C.re.compile(rf"(?i)([{C.NAME}]+)(?:\s+et\s+al\.?)?\s*[,;(]?\s*\b((?:19|20)\d{{2}})\b")
    rng = random.Random(5)
    say = ["Smith", "et", "al", "al.", " ", "\n", ",", "(", "1995", "2001", "19", "’", "-", "É", "Ÿ", "K", "ſ", "ET", "_", "x1", "20١٢", ".", "中", " et al. ", " et al 2001"]
    for _ in range(20_000):
        text = "".join(rng.choice(say) for _ in range(rng.randint(1, 14)))
        assert C._named(text) == [(*m.span(), (C.endings(m[1]), int(m[2]))) for m in front.finditer(text)], text
    assert C._named("a" * 300_000 + " 1995")[0][:2] == (0, 300_005)


def test_all_contexts_of_a_reference_are_counted(spark):
    """eight contexts of a reference were the most that there could be, and its fourth surname cited nothing."""
    text = "\n".join(f"Line {i} cites [1] here, and Delta et al. (1995) there; Alpha 1995." for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, "Delta 1995")], "d int, t string")
    refs = spark.createDataFrame([(d, 1, 1995, ["Alpha", "Beta", "Gamma", "Delta"]) for d in (1, 2)], "d int, number int, year int, author_keys array<string>")
    assert sorted(tuple(r) for r in C.context_counts(docs, refs, "d", "t").collect()) == [(1, 1, 8, 90), (2, 1, 0, 1)]
    every = C.contexts_of(docs, refs, "d", "t", None, None)
    assert sorted(tuple(r) for r in every.groupBy("d", "number").count().collect()) == [(1, 1, 90), (2, 1, 1)]
    assert [r["count"] for r in C.contexts_of(docs, refs, "d", "t").groupBy("d").count().collect()] == [8]


def test_document_citations_counts_all_places(spark, sf_dir):
    """how often a text cites a reference isn't cut at eight."""
    bodies = {r["doc_id"]: r["body"] for r in plan._cited_documents(spark, sf_dir).collect()}
    rows = registry.queries()["document_citations"](spark, sf_dir).filter("number = 1").collect()
    for r in rows:
        text = bodies[r["doc_id"]]
        quotes = {(text.count("\n", 0, m.start()), " ".join(text[max(0, m.start() - 180) : m.end() + 180].split())) for m in C.NUMBERS.finditer(text) if m[1] == "1"}
        assert r["contexts"] == min(8, r["cited"]) and r["cited"] >= len(quotes)
    assert max(r["cited"] for r in rows) > 8


def test_tokens_of_sets_are_not_shuffled_one_by_one(spark, monkeypatch):
    """each token was shuffled with its set and its count, and sets once more for each pair that a frequent token made."""
    saved, save = [], S.Scratch.save
    monkeypatch.setattr(S.Scratch, "save", lambda self, df: saved.append(df) or save(self, df))
    sets = spark.range(3000).selectExpr("id as k", "transform(sequence(1, 200), i -> concat('t', (id div 2) * 7 + i * i + if(i < 190, 0, id % 2))) as t")
    found = S.near_sets(sets, 0.82, "k", "t")
    assert len(saved) == 1 and saved[0]._jdf.queryExecution().executedPlan().toString().count("Generate") == 0
    joins = found._jdf.queryExecution().executedPlan().toString()
    assert joins.count("Generate") == 4 and "ObjectHashAggregate" not in joins  # places and blocks of prefixes, of both sides
    pairs = {(r["a"], r["b"]) for r in found.collect()}
    assert {(2 * i, 2 * i + 1) for i in range(1500)} <= pairs


def test_near_sets_of_many_sizes_equal_all_pairs(spark, monkeypatch):
    """across blocks of sizes and maps of several widths, with few and with no frequent tokens, keys that are strings, empty sets."""
    rng, sets = random.Random(9), [(f"k{i:04}", t) for i, t in enumerate([[], ["a"], ["a"], None, []])]
    for size in (1, 2, 3, 8, 9, 10, 26, 27, 28, 79, 81, 84, 240, 243, 250, 600, 1100):
        base = rng.sample(range(2500), size)
        for share in (0, 0, 0.02, 0.05, 0.08, 0.1, 0.15):
            kept = [t for t in base if rng.random() >= share / 2] + rng.sample(range(2500, 4000), round(size * share / 2))
            sets.append((f"k{len(sets):04}", [f"t{t}" for t in kept]))
    first: dict[frozenset, str] = {}
    for k, t in sets:
        if t:
            first.setdefault(frozenset(t), k)
    different = sorted((k, t) for t, k in first.items())
    df = spark.createDataFrame(sets, "k string, t array<string>")
    for hot in (50_000, 100, 1):
        monkeypatch.setattr(S, "LOCAL_TOKENS", hot)
        monkeypatch.setattr(S, "MOST_SORTED", 3000)
        for threshold in (0.82, 0.3):
            want = {(a, b): len(s & t) / len(s | t) for i, (a, s) in enumerate(different) for b, t in different[i + 1 :] if len(s & t) / len(s | t) >= threshold}
            got = {(r["a"], r["b"]): r["jaccard"] for r in S.near_sets(df, threshold, "k", "t").collect()}
            assert got == want and len(want) > 100


def test_texts_of_many_files_are_not_dealt_out(spark, sf_dir, tmp_path, monkeypatch):
    """texts were shuffled to be read by all cores where their files already are read by all."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    plans, near = [], S.near_sets
    monkeypatch.setattr(S, "near_sets", lambda sets, *a: plans.append(sets._jdf.queryExecution().executedPlan().toString()) or near(sets, *a))
    many = registry.queries()["jaccard_near_duplicates"](spark, str(tmp_path)).collect()
    one = registry.queries()["jaccard_near_duplicates"](spark, sf_dir).collect()
    assert ["Exchange" in p for p in plans] == [False, True] and sorted(many) == sorted(one)
