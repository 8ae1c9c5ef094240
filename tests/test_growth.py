"""Large groups: what many rows share is one row in a join, so the work grows with the rows and not with their pairs."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from scrivener import registry
from scrivener.operators import records as R
from scrivener.operators import search as S
from scrivener.operators import trees as E
from scrivener.sources import landed


def plain_resolution(candidates, known):
    out = {}
    for cand, self_id, *keys in candidates:
        hits = {(k[0], way) for way, value in enumerate(keys) if value for k in known if k[way] == value}
        targets = {t for t, _ in hits}
        one = targets.copy().pop() if len(targets) == 1 else None
        status = "candidate" if not targets else "ambiguous" if len(targets) > 1 else "rejected" if one == self_id else "resolved"
        sure = {"candidate": 0.6, "ambiguous": 0.4, "rejected": 0.0}.get(status) if status != "resolved" else 1.0 if min(w for _, w in hits) < 2 else 0.9
        out[cand] = (status, one, sure)
    return out


def test_resolution_equals_the_plain_loop_and_lists_no_pairs(spark):
    rng = random.Random(4)
    word = lambda n: rng.choice([None, "", *(f"v{i}" for i in range(n))])
    known = [(f"v{i}", word(40), word(25)) for i in range(30)] + [("v3", word(40), word(25)), (None, "v1", "v2"), (None, None, "v7")]
    candidates = [(i, f"v{i % 40}", word(60), word(60), word(60)) for i in range(400)]
    c, k = "cand long, self_id string, id_key string, doi_key string, title_key string", "id string, doi_key string, title_key string"
    got = {r["cand"]: (r["status"], r["target"], r["confidence"]) for r in R.resolve(spark.createDataFrame(candidates, c), spark.createDataFrame(known, k)).collect()}
    assert got == plain_resolution(candidates, known) and {s for s, *_ in got.values()} == {"candidate", "ambiguous", "rejected", "resolved"}
    # Three keys for all of 60,000 rows: billions of pairs.
    rows, began = spark.range(60_000).select(F.col("id").cast("string").alias("id")), time.time()
    every = rows.select("id", F.lit("d").alias("doi_key"), F.lit("t").alias("title_key"))
    out = R.resolve(every.select(F.col("id").alias("cand"), F.col("id").alias("self_id"), F.col("id").alias("id_key"), "doi_key", "title_key"), every)
    assert [tuple(r) for r in out.groupBy("status").count().collect()] == [("ambiguous", 60_000)] and time.time() - began < 60


def plain_files(records, paths):
    out = {}
    for key, name, ext, doi, title in records:
        scored = []
        for path in paths:
            stem = re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[1]).lower()
            score = 4 * (name != "" and name in stem) + 3 * (ext != "" and ext in stem) + 3 * (doi != "" and doi in stem) + 2 * (title != "" and (title in stem or stem in title))
            scored += [(-score, path)] if score else []
        if scored:
            out[key] = (min(scored)[1], -min(scored)[0])
    return out


def test_best_files_equal_the_plain_loop(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
    for _ in range(3):
        paths = sorted({f"/{word()}/{word()}{word()}{word()}.pdf" for _ in range(60)})
        some = lambda: rng.choice(["", word(), word() + word()])
        records = [(i, some(), some(), some(), some()) for i in range(150)]
        df = spark.createDataFrame(records, "k long, name string, ext string, doi string, title string")
        got = landed.best_files(df, spark.createDataFrame([(p,) for p in paths], "path string"), "k", "title", "ext", "doi", "name")
        assert {r["k"]: (r["path"], r["score"]) for r in got.collect()} == plain_files(records, paths)


def test_records_and_files_that_share_beginnings_and_a_place(spark):
    # 20,000 names with one beginning, in 2 places: 200 million pairs by either.
    rows, began = spark.range(20_000).select("id", F.format_string("Supplier#%09d", "id").alias("name"), F.when(F.col("id") % 2 == 0, "NORWAY").otherwise("FRANCE").alias("place")), time.time()
    files = rows.filter("id % 3 = 0").select(F.concat(F.lit("/f/"), F.lower("name"), F.lit("-"), "place", F.lit(".pdf")).alias("path"))
    got = landed.best_files(rows.withColumns({"title": F.lit(""), "doi": F.lit("")}), files, "id", "title", "place", "doi", "name")
    want = F.when(F.col("id") % 3 == 0, F.concat(F.lit("/f/"), F.lower("name"), F.lit("-"), "place", F.lit(".pdf"))).when(F.col("id") % 2 == 0, "/f/supplier#000000000-NORWAY.pdf").otherwise("/f/supplier#000000003-FRANCE.pdf")
    same = got.join(rows, "id").filter((F.col("path") == want) & (F.col("score") == F.when(F.col("id") % 3 == 0, 7).otherwise(3)))
    assert same.count() == got.count() == 20_000 and time.time() - began < 120


def test_near_sets_equal_all_pairs(spark):
    # Sets of many sizes, near ones among them, made of few tokens so that maps and prefixes meet often.
    rng, sets = random.Random(6), []
    for _ in range(60):
        base = [f"t{i}" for i in rng.sample(range(400), rng.choice([1, 2, 5, 11, 40, 120, 300]))]
        sets += [base, *([t for t in base if rng.random() > 0.07] + [f"t{i}" for i in rng.sample(range(400, 500), rng.randint(0, 1 + len(base) // 12))] for _ in range(4))]
    first: dict[frozenset, int] = {}
    for k, tokens in enumerate(sets):
        first.setdefault(frozenset(tokens), k)
    different = sorted((k, s) for s, k in first.items() if s)
    for threshold in (0.82, 0.5, 1.0):
        want = {(a, b) for i, (a, s) in enumerate(different) for b, t in different[i + 1 :] if len(s & t) / len(s | t) >= threshold}
        got = [(r["a"], r["b"]) for r in S.near_sets(spark.createDataFrame(list(enumerate(sets)), "k long, t array<string>"), threshold, "k", "t").collect()]
        assert sorted(got) == sorted(want) and (len(want) > 100 or threshold == 1.0)


def test_cycles_far_below_which_are_many_nodes(spark):
    rng = random.Random(7)
    for _ in range(3):
        parents = {i: rng.choice([rng.randrange(80), None, 900]) if rng.random() < 0.3 else rng.randrange(80) for i in range(80)}
        want = set()
        for i in parents:
            path = [i]
            while (up := parents.get(path[-1])) is not None and up not in path:
                path.append(up)
            if up == i and min(path) == i:
                want.add(tuple(path))
        got = E.cycles(spark.createDataFrame(list(parents.items()), "n long, up long"), "n", "up").collect()
        assert {tuple(r["members"]) for r in got} == want and all(r["start"] == r["members"][0] and r["size"] == len(r["members"]) for r in got)
    # A chain of 6,000 nodes above which is a cycle of three: 18 million pairs of a node and one above it.
    ids, began = spark.range(6_000).select(F.col("id").alias("n"), F.when(F.col("id") == 0, 2).otherwise(F.col("id") - 1).alias("up")), time.time()
    assert [tuple(r) for r in E.cycles(ids, "n", "up").collect()] == [(0, [0, 2, 1], 3)]
    assert E._on_cycles(ids, "n", "up").count() == 3 and time.time() - began < 120


def test_topic_domains_keep_a_number_per_topic(spark, sf_dir, tmp_path):
    names = ["red bolt", "bolt gear red", "small large blue green", "x", None, "green ring small", "large"]
    spark.createDataFrame([(i % 6, n) for i, n in enumerate(names)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    out = registry.queries()["topic_domains"](spark, str(tmp_path))
    assert {r["p_partkey"]: r["domain"] for r in out.collect()} == {0: "colour", 1: "metal", 2: "colour", 3: None, 4: None, 5: "colour"}
    assert "SortAggregate" not in registry.queries()["topic_domains"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
