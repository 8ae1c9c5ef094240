"""Conversation repair, the vector tree and importance resampling against plain versions and awkward inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrivener.llm import conversation_repair as C
from scrivener.llm import queries, resampling
from scrivener.llm.vector_tree import Tree, k_means, nearest, units

Q, SF = queries.queries(), "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_importance_resampling"])
def test_query_equals_its_sql(name, same_rows):
    same_rows(Q[name], queries.oracle_sql()[name], SF)


# Conversation repair


def plain_repair(rows: list[tuple[str, str, str]]) -> tuple[int, str, str]:
    """The cheapest repair of rows (role, text, fault), by going through all edits in their order."""
    best = [4 * len(rows), "D" * len(rows), ()]

    def walk(i: int, roles: str, cost: int, audit: str, lines: tuple) -> None:
        if cost > best[0] or not re.fullmatch("s?(ua)*u?", roles):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (cost, audit) < (best[0], best[1]):
            best[:] = cost, audit, lines
        for role in ("user", "assistant"):
            walk(i, roles + role[0], cost + 3, audit + "I", (*lines, f"{role}:"))
        if i < len(rows):
            role, text, fault = rows[i]
            walk(i + 1, roles, cost + 4, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role:
                    walk(i + 1, roles + role[0], cost + more, audit + "K", (*lines, f"{role}:{text}"))
                for new in ("user", "assistant"):
                    walk(i + 1, roles + new[0], cost + 3 + more, audit + "R", (*lines, f"{new}:{text}"))

    walk(0, "", 0, "", ())
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def found_faults(rows: list[tuple[str, str]]) -> list[str]:
    out = []
    for i, (role, text) in enumerate(rows):
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not ends else "duplicate" if (role, text) in rows[:i] else "" if ends[-1] in ".!?" else "truncated")
    return out


ROLES, TEXTS = ["user", "assistant", "system", "tool", "", "User"], ["Yes.", "No!", "cut", "", " \t", "Why? ", "x.y"]


def test_op11_equals_all_edits_tried(spark):
    rng = random.Random(5)
    rows = [(conv, rng.choice([None, *range(7)]), rng.choice([*ROLES, *ROLES[:2] * 3]), rng.choice(TEXTS)) for conv in range(150) for _ in range(rng.randint(1, 5))]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello."), (200, None, None, None), (200, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.repaired(df.withColumn("gone", F.lit(False))).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        mine = sorted(((-1 if t is None else t, role if role is not None else " ", x if x is not None else " ") for c, t, role, x in rows if c == conv))
        faults = found_faults([m[1:] for m in mine])
        r, turns = got[conv], [t for t, _, _ in mine if t >= 0]
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == plain_repair([(role, x, f) for (_, role, x), f in zip(mine, faults, strict=True)])
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert r["illegal"] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))


def test_op11_damage(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in ((0, "system", "Be kind. "), (1, "user", "a. b! c?"), (None, None, None))]
    got = Counter(tuple(r) for r in C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind in (0, 1) else re.sub("[.!?]", "", x) if kind == 2 else x
        want[c, t, "user" if kind == 4 else r, x, kind == 0] += 1 + (kind == 3)
    assert got == want


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_op11_blocks_change_nothing(block, monkeypatch):
    """The search in blocks, with audits that begin one another, against one search over all rows."""
    rng = random.Random(block)
    for _ in range(300):
        few = rng.choice([["user"], ["user", "assistant"], ["user", "assistant", "system"]])
        rows = [(rng.choice(few), f"t{i}", rng.random() < 0.15, rng.random() < 0.2) for i in range(rng.randint(0, 12))]
        results = []
        for size in (1000, block):
            monkeypatch.setattr(C, "BLOCK_ROWS", size)
            repair = C.Repair()
            for row in rows:
                repair.add(row)
            results.append(repair.result())
        assert results[0] == results[1]


def test_op11_awkward(spark):
    rows = [(1, 1, "user", "x" * 2_000_000 + ".", "a"), (1, 2, "assistant", "y. " + " " * 100_000, "b"), (2, 0, "user", None, "c"), (None, None, None, "Fine.", "d"), (None, None, None, "Fine.", "d")]
    rows += [(3, t, "user" if t % 2 == 0 else "assistant", f"Row {t}.", "e") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone string")
    out = C.repaired(C.damaged(df)).collect()
    assert sorted(str(r["conv_id"]) for r in out) == ["1", "2", "3", "None"]
    assert len([e for r in out if r["conv_id"] == 3 for e in r["audit"] if e != "I"]) == sum(r[0] == 3 for r in C.damaged(df).filter("not gone").collect())
    assert C.repaired(C.damaged(df.limit(0))).count() == 0
    gone = next(t for t in range(100) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    (r,) = C.repaired(C.damaged(spark.createDataFrame([(9, gone, "user", "Hi.")], "conv_id long, turn long, role string, text string"))).collect()
    assert tuple(r) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


# Nearest neighbours


def plain_nearest(vectors: list, wanted, k: int = 5) -> dict:
    """By place in the list: score of each neighbour, nearest first."""
    rows = [(i, vec_id, np.array(v, float)) for i, (vec_id, v) in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, vec_id, v in rows:
        if vec_id is not None and wanted(vec_id):
            scored = [(-float((u * v).sum() / np.sqrt((u * u).sum()) / np.sqrt((v * v).sum())), vec_id if vec_id is not None else 2**62, j) for j, vec_id, u in rows if j != i]
            out[i] = sorted(scored)[:k]
    return out


def test_op12_recall_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    table = pd.read_parquet(f"{sf}/embeddings.parquet")
    got = Q["op12_vector_tree"](spark, sf).toPandas()
    want = plain_nearest(list(zip(table["vec_id"], table["embedding"], strict=True)), lambda x: x % 50 == 0)
    assert len(got) == 5 * len(want) and (got.groupby("query_id")["rank"].apply(sorted).map(tuple) == (1, 2, 3, 4, 5)).all()
    hits = 0
    for i, true in want.items():
        mine = got[got["query_id"] == table["vec_id"][i]].sort_values("rank")
        hits += len({int(j) for _, j, _ in true} & set(mine["vec_id"]))
        assert list(mine["score"]) == sorted(mine["score"], reverse=True)
        by_id = dict(zip(table["vec_id"], table["embedding"], strict=True))
        for v, s in zip(mine["vec_id"], mine["score"], strict=True):
            a, b = np.array(by_id[v], float), np.array(table["embedding"][i], float)
            assert abs(s - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12
    assert hits >= 0.95 * 5 * len(want)


def test_op12_recall_with_many_leaves(spark):
    """4,000 vectors around 40 directions, 30 of them equal, in leaves of 60: fewer leaves are visited than there are."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    vectors = [[float(x) for x in centres[i % 40] + 0.4 * rng.normal(size=16)] for i in range(4000)]
    vectors[100:130] = [vectors[100]] * 30
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = nearest(df, wanted=F.col("id") % 50 == 0, recall=0.95, leaf_rows=60, branches=8, sample_rows=500, cell_rows=40, cell_queries=3).toPandas()
    want = plain_nearest(list(enumerate(vectors)), lambda x: x % 50 == 0)
    hits = sum(len({j for _, _, j in true} & set(got[got["query_id"] == i]["vec_id"])) for i, true in want.items())
    assert len(got) == 5 * 80 and hits >= 0.9 * 400
    equal = got[got["query_id"] == 100].sort_values("rank")
    assert list(equal["vec_id"]) == [101, 102, 103, 104, 105] and (equal["score"].nunique(), len(equal)) == (1, 5)


def test_op12_best_bin_first_visits_every_leaf_nearest_first():
    rng = np.random.default_rng(1)
    unit = units(rng.normal(size=(400, 8)))
    tree = Tree.root(8).grown({0: k_means(unit, 6, 0)})
    leaf = tree.descend(unit)
    tree = tree.grown({n: k_means(unit[leaf == n], 4, n) for n in tree.leaves()[:3]})
    for v in unit[:20]:
        order = list(tree.best_bins(v))
        assert sorted(order) == sorted(tree.leaves())
        near = [float(tree.centroids[n] @ v) for n in order]
        assert near[0] == max(float(tree.centroids[n] @ v) for n in order) or tree.many[1:7].any()


def test_op12_awkward(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.6, 0.8]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (5, [1.0, None]), (None, [0.0, 1.0]), (6, [1e300, 1e300]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, leaf string, row int")
    got = nearest(df, wanted=F.col("id") % 50 == 0).collect()
    want = plain_nearest([r if r[0] != 7 else (7, None) for r in [(i, v if i != 6 else [1.0, 1.0]) for i, v in rows]], lambda x: x % 50 == 0)
    assert sorted((r["query_id"], r["rank"], -1 if r["vec_id"] is None else r["vec_id"], round(r["score"], 12)) for r in got) == sorted((rows[i][0], n + 1, -1 if rows[j][0] is None else rows[j][0], round(-s, 12)) for i, true in want.items() for n, (s, _, j) in enumerate(true))
    assert nearest(df.limit(0)).count() == nearest(df.filter("vec_id = 0")).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(3000)], "vec_id long, embedding array<double>")
    ties = nearest(same, wanted=F.col("id") == 50, leaf_rows=100).orderBy("rank").collect()
    assert [r["vec_id"] for r in ties] == [0, 1, 2, 3, 4]


# Importance resampling


def plain_buckets(text: str | None, longest: int, buckets: int) -> list[int]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_op13_ring_emits_every_run(longest, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 40)
    rng = random.Random(longest)
    for text in ["", "One", "É a-b_c ÀB 12x\x7fy\x00z", "a" * 500, *("".join(rng.choice("aBé 1.,\n界") for _ in range(rng.randint(0, 300))) for _ in range(100))]:
        words, got = resampling.ring_buckets(text.encode(), longest, 70_000)
        assert sorted(got.tolist()) == sorted(plain_buckets(text, longest, 70_000)) and words == len(plain_buckets(text, 1, 9))


def test_op13_longer_runs_equal_plain_counts(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["Ant", "bee", "cat", "dog", "élan"]) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(5, "ant bee " * 15), (5, "ant bee " * 15), (None, "bee " * 30), (None, None), (61, "")]
    target = [("bee cat dog",), ("BEE CAT",), (None,)]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, score int, id string")
    got = resampling.resampled(df, spark.createDataFrame(target, "text string"), longest=3, buckets=500, percent=50, seed="s").collect()
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_buckets(text, 3, 500))
    for (text,) in target:
        t.update(plain_buckets(text, 3, 500))
    gain = lambda b: int(np.floor(1000 * np.log((t[b] + 1.0) * (s.total() + 500.0) / ((s[b] + 1.0) * (t.total() + 500.0)))))
    rows = []
    for d, text in docs:
        found = plain_buckets(text, 3, 500)
        h = int(hashlib.sha256(f"s:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append((d, len(plain_buckets(text, 1, 500)), len(found), weight, weight + int(np.floor(-1000 * np.log(-np.log((h + 0.5) / 2**32))))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    want = [(*r, n + 1 if n < len(able) // 2 else None) for n, r in enumerate(able)] + [(*r, None) for r in rows if r[1] < 20]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_op13_awkward(spark):
    docs = spark.createDataFrame([(1, None), (2, "word " * 300_000), (3, "x" * 3_000_000)], "doc_id long, text string")
    items = spark.createDataFrame([("word",)], "text string")
    got = {r["doc_id"]: r for r in resampling.resampled(docs, items, percent=100).collect()}
    assert (got[1]["n_features"], got[1]["weight"], got[1]["rank"]) == (0, 0, None) and got[2]["n_features"] == 300_000 and got[3]["n_features"] == 1 and got[2]["rank"] == 1
    assert resampling.resampled(docs.limit(0), items).count() == 0
    assert resampling.resampled(docs, items.limit(0)).count() == 3
