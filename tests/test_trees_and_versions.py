"""Tree scopes, cycles and curation, revisioned tables, canonical JSON and nested artifacts, by plain versions."""

from __future__ import annotations

import hashlib
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from scrivener.functions import canonical as K
from scrivener.operators import trees as O
from scrivener.sources import nested as N
from scrivener.sources.versions import RevisionConflict, Versions

# Collections


def collections(spark, rows):
    return spark.createDataFrame([(k, n, p, 1) for k, n, p in rows], "key string, name string, parent string, version int")


def test_cycles_are_named(spark):
    rows = [("A", "a", "B"), ("B", "b", "C"), ("C", "c", "A"), ("D", "d", "A"), ("E", "e", "E"), ("F", "f", None), ("G", "g", "F"), ("H", "h", "I"), ("I", "i", "H")]
    got = {r["start"]: (r["members"], r["size"]) for r in O.cycles(collections(spark, rows), "key", "parent").collect()}
    assert got == {"A": (["A", "B", "C"], 3), "E": (["E"], 1), "H": (["H", "I"], 2)}
    with pytest.raises(ValueError, match="A > B > C > A; E > E; H > I > H"):
        O.collection_scope(collections(spark, rows))


def plain_scope(rows, roots, below):
    by = {k: (n, p) for k, n, p in rows}
    up = lambda k: [k, *(up(by[k][1]) if by[k][1] in by else [])]
    inside = {k for k in by if not roots or any(r in (up(k) if below else [k]) for r in roots)}
    depth = lambda k: 1 + depth(by[k][1]) if by[k][1] in inside else (0 if roots else 1)
    out = {(k, by[k][1] if by[k][1] in inside else ("" if roots else O.LIBRARY), " / ".join(by[x][0] for x in reversed(up(k))), depth(k)) for k in inside}
    return out if roots else out | {(O.LIBRARY, "", "Library", 0), (O.UNFILED, O.LIBRARY, "Library / Unfiled", 1)}


@pytest.mark.parametrize("roots, below", [((), True), (("K3", "K7", "K3"), True), (("K3", "K7", "K12"), False)])
def test_scope_equals_the_plain_walk(spark, roots, below):
    rng = random.Random(7)
    rows = [(f"K{i}", f"n{i % 5}", rng.choice([f"K{rng.randrange(i)}" if i else "", "GONE", ""]) if i % 3 == 0 else f"K{rng.randrange(i)}") for i in range(40)]
    got = {(r["key"], r["parent_key"], r["path"], r["depth"]) for r in O.collection_scope(collections(spark, rows), [r.lower() for r in roots], below).collect()}
    assert got == plain_scope(rows, roots, below)
    with pytest.raises(ValueError, match="NOWHERE"):
        O.collection_scope(collections(spark, rows), ["nowhere"])


# Curation


def frames(spark):
    tree = spark.createDataFrame([("1", None, "top"), ("2", "1", "mid"), ("3", "2", "leaf"), ("4", "1", "other")], "node string, parent string, label string")
    entities = spark.createDataFrame([("e1", "A", "t"), ("e2", "B", "t"), ("e3", "C", "t")], "id string, name string, type string")
    relations = spark.createDataFrame([("r1", "e1", "e2", "uses", 0.5), ("r2", "e2", "e3", "uses", 0.5), ("r3", "e1", "e3", "is", 0.9)], "id string, source string, target string, predicate string, confidence double")
    return tree, entities, relations


def log(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "revision int, kind string, target string, op string, fields map<string,string>")


def names(df, key):
    return sorted(r[key] for r in df.collect())


def test_deletions_cascade_and_restores_undo_them(spark):
    now = O.curated(*frames(spark), log(spark, ("tree", "2", "delete", None), ("tree", "4", "patch", {"label": " new "}), ("entity", "e2", "delete", None), ("entity", "e2", "patch", {"name": "kept"}), ("relation", "gone", "patch", {"predicate": "x"})))
    assert names(now.tree, "node") == ["1", "4"] and now.tree.filter("node = '4'").first()["label"] == "new"
    assert names(now.entities, "id") == ["e1", "e3"] and names(now.relations, "id") == ["r3"]
    assert [tuple(r) for r in now.orphans.collect()] == [("relation", "gone")]
    back = O.curated(*frames(spark), log(spark, ("tree", "2", "delete", None), ("entity", "e2", "delete", None), ("entity", "e2", "patch", {"name": "kept"}), ("tree", "2", "restore", None), ("entity", "e2", "restore", None), ("relation", "r1", "patch", {"target": "nobody"}), ("relation", "r2", "patch", {"confidence": "0.25"}), ("relation", "r2", "patch", {"predicate": "has"})))
    assert names(back.tree, "node") == ["1", "2", "3", "4"] and back.entities.filter("id = 'e2'").first()["name"] == "kept"
    assert names(back.relations, "id") == ["r2", "r3"]
    assert tuple(back.relations.filter("id = 'r2'").first()) == ("r2", "e2", "e3", "has", 0.25)


def test_impact_is_what_the_mutation_does(spark):
    rng = random.Random(2)
    tree = spark.createDataFrame([(str(i), str(rng.randrange(i)) if i else None, f"l{i}") for i in range(30)], "node string, parent string, label string")
    entities = spark.createDataFrame([(f"e{i}", "n", "t") for i in range(8)], "id string, name string, type string")
    relations = spark.createDataFrame([(f"r{i}", f"e{rng.randrange(8)}", f"e{rng.randrange(8)}", "p", 0.1) for i in range(30)], frames(spark)[2].schema)
    first = [("tree", "5", "delete", None), ("entity", "e3", "delete", None)]
    now = O.curated(tree, entities, relations, log(spark, *first))
    targets = spark.createDataFrame([("tree", "1"), ("tree", "5"), ("entity", "e1"), ("entity", "e3"), ("relation", "r1")], "kind string, target string")
    said = {(r["kind"], r["target"]): (r["there"], r["reach"]) for r in O.impact(now, targets).collect()}
    assert said["tree", "5"] == said["entity", "e3"] == (False, 0)
    then = O.curated(tree, entities, relations, log(spark, *first, ("tree", "1", "delete", None)))
    assert said["tree", "1"] == (True, now.tree.count() - then.tree.count() - 1)
    then = O.curated(tree, entities, relations, log(spark, *first, ("entity", "e1", "delete", None)))
    assert said["entity", "e1"] == (True, now.relations.count() - then.relations.count())
    assert said["relation", "r1"] == (now.relations.filter("id = 'r1'").count() == 1, 0)


def test_positions(spark):
    nodes = spark.createDataFrame([("a", None, 2), ("b", None, 1), ("c", "a", 1), ("d", "c", 5), ("e", "c", 4)], "node string, parent string, ord int")
    assert {r["node"]: r["position"] for r in O.positions(nodes, "node", "parent", "ord").collect()} == {"b": "1", "a": "2", "c": "2.1", "e": "2.1.1", "d": "2.1.2"}


# Revisions


def test_of_two_writers_one_is_refused(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "t"))
    assert store.revision() == 0
    assert store.write(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), 0) == 1
    change = lambda df: df.filter("id > 1").unionByName(spark.createDataFrame([(3, "c")], df.schema)).withColumn("v", F.concat("v", F.lit("!")))
    assert store.dry_run(change, ["id"]) == {"added": 1, "removed": 1, "altered": 1} and store.revision() == 1
    assert store.mutate(change, 1) == 2
    with pytest.raises(RevisionConflict):
        store.mutate(change, 1)
    assert sorted(map(tuple, store.read().collect())) == [(2, "b!"), (3, "c!")] and store.read(1).count() == 2
    assert store.restore(1, 2) == 3 and sorted(map(tuple, store.read().collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        store.read(9)


def test_writers_at_once(spark, tmp_path):
    """Both have seen revision 1 and written their rows; the file system lets one publish."""
    store = Versions(spark, str(tmp_path / "t"))
    store.write(spark.range(1), 0)
    data, gate, results = store._data_of(1), threading.Barrier(4), []

    def publish():
        other = Versions(spark, store.root)
        gate.wait()
        try:
            results.append(other._publish(data, 1))
        except RevisionConflict:
            results.append("refused")

    threads = [threading.Thread(target=publish) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert results.count(2) >= 1 and set(results) <= {2, "refused"} and store.revision() == 2


# Canonical JSON


def shuffled(rng, value):
    if isinstance(value, dict):
        items = [(k, shuffled(rng, v)) for k, v in value.items()]
        rng.shuffle(items)
        return dict(items)
    return [shuffled(rng, v) for v in value] if isinstance(value, list) else value


def grown(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind > 4:
        return {rng.choice(["b", "A", "é", "a b", "zz", "1", 'q"']) + str(rng.randrange(9)): grown(rng, depth - 1) for _ in range(rng.randrange(5))}
    return [grown(rng, depth - 1) for _ in range(rng.randrange(4))] if kind == 4 else rng.choice([None, True, -3, 10**12, "x\n\"y\\", "é中", "", 0])


def test_two_spellings_of_an_object_have_one_hash(spark):
    rng = random.Random(3)
    objects = [{"o": grown(rng, 4)} for _ in range(200)]
    rows = [(i, json.dumps(o, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)) for i, v in enumerate(objects) for o in (v, shuffled(rng, v))]
    got = spark.createDataFrame(rows, "i int, s string").select("i", K.canonical_json(F.col("s")).alias("c"), K.canonical_hash(F.col("s")).alias("h")).collect()
    for r in got:
        want = json.dumps(objects[r["i"]], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r["c"] == want and r["h"] == hashlib.sha256(want.encode()).hexdigest()
    odd = spark.createDataFrame([('{"a":1.0,"b":100.50}',), ('{"b":100.5,"a":1}',), ('{"a":1,"a":2}',), ("no",), (None,)], "s string")
    assert [r[0] for r in odd.select(K.cache_key("n", F.col("s"))).collect()[2:]] == [None] * 3
    assert len({r[0] for r in odd.limit(2).select(K.canonical_json(F.col("s"))).collect()}) == 1


def test_content_versions_change_with_content_alone(spark):
    docs = spark.createDataFrame([(1, "T", "text"), (2, "T", "text"), (3, None, None)], "id int, title string, body string")
    chunks = [(1, 0, "s", "one"), (1, 1, "s", "two"), (2, 0, "s", "one"), (2, 1, "s", "twO")]
    of = lambda rows: {r["id"]: r["version"] for r in K.content_versions(docs, spark.createDataFrame(rows, "id int, i int, section string, content string"), "id", ["title"], "body", ["i", "section"], ["content", "section"]).collect()}
    first = of(chunks)
    assert first == of(chunks[::-1]) and first[1] != first[2] and first[3] and of([*chunks[:3], (2, 1, "s", "two")])[2] == first[1]


# Nested artifacts


def test_collections_of_mixed_types(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"key": "A", "data": {"key": " A ", "name": "Top", "parentCollection": False, "version": 3}}, {"key": "B", "version": 7, "data": {"name": "", "parentCollection": "A"}}, {"data": {}}, 5, {"key": "C", "name": "flat", "parentCollection": None}]))
    (tmp_path / "b.json").write_text("broken")
    (tmp_path / "c.json").write_text('{"key": "no array"}')
    got = N.collections(N.json_files(spark, str(tmp_path)), "v").collect()
    assert sorted(map(tuple, got)) == [("A", "Top", "", 3), ("B", "B", "A", 7), ("C", "flat", "", 0)]


def test_trees_of_any_depth(spark):
    rng = random.Random(4)

    def node(depth):
        out = {"label": rng.choice(["x", "y", " ", "deep"]), "n": rng.randrange(100)}
        if depth and rng.random() < 0.8:
            out["child"] = [rng.choice([node(depth - 1), node(depth - 1), 7]) for _ in range(rng.randrange(4))]
        return out

    trees = [(i, [node(rng.randrange(8)) for _ in range(3)]) for i in range(20)] + [(90, {"label": "alone"}), (91, None)]
    chain = {"label": "end"}
    for _ in range(40):
        chain = {"label": "link", "child": [chain]}
    trees.append((92, chain))
    want = []

    def walk(key, nodes, prefix, depth):
        for i, n in enumerate(nodes, 1):
            if isinstance(n, dict) and n["label"].strip():
                position = f"{prefix}.{i}" if prefix else str(i)
                want.append((key, position, prefix, i, depth, n["label"], n.get("n")))
                walk(key, n.get("child", []), position, depth + 1)

    for key, t in trees:
        walk(key, t if isinstance(t, list) else [t] if t else [], "", 0)
    df = spark.createDataFrame([(k, json.dumps(t) if t else None) for k, t in trees], "k int, s string").select("k", F.try_parse_json("s").alias("v"))
    got = N.tree_nodes(df, "k", "v").select("k", "position", "parent_position", "ordinal", "depth", "label", N.get(F.col("node"), "$.n", "long")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        N.tree_nodes(df.filter("k = 92"), "k", "v", most_depth=10)


def test_results_of_other_projects_are_left_out(spark, tmp_path):
    files = {
        "p1": {"domain_tree.json": {"projectId": "p1", "graphStatus": "ready", "language": "en", "documentCount": 4, "domainTree": [{"label": "a"}]}, "knowledge_graph.json": {"projectId": "p1", "nodes": [1, 2]}, "manifest.json": {"v": 1}},
        "p2": {"domain_tree.json": {"projectId": "p1", "domainTree": []}}, "p3": {"domain_tree.json": [{"label": "plain list"}], "knowledge_graph.json": {"projectId": "other"}},
        "p4": {"domain_tree.json": {"graphStatus": "failed", "domainTree": []}, "knowledge_graph.json": {"projectId": "other", "nodes": [1]}}, "p5": {"knowledge_graph.json": {}}, "p6": {"domain_tree.json": {"projectId": " "}, "manifest.json": {"projectId": "p1"}},
    }
    for project, parts in files.items():
        (tmp_path / project).mkdir()
        for name, value in parts.items():
            (tmp_path / project / name).write_text(json.dumps(value, indent=1))
    (tmp_path / "p1/catalog.txt").write_text("line\nline")
    got = {r["project"]: r.asDict() for r in N.project_results(spark, str(tmp_path)).withColumns({c: F.to_json(c) for c in ("tree", "graph", "manifest")}).collect()}
    assert set(got) == {"p1", "p4"}
    assert got["p1"] == {"project": "p1", "status": "ready", "generated_at": "", "language": "en", "documents": 4, "tree": '[{"label":"a"}]', "graph": '{"nodes":[1,2],"projectId":"p1"}', "manifest": '{"v":1}', "catalog": "line\nline"}
    assert (got["p4"]["status"], got["p4"]["graph"], got["p4"]["catalog"]) == ("failed", None, "")
