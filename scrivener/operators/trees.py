"""Trees of collections and topics: cycles, scopes, positions, and curation by a log of revisions.

Nodes are rows with their parent; ancestors come from `graphs.closure`, which takes the logarithm of the depth in rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.operators.graphs import closure
from scrivener.session import Scratch

LIBRARY, UNFILED = "__library__", "__unfiled__"


def _on_cycles(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """Edges among which all cycles are. Where each node has one parent, only those of the cycles themselves: the nodes that
    are reached from others by 1, 3, 7, ... steps are ever fewer, and when they no longer change they are on cycles."""
    scratch = Scratch(edges.sparkSession)
    pairs = scratch.save(edges.select(F.col(node).alias("node"), F.col(parent).alias("up")).filter("node is not null and up is not null").distinct())
    if not pairs.groupBy("node").count().filter("count > 1").isEmpty():
        return pairs
    steps, n = pairs, -1
    while (now := steps.count()) != n:
        n = now
        reached = steps.join(steps.select(F.col("up").alias("node")).distinct(), "node", "left_semi")
        steps = scratch.save(reached.join(steps.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", F.col("far").alias("up")))
    return pairs.join(steps.select("node"), "node", "left_semi")


def cycles(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """The cycles of a parent relation, one row each: `start`, the smallest node, `members` in the order in which parents
    lead from it, and `size`. A node that is its own parent is a cycle of one."""
    up = closure(_on_cycles(edges, node, parent), "node", "up")  # nodes beside the cycles would list all that is above them
    alone = edges.filter(F.col(node) == F.col(parent)).select(F.col(node).alias("start"), F.col(node).alias("member"), F.lit(0).alias("depth")).distinct()
    over = up.filter("depth > 0").select(F.col("node").alias("start"), F.col("ancestor").alias("member"), "depth")
    back = up.filter("depth > 0").select(F.col("ancestor").alias("start"), F.col("node").alias("member"))
    mutual = over.join(back, ["start", "member"], "left_semi")
    # Each node of a cycle sees all others; the smallest tells of it.
    least = mutual.groupBy("start").agg(F.min("member").alias("m")).filter(F.col("start") < F.col("m")).select("start")
    told = mutual.join(least, "start", "left_semi").unionByName(least.select("start", F.col("start").alias("member"), F.lit(0).alias("depth"))).unionByName(alone)
    members = F.transform(F.array_sort(F.collect_list(F.struct("depth", "member"))), lambda s: s["member"])  # one cycle
    return told.groupBy("start").agg(members.alias("members")).withColumn("size", F.size("members"))


def require_acyclic(edges: DataFrame, node: str, parent: str) -> None:
    """Raises an error that names some cycles."""
    if found := cycles(edges, node, parent).orderBy("start").limit(5).collect():
        raise ValueError("cycles of parents: " + "; ".join(" > ".join([*map(str, r["members"]), str(r["start"])]) for r in found))


def normalized_collections(rows: DataFrame) -> DataFrame:
    """key and parent in capitals, names without blanks at their ends, the key for a blank name, the last row of a key."""
    trimmed = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = rows.select(F.upper(trimmed("key")).alias("key"), trimmed("name").alias("name"), F.upper(trimmed("parent")).alias("parent"), F.coalesce("version", F.lit(0)).cast("long").alias("version")).filter("key <> ''")
    out = out.groupBy("key").agg(F.max_by(F.struct("name", "parent", "version"), F.struct("version", "name")).alias("r")).select("key", "r.*")
    return out.withColumn("name", F.when(F.col("name") == "", F.col("key")).otherwise(F.col("name")))


def collection_scope(rows: DataFrame, roots: Sequence[str] = (), below: bool = True, library: str = "Library", unfiled: str = "Unfiled", check: bool = True) -> DataFrame:
    """The collections (key, name, parent, version) of a scope: key, parent_key, name, path, depth, version, is_virtual.

    Without roots the scope is the whole library, below a virtual root and with a virtual place for what is in none.
    With roots it is those and, with `below`, all that is under them; depths count from the topmost one in the scope, paths
    from the top of the library. A root that isn't there is an error, and so are cycles, unless `check` is off: then what
    is in or below one has the path that its ancestors give.
    """
    all_ = normalized_collections(rows)
    if check:
        require_acyclic(all_, "key", "parent")
    wanted = list(dict.fromkeys(k for r in roots if (k := str(r).strip().upper())))
    if wanted:
        there = {r["key"] for r in all_.filter(F.col("key").isin(wanted)).select("key").collect()}
        if missing := [k for k in wanted if k not in there]:
            raise ValueError("no such collections: " + ", ".join(missing[:10]))
    up = closure(all_, "key", "parent")
    if not wanted:
        inside = all_
    elif below:
        inside = all_.join(up.filter(F.col("ancestor").isin(wanted)).select(F.col("node").alias("key")).distinct(), "key", "left_semi")
    else:
        inside = all_.filter(F.col("key").isin(wanted))
    parents = inside.select(F.col("key").alias("parent"), F.lit(True).alias("__in"))
    inside = inside.join(parents, "parent", "left")
    # Depth within the scope: the chain of parents that are in it too.
    chained = inside.select("key", F.when(F.col("__in"), F.col("parent")).alias("parent"))
    depth = closure(chained, "key", "parent").groupBy(F.col("node").alias("key")).agg(F.max("depth").alias("depth"))
    named = up.join(all_.select(F.col("key").alias("ancestor"), F.col("name").alias("__name")), "ancestor")
    path = named.groupBy(F.col("node").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "__name"))), lambda s: s["__name"]), " / ").alias("path"))
    top, shift = (F.lit(LIBRARY), 1) if not wanted else (F.lit(""), 0)
    out = inside.join(depth, "key").join(path, "key").select("key", F.when(F.col("__in"), F.col("parent")).otherwise(top).alias("parent_key"), "name", "path", (F.col("depth") + shift).cast("int").alias("depth"), "version", F.lit(False).alias("is_virtual"))
    if wanted:
        return out
    virtual = [(LIBRARY, "", library, library, 0, 0, True), (UNFILED, LIBRARY, unfiled, f"{library} / {unfiled}", 1, 0, True)]
    return out.unionByName(rows.sparkSession.createDataFrame(virtual, out.schema))


def positions(nodes: DataFrame, node: str, parent: str, ord_: str) -> DataFrame:
    """node and position: `2.1.3` is the third child of the first child of the second root."""
    numbered = nodes.select(F.col(node).alias("ancestor"), F.row_number().over(Window.partitionBy(parent).orderBy(ord_, node)).cast("string").alias("n"))
    up = closure(nodes, node, parent).join(numbered, "ancestor")
    place = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "n"))), lambda s: s["n"]), ".")  # one node's ancestors
    return up.groupBy(F.col("node").alias(node)).agg(place.alias("position"))


def renamed_ids(nodes: DataFrame, node: str, parent: str, ord_: str, new: str, prefix: str = "domain:") -> DataFrame:
    """old_id, by position, and new_id, by the column `new`, of every node."""
    return positions(nodes, node, parent, ord_).join(nodes.select(node, new), node).select(F.concat(F.lit(prefix), "position").alias("old_id"), F.concat(F.lit(prefix), F.col(new).cast("string")).alias("new_id"))


@dataclass(frozen=True)
class Curated:
    tree: DataFrame
    entities: DataFrame
    relations: DataFrame
    orphans: DataFrame


def deletions(log: DataFrame) -> DataFrame:
    """kind and target of what the log (revision, kind, target, op, fields) leaves deleted: a restore undoes a deletion."""
    last = log.filter(F.col("op").isin("delete", "restore")).groupBy("kind", "target").agg(F.max_by("op", "revision").alias("op"))
    return last.filter("op = 'delete'").select("kind", "target")


def patches(log: DataFrame) -> DataFrame:
    """kind, target and fields: of every field the value of the last patch that has it."""
    fields = log.filter("op = 'patch'").select("kind", "target", "revision", F.explode("fields").alias("f", "v"))
    last = fields.groupBy("kind", "target", "f").agg(F.max_by("v", "revision").alias("v"))
    return last.groupBy("kind", "target").agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("fields"))  # a node's fields


def _patched(rows: DataFrame, key: str, kind: str, new: DataFrame, fields: Sequence[str]) -> DataFrame:
    of = new.filter(F.col("kind") == kind).select(F.col("target").alias(key), "fields")
    value = lambda c: F.get(F.array(F.col("fields")[c]), F.lit(0))
    return rows.join(of, key, "left").withColumns({c: F.coalesce(F.when(F.trim(value(c)) != "", F.trim(value(c))).cast(rows.schema[c].dataType), F.col(c)) for c in fields}).drop("fields")


def curated(tree: DataFrame, entities: DataFrame, relations: DataFrame, log: DataFrame) -> Curated:
    """tree (node, parent, label, ...), entities (id, name, ...) and relations (id, source, target, ...) after a log of
    patches, deletions and restores of `tree`, `entity` and `relation`. What is below a deleted node goes with it, and so do
    relations that have lost an end, by deletion or by a patch. Blank values of a patch count as none. orphans: targets of
    patches that nothing has."""
    gone, new = deletions(log), patches(log)
    of = lambda kind, key: gone.filter(F.col("kind") == kind).select(F.col("target").alias(key))
    down = closure(tree, "node", "parent").join(of("tree", "ancestor"), "ancestor", "left_semi").select("node").distinct()
    kept_tree = _patched(tree.join(down, "node", "left_anti"), "node", "tree", new, ["label"])
    kept = _patched(entities.join(of("entity", "id"), "id", "left_anti"), "id", "entity", new, [c for c in ("name", "type") if c in entities.columns])
    edges = _patched(relations.join(of("relation", "id"), "id", "left_anti"), "id", "relation", new, [c for c in ("source", "target", "predicate", "confidence") if c in relations.columns])
    for end in ("source", "target"):
        edges = edges.join(kept.select(F.col("id").alias(end)), end, "left_semi")
    known = tree.select(F.lit("tree").alias("kind"), F.col("node").cast("string").alias("target"))
    for kind, rows in (("entity", entities), ("relation", relations)):
        known = known.unionByName(rows.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("target")))
    return Curated(kept_tree, kept, edges.select(*relations.columns), new.select("kind", "target").join(known, ["kind", "target"], "left_anti"))


def knowledge_edges(project: str, curated_: Curated, base: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """source, target and relation of the graph over a curated result: the project above its topics, topics above theirs, the
    relations of entities, and base edges (source, target, relation) whose ends, under their new ids, are still there."""
    topic = lambda c: F.concat(F.lit("domain:"), F.col(c).cast("string"))
    root = F.lit(f"project:{project}")
    nodes = curated_.tree.select(topic("node").alias("id")).unionByName(curated_.entities.select(F.col("id").cast("string").alias("id")))
    down = curated_.tree.select(F.when(F.col("parent").isNull(), root).otherwise(topic("parent")).alias("source"), topic("node").alias("target"), F.when(F.col("parent").isNull(), "has_domain").otherwise("has_subdomain").alias("relation"))
    out = down.unionByName(curated_.relations.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.lit("semantic_relation").alias("relation")))
    if base is None:
        return out
    edges = base.filter(~F.col("relation").isin("has_domain", "has_subdomain", "semantic_relation")).select("source", "target", "relation")
    there = nodes.unionByName(base.sparkSession.createDataFrame([(f"project:{project}",)], "id string")).distinct()
    for end in ("source", "target"):
        if ids is not None:
            edges = edges.join(ids.select(F.col("old_id").alias(end), "new_id"), end, "left").withColumn(end, F.coalesce("new_id", end)).drop("new_id")
        edges = edges.join(there.select(F.col("id").alias(end)), end, "left_semi")
    return out.unionByName(edges.select("source", "target", "relation"))


def impact(now: Curated, targets: DataFrame) -> DataFrame:
    """What a deletion of each target (kind, target) would take along, before it is done: kind, target, there, and reach: the
    nodes below a topic, the relations of an entity, nothing for a relation."""
    below = closure(now.tree, "node", "parent").groupBy(F.col("ancestor").cast("string").alias("target")).agg((F.count("*") - 1).alias("reach")).select(F.lit("tree").alias("kind"), "target", "reach")
    ends = now.relations.select(F.explode(F.array_distinct(F.array(F.col("source").cast("string"), F.col("target").cast("string")))).alias("target")).groupBy("target").agg(F.count("*").alias("reach"))
    entities = now.entities.select(F.col("id").cast("string").alias("target")).join(ends, "target", "left").select(F.lit("entity").alias("kind"), "target", F.coalesce("reach", F.lit(0)).alias("reach"))
    relations = now.relations.select(F.lit("relation").alias("kind"), F.col("id").cast("string").alias("target"), F.lit(0).cast("long").alias("reach"))
    found = below.unionByName(entities).unionByName(relations)
    asked = targets.select("kind", F.col("target").cast("string").alias("target")).distinct()
    return asked.join(found, ["kind", "target"], "left").select("kind", "target", F.col("reach").isNotNull().alias("there"), F.coalesce("reach", F.lit(0)).alias("reach"))
