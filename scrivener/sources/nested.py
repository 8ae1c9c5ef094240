"""Nested artifacts with fields of mixed types, read as VARIANT: collections, topic trees of any depth, and their folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.session import Scratch, prepare

#: States of a build in which its graph may be used.
USABLE = ("ready", "degraded")


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def is_kind(v: Column, path: str, *kinds: str) -> Column:
    """Whether there is something at a path, of one of the kinds (BOOLEAN, OBJECT, ARRAY ...)."""
    kind = F.schema_of_variant(get(v, path, "variant"))
    return F.coalesce(F.regexp_extract(kind, r"^\w+", 0).isin(*kinds), F.lit(False))


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """path, and the content of each file as VARIANT; null where it isn't JSON."""
    return prepare(spark).read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))


def exploded(df: DataFrame, array: Column) -> DataFrame:
    """df with pos and value of each element of an array; rows without one are left out."""
    name = "__exploded"
    return df.withColumn(name, array).lateralJoin(df.sparkSession.tvf.variant_explode(F.col(name).outer())).drop("key", name)


def collections(df: DataFrame, v: str) -> DataFrame:
    """key, name, parent and version from arrays of collections as a reference manager gives them.

    Fields stand in `data` or in the object itself. `parentCollection` is a key, or false at the top. Collections without a
    key are left out, a blank name is the key, a missing version is 0.
    """
    each = exploded(df.filter(is_kind(F.col(v), "$", "ARRAY")).select(v), F.col(v))
    o = F.col("value")
    rows = each.filter(is_kind(o, "$", "OBJECT")).withColumn("d", F.when(is_kind(o, "$.data", "OBJECT"), get(o, "$.data", "variant")).otherwise(o))
    d = F.col("d")
    some = lambda c: F.when(c != "", c)
    key = F.trim(F.coalesce(some(get(d, "$.key")), get(o, "$.key"), F.lit("")))
    parent = F.when(is_kind(d, "$.parentCollection", "BOOLEAN"), "").otherwise(F.coalesce(get(d, "$.parentCollection"), F.lit("")))
    version = F.coalesce(F.nullif(get(d, "$.version", "long"), F.lit(0)), get(o, "$.version", "long"), F.lit(0))
    return rows.select(key.alias("key"), F.coalesce(some(get(d, "$.name")), key).alias("name"), parent.alias("parent"), version.alias("version")).filter("key <> ''")


def tree_nodes(df: DataFrame, key: str, v: str, label: str = "label", children: str = "child", most_depth: int = 100) -> DataFrame:
    """The nodes of the trees in df, one tree or list of trees per key: key, position, parent_position, ordinal, depth, label
    and node (the rest as VARIANT, children left in).

    The trees are taken apart level by level, each level a written table, so their depth is what it is in the files. Nodes
    that aren't objects or have a blank label are left out with what is below them, but count in the positions.
    """
    scratch = Scratch(df.sparkSession)
    root = F.when(is_kind(F.col(v), "$", "ARRAY"), F.col(v)).otherwise(F.try_parse_json(F.concat(F.lit("["), F.to_json(v), F.lit("]"))))
    level, out = df.filter(F.col(v).isNotNull()).select(key, F.lit("").alias("position"), root.alias("below")), None
    for depth in range(most_depth + 1):
        rows = exploded(level, F.col("below")).filter(is_kind(F.col("value"), "$", "OBJECT"))
        name = F.trim(F.coalesce(get(F.col("value"), f"$.{label}"), F.lit("")))
        position = F.concat_ws(".", F.when(F.col("position") != "", F.col("position")), (F.col("pos") + 1).cast("string"))
        rows = rows.select(key, position.alias("position"), F.col("position").alias("parent_position"), (F.col("pos") + 1).cast("int").alias("ordinal"), F.lit(depth).alias("depth"), name.alias("label"), F.col("value").alias("node")).filter("label <> ''")
        rows = scratch.save(rows)
        if rows.isEmpty():
            return rows if out is None else out
        out = rows if out is None else out.unionByName(rows)
        below = get(F.col("node"), f"$.{children}", "variant")
        level = rows.filter(is_kind(F.col("node"), f"$.{children}", "ARRAY")).select(key, "position", below.alias("below"))
    raise ValueError(f"a tree has more than {most_depth} levels")


def project_results(spark: SparkSession, folder: str) -> DataFrame:
    """What builds have left in `folder`, one folder per project: project, status, generated_at, language, documents, tree,
    graph and manifest (VARIANT), and catalog.

    A file that names another project spoils the whole result, and there is no result without a domain_tree.json. The graph
    is only read where the status, `ready` if there is none, is ready or degraded.
    """
    project = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("project")
    part = lambda name: json_files(spark, f"{folder}/*/{name}").select(project, "v")
    built = part("domain_tree.json").filter(F.col("v").isNotNull())
    owner = lambda v: F.trim(F.coalesce(get(v, "$.projectId"), F.lit("")))
    other = lambda v: is_kind(v, "$", "OBJECT") & (owner(v) != "") & (owner(v) != F.col("project"))
    out = built.filter(~other(F.col("v")))
    out = out.withColumn("status", F.coalesce(get(F.col("v"), "$.graphStatus"), F.lit("ready")))
    for name, file in (("graph", "knowledge_graph.json"), ("manifest", "manifest.json")):
        out = out.join(part(file).withColumnRenamed("v", name), "project", "left")
    out = out.withColumn("graph", F.when(F.col("status").isin(*USABLE) & is_kind(F.col("graph"), "$", "OBJECT"), F.col("graph")))
    for name in ("graph", "manifest"):
        out = out.filter(F.col(name).isNull() | ~other(F.col(name)))
    texts = spark.read.text(f"{folder}/*/catalog.txt", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").select(project, F.col("value").alias("catalog"))
    out = out.join(texts, "project", "left")
    tree = F.when(is_kind(F.col("v"), "$", "ARRAY"), F.col("v")).otherwise(get(F.col("v"), "$.domainTree", "variant"))
    return out.select(
        "project", "status", F.coalesce(get(F.col("v"), "$.generatedAt"), F.lit("")).alias("generated_at"), F.coalesce(get(F.col("v"), "$.language"), F.lit("")).alias("language"),
        F.coalesce(get(F.col("v"), "$.documentCount", "long"), F.lit(0)).alias("documents"), tree.alias("tree"), "graph", "manifest", F.coalesce("catalog", F.lit("")).alias("catalog"),
    )
