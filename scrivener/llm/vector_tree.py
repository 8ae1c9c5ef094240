"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first through a priority queue.

Building. Vectors are compared by direction (their cosine). The tree grows in rounds: every round sends all vectors down
the tree, counts the rows of each leaf, and splits the leaves above twice `leaf_rows` by k-means, each in a task of its own
over a bounded sample of its rows (`sample_rows`, those of the smallest hash of their row number). All vectors are then
indexed under their leaf. The tree stops growing at `most_leaves`, so that it can be broadcast (65,536 leaves of 1,024
dimensions are 256 MB), and after `depth` rounds, in which 32 branches reach that many leaves; beyond that, leaves have more
rows, as leaves of equal or nearly equal vectors do.

Searching. A query walks the tree through a priority queue of branches, the one of the nearest centroid first, and visits
leaves in that order. How many it visits is calibrated: up to 200 of the queries (of the smallest hash) are compared with
all vectors, and visits are widened until these find `recall` of their true neighbours. Every query visits that many, and
goes on while the leaves visited hold too few rows.

Comparing. A leaf's rows and the queries that visit it are dealt to cells of at most `cell_rows` by `cell_queries` on
average, and a cell is one cogroup, so a leaf with a third of all rows is many tasks. A cell keeps its k best per query.
Candidates within a rounding error of the k-th are compared again one by one, so that equal vectors have equal scores.

Rows are told apart by a number, so ids may be repeated or null; a query leaves out its own row alone, and a null id is never
a query. Null vectors, zero vectors, and vectors that hold null or non-finite components take no part; nor do those of another
length than most have (of two lengths equally frequent, the smaller counts). Ties go to the smaller id, null ids last. With no
more than k other vectors all are returned; no vectors or no queries give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.shared import Scratch, arrow_batches

ROUNDING = 1e-9


@dataclass
class Tree:
    """Nodes as arrays: centroids (unit length), the first child and the number of children (none: a leaf)."""

    centroids: np.ndarray
    first: np.ndarray
    many: np.ndarray

    @classmethod
    def root(cls, dimensions: int) -> Tree:
        return cls(np.zeros((1, dimensions), np.float32), np.zeros(1, np.int64), np.zeros(1, np.int64))

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.many == 0)

    def grown(self, splits: dict[int, np.ndarray]) -> Tree:
        """With children of the given centroids below the given leaves."""
        first, many, parts, n = self.first.copy(), self.many.copy(), [self.centroids], len(self.many)
        for leaf, centroids in sorted(splits.items()):
            first[leaf], many[leaf] = n, len(centroids)
            parts.append(centroids)
            n += len(centroids)
        new = n - len(self.many)
        zeros = np.zeros(new, np.int64)
        return Tree(np.concatenate(parts), np.concatenate([first, zeros]), np.concatenate([many, zeros]))

    def descend(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of every row: the nearest child at each level, the first of equally near ones."""
        at = np.zeros(len(unit), np.int64)
        while True:
            inner = self.many[at] > 0
            if not inner.any():
                return at
            for node in np.unique(at[inner]):
                rows = np.flatnonzero(at == node)
                children = slice(self.first[node], self.first[node] + self.many[node])
                at[rows] = self.first[node] + np.argmax(unit[rows] @ self.centroids[children].T, axis=1)

    def best_bins(self, unit: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which the queue of branches gives them."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.many[node]:
                yield int(node)
                continue
            begin, end = self.first[node], self.first[node] + self.many[node]
            for child, near in zip(range(begin, end), (self.centroids[begin:end] @ unit).tolist(), strict=True):
                heapq.heappush(queue, (-near, child))


def units(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def k_means(unit: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids of unit vectors by direction, begun at far-apart rows. Empty clusters are left out, so there may be fewer."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(unit)))]
    away = 1 - unit @ unit[chosen[0]]
    for _ in range(k - 1):
        weights = np.maximum(away, 0).astype(float)
        if weights.sum() < 1e-6:
            break
        chosen.append(int(rng.choice(len(unit), p=weights / weights.sum())))
        away = np.minimum(away, 1 - unit @ unit[chosen[-1]])
    centroids = unit[chosen]
    for _ in range(rounds):
        nearest = np.argmax(unit @ centroids.T, axis=1)
        sums = np.zeros((len(centroids), unit.shape[1]))
        np.add.at(sums, nearest, unit)
        norms = np.linalg.norm(sums, axis=1)
        centroids = (sums[norms > 1e-9] / norms[norms > 1e-9, None]).astype(np.float32)
    return centroids


def matrix(column: pa.Array) -> np.ndarray:
    """A column of packed doubles as rows."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)


def packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows, "<f8")], pa.binary())


def valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """row, id, packed (doubles) of the vectors that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter("v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    rows = rows.filter(F.size("v") == (sizes[0]["size"] if sizes else 0)).withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(2).flatten(), "<f8").reshape(batch.num_rows, -1)
            # Scaled by a power of two, which changes no cosine, so that no square is lost to the range of doubles.
            _, power = np.frexp(np.abs(values).max(axis=1, initial=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(np.ldexp(values, -power[:, None]))], ["row", "id", "packed"])

    return rows.select("row", "id", "v").mapInArrow(run, "row long, id long, packed binary")


def splits(rows: DataFrame, tree: Tree, large: dict[int, int], leaf_rows: int, branches: int, sample_rows: int) -> dict[int, np.ndarray]:
    """For each large leaf the centroids of its children; each leaf's k-means is a task."""
    shared = rows.sparkSession.sparkContext.broadcast((tree, large))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, large = shared.value
        share = np.zeros(len(tree.many))
        share[list(large)] = [sample_rows / n for n in large.values()]
        for batch in batches:
            leaf = tree.descend(units(matrix(batch.column(1))))
            drawn = pa.array(np.asarray(batch.column(0)) / 2.0**32 < share[leaf])
            yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column(1)], ["leaf", "packed"]).filter(drawn)

    def fit(key, group):
        leaf = key[0].as_py()
        unit = units(matrix(group.column("packed").combine_chunks()))
        unit = unit[np.lexsort(unit.T)]  # whatever order the rows came in
        found = k_means(unit, min(branches, -(-shared.value[1][leaf] // leaf_rows) + 1), leaf)
        return pa.table({"leaf": pa.array([leaf] * len(found), pa.int64()), "centroid": packed(found)})

    # A sample by hash has about sample_rows rows of each leaf, whatever the leaf's size.
    sample = rows.select(F.xxhash64("row").bitwiseAND(0xFFFFFFFF).alias("h"), "packed").mapInArrow(sampled, "leaf long, packed binary")
    found: dict[int, list] = {}
    for r in sample.groupBy("leaf").applyInArrow(fit, "leaf long, centroid binary").toLocalIterator():  # most_leaves rows at most
        found.setdefault(r["leaf"], []).append(np.frombuffer(r["centroid"], "<f8"))
    return {leaf: np.array(c, np.float32) for leaf, c in found.items()}


def grow(rows: DataFrame, total: int, dimensions: int, leaf_rows: int, branches: int, sample_rows: int, most_leaves: int, depth: int) -> tuple[Tree, dict[int, int]]:
    """The tree over all rows, and the number of rows of each leaf."""
    tree, counts, final = Tree.root(dimensions), {0: total}, set()
    for _ in range(depth):
        large = {leaf: n for leaf, n in counts.items() if n > 2 * leaf_rows and leaf not in final}
        room = (most_leaves - len(tree.leaves())) // branches
        if not large or not room:
            break
        large = dict(sorted(large.items(), key=lambda x: (-x[1], x[0]))[:room])
        found = {leaf: c for leaf, c in splits(rows, tree, large, leaf_rows, branches, sample_rows).items() if len(c) > 1}
        final |= large.keys() - found.keys()
        if found:
            tree = tree.grown(found)
            counts = {r["leaf"]: r["n"] for r in under_leaves(rows, tree).groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    return tree, counts


def under_leaves(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows with their leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.descend(units(matrix(batch.column(2))))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "row", "id", "packed"])

    return rows.select("row", "id", "packed").mapInArrow(run, "leaf long, row long, id long, packed binary")


def best(q_rows: np.ndarray, q: np.ndarray, c_rows: np.ndarray, c_ids: list, c: np.ndarray, k: int) -> list[tuple[int, int, int | None, float]]:
    """Of candidates c the k nearest of each query, its own row left out, as (query's row, row, id, score)."""
    q_norms, c_norms = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    rough = (q @ c.T) / (q_norms[:, None] * c_norms)
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i in c_ids], np.int64)
    out = []
    for i, row in enumerate(q_rows):
        scores = rough[i]
        scores[c_rows == row] = -np.inf
        if len(scores) > k:
            near = np.flatnonzero(scores >= np.partition(scores, -k)[-k] - ROUNDING)
        else:
            near = np.arange(len(scores))
        near = near[c_rows[near] != row]
        exact = (c[near] * q[i]).sum(axis=1) / (q_norms[i] * c_norms[near])
        for j in np.lexsort((c_rows[near], ids[near], -exact))[:k]:
            out.append((int(row), int(c_rows[near[j]]), c_ids[near[j]], float(exact[j])))
    return out


FOUND = "q long, row long, id long, score double"


def as_found(rows: list[tuple]) -> dict[str, pa.Array]:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return {n: pa.array(x, t) for n, x, t in zip(("q", "row", "id", "score"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)}


def nearest_first() -> list[Column]:
    return [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]


def k_best(found: DataFrame, k: int) -> DataFrame:
    """found with rank, the k nearest of each query. Spark drops what is beyond the k-th before the shuffle too."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*nearest_first()))).filter(F.col("rank") <= k)


def exact(rows: DataFrame, q_rows: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Neighbours of a bounded number of queries by comparing each with all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((q_rows, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_rows, q = shared.value
        for batch in batches:
            found = best(q_rows, q, np.asarray(batch.column(0)), batch.column(1).to_pylist(), matrix(batch.column(2)), k)
            yield pa.RecordBatch.from_pydict(as_found(found))

    return k_best(rows.select("row", "id", "packed").mapInArrow(run, FOUND), k)


def calibrated(index: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float, most: int) -> int:
    """How many leaves a query has to visit, so that `most` of the queries find `recall` of their true neighbours."""
    some = queries.orderBy(F.xxhash64("row"), "row").limit(most).select("row", "packed").toArrow()
    if not some.num_rows:
        return 1
    q_rows, q = np.asarray(some["row"]), matrix(some["packed"].combine_chunks())
    true = exact(index, q_rows, q, k).select("q", "row").join(index.select("row", "leaf"), "row").select("q", "leaf").collect()  # most * k rows
    place = {(int(r), leaf): n for r, v in zip(q_rows, units(q), strict=True) for n, leaf in enumerate(tree.best_bins(v))}
    needed = np.sort([place[t["q"], t["leaf"]] + 1 for t in true])
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def visits(queries: DataFrame, tree: Tree, counts: dict[int, int], most: int, k: int) -> DataFrame:
    """A row per query and leaf to visit."""
    shared = queries.sparkSession.sparkContext.broadcast((tree, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, counts = shared.value
        for batch in batches:
            unit = units(matrix(batch.column(1)))
            taken, leaves = [], []
            for i in range(len(unit)):
                seen = held = 0
                for leaf in tree.best_bins(unit[i]):
                    if seen >= most and held > k:
                        break
                    seen, held = seen + 1, held + counts.get(leaf, 0)
                    taken.append(i)
                    leaves.append(leaf)
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), *(c.take(pa.array(taken, pa.int64())) for c in batch.columns)], ["leaf", "row", "packed"])

    return queries.select("row", "packed").mapInArrow(run, "leaf long, row long, packed binary")


def nearest(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", wanted: Column | None = None, k: int = 5, recall: float = 0.97,
    leaf_rows: int = 512, branches: int = 32, sample_rows: int = 8192, most_leaves: int = 65_536, depth: int = 4, calibration: int = 200, cell_rows: int = 16_384, cell_queries: int = 1024,
) -> DataFrame:
    """The k nearest vectors of every wanted row, as query_id, rank, vec_id and score (cosine). wanted is a condition on
    `id`; the default takes all rows that have an id."""
    spark = arrow_batches(vectors.sparkSession)
    scratch = Scratch(spark)
    rows = scratch.save(valid(vectors, id_column, vector_column))
    first = rows.limit(1).collect()
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree, counts = grow(rows, rows.count(), len(first[0]["packed"]) // 8, leaf_rows, branches, sample_rows, most_leaves, depth)
    index = scratch.save(under_leaves(rows, tree))
    queries = index.filter(F.col("id").isNotNull() & (F.lit(True) if wanted is None else wanted))
    most = calibrated(index, queries, tree, k, recall, calibration)
    visited = scratch.save(visits(queries, tree, counts, most, k))

    # Cells: a leaf's rows in parts, its queries in parts, and each part of one with each part of the other.
    asked = {r["leaf"]: r["n"] for r in visited.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # most_leaves rows at most
    parts = [(leaf, -(-counts.get(leaf, 1) // cell_rows), -(-n // cell_queries)) for leaf, n in asked.items()]
    cells = F.broadcast(spark.createDataFrame(parts, "leaf long, c_parts int, q_parts int"))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    c = index.join(cells, "leaf").withColumn("c_part", dealt("c_parts")).withColumn("q_part", every("q_parts")).select("leaf", "c_part", "q_part", "row", "id", "packed")
    q = visited.join(cells, "leaf").withColumn("q_part", dealt("q_parts")).withColumn("c_part", every("c_parts")).select("leaf", "c_part", "q_part", "row", "packed")

    def compare(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table(as_found([]))
        l, r = left.combine_chunks(), right.combine_chunks()
        q_rows, q = np.asarray(l["row"]), matrix(l["packed"].combine_chunks())
        c_rows, c, ids = np.asarray(r["row"]), matrix(r["packed"].combine_chunks()), r["id"].to_pylist()
        found = []
        for at in range(0, len(q_rows), 64):  # 64 queries' scores at once
            found += best(q_rows[at : at + 64], q[at : at + 64], c_rows, ids, c, k)
        return pa.table(as_found(found))

    keys = ["leaf", "c_part", "q_part"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(compare, FOUND)
    ids = queries.select(F.col("row").alias("q"), F.col("id").alias("query_id"))
    return k_best(found, k).withColumnRenamed("id", "vec_id").join(ids, "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
