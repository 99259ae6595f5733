"""Approximate nearest neighbours: a forest of random-projection trees and one priority queue over all of it.

A tree halves its vectors again and again at the median of their projection on the line through two random
ones. The forest is fitted on a bounded sample (the ``sample`` rows of least hash of their id) and so has a
bounded size; every row is then assigned to its leaf in each tree. A query walks all trees through one
queue, always into the branch with the least sum of squared margins on the way, until the leaves it has reached
hold ``share`` of all rows. The share is measured: the smallest that finds ``recall`` of the true neighbours
of some sample rows by brute force over the sample; rows that are alike need little, random ones much.
Candidates of a leaf are ranked by the exact distance on the original vectors, in blocks of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgrid.llm.store import keep


@dataclass
class Tree:
    """Inner node i has a plane and two children; a negative child -k - 1 is leaf k."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int


def grow(vectors: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
    """A tree over ``vectors``; sets that no plane divides stay one leaf."""
    normals, offsets, children, leaves = [], [], [], 0
    todo = [(np.arange(len(vectors)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        node = None
        if len(rows) > leaf_rows:
            for _ in range(4):
                a, b = vectors[rng.choice(rows, 2, replace=False)]
                normal = (a - b) / max(float(np.linalg.norm(a - b)), 1e-30)
                projected = vectors[rows] @ normal
                cut = float(np.median(projected))
                left = projected <= cut
                if 0 < left.sum() < len(rows):
                    node = len(normals)
                    normals.append(normal)
                    offsets.append(cut)
                    children.append([0, 0])
                    todo += [(rows[left], node, 0), (rows[~left], node, 1)]
                    break
        if node is None:
            node, leaves = -leaves - 1, leaves + 1
        if parent >= 0:
            children[parent][side] = node
    shape = (len(normals), vectors.shape[1])
    return Tree(np.array(normals, float).reshape(shape), np.array(offsets, float), np.array(children, np.int64).reshape(-1, 2), leaves)


def assign(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """Leaf of each vector."""
    if not len(tree.normals):
        return np.zeros(len(vectors), np.int64)
    at = np.zeros(len(vectors), np.int64)
    inner = np.arange(len(vectors))
    while len(inner):
        node = at[inner]
        right = np.einsum("ij,ij->i", vectors[inner], tree.normals[node]) > tree.offsets[node]
        at[inner] = tree.children[node, right.astype(np.int64)]
        inner = inner[at[inner] >= 0]
    return -at - 1


def walk(forest: list[Tree], rows_in: list[np.ndarray], vector: np.ndarray, search: float) -> list[tuple[int, int]]:
    """(tree, leaf) in order of the shared queue until they hold ``search`` rows."""
    margins = [t.normals @ vector - t.offsets for t in forest]
    queue = [(0.0, k, 0 if len(t.normals) else -1) for k, t in enumerate(forest)]
    heapq.heapify(queue)
    found, rows = [], 0
    while queue and rows < search:
        cost, k, node = heapq.heappop(queue)
        if node < 0:
            found.append((k, -node - 1))
            rows += int(rows_in[k][-node - 1])
            continue
        margin = float(margins[k][node])
        left, right = map(int, forest[k].children[node])
        near, far = (right, left) if margin > 0 else (left, right)
        heapq.heappush(queue, (cost, k, near))
        heapq.heappush(queue, (cost + margin * margin, k, far))
    return found


def needed_share(forest: list[Tree], vectors: np.ndarray, k: int, recall: float, tests: int = 64) -> float:
    """Rows that a walk must reach, as a share of all (over 1 where trees overlap), to find ``recall`` of the
    ``k`` nearest of the first rows."""
    if len(vectors) <= k + 1:
        return float(len(forest))
    leaf = [assign(t, vectors) for t in forest]
    rows_in = [np.bincount(x, minlength=t.leaves) for x, t in zip(leaf, forest)]
    asked = vectors[:tests]
    gaps = ((asked ** 2).sum(1)[:, None] - 2 * asked @ vectors.T + (vectors ** 2).sum(1)[None])
    gaps[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    true = np.argpartition(gaps, k, axis=1)[:, :k]
    share = 0.01
    while share < len(forest):
        hits = 0
        for x, want in zip(asked, true):
            seen = np.zeros(len(want), bool)
            for tree, place in walk(forest, rows_in, x, share * len(vectors)):
                seen |= leaf[tree][want] == place
            hits += int(seen.sum())
        if hits >= recall * true.size:
            return share
        share *= 1.25
    return float(len(forest))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)


class ForestIndex:
    """Index of a table (vec_id, embedding).

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with null
    id and vectors whose length is not the most frequent one (the smaller of a tie). Rows that repeat an id
    are one row, the least vector. Of equal vectors only the ``k`` + 1 smallest ids are indexed: others cannot
    be among the ``k`` nearest of any query, whose ties go to the smaller id.
    """

    def __init__(self, table: DataFrame, k: int = 10, trees: int = 8, sample: int = 20_000, leaf_rows: int = 64,
                 recall: float = 0.97, seed: int = 7):
        self.k = k
        rows = table.select(table["vec_id"].cast("long").alias("vec_id"), table["embedding"])
        fine = rows.where("vec_id is not null and embedding is not null").where(
            "not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)")
        size = fine.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        self.dim = size["dim"] if size else 0
        self.points = fine.where(F.size("embedding") == self.dim)
        if not self.points.groupBy("vec_id").count().where("count > 1").isEmpty():
            self.points = keep(self.points.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "points")
        equal = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
        self.indexed = keep(self.points.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k + 1).drop("n"), "indexed")
        # Every task would send its own first rows; a bound on the hash leaves about a third more than the sample in all.
        draw = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 40))
        bound = int(min(1.0, (1.3 * sample + 1000) / max(self.indexed.count(), 1)) * (1 << 40))
        chosen = self.indexed.where(draw < bound).orderBy(draw, "vec_id").limit(sample).toArrow()
        column = chosen.column("embedding").combine_chunks()
        self.sample = _matrix(column, self.dim) if len(column) else np.zeros((0, self.dim))
        self.sample_ids = chosen.column("vec_id").to_numpy()
        rng = np.random.default_rng(seed)
        self.forest = [grow(self.sample, leaf_rows, rng) for _ in range(trees)]
        self.first_leaf = np.cumsum([0] + [t.leaves for t in self.forest])
        self.share = needed_share(self.forest, self.sample, k, recall)

    def leaves(self) -> DataFrame:
        """(leaf, vec_id, embedding): every indexed row in its leaf of every tree."""
        forest, base, dim = self.forest, self.first_leaf, self.dim

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    vectors = _matrix(batch.column("embedding"), dim)
                    for k, tree in enumerate(forest):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(assign(tree, vectors) + base[k], pa.int64()), *batch.columns], ["leaf", *batch.schema.names])

        schema = self.indexed.schema
        return self.indexed.mapInArrow(scan, f"leaf long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}")

    def visits(self, queries: DataFrame, sizes: np.ndarray, bounded: bool = True) -> DataFrame:
        """(leaf, query_id, query, bound): the leaves that each query reaches. ``bound``, the distance of the 3k-th
        other row of the sample, is farther than any of the k nearest."""
        forest, base, dim, k = self.forest, self.first_leaf, self.dim, self.k
        rows_in = [sizes[a:b] for a, b in zip(base[:-1], base[1:])]
        search = self.share * sizes.sum() / len(forest)
        sample, sample_ids = self.sample, self.sample_ids

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(a, 64) for a in range(0, whole.num_rows, 64)):
                    ids = batch.column("query_id").to_numpy(zero_copy_only=False)
                    vectors = _matrix(batch.column("embedding"), dim)
                    bound = np.full(len(ids), np.inf)
                    rows, places = [], []
                    for i, vector in enumerate(vectors):
                        others = np.sqrt(((sample - vector) ** 2).sum(axis=1))[sample_ids != ids[i]]
                        if bounded and len(others) >= 3 * k:
                            bound[i] = np.partition(others, 3 * k - 1)[3 * k - 1] * (1 + 1e-9)
                        for tree, leaf in walk(forest, rows_in, vector, search):
                            rows.append(i)
                            places.append(int(base[tree]) + leaf)
                    index = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(places, pa.int64()), batch.column("query_id").take(index), batch.column("embedding").take(index),
                         pa.array(bound).take(index)], ["leaf", "query_id", "query", "bound"])

        kind = self.indexed.schema["embedding"].dataType.simpleString()
        return queries.select("query_id", "embedding").mapInArrow(scan, f"leaf long, query_id long, query {kind}, bound double")

    def nearest(self, queries: DataFrame) -> DataFrame:
        """(query_id, rank, vec_id, score): the ``k`` nearest found of each (query_id, embedding), without the
        row of the same id; fewer only if there are fewer rows."""
        if not self.dim:
            return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        leaves = keep(self.leaves(), "leaves")
        found = keep(self._ranked(leaves, queries, True), "found")
        full = found.where(F.col("rank") == self.k).select("query_id")
        short = queries.join(full, "query_id", "left_anti")
        if short.isEmpty():
            return found
        # Walks that met fewer rows within the bound than asked for count all they met.
        return found.join(full, "query_id", "left_semi").unionByName(self._ranked(leaves, short, False))

    def _ranked(self, leaves: DataFrame, queries: DataFrame, bounded: bool, point_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
        """The nearest rows of each query; a leaf of more rows than ``point_rows`` or ``query_rows`` is worked in
        blocks of that size."""
        spark = queries.sparkSession
        dim, k = self.dim, self.k

        def counted(df: DataFrame) -> np.ndarray:
            out = np.zeros(self.first_leaf[-1], np.int64)
            for row in df.groupBy("leaf").count().collect():  # one row per leaf of the bounded forest
                out[row["leaf"]] = row["count"]
            return out

        sizes = counted(leaves)
        visits = keep(self.visits(queries, sizes, bounded), "visits")
        p_blocks = np.maximum(1, -(-sizes // point_rows))
        q_blocks = np.maximum(1, -(-counted(visits) // query_rows))
        blocks = spark.createDataFrame([(i, int(p), int(q)) for i, (p, q) in enumerate(zip(p_blocks, q_blocks))],
                                       "leaf long, p_blocks int, q_blocks int")
        # At most one row per leaf of the bounded forest.
        left = leaves.join(F.broadcast(blocks), "leaf").selectExpr(
            "leaf", "cast(pmod(xxhash64(vec_id), p_blocks) as int) as p", "explode(sequence(0, q_blocks - 1)) as q", "vec_id", "embedding")
        right = visits.join(F.broadcast(blocks), "leaf").selectExpr(
            "leaf", "explode(sequence(0, p_blocks - 1)) as p", "cast(pmod(xxhash64(query_id), q_blocks) as int) as q",
            "query_id", "query", "bound")
        out_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

        def rank(points: pa.Table, asked: pa.Table) -> pa.Table:
            found = []
            if points.num_rows and asked.num_rows:
                ids = points.column("vec_id").to_numpy()
                vectors = _matrix(points.column("embedding").combine_chunks(), dim)
                wanted = _matrix(asked.column("query").combine_chunks(), dim)
                squares = (vectors ** 2).sum(axis=1)
                for query, vector, bound in zip(asked.column("query_id").to_pylist(), wanted, asked.column("bound").to_numpy()):
                    rough = squares - 2 * (vectors @ vector) + vector @ vector
                    slack = 1e-9 * (squares + vector @ vector)
                    near = np.flatnonzero((rough <= bound * bound + slack) & (ids != query))
                    score = np.sqrt(((vectors[near] - vector) ** 2).sum(axis=1))
                    best = np.lexsort((ids[near], score))[:k]
                    found.append((np.full(len(best), query), ids[near][best], score[best]))
            if not found:
                return out_schema.empty_table()
            return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=out_schema)

        scored = left.groupBy("leaf", "p", "q").cogroup(right.groupBy("leaf", "p", "q")).applyInArrow(
            rank, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
            "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
