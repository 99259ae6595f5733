"""Scores of a fitted random forest by columns of bits.

MLlib scores row by row and walks every tree for each; a large forest does not fit the processor's cache, so each step of each
walk waits for memory. Here a task takes some thousands of rows at once: a split is a column of bits, one per row, a node is the
bits of the rows that reach it, and a level of several trees is a handful of operations on such columns. Votes are
added in the order of the trees, so the class is the one MLlib gives, ties and last digits included.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.session import scratch_path

#: Rows scored at once, and trees whose levels are worked together.
ROWS, TREES = 4096, 8


@dataclass
class Grove:
    """Some trees by levels. A level has the places of leaves and of split nodes among its nodes, and the splits; the next level has
    all left children, then all right ones. Leaves, in the order they are met, vote in runs of equal tree, class and vote."""

    roots: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    leaf: np.ndarray
    starts: np.ndarray
    classes: list[int]
    votes: list[float]


def splits_and_groves(forest: RandomForestClassificationModel, df: DataFrame) -> tuple[np.ndarray, np.ndarray, list[Grove]]:
    """Feature and threshold of every distinct split, and the trees. Nodes are read from the stored model, which is as large
    as the forest that MLlib has built on the driver."""
    path = scratch_path(df.sparkSession, "forest")
    forest.write().save(path)
    nodes = df.sparkSession.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.impurityStats",
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).orderBy("treeID", "id").toArrow()
    tree, left, right, feature, threshold = (
        nodes.column(c).to_numpy() for c in ("treeID", "leftChild", "rightChild", "feature", "threshold"))
    stats = nodes.column("impurityStats").combine_chunks().flatten().to_numpy().reshape(len(tree), -1)
    total = stats.sum(axis=1, keepdims=True)
    share = np.divide(stats, total, out=np.zeros_like(stats), where=total != 0)
    split = left >= 0
    kinds, of = np.unique(feature[split] + 1j * threshold[split], return_inverse=True)  # by feature, then threshold
    kind = np.full(len(tree), -1)
    kind[split] = of
    first = np.searchsorted(tree, np.arange(forest.getNumTrees))
    down, up = left + first[tree], right + first[tree]
    groves = []
    for at in range(0, len(first), TREES):
        now, levels, met = first[at:at + TREES], [], []
        while len(now):
            inner = np.flatnonzero(split[now])
            ends = np.flatnonzero(~split[now])
            levels.append((ends, inner, kind[now[inner]]))
            met.append(now[ends])
            now = np.concatenate([down[now[inner]], up[now[inner]]])
        leaves = np.concatenate(met)
        leaf, classes = np.nonzero(share[leaves])
        votes, trees = share[leaves[leaf], classes], tree[leaves[leaf]]
        order = np.lexsort((votes, classes, trees))
        leaf, classes, votes, trees = leaf[order], classes[order], votes[order], trees[order]
        fresh = np.ones(len(leaf), bool)
        fresh[1:] = (trees[1:] != trees[:-1]) | (classes[1:] != classes[:-1]) | (votes[1:] != votes[:-1])
        starts = np.flatnonzero(fresh)
        groves.append(Grove(len(first[at:at + TREES]), levels, leaf, starts, classes[starts].tolist(), votes[starts].tolist()))
    return kinds.real.astype(int), kinds.imag, groves


def best_class(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, groves: Sequence[Grove], classes: int) -> np.ndarray:
    """Class of most votes of each row of ``x``, the first on ties."""
    n = len(x)
    held = np.zeros((len(feature), -(-n // 64) * 64), bool)
    held[:, :n] = x.T[feature] <= threshold[:, None]
    below = np.packbits(held, axis=1).view(np.uint64)
    total = np.zeros((classes, n))
    for g in groves:
        mask, ends = np.full((g.roots, below.shape[1]), ~np.uint64(0)), []
        for leaves, inner, split in g.levels:
            ends.append(mask[leaves])
            above = mask[inner]
            mask = np.empty((2 * len(inner), below.shape[1]), np.uint64)
            np.bitwise_and(above, below[split], out=mask[:len(inner)])
            np.bitwise_xor(above, mask[:len(inner)], out=mask[len(inner):])
        if not len(g.starts):
            continue
        reached = np.bitwise_or.reduceat(np.concatenate(ends)[g.leaf], g.starts, axis=0)
        for bits, c, vote in zip(np.unpackbits(reached.view(np.uint8), axis=1, count=n), g.classes, g.votes):
            total[c] += bits if vote == 1.0 else bits * vote
    return total.argmax(axis=0)


def forest_classes(forest: RandomForestClassificationModel, df: DataFrame, keys: Sequence[str], features: Sequence[str],
                   usable: str) -> DataFrame:
    """``keys`` and the predicted ``cls`` of every row, NULL where ``usable`` is not true."""
    keys, names, classes = list(keys), [f"x{i}_" for i in range(len(features))], forest.numClasses
    shared = df.sparkSession.sparkContext.broadcast(splits_and_groves(forest, df))
    rows = df.select(*keys, F.coalesce(usable, F.lit(False)).alias("usable_"),
                     *[F.col(f).cast("double").alias(n) for f, n in zip(features, names)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = batch.column("usable_").to_numpy(zero_copy_only=False).astype(bool)
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            cls, at = np.zeros(len(x), np.int32), np.flatnonzero(ok)
            for a in range(0, len(at), ROWS):
                part = at[a:a + ROWS]
                cls[part] = best_class(x[part], *shared.value, classes)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(cls, pa.int32(), mask=~ok)], [*keys, "cls"])

    return rows.mapInArrow(scan, T.StructType([*(rows.schema[k] for k in keys), T.StructField("cls", T.IntegerType())]))
