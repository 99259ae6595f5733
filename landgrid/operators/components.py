"""Connected groups of equal-class cells.

Tiles are labelled on their own (bounded groups); the labels that meet at tile borders form a
much smaller graph, which is contracted in rounds until no edge is left. Every round hooks
each label to a pseudo-randomly preferred neighbour, so a constant share of the labels is
expected to vanish per round whatever the shape of the patches. Rounds are cut by reliable
checkpoints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.session import cut_lineage

TILE = 512
FORWARD = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, 0), (1, 1), (1, -1))}


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index per index, from edges (a, b)."""
    parent = np.arange(n)
    while a.size:
        pa, pb = parent[a], parent[b]
        open_ = pa != pb
        if not open_.any():
            break
        a, b, pa, pb = a[open_], b[open_], pa[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _label_tile(pdf: pd.DataFrame, directions: int) -> pd.DataFrame:
    pdf = pdf.sort_values("cell_id", ignore_index=True)
    r, c, v = (pdf[k].to_numpy() for k in ("r", "c", "v"))
    r, c = r - r.min(), c - c.min()
    index = np.full((r.max() + 2, c.max() + 3), -1, dtype=np.int64)
    index[r, c + 1] = np.arange(len(pdf))
    left, right = [], []
    for dr, dc in FORWARD[directions]:
        other = index[r + dr, c + 1 + dc]
        here = np.flatnonzero(other >= 0)
        same = here[v[here] == v[other[here]]]
        left.append(same)
        right.append(other[same])
    root = _roots(len(pdf), np.concatenate(left), np.concatenate(right))
    return pdf.assign(label=pdf["cell_id"].to_numpy()[root])


def _round_key(turn: int) -> tuple[int, int]:
    digest = hashlib.md5(f"round {turn}".encode()).digest()
    return 1 + digest[0] % 63, int.from_bytes(digest[8:], "big", signed=True)


def _shuffle(node: Column, turn: int) -> Column:
    """Reversible pseudo-random order of the labels: rotate the bits and flip some of them. A
    plain number, so the minimum stays a hash aggregation."""
    turn_by, mask = _round_key(turn)
    return F.shiftleft(node, turn_by).bitwiseOR(
        F.shiftrightunsigned(node, 64 - turn_by)).bitwiseXOR(F.lit(mask))


def _unshuffle(rank: Column, turn: int) -> Column:
    turn_by, mask = _round_key(turn)
    x = rank.bitwiseXOR(F.lit(mask))
    return F.shiftrightunsigned(x, turn_by).bitwiseOR(F.shiftleft(x, 64 - turn_by))


def contract(edges: DataFrame, by: Sequence[str], max_rounds: int = 200) -> DataFrame | None:
    """Map every node of an undirected graph to the smallest node of its component; ``None``
    for a graph without edges. ``edges`` has columns ``a``, ``b`` next to the group columns."""
    by = list(by)
    edges = cut_lineage(edges.filter(F.col("a") != F.col("b")).distinct())
    if edges.isEmpty():
        return None
    both = lambda e: e.select(*by, "a", "b").unionByName(
        e.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = both(edges).select(*by, F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    for turn in range(max_rounds):
        near = both(edges).groupBy(*by, "a").agg(F.min(_shuffle(F.col("b"), turn)).alias("m"))
        hook = near.select(*by, F.col("a").alias("root"), _unshuffle(
            F.least(F.col("m"), _shuffle(F.col("a"), turn)), turn).alias("up"))
        hook = cut_lineage(hook)
        nodes = cut_lineage(nodes.join(hook, [*by, "root"], "left")
                            .select(*by, "node", F.coalesce("up", "root").alias("root")))
        side = lambda old, new: hook.select(*by, F.col("root").alias(old),  # noqa: B023,E731
                                            F.col("up").alias(new))
        edges = cut_lineage(
            edges.join(side("a", "ua"), [*by, "a"]).join(side("b", "ub"), [*by, "b"])
            .select(*by, F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .filter(F.col("a") != F.col("b")).distinct())
        if edges.isEmpty():
            # Pre-aggregated minimum per root; adaptive execution splits a hot root in the join.
            smallest = nodes.groupBy(*by, "root").agg(F.min("node").alias("component"))
            return nodes.join(smallest, [*by, "root"]).select(*by, "node", "component")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def connected_components(px: DataFrame, directions: int = 8, by: Sequence[str] = ("yr",),
                         value: str = "cls", tile: int = TILE) -> DataFrame:
    """Cells with the smallest ``cell_id`` of their patch as ``component``. Cells join when
    they touch (4 or 8 directions) and hold the same non-NULL value. ``label`` is the part of
    the patch inside one tile."""
    by = list(by)
    cells = px.filter(F.col(value).isNotNull()).select(
        *by, "cell_id", "r", "c", F.col(value).alias("v"),
        F.expr(f"r div {tile}").alias("tr"), F.expr(f"c div {tile}").alias("tc"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields)
    labelled = cut_lineage(cells.groupBy(*by, "tr", "tc").applyInPandas(
        lambda pdf: _label_tile(pdf, directions), schema=schema + ", label bigint"))

    rim = labelled.filter(
        F.expr(f"r % {tile} IN (0, {tile - 1}) OR c % {tile} IN (0, {tile - 1})")).select(
        *by, "r", "c", "v", "label", "tr", "tc")
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"))
                      for dr, dc in FORWARD[directions]])
    sent = rim.select(*by, "v", F.col("label").alias("a"), "tr", "tc", "r", "c", F.inline(steps))
    sent = sent.withColumns({"r": F.col("r") + F.col("dr"), "c": F.col("c") + F.col("dc")}).filter(
        F.expr(f"r div {tile} <> tr OR floor(c / {tile}) <> tc")).drop("tr", "tc", "dr", "dc")
    edges = sent.join(rim.select(*by, "r", "c", "v", F.col("label").alias("b")),
                      [*by, "r", "c", "v"]).select(*by, "a", "b")
    merged = contract(edges, by)
    out = labelled.select(*by, "cell_id", "r", "c", F.col("v").alias(value), "label")
    if merged is None:
        return out.withColumn("component", F.col("label"))
    # A tile-local label covers at most one tile of cells, so this key cannot run hot.
    return (out.join(merged.withColumnRenamed("node", "label"), [*by, "label"], "left")
            .withColumn("component", F.coalesce("component", "label")))


def sieve_small(prob: DataFrame, lulc_post: DataFrame, min_cells: int,
                by: Sequence[str] = ("yr",), directions: int = 4, tile: int = TILE) -> DataFrame:
    """Change map from probabilities: above one half is change, water never is, and patches
    of fewer than ``min_cells`` cells are removed. NULL probability stays NULL."""
    by = list(by)
    joined = prob.join(lulc_post.select(*by, "cell_id", F.col("cls").alias("post")),
                       [*by, "cell_id"], "left")
    raw = F.when(F.col("prob").isNull(), None).when(F.col("prob") > 0.5, 1).otherwise(0)
    flagged = cut_lineage(joined.select(
        *by, "cell_id", "r", "c", F.when(F.col("post") == 4, 0).otherwise(raw).alias("change")))
    groups = connected_components(flagged.filter(F.col("change") == 1), directions, by, "change",
                                  tile)
    parts = groups.groupBy(*by, "component", "label").agg(F.count(F.lit(1)).alias("cells"))
    small = (parts.groupBy(*by, "component").agg(F.sum("cells").alias("cells"))
             .filter(F.col("cells") < min_cells))
    labels = parts.join(small, [*by, "component"], "left_semi").select(*by, "label")
    drop = groups.join(labels, [*by, "label"], "left_semi").select(*by, "cell_id",
                                                                   F.lit(0).alias("to"))
    return flagged.join(drop, [*by, "cell_id"], "left").select(
        *by, "cell_id", "r", "c", F.coalesce("to", "change").alias("change"))
