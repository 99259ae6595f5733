"""Exact nearest neighbours over an adaptive quadtree of Morton codes.

Counts of cells, taken once and again only inside crowded cells, give leaves of at most ``leaf`` points: crowded cells split
alone, sparse siblings are one leaf. Every leaf is searched on its own. A point then visits those other leaves only that come
nearer than its k-th neighbour so far, and brings back at most k candidates from each. A leaf with too few points has a
crowded parent: its points reach no further than the leaves below that parent which hold k points for certain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgrid.session import stored

BITS = 31
STEP = 6
LEAF = 16_384
#: Leaves are kept on the driver and sent with the tasks: with more points, leaves grow instead of their number.
LEAVES = 100_000
BLOCK = 256


def morton(ix: np.ndarray, iy: np.ndarray) -> np.ndarray:
    """Interleaved bits of two 31-bit numbers."""
    def spread(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.int64)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                            (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = (v | (v << shift)) & mask
        return v

    return spread(ix) | (spread(iy) << 1)


class Frame:
    """The square that holds all points, in 2^31 steps each way."""

    def __init__(self, x0: float, y0: float, span: float):
        self.x0, self.y0, self.span = x0, y0, span if span > 0 else 1.0

    def codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        top = (1 << BITS) - 1
        place = lambda v, v0: np.clip(np.floor((v - v0) / self.span * (1 << BITS)), 0, top)
        return morton(place(x, self.x0), place(y, self.y0))


def leaves_of(cells: dict[tuple[int, int], int], leaf: int) -> list[tuple[int, int]]:
    """(level, code) of the leaves over counted, disjoint ``cells``: siblings of together at most ``leaf`` points are one."""
    by_level: dict[int, dict[int, int]] = {}
    for (level, code), n in cells.items():
        by_level.setdefault(level, {})[code] = n
    out, held = [], set()  # held: cells with leaves further down
    for level in range(max(by_level, default=0), 0, -1):
        parents: dict[int, int] = {}
        for code, n in by_level.get(level, {}).items():
            parents[code >> 2] = parents.get(code >> 2, 0) + n
        stay = {p for p, n in parents.items() if n > leaf} | {code >> 2 for code in held}
        for code, n in by_level.get(level, {}).items():
            if code >> 2 in stay:
                out.append((level, code))
            else:
                above = by_level.setdefault(level - 1, {})
                above[code >> 2] = above.get(code >> 2, 0) + n
        held = stay
    return out + [(0, code) for code in by_level.get(0, {})]


def nearest_in(qx: np.ndarray, qy: np.ndarray, qid: np.ndarray, reach: np.ndarray, px: np.ndarray, py: np.ndarray, pid: np.ndarray,
               k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, distance, id) of up to ``k`` nearest points within ``reach`` of each query but itself, nearest first and the lower
    id first on ties. Queries and points in Morton order meet block by block, near blocks first."""
    rows, dists, ids = [], [], []
    starts = np.arange(0, len(px), BLOCK)
    low_x, high_x = np.minimum.reduceat(px, starts), np.maximum.reduceat(px, starts)
    low_y, high_y = np.minimum.reduceat(py, starts), np.maximum.reduceat(py, starts)
    for a in range(0, len(qx), BLOCK):
        x, y, own = qx[a:a + BLOCK], qy[a:a + BLOCK], qid[a:a + BLOCK]
        bound = reach[a:a + BLOCK].copy()
        gap_x = np.maximum(0, np.maximum(low_x - x.max(), x.min() - high_x))
        gap_y = np.maximum(0, np.maximum(low_y - y.max(), y.min() - high_y))
        gap = np.sqrt(gap_x * gap_x + gap_y * gap_y)
        row, dist, ident = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for b in np.argsort(gap, kind="stable").tolist():
            if gap[b] > bound.max():
                break
            s = slice(starts[b], starts[b] + BLOCK)
            dx, dy = x[:, None] - px[s], y[:, None] - py[s]
            d = np.sqrt(dx * dx + dy * dy)
            d[own[:, None] == pid[s]] = np.inf
            limit = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1]) if d.shape[1] >= k else bound
            r, c = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
            row, dist, ident = np.concatenate([row, r]), np.concatenate([dist, d[r, c]]), np.concatenate([ident, pid[s][c]])
            order = np.lexsort((ident, dist, row))
            row, dist, ident = row[order], dist[order], ident[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            full = place == k - 1
            bound[row[full]] = np.minimum(bound[row[full]], dist[full])
            row, dist, ident = row[place < k], dist[place < k], ident[place < k]
        rows.append(row + a)
        dists.append(dist)
        ids.append(ident)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(dists), np.concatenate(ids)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


class Quadtree:
    """``points`` (id, x, y) ready for searches of ``k`` neighbours. Rows with a null or NaN in one of them take no part; ids are
    distinct. Of points on one spot only the k + 1 lowest ids can be neighbours, so a crowded spot weighs no more."""

    def __init__(self, points: DataFrame, k: int, leaf: int = LEAF):
        clean = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        self.points = clean.filter("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
        n, x0, x1, y0, y1 = self.points.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        self.n, self.k = n, max(1, min(int(k), n - 1))
        self.leaf = max(leaf, 4 * (self.k + 1), n // LEAVES)
        self.frame = Frame(x0, y0, max(x1 - x0, y1 - y0)) if n else Frame(0.0, 0.0, 1.0)
        spot = Window.partitionBy("x", "y").orderBy("id")
        low = self.points.withColumn("at_", F.row_number().over(spot)).filter(F.col("at_") <= self.k + 1)
        self.low = stored(low, "spots")
        self.starts, self.levels = self._tree()

    def _tree(self) -> tuple[np.ndarray, np.ndarray]:
        """First code at full depth and level of every leaf, in the order of codes."""
        cells = {(0, 0): self.n}
        open_ = [(0, 0)] if self.n > self.leaf else []
        while open_:
            step = max(STEP, math.ceil(math.log(self.n / self.leaf, 4)) + 1) if open_ == [(0, 0)] else STEP
            found = self._counts(open_, step)
            for cell in open_:
                del cells[cell]
            cells.update(found)
            open_ = [(level, code) for (level, code), n in found.items() if n > self.leaf and level < BITS]
        out = leaves_of(cells, self.leaf)
        starts = np.array([code << 2 * (BITS - level) for level, code in out], np.int64)
        order = np.argsort(starts)
        return starts[order], np.array([level for level, _ in out], np.int64)[order]

    def _counts(self, cells: list[tuple[int, int]], step: int) -> dict[tuple[int, int], int]:
        """Points in the cells ``step`` levels below each of ``cells``."""
        frame, down = self.frame, np.array([min(level + step, BITS) for level, _ in cells], np.int64)
        first = np.array([code << 2 * (BITS - level) for level, code in cells], np.int64)
        last = first + (np.int64(1) << 2 * (BITS - np.array([level for level, _ in cells], np.int64)))
        order = np.argsort(first)
        first, last, down = first[order], last[order], down[order]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = frame.codes(*_columns(batch, "x", "y"))
                at = np.searchsorted(first, codes, "right") - 1
                ok = (at >= 0) & (codes < last[np.maximum(at, 0)])
                level = down[at[ok]]
                pair = np.stack([level, codes[ok] >> 2 * (BITS - level)])
                keys, n = np.unique(pair, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(n.astype(np.int64))], ["level", "code", "n"])

        counted = self.low.select("x", "y").mapInArrow(scan, "level long, code long, n long").groupBy("level", "code").agg(F.sum("n").alias("n"))
        table = counted.toArrow()  # cells of at most LEAVES crowded ones
        return dict(zip(zip(table.column("level").to_pylist(), table.column("code").to_pylist()), table.column("n").to_pylist()))

    def _local(self) -> DataFrame:
        """(id, x, y, leaf, reach, ds, js): neighbours inside the leaf; ``reach`` is the k-th distance, NULL with fewer."""
        frame, starts, k = self.frame, self.starts, self.k

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = frame.codes(*_columns(batch, "x", "y"))
                leaf = np.searchsorted(starts, codes, "right") - 1
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "x", "y")), pa.array(leaf.astype(np.int32)), pa.array(codes)],
                                                 ["id", "x", "y", "leaf", "code"])

        def search(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("code", kind="stable")
            x, y, ids = (group[c].to_numpy() for c in ("x", "y", "id"))
            row, dist, near = nearest_in(x, y, ids, np.full(len(x), np.inf), x, y, ids, k)
            cuts = np.searchsorted(row, np.arange(1, len(x)))
            out = group[["id", "x", "y", "leaf"]].copy()
            out["ds"], out["js"] = np.split(dist, cuts), np.split(near, cuts)
            out["reach"] = [d[-1] if len(d) == k else None for d in out["ds"]]
            out["reach"] = out["reach"].astype("Float64")
            return out[["id", "x", "y", "leaf", "reach", "ds", "js"]]

        placed = self.low.select("id", "x", "y").mapInArrow(place, "id long, x double, y double, leaf int, code long")
        return placed.groupBy("leaf").applyInPandas(search, "id long, x double, y double, leaf int, reach double, ds array<double>, js array<long>")

    def _routed(self, local: DataFrame, boxes: np.ndarray, below: np.ndarray) -> DataFrame:
        """(i, xi, yi, r, to): visits of points to other leaves within their reach. ``boxes`` has the extent and the number of
        points of each leaf, ``below`` the first and last leaf of its parent."""
        k = self.k

        def bound(x: float, y: float, leaf: int) -> float:
            """Distance within which the leaves of the parent hold ``k`` points besides the point at (x, y)."""
            x0, x1, y0, y1, n = boxes[below[leaf, 0]:below[leaf, 1]].T
            far_x, far_y = np.maximum(x1 - x, x - x0), np.maximum(y1 - y, y - y0)
            far = np.sqrt(far_x * far_x + far_y * far_y)
            order = np.argsort(far)
            return far[order][np.searchsorted(np.cumsum(n[order]), k + 1)] * (1 + 1e-12)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x, y, leaf, reach = _columns(batch, "id", "x", "y", "leaf", "reach")
                reach = reach.astype(float)
                for n in np.flatnonzero(np.isnan(reach)).tolist():  # at most k points of a leaf
                    reach[n] = bound(x[n], y[n], leaf[n])
                rows, to = [], []
                order = np.lexsort((reach, leaf))
                for a in range(0, len(order), BLOCK):
                    own = order[a:a + BLOCK]
                    bx, by, br = x[own], y[own], reach[own]
                    near = np.flatnonzero((boxes[:, 0] <= bx.max() + br.max()) & (boxes[:, 1] >= bx.min() - br.max())
                                          & (boxes[:, 2] <= by.max() + br.max()) & (boxes[:, 3] >= by.min() - br.max()))
                    gap_x = np.maximum(0, np.maximum(boxes[near, 0] - bx[:, None], bx[:, None] - boxes[near, 1]))
                    gap_y = np.maximum(0, np.maximum(boxes[near, 2] - by[:, None], by[:, None] - boxes[near, 3]))
                    r, c = np.nonzero((np.sqrt(gap_x * gap_x + gap_y * gap_y) <= br[:, None]) & (near != leaf[own][:, None]))
                    rows.append(own[r])
                    to.append(near[c])
                rows, to = np.concatenate(rows), np.concatenate(to)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[rows], x[rows], y[rows], reach[rows], to.astype(np.int32))],
                                                 ["i", "xi", "yi", "r", "to"])

        return local.select("id", "x", "y", "leaf", "reach").mapInArrow(route, "i long, xi double, yi double, r double, to int")

    def _boxes(self, local: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Extent and number of points of each leaf, and the leaves below its parent."""
        table = local.groupBy("leaf").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).toArrow().to_pandas()  # a row per leaf
        out = np.full((len(self.starts), 5), np.nan)
        out[table.iloc[:, 0].to_numpy()] = table.iloc[:, 1:].to_numpy()
        up = np.maximum(self.levels - 1, 0)
        # A parent's leaves are consecutive: from its first code up to its last.
        first = (self.starts >> 2 * (BITS - up)) << 2 * (BITS - up)
        last = first + (np.int64(1) << 2 * (BITS - up))
        return out, np.stack([np.searchsorted(self.starts, first), np.searchsorted(self.starts, last)], axis=1)

    def visits(self) -> tuple[DataFrame, DataFrame]:
        """The leaves searched alone, and the visits that are left."""
        local = stored(self._local(), "leaves")
        if len(self.starts) < 2:
            return local, local.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("reach").alias("r"),
                                       F.col("leaf").alias("to")).limit(0)
        return local, self._routed(local, *self._boxes(local))

    def nearest(self) -> DataFrame:
        """(i, j, d, rank) for the ``k`` nearest other points of every point, the lower id first on ties."""
        k = self.k
        if self.n < 2:
            return self.points.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d"), F.lit(1).alias("rank")).limit(0)
        local, visits = self.visits()

        def search(_, queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            queries, own = (f.sort_values(c, kind="stable") for f, c in ((queries, ["xi", "yi"]), (own, ["x", "y"])))
            row, dist, near = nearest_in(queries["xi"].to_numpy(), queries["yi"].to_numpy(), queries["i"].to_numpy(), queries["r"].to_numpy(),
                                         own["x"].to_numpy(), own["y"].to_numpy(), own["id"].to_numpy(), k) if len(own) and len(queries) else ([], [], [])
            return pd.DataFrame({"i": queries["i"].to_numpy()[row] if len(row) else [], "j": near, "d": dist})

        found = local.select(F.col("id").alias("i"), F.inline(F.arrays_zip(F.col("js").alias("j"), F.col("ds").alias("d"))))
        if len(self.starts) > 1:
            away = visits.groupBy("to").cogroup(local.select("id", "x", "y", "leaf").groupBy("leaf")).applyInPandas(search, "i long, j long, d double")
            order = Window.partitionBy("i").orderBy("d", "j")
            ranked = found.unionByName(away).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        else:
            ranked = local.select(F.col("id").alias("i"), F.posexplode(F.arrays_zip(F.col("js").alias("j"), F.col("ds").alias("d")))).select(
                "i", "col.j", "col.d", (F.col("pos") + 1).alias("rank"))
        if self.low.count() == self.n:
            return ranked
        # Further points on a crowded spot: the k lowest ids there, none of which is their own.
        full = self.low.filter(F.col("at_") == k + 1).select("x", "y", F.col("id").alias("last"))
        more = self.points.join(full, ["x", "y"]).filter(F.col("id") > F.col("last")).select(F.col("id").alias("i"), "x", "y")
        theirs = more.join(self.low.filter(F.col("at_") <= k).select("x", "y", F.col("id").alias("j"), F.col("at_").alias("rank")), ["x", "y"])
        return ranked.unionByName(theirs.select("i", "j", F.lit(0.0).alias("d"), "rank"))
