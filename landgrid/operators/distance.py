"""Exact Euclidean distance to the nearest target cell, in time linear in the cells.

The grid is cut into tiles of rows and columns. A small aggregation finds, for every column, the nearest target above and
below each band of rows, so a tile knows the vertical distance v of each of its cells. Along a row every column c'
is a parabola v^2 + (c - c')^2, and the distance is their lower envelope, built from left to right on a stack. Tiles of
one band exchange the pieces of their envelopes that show beyond their own columns, row by row; the rest stays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgrid.config import Grid

BAND_CELLS = 1_000_000
TILE_COLS = 2_048
#: Rows whose pieces are exchanged by one task.
ROWS_TOGETHER = 64
FAR = np.iinfo(np.int64).max // 4


def _vertical(target: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Rows to the nearest target in the same column; ``above``/``below`` are distances of the
    tile's first/last row to the nearest target outside the tile."""
    n = target.shape[0]
    up = np.empty(target.shape, dtype=np.int64)
    carry = above - 1
    for i in range(n):
        carry = np.where(target[i], 0, np.minimum(carry + 1, FAR))
        up[i] = carry
    carry = below - 1
    for i in range(n - 1, -1, -1):
        carry = np.where(target[i], 0, np.minimum(carry + 1, FAR))
        up[i] = np.minimum(up[i], carry)
    return up


class Envelope:
    """Lower envelopes over columns ``low`` to ``high`` of one set of parabolas per row. ``col`` and ``square`` are matrices of
    ascending columns and squared heights, -1 where a row has no parabola. All rows advance together;
    every parabola enters and leaves its row's stack once at most."""

    def __init__(self, col: np.ndarray, square: np.ndarray, low: int, high: int):
        n, m = square.shape
        self.low, self.high, self.rows = low, high, np.arange(n)
        self.col, self.square = np.zeros((n, m + 1), np.int64), np.zeros((n, m + 1), np.int64)
        self.since = np.full((n, m + 1), low, np.int64)
        self.top = np.full(n, -1)
        if high < low:
            return
        for u in np.flatnonzero((square >= 0).any(axis=0)).tolist():
            c, g = np.broadcast_to(col[:, u], n), square[:, u]
            new = np.flatnonzero(g >= 0)
            open_ = new[self.top[new] >= 0]
            while len(open_):
                q = self.top[open_]
                x = self.since[open_, q]
                worse = (x - self.col[open_, q]) ** 2 + self.square[open_, q] >= (x - c[open_]) ** 2 + g[open_]
                open_ = open_[worse]
                self.top[open_] -= 1
                open_ = open_[self.top[open_] >= 0]
            q = self.top[new]
            fresh = q < 0
            old = np.maximum(q, 0)
            before, height = self.col[new, old], self.square[new, old]
            step = np.maximum(c[new] - before, 1)
            # First column at which the new parabola is lower than the one on top.
            start = np.where(fresh, low, (c[new] * c[new] - before * before + g[new] - height) // (2 * step) + 1)
            seen = start <= high
            new, start, q = new[seen], start[seen], q[seen] + 1
            self.top[new] = q
            self.col[new, q], self.square[new, q], self.since[new, q] = c[new], g[new], start

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Columns and squared heights of the parabolas that show, -1 beyond the last."""
        wide = int(self.top.max()) + 1 if len(self.top) else 0
        shown = np.arange(wide) <= self.top[:, None]
        return np.where(shown, self.col[:, :wide], -1), np.where(shown, self.square[:, :wide], -1)

    def squares(self) -> np.ndarray:
        """Squared distance at every column, ``FAR`` in a row without parabolas."""
        out = np.full((len(self.rows), self.high - self.low + 1), FAR, np.int64)
        at, some = self.top.copy(), self.top >= 0
        for x in range(self.high, self.low - 1, -1):
            on = np.maximum(at, 0)
            out[some, x - self.low] = ((x - self.col[self.rows, on]) ** 2 + self.square[self.rows, on])[some]
            at = np.where((at > 0) & (self.since[self.rows, on] == x), at - 1, at)
        return out


def _heights(vertical: np.ndarray, c0: int) -> tuple[np.ndarray, np.ndarray]:
    known = vertical < FAR // 2
    columns = np.broadcast_to(np.arange(c0, c0 + vertical.shape[1]), vertical.shape)
    return columns, np.where(known, np.where(known, vertical, 0) ** 2, -1)


def _beside(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts], axis=1)


def _matrix(frame: pd.DataFrame, r0: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of rows ``r0`` on, one list per row, as matrices."""
    size = frame["cols"].map(len)
    col, square = np.full((n, int(size.max()) if len(frame) else 0), -1), np.full((n, int(size.max()) if len(frame) else 0), -1)
    for r, c, g in zip(frame["at"].to_numpy(), frame["cols"], frame["squares"]):
        col[int(r) - r0, :len(c)], square[int(r) - r0, :len(g)] = c, g
    return col, square


def distance_transform(px: DataFrame, target: str, grid: Grid, by: Sequence[str] = (),
                       keep: Sequence[str] = ("cell_id",), name: str = "dist", flat_fill: float = 50_000.0,
                       band_cells: int = BAND_CELLS, tile_cols: int = TILE_COLS) -> DataFrame:
    """Distance in metres from every cell of ``px`` to the nearest cell of its group where the
    boolean ``target`` holds; a group without targets gets ``flat_fill``."""
    by, keep = list(by), list(keep)
    width = min(tile_cols, grid.ncols)
    band = max(1, band_cells // width)
    last_band, last_tile, n_cols, n_rows = (grid.nrows - 1) // band, (grid.ncols - 1) // width, grid.ncols, grid.nrows
    tile = [F.expr(f"r div {band}").alias("band"), F.expr(f"c div {width}").alias("part")]
    cells = px.select(*by, *keep, "r", "c", F.coalesce(F.col(target), F.lit(False)).alias("t"), *tile)
    hits = px.filter(F.col(target)).select(*by, "r", "c", *tile)

    # Nearest target of each column beyond each band, also where the band has no cell in that column.
    ends = hits.groupBy(*by, "c", "band").agg(F.max("r").alias("last_r"), F.min("r").alias("first_r"))
    bands = hits.select(*by, "c").distinct().withColumn("band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last_band).cast("bigint"))))
    column = Window.partitionBy(*by, "c").orderBy("band")
    known = bands.join(ends, [*by, "c", "band"], "left").select(
        *by, "band", "c", F.max("last_r").over(column.rowsBetween(Window.unboundedPreceding, -1)).alias("above_r"),
        F.min("first_r").over(column.rowsBetween(1, Window.unboundedFollowing)).alias("below_r"))
    none = F.lit(None).cast("array<bigint>")
    # Fresh names: both sides of a co-group must not share attributes.
    edge = known.select(*[F.col(k).alias(f"edge_{k}") for k in (*by, "band")], F.expr(f"c div {width}").alias("edge_part"),
                        F.lit("column").alias("kind"), F.col("c").cast("bigint").alias("at"), "above_r", "below_r",
                        none.alias("cols"), none.alias("squares"))
    group = [*by, "band", "part"]
    edge_group = [f"edge_{k}" for k in group]
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*group).schema.fields)

    def heights(r: np.ndarray, c: np.ndarray, side: pd.DataFrame, r0: int, n: int, c0: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Parabolas of a tile's own columns."""
        hit = np.zeros((n, m), dtype=bool)
        hit[r - r0, c - c0] = True
        above, below = np.full(m, FAR, dtype=np.int64), np.full(m, FAR, dtype=np.int64)
        up, down = side[side["above_r"].notna()], side[side["below_r"].notna()]
        above[up["at"].to_numpy() - c0] = r0 - up["above_r"].to_numpy(dtype=np.int64)
        below[down["at"].to_numpy() - c0] = down["below_r"].to_numpy(dtype=np.int64) - (r0 + n - 1)
        return _heights(_vertical(hit, above, below), c0)

    def place(key: tuple) -> tuple[int, int, int, int]:
        r0, c0 = int(key[-2]) * band, int(key[-1]) * width
        return r0, min(band, n_rows - r0), c0, min(width, n_cols - c0)

    if last_tile:
        piece = f"{keys}, r bigint, cols array<bigint>, squares array<bigint>"

        def show(key: tuple, own: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
            """Pieces of a tile that show left of it and right of it."""
            r0, n, c0, m = place(key)
            own_cols = heights(own["r"].to_numpy(), own["c"].to_numpy(), side, r0, n, c0, m)
            out = []
            left, right = Envelope(*own_cols, 0, c0 - 1).pieces(), Envelope(*own_cols, c0 + m, n_cols - 1).pieces()
            for i in range(n):
                a, b = (dict(zip(p[0][i][p[1][i] >= 0].tolist(), p[1][i][p[1][i] >= 0].tolist())) for p in (left, right))
                both = sorted((a | b).items())
                if both:
                    out.append((*key, r0 + i, [c for c, _ in both], [g for _, g in both]))
            return pd.DataFrame(out, columns=[*group, "r", "cols", "squares"])

        shown = hits.groupBy(*group).cogroup(edge.groupBy(*edge_group)).applyInPandas(show, piece)

        def exchange(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            """For every tile of a row the pieces of the others that show inside it."""
            r0 = int(frame["at"].min())
            n = int(frame["at"].max()) - r0 + 1
            parts = {int(p): _matrix(f, r0, n) for p, f in frame.groupby("part")}
            found: dict[int, list] = {p: [] for p in range(last_tile + 1)}
            empty = np.full((n, 0), -1), np.full((n, 0), -1)
            for order in (range(last_tile + 1), range(last_tile, -1, -1)):
                carried, rightward = empty, order.step > 0
                for p in order:
                    c0, c1 = p * width, min((p + 1) * width, n_cols) - 1
                    found[p].append(Envelope(*carried, c0, c1).pieces())
                    both = (carried, parts.get(p, empty)) if rightward else (parts.get(p, empty), carried)
                    carried = Envelope(*_beside(*both), *((c1 + 1, n_cols - 1) if rightward else (0, c0 - 1))).pieces()
            out = []
            for p, (left, right) in found.items():
                col, square = _beside(left, right)
                for i in np.flatnonzero((square >= 0).any(axis=1)).tolist():
                    ok = square[i] >= 0
                    out.append((*key[:-1], p, r0 + i, col[i][ok].tolist(), square[i][ok].tolist()))
            return pd.DataFrame(out, columns=[*group, "r", "cols", "squares"])

        rows = [*by, "band", F.expr(f"r div {ROWS_TOGETHER}").alias("rows_")]
        away = shown.withColumn("at", F.col("r")).groupBy(*rows).applyInPandas(exchange, piece)
        edge = edge.unionByName(away.select(*[F.col(k).alias(f"edge_{k}") for k in group], F.lit("row").alias("kind"), F.col("r").alias("at"),
                                            F.lit(None).cast("bigint").alias("above_r"), F.lit(None).cast("bigint").alias("below_r"),
                                            "cols", "squares"))

    res = float(grid.res)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in px.select(
        *by, *keep, "r", "c").schema.fields] + [f"{name} double"])

    def finish(key: tuple, own: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=[*by, *keep, "r", "c", name])
        r0, n, c0, m = place(key)
        hit = own["t"].to_numpy(dtype=bool)
        r, c = own["r"].to_numpy(), own["c"].to_numpy()
        own_cols = heights(r[hit], c[hit], side[side["kind"] == "column"], r0, n, c0, m)
        col, square = _matrix(side[side["kind"] == "row"], r0, n)
        left, right = np.where(col < c0, square, -1), np.where(col >= c0 + m, square, -1)
        best = Envelope(*_beside((col, left), own_cols, (col, right)), c0, c0 + m - 1).squares()[r - r0, c - c0]
        dist = np.where(best >= FAR, flat_fill, np.sqrt(best.astype(np.float64)) * res)
        return own[[*by, *keep, "r", "c"]].assign(**{name: dist})

    return (cells.groupBy(*group).cogroup(edge.groupBy(*edge_group))
            .applyInPandas(finish, schema=schema))
