"""Neighbourhood operators on tiles with a halo.

An exchange step of its own deals the cells by tile and copies those at a tile's rim to the tiles beside it, which is about
one row in sixteen. Inside a tile each cell then sends its contribution to the cells around it and one aggregation
collects them; it is grouped by tile first, so Spark needs no further shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.config import CLASSES
from landgrid.functions import classes as C

SQUARE = tuple((dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1))


HALO_TILE = 64
TILE = ("tile_r", "tile_c")


def with_halo(df: DataFrame, offsets: Sequence[tuple[int, int]], by: Sequence[str], tile: int = HALO_TILE) -> DataFrame:
    """``df`` dealt by ``tile_r, tile_c``: every row goes to its own tile and to those that one of its ``offsets`` reaches."""
    def reached(axis: str, steps: Sequence[int]) -> Column:
        return F.sequence(F.expr(f"({axis} + {min(steps)}) div {tile}"), F.expr(f"({axis} + {max(steps)}) div {tile}"))

    rows = df.withColumn("tile_r", F.explode(reached("r", [dr for dr, _ in offsets])))
    rows = rows.withColumn("tile_c", F.explode(reached("c", [dc for _, dc in offsets])))
    return rows.repartition(*by, *TILE)


def push(df: DataFrame, offsets: Sequence[tuple[int, int]], by: Sequence[str],
         carry: Mapping[str, Column], tile: int = HALO_TILE) -> DataFrame:
    """Copy ``carry`` to the cells at ``offsets``; ``dr, dc`` tell where the copy went. To be grouped by
    ``(*by, *TILE, r, c)``, which needs no shuffle."""
    targets = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"))
                        for dr, dc in offsets])
    narrow = df.select(*by, "r", "c", *[e.alias(n) for n, e in carry.items()])
    sent = with_halo(narrow, offsets, by, tile).select("*", F.inline(targets))
    moved = sent.withColumns({"r": F.col("r") + F.col("dr"), "c": F.col("c") + F.col("dc")})
    return moved.filter(F.expr(f"r div {tile} = tile_r AND c div {tile} = tile_c"))


def focal_majority(lulc: DataFrame, by: Sequence[str] = ("yr",),
                   classes: Sequence[int] = CLASSES, value: str = "cls") -> DataFrame:
    """3 x 3 majority with the centre included, NULLs dropped, the lowest class on ties."""
    sent = push(lulc, SQUARE, by, {"v": F.col(value), "id": F.col("cell_id")})
    own = (F.col("dr") == 0) & (F.col("dc") == 0)
    counts = sent.groupBy(*by, *TILE, "r", "c").agg(
        F.max(F.when(own, F.col("id"))).alias("cell_id"),
        *[F.count(F.when(F.col("v") == k, 1)).alias(f"n{k}") for k in classes],
    ).filter(F.col("cell_id").isNotNull())
    return counts.select("cell_id", "r", "c", *by,
                         C.argmax_class({k: F.col(f"n{k}") for k in classes}).alias(value))


def slope_degrees(dem: DataFrame, res: float, by: Sequence[str] = ()) -> DataFrame:
    """Slope from the eight neighbours (Horn 1981); NULL unless all of them are known."""
    sent = push(dem, SQUARE, by, {"z": F.col("elev"), "id": F.col("cell_id")})
    own = (F.col("dr") == 0) & (F.col("dc") == 0)
    # A copy sent by (dr, dc) came from the neighbour at (-dr, -dc).
    wx = -F.col("dc") * (2 - F.abs(F.col("dr")))
    wy = -F.col("dr") * (2 - F.abs(F.col("dc")))
    g = sent.groupBy(*by, *TILE, "r", "c").agg(
        F.max(F.when(own, F.col("id"))).alias("cell_id"),
        F.count("z").alias("n"),
        (F.sum(F.col("z") * wx) / (8.0 * res)).alias("gx"),
        (F.sum(F.col("z") * wy) / (8.0 * res)).alias("gy"),
    ).filter(F.col("cell_id").isNotNull())
    slope = F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))
    return g.select("cell_id", "r", "c", *by, F.when(F.col("n") == 9, slope).alias("slope"))


def aggregate_modal(lulc: DataFrame, factor: int, by: Sequence[str] = ("yr",),
                    classes: Sequence[int] = CLASSES, value: str = "cls") -> DataFrame:
    """Block majority: coarse cells of ``factor`` by ``factor``, the lowest class on ties."""
    block = lulc.groupBy(*by, F.expr(f"r div {factor}").alias("r"),
                         F.expr(f"c div {factor}").alias("c"))
    counts = block.agg(*[F.count(F.when(F.col(value) == k, 1)).alias(f"n{k}") for k in classes])
    return counts.select(*by, "r", "c",
                         C.argmax_class({k: F.col(f"n{k}") for k in classes}).alias(value))


def coarsen_factor(res: float, factor: int | None = None, target_res: float | None = None) -> int:
    if target_res:
        return max(1, round(target_res / res))
    return max(1, int(factor or 1))


def forward_pairs(lulc: DataFrame, by: Sequence[str] = ("yr",), value: str = "cls") -> DataFrame:
    """Each cell with the class to its right and below it (NULL where there is none)."""
    sent = push(lulc, ((0, 0), (0, -1), (-1, 0)), by, {"v": F.col(value)})
    pick = lambda dr, dc: F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc),
                                       F.col("v")))
    found = sent.groupBy(*by, *TILE, "r", "c").agg(pick(0, 0).alias(value), pick(0, -1).alias("right"),
                                                   pick(-1, 0).alias("below"))
    return found.drop(*TILE)
