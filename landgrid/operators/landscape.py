"""Landscape metrics of one class per year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.operators.components import TILE, connected_components
from landgrid.operators.focal import forward_pairs


def adjacency(lulc: DataFrame, cls: int = 1) -> DataFrame:
    """Per year: cells of the class and of the landscape, class-class and class-other borders
    between direct neighbours. Borders with NULL or outside the raster do not count."""
    v, one = F.col("cls"), F.lit(cls)
    like, edge = F.lit(0), F.lit(0)
    for other in (F.col("right"), F.col("below")):
        known = v.isNotNull() & other.isNotNull()
        like = like + F.when(known & (v == one) & (other == one), 1).otherwise(0)
        edge = edge + F.when(known & ((v == one) != (other == one)), 1).otherwise(0)
    return forward_pairs(lulc).groupBy("yr").agg(
        F.count(F.when(v == one, 1)).alias("class_cells"), F.count(v).alias("cells"),
        F.sum(like).alias("like_pairs"), F.sum(edge).alias("edges"))


def patch_stats(lulc: DataFrame, cls: int = 1, tile: int = TILE) -> DataFrame:
    """Per year: number of patches (8 neighbours), cells in the largest, mean cells."""
    patches = connected_components(lulc.filter(F.col("cls") == cls), 8, tile=tile)
    sizes = patches.groupBy("yr", "component").agg(F.count(F.lit(1)).alias("k"))
    return sizes.groupBy("yr").agg(F.count(F.lit(1)).alias("patches"), F.max("k").alias("largest"),
                                   F.avg("k").alias("mean_cells"))


def _landscape_cells(lulc: DataFrame) -> DataFrame:
    return lulc.groupBy("yr").agg(F.count("cls").alias("cells"))


def with_patch_metrics(stats: DataFrame, res: float) -> DataFrame:
    area = F.col("cells") * (res * res)
    return stats.withColumns({
        "PD": F.col("patches") * 1e6 / area,
        "LPI": F.col("largest") / F.col("cells") * 100.0,
        "MPA": F.col("mean_cells") * (res * res / 1e4)})


def patch_metrics(lulc: DataFrame, res: float, cls: int = 1, tile: int = TILE) -> DataFrame:
    """PD, LPI and MPA per year; NULL where the class is absent."""
    return with_patch_metrics(
        _landscape_cells(lulc).join(patch_stats(lulc, cls, tile), "yr", "left"), res)


def with_border_metrics(adj: DataFrame, res: float) -> DataFrame:
    """ED in m/ha and the aggregation index: like borders as a share of the largest possible
    number for as many cells (He et al. 2000)."""
    a = F.col("class_cells")
    root = F.floor(F.sqrt(a)).cast("bigint")
    m = a - root * root
    most = 2 * root * (root - 1) + F.when(m == 0, 0).when(m <= root, 2 * m - 1).otherwise(2 * m - 2)
    present = a > 0
    return adj.withColumns({
        "ED": F.when(present, F.col("edges") * res * 1e4 / (F.col("cells") * (res * res))),
        "AI": F.when(present & (most > 0), F.col("like_pairs") / most * 100.0)})


def border_metrics(lulc: DataFrame, res: float, cls: int = 1) -> DataFrame:
    return with_border_metrics(adjacency(lulc, cls), res)


def landscape_metrics(lulc: DataFrame, res: float, cls: int = 1, tile: int = TILE) -> DataFrame:
    """year, PD, LPI, ED, AI, MPA."""
    borders = border_metrics(lulc, res, cls)
    both = with_patch_metrics(borders.join(patch_stats(lulc, cls, tile), "yr", "left"), res)
    return both.select(F.col("yr").alias("year"), "PD", "LPI", "ED", "AI", "MPA")
