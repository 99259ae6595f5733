"""The predictor stack of urban growth on a coarse working grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.config import Grid
from landgrid.functions import classes as C
from landgrid.functions import geo
from landgrid.operators import change, distance, focal, resample, vectors
from landgrid.session import cut_lineage

PREDICTORS = ("dist_roads", "dist_centre", "dist_urban", "pop_density", "elevation", "slope",
              "ndvi_loss")


def coarse_grid(grid: Grid, factor: int) -> Grid:
    return Grid(res=grid.res * factor, nrows=-(-grid.nrows // factor),
                ncols=-(-grid.ncols // factor), x0=grid.x0, y0=grid.y0)


def stack_layers(template: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Layers to one wide row per template cell: a union and one aggregation instead of a
    chain of joins."""
    tagged = [template.select("r", "c", F.lit(True).alias("in_"))]
    tagged += [df.select("r", "c", F.col(name)) for name, df in layers.items()]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    wide = union.groupBy("r", "c").agg(F.max("in_").alias("in_"),
                                       *[F.max(n).alias(n) for n in layers])
    return wide.filter("in_").drop("in_")


def driver_stack(lulc: DataFrame, y0: int, y1: int, grid: Grid, factor: int,
                 centre: tuple[float, float], roads: DataFrame | None = None,
                 ndvi: DataFrame | None = None, population: DataFrame | None = None,
                 dem: DataFrame | None = None, flat_fill: float = 50_000.0) -> DataFrame:
    """Growth flag and predictors per coarse cell. Layers whose input is missing are left out."""
    coarse = coarse_grid(grid, factor)
    # Coarse layers are small beside the class maps: each is computed once and written.
    template = cut_lineage(lulc.select(F.expr(f"r div {factor}").alias("r"),
                                       F.expr(f"c div {factor}").alias("c")).distinct())
    near = cut_lineage(resample.resample_nearest(lulc.filter(F.col("yr").isin(y0, y1)), grid,
                                                 coarse, ["cls"], ["yr"]))
    wide = change.spread_years(near, ["cls"], [y0, y1], ["r", "c"])
    both = F.col(f"has_{y0}") & F.col(f"has_{y1}")
    growth = wide.filter(both).select("r", "c", C.became(F.col(f"cls_{y0}"), F.col(f"cls_{y1}"))
                                      .alias("growth"))
    layers = {"growth": growth}

    def distance_to(hits: DataFrame, name: str) -> DataFrame:
        cells = stack_layers(template, {"hit": hits.select("r", "c", F.lit(True).alias("hit"))})
        return cut_lineage(distance.distance_transform(cells, "hit", coarse, keep=(), name=name,
                                                       flat_fill=flat_fill))

    if roads is not None:
        layers["dist_roads"] = distance_to(vectors.rasterize_lines(roads, coarse), "dist_roads")
    x, y = geo.cell_x(F.col("c"), coarse), geo.cell_y(F.col("r"), coarse)
    layers["dist_centre"] = template.select(
        "r", "c", geo.dist_to_point(x, y, *centre).alias("dist_centre"))
    layers["dist_urban"] = distance_to(near.filter((F.col("yr") == y0) & (F.col("cls") == 1)),
                                       "dist_urban")
    if population is not None:
        pop = resample.resample_bilinear(population, grid, coarse, ["pop"])
        layers["pop_density"] = pop.select("r", "c",
                                           (F.col("pop") / coarse.cell_km2).alias("pop_density"))
    if dem is not None:
        elev = cut_lineage(resample.resample_bilinear(dem, grid, coarse, ["elev"]))
        layers["elevation"] = elev.select("r", "c", F.col("elev").alias("elevation"))
        numbered = elev.withColumn("cell_id", F.col("r") * coarse.ncols + F.col("c"))
        layers["slope"] = focal.slope_degrees(numbered, coarse.res)
    if ndvi is not None:
        two = cut_lineage(resample.resample_bilinear(ndvi.filter(F.col("yr").isin(y0, y1)), grid,
                                                     coarse, ["ndvi"], ["yr"]))
        layers["ndvi_loss"] = change.ndvi_loss(two, y0, y1, ["r", "c"])
    stack = stack_layers(template, layers)
    return stack.select((F.col("r") * coarse.ncols + F.col("c")).alias("cell_id"), "r", "c",
                        x.alias("x"), y.alias("y"), *layers)
