"""Moving values between grids. A source cell computes which target cells it serves, so
no template table is joined and nothing is shuffled for nearest, once for bilinear."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.config import Geometry, Grid
from landgrid.functions import geo


def _served(lo: Column, hi: Column, origin: float, res: float, n: int) -> Column:
    """Target indices whose centre lies in [lo, hi), clipped to the target extent."""
    first = F.greatest(F.ceil((lo - origin) / res - 0.5).cast("bigint"), F.lit(0).cast("bigint"))
    last = F.least(F.ceil((hi - origin) / res - 0.5).cast("bigint") - 1,
                   F.lit(n - 1).cast("bigint"))
    return F.when(first <= last, F.sequence(first, last))


def resample_nearest(px: DataFrame, src: Grid, dst: Grid, values: Sequence[str],
                     by: Sequence[str] = ()) -> DataFrame:
    """Value of the source cell that holds each target centre."""
    left = F.col("c") * src.res + src.x0
    low = F.col("r") * src.res + src.y0
    rows = px.select(*by, *values,
                     _served(low, low + src.res, dst.y0, dst.res, dst.nrows).alias("rr"),
                     _served(left, left + src.res, dst.x0, dst.res, dst.ncols).alias("cc"))
    rows = rows.select(*by, *values, "cc", F.explode("rr").alias("r"))
    return rows.select(*by, "r", F.explode("cc").alias("c"), *values)


def resample_bilinear(px: DataFrame, src: Grid, dst: Grid, values: Sequence[str],
                      by: Sequence[str] = ()) -> DataFrame:
    """Mean of the four source centres around each target centre, weighted by nearness; the
    weights of missing neighbours are dropped and the rest renormalised."""
    if src == dst:
        return px.select(*by, "r", "c", *values)
    x, y = geo.cell_x(F.col("c"), src), geo.cell_y(F.col("r"), src)
    # A source centre matters to the target centres closer than one source cell.
    rows = px.select(*by, *values, x.alias("sx"), y.alias("sy"),
                     _served(y - src.res, y + src.res, dst.y0, dst.res, dst.nrows).alias("rr"),
                     _served(x - src.res, x + src.res, dst.x0, dst.res, dst.ncols).alias("cc"))
    rows = rows.select(*by, *values, "sx", "sy", "cc", F.explode("rr").alias("r"))
    rows = rows.select(*by, *values, "sx", "sy", "r", F.explode("cc").alias("c"))
    wx = 1.0 - F.abs(geo.cell_x(F.col("c"), dst) - F.col("sx")) / src.res
    wy = 1.0 - F.abs(geo.cell_y(F.col("r"), dst) - F.col("sy")) / src.res
    w = F.greatest(wx, F.lit(0.0)) * F.greatest(wy, F.lit(0.0))
    # A centre one whole cell away has no weight: without any nearer one there is no target cell.
    sums = rows.withColumn("w", w).filter("w > 0").groupBy(*by, "r", "c").agg(
        *[e for v in values for e in (
            F.sum(F.col("w") * F.col(v)).alias(f"s_{v}"),
            F.sum(F.when(F.col(v).isNotNull(), F.col("w"))).alias(f"w_{v}"))])
    return sums.select(*by, "r", "c", *[F.when(F.col(f"w_{v}") > 0, F.col(f"s_{v}") / F.col(f"w_{v}"))
                                        .alias(v) for v in values])


def align(px: DataFrame, src: Geometry, dst: Geometry, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Values on the target geometry: as they are where the two are the same, else bilinear. Degrees (``EPSG:4326``) are
    brought to a projected target through the positions of the target's cells."""
    if src.same(dst):
        return px.select(*by, "r", "c", *values)
    if src.crs == dst.crs:
        return resample_bilinear(px, src.grid, dst.grid, values, by)
    zone = re.fullmatch(r"UTM(\d+)([NS])", dst.crs)
    if src.crs != "EPSG:4326" or zone is None:
        raise ValueError(f"no way from {src.crs} to {dst.crs}")
    return _from_degrees(px, src.grid, dst.grid, values, by, int(zone[1]), zone[2] == "S")


def _from_degrees(px: DataFrame, src: Grid, dst: Grid, values: Sequence[str], by: Sequence[str], zone: int, south: bool) -> DataFrame:
    """Every target cell asks for the four source centres around its own; those that are missing lose their weight."""
    spark = px.sparkSession
    cells = spark.range(dst.nrows * dst.ncols).select(F.expr(f"id div {dst.ncols}").alias("r"), F.expr(f"id % {dst.ncols}").alias("c"))
    placed = geo.from_utm(cells.withColumns({"x": geo.cell_x(F.col("c"), dst), "y": geo.cell_y(F.col("r"), dst)}), "x", "y", "lon", "lat", zone, south)
    u, v = (F.col("lon") - src.x0) / src.res - 0.5, (F.col("lat") - src.y0) / src.res - 0.5
    corners = placed.select("r", "c", u.alias("u"), v.alias("v"), F.inline(F.array(*[
        F.struct((F.floor(v) + dr).cast("bigint").alias("sr"), (F.floor(u) + dc).cast("bigint").alias("sc")) for dr in (0, 1) for dc in (0, 1)])))
    weight = (1.0 - F.abs(F.col("u") - F.col("sc"))) * (1.0 - F.abs(F.col("v") - F.col("sr")))
    asked = corners.select("r", "c", "sr", "sc", weight.alias("w")).filter("w > 0")
    source = px.select(*by, F.col("r").alias("sr"), F.col("c").alias("sc"), *values)
    sums = source.join(asked, ["sr", "sc"]).groupBy(*by, "r", "c").agg(*[e for x in values for e in (
        F.sum(F.col("w") * F.col(x)).alias(f"s_{x}"), F.sum(F.when(F.col(x).isNotNull(), F.col("w"))).alias(f"w_{x}"))])
    return sums.select(*by, "r", "c", *[F.when(F.col(f"w_{x}") > 0, F.col(f"s_{x}") / F.col(f"w_{x}")).alias(x) for x in values])
