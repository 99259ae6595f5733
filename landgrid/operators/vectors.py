"""Points and lines against the grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgrid.config import Grid
from landgrid.functions import geo
from landgrid.session import join_bounded


def rasterize_lines(segments: DataFrame, grid: Grid) -> DataFrame:
    """Cells touched by straight segments. In each column slab a segment covers one interval
    of y, so the cells follow from two sequences and no cell is joined with a segment."""
    limit_x = grid.x0 + grid.ncols * grid.res
    swap = F.col("x1") > F.col("x2")
    s = segments.select(
        F.when(swap, F.col("x2")).otherwise(F.col("x1")).alias("xa"),
        F.when(swap, F.col("y2")).otherwise(F.col("y1")).alias("ya"),
        F.when(swap, F.col("x1")).otherwise(F.col("x2")).alias("xb"),
        F.when(swap, F.col("y1")).otherwise(F.col("y2")).alias("yb"),
    ).filter((F.col("xb") >= grid.x0) & (F.col("xa") < limit_x))
    first = F.greatest(geo.col_of(F.col("xa"), grid), F.lit(0).cast("bigint"))
    last = F.least(geo.col_of(F.col("xb"), grid), F.lit(grid.ncols - 1).cast("bigint"))
    s = s.select("*", F.explode(F.sequence(first, last)).alias("c"))
    left = F.lit(grid.x0) + F.col("c") * grid.res
    run = F.col("xb") - F.col("xa")
    at = lambda x: F.col("ya") + (F.col("yb") - F.col("ya")) * (x - F.col("xa")) / run
    y_in = F.when(run == 0, F.col("ya")).otherwise(at(F.greatest(left, F.col("xa"))))
    y_out = F.when(run == 0, F.col("yb")).otherwise(at(F.least(left + grid.res, F.col("xb"))))
    low = F.greatest(geo.row_of(F.least(y_in, y_out), grid), F.lit(0).cast("bigint"))
    high = F.least(geo.row_of(F.greatest(y_in, y_out), grid), F.lit(grid.nrows - 1).cast("bigint"))
    rows = s.select("c", low.alias("lo"), high.alias("hi")).filter("lo <= hi")
    return rows.select(F.explode(F.sequence("lo", "hi")).alias("r"), "c").distinct()


def points_to_cells(points: DataFrame, grid: Grid, value: str, name: str) -> DataFrame:
    """Mean of the point values in each cell."""
    return points.groupBy(geo.row_of(F.col("y"), grid).alias("r"),
                          geo.col_of(F.col("x"), grid).alias("c")).agg(F.avg(value).alias(name))


def points_on_surface(vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x, y): a point inside each polygon. ``vertices`` has the keys and part, ring, seq, x, y; rings need not be closed,
    holes are further rings of a part.

    Each part is cut at half height between two of its vertices, where the crossings with its edges bound intervals that
    lie inside by turns; the middle of the widest one is taken, the lowest part and the left one on ties. A polygon
    without area gives its first vertex."""
    keys = list(keys)
    part = Window.partitionBy(*keys, "part")
    ring = Window.partitionBy(*keys, "part", "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    middle = (F.min("y").over(part) + F.max("y").over(part)) / 2
    edges = vertices.select(*keys, "part", "ring", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), middle.alias("mid"),
                            F.coalesce(F.lead("x").over(ring), F.first("x").over(whole)).alias("x2"),
                            F.coalesce(F.lead("y").over(ring), F.first("y").over(whole)).alias("y2"))
    below, above = F.max(F.when(F.col("y1") <= F.col("mid"), F.col("y1"))), F.min(F.when(F.col("y1") > F.col("mid"), F.col("y1")))
    edges = edges.withColumn("at", (below.over(part) + above.over(part)) / 2)
    y1, y2, at = F.col("y1"), F.col("y2"), F.col("at")
    crossing = F.when((y1 <= at) != (y2 <= at), F.col("x1") + (at - y1) / (y2 - y1) * (F.col("x2") - F.col("x1")))
    cut = edges.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(crossing)).alias("xs"), F.max("at").alias("at"),
                                           F.min(F.struct("ring", "seq", "x1", "y1")).alias("corner"))
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1, F.lit(1)), lambda i: F.struct(
        (F.col("xs")[i * 2 + 1] - F.col("xs")[i * 2]).alias("width"), (-F.col("part")).cast("double").alias("part"),
        (-F.col("xs")[i * 2]).alias("left"), ((F.col("xs")[i * 2] + F.col("xs")[i * 2 + 1]) / 2).alias("x"), F.col("at").alias("y")))
    flat = F.array(F.struct(F.lit(-1.0).alias("width"), (-F.col("part")).cast("double").alias("part"), F.lit(0.0).alias("left"),
                            F.col("corner.x1").cast("double").alias("x"), F.col("corner.y1").cast("double").alias("y")))
    widest = cut.withColumn("best", F.array_max(F.when(F.size("xs") >= 2, spans).otherwise(flat)))
    best = widest.groupBy(*keys).agg(F.array_max(F.collect_list("best")).alias("b"))
    return best.select(*keys, "b.x", "b.y")


def extract_at_points(px: DataFrame, points: DataFrame, grid: Grid, layers: Sequence[str],
                      how: str = "left", degrees: tuple[int, bool] | None = None) -> DataFrame:
    """All layers at the cell of each point; a point whose class is missing or outside 1..4 is an error in
    the source data and stops the job. ``degrees`` (UTM zone of the grid, south) tells that x and y are longitude and
    latitude; they are projected before they are looked up and returned as they came."""
    if "class" in points.columns:
        wrong = F.raise_error(F.concat(F.lit("class outside 1..4: "), F.coalesce(F.col("class").cast("string"), F.lit("null"))))
        fine = F.coalesce(F.col("class").between(1, 4), F.lit(False))
        points = points.withColumn("class", F.when(fine, F.col("class")).otherwise(wrong.cast(points.schema["class"].dataType)))
    x, y = "x", "y"
    if degrees is not None:
        points, x, y = geo.to_utm(points, "x", "y", "east_", "north_", *degrees), "east_", "north_"
    located = points.withColumns({"r": geo.row_of(F.col(y), grid),
                                  "c": geo.col_of(F.col(x), grid)}).drop("east_", "north_")
    # The pixels are filtered where they are: only cells with a point reach a shuffle.
    wanted = located.select("r", "c").distinct()
    hits = join_bounded(px.select("r", "c", *layers), wanted, ["r", "c"], "left_semi")
    return located.join(hits, ["r", "c"], how)
