"""Queries on grid geometry, neighbourhoods and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgrid.config import Grid, Sprawl
from landgrid.functions import bands as B
from landgrid.functions import geo
from landgrid.functions.classes import became
from landgrid.operators import change, components, distance, focal, landscape, patches, pixels
from landgrid.operators import resample, vectors, zones
from landgrid.plans.common import keep, register
from landgrid.sources import testbed

QUERIES = {}
query = register(QUERIES)
SPRAWL = Sprawl(centre_xy=testbed.CENTRE)
RES = testbed.RES


def patch_pairs(spark, sf):
    """Two-date channel stack with the change flag, per transition."""
    pairs = change.transition_values(testbed.channels(spark, sf), [*B.FEATURES, "cls"],
                                     testbed.TRANSITIONS)
    return pairs.withColumn("change", became(F.col("pre_cls"), F.col("post_cls")))


def patch_labels(spark, sf):
    """Labelled complete windows with their block."""
    st = testbed.study(spark, sf)
    p = patches.patch_summaries(patch_pairs(spark, sf), B.FEATURES, st.change,
                                st.change.stride_train, ["transition_id"], statistics=False)
    return p.withColumn("block", patches.block_id(st.grid, st.change)), st


@query("project_utm")
def project_utm(spark, sf):
    """Cell positions to UTM zone 37 south and back."""
    lon, lat = 36.6 + F.col("c") / 100.0, -1.5 + (F.col("r") % 40) / 100.0
    cells = testbed.lulc(spark, sf).select("cell_id", "r", "c").distinct()
    start = cells.select("cell_id", lon.alias("lon0"), lat.alias("lat0"))
    there = geo.to_utm(start, "lon0", "lat0", "x", "y", 37, True)
    back = geo.from_utm(there, "x", "y", "lon", "lat", 37, True)
    return back.select("cell_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"),
                       F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("cell_xy")
def cell_xy(spark, sf):
    return pixels.cell_xy(testbed.lulc(spark, sf), testbed.grid(spark, sf)).select(
        "cell_id", "yr", "x", "y")


@query("resample_bilinear")
def resample_bilinear(spark, sf):
    """Elevation and population to a finer, shifted grid."""
    src = testbed.grid(spark, sf)
    dst = Grid(res=800.0, nrows=int(src.nrows * 1.25), ncols=int(src.ncols * 1.25), x0=150.0, y0=-100.0)
    fine = resample.resample_bilinear(testbed.land_cover(spark, sf), src, dst, ["elev", "pop"])
    return keep(fine, ["r", "c"], ["elev", "pop"])


@query("resample_nearest")
def resample_nearest(spark, sf):
    src = testbed.grid(spark, sf)
    dst = Grid(res=700.0, nrows=int(src.nrows / 0.7), ncols=int(src.ncols / 0.7))
    return resample.resample_nearest(testbed.lulc(spark, sf), src, dst, ["cls"], ["yr"])


@query("aggregate_modal")
def aggregate_modal(spark, sf):
    return focal.aggregate_modal(testbed.lulc(spark, sf), 8)


@query("focal_majority")
def focal_majority(spark, sf):
    return focal.focal_majority(testbed.lulc(spark, sf)).select("cell_id", "yr", "cls")


@query("slope_deg")
def slope_deg(spark, sf):
    return keep(focal.slope_degrees(testbed.land_cover(spark, sf), RES), ["cell_id"], ["slope"])


@query("distance_transform")
def distance_transform(spark, sf):
    cells = testbed.lulc(spark, sf).withColumn("target", F.col("cls") == 1)
    out = distance.distance_transform(cells, "target", testbed.grid(spark, sf), ["yr"])
    return keep(out, ["cell_id", "yr"], ["dist"])


@query("rasterize_lines")
def rasterize_lines(spark, sf):
    return vectors.rasterize_lines(testbed.roads(spark, sf), testbed.grid(spark, sf))


@query("rasterize_zone_field")
def rasterize_zone_field(spark, sf):
    grid = testbed.grid(spark, sf)
    zoned = zones.with_ring(testbed.lulc(spark, sf), grid, SPRAWL)
    counts = zones.zone_counts(zoned, testbed.YEARS)
    painted = zones.paint(zoned, zones.zone_shares(counts), ["yr", "zone_id"], ["pi"])
    return keep(painted, ["cell_id", "yr"], ["pi"])


@query("rasterize_points_mean")
def rasterize_points_mean(spark, sf):
    """Line ends as points with their length as value."""
    ends = testbed.roads(spark, sf).select(F.inline(F.array(
        F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("y2") - F.col("y1")).alias("v")),
        F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), (F.col("x2") - F.col("x1")).alias("v")))))
    return keep(vectors.points_to_cells(ends, testbed.grid(spark, sf), "v", "mean_v"), ["r", "c"], ["mean_v"])


@query("extract_at_points")
def extract_at_points(spark, sf):
    """Layers of the last year at the line starts; some starts lie outside the raster."""
    points = testbed.roads(spark, sf).select("seg_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    layers = pixels.feature_stack(testbed.px(spark, sf)).filter(F.col("yr") == 2001)
    out = vectors.extract_at_points(layers, points, testbed.grid(spark, sf), ["cell_id", "ndvi", "b08"])
    return keep(out, ["seg_id", "cell_id"], ["ndvi", "b08"])


@query("extract_at_polygons")
def extract_at_polygons(spark, sf):
    """Layers of the last year inside U-shaped polygons at the line starts, the mean position of which lies outside them."""
    notch = 1000 + 500 * (1 + F.col("seg_id") % 3)
    corners = [(0, 0), (3000, 0), (3000, 3000), (notch, 3000), (notch, 1000), (1000, 1000), (1000, 3000), (0, 3000)]
    vertices = testbed.roads(spark, sf).select("seg_id", F.lit(0).alias("part"), F.lit(0).alias("ring"), F.posexplode(F.array(*[
        F.struct((F.col("x1") + dx).cast("double").alias("x"), (F.col("y1") + dy).cast("double").alias("y")) for dx, dy in corners])).alias("seq", "v"))
    points = vectors.points_on_surface(vertices.select("seg_id", "part", "ring", "seq", "v.x", "v.y"), ["seg_id"])
    layers = pixels.feature_stack(testbed.px(spark, sf)).filter(F.col("yr") == 2001)
    out = vectors.extract_at_points(layers, points, testbed.grid(spark, sf), ["cell_id", "ndvi"])
    return keep(out, ["seg_id", "cell_id"], ["x", "y", "ndvi"])


@query("extract_at_degrees")
def extract_at_degrees(spark, sf):
    """Class of the last year at points given in degrees."""
    grid = Grid(res=RES, nrows=testbed.grid(spark, sf).nrows, ncols=50, x0=230_000.0, y0=9_770_000.0)
    lulc = testbed.lulc(spark, sf)
    points = lulc.select("cell_id", (36.6 + F.col("c") / 100.0).alias("x"), (-1.5 + (F.col("r") % 40) / 100.0).alias("y")).distinct()
    layers = lulc.filter(F.col("yr") == 2001).select("r", "c", "cls")
    out = vectors.extract_at_points(layers, points, grid, ["cls"], degrees=(37, True))
    return out.select("cell_id", "r", "c", "cls")


@query("compare_geom")
def compare_geom(spark, sf):
    lulc = testbed.lulc(spark, sf)
    return pixels.same_geometry(lulc.filter(F.col("yr") == 1995), lulc.filter(F.col("yr") == 2001))


@query("tile_grid")
def tile_grid(spark, sf):
    tiled = pixels.with_tile(testbed.lulc(spark, sf), testbed.grid(spark, sf), 3, 2)
    return tiled.groupBy("yr", "tile_r", "tile_c").agg(F.count(F.lit(1)).alias("cells"))


@query("connected_components")
def connected_components(spark, sf):
    urban = testbed.lulc(spark, sf).filter(F.col("cls") == 1)
    return components.connected_components(urban, 8).select("cell_id", "yr", "component")


@query("sieve_small")
def sieve_small(spark, sf):
    px = testbed.change_prob(spark, sf)
    return components.sieve_small(px.drop("cls"), px, 9).select("cell_id", "yr", "change")


@query("patch_windows")
def patch_windows(spark, sf):
    cfg = testbed.study(spark, sf).change
    pairs = change.transition_values(testbed.channels(spark, sf), ["b04"], testbed.TRANSITIONS)
    out = patches.patch_windows(pairs, ["b04"], cfg.patch_size, cfg.stride_train, ["transition_id"])
    text = lambda a: F.array_join(F.transform(a, lambda v: F.round(v * 10000).cast("bigint")), ",")
    return out.select("transition_id", "r0", "c0", text("pre_b04").alias("pre"),
                      text("post_b04").alias("post"))


@query("patch_label")
def patch_label(spark, sf):
    labelled, _ = patch_labels(spark, sf)
    return labelled.select("transition_id", "r0", "c0", "y")


@query("block_split_id")
def block_split_id(spark, sf):
    labelled, _ = patch_labels(spark, sf)
    return labelled.select("transition_id", "r0", "c0", "block")


@query("sliding_window_mean")
def sliding_window_mean(spark, sf):
    """Window scores (mean NDVI of the first date) averaged back to cells."""
    cfg = testbed.study(spark, sf).change
    pairs = change.transition_values(testbed.channels(spark, sf), ["ndvi"], testbed.TRANSITIONS) \
        .withColumn("change", F.lit(0))
    scores = patches.patch_summaries(pairs, ["ndvi"], cfg, cfg.stride_infer, ["transition_id"])
    scores = scores.select("transition_id", "r0", "c0", F.col("pre_ndvi_mean").alias("prob"))
    out = patches.overlap_mean(scores, pairs.select("transition_id", "cell_id", "r", "c"),
                               cfg.patch_size, cfg.stride_infer, ["transition_id"])
    return keep(out, ["transition_id", "cell_id"], ["prob"])


@query("patch_density")
def patch_density(spark, sf):
    return keep(landscape.patch_metrics(testbed.lulc(spark, sf), RES), ["yr"], ["PD"])


@query("largest_patch_index")
def largest_patch_index(spark, sf):
    return keep(landscape.patch_metrics(testbed.lulc(spark, sf), RES), ["yr"], ["LPI"])


@query("mean_patch_area")
def mean_patch_area(spark, sf):
    return keep(landscape.patch_metrics(testbed.lulc(spark, sf), RES), ["yr"], ["MPA"])


@query("edge_density")
def edge_density(spark, sf):
    return keep(landscape.border_metrics(testbed.lulc(spark, sf), RES), ["yr"], ["ED"])


@query("aggregation_index")
def aggregation_index(spark, sf):
    return keep(landscape.border_metrics(testbed.lulc(spark, sf), RES), ["yr"], ["AI"])


@query("landscape_metrics")
def landscape_metrics(spark, sf):
    return keep(landscape.landscape_metrics(testbed.lulc(spark, sf), RES), ["year"],
                ["PD", "LPI", "ED", "AI", "MPA"])
