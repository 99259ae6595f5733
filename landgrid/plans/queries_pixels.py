"""Queries on per-pixel map algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgrid.config import Sprawl
from landgrid.functions import bands as B
from landgrid.functions import classes as C
from landgrid.functions import geo
from landgrid.operators import change, pixels, resample, zones
from landgrid.plans.common import keep, register
from landgrid.config import Grid
from landgrid.sources import testbed

QUERIES = {}
query = register(QUERIES)
SPRAWL = Sprawl(centre_xy=testbed.CENTRE)


@query("mask_scl")
def mask_scl(spark, sf):
    px = testbed.px(spark, sf).filter(F.col("sensor") == "sentinel")
    return pixels.mask_scl(px).select("cell_id", "yr", *B.BANDS)


@query("mask_qa")
def mask_qa(spark, sf):
    px = testbed.px(spark, sf).filter(F.col("sensor") == "landsat")
    return pixels.mask_qa(px).select("cell_id", "yr", *B.BANDS)


@query("scale_s2")
def scale_s2(spark, sf):
    px = testbed.px(spark, sf).filter(F.col("sensor") == "sentinel")
    return pixels.scale_sentinel(px).select("cell_id", "yr", *B.BANDS)


@query("scale_landsat")
def scale_landsat(spark, sf):
    px = testbed.px(spark, sf).filter(F.col("sensor") == "landsat")
    return pixels.scale_landsat(px).select("cell_id", "yr", *B.BANDS)


def _index(name):
    @query(f"idx_{name}")
    def one(spark, sf):
        refl = pixels.reflectance(testbed.px(spark, sf))
        return keep(pixels.with_indices(refl, [name]), ["cell_id", "yr"], [name])
    return one


for _name in B.INDICES:
    _index(_name)


@query("feature_stack")
def feature_stack(spark, sf):
    return keep(pixels.feature_stack(testbed.px(spark, sf)), pixels.KEYS, B.FEATURES)


@query("canonical_bands")
def canonical_bands(spark, sf):
    px = testbed.px(spark, sf).filter(F.col("sensor") == "landsat")
    back = {v: k for k, v in pixels.LANDSAT_TO_CANONICAL.items()}
    named = px.drop("scl").withColumnsRenamed(back)
    return pixels.canonicalize(named).select("cell_id", "yr", *B.BANDS)


@query("minmax_params")
def minmax_params(spark, sf):
    params = pixels.minmax_params(pixels.feature_stack(testbed.px(spark, sf)))
    return keep(params, ["year", "sensor", "layer"], ["min", "max"])


@query("minmax_normalize")
def minmax_normalize(spark, sf):
    feat = pixels.feature_stack(testbed.px(spark, sf))
    norm = pixels.minmax_normalize(feat, pixels.minmax_params(feat))
    return keep(norm, ["cell_id", "yr", "sensor"], B.FEATURES)


@query("denormalize")
def denormalize(spark, sf):
    feat = pixels.feature_stack(testbed.px(spark, sf))
    params = pixels.minmax_params(feat)
    norm = pixels.minmax_normalize(feat, params)
    raw = pixels.denormalize(norm, params, ["ndvi", "mndwi"])
    return keep(raw, ["cell_id", "yr"], ["raw_ndvi", "raw_mndwi"])


@query("spectral_rules")
def spectral_rules(spark, sf):
    feat = pixels.feature_stack(testbed.px(spark, sf)).select("cell_id", "yr", "mndwi", "ndvi")
    both = testbed.lulc(spark, sf).join(feat, ["cell_id", "yr"], "left")
    ruled = C.spectral_rules(F.col("cls"), F.col("mndwi"), F.col("ndvi"))
    return both.select("cell_id", "yr", ruled.alias("cls"))


@query("remap_worldcover")
def remap_worldcover(spark, sf):
    return testbed.land_cover(spark, sf).select(
        "cell_id", C.remap(F.col("code"), C.WORLDCOVER).alias("cls"))


@query("remap_globeland30")
def remap_globeland30(spark, sf):
    return testbed.land_cover(spark, sf).select(
        "cell_id", C.remap(F.col("code"), C.GLOBELAND30).alias("cls"))


@query("clamp_class")
def clamp_class(spark, sf):
    return testbed.land_cover(spark, sf).select(
        "cell_id", C.clamp_class(F.col("pop") / 8 + 0.25).alias("cls"))


@query("sanitize_lulc")
def sanitize_lulc(spark, sf):
    """Class codes stretched to 1, 3, 5 and 7, so that two of them are out of range."""
    code = C.sanitize_class(F.col("cls") * 2 - 1)
    return testbed.lulc(spark, sf).select("cell_id", "yr", code.alias("cls")) \
        .withColumn("label", C.class_label(F.col("cls")))


@query("change_ref")
def change_ref(spark, sf):
    return change.change_reference(testbed.lulc(spark, sf), testbed.TRANSITIONS).select(
        "cell_id", "pre_year", "post_year", "change")


@query("growth_binary")
def growth_binary(spark, sf):
    src = testbed.grid(spark, sf)
    dst = Grid(res=2 * src.res, nrows=-(-src.nrows // 2), ncols=src.ncols // 2)
    coarse = resample.resample_nearest(testbed.lulc(spark, sf), src, dst, ["cls"], ["yr"])
    return change.change_reference(coarse, [(1995, 2001)], ["r", "c"]).select(
        "r", "c", F.col("change").alias("growth"))


@query("new_urban_overlay")
def new_urban_overlay(spark, sf):
    changes = change.change_reference(testbed.lulc(spark, sf), testbed.TRANSITIONS)
    return change.new_urban(changes).select("cell_id", "pre_year", "post_year", "change")


@query("ndvi_loss")
def ndvi_loss(spark, sf):
    feat = pixels.feature_stack(testbed.px(spark, sf)).select("cell_id", "r", "c", "yr", "sensor", "ndvi")
    norm = pixels.minmax_normalize(feat, pixels.minmax_params(feat, ["ndvi"]), ["ndvi"])
    return keep(change.ndvi_loss(norm, 1995, 2001), ["cell_id"], ["ndvi_loss"])


@query("pop_density")
def pop_density(spark, sf):
    km2 = testbed.grid(spark, sf).cell_km2
    return keep(testbed.land_cover(spark, sf).withColumn("pop_density", F.col("pop") / km2),
                ["cell_id"], ["pop_density"])


@query("dist_to_point")
def dist_to_point(spark, sf):
    grid = testbed.grid(spark, sf)
    cells = pixels.cell_xy(testbed.lulc(spark, sf).select("cell_id", "r", "c").distinct(), grid)
    d = geo.dist_to_point(F.col("x"), F.col("y"), *testbed.CENTRE)
    return keep(cells.withColumn("dist", d), ["cell_id"], ["dist"])


@query("ring_zone")
def ring_zone(spark, sf):
    grid = testbed.grid(spark, sf)
    return zones.with_ring(testbed.lulc(spark, sf), grid, SPRAWL, bounds=True).select(
        "cell_id", "yr", "zone_id", "inner_km", "outer_km")


@query("sector_zone")
def sector_zone(spark, sf):
    out = zones.with_sector(testbed.lulc(spark, sf), testbed.grid(spark, sf), SPRAWL)
    return out.select("cell_id", "yr", "sector_id",
                      geo.sector_name(F.col("sector_id")).alias("sector_name"))


@query("ring_zone_touch")
def ring_zone_touch(spark, sf):
    out = zones.with_rings_touched(testbed.lulc(spark, sf), testbed.grid(spark, sf), SPRAWL)
    return out.select("cell_id", "yr", "zone_id")


@query("entropy_band")
def entropy_band(spark, sf):
    counts = zones.zone_counts(
        zones.with_ring(testbed.lulc(spark, sf), testbed.grid(spark, sf), SPRAWL),
        testbed.YEARS)
    return zones.shannon_entropy(counts).select("year", C.entropy_band(F.col("H_rel")).alias("band"))
