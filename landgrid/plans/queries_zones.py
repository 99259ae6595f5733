"""Queries on zonal statistics, accuracy and report tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from landgrid.config import Sprawl
from landgrid.functions.classes import became
from landgrid.operators import change, landscape, pixels, report, stats, zones
from landgrid.config import Grid
from landgrid.plans.common import keep, register
from landgrid.sources import testbed

QUERIES = {}
query = register(QUERIES)
SPRAWL = Sprawl(centre_xy=testbed.CENTRE)
RES, YEARS, TRANSITIONS = testbed.RES, testbed.YEARS, testbed.TRANSITIONS
AREA = ("Urban_km2", "Vegetation_km2", "BareSoil_km2", "Water_km2", "Total_km2")
NEXT_YEAR = tuple(zip(YEARS, YEARS[1:]))


def ring_table(spark, sf):
    """(counts, area, grid) of the rings."""
    grid = testbed.grid(spark, sf)
    lulc = testbed.lulc(spark, sf)
    counts = zones.zone_counts(zones.with_ring(lulc, grid, SPRAWL), YEARS)
    return counts, zones.zone_area(lulc, grid, SPRAWL), grid


def ueii_table(spark, sf):
    counts, area, grid = ring_table(spark, sf)
    return zones.expansion_intensity(counts, area, TRANSITIONS, grid)


def predictions(spark, sf):
    """Class of the same cell in the next year, as prediction of this year's class."""
    pairs = change.transition_pairs(testbed.lulc(spark, sf), NEXT_YEAR)
    return pairs.select(F.col("pre_year").alias("yr"), F.col("post_cls").alias("pred"),
                        F.col("pre_cls").alias("ref"),
                        (F.col("post_cls").isNotNull() & F.col("pre_cls").isNotNull()).alias("complete"))


@query("class_area")
def class_area(spark, sf):
    return keep(stats.class_area(testbed.lulc(spark, sf), RES), ["yr", "cls"], ["area_km2"])


@query("area_stats")
def area_stats(spark, sf):
    return keep(stats.area_stats(testbed.lulc(spark, sf), RES), ["Year"], AREA)


@query("zone_counts")
def zone_counts(spark, sf):
    return ring_table(spark, sf)[0].select("yr", "zone_id", "urban_px", "total_px")


@query("zone_area")
def zone_area(spark, sf):
    return keep(ring_table(spark, sf)[1], ["zone_id"], ["zone_area_km2"])


@query("zone_wide")
def zone_wide(spark, sf):
    counts, area, grid = ring_table(spark, sf)
    wide = zones.zone_wide(counts, area, YEARS, grid, SPRAWL)
    return keep(wide, ["zone_id", *[f"urban_px_{y}" for y in YEARS]],
                ["inner_km", "outer_km", "zone_area_km2", *[f"urban_km2_{y}" for y in YEARS]])


@query("dissolve_by_id")
def dissolve_by_id(spark, sf):
    """Ring pieces cut by wedges, put together again."""
    grid = testbed.grid(spark, sf)
    cells = testbed.lulc(spark, sf).select("r", "c").distinct()
    cut = zones.with_sector(zones.with_ring(cells, grid, SPRAWL, bounds=True), grid, SPRAWL)
    pieces = cut.groupBy("zone_id", "sector_id").agg(
        F.max("inner_km").alias("inner_km"), (F.count(F.lit(1)) * F.lit(grid.cell_km2)).alias("area_km2"))
    whole = zones.dissolve(pieces, "zone_id", "sector_id", ["inner_km", "sector_id"], "area_km2")
    return keep(whole.withColumnRenamed("sector_id", "first_sector"),
                ["zone_id", "first_sector"], ["inner_km", "area_km2"])


@query("shannon_entropy")
def shannon_entropy(spark, sf):
    return keep(zones.shannon_entropy(ring_table(spark, sf)[0]), ["year", "n_zones"], ["H", "H_rel"])


@query("zone_pi")
def zone_pi(spark, sf):
    return keep(zones.zone_shares(ring_table(spark, sf)[0]), ["yr", "zone_id"], ["pi"])


@query("ueii")
def ueii(spark, sf):
    return keep(ueii_table(spark, sf), ["zone_id", "pre_year", "post_year", "delta_years"], ["ueii"])


@query("hotspots")
def hotspots(spark, sf):
    hot = zones.hotspots(ueii_table(spark, sf), SPRAWL, len(TRANSITIONS))
    return keep(hot, ["zone_id"], ["inner_km", "outer_km", "ueii"])


@query("hotspots_first_step")
def hotspots_first_step(spark, sf):
    """Hotspots of the first transition over all rings, the fringe included."""
    hot = zones.hotspots(ueii_table(spark, sf), replace(SPRAWL, fringe_km=-1.0), 1)
    return keep(hot, ["zone_id"], ["inner_km", "outer_km", "ueii"])


@query("sector_counts")
def sector_counts(spark, sf):
    out = zones.sector_counts(testbed.lulc(spark, sf), testbed.grid(spark, sf), SPRAWL, YEARS)
    return keep(out, ["yr", "sector_id", "sector_name", "urban_px"], ["urban_km2"])


@query("directional_growth")
def directional_growth(spark, sf):
    counts = zones.sector_counts(testbed.lulc(spark, sf), testbed.grid(spark, sf), SPRAWL,
                                 (YEARS[0], YEARS[-1]))
    return keep(zones.directional_growth(counts, YEARS[0], YEARS[-1]), ["sector"],
                ["urban_km2_t0", "urban_km2_t1", "growth_pct"])


@query("confusion_matrix")
def confusion_matrix(spark, sf):
    return stats.confusion_matrix(predictions(spark, sf), ["yr"], complete="complete")


@query("accuracy_report")
def accuracy_report(spark, sf):
    conf = stats.confusion_matrix(predictions(spark, sf), ["yr"], complete="complete")
    return keep(stats.accuracy_report(conf, ["yr"]), ["yr", "metric"], ["value"])


@query("binary_metrics")
def binary_metrics(spark, sf):
    pairs = change.transition_values(testbed.change_prob(spark, sf), ["cls", "prob"], TRANSITIONS)
    scored = pairs.select("transition_id", F.col("post_prob").alias("prob"),
                          became(F.col("pre_cls"), F.col("post_cls")).alias("y"))
    out = stats.binary_metrics(scored.dropna(), ["transition_id"])
    return keep(out, ["transition_id", "TP", "FP", "FN", "TN"], ["Precision", "Recall", "F1", "IoU"])


@query("min_samples_check")
def min_samples_check(spark, sf):
    known = testbed.lulc(spark, sf).dropna(subset=["cls"])
    return stats.low_classes(known, 200, ["yr"])


@query("quality_checks")
def quality_checks(spark, sf):
    out = pixels.quality_checks(pixels.feature_stack(testbed.px(spark, sf)))
    return keep(out, ["yr", "sensor", "layer"],
                ["null_share", "min_ndvi", "max_ndvi", "min_ndbi", "max_ndbi", "min_reflectance"])


@query("class_histogram")
def class_histogram(spark, sf):
    return stats.class_histogram(testbed.lulc(spark, sf))


@query("growth_trajectory")
def growth_trajectory(spark, sf):
    return report.growth_trajectory(stats.area_stats(testbed.lulc(spark, sf), RES))


@query("entropy_trend")
def entropy_trend(spark, sf):
    return report.entropy_trend(zones.shannon_entropy(ring_table(spark, sf)[0]))


@query("landscape_long")
def landscape_long(spark, sf):
    metrics = landscape.landscape_metrics(testbed.lulc(spark, sf), RES)
    return keep(report.landscape_long(metrics), ["year", "metric"], ["value"])


@query("hotspots_latest_ueii")
def hotspots_latest_ueii(spark, sf):
    """Every ring as a candidate, so that the popup text is exercised for all of them."""
    table = ueii_table(spark, sf)
    return report.hotspot_popups(table.select("zone_id").distinct(), table)


@query("ring_labels")
def ring_labels(spark, sf):
    _, area, _ = ring_table(spark, sf)
    return report.ring_labels(zones.with_ring_bounds(area, SPRAWL))


def dashboard(spark, sf, with_change=True):
    """Last class map and first-to-last change, coarsened."""
    size = testbed.grid(spark, sf)
    grid = Grid(res=size.res, nrows=size.nrows, ncols=size.ncols, x0=280_000.0, y0=9_850_000.0)
    lulc = testbed.lulc(spark, sf)
    changed = change.change_reference(lulc, [(YEARS[0], YEARS[-1])]) if with_change else None
    return report.dashboard(lulc.filter(F.col("yr") == YEARS[-1]), changed, grid, 4, 37, True)


@query("dashboard_layers")
def dashboard_layers(spark, sf):
    """The map's layers as coloured points with their position in degrees."""
    placed = dashboard(spark, sf).points
    return placed.select("r", "c", "cls", "change", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("dashboard_extent")
def dashboard_extent(spark, sf):
    """The box the map opens on; without the change layer it is the same."""
    box = dashboard(spark, sf, with_change=False).extent
    return box.select(*[F.round(c, 7).alias(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")])


@query("change_overlay")
def change_overlay(spark, sf):
    changes = change.change_reference(testbed.lulc(spark, sf), TRANSITIONS)
    return report.change_overlay(changes, keys=["cell_id", "transition_id"])
