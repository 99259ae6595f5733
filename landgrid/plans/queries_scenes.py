"""Queries on catalogs, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgrid.config import SceneSearch
from landgrid.functions.bands import BANDS
from landgrid.operators import change, pixels, stats
from landgrid.plans.common import keep, register
from landgrid.session import scratch_path
from landgrid.sources import catalog as cat
from landgrid.sources import products, testbed

QUERIES = {}
query = register(QUERIES)
AOI = (36.6, -1.5, 37.1, -1.1)
SEARCH = SceneSearch()
AREA = ("Urban_km2", "Vegetation_km2", "BareSoil_km2", "Water_km2", "Total_km2")


@query("scan_scene")
def scan_scene(spark, sf):
    scenes = testbed.px(spark, sf).filter(F.col("sensor") == "sentinel")
    unnamed = scenes.select("cell_id", "r", "c", "yr", *[
        F.col(b).alias(f"layer_{i}") for i, b in enumerate((*BANDS, "scl"), start=1)])
    return pixels.conform_layers(unnamed, "sentinel", ("cell_id", "r", "c", "yr"))


@query("catalog_search")
def catalog_search(spark, sf):
    hits = cat.catalog_search(testbed.catalog(spark, sf), SEARCH.sentinel_collection, AOI,
                              "1996-01-01", "1996-03-31")
    return hits.select("item_id", F.col("dt").cast("string").alias("dt"))


@query("catalog_search_relaxed")
def catalog_search_relaxed(spark, sf):
    items = testbed.catalog(spark, sf)
    hit = cat.catalog_search_relaxed(items, SEARCH.landsat_collection, AOI,
                                     "1997-01-01", "1997-03-31")
    miss = cat.catalog_search_relaxed(items, SEARCH.landsat_collection, AOI,
                                      "1980-01-01", "1980-12-31")
    return (hit.select(F.lit("hit").alias("search"), "item_id")
            .unionByName(miss.select(F.lit("relaxed").alias("search"), "item_id")))


@query("season_window")
def season_window(spark, sf):
    years = testbed.catalog(spark, sf).select("yr").distinct()
    t0, t1 = cat.season_bounds(F.col("yr"), 1, 3)
    f0, f1 = cat.season_bounds(F.col("yr"), 2, 2)
    return years.select("yr", *[e.cast("string").alias(n) for n, e in
                                (("t0", t0), ("t1", t1), ("feb0", f0), ("feb1", f1))])


@query("effective_cloud")
def effective_cloud(spark, sf):
    return testbed.catalog(spark, sf).select(
        "item_id", cat.effective_cloud(F.col("eo_cloud"), F.col("land_cloud")).alias("cloud"))


@query("normalize_platform")
def normalize_platform(spark, sf):
    return testbed.catalog(spark, sf).select(
        "item_id", cat.normalize_platform(F.col("platform")).alias("platform"))


@query("best_scene")
def best_scene(spark, sf):
    t0, t1 = cat.season_bounds(F.col("yr"), *SEARCH.season)
    items = testbed.catalog(spark, sf).filter(
        (F.col("collection") == SEARCH.sentinel_collection) & F.col("dt").between(t0, t1))
    return cat.best_scene(items, ["yr"], SEARCH.sentinel_ladder)


@query("best_scene_platform")
def best_scene_platform(spark, sf):
    items = testbed.catalog(spark, sf).filter(F.col("collection") == SEARCH.landsat_collection)
    wanted = [(1995, "landsat-5"), (1996, "landsat-7"), (1997, "landsat-8"), (1998, "landsat-9")]
    return cat.best_scene_platform(items, wanted, SEARCH.season, SEARCH.landsat_ladder)


@query("asset_pick")
def asset_pick(spark, sf):
    return cat.asset_pick(testbed.catalog(spark, sf), ["other"], ["collection"])


@query("aoi_crop")
def aoi_crop(spark, sf):
    box = (5_250.0, 1_000.0, 38_500.0, 31_500.0)
    return pixels.aoi_crop(testbed.px(spark, sf), box, testbed.grid(spark, sf)) \
        .select("cell_id", "yr", "b02", "b08")


@query("mosaic_tiles")
def mosaic_tiles(spark, sf):
    lulc = testbed.lulc(spark, sf)
    tiles = F.array(
        F.struct(F.lit(1).alias("tile_order"), (F.col("c") < 30).alias("in_tile"),
                 F.col("cls").alias("tile_cls")),
        F.struct(F.lit(2).alias("tile_order"), (F.col("c") >= 20).alias("in_tile"),
                 (5 - F.coalesce("cls", F.lit(2))).alias("tile_cls")))
    tiled = lulc.select("cell_id", "yr", F.inline(tiles)).filter("in_tile")
    return pixels.mosaic_tiles(tiled.withColumnRenamed("tile_cls", "cls"), ["cell_id", "yr"])


@query("stack_bands")
def stack_bands(spark, sf):
    long = testbed.px(spark, sf).unpivot(["cell_id", "yr"], list(BANDS), "band", "value")
    return pixels.stack_bands(long, BANDS, ["cell_id", "yr"])


@query("pixel_sink")
def pixel_sink(spark, sf):
    """Write three years, then everything: the second run skips the years that exist."""
    lulc = testbed.lulc(spark, sf)
    path = scratch_path(spark, "lulc")
    products.write_product(lulc.filter(F.col("yr") <= 1997), path)
    products.write_product(lulc, path)
    return spark.read.parquet(path).groupBy("yr").agg(
        F.count(F.lit(1)).alias("cells"), F.count("cls").alias("classified"),
        F.sum(F.coalesce("cls", F.lit(0))).alias("class_sum"))


@query("upsert_by_key")
def upsert_by_key(spark, sf):
    """A stored table with an outdated urban area, refreshed for the later years."""
    area = stats.area_stats(testbed.lulc(spark, sf), testbed.RES)
    old = area.withColumn("Urban_km2", F.col("Urban_km2") + 1)
    merged = products.upsert(old, area.filter(F.col("Year") >= 1999), ["Year"])
    return keep(merged.orderBy("Year"), ["Year"], AREA)


@query("csv_report_sink")
def csv_report_sink(spark, sf):
    area = stats.area_stats(testbed.lulc(spark, sf), testbed.RES)
    path = scratch_path(spark, "area")
    products.write_csv(area, path, order=["Year"])
    return keep(spark.read.schema(area.schema).option("header", True).csv(path), ["Year"], AREA)


@query("transition_pairs")
def transition_pairs(spark, sf):
    return change.transition_pairs(testbed.lulc(spark, sf), testbed.TRANSITIONS).select(
        "cell_id", "transition_id", "pre_year", "post_year", "pre_cls", "post_cls")


@query("available_years")
def available_years(spark, sf):
    px = testbed.px(spark, sf)
    return products.available_years([px.filter("sensor = 'landsat'"), px.filter("sensor = 'sentinel'")],
                                    want=[1990, 1995, 1996, 1999, 2001, 2010])
