"""NULL rules, normalisation, sinks, zones and reports on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from landgrid.config import Grid, Sprawl
from landgrid.functions import bands as B
from landgrid.functions import classes as C
from landgrid.operators import change, pixels, report, stats, zones
from landgrid.session import join_bounded
from landgrid.sources import catalog, products
from landgrid.streaming.refresh import LULC_SCHEMA, area_refresh


def one(spark, **exprs):
    return spark.range(1).select(*[e.alias(n) for n, e in exprs.items()]).first()


def test_change_is_three_valued(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), (1, None), (2, None), (2, 1), (1, 1)], "a int, b int")
    got = [r[0] for r in df.select(C.became(F.col("a"), F.col("b"))).collect()]
    assert got == [0, None, 0, None, 1, 0]


def test_masks_and_scaling(spark):
    df = spark.createDataFrame([(4.0, 64, 5000), (4.5, 8, 12000), (9.0, None, -5), (7.0, 1, None)],
                               "scl double, qa int, dn int")
    got = df.select(B.scl_is_clear(F.col("scl")), B.qa_is_clear(F.col("qa")),
                    B.sentinel_reflectance(F.col("dn")), B.landsat_reflectance(F.col("dn"))).collect()
    assert [r[0] for r in got] == [True, False, False, True]
    assert [r[1] for r in got] == [True, False, False, True]
    assert [r[2] for r in got] == [0.5, 1.0, 0.0, None]
    assert got[0][3] == 0.0 and got[3][3] is None


def test_rules_order_and_null(spark):
    df = spark.createDataFrame([(1, 0.4, 0.7), (1, 0.4, None), (1, None, 0.5), (None, 0.4, 0.1), (None, None, None)],
                               "c int, m double, n double")
    got = [r[0] for r in df.select(C.spectral_rules(F.col("c"), F.col("m"), F.col("n"))).collect()]
    assert got == [2, 4, 1, 4, None]
    codes = spark.createDataFrame([(-1.0,), (2.4,), (9.0,), (None,)], "v double")
    assert [r[0] for r in codes.select(C.clamp_class(F.col("v"))).collect()] == [1, 2, 4, None]
    assert [r[0] for r in codes.select(C.sanitize_class(F.col("v"))).collect()] == [0, 2, 0, None]


def test_conform_and_canonical_layers(spark):
    df = spark.range(1).select(F.col("id").alias("cell_id"), *[F.lit(i).alias(f"x{i}") for i in range(7)])
    with pytest.warns(UserWarning):
        assert pixels.conform_layers(df, "landsat", ["cell_id"]).columns[1] == "SR_B2"
    with pytest.raises(ValueError):
        pixels.conform_layers(df.drop("x6"), "landsat", ["cell_id"])
    with pytest.raises(ValueError):
        pixels.canonicalize(df.select(F.lit(1).alias("SR_B2")))
    assert pixels.sensor_of(["B02", "B03"]) == "sentinel"


def test_minmax_degenerate_and_back(spark):
    rows = [(1, 2000, "s", 1.0, 5.0), (2, 2000, "s", 3.0, 5.0), (3, 2000, "s", None, None)]
    df = spark.createDataFrame(rows, "cell_id int, yr int, sensor string, a double, b double")
    params = pixels.minmax_params(df, ["a", "b"])
    norm = pixels.minmax_normalize(df, params, ["a", "b"])
    assert [tuple(r) for r in norm.orderBy("cell_id").select("a", "b").collect()] == [
        (0.0, 0.0), (1.0, 0.0), (None, None)]
    raw = pixels.denormalize(norm, params, ["a"]).orderBy("cell_id")
    assert [r["raw_a"] for r in raw.collect()] == [1.0, 3.0, None]
    twice = pixels.denormalize(norm, params.unionByName(params), ["a"])
    assert [r["raw_a"] for r in twice.collect()] == [None] * 3


def test_join_bounded_both_ways(spark):
    big = spark.range(50).select(F.col("id"), (F.col("id") % 5).alias("k"))
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    a = {tuple(r) for r in join_bounded(big, small, "k").collect()}
    b = {tuple(r) for r in join_bounded(big, small, "k", cap=2).collect()}
    assert a == b and len(a) == 50
    assert "Broadcast" not in join_bounded(big, small, "k", cap=2)._jdf.queryExecution().optimizedPlan().toString()


def test_entropy_limits(spark):
    rows = [(2000, z, u, 10) for z, u in ((1, 4), (2, 4), (3, 4))] + [(2001, z, 0, 10) for z in (1, 2, 3)]
    rows += [(2002, 1, 9, 10), (2002, 2, 0, 10), (2002, 3, 0, 10)]
    counts = spark.createDataFrame(rows, "yr int, zone_id bigint, urban_px bigint, total_px bigint")
    got = {r["year"]: r for r in zones.shannon_entropy(counts).collect()}
    assert got[2000]["H"] == pytest.approx(math.log(3)) and got[2000]["H_rel"] == pytest.approx(1.0)
    assert got[2001]["H"] == 0 and got[2001]["H_rel"] == 0 and got[2002]["H_rel"] == 0
    shares = zones.zone_shares(counts).groupBy("yr").agg(F.sum("pi")).collect()
    assert {r[0]: round(r[1], 9) for r in shares} == {2000: 1.0, 2001: 0.0, 2002: 1.0}
    single = zones.shannon_entropy(counts.filter("zone_id = 1")).collect()
    assert all(r["H_rel"] == 0 for r in single)


def test_rings_hotspots_and_popups(spark, frame):
    cfg, grid = Sprawl(centre_xy=(50.0, 50.0), ring_step=20.0, ring_max=60.0, fringe_km=0.01, sector_radius=500.0), Grid(10.0, 10, 10)
    px = frame([[1] * 10 for _ in range(10)])
    ring = zones.with_ring(px, grid, cfg)
    assert ring.agg(F.min("zone_id"), F.max("zone_id")).first()[:] == (1, 3)
    touched = zones.with_rings_touched(px, grid, cfg)
    assert touched.count() > ring.count()
    assert touched.join(ring.select("cell_id", "zone_id"), ["cell_id", "zone_id"], "left_semi").count() <= touched.count()
    sectors = zones.with_sector(px, grid, cfg).groupBy("sector_id").count().collect()
    assert len(sectors) == 8 and sum(r["count"] for r in sectors) == 100
    rows = [(z, 1, 2000, 2005, 5, v) for z, v in ((1, 1.0), (2, 1.0), (3, 9.0), (4, None))]
    ueii = spark.createDataFrame(rows, "zone_id bigint, transition_id int, pre_year int, post_year int, delta_years int, ueii double")
    hot = zones.hotspots(ueii, cfg, 1)
    assert [r["zone_id"] for r in hot.collect()] == [3]
    pop = {r["zone_id"]: r["popup"] for r in report.hotspot_popups(ueii.select("zone_id"), ueii).collect()}
    assert pop[3].endswith("UEII: 9.00 % / yr") and "—" in pop[4]


def test_transitions_choice():
    t = [(2000, 2010), (2010, 2020)]
    assert change.pick_transitions(t, index=2) == [(2010, 2020)]
    assert change.pick_transitions(t, pair=(1, 2)) == [(1, 2)]
    with pytest.raises(IndexError):
        change.pick_transitions(t, index=3)


def test_best_scene_unknown_cloud_is_first_level(spark):
    rows = [(1, 1, 2000, 15.0, None), (2, 2, 2000, None, None), (3, 3, 2001, 19.0, float("nan")),
            (4, 4, 2001, 30.0, 12.0), (5, 5, 2002, 50.0, None)]
    df = spark.createDataFrame(rows, "item_id bigint, item_seq bigint, yr int, eo_cloud double, land_cloud double")
    df = df.withColumn("dt", F.make_date("yr", F.lit(1), F.lit(1)))
    got = {r["yr"]: r["item_id"] for r in catalog.best_scene(df, ["yr"], (10.0, 20.0)).collect()}
    assert got == {2000: 2, 2001: 4}


def test_sinks_skip_replace_and_upsert(spark, tmp_path):
    path = str(tmp_path / "p")
    make = lambda yr, cls: spark.createDataFrame([(1, 0, 0, yr, cls)], LULC_SCHEMA)
    products.write_product(make(2000, 1), path)
    products.write_product(make(2000, 2).union(make(2001, 2)), path)
    read = lambda: {r["yr"]: r["cls"] for r in spark.read.parquet(path).collect()}
    assert read() == {2000: 1, 2001: 2}
    products.write_product(make(2000, 3), path, overwrite=True)
    assert read() == {2000: 3, 2001: 2}
    report_path = str(tmp_path / "r")
    table = lambda y, v: spark.createDataFrame([(y, v)], "Year int, v int")
    products.refresh_report(table(2000, 1), report_path, ["Year"])
    products.refresh_report(table(2001, 1), report_path, ["Year"])
    products.refresh_report(table(2000, 5), report_path, ["Year"])
    assert {tuple(r) for r in spark.read.parquet(report_path).collect()} == {(2000, 5), (2001, 1)}


def test_scan_scene_from_files(spark, tmp_path):
    path = str(tmp_path / "scene")
    df = spark.range(3).select(F.col("id").alias("cell_id"), F.lit(0).alias("r"), F.lit(0).alias("c"),
                               F.lit(2000).alias("yr"), *[F.lit(i).alias(n) for i, n in enumerate(
                                   ("B02", "B03", "B04", "B08", "B11", "B12", "SCL"))])
    df.write.parquet(path)
    assert products.scan_scene(spark, path, "sentinel").columns == df.columns


def test_stream_refresh_is_idempotent(spark, tmp_path):
    arrivals, product, rep = (str(tmp_path / n) for n in ("in", "lulc", "area"))
    rows = [(i, 0, i, 2000 + i % 2, 1 + i % 4) for i in range(8)]
    spark.createDataFrame(rows, LULC_SCHEMA).write.parquet(arrivals)
    area_refresh(spark, arrivals, product, rep, 1000.0, str(tmp_path / "cp")).awaitTermination()
    first = {tuple(r) for r in spark.read.parquet(rep).collect()}
    fix = [(i, 0, i, 2001, 1) for i in (1, 3, 5, 7)]
    spark.createDataFrame(fix, LULC_SCHEMA).write.mode("append").parquet(arrivals)
    area_refresh(spark, arrivals, product, rep, 1000.0, str(tmp_path / "cp")).awaitTermination()
    second = {r["Year"]: r["Urban_km2"] for r in spark.read.parquet(rep).collect()}
    assert second[2001] == 4.0 and {r[0] for r in first} == {2000, 2001} and len(second) == 2
    part = [(1, 0, 1, 2001, 2), (9, 0, 9, 2001, 1)]  # a year that arrives in parts keeps its other cells
    spark.createDataFrame(part, LULC_SCHEMA).write.mode("append").parquet(arrivals)
    area_refresh(spark, arrivals, product, rep, 1000.0, str(tmp_path / "cp")).awaitTermination()
    third = {r["Year"]: (r["Urban_km2"], r["Total_km2"]) for r in spark.read.parquet(rep).collect()}
    assert third[2001] == (4.0, 5.0)


def test_correlation_uses_pairwise_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, None), (4.0, 7.9)], "a double, b double")
    got = {r["variable"]: r for r in stats.correlation_matrix(df, ["a", "b"]).collect()}
    import numpy as np
    assert got["a"]["b"] == pytest.approx(np.corrcoef([1, 2, 4], [2.0, 4.1, 7.9])[0, 1])
    assert got["b"]["b"] == 1.0
    low = report.corr_lower(stats.correlation_matrix(df, ["a", "b"]), ["a", "b"]).collect()
    assert len(low) == 3


def test_shared_dir_follows_the_session():
    from types import SimpleNamespace

    from landgrid.session import shared_dir

    def session(master, configured=None):
        known = {"spark.checkpoint.dir": configured} if configured else {}
        conf = SimpleNamespace(get=known.get, set=known.__setitem__)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("yarn", "hdfs://shared/cp/")) == "hdfs://shared/cp"
    with pytest.raises(RuntimeError):
        shared_dir(session("yarn"))
    alone = session("local[2]")
    assert shared_dir(alone).startswith("/tmp/spark-") and shared_dir(alone) == shared_dir(alone)


def test_missing_year_is_skipped_and_zones_are_those_of_the_maps(spark):
    from landgrid.operators import zones
    cells = [(i, 1990 + y, 1 + i % 3, 1 if i % 2 else 2) for i in range(12) for y in (0, 2)]
    zoned = spark.createDataFrame(cells, "cell_id bigint, yr int, zone_id bigint, cls int")
    counts = zones.zone_counts(zoned, (1990, 1991, 1992))
    assert {(r["yr"], r["zone_id"]) for r in counts.collect()} == {(y, z) for y in (1990, 1992) for z in (1, 2, 3)}
    assert {r["year"]: r["n_zones"] for r in zones.shannon_entropy(counts).collect()} == {1990: 3, 1992: 3}
    area = spark.createDataFrame([(z, 4.0) for z in (1, 2, 3)], "zone_id bigint, zone_area_km2 double")
    steps = zones.expansion_intensity(counts, area, ((1990, 1991), (1990, 1992)), Grid(1000.0, 4, 4)).collect()
    assert {(r["pre_year"], r["post_year"]) for r in steps} == {(1990, 1992)}


def test_bad_classes_and_seeds_stop_the_job(spark):
    from pyspark.errors import PySparkException

    from landgrid.config import Change
    from landgrid.operators import vectors
    from landgrid.plans.jobs import split_patches
    px = spark.createDataFrame([(0, 0, 1.0)], "r bigint, c bigint, v double")
    for bad in (5, None):
        points = spark.createDataFrame([(500.0, 500.0, bad)], "x double, y double, class int")
        with pytest.raises(PySparkException, match="class outside"):
            vectors.extract_at_points(px, points, Grid(1000.0, 1, 1), ["v"]).collect()
    patches = spark.createDataFrame([(1, b, 0) for b in range(16)], "transition_id int, block int, y int")
    with pytest.raises(ValueError, match="no split seed"):
        split_patches(patches, Change(), ["transition_id"])


def test_catalog_search_is_not_cut(spark):
    from landgrid.sources import catalog
    items = spark.range(900).selectExpr("id AS item_id", "id AS item_seq", "'s' AS collection", "date'2000-01-05' AS dt",
                                        "0.0 AS xmin", "1.0 AS xmax", "0.0 AS ymin", "1.0 AS ymax")
    box = (0.0, 0.0, 1.0, 1.0)
    assert catalog.catalog_search(items, "s", box, "2000-01-01", "2000-02-01").count() == 900
    assert catalog.catalog_search_relaxed(items, "s", box, "1990-01-01", "1990-02-01").count() == 900
    assert catalog.catalog_search_relaxed(items, "s", box, "1990-01-01", "1990-02-01", 7).count() == 7
