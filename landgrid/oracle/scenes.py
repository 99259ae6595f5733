"""SQL of catalog, source and sink queries."""

from landgrid.oracle.base import sql

_SCENE_COLS = "b02 AS B02, b03 AS B03, b04 AS B04, b08 AS B08, b11 AS B11, b12 AS B12, scl AS SCL"
_AREA = {
    "cnt": "SELECT yr, cls, count(*) AS k FROM lulc WHERE cls IS NOT NULL GROUP BY ALL",
    "area": """SELECT yr AS "Year", round(sum(k) FILTER (cls = 1) * CAST(1 AS DOUBLE), 6) AS "Urban_km2",
 round(sum(k) FILTER (cls = 2) * CAST(1 AS DOUBLE), 6) AS "Vegetation_km2", round(sum(k) FILTER (cls = 3) * CAST(1 AS DOUBLE), 6) AS "BareSoil_km2",
 round(sum(k) FILTER (cls = 4) * CAST(1 AS DOUBLE), 6) AS "Water_km2", round(sum(k) * CAST(1 AS DOUBLE), 6) AS "Total_km2" FROM cnt GROUP BY yr""",
}
_BOX = "xmin <= 37.1 AND xmax >= 36.6 AND ymin <= -1.1 AND ymax >= -1.5"

SQL = {
    "scan_scene": sql(f"SELECT cell_id, r, c, yr, {_SCENE_COLS} FROM px WHERE sensor = 'sentinel'"),
    "catalog_search": sql(f"""SELECT item_id, CAST(dt AS VARCHAR) AS dt FROM catalog WHERE collection = 'sentinel-2-l2a'
 AND {_BOX} AND dt BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'"""),
    "catalog_search_relaxed": sql(f"""SELECT * FROM (SELECT 'hit' AS search, item_id FROM catalog WHERE collection = 'landsat-c2-l2'
 AND {_BOX} AND dt BETWEEN DATE '1997-01-01' AND DATE '1997-03-31')
 UNION ALL SELECT * FROM (SELECT 'relaxed' AS search, item_id FROM catalog WHERE collection = 'landsat-c2-l2'
 AND {_BOX})"""),
    "season_window": sql("""SELECT DISTINCT yr, yr || '-01-01' AS t0, yr || '-03-31' AS t1, yr || '-02-01' AS feb0,
 yr || CASE WHEN yr % 4 = 0 AND (yr % 100 <> 0 OR yr % 400 = 0) THEN '-02-29' ELSE '-02-28' END AS feb1 FROM catalog"""),
    "effective_cloud": sql("""SELECT item_id, CASE WHEN eo_cloud IS NULL THEN land_cloud WHEN land_cloud IS NULL THEN eo_cloud
 WHEN eo_cloud < land_cloud THEN eo_cloud ELSE land_cloud END AS cloud FROM catalog"""),
    "normalize_platform": sql("SELECT item_id, replace(trim(lower(platform)), '_', '-') AS platform FROM catalog"),
    "best_scene": sql("""SELECT yr, item_id, cloud, level FROM (SELECT *, row_number() OVER (PARTITION BY yr
 ORDER BY level, cloud NULLS LAST, item_seq) AS rn FROM (SELECT *, CASE WHEN cloud IS NULL OR cloud <= 10 THEN 0
 WHEN cloud <= 20 THEN 1 END AS level FROM cloudy WHERE collection = 'sentinel-2-l2a' AND month(dt) <= 3) z
 WHERE level IS NOT NULL) y WHERE rn = 1"""),
    "best_scene_platform": sql("""SELECT yr, platform, item_id, cloud, stage FROM (SELECT c.yr, a.want AS platform, c.item_id, c.cloud,
 c.item_seq, CASE WHEN p <> a.want THEN 2 WHEN month(c.dt) <= 3 THEN 0 ELSE 1 END AS stage,
 row_number() OVER (PARTITION BY c.yr, a.want ORDER BY CASE WHEN p <> a.want THEN 2 WHEN month(c.dt) <= 3 THEN 0 ELSE 1 END,
 CASE WHEN c.cloud IS NULL OR c.cloud <= 10 THEN 0 WHEN c.cloud <= 20 THEN 1 WHEN c.cloud <= 40 THEN 2
 WHEN c.cloud <= 60 THEN 3 WHEN c.cloud <= 80 THEN 4 WHEN c.cloud <= 100 THEN 5 ELSE 6 END,
 c.cloud NULLS LAST, c.item_seq) AS rn
 FROM (SELECT *, replace(trim(lower(platform)), '_', '-') AS p FROM cloudy WHERE collection = 'landsat-c2-l2') c
 JOIN (VALUES (1995, 'landsat-5'), (1996, 'landsat-7'), (1997, 'landsat-8'), (1998, 'landsat-9')) a(yr, want) ON a.yr = c.yr) z
 WHERE rn = 1"""),
    "asset_pick": sql("""SELECT collection, item_id, asset, href FROM (SELECT *, row_number() OVER (PARTITION BY collection
 ORDER BY item_seq, pr) AS rn FROM (SELECT *, CASE WHEN asset = 'other' AND href <> '' THEN 0 WHEN asset = 'map' AND href <> '' THEN 1
 WHEN asset = 'classification' AND href <> '' THEN 2 WHEN asset = 'data' AND href <> '' THEN 3
 WHEN asset = 'landcover' AND href <> '' THEN 4
 WHEN regexp_matches(href, '\\.tiff?(\\?.*)?$', 'i') THEN 100 + pos END AS pr FROM assets) z WHERE pr IS NOT NULL) y WHERE rn = 1""",
        assets="""SELECT collection, item_seq, item_id, 0 AS pos, 'thumb' AS asset, 'http://x/' || item_id || '.png' AS href FROM catalog
 UNION ALL SELECT collection, item_seq, item_id, 1, CASE ck % 4 WHEN 0 THEN 'map' WHEN 1 THEN 'data' WHEN 2 THEN 'classification' ELSE 'other' END,
 CASE WHEN ck % 6 = 0 THEN '' ELSE 'http://x/' || item_id || '/a.bin' END FROM catalog
 UNION ALL SELECT collection, item_seq, item_id, 2, 'tail', 'http://x/' || item_id || CASE WHEN item_id % 5 = 0 THEN '.TIF?sig=1' ELSE '.xml' END FROM catalog"""),
    "aoi_crop": sql("""SELECT cell_id, yr, b02, b08 FROM px WHERE c * 1000 + 500 BETWEEN 5250 AND 38500
 AND r * 1000 + 500 BETWEEN 1000 AND 31500"""),
    "mosaic_tiles": sql("""SELECT cell_id, yr, coalesce(CASE WHEN c < 30 THEN cls END, CASE WHEN c >= 20 THEN 5 - coalesce(cls, 2) END) AS cls
 FROM lulc"""),
    "stack_bands": sql("SELECT cell_id, yr, b02, b03, b04, b08, b11, b12 FROM px"),
    "pixel_sink": sql("SELECT yr, count(*) AS cells, count(cls) AS classified, sum(coalesce(cls, 0))::BIGINT AS class_sum FROM lulc GROUP BY yr"),
    "upsert_by_key": sql("""SELECT * FROM area WHERE "Year" >= 1999 UNION ALL
 SELECT "Year", "Urban_km2" + 1, "Vegetation_km2", "BareSoil_km2", "Water_km2", "Total_km2" FROM area WHERE "Year" < 1999""", **_AREA),
    "csv_report_sink": sql("SELECT * FROM area", **_AREA),
    "transition_pairs": sql("SELECT cell_id, transition_id, pre_year, post_year, pre_cls, post_cls FROM pairs"),
    "available_years": sql("SELECT DISTINCT yr FROM px WHERE yr IN (1990, 1995, 1996, 1999, 2001, 2010)"),
}
