"""SQL of per-pixel map algebra."""

from landgrid.oracle.base import BANDS, FEATURES, sql

_B = ", ".join(BANDS)


def _index(name: str) -> str:
    return sql(f"SELECT cell_id, yr, round({name}, 6) AS {name} FROM feat")


_DENORM = sql("""SELECT cell_id, yr, round(max(v) FILTER (layer = 'ndvi'), 6) AS raw_ndvi,
 round(max(v) FILTER (layer = 'mndwi'), 6) AS raw_mndwi FROM norm_long GROUP BY cell_id, yr""")

_RULED = """SELECT l.cell_id, l.r, l.c, l.yr, l.cls, CASE WHEN f.ndvi > 6e-1 THEN 2 WHEN f.mndwi > 3e-1 THEN 4 ELSE l.cls END AS ruled
 FROM lulc l LEFT JOIN feat f ON f.cell_id = l.cell_id AND f.yr = l.yr"""

SQL = {
    "mask_scl": sql("SELECT cell_id, yr, " + ", ".join(
        f"CASE WHEN scl BETWEEN 4 AND 7 THEN {b} END AS {b}" for b in BANDS)
        + " FROM px WHERE sensor = 'sentinel'"),
    "mask_qa": sql("SELECT cell_id, yr, " + ", ".join(
        f"CASE WHEN (qa & 2) = 0 AND (qa & 8) = 0 AND (qa & 16) = 0 AND (qa & 32) = 0 THEN {b} END AS {b}" for b in BANDS)
        + " FROM px WHERE sensor = 'landsat'"),
    "scale_s2": sql("SELECT cell_id, yr, " + ", ".join(
        f"CASE WHEN {b} / 1e4 > 1 THEN CAST(1 AS DOUBLE) WHEN {b} < 0 THEN 0 ELSE {b} / 1e4 END AS {b}" for b in BANDS)
        + " FROM px WHERE sensor = 'sentinel'"),
    "scale_landsat": sql("SELECT cell_id, yr, " + ", ".join(
        f"CASE WHEN {b} * 2.75e-5 - 2e-1 > 1 THEN CAST(1 AS DOUBLE) WHEN {b} * 2.75e-5 - 2e-1 < 0 THEN 0 ELSE {b} * 2.75e-5 - 2e-1 END AS {b}" for b in BANDS)
        + " FROM px WHERE sensor = 'landsat'"),
    "idx_ndvi": _index("ndvi"), "idx_ndbi": _index("ndbi"), "idx_mndwi": _index("mndwi"),
    "idx_nbi": _index("nbi"), "idx_bsi": _index("bsi"),
    "feature_stack": sql("SELECT cell_id, r, c, yr, sensor, " + ", ".join(
        f"round({n}, 6) AS {n}" for n in FEATURES) + " FROM feat"),
    "canonical_bands": sql(f"SELECT cell_id, yr, {_B} FROM px WHERE sensor = 'landsat'"),
    "minmax_params": sql("SELECT year, sensor, layer, round(min, 6) AS min, round(max, 6) AS max FROM norm_params"),
    "minmax_normalize": sql("SELECT cell_id, yr, sensor, " + ", ".join(
        f"round({n}, 6) AS {n}" for n in FEATURES) + " FROM feat_norm"),
    "denormalize": _DENORM,
    "spectral_rules": sql(f"SELECT cell_id, yr, ruled AS cls FROM ({_RULED}) z"),
    "remap_worldcover": sql("""SELECT cell_id, CASE WHEN code = 50 THEN 1 WHEN code IN (60, 70) THEN 3 WHEN code = 80 THEN 4
 WHEN code IN (10, 20, 30, 40, 90, 95, 96) THEN 2 END AS cls FROM land_cover"""),
    "remap_globeland30": sql("""SELECT cell_id, CASE WHEN code = 80 THEN 1 WHEN code = 90 THEN 3 WHEN code = 60 THEN 4
 WHEN code IN (10, 20, 30, 40, 50, 70, 100) THEN 2 END AS cls FROM land_cover"""),
    "clamp_class": sql("""SELECT cell_id, CAST(CASE WHEN round(pop / 8 + 25e-2) < 1 THEN 1 WHEN round(pop / 8 + 25e-2) > 4 THEN 4
 ELSE round(pop / 8 + 25e-2) END AS INT) AS cls FROM land_cover"""),
    "sanitize_lulc": sql("""SELECT cell_id, yr, code AS cls, CASE code WHEN 0 THEN 'Other/NoData' WHEN 1 THEN 'Urban'
 WHEN 2 THEN 'Vegetation' WHEN 3 THEN 'Bare Soil' WHEN 4 THEN 'Water' END AS label FROM
 (SELECT cell_id, yr, CASE WHEN cls IS NULL THEN NULL WHEN cls * 2 - 1 > 4 THEN 0 ELSE cls * 2 - 1 END AS code FROM lulc) z"""),
    "change_ref": sql("SELECT cell_id, pre_year, post_year, change FROM changes"),
    "growth_binary": sql("""SELECT r, c, CASE WHEN a = 1 OR b <> 1 THEN 0 WHEN a IS NULL OR b IS NULL THEN NULL ELSE 1 END AS growth FROM
 (SELECT t.tr AS r, t.tc AS c, x.cls AS a, y.cls AS b FROM
 (SELECT DISTINCT r // 2 AS tr, c // 2 AS tc FROM lulc WHERE yr = 1995) t
 JOIN lulc x ON x.yr = 1995 AND x.r = t.tr * 2 + 1 AND x.c = t.tc * 2 + 1
 JOIN lulc y ON y.yr = 2001 AND y.r = t.tr * 2 + 1 AND y.c = t.tc * 2 + 1) z"""),
    "new_urban_overlay": sql("SELECT cell_id, pre_year, post_year, change FROM changes WHERE change = 1"),
    "ndvi_loss": sql("""SELECT a.cell_id, round(CASE WHEN a.ndvi - b.ndvi < 0 THEN 0 ELSE a.ndvi - b.ndvi END, 6) AS ndvi_loss
 FROM feat_norm a JOIN feat_norm b USING (cell_id) WHERE a.yr = 1995 AND b.yr = 2001"""),
    "pop_density": sql("SELECT cell_id, round(pop / 1, 6) AS pop_density FROM land_cover"),
    "dist_to_point": sql("""SELECT DISTINCT cell_id, round(sqrt(CAST((c*1000+500-25000)*(c*1000+500-25000)
 + (r*1000+500-20000)*(r*1000+500-20000) AS DOUBLE)), 6) AS dist FROM lulc"""),
    "ring_zone": sql("SELECT cell_id, yr, zone_id, CAST((zone_id - 1) * 5 AS DOUBLE) AS inner_km, CAST(zone_id * 5 AS DOUBLE) AS outer_km FROM zone_px"),
    "sector_zone": sql("""SELECT cell_id, yr, sector_id, CASE sector_id WHEN 1 THEN 'N' WHEN 2 THEN 'NE' WHEN 3 THEN 'E' WHEN 4 THEN 'SE'
 WHEN 5 THEN 'S' WHEN 6 THEN 'SW' WHEN 7 THEN 'W' ELSE 'NW' END AS sector_name FROM sector_px"""),
    "ring_zone_touch": sql("""SELECT cell_id, yr, CAST(k AS BIGINT) AS zone_id FROM (SELECT *,
 (CASE WHEN c >= 25 THEN c * 1000 - 25000 ELSE 25000 - (c + 1) * 1000 END) AS nx, (CASE WHEN c >= 25 THEN (c + 1) * 1000 - 25000 ELSE 25000 - c * 1000 END) AS fx,
 (CASE WHEN r >= 20 THEN r * 1000 - 20000 ELSE 20000 - (r + 1) * 1000 END) AS ny, (CASE WHEN r >= 20 THEN (r + 1) * 1000 - 20000 ELSE 20000 - r * 1000 END) AS fy
 FROM lulc) z JOIN generate_series(1, 6) g(k) ON nx * nx + ny * ny <= k * 5000 * k * 5000 AND (k = 1 OR fx * fx + fy * fy > (k - 1) * 5000 * (k - 1) * 5000)"""),
    "entropy_band": sql("""SELECT yr AS year, CASE WHEN h >= 7e-1 THEN 'high' WHEN h >= 5e-1 THEN 'moderate' ELSE 'low' END AS band
 FROM (SELECT yr, -sum(p * ln(p)) FILTER (p > 0) / ln(CAST(nullif(count(*), 1) AS DOUBLE)) AS h FROM
 (SELECT yr, zone_id, count(*) FILTER (cls = 1) / CAST(sum(count(*) FILTER (cls = 1)) OVER (PARTITION BY yr) AS DOUBLE) AS p
 FROM zone_px GROUP BY yr, zone_id) z GROUP BY yr) y"""),
}
