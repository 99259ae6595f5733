"""SQL of zonal, accuracy and report queries."""

from landgrid.oracle.base import sql
from landgrid.oracle.grids import _ADJ, _COMPONENTS, from_utm_sql
from landgrid.oracle.scenes import _AREA

YEARS = range(1995, 2002)
_ZC = {
    "frame": "SELECT yr, zone_id FROM (SELECT DISTINCT yr FROM zone_px) a, (SELECT DISTINCT zone_id FROM zone_px) b",
    "zc": """SELECT f.yr, f.zone_id, count(*) FILTER (p.cls = 1) AS urban_px, count(p.cls) AS total_px
 FROM frame f LEFT JOIN zone_px p ON p.yr = f.yr AND p.zone_id = f.zone_id GROUP BY ALL""",
    "za": "SELECT zone_id, CAST(count(DISTINCT cell_id) AS DOUBLE) AS zone_area_km2 FROM zone_px GROUP BY ALL",
    "pz": """SELECT *, CASE WHEN sum(urban_px) OVER (PARTITION BY yr) > 0
 THEN urban_px / CAST(sum(urban_px) OVER (PARTITION BY yr) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS pi FROM zc""",
    "ent": """SELECT yr AS year, coalesce(-sum(pi * ln(pi)) FILTER (pi > 0), 0) AS h, count(*) AS n_zones,
 CASE WHEN count(*) > 1 THEN coalesce(-sum(pi * ln(pi)) FILTER (pi > 0), 0) / ln(CAST(count(*) AS DOUBLE)) ELSE 0 END AS hr FROM pz GROUP BY yr""",
    "ue": """SELECT a.zone_id, t.transition_id, t.pre_year, t.post_year, CAST(t.post_year - t.pre_year AS INT) AS delta_years,
 (b.urban_px - a.urban_px) / (z.zone_area_km2 * (t.post_year - t.pre_year)) * 100 AS ueii
 FROM trans t JOIN zc a ON a.yr = t.pre_year JOIN zc b ON b.yr = t.post_year AND b.zone_id = a.zone_id JOIN za z ON z.zone_id = a.zone_id""",
}
_SEC = {
    "sf": "SELECT yr, CAST(s AS INT) AS sector_id FROM (SELECT DISTINCT yr FROM sector_px) a, generate_series(1, 8) b(s)",
    "sc": """SELECT f.yr, f.sector_id, list_element(['N','NE','E','SE','S','SW','W','NW'], f.sector_id) AS sector_name,
 count(*) FILTER (p.cls = 1) AS urban_px FROM sf f LEFT JOIN sector_px p ON p.yr = f.yr AND p.sector_id = f.sector_id GROUP BY ALL""",
}
_CONF = {
    "pr": "SELECT a.yr, b.cls AS pred, a.cls AS ref FROM lulc a JOIN lulc b ON b.cell_id = a.cell_id AND b.yr = a.yr + 1",
    "lv": "SELECT CAST(p AS INT) AS pred, CAST(q AS INT) AS ref FROM generate_series(1, 4) a(p), generate_series(1, 4) b(q)",
    "cm": """SELECT y.yr, y.n_dropped, lv.pred, lv.ref, (SELECT count(*) FROM pr WHERE pr.yr = y.yr AND pr.pred = lv.pred AND pr.ref = lv.ref) AS n
 FROM (SELECT yr, count(*) FILTER (pred IS NULL OR ref IS NULL) AS n_dropped FROM pr GROUP BY yr) y, lv""",
    "tot": "SELECT yr, sum(n) AS n, sum(n) FILTER (pred = ref) / CAST(sum(n) AS DOUBLE) AS po FROM cm GROUP BY yr",
    "rows_": "SELECT yr, pred AS k, sum(n) AS n FROM cm GROUP BY ALL",
    "cols_": "SELECT yr, ref AS k, sum(n) AS n FROM cm GROUP BY ALL",
    "pe": "SELECT r.yr, sum(CAST(r.n AS DOUBLE) * c.n) / max(CAST(t.n AS DOUBLE) * t.n) AS pe FROM rows_ r JOIN cols_ c USING (yr, k) JOIN tot t ON t.yr = r.yr GROUP BY r.yr",
}

SQL = {
    "class_area": sql("SELECT yr, cls, CAST(count(*) AS DOUBLE) AS area_km2 FROM lulc WHERE cls IS NOT NULL GROUP BY ALL"),
    "area_stats": sql("SELECT * FROM area", **_AREA),
    "zone_counts": sql("SELECT yr, zone_id, urban_px, total_px FROM zc", **_ZC),
    "zone_area": sql("SELECT * FROM za", **_ZC),
    "zone_wide": sql("SELECT zone_id, (zone_id - 1) * CAST(5 AS DOUBLE) AS inner_km, zone_id * CAST(5 AS DOUBLE) AS outer_km, any_value(zone_area_km2) AS zone_area_km2, "
                     + ", ".join(f"CAST(sum(urban_px) FILTER (yr = {y}) AS BIGINT) AS urban_px_{y}, CAST(sum(urban_px) FILTER (yr = {y}) AS DOUBLE) AS urban_km2_{y}" for y in YEARS)
                     + " FROM zc JOIN za USING (zone_id) GROUP BY zone_id", **_ZC),
    "dissolve_by_id": sql("""SELECT z.zone_id, min(s.sector_id) AS first_sector, (z.zone_id - 1) * CAST(5 AS DOUBLE) AS inner_km, CAST(count(DISTINCT z.cell_id) AS DOUBLE) AS area_km2
 FROM zone_px z JOIN sector_px s ON s.cell_id = z.cell_id GROUP BY z.zone_id"""),
    "shannon_entropy": sql('SELECT year, n_zones, round(h, 6) AS "H", round(hr, 6) AS "H_rel" FROM ent', **_ZC),
    "zone_pi": sql("SELECT yr, zone_id, round(pi, 6) AS pi FROM pz", **_ZC),
    "ueii": sql("SELECT zone_id, pre_year, post_year, delta_years, round(ueii, 6) AS ueii FROM ue", **_ZC),
    "hotspots": sql("""SELECT zone_id, (zone_id - 1) * CAST(5 AS DOUBLE) AS inner_km, zone_id * CAST(5 AS DOUBLE) AS outer_km, round(ueii, 6) AS ueii FROM ue
 WHERE transition_id = 3 AND zone_id > 3 AND ueii > (SELECT avg(ueii) + coalesce(stddev_samp(ueii), 0) FROM ue WHERE transition_id = 3)""", **_ZC),
    "hotspots_first_step": sql("""SELECT zone_id, (zone_id - 1) * CAST(5 AS DOUBLE) AS inner_km, zone_id * CAST(5 AS DOUBLE) AS outer_km, round(ueii, 6) AS ueii FROM ue
 WHERE transition_id = 1 AND ueii > (SELECT avg(ueii) + coalesce(stddev_samp(ueii), 0) FROM ue WHERE transition_id = 1)""", **_ZC),
    "sector_counts": sql("SELECT *, CAST(urban_px AS DOUBLE) AS urban_km2 FROM sc", **_SEC),
    "directional_growth": sql("""SELECT a.sector_name AS sector, CAST(a.urban_px AS DOUBLE) AS urban_km2_t0, CAST(b.urban_px AS DOUBLE) AS urban_km2_t1,
 round(CASE WHEN a.urban_px > 0 THEN (b.urban_px - a.urban_px) / CAST(a.urban_px AS DOUBLE) * 100 END, 6) AS growth_pct
 FROM sc a JOIN sc b USING (sector_id) WHERE a.yr = 1995 AND b.yr = 2001""", **_SEC),
    "confusion_matrix": sql("SELECT yr, n_dropped, pred, ref, n FROM cm", **_CONF),
    "accuracy_report": sql("""SELECT yr, metric, round(value, 6) AS value FROM (
 SELECT yr, 'OA' AS metric, po AS value FROM tot UNION ALL SELECT yr, 'Kappa', (po - pe) / (1 - pe) FROM tot JOIN pe USING (yr)
 UNION ALL SELECT c.yr, 'PA_' || c.ref, c.n / CAST(nullif(k.n, 0) AS DOUBLE) FROM cm c JOIN cols_ k ON k.yr = c.yr AND k.k = c.ref WHERE c.pred = c.ref
 UNION ALL SELECT c.yr, 'UA_' || c.ref, c.n / CAST(nullif(k.n, 0) AS DOUBLE) FROM cm c JOIN rows_ k ON k.yr = c.yr AND k.k = c.ref WHERE c.pred = c.ref) z""", **_CONF),
    "binary_metrics": sql("""SELECT *, round(p, 6) AS "Precision", round(q, 6) AS "Recall", round(2 * p * q / (p + q + 1e-9), 6) AS "F1",
 round("TP" / ("TP" + "FP" + "FN" + 1e-9), 6) AS "IoU" FROM (SELECT *, "TP" / ("TP" + "FP" + 1e-9) AS p, "TP" / ("TP" + "FN" + 1e-9) AS q FROM
 (SELECT c.transition_id, count(*) FILTER (pb >= 5e-1 AND change = 1) AS "TP", count(*) FILTER (pb >= 5e-1 AND change = 0) AS "FP",
 count(*) FILTER (pb < 5e-1 AND change = 1) AS "FN", count(*) FILTER (pb < 5e-1 AND change = 0) AS "TN"
 FROM changes c JOIN (SELECT cell_id, yr, (b08 % 97) / 97e0 AS pb FROM base WHERE ok % 13 <> 0) b ON b.cell_id = c.cell_id AND b.yr = c.post_year
 WHERE change IS NOT NULL GROUP BY ALL) z) y""".replace("SELECT *, round(p, 6)", 'SELECT transition_id, "TP", "FP", "FN", "TN", round(p, 6)')),
    "min_samples_check": sql("SELECT yr, cls, count(*) AS n FROM lulc WHERE cls IS NOT NULL GROUP BY ALL HAVING count(*) < 200"),
    "quality_checks": sql("""SELECT l.yr, l.sensor, l.layer, round(1 - count(l.v) / CAST(count(*) AS DOUBLE), 6) AS null_share, any_value(round(a, 6)) AS min_ndvi,
 any_value(round(b, 6)) AS max_ndvi, any_value(round(d, 6)) AS min_ndbi, any_value(round(e, 6)) AS max_ndbi, any_value(round(m, 6)) AS min_reflectance
 FROM feat_long l JOIN (SELECT yr, sensor, min(ndvi) AS a, max(ndvi) AS b, min(ndbi) AS d, max(ndbi) AS e,
 least(min(b02), min(b03), min(b04), min(b08), min(b11), min(b12)) AS m FROM feat GROUP BY ALL) q USING (yr, sensor) GROUP BY l.yr, l.sensor, l.layer"""),
    "class_histogram": sql("SELECT yr, cls, count(*) AS n FROM lulc WHERE cls BETWEEN 1 AND 4 GROUP BY ALL"),
    "growth_trajectory": sql('SELECT "Year", "Urban_km2", round("Urban_km2", 1) AS label FROM area', **_AREA),
    "entropy_trend": sql("""SELECT year, round(hr, 3) AS "H_rel", CASE WHEN hr >= 7e-1 THEN 'high' WHEN hr >= 5e-1 THEN 'moderate' ELSE 'low' END AS band FROM ent""", **_ZC),
    "landscape_long": sql("""SELECT year, metric, round(value, 6) AS value FROM (SELECT pm.yr AS year, unnest(['PD', 'LPI', 'ED']) AS metric,
 unnest(["PD", "LPI", "ED"]) AS value FROM pm JOIN bm USING (yr)) z""", **_COMPONENTS, **_ADJ),
    "hotspots_latest_ueii": sql("""SELECT zone_id, 'Sprawl hotspot (zone ' || zone_id || ')<br>UEII: ' || coalesce(printf('%.2f', round(ueii, 2)), '—') || ' % / yr' AS popup
 FROM ue WHERE post_year = (SELECT max(post_year) FROM ue)""", **_ZC),
    "ring_labels": sql("SELECT zone_id, 'Zone ' || zone_id || '<br>Ring: ' || (zone_id - 1) * 5 || '–' || zone_id * 5 || ' km' AS label FROM za", **_ZC),
    "dashboard_layers": sql("SELECT l.r, l.c, l.cls, g.change, g2.lon, g2.lat FROM lc l LEFT JOIN gc g USING (r, c) JOIN geo g2 USING (r, c)",
        lc="""SELECT r, c, cls FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY cls IS NULL, k DESC, cls) AS rn FROM
 (SELECT r // 4 AS r, c // 4 AS c, cls, count(*) AS k FROM lulc WHERE yr = 2001 GROUP BY ALL) z) y WHERE rn = 1""",
        gc="""SELECT r, c, change FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY change IS NULL, k DESC, change) AS rn FROM
 (SELECT a.r // 4 AS r, a.c // 4 AS c, CAST(CASE WHEN a.cls = 1 OR b.cls <> 1 THEN 0 WHEN a.cls IS NULL OR b.cls IS NULL THEN NULL ELSE 1 END AS INT) AS change,
 count(*) AS k FROM lulc a JOIN lulc b ON b.cell_id = a.cell_id AND b.yr = 2001 WHERE a.yr = 1995 GROUP BY ALL) z) y WHERE rn = 1""",
        geo=from_utm_sql("SELECT r, c, 280000 + (c + 5e-1) * 4000 AS x, 9850000 + (r + 5e-1) * 4000 AS y FROM lc")),
    "dashboard_extent": sql("SELECT min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, max(lat) AS lat_max FROM geo",
        lim="SELECT min(r // 4) AS r0, max(r // 4) + 1 AS r1, min(c // 4) AS c0, max(c // 4) + 1 AS c1 FROM lulc WHERE yr = 2001",
        rim="""SELECT r, c FROM lim, (SELECT unnest(range(0, 100000)) AS r) a, (SELECT unnest(range(0, 14)) AS c) b
 WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 AND (r IN (r0, r1) OR c IN (c0, c1))""",
        geo=from_utm_sql("SELECT r, c, 280000 + c * 4e3 AS x, 9850000 + r * 4e3 AS y FROM rim")),
    "change_overlay": sql("""SELECT cell_id, transition_id, pre_cls AS cls, CASE WHEN change = 1 THEN 1 END AS new_urban, CASE pre_cls WHEN 1 THEN 'Urban'
 WHEN 2 THEN 'Vegetation' WHEN 3 THEN 'Bare Soil' WHEN 4 THEN 'Water' END AS label FROM changes"""),
}
