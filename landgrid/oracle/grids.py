"""SQL of grid geometry, neighbourhood and patch queries."""

import math

from landgrid.oracle.base import FEATURES, sql


def _d(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def _utm() -> str:
    """Transverse Mercator with Krueger's series written out step by step."""
    a, inv = 6378249.145, 293.465
    f = 1 / inv
    e2 = f * (2 - f)
    wa, winv = 6378137.0, 298.257223563
    wf = 1 / winv
    we2 = wf * (2 - wf)
    n = f / (2 - f)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    big = 0.9996 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    b, ep2 = a * (1 - f), e2 / (1 - e2)
    k = math.sqrt(e2)
    steps = [
        "SELECT DISTINCT cell_id, radians(366e-1 + c / 100e0) AS lo, radians(-15e-1 + (r % 40) / 100e0) AS la FROM lulc",
        f"SELECT *, {_d(wa)} / sqrt(1 - {_d(we2)} * sin(la) ** 2) AS nu FROM ({{p}})",
        f"SELECT *, nu * cos(la) * cos(lo) + 160 AS gx, nu * cos(la) * sin(lo) + 6 AS gy, nu * (1 - {_d(we2)}) * sin(la) + 302 AS gz FROM ({{p}})",
        f"SELECT *, sqrt(gx * gx + gy * gy) AS p, atan2(gz * {_d(a)}, sqrt(gx * gx + gy * gy) * {_d(b)}) AS th FROM ({{p}})",
        f"""SELECT cell_id, lo, la, atan2(gy, gx) - radians(39) AS dl, atan2(gz + {_d(ep2 * b)} * sin(th) ** 3, p - {_d(e2 * a)} * cos(th) ** 3) AS ph FROM ({{p}})""",
        f"""SELECT *, tan(ph) AS tp, {_d(k)} * atanh({_d(k)} * sin(ph)) AS kk FROM ({{p}})""",
        """SELECT *, sinh(asinh(tp) - kk) AS t FROM ({p})""",
        "SELECT *, atan2(t, cos(dl)) AS xi, asinh(sin(dl) / sqrt(t * t + cos(dl) ** 2)) AS et FROM ({p})",
        "SELECT cell_id, lo, la, "
        + "xi + " + " + ".join(f"{_d(x)} * sin({2*j} * xi) * cosh({2*j} * et)" for j, x in enumerate(al, 1)) + " AS nn, "
        + "et + " + " + ".join(f"{_d(x)} * cos({2*j} * xi) * sinh({2*j} * et)" for j, x in enumerate(al, 1)) + " AS ee FROM ({p})",
        f"SELECT cell_id, round(500000 + {_d(big)} * ee, 3) AS x, round(10000000 + {_d(big)} * nn, 3) AS y, round(degrees(lo), 7) AS lon, round(degrees(la), 7) AS lat FROM ({{p}})",
    ]
    text = steps[0]
    for s in steps[1:]:
        text = s.replace("{p}", text)
    return text


_NEIGH8 = "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1"

_COMPONENTS = {
    "urban": "SELECT yr, cell_id, r, c FROM lulc WHERE cls = 1",
    "links": f"SELECT a.yr, a.cell_id AS a, b.cell_id AS b FROM urban a JOIN urban b ON a.yr = b.yr AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1",
    "reach": "SELECT yr, a, b FROM links UNION SELECT x.yr, x.a, l.b FROM reach x JOIN links l ON l.yr = x.yr AND l.a = x.b",
    "comp": "SELECT yr, a AS cell_id, min(b) AS component FROM reach GROUP BY ALL",
    "sizes": "SELECT yr, component, count(*) AS k FROM comp GROUP BY ALL",
    "land": "SELECT yr, count(cls) AS cells FROM lulc GROUP BY yr",
    "pm": """SELECT l.yr, count(k) / CAST(any_value(cells) AS DOUBLE) AS "PD", 100 * max(k) / CAST(any_value(cells) AS DOUBLE) AS "LPI",
 avg(k) * 100 AS "MPA" FROM land l LEFT JOIN sizes s ON s.yr = l.yr GROUP BY l.yr""",
}
_ADJ = {
    "adj": """SELECT a.yr, count(*) FILTER (a.cls = 1 AND b.cls = 1) AS lik,
 count(*) FILTER ((a.cls = 1) <> (b.cls = 1)) AS edg FROM lulc a JOIN lulc b ON a.yr = b.yr
 AND ((b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1)) WHERE a.cls IS NOT NULL AND b.cls IS NOT NULL GROUP BY a.yr""",
    "cnt": "SELECT yr, count(cls) AS cells, count(*) FILTER (cls = 1) AS u FROM lulc GROUP BY yr",
    "bm": """SELECT yr, edg * 1000 * 1e4 / (cells * 1e6) AS "ED", 100.0 * lik / CAST(CASE WHEN u = n * n THEN 2 * n * (n - 1)
 WHEN u - n * n <= n THEN 2 * n * (n - 1) + 2 * (u - n * n) - 1 ELSE 2 * n * (n - 1) + 2 * (u - n * n) - 2 END AS DOUBLE) AS "AI"
 FROM (SELECT *, CAST(floor(sqrt(u)) AS BIGINT) AS n FROM cnt) z JOIN adj USING (yr)""",
}

_WINDOWS = {
    "cpair": "SELECT a.cell_id, a.r, a.c, t.transition_id, " + ", ".join(
        f"a.{f} AS pre_{f}, b.{f} AS post_{f}" for f in FEATURES)
        + ", x.change FROM trans t JOIN chan a ON a.yr = t.pre_year JOIN chan b ON b.yr = t.post_year AND b.cell_id = a.cell_id"
          " JOIN changes x ON x.cell_id = a.cell_id AND x.transition_id = t.transition_id",
    "orig": "SELECT DISTINCT r - r % 4 AS r0, c - c % 4 AS c0 FROM lulc",
    "win": """SELECT p.transition_id, o.r0, o.c0, count(*) AS n,
 CAST(avg(change) FILTER (r - r0 BETWEEN 3 AND 4 AND c - c0 BETWEEN 3 AND 4) >= 1e-1 AS INT) AS y,
 string_agg(CAST(round(pre_b04 * 10000) AS BIGINT)::VARCHAR, ',' ORDER BY r, c) AS pre,
 string_agg(CAST(round(post_b04 * 10000) AS BIGINT)::VARCHAR, ',' ORDER BY r, c) AS post, avg(pre_ndvi) AS prob
 FROM orig o JOIN cpair p ON p.r BETWEEN o.r0 AND o.r0 + 7 AND p.c BETWEEN o.c0 AND o.c0 + 7
 GROUP BY p.transition_id, o.r0, o.c0 HAVING count(*) = 64""",
    "blocked": """SELECT w.*, CAST((least(greatest(ceil(4 * (r0 + 5) / CAST(nr AS DOUBLE)), 1), 4) - 1) * 4
 + least(greatest(ceil(4 * (c0 + 5) / CAST(nc AS DOUBLE)), 1), 4) AS INT) AS block,
 transition_id || '-' || r0 || '-' || c0 AS patch_id FROM win w, grid_size""",
}


def windows(body: str, **extra: str) -> str:
    return sql(body, **_WINDOWS, **extra)


SQL = {
    "project_utm": sql(_utm()),
    "cell_xy": sql("SELECT cell_id, yr, CAST(c * 1000 + 500 AS DOUBLE) AS x, CAST(r * 1000 + 500 AS DOUBLE) AS y FROM lulc"),
    "resample_bilinear": sql("""SELECT r, c, round(sum(w * elev) / sum(w) FILTER (elev IS NOT NULL), 6) AS elev,
 round(sum(w * pop) / sum(w) FILTER (pop IS NOT NULL), 6) AS pop FROM
 (SELECT t.r, t.c, s.elev, s.pop, (1 - abs(t.x - (s.c * 1000 + 500)) / 1e3) * (1 - abs(t.y - (s.r * 1000 + 500)) / 1e3) AS w
 FROM (SELECT i AS r, j AS c, 150 + (j + 5e-1) * 800 AS x, -100 + (i + 5e-1) * 800 AS y FROM
 generate_series(0, (SELECT CAST(floor(nr * 125e-2) AS BIGINT) - 1 FROM grid_size)) a(i), generate_series(0, 61) b(j)) t
 JOIN land_cover s ON s.c BETWEEN CAST(floor((t.x - 500) / 1000) AS BIGINT) AND CAST(floor((t.x - 500) / 1000) AS BIGINT) + 1
 AND s.r BETWEEN CAST(floor((t.y - 500) / 1000) AS BIGINT) AND CAST(floor((t.y - 500) / 1000) AS BIGINT) + 1) z WHERE w > 0 GROUP BY r, c"""),
    "resample_nearest": sql("""SELECT yr, t.r, t.c, cls FROM (SELECT i AS r, j AS c FROM
 generate_series(0, (SELECT CAST(floor(nr / 7e-1) AS BIGINT) - 1 FROM grid_size)) a(i), generate_series(0, 70) b(j)) t
 JOIN lulc s ON s.r = (t.r * 700 + 350) // 1000 AND s.c = (t.c * 700 + 350) // 1000"""),
    "aggregate_modal": sql("""SELECT yr, r, c, cls FROM (SELECT *, row_number() OVER (PARTITION BY yr, r, c
 ORDER BY CASE WHEN cls IS NULL THEN 1 ELSE 0 END, k DESC, cls) AS rn FROM
 (SELECT yr, r // 8 AS r, c // 8 AS c, cls, count(*) AS k FROM lulc GROUP BY ALL) z) y WHERE rn = 1"""),
    "focal_majority": sql("""SELECT l.cell_id, l.yr, m.cls FROM lulc l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY yr, cell_id
 ORDER BY k DESC, cls) AS rn FROM (SELECT a.yr, a.cell_id, b.cls, count(*) AS k FROM lulc a JOIN lulc b ON a.yr = b.yr
 AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 WHERE b.cls IS NOT NULL GROUP BY ALL) z) m
 ON m.yr = l.yr AND m.cell_id = l.cell_id AND m.rn = 1"""),
    "slope_deg": sql("""SELECT m.cell_id, round(degrees(atan(sqrt(power(((ne.elev + 2 * e.elev + se.elev) - (nw.elev + 2 * w.elev + sw.elev)) / 8e3, 2)
 + power(((sw.elev + 2 * s.elev + se.elev) - (nw.elev + 2 * n.elev + ne.elev)) / 8e3, 2)))), 6) AS slope FROM land_cover m """ + " ".join(
        f"LEFT JOIN land_cover {n} ON {n}.r = m.r + ({dr}) AND {n}.c = m.c + ({dc})" for n, dr, dc in
        (("nw", -1, -1), ("n", -1, 0), ("ne", -1, 1), ("w", 0, -1), ("e", 0, 1), ("sw", 1, -1), ("s", 1, 0), ("se", 1, 1)))),
    "distance_transform": sql("""SELECT a.cell_id, a.yr, round(coalesce(sqrt(CAST(min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS DOUBLE)) * 1000, 50000), 6) AS dist
 FROM lulc a LEFT JOIN lulc b ON a.yr = b.yr AND b.cls = 1 GROUP BY a.cell_id, a.yr"""),
    "rasterize_lines": sql("""SELECT DISTINCT g.r, g.c FROM (SELECT i AS r, j AS c FROM generate_series(0, (SELECT nr - 1 FROM grid_size)) a(i),
 generate_series(0, 49) b(j)) g JOIN roads s ON s.x1 < (g.c + 1) * 1000 AND s.x2 >= g.c * 1000
 AND floor((s.y1 + (s.y2 - s.y1) * (greatest(s.x1, g.c * 1000) - s.x1) / (s.x2 - s.x1)) / 1000) <= g.r
 AND floor((s.y1 + (s.y2 - s.y1) * (least(s.x2, (g.c + 1) * 1000) - s.x1) / (s.x2 - s.x1)) / 1000) >= g.r"""),
    "rasterize_zone_field": sql("""SELECT z.cell_id, z.yr, round(u / CAST(sum(u) OVER (PARTITION BY z.yr, 1) AS DOUBLE), 6) AS pi FROM zone_px z
 JOIN (SELECT yr, zone_id, count(*) FILTER (cls = 1) AS u FROM zone_px GROUP BY ALL) q USING (yr, zone_id)""".replace(
        "round(u / CAST(sum(u) OVER (PARTITION BY z.yr, 1) AS DOUBLE), 6)",
        "round(u / CAST((SELECT count(*) FROM zone_px t WHERE t.yr = z.yr AND t.cls = 1) AS DOUBLE), 6)")),
    "rasterize_points_mean": sql("""SELECT CAST(floor(y / 1000) AS BIGINT) AS r, CAST(floor(x / 1000) AS BIGINT) AS c, round(avg(v), 6) AS mean_v FROM
 (SELECT x1 AS x, y1 AS y, y2 - y1 AS v FROM roads UNION ALL SELECT x2, y2, x2 - x1 FROM roads) z GROUP BY ALL"""),
    "extract_at_points": sql("""SELECT s.seg_id, f.cell_id, round(f.ndvi, 6) AS ndvi, round(f.b08, 6) AS b08 FROM roads s
 LEFT JOIN feat f ON f.yr = 2001 AND s.x1 = f.c * 1000 + 500 AND s.y1 = f.r * 1000 + 500"""),
    "extract_at_polygons": sql("""SELECT s.seg_id, f.cell_id, round(px, 6) AS x, round(py, 6) AS y, round(f.ndvi, 6) AS ndvi FROM
 (SELECT seg_id, CAST(x1 AS DOUBLE) + CASE seg_id % 3 WHEN 0 THEN 2250 ELSE 500 END AS px, CAST(y1 AS DOUBLE) + 2000 AS py FROM roads) s
 LEFT JOIN feat f ON f.yr = 2001 AND f.c = floor(px / 1000) AND f.r = floor(py / 1000)"""),
    "extract_at_degrees": sql(f"""SELECT u.cell_id, u.r, u.c, l.cls FROM (SELECT cell_id, CAST(floor((y - 9770000) / 1000) AS BIGINT) AS r,
 CAST(floor((x - 230000) / 1000) AS BIGINT) AS c FROM ({_utm()}) z) u LEFT JOIN lulc l ON l.yr = 2001 AND l.r = u.r AND l.c = u.c"""),
    "compare_geom": sql("""SELECT a.k = b.k AND a.r0 = b.r0 AND a.r1 = b.r1 AND a.c0 = b.c0 AND a.c1 = b.c1 AS same, a.k AS cells_a, b.k AS cells_b FROM
 (SELECT count(*) AS k, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM lulc WHERE yr = 1995) a,
 (SELECT count(*) AS k, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM lulc WHERE yr = 2001) b"""),
    "tile_grid": sql("""SELECT yr, CAST(floor((r + 5e-1) / (nr / 2e0)) AS INT) AS tile_r, CAST(floor((c + 5e-1) / (nc / 3e0)) AS INT) AS tile_c,
 count(*) AS cells FROM lulc, grid_size GROUP BY ALL"""),
    "connected_components": sql("SELECT cell_id, yr, component FROM comp", **_COMPONENTS),
    "sieve_small": sql("""SELECT f.cell_id, f.yr, CASE WHEN f.change = 1 AND s.k < 9 THEN 0 ELSE f.change END AS change
 FROM flag f LEFT JOIN comp c ON c.yr = f.yr AND c.cell_id = f.cell_id LEFT JOIN sizes s ON s.yr = c.yr AND s.component = c.component""",
        flag="""SELECT l.cell_id, l.r, l.c, l.yr, CASE WHEN l.cls = 4 THEN 0 WHEN b.ok % 13 = 0 THEN NULL WHEN (b.b08 % 97) * 2 > 97 THEN 1 ELSE 0 END AS change
 FROM lulc l JOIN base b ON b.cell_id = l.cell_id AND b.yr = l.yr""",
        hot="SELECT yr, cell_id, r, c FROM flag WHERE change = 1",
        links="""SELECT a.yr, a.cell_id AS a, b.cell_id AS b FROM hot a JOIN hot b ON a.yr = b.yr AND b.r BETWEEN a.r - 1 AND a.r + 1
 AND abs(a.r - b.r) + abs(a.c - b.c) <= 1""",
        reach=_COMPONENTS["reach"], comp=_COMPONENTS["comp"], sizes=_COMPONENTS["sizes"]),
    "patch_windows": windows("SELECT transition_id, r0, c0, pre, post FROM win"),
    "patch_label": windows("SELECT transition_id, r0, c0, y FROM win"),
    "block_split_id": windows("SELECT transition_id, r0, c0, block FROM blocked"),
    "sliding_window_mean": windows("""SELECT p.transition_id, p.cell_id, round(avg(w.prob), 6) AS prob FROM cpair p LEFT JOIN win w
 ON w.transition_id = p.transition_id AND p.r BETWEEN w.r0 AND w.r0 + 7 AND p.c BETWEEN w.c0 AND w.c0 + 7 GROUP BY ALL"""),
    "patch_density": sql('SELECT yr, round("PD", 6) AS "PD" FROM pm', **_COMPONENTS),
    "largest_patch_index": sql('SELECT yr, round("LPI", 6) AS "LPI" FROM pm', **_COMPONENTS),
    "mean_patch_area": sql('SELECT yr, round("MPA", 6) AS "MPA" FROM pm', **_COMPONENTS),
    "edge_density": sql('SELECT yr, round("ED", 6) AS "ED" FROM bm', **_ADJ),
    "aggregation_index": sql('SELECT yr, round("AI", 6) AS "AI" FROM bm', **_ADJ),
    "landscape_metrics": sql("""SELECT pm.yr AS year, round("PD", 6) AS "PD", round("LPI", 6) AS "LPI", round("ED", 6) AS "ED",
 round("AI", 6) AS "AI", round("MPA", 6) AS "MPA" FROM pm JOIN bm USING (yr)""", **_COMPONENTS, **_ADJ),
}


def from_utm_sql(source: str) -> str:
    """(r, c, x, y) to (r, c, lon, lat): the inverse series, then the datum shift."""
    a, inv = 6378249.145, 293.465
    f = 1 / inv
    e2 = f * (2 - f)
    n = f / (2 - f)
    wa, wf = 6378137.0, 1 / 298.257223563
    wb, we2 = wa * (1 - wf), wf * (2 - wf)
    be = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    de = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    big = 0.9996 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    steps = [
        f"SELECT r, c, (y - 10000000) / {_d(big)} AS xi, (x - 500000) / {_d(big)} AS et FROM ({source})",
        "SELECT r, c, " + "xi - " + " - ".join(f"{_d(v)} * sin({2*j} * xi) * cosh({2*j} * et)" for j, v in enumerate(be, 1)) + " AS x0, et - "
        + " - ".join(f"{_d(v)} * cos({2*j} * xi) * sinh({2*j} * et)" for j, v in enumerate(be, 1)) + " AS e0 FROM ({p})",
        "SELECT r, c, asin(sin(x0) / cosh(e0)) AS chi, radians(39) + atan2(sinh(e0), cos(x0)) AS lo FROM ({p})",
        "SELECT r, c, lo, chi + " + " + ".join(f"{_d(v)} * sin({2*j} * chi)" for j, v in enumerate(de, 1)) + " AS la FROM ({p})",
        f"SELECT *, {_d(a)} / sqrt(1 - {_d(e2)} * sin(la) ** 2) AS nu FROM ({{p}})",
        f"SELECT r, c, nu * cos(la) * cos(lo) - 160 AS gx, nu * cos(la) * sin(lo) - 6 AS gy, nu * (1 - {_d(e2)}) * sin(la) - 302 AS gz FROM ({{p}})",
        f"SELECT *, sqrt(gx * gx + gy * gy) AS p, atan2(gz * {_d(wa)}, sqrt(gx * gx + gy * gy) * {_d(wb)}) AS th FROM ({{p}})",
        f"SELECT r, c, round(degrees(atan2(gy, gx)), 7) AS lon, round(degrees(atan2(gz + {_d(we2 / (1 - we2) * wb)} * sin(th) ** 3, p - {_d(we2 * wa)} * cos(th) ** 3)), 7) AS lat FROM ({{p}})",
    ]
    text = steps[0]
    for s in steps[1:]:
        text = s.replace("{p}", text)
    return text
