"""Shared common table expressions; :func:`sql` prepends the ones a statement uses."""

from __future__ import annotations

import re

from landgrid.oracle.solve import ONCE

BANDS = ("b02", "b03", "b04", "b08", "b11", "b12")
FEATURES = BANDS + ("ndvi", "ndbi", "mndwi", "nbi", "bsi")

INDEX_SQL = """(b08 - b04) / (b08 + b04 + 1e-6) AS ndvi, (b11 - b08) / (b11 + b08 + 1e-6) AS ndbi,
 (b03 - b11) / (b03 + b11 + 1e-6) AS mndwi, b04 * b11 / (b08 + 1e-6) AS nbi,
 ((b11 + b04) - (b08 + b02)) / ((b11 + b04) + (b08 + b02) + 1e-6) AS bsi"""


def _each(fmt: str, names=BANDS, sep: str = ", ") -> str:
    return sep.join(fmt.format(b=b) for b in names)


CTES: dict[str, str] = {
    "obs": """SELECT l_partkey AS cell_id, CAST(floor(l_partkey / 50) AS BIGINT) AS r, l_partkey % 50 AS c,
 CAST(year(l_shipdate) AS INT) AS yr,
 CASE WHEN year(l_shipdate) <= 1997 THEN 'landsat' ELSE 'sentinel' END AS sensor,
 l_suppkey AS sk, CAST(l_linenumber AS BIGINT) AS ln, l_orderkey AS ok,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS e, CAST(round(l_quantity) AS BIGINT) AS q,
 CAST(round(l_discount * 100) AS BIGINT) AS dsc, CAST(round(l_tax * 100) AS BIGINT) AS tx FROM lineitem""",
    "scene": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, yr
 ORDER BY dsc, e, ok, ln, sk, q, tx) AS rn FROM obs) z WHERE rn = 1""",
    "base": """SELECT cell_id, r, c, yr, sensor, ok,
 CASE WHEN ok % 3 = 0 THEN (sk + ln) % 12 ELSE 4 + sk % 4 END AS scl,
 CASE WHEN ok % 4 = 0 THEN (e * 7) % 64 ELSE 64 END AS qa,
 200 + e % 2600 AS b02, 300 + (e + q * 131) % 3000 AS b03, 300 + (q * 97 + ok * 3) % 3300 AS b04,
 500 + (e * 3 + tx * 211 + ok * 7) % 5500 AS b08, 400 + (e * 5 + q * 17) % 4600 AS b11,
 300 + (e * 11 + dsc * 29) % 4200 AS b12 FROM scene""",
    "px": "SELECT cell_id, r, c, yr, sensor, scl, qa, "
          + _each("CASE WHEN sensor = 'landsat' THEN 7300 + 4 * {b} ELSE {b} END AS {b}")
          + " FROM base",
    "lulc": """SELECT cell_id, r, c, yr, CAST(CASE WHEN ok % 13 = 0 THEN NULL
 WHEN b08 % 100 < 30 + (yr - 1995) * 4 THEN 1 WHEN b08 % 100 < 70 THEN 2
 WHEN b08 % 100 < 90 THEN 3 ELSE 4 END AS INT) AS cls FROM base""",
    "refl": """SELECT cell_id, r, c, yr, sensor, """
            + _each("""CASE WHEN sensor = 'landsat' AND (qa & 58) = 0
 THEN least(greatest(CAST({b} AS DOUBLE) * 2.75e-5 - 2e-1, 0), 1)
 WHEN sensor = 'sentinel' AND scl IN (4, 5, 6, 7)
 THEN least(greatest(CAST({b} AS DOUBLE) / 1e4, 0), 1) END AS {b}""") + " FROM px",
    "feat": f"SELECT *, {INDEX_SQL} FROM refl",
    "feat_long": "SELECT cell_id, r, c, yr, sensor, unnest(["
                 + _each("'{b}'", FEATURES) + "]) AS layer, unnest([" + _each("{b}", FEATURES)
                 + "]) AS v FROM feat",
    "norm_params": """SELECT yr AS year, sensor, layer, min(v) AS min, max(v) AS max
 FROM feat_long GROUP BY ALL""",
    "norm_long": """SELECT f.cell_id, f.r, f.c, f.yr, f.sensor, f.layer, f.v,
 CASE WHEN isfinite(p.min) AND isfinite(p.max) AND abs(p.max - p.min) >= 1e-6
 THEN (f.v - p.min) / (p.max - p.min) ELSE f.v * 0 END AS nv
 FROM feat_long f LEFT JOIN norm_params p ON p.year = f.yr AND p.sensor = f.sensor AND p.layer = f.layer""",
    "feat_norm": "SELECT cell_id, r, c, yr, sensor, "
                 + _each("max(nv) FILTER (layer = '{b}') AS {b}", FEATURES)
                 + " FROM norm_long GROUP BY cell_id, r, c, yr, sensor",
    "chan": f"""SELECT *, {INDEX_SQL} FROM (SELECT cell_id, r, c, yr, """
            + _each("least(greatest(CAST({b} AS DOUBLE) / 1e4, 0), 1) AS {b}") + " FROM base) z",
    "zone_px": """SELECT cell_id, r, c, yr, cls, greatest(CAST(ceil(d / 5000) AS BIGINT), 1) AS zone_id
 FROM (SELECT *, sqrt(CAST((c*1000+500-25000)*(c*1000+500-25000) + (r*1000+500-20000)*(r*1000+500-20000)
 AS DOUBLE)) AS d FROM lulc) z WHERE d <= 30000""",
    "sector_px": """SELECT cell_id, r, c, yr, cls, CAST(least(floor(CASE WHEN b < 0 THEN b + 360 ELSE b END / 45), 7) AS INT) + 1 AS sector_id
 FROM (SELECT *, degrees(atan2(CAST(c*1000+500-25000 AS DOUBLE), CAST(r*1000+500-20000 AS DOUBLE))) AS b,
 sqrt(CAST((c*1000+500-25000)*(c*1000+500-25000) + (r*1000+500-20000)*(r*1000+500-20000) AS DOUBLE)) AS d
 FROM lulc) z WHERE d <= 80000""",
    "land_cover": """SELECT p_partkey AS cell_id, CAST(floor(p_partkey / 50) AS BIGINT) AS r, p_partkey % 50 AS c,
 CAST(CASE p_size % 12 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 40 WHEN 4 THEN 50
 WHEN 5 THEN 60 WHEN 6 THEN 70 WHEN 7 THEN 80 WHEN 8 THEN 90 WHEN 9 THEN 95 WHEN 10 THEN 100 ELSE 96 END AS INT) AS code,
 p_retailprice AS elev, CAST(p_size AS DOUBLE) AS pop FROM part""",
    "catalog": """SELECT o_orderkey AS item_id, o_orderkey AS item_seq, o_custkey AS ck,
 CASE WHEN o_orderkey % 2 = 0 THEN 'landsat-c2-l2' ELSE 'sentinel-2-l2a' END AS collection,
 CAST(o_orderdate AS DATE) AS dt, CAST(year(o_orderdate) AS INT) AS yr,
 CASE o_custkey % 3 WHEN 0 THEN ' Landsat_5' WHEN 1 THEN 'landsat-7 ' ELSE 'LANDSAT_8' END AS platform,
 CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 10000 AS DOUBLE) / 100 END AS eo_cloud,
 CASE WHEN o_custkey % 5 < 3 THEN NULL ELSE CAST(o_custkey % 101 AS DOUBLE) END AS land_cloud,
 CAST(36.0 AS DOUBLE) + (o_custkey % 20) / CAST(10 AS DOUBLE) AS xmin, CAST(36.5 AS DOUBLE) + (o_custkey % 20) / CAST(10 AS DOUBLE) AS xmax,
 CAST(-2.0 AS DOUBLE) + (o_custkey % 7) / CAST(10 AS DOUBLE) AS ymin, CAST(-1.6 AS DOUBLE) + (o_custkey % 7) / CAST(10 AS DOUBLE) AS ymax
 FROM orders""",
    "cloudy": "SELECT *, least(eo_cloud, land_cloud) AS cloud FROM catalog",
    "roads": """SELECT CAST(s_suppkey AS BIGINT) AS seg_id, CAST(((s_suppkey * 13) % 45) * 1000 + 500 AS DOUBLE) AS x1,
 CAST(((s_suppkey * 7) % 35) * 1000 + 500 AS DOUBLE) AS y1, CAST(((s_suppkey * 13) % 45) * 1000 + 4500 AS DOUBLE) AS x2,
 CAST(((s_suppkey * 7) % 35 + s_nationkey % 5) * 1000 + 500 AS DOUBLE) AS y2 FROM supplier""",
    "trans": """SELECT * FROM (VALUES (1, 1995, 1997), (2, 1997, 1999), (3, 1999, 2001))
 AS t(transition_id, pre_year, post_year)""",
    "pairs": """SELECT a.cell_id, a.r, a.c, t.transition_id, t.pre_year, t.post_year, a.cls AS pre_cls, b.cls AS post_cls
 FROM trans t JOIN lulc a ON a.yr = t.pre_year JOIN lulc b ON b.cell_id = a.cell_id AND b.yr = t.post_year""",
    "changes": """SELECT *, CASE WHEN pre_cls = 1 OR post_cls <> 1 THEN 0
 WHEN pre_cls IS NULL OR post_cls IS NULL THEN NULL ELSE 1 END AS change FROM pairs""",
    "grid_size": "SELECT max(l_partkey) // 50 + 1 AS nr, 50 AS nc FROM lineitem",
}


def _used(text: str) -> set[str]:
    return {n for n in CTES if re.search(rf"\b{n}\b", text)}


def sql(body: str, **extra: str) -> str:
    """``body`` with its CTEs in front; ``extra`` adds statement-local CTEs in order."""
    need: set[str] = set()
    todo = [body, *extra.values()]
    while todo:
        for name in _used(todo.pop()) - need - set(extra):
            need.add(name)
            todo.append(CTES[name])
    parts = [f"{n} AS ({q})" for n, q in CTES.items() if n in need]
    parts += [f"{n} AS {'MATERIALIZED ' if q.startswith(ONCE) else ''}({q})" for n, q in extra.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
