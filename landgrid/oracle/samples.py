"""SQL of sampling, model-table and composed queries."""

from landgrid.oracle.base import FEATURES, sql
from landgrid.oracle.grids import _ADJ, _COMPONENTS, windows
from landgrid.oracle.pixels import SQL as PIXEL_SQL
from landgrid.oracle.solve import TAIL, logistic
from landgrid.oracle.zones import _ZC

PREDICTORS = ("dist_roads", "dist_centre", "dist_urban", "pop_density", "elevation", "slope", "ndvi_loss")

_STACK = {
    "tmpl": "SELECT DISTINCT r // 2 AS r, c // 2 AS c FROM lulc",
    "near": "SELECT yr, r // 2 AS r, c // 2 AS c, cls FROM lulc WHERE (r + 1) // 2 * 2 = r + 1 AND (c + 1) // 2 * 2 = c + 1",
    "road": """SELECT DISTINCT t.r, t.c FROM tmpl t JOIN roads s ON s.x1 < (t.c + 1) * 2000 AND s.x2 >= t.c * 2000
 AND floor((s.y1 + (s.y2 - s.y1) * (greatest(s.x1, t.c * 2000) - s.x1) / (s.x2 - s.x1)) / 2000) <= t.r
 AND floor((s.y1 + (s.y2 - s.y1) * (least(s.x2, (t.c + 1) * 2000) - s.x1) / (s.x2 - s.x1)) / 2000) >= t.r""",
    "urb": "SELECT r, c FROM near WHERE yr = 1995 AND cls = 1",
    "droad": """SELECT t.r, t.c, coalesce(min(sqrt(CAST((t.r-x.r)*(t.r-x.r) + (t.c-x.c)*(t.c-x.c) AS DOUBLE))) * 2000, 50000) AS dist_roads
 FROM tmpl t LEFT JOIN road x ON true GROUP BY ALL""",
    "durb": """SELECT t.r, t.c, coalesce(min(sqrt(CAST((t.r-x.r)*(t.r-x.r) + (t.c-x.c)*(t.c-x.c) AS DOUBLE))) * 2000, 50000) AS dist_urban
 FROM tmpl t LEFT JOIN urb x ON true GROUP BY ALL""",
    "grow": """SELECT a.r, a.c, CAST(CASE WHEN a.cls = 1 OR b.cls <> 1 THEN 0 WHEN a.cls IS NULL OR b.cls IS NULL THEN NULL ELSE 1 END AS INT) AS growth
 FROM near a JOIN near b ON b.r = a.r AND b.c = a.c AND b.yr = 2001 WHERE a.yr = 1995""",
    "cover": "SELECT r // 2 AS r, c // 2 AS c, avg(elev) AS elevation, avg(pop) / 4 AS pop_density FROM land_cover GROUP BY ALL",
    "slp": """SELECT m.r, m.c, degrees(atan(sqrt(power(((ne.elevation + 2 * e.elevation + se.elevation) - (nw.elevation + 2 * w.elevation + sw.elevation)) / 16e3, 2)
 + power(((sw.elevation + 2 * s.elevation + se.elevation) - (nw.elevation + 2 * n.elevation + ne.elevation)) / 16e3, 2)))) AS slope FROM cover m """
           + " ".join(f"LEFT JOIN cover {n} ON {n}.r = m.r + ({dr}) AND {n}.c = m.c + ({dc})" for n, dr, dc in
                      (("nw", -1, -1), ("n", -1, 0), ("ne", -1, 1), ("w", 0, -1), ("e", 0, 1), ("sw", 1, -1), ("s", 1, 0), ("se", 1, 1))),
    "nd": "SELECT yr, r // 2 AS r, c // 2 AS c, avg(nv) AS v FROM norm_long WHERE layer = 'ndvi' AND yr IN (1995, 2001) GROUP BY ALL",
    "ndl": "SELECT a.r, a.c, CASE WHEN a.v - b.v < 0 THEN 0 ELSE a.v - b.v END AS ndvi_loss FROM nd a JOIN nd b ON a.r = b.r AND a.c = b.c AND a.yr = 1995 AND b.yr = 2001",
    "stk": """SELECT t.r * 25 + t.c AS cell_id, t.r, t.c, CAST(t.c * 2000 + 1000 AS DOUBLE) AS x, CAST(t.r * 2000 + 1000 AS DOUBLE) AS y, growth, dist_roads,
 sqrt(CAST((t.c*2000+1000-25000)*(t.c*2000+1000-25000) + (t.r*2000+1000-20000)*(t.r*2000+1000-20000) AS DOUBLE)) AS dist_centre, dist_urban,
 pop_density, elevation, slope, ndvi_loss FROM tmpl t LEFT JOIN grow USING (r, c) LEFT JOIN droad USING (r, c) LEFT JOIN durb USING (r, c)
 LEFT JOIN cover USING (r, c) LEFT JOIN slp USING (r, c) LEFT JOIN ndl USING (r, c)""",
    "smp": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY growth ORDER BY md5('42|' || cell_id), cell_id) AS rk FROM stk WHERE growth IS NOT NULL) z
 WHERE rk <= 1000""",
    "frm": "SELECT * FROM smp WHERE " + " AND ".join(f"{p} IS NOT NULL" for p in PREDICTORS),
    "knn": """SELECT i, j, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY i) AS w FROM (SELECT a.cell_id AS i, b.cell_id AS j,
 row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.cell_id) AS rk
 FROM frm a JOIN frm b ON a.cell_id <> b.cell_id) z WHERE rk <= 8""",
}


def stack(body: str, **extra: str) -> str:
    return sql(body, **_STACK, **extra)


_VARS = ("growth",) + PREDICTORS
_CORR = " UNION ALL ".join(
    f"SELECT {i} AS i, '{a}' AS variable, " + ", ".join(
        ("CAST(1 AS DOUBLE)" if a == b else f"round(corr({a}, {b}), 6)") + f" AS {b}" for b in _VARS)
    + " FROM stk" for i, a in enumerate(_VARS))
_SPLIT = """CASE WHEN rk <= 11 THEN 'train' WHEN rk <= 14 THEN 'val' ELSE 'test' END"""
_BLOCKS = {
    "bsplit": f"""SELECT seed, pos, block, {_SPLIT} AS split FROM (SELECT seed, pos, CAST(b AS INT) AS block,
 row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || b)) AS rk FROM (VALUES (1, 42), (2, 101), (3, 202), (4, 303)) s(pos, seed), generate_series(1, 16) g(b)) z""",
}
_NORMAL = {
    "mi": """SELECT n, s0, zz, m2, m4, s1, s2 FROM
 (SELECT count(*) AS n, sum(d * d) AS m2, sum(power(d, 4)) AS m4 FROM dev),
 (SELECT sum(w) AS s0, sum(w * a.d * b.d) AS zz FROM knn JOIN dev a ON a.cell_id = i JOIN dev b ON b.cell_id = j),
 (SELECT sum(power(coalesce(k.w, 0) + coalesce(l.w, 0), 2)) / 2 AS s1 FROM (SELECT DISTINCT i, j FROM (SELECT i, j FROM knn UNION ALL SELECT j, i FROM knn)) u
 LEFT JOIN knn k ON k.i = u.i AND k.j = u.j LEFT JOIN knn l ON l.i = u.j AND l.j = u.i),
 (SELECT sum(power(t, 2)) AS s2 FROM (SELECT p, sum(w) AS t FROM (SELECT i AS p, w FROM knn UNION ALL SELECT j, w FROM knn) GROUP BY p))""",
    "mv": """SELECT *, n * zz / (s0 * m2) AS mi, -1 / (n - 1e0) AS ex, (n * ((n * n - 3e0 * n + 3) * s1 - n * s2 + 3 * s0 * s0)
 - n * m4 / (m2 * m2) * ((n * n - n) * s1 - 2e0 * n * s2 + 6 * s0 * s0)) / ((n - 1e0) * (n - 2) * (n - 3) * s0 * s0) - 1 / ((n - 1e0) * (n - 1e0)) AS va FROM mi""",
    "mz": "SELECT *, (mi - ex) / sqrt(va) AS z FROM mv",
    "er": """SELECT sum(exp(ln(x) + k * ln(2 * x * x) - lf)) * 2 / sqrt(pi()) * exp(-x * x) AS er FROM (SELECT abs(z) / sqrt(2e0) AS x FROM mz),
 (SELECT k, sum(CASE WHEN k = 0 THEN 0 ELSE ln(2e0 * k + 1) END) OVER (ORDER BY k) AS lf FROM generate_series(0, 250) g(k)) GROUP BY x""",
}

_FIRST_SEED = """SELECT transition_id, min_by(seed, pos) FILTER (tp > 0 AND nv > 0) AS seed FROM
 (SELECT transition_id, seed, pos, count(*) FILTER (split = 'train' AND y = 1) AS tp, count(*) FILTER (split = 'val') AS nv
 FROM blocked JOIN bsplit USING (block) GROUP BY ALL) z GROUP BY transition_id"""
_LOGIT = logistic("frm", "growth", PREDICTORS)
_TERM = "CASE t.k " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(("(Intercept)", *PREDICTORS))) + " END"

SQL = {
    "stratified_points": sql("""SELECT yr, cls, cell_id, rk FROM (SELECT *, row_number() OVER (PARTITION BY yr, cls ORDER BY md5('42|' || cell_id), cell_id) AS rk
 FROM lulc WHERE cls IS NOT NULL) z WHERE rk <= 100"""),
    "train_test_split": sql("""SELECT yr, cls, cell_id, CASE WHEN row_number() OVER (PARTITION BY yr, cls ORDER BY md5('42|' || cell_id), cell_id)
 <= ceil(7e-1 * count(*) OVER (PARTITION BY yr, cls)) THEN 'train' ELSE 'test' END AS split FROM lulc WHERE cls IS NOT NULL"""),
    "paired_split": sql("""SELECT unnest(['landsat', 'sentinel']) AS sensor, cell_id, unnest([c1, c2]) AS cls, CASE WHEN row_number() OVER (PARTITION BY c1 ORDER BY md5('42|' || cell_id), cell_id)
 <= ceil(7e-1 * count(*) OVER (PARTITION BY c1)) THEN 'train' ELSE 'test' END AS split FROM
 (SELECT a.cell_id, a.cls AS c1, b.cls AS c2 FROM lulc a JOIN lulc b USING (cell_id) WHERE a.yr = 1997 AND b.yr = 1998 AND a.cls IS NOT NULL AND b.cls IS NOT NULL) z"""),
    "spatial_block_split": windows("SELECT transition_id, r0, c0, split FROM blocked JOIN bsplit USING (block) WHERE seed = 42", **_BLOCKS),
    "split_seed_search": windows("""SELECT transition_id, min_by(seed, pos) FILTER (tp > 0 AND nv > 0) AS seed FROM
 (SELECT transition_id, seed, pos, count(*) FILTER (split = 'train' AND y = 1) AS tp, count(*) FILTER (split = 'val') AS nv
 FROM blocked JOIN bsplit USING (block) GROUP BY ALL) z GROUP BY transition_id""", **_BLOCKS),
    "balance_negatives": sql("""SELECT transition_id, cell_id, change AS y FROM changes WHERE change = 1 UNION ALL
 SELECT transition_id, cell_id, 0 FROM (SELECT *, row_number() OVER (PARTITION BY transition_id ORDER BY md5('42|' || cell_id), cell_id) AS rk FROM changes WHERE change = 0) z
 WHERE rk <= (SELECT count(*) FROM changes p WHERE p.change = 1 AND p.transition_id = z.transition_id)"""),
    "driver_stack": stack("SELECT cell_id, growth, " + ", ".join(f"round({p}, 6) AS {p}" for p in PREDICTORS) + " FROM stk"),
    "growth_sample": stack("SELECT cell_id, growth FROM smp WHERE rk <= 100"),
    "regression_frame": stack("SELECT cell_id, growth, x, y, " + ", ".join(f"round({p}, 6) AS {p}" for p in PREDICTORS) + " FROM frm"),
    "dedupe_coordinates": sql("""SELECT seg_id AS id, round(x1 + CASE WHEN k > 1 THEN CAST('0x' || substr(md5('42|x|' || seg_id), 1, 8) AS BIGINT) / 4294967296e0 * eps ELSE 0 END, 6) AS x,
 round(y1 + CASE WHEN k > 1 THEN CAST('0x' || substr(md5('42|y|' || seg_id), 1, 8) AS BIGINT) / 4294967296e0 * eps ELSE 0 END, 6) AS y
 FROM (SELECT *, count(*) OVER (PARTITION BY x1, y1) AS k FROM roads), (SELECT 1e-6 * least(max(x1) - min(x1), max(y1) - min(y1)) AS eps FROM roads)"""),
    "correlation_matrix": stack(f"SELECT * EXCLUDE (i) FROM ({_CORR}) z"),
    "corr_long_lower": stack(" UNION ALL ".join(
        f"SELECT '{a}' AS variable, '{b}' AS other, " + ("max(CAST(1 AS DOUBLE))" if a == b else f"round(corr({a}, {b}), 6)") + " AS r FROM stk"
        for i, a in enumerate(_VARS) for b in _VARS[:i + 1])),
    "driver_ci": stack("""SELECT term, CASE WHEN e >= 0 THEN 'Increases P(growth)' ELSE 'Decreases P(growth)' END AS direction, round(e, 6) AS estimate,
 round(e - 196e-2 * sqrt((1 - e * e) / (n - 2)), 6) AS lo, round(e + 196e-2 * sqrt((1 - e * e) / (n - 2)), 6) AS hi FROM (""" + " UNION ALL ".join(
        f"SELECT '{p}' AS term, corr(growth, {p}) AS e, count(growth) AS n FROM stk" for p in PREDICTORS) + ") z"),
    "knn_weights": stack("SELECT i, j, w FROM knn"),
    "spatial_lag_column": stack("""SELECT i AS id, round(sum(w * growth), 6) AS lag_growth, round(sum(w * elevation), 6) AS lag_elevation
 FROM knn JOIN frm ON cell_id = j GROUP BY i"""),
    "morans_i": stack("""SELECT round(mi, 6) AS "I", round(ex, 6) AS expected, round(va, 6) AS variance, round(z, 6) AS z,
 round(CASE WHEN abs(z) > 8 THEN CASE WHEN z > 0 THEN 0 ELSE 1 END WHEN z >= 0 THEN (1 - er) / 2 ELSE (1 + er) / 2 END, 6) AS p FROM mz, er""",
        dev="SELECT cell_id, growth - (SELECT avg(growth) FROM frm) AS d FROM frm", **_NORMAL),
    "logistic_regression": stack(f"""SELECT {_TERM} AS term, round(est, 9) AS estimate, round(se, 9) AS std_error, round(est / se, 6) AS z_value, round(p, 6) AS p_value,
 round(exp(est), 6) AS odds_ratio, round(pr2, 6) AS pseudo_r2 FROM terms t JOIN tails ON tails.k = t.k""", **_LOGIT, tails=TAIL),
    "driver_importance": stack(f"SELECT {_TERM} AS variable, round(abs(est), 9) AS abs_coef FROM terms t WHERE k > 0", **_LOGIT),
    "pick_best_model": sql("""SELECT sensor, model FROM (SELECT sensor, model, row_number() OVER (PARTITION BY sensor ORDER BY (po - pe) / (1 - pe) DESC, model) AS rn FROM
 (SELECT sensor, model, sum(n) FILTER (pred = ref) / sum(n) AS po, sum(CAST(n AS DOUBLE) * 0) + (SELECT sum(a.t * b.t) FROM (SELECT pred AS k, sum(n) AS t FROM g q WHERE q.sensor = g.sensor AND q.model = g.model GROUP BY pred) a
 JOIN (SELECT ref AS k, sum(n) AS t FROM g q WHERE q.sensor = g.sensor AND q.model = g.model GROUP BY ref) b USING (k)) / (sum(n) * sum(n)) AS pe
 FROM g GROUP BY sensor, model) z) y WHERE rn = 1""",
        g="""SELECT CASE WHEN b.yr - a.yr = 1 THEN 'one_year' ELSE 'two_years' END AS model, CASE WHEN a.yr <= 1997 THEN 'landsat' ELSE 'sentinel' END AS sensor,
 b.cls AS pred, a.cls AS ref, CAST(count(*) AS DOUBLE) AS n FROM lulc a JOIN lulc b ON b.cell_id = a.cell_id AND b.yr - a.yr IN (1, 2)
 WHERE a.cls IS NOT NULL AND b.cls IS NOT NULL GROUP BY ALL"""),
    "classify_year": sql("""SELECT m.cell_id, m.yr, CASE WHEN f.ndvi > 6e-1 THEN 2 WHEN f.mndwi > 3e-1 THEN 4 ELSE m.cls END AS cls FROM maj m
 LEFT JOIN feat f ON f.cell_id = m.cell_id AND f.yr = m.yr""",
        maj="""SELECT l.cell_id, l.yr, m.cls FROM lulc l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY yr, cell_id
 ORDER BY k DESC, cls) AS rn FROM (SELECT a.yr, a.cell_id, b.cls, count(*) AS k FROM lulc a JOIN lulc b ON a.yr = b.yr
 AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 WHERE b.cls IS NOT NULL GROUP BY ALL) z) m
 ON m.yr = l.yr AND m.cell_id = l.cell_id AND m.rn = 1"""),
    "class_weight": windows("""SELECT transition_id, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
 round(count(*) FILTER (y = 0) / CAST(greatest(count(*) FILTER (y = 1), 1) AS DOUBLE), 6) AS pos_weight FROM win GROUP BY transition_id"""),
    "change_models": windows("""SELECT transition_id, p AS n_pos, q AS n_neg, round(q / CAST(greatest(p, 1) AS DOUBLE), 6) AS pos_weight, true AS at_rest FROM
 (SELECT b.transition_id, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM blocked b JOIN first_seed f ON f.transition_id = b.transition_id
 JOIN bsplit s ON s.seed = f.seed AND s.block = b.block WHERE s.split = 'train' GROUP BY b.transition_id) z""", **_BLOCKS,
        first_seed=_FIRST_SEED),
    "change_report": windows("""SELECT t.pre_year, t.post_year, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
 count(*) FILTER (split = 'test') AS n_test, true AS known FROM blocked b JOIN first_seed f ON f.transition_id = b.transition_id
 JOIN bsplit s ON s.seed = f.seed AND s.block = b.block JOIN trans t ON t.transition_id = b.transition_id GROUP BY t.pre_year, t.post_year""",
        **_BLOCKS, first_seed=_FIRST_SEED),
    "model_facts": sql("""SELECT f.sensor, f.yr, f.n_pixels, f.n_classed, CAST(0 AS BIGINT) AS n_unknown, p.n_points, CAST(1 AS DOUBLE) AS importance_sum FROM
 (SELECT sensor, yr, count(*) AS n_pixels, count(*) FILTER (whole) AS n_classed FROM lab GROUP BY sensor, yr) f
 JOIN (SELECT sensor, CAST(sum(least(n, 400)) AS BIGINT) AS n_points FROM (SELECT sensor, cls, count(*) AS n FROM lab WHERE whole AND cls IS NOT NULL GROUP BY ALL) z
 GROUP BY sensor) p ON p.sensor = f.sensor""",
        lab="SELECT f.*, (" + " AND ".join(f"f.{b} IS NOT NULL" for b in FEATURES) + """) AS whole, CASE WHEN code = 50 THEN 1
 WHEN code IN (60, 70) THEN 3 WHEN code = 80 THEN 4 WHEN code IN (10, 20, 30, 40, 90, 95, 96) THEN 2 END AS cls FROM feat f LEFT JOIN land_cover USING (cell_id)"""),
    "transition_report": windows("""SELECT transition_id, n_train, n_val, n_test, round(CASE WHEN k > 0 THEN 2 * p * q / (p + q + 1e-9) END, 6) AS "F1",
 round(CASE WHEN k > 0 THEN p END, 6) AS "Precision", round(CASE WHEN k > 0 THEN q END, 6) AS "Recall", round(CASE WHEN k > 0 THEN tp / (tp + fp + fn + 1e-9) END, 6) AS "IoU"
 FROM (SELECT *, tp + fp + fn + tn AS k, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS q FROM (SELECT b.transition_id,
 count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test,
 count(*) FILTER (split = 'test' AND s >= 5e-1 AND y = 1) AS tp, count(*) FILTER (split = 'test' AND s >= 5e-1 AND y = 0) AS fp,
 count(*) FILTER (split = 'test' AND s < 5e-1 AND y = 1) AS fn, count(*) FILTER (split = 'test' AND s < 5e-1 AND y = 0) AS tn
 FROM blocked b JOIN bsplit ON bsplit.block = b.block AND seed = 42 JOIN sc ON sc.patch_id = b.patch_id GROUP BY b.transition_id) z) v""",
        sc="""SELECT p.transition_id || '-' || r0 || '-' || c0 AS patch_id, 2 * avg(abs(post_ndvi - pre_ndvi)) AS s FROM orig o JOIN cpair p ON p.r BETWEEN o.r0 AND o.r0 + 7
 AND p.c BETWEEN o.c0 AND o.c0 + 7 GROUP BY p.transition_id, r0, c0""", **_BLOCKS),
    "sliding_change_prob": windows("""SELECT p.transition_id, p.cell_id, round(avg(w.s), 6) AS prob FROM cpair p LEFT JOIN sc w
 ON w.transition_id = p.transition_id AND p.r BETWEEN w.r0 AND w.r0 + 7 AND p.c BETWEEN w.c0 AND w.c0 + 7 GROUP BY ALL""",
        sc="""SELECT p.transition_id, r0, c0, least(2 * avg(abs(post_ndvi - pre_ndvi)), 1) AS s FROM orig o JOIN cpair p ON p.r BETWEEN o.r0 AND o.r0 + 7
 AND p.c BETWEEN o.c0 AND o.c0 + 7 GROUP BY p.transition_id, r0, c0 HAVING count(*) = 64"""),
    "preprocess_year": PIXEL_SQL["minmax_normalize"],
    "preprocess_scene": sql("""SELECT r, c, 2001 AS yr, round((b08 - lo8) / (hi8 - lo8), 6) AS b08, round((ndvi - lov) / (hiv - lov), 6) AS ndvi FROM idx,
 (SELECT min(b08) AS lo8, max(b08) AS hi8, min(ndvi) AS lov, max(ndvi) AS hiv FROM idx) z""",
        bil="""SELECT r, c, sum(w * b04) / sum(w) FILTER (b04 IS NOT NULL) AS b04, sum(w * b08) / sum(w) FILTER (b08 IS NOT NULL) AS b08 FROM
 (SELECT t.r, t.c, s.b04, s.b08, (1 - abs(t.x - (s.c * 1000 + 500)) / 1e3) * (1 - abs(t.y - (s.r * 1000 + 500)) / 1e3) AS w
 FROM (SELECT i AS r, j AS c, 150 + (j + 5e-1) * 800 AS x, -100 + (i + 5e-1) * 800 AS y FROM
 generate_series(0, (SELECT CAST(floor(nr * 125e-2) AS BIGINT) - 1 FROM grid_size)) a(i), generate_series(0, 61) b(j)) t
 JOIN refl s ON s.yr = 2001 AND s.c BETWEEN CAST(floor((t.x - 500) / 1000) AS BIGINT) AND CAST(floor((t.x - 500) / 1000) AS BIGINT) + 1
 AND s.r BETWEEN CAST(floor((t.y - 500) / 1000) AS BIGINT) AND CAST(floor((t.y - 500) / 1000) AS BIGINT) + 1) z WHERE w > 0 GROUP BY r, c""",
        idx="SELECT *, (b08 - b04) / (b08 + b04 + 1e-6) AS ndvi FROM bil"),
    "compare_products": sql("""SELECT variant = 'same' AS same, n AS cells_a, n AS cells_b, variant FROM (SELECT count(DISTINCT cell_id) AS n FROM lulc WHERE yr = 2001) z,
 (SELECT unnest(['same', 'resolution', 'origin', 'system', 'size']) AS variant) y"""),
    "auto_training_samples": sql("""SELECT cell_id AS id, cls AS class, CAST(c * 1000 + 500 AS DOUBLE) AS x, CAST(r * 1000 + 500 AS DOUBLE) AS y FROM
 (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5('42|' || cell_id), cell_id) AS rk FROM (SELECT *, CASE WHEN code = 50 THEN 1
 WHEN code IN (60, 70) THEN 3 WHEN code = 80 THEN 4 WHEN code IN (10, 20, 30, 40, 90, 95, 96) THEN 2 END AS cls FROM land_cover) z WHERE cls IS NOT NULL) y WHERE rk <= 100"""),
    "sprawl_metrics": sql("""SELECT e.year, e.n_zones, round(h, 6) AS "H", round(hr, 6) AS "H_rel", round("PD", 6) AS "PD", round("LPI", 6) AS "LPI", round("ED", 6) AS "ED",
 round("AI", 6) AS "AI", round("MPA", 6) AS "MPA" FROM ent e JOIN pm ON pm.yr = e.year JOIN bm ON bm.yr = e.year""", **_ZC, **_COMPONENTS, **_ADJ),
}
