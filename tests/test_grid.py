"""Neighbourhood operators against brute force on small grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgrid.config import Grid
from landgrid.functions import geo
from landgrid.operators import components, distance, focal, landscape, patches, resample, vectors


def as_grid(df, name, shape, by=None):
    out = np.full(shape, np.nan)
    for row in df.select("r", "c", name).collect():
        out[row["r"], row["c"]] = np.nan if row[name] is None else row[name]
    return out


def test_focal_majority_ties_nulls_and_edges(frame):
    rows = [[1, 1, 2, 2, None], [1, None, 2, 3, None], [4, 4, 3, 3, None], [4, 4, 1, 2, None],
            [4, 1, 1, 2, None]]
    got = as_grid(focal.focal_majority(frame(rows)), "cls", (5, 5))
    a = np.array([[np.nan if v is None else v for v in r] for r in rows], dtype=float)
    for r in range(5):
        for c in range(5):
            near = a[max(r - 1, 0):r + 2, max(c - 1, 0):c + 2]
            near = near[~np.isnan(near)].astype(int)
            want = np.bincount(near).argmax() if near.size else np.nan
            assert got[r, c] == want or (np.isnan(got[r, c]) and np.isnan(want))


def test_focal_majority_all_null(frame):
    got = focal.focal_majority(frame([[None, None], [None, None]])).collect()
    assert len(got) == 4 and all(r["cls"] is None for r in got)


def test_aggregate_modal_prefers_low_class(frame):
    got = {(r["r"], r["c"]): r["cls"] for r in
           focal.aggregate_modal(frame([[2, 1, 4], [1, 2, None]]), 2).collect()}
    assert got == {(0, 0): 1, (0, 1): 4}
    assert focal.coarsen_factor(10, target_res=100) == 10 and focal.coarsen_factor(10, 0) == 1


def test_slope_of_a_plane(frame):
    z = [[float(3 * c + 4 * r) for c in range(5)] for r in range(5)]
    got = as_grid(focal.slope_degrees(frame(z, name="elev", kind="double"), 1.0), "slope", (5, 5))
    assert np.allclose(got[1:-1, 1:-1], np.degrees(np.arctan(5.0)))
    assert np.isnan(got[0]).all() and np.isnan(got[:, -1]).all()


@pytest.mark.parametrize("band", [7, 30, 10_000])
def test_distance_matches_brute_force(frame, band):
    rng = np.random.default_rng(3)
    a = (rng.random((23, 7)) < 0.05).astype(int)
    a[0:9] = 0
    df = frame(a.tolist()).withColumn("t", F.col("cls") == 1)
    got = as_grid(distance.distance_transform(df, "t", Grid(10.0, 23, 7), ["yr"], band_cells=band),
                  "dist", a.shape)
    hits = np.argwhere(a == 1)
    for r in range(23):
        for c in range(7):
            want = 10.0 * np.sqrt(((hits - (r, c)) ** 2).sum(axis=1).min())
            assert got[r, c] == pytest.approx(want)


@pytest.mark.parametrize("tile", (1, 5, 8, 40))
@pytest.mark.parametrize("share", (0.01, 0.2))
def test_distance_over_column_tiles(frame, tile, share):
    """Tiles with no cell or no target of their own, and targets in columns that a band does not have."""
    rng = np.random.default_rng(tile)
    a = (rng.random((19, 37)) < share).astype(int)
    a[3, 30] = 1
    gone = rng.random(a.shape) < 0.3
    gone[8:13, 10:30] = True
    gone[3, 30] = False
    df = frame(a.tolist()).withColumn("t", F.col("cls") == 1)
    cells = [(int(r), int(c)) for r, c in np.argwhere(~gone)]
    here = df.join(df.sparkSession.createDataFrame(cells, "r bigint, c bigint"), ["r", "c"])
    got = {(r["r"], r["c"]): r["dist"] for r in distance.distance_transform(
        here, "t", Grid(10.0, 19, 37), ["yr"], band_cells=4 * tile, tile_cols=tile).collect()}
    hits = np.argwhere((a == 1) & ~gone)
    assert set(got) == set(cells)
    for r, c in cells:
        assert got[r, c] == pytest.approx(10.0 * np.sqrt(((hits - (r, c)) ** 2).sum(axis=1).min()))


def test_halo_costs_few_rows_and_no_second_shuffle(spark):
    n = 256
    cells = spark.range(n * n).select(F.col("id").alias("cell_id"), F.expr(f"id div {n}").alias("r"), F.expr(f"id % {n}").alias("c"),
                                      F.expr("id % 1").alias("yr"), (F.col("id") % 4 + 1).cast("int").alias("cls"), F.col("id").cast("double").alias("elev"))
    assert focal.with_halo(cells, focal.SQUARE, ["yr"]).count() <= 1.1 * n * n
    for out in (focal.focal_majority(cells), focal.slope_degrees(cells, 10.0), focal.forward_pairs(cells)):
        assert out.filter("r >= 0 AND c >= 0").count() == n * n
        assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1


def test_envelope_is_the_minimum_of_its_parabolas():
    rng = np.random.default_rng(1)
    for low, high in ((0, 30), (12, 20), (31, 60), (-20, -1)):
        square = np.where(rng.random((40, 31)) < 0.4, rng.integers(0, 400, (40, 31)), -1)
        square[0] = -1
        col = np.broadcast_to(np.arange(31), square.shape)
        e = distance.Envelope(col, square, low, high)
        x = np.arange(low, high + 1)
        for i in range(40):
            own = np.flatnonzero(square[i] >= 0)
            want = ((x[:, None] - own) ** 2 + square[i][own]).min(axis=1) if len(own) else np.full(len(x), distance.FAR)
            assert (e.squares()[i] == want).all()
        again = distance.Envelope(*e.pieces(), low, high)
        assert (again.squares() == e.squares()).all() and again.top.max() <= e.top.max()


def test_distance_without_target(frame):
    df = frame([[0, 0], [0, None]]).withColumn("t", F.col("cls") == 1)
    got = distance.distance_transform(df, "t", Grid(10.0, 2, 2), ["yr"]).collect()
    assert len(got) == 4 and {r["dist"] for r in got} == {50_000.0}


def flood(a, directions):
    """Smallest row-major index of each cell's patch."""
    out = np.full(a.shape, -1)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    if directions == 8:
        steps += [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            if a[r, c] and out[r, c] < 0:
                stack, label = [(r, c)], r * a.shape[1] + c
                out[r, c] = label
                while stack:
                    y, x = stack.pop()
                    for dy, dx in steps:
                        i, j = y + dy, x + dx
                        if (0 <= i < a.shape[0] and 0 <= j < a.shape[1] and out[i, j] < 0
                                and a[i, j] == a[r, c]):
                            out[i, j] = label
                            stack.append((i, j))
    return out


def spiral(n):
    a = np.zeros((n, n), dtype=int)
    r, c, dr, dc = 0, 0, 0, 1
    for _ in range(n * n):
        a[r, c] = 1
        i, j, k, m = r + dr, c + dc, r + 2 * dr, c + 2 * dc
        if not (0 <= i < n and 0 <= j < n) or (0 <= k < n and 0 <= m < n and a[k, m]):
            dr, dc = dc, -dr
            i, j, k, m = r + dr, c + dc, r + 2 * dr, c + 2 * dc
            if not (0 <= i < n and 0 <= j < n) or (0 <= k < n and 0 <= m < n and a[k, m]):
                break
        r, c = i, j
    return a


@pytest.mark.parametrize("directions,tile", [(4, 3), (8, 4), (8, 100)])
def test_components_across_tiles(frame, directions, tile):
    rng = np.random.default_rng(1)
    a = rng.choice([0, 1, 2], size=(13, 12), p=[0.35, 0.5, 0.15])
    df = frame([[int(v) or None for v in row] for row in a])
    got = components.connected_components(df, directions, tile=tile)
    assert {(r["r"], r["c"]): r["component"] for r in got.collect()} == {
        (r, c): flood(a, directions)[r, c] for r, c in np.argwhere(a > 0)}


def test_components_follow_a_spiral(frame):
    a = spiral(15)
    got = components.connected_components(
        frame([[int(v) or None for v in row] for row in a]), 4, tile=2)
    assert got.select("component").distinct().count() == 1
    assert got.count() == a.sum()


def test_sieve_keeps_large_patches_and_is_idempotent(frame):
    rows = [[0.9, 0.9, 0.1, 0.9], [0.9, 0.1, 0.1, None], [0.9, 0.1, 0.9, 0.9]]
    prob = frame(rows, name="prob", kind="double")
    lulc = frame([[1, 1, 1, 1], [1, 1, 1, 1], [1, 1, 1, 4]])
    once = components.sieve_small(prob, lulc, 3, tile=2)
    got = as_grid(once, "change", (3, 4))
    want = np.array([[1, 1, 0, 0], [1, 0, 0, np.nan], [1, 0, 0, 0]])
    assert np.array_equal(got, want, equal_nan=True)
    again = components.sieve_small(once.withColumn("prob", F.col("change").cast("double")), lulc, 3)
    assert np.array_equal(as_grid(again, "change", (3, 4)), want, equal_nan=True)


def test_landscape_metrics_of_a_block(frame):
    rows = [[1, 1, 2, 2], [1, 1, 2, 2], [2, 2, 2, 1], [2, 2, 1, 2]]
    m = landscape.landscape_metrics(frame(rows), 100.0).first()
    area = 16 * 100.0 * 100.0
    assert m["PD"] == pytest.approx(2 * 1e6 / area)
    assert m["LPI"] == pytest.approx(4 / 16 * 100)
    assert m["MPA"] == pytest.approx(3.0)
    assert m["ED"] == pytest.approx((4 + 3 + 3) * 100 * 1e4 / area)
    assert m["AI"] == pytest.approx(4 / 7 * 100)


def test_landscape_without_the_class(frame):
    m = landscape.landscape_metrics(frame([[2, 2], [2, None]]), 100.0).first()
    assert [m[k] for k in ("PD", "LPI", "ED", "AI", "MPA")] == [None] * 5


def test_lines_match_dense_sampling(spark):
    grid = Grid(1.0, 12, 15)
    rng = np.random.default_rng(5)
    seg = rng.uniform(-2, 14, size=(12, 4))
    seg[0] = (3.2, 1.0, 3.2, 9.5)
    df = spark.createDataFrame([tuple(map(float, s)) for s in seg], "x1 double, y1 double, x2 double, y2 double")
    got = {(r["r"], r["c"]) for r in vectors.rasterize_lines(df, grid).collect()}
    t = np.linspace(0, 1, 40_001)[:, None]
    want = set()
    for x1, y1, x2, y2 in seg:
        p = np.floor(np.hstack([y1 + (y2 - y1) * t, x1 + (x2 - x1) * t])).astype(int)
        want |= {(int(r), int(c)) for r, c in np.unique(p, axis=0) if 0 <= r < 12 and 0 <= c < 15}
    assert want <= got
    assert len(got - want) <= 2  # corners cut by less than a sampling step


def test_bilinear_identity_and_weights(spark, frame):
    df = frame([[0.0, 10.0], [20.0, None]], name="v", kind="double")
    g = Grid(10.0, 2, 2)
    assert resample.resample_bilinear(df, g, g, ["v"]).count() == 4
    one = resample.resample_bilinear(df, g, Grid(10.0, 1, 1, x0=2.5, y0=0.0), ["v"]).first()
    assert one["v"] == pytest.approx(2.5)
    mid = resample.resample_bilinear(df, g, Grid(20.0, 1, 1), ["v"]).first()
    assert mid["v"] == pytest.approx(10.0)


def test_bilinear_drops_target_cells_without_a_weighted_source(spark):
    df = spark.createDataFrame([(0, 0, 5.0), (1, 2, None)], "r bigint, c bigint, v double")
    got = resample.resample_bilinear(df, Grid(10.0, 3, 3), Grid(5.0, 6, 6, x0=-2.5, y0=-2.5), ["v"]).collect()
    near = {(r, c) for y, x in ((0, 0), (1, 2)) for r in range(6) for c in range(6)
            if abs(5 * r - 10 * y - 5) < 10 and abs(5 * c - 10 * x - 5) < 10}
    assert {(r["r"], r["c"]) for r in got} == near
    assert all((r["v"] is None) == (r["c"] > 2) for r in got)


def test_nearest_to_finer_and_coarser(frame):
    df = frame([[1, 2], [3, 4]])
    fine = resample.resample_nearest(df, Grid(10.0, 2, 2), Grid(5.0, 4, 4), ["cls"])
    assert np.array_equal(as_grid(fine, "cls", (4, 4)), np.kron([[1, 2], [3, 4]], np.ones((2, 2))))
    coarse = resample.resample_nearest(df, Grid(10.0, 2, 2), Grid(20.0, 1, 1), ["cls"]).collect()
    assert [r["cls"] for r in coarse] == [4]


def test_overlap_mean_with_uneven_stride(spark, frame):
    cells = frame(np.zeros((9, 9), dtype=int).tolist()).withColumn("t", F.lit(1))
    wins = [(1, r, c, float(r * 10 + c)) for r in range(0, 4, 3) for c in range(0, 6, 3)]
    scores = spark.createDataFrame(wins, "t int, r0 bigint, c0 bigint, prob double")
    got = as_grid(patches.overlap_mean(scores, cells, 4, 3, ["t"]), "prob", (9, 9))
    total, n = np.zeros((9, 9)), np.zeros((9, 9))
    for _, r, c, p in wins:
        total[r:r + 4, c:c + 4] += p
        n[r:r + 4, c:c + 4] += 1
    want = np.where(n > 0, total / np.maximum(n, 1), np.nan)
    assert np.allclose(got, want, equal_nan=True)


def test_utm_known_meridian_arc_and_round_trip(spark):
    df = spark.createDataFrame([(39.0, 45.0), (36.8219, -1.2864), (41.5, 10.0)], "lon double, lat double")
    flat = geo.to_utm(df, "lon", "lat", "x", "y", 37, False, geo.WGS84, None).collect()
    assert flat[0]["x"] == pytest.approx(500_000.0)
    assert flat[0]["y"] == pytest.approx(0.9996 * 4_984_944.378, abs=0.01)
    for shift, near in ((None, 1e-8), (geo.ARC_1960_TO_WGS84, 5e-7)):
        # The series ends at third order (below a millimetre); a three-parameter shift drops the
        # height, which costs centimetres on the way back.
        there = geo.to_utm(df, "lon", "lat", "x", "y", 37, True, to_wgs84=shift)
        for row in geo.from_utm(there, "x", "y", "lo", "la", 37, True, to_wgs84=shift).collect():
            assert row["lo"] == pytest.approx(row["lon"], abs=near)
            assert row["la"] == pytest.approx(row["lat"], abs=near)
