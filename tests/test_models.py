"""Sampling, weights and regressions against numpy."""

import hashlib
import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgrid.config import Change, Classification, Drivers, Grid
from landgrid.operators.quadtree import Quadtree, leaves_of
from landgrid.operators import (changemodel, classify, patches, ranking, regression, sampling,
                                stats, weights)
from landgrid.plans import jobs
from landgrid.plans.queries_samples import QUERIES
from landgrid.sources import products


def key(seed, i):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(11)
    n = 150
    x, y = rng.uniform(0, 100, n), rng.uniform(0, 100, n)
    a, b = rng.normal(size=n), rng.normal(size=n)
    g = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + 1.1 * a - 0.7 * b)))).astype(int)
    rows = [(i, float(x[i]), float(y[i]), float(a[i]), float(b[i]), int(g[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, a double, b double, growth int")
    return df.cache(), np.array(rows)


def test_hash_rank_is_the_sorted_order(spark):
    df = spark.range(0, 700).withColumn("g", F.when(F.col("id") < 600, 1).otherwise(2))
    got = {(r["g"], r["id"]): (r["rk"], r["group_n"])
           for r in ranking.hash_rank(df, ["g"], ["id"], 7).collect()}
    for g, ids in ((1, range(600)), (2, range(600, 700))):
        for rank, i in enumerate(sorted(ids, key=lambda i: key(7, i)), start=1):
            assert got[(g, i)] == (rank, len(ids))
    top = ranking.hash_first(df, ["g"], ["id"], 7, 5)
    assert sorted((r["g"], r["rk"], r["id"]) for r in top.collect()) == sorted(
        (g, k, i) for g, ids in ((1, range(600)), (2, range(600, 700)))
        for k, i in enumerate(sorted(ids, key=lambda i: key(7, i))[:5], start=1))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # tasks pass on five rows of a group at most


def test_ranks_over_many_parts_with_null_groups(spark):
    df = spark.range(0, 500).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 5 % 2).alias("g"))
    got = {r["id"]: (r["rk"], r["group_n"]) for r in ranking.exact_rank(df, ["g"], [F.desc("id")], part_rows=40).collect()}
    for group in ([i for i in range(500) if i % 5 in (1, 3)], [i for i in range(500) if i % 5 in (2, 4)], range(0, 500, 5)):
        assert [got[i] for i in sorted(group, reverse=True)] == [(k + 1, len(group)) for k in range(len(group))]
    whole = ranking.exact_rank(df, [], [F.asc("id")], part_rows=40)
    assert {r["id"]: r["rk"] for r in whole.collect()} == {i: i + 1 for i in range(500)}
    assert ranking.exact_rank(df.filter("id < 0"), ["g"], [F.asc("id")]).count() == 0


def test_split_sizes_and_pairing(spark):
    df = spark.range(0, 101).withColumn("cls", (F.col("id") % 3).cast("int"))
    sizes = {(r["cls"], r["split"]): r["count"] for r in
             sampling.train_test_split(df, ["cls"], ["id"], 0.7, 1).groupBy("cls", "split").count().collect()}
    assert sizes == {(0, "train"): 24, (0, "test"): 10, (1, "train"): 24, (1, "test"): 10,
                     (2, "train"): 24, (2, "test"): 9}
    a, b = sampling.paired_split(df, df, ["cls"], ["id"], 0.7, 1)
    assert {tuple(r) for r in a.select("id", "split").collect()} == {
        tuple(r) for r in b.select("id", "split").collect()}
    with pytest.raises(ValueError):
        sampling.paired_split(df, df.limit(5), ["cls"], ["id"], 0.7, 1)


def test_sample_errors(spark):
    few = spark.range(0, 20).select(F.col("id").alias("cell_id"), F.lit(1).alias("cls"), F.lit(0).alias("growth"))
    with pytest.raises(ValueError):
        sampling.stratified_points(few, 10, 1)
    with pytest.raises(ValueError):
        sampling.growth_sample(few, 10, 1)
    with pytest.raises(ValueError):
        sampling.balance_negatives(few.withColumn("y", F.lit(0)), ["cls"], ["cell_id"], 3, 1)


def test_balance_ratio(spark):
    df = spark.range(0, 100).select("id", F.lit(1).alias("t"), (F.col("id") < 7).cast("int").alias("y"))
    got = sampling.balance_negatives(df, ["t"], ["id"], 3, 5)
    assert {r["y"]: r["count"] for r in got.groupBy("y").count().collect()} == {1: 7, 0: 21}
    want = set(sorted(range(7, 100), key=lambda i: key(5, i))[:21])
    assert {r["id"] for r in got.filter("y = 0").collect()} == want


def test_jitter_only_moves_duplicates(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 10.0, 5.0)], "id bigint, x double, y double")
    got = {r["id"]: (r["x"], r["y"]) for r in sampling.jitter_duplicates(df, 1).collect()}
    assert got[3] == (10.0, 5.0) and got[1] != got[2]
    assert all(abs(v) < 1e-5 for i in (1, 2) for v in got[i])


def test_block_splits_and_seed_choice(spark):
    cfg = Change(patch_size=8, stride_train=4, centre=2)
    split = patches.block_splits(42, cfg)
    assert sorted(split.values()).count("train") == 11 and sorted(split.values()).count("test") == 2
    block = next(b for b, s in patches.block_splits(42, cfg).items() if s != "train")
    val = [next(b for b, s in patches.block_splits(s, cfg).items() if s != "x") for s in cfg.seeds]
    rows = [(1, block, 1)] + [(1, b, 0) for b in range(1, 17)] + [(2, val[0], 0)]
    df = spark.createDataFrame(rows, "transition_id int, block int, y int")
    got = {r["transition_id"]: r["seed"] for r in patches.choose_split_seed(df, ["transition_id"], cfg).collect()}
    want = next((s for s in cfg.seeds if patches.block_splits(s, cfg)[block] == "train"), None)
    assert got == {1: want, 2: None}
    grid = Grid(10.0, 100, 40)
    ids = spark.createDataFrame([(0, 0), (92, 32), (46, 16)], "r0 bigint, c0 bigint").select(
        patches.block_id(grid, cfg)).collect()
    assert [r[0] for r in ids] == [1, 16, 11]


def layout_points(layout, n=600):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 100, (n, 2))
    if layout == "clustered":  # three quarters in a thousandth of the width, a few far out
        xy[:3 * n // 4] = 50 + rng.normal(size=(3 * n // 4, 2)) * 1e-3
        xy[:20] += 1e5
    elif layout == "grid":  # every distance is tied
        xy = np.floor(xy / 4)
    elif layout == "spot":  # a third on one spot
        xy[::3] = (7.0, 7.0)
    elif layout == "line":
        xy[:, 1] = 3.0
    return xy


@pytest.mark.parametrize("leaf", (20_000, 30))
@pytest.mark.parametrize("layout", ["even", "clustered", "grid", "spot", "line"])
def test_knn_matches_brute_force(spark, layout, leaf):
    xy = layout_points(layout)
    df = spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in enumerate(xy)] + [(-1, None, 1.0), (-2, 1.0, float("nan"))],
                               "id bigint, x double, y double")
    got = {}
    for r in Quadtree(df, 6, leaf).nearest().collect():
        got.setdefault(r["i"], {})[r["rank"]] = (r["j"], r["d"])
    assert set(got) == set(range(len(xy)))
    for i in range(len(xy)):
        d = np.sqrt(((xy - xy[i]) ** 2).sum(axis=1))
        want = [j for j in np.lexsort((np.arange(len(xy)), d)) if j != i][:6]
        assert [got[i][k][0] for k in range(1, 7)] == want and got[i][6][1] == d[want[-1]]


def test_quadtree_bounds_leaves_visits_and_jobs(spark):
    """Clusters and sparse points side by side: no leaf is crowded, a point visits few others, few jobs run."""
    xy = layout_points("clustered", 8_000)
    df = spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in enumerate(xy)], "id bigint, x double, y double").cache()
    df.count()
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("quadtree", "")
    tree = Quadtree(df, 8, 128)
    local, visits = tree.visits()
    sizes = [r["count"] for r in local.groupBy("leaf").count().collect()]
    assert max(sizes) <= 128 and sum(sizes) == 8_000
    # Less than one visit a point, each of at most 8 candidates; only stragglers beside a cluster make many.
    per_point = visits.groupBy("i").count().agg(F.sum("count"), F.count(F.when(F.col("count") > 20, 1))).first()
    assert per_point[0] < 8_000 and per_point[1] < 0.005 * 8_000
    sc.setJobGroup("nearest", "")
    assert weights.nearest_neighbours(df, 8).count() == 64_000
    assert len(tracker.getJobIdsForGroup("nearest")) < 15
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_leaves_cover_and_merge():
    cells = {(2, 0): 3, (2, 1): 4, (2, 5): 50, (3, 40): 9, (3, 41): 9, (2, 11): 2, (1, 3): 1}
    got = set(leaves_of(cells, 10))
    assert got == {(1, 0), (2, 5), (3, 40), (3, 41), (2, 11), (1, 3)}  # beside a crowded sibling a sparse cell stays
    assert leaves_of({(4, 200): 1, (4, 7): 2}, 10) == [(0, 0)]


def test_knn_with_fewer_points_than_k(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 5.0, 0.0)], "id bigint, x double, y double")
    w = weights.knn_weights(df, 8).collect()
    assert len(w) == 6 and {r["w"] for r in w} == {0.5}


def dense_weights(w, n):
    m = np.zeros((n, n))
    for r in w.collect():
        m[r["i"], r["j"]] = r["w"]
    return m


def test_morans_i_matches_numpy(spark, samples):
    df, rows = samples
    w = weights.knn_weights(df.select("id", "x", "y"), 5).cache()
    m, n = dense_weights(w, len(rows)), len(rows)
    z = rows[:, 1] - rows[:, 1].mean()
    s0, s1 = m.sum(), 0.5 * ((m + m.T) ** 2).sum()
    s2 = ((m.sum(0) + m.sum(1)) ** 2).sum()
    i = n / s0 * (z @ m @ z) / (z @ z)
    b2 = n * (z**4).sum() / (z @ z) ** 2
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2)
           - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)) / ((n - 1) * (n - 2) * (n - 3) * s0**2) - 1 / (n - 1) ** 2
    got = weights.morans_i(df.select("id", F.col("x").alias("z")), w).first()
    assert got["I"] == pytest.approx(i) and got["variance"] == pytest.approx(var)
    from math import erfc, sqrt
    tails = spark.createDataFrame([(v,) for v in (-3.0, -0.5, 0.0, 1.3, 4.2, 9.0)], "z double")
    for r in tails.select("z", weights.normal_upper_tail(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(erfc(r["z"] / sqrt(2)) / 2, abs=1e-12)


def test_logistic_matches_irls(samples):
    df, rows = samples
    x = np.column_stack([np.ones(len(rows)), rows[:, 3], rows[:, 4]])
    y = rows[:, 5]
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        h = x.T @ (x * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(h, x.T @ (y - p))
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    table, resid = regression.logistic_regression(df, ["a", "b"], residuals=True)
    got = {r["term"]: r for r in table.collect()}
    for t, e, s in zip(("(Intercept)", "a", "b"), beta, se):
        assert got[t]["estimate"] == pytest.approx(e, rel=1e-4)
        assert got[t]["std_error"] == pytest.approx(s, rel=1e-3)
        assert got[t]["odds_ratio"] == pytest.approx(np.exp(got[t]["estimate"]))
    assert 0 < got["a"]["pseudo_r2"] < 1
    assert resid.agg(F.sum("z")).first()[0] == pytest.approx(0.0, abs=1e-4)
    top = regression.driver_importance(table).collect()
    assert [r["variable"] for r in top] == ["a", "b"]


def test_spatial_lag_recovers_rho(spark):
    rng = np.random.default_rng(4)
    n = 900
    xy = rng.uniform(0, 100, (n, 2))
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id bigint, x double, y double")
    w = weights.knn_weights(pts, 6).cache()
    m = dense_weights(w, n)
    a = rng.normal(size=n)
    y = np.linalg.solve(np.eye(n) - 0.5 * m, 1.0 + 2.0 * a + rng.normal(size=n) * 0.3)
    df = spark.createDataFrame([(i, float(a[i]), float(y[i])) for i in range(n)], "id bigint, a double, resp double")
    got = {r["term"]: r["estimate"] for r in regression.spatial_lag_model(df, w, ["a"], "resp").collect()}
    assert got["rho"] == pytest.approx(0.5, abs=0.05)
    assert got["a"] == pytest.approx(2.0, abs=0.05) and got["(Intercept)"] == pytest.approx(1.0, abs=0.2)


def test_gwr_matches_numpy(samples):
    df, rows = samples
    bw, n = 40, len(rows)
    xy, y = rows[:, 1:3], rows[:, 5]
    x = np.column_stack([np.ones(n), rows[:, 3], rows[:, 4]])
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    beta, hat = np.zeros((n, 3)), np.zeros(n)
    ws = np.zeros((n, n))
    for i in range(n):
        h = np.sort(d[i])[bw - 1]
        w = np.where(d[i] < h, (1 - (d[i] / h) ** 2) ** 2, 0)
        inv = np.linalg.inv(x.T @ (x * w[:, None]))
        beta[i], hat[i], ws[i] = inv @ (x.T @ (w * y)), x[i] @ inv @ x[i], w
    fit = (x * beta).sum(1)
    mean = (ws * y).sum(1) / ws.sum(1)
    r2 = 1 - (ws * (y - fit) ** 2).sum(1) / (ws * (y[None] - mean[:, None]) ** 2).sum(1)
    got = {r["id"]: r for r in regression.gwr(df, ["a", "b"], bw).collect()}
    for i in range(n):
        assert got[i]["b_a"] == pytest.approx(beta[i, 1], abs=1e-6)
        assert got[i]["b_intercept"] == pytest.approx(beta[i, 0], abs=1e-6)
        assert got[i]["local_r2"] == pytest.approx(r2[i], abs=1e-6)
    table = {r["bw"]: r for r in regression.gwr_bandwidth(df, ["a", "b"], [40, 100]).collect()}
    rss, tr = ((y - fit) ** 2).sum(), hat.sum()
    want = n * np.log(rss / n) + n * np.log(2 * np.pi) + n * (n + tr) / (n - 2 - tr)
    assert table[40]["aicc"] == pytest.approx(want)


def test_bandwidth_search_equals_full_search(samples):
    df, rows = samples
    full = regression.gwr_bandwidth(df, ["a", "b"], list(range(20, len(rows) + 1)))
    found = regression.gwr_bandwidth(df, ["a", "b"]).collect()
    best = full.first()
    assert found[0]["bw"] == best["bw"] and found[0]["aicc"] == pytest.approx(best["aicc"], rel=1e-9)
    assert len(found) < 20
    # Coefficients that vary over the map: neither the narrowest nor the widest is best.
    bent = df.withColumn("resp", F.col("a") * F.sin(F.col("x") / 25) + F.col("b") * F.col("y") / 50)
    best = regression.gwr_bandwidth(bent, ["a", "b"], list(range(20, len(rows) + 1)), "resp").first()
    found = regression.gwr_bandwidth(bent, ["a", "b"], response="resp").collect()
    assert 20 <= best["bw"] < 120 and found[0]["bw"] == best["bw"]


def test_golden_section_asks_once():
    asked = []

    def scores(places):
        asked.extend(places)
        return {p: (p - 137) ** 2 for p in places}

    for low, high in ((20, 1000), (137, 137), (100, 138), (138, 200)):
        asked.clear()
        known = regression.golden_section(scores, low, high)
        assert min(known, key=known.get) == min(max(137, low), high) and len(asked) == len(set(asked)) < 35


def test_accuracy_of_known_matrix(spark):
    pairs = [(1, 1)] * 8 + [(1, 2)] * 2 + [(2, 2)] * 9 + [(2, 1)] * 1
    df = spark.createDataFrame([("m", p, r) for p, r in pairs], "model string, pred int, ref int")
    conf = stats.confusion_matrix(df, ["model"])
    assert conf.count() == 16 and conf.agg(F.sum("n")).first()[0] == 20
    got = {r["metric"]: r["value"] for r in stats.accuracy_report(conf, ["model"]).collect()}
    assert got["OA"] == pytest.approx(0.85) and got["Kappa"] == pytest.approx(0.7)
    assert got["PA_1"] == pytest.approx(8 / 9) and got["UA_1"] == pytest.approx(0.8) and got["PA_3"] is None


def test_classifiers_learn_and_skip_incomplete(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        cls = i % 4 + 1
        v = rng.normal(size=2) * 0.3 + [(cls % 2) * 3.0, (cls // 3) * 3.0]
        rows.append((i, float(v[0]), float(v[1]), cls))
    rows += [(400, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "cell_id bigint, f1 double, f2 double, cls int").cache()
    feats = ["f1", "f2"]
    rf = classify.rf_train(df, feats, cfg=Classification(features_per_split=2), trees=10)
    svm = classify.svm_rbf_train(df, feats, size=48, max_iter=20)
    for model, shift in ((rf, 0), (svm, 1)):
        out = classify.predict_pixels(model, df, ["cell_id"], feats, shift)
        both = out.withColumnRenamed("cls", "pred").join(df, "cell_id")
        assert both.filter("pred = cls").count() >= 380
        assert both.filter("cell_id = 400").first()["pred"] is None and both.count() == 401
    imp = classify.rf_importance(rf, df, feats).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)


def test_forest_scores_many_rows_at_once_as_mllib_does_one_by_one(spark):
    """Equal classes, also with impure leaves, trees of one leaf, NaN and more rows than a block; no row passes MLlib's function."""
    rng = np.random.default_rng(3)
    rows = [(i, *(float(v) for v in rng.integers(0, 6, 2)), int(rng.integers(1, 5))) for i in range(9_000)]
    rows += [(9_000, None, 1.0, 1), (9_001, float("nan"), 1.0, 2)]
    df = spark.createDataFrame(rows, "cell_id bigint, f1 double, f2 double, cls int").coalesce(1).cache()
    few, feats = df.filter("cell_id < 300"), ["f1", "f2"]
    for cfg, train in ((Classification(features_per_split=1), few), (Classification(features_per_split=2, depth=2), few),
                       (Classification(features_per_split=1), few.filter("cls = 3"))):
        model = classify.rf_train(train, feats, cfg=cfg, trees=21)
        out = classify.predict_pixels(model, df, ["cell_id"], feats)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "UDF(" not in plan
        want = model.transform(df).select("cell_id", F.when(F.col("f1").isNotNull(), F.col("prediction").cast("int")).alias("cls"))
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_tuning_equals_separate_machines(spark):
    """Every grid point, fold and class solved alone by numpy gives the same accuracies."""
    rng = np.random.default_rng(5)
    n, size = 160, 12
    x = rng.normal(size=(n, 2))
    cls = np.where(x[:, 0] ** 2 + x[:, 1] ** 2 < 1, 1, np.where(x[:, 0] > 0, 2, 3))
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, cls)] + [(None, 1.0, 1)], "f1 double, f2 double, cls int")
    cfg = Classification(tune_costs=(0.1, 10.0), tune_gammas=(0.1, 1.0), tune_folds=3)
    got = {(r["cost"], r["gamma"]): r["accuracy"] for r in classify.svm_tune(df, ["f1", "f2"], cfg=cfg, size=size, max_iter=60).collect()}
    fold = np.array([int(hashlib.md5(f"{cfg.seed}|{a}|{b}".encode()).hexdigest()[:8], 16) % 3 for a, b in
                     [tuple(r) for r in df.dropna().select(F.col("f1").cast("string"), F.col("f2").cast("string")).collect()]])
    for gamma in cfg.tune_gammas:
        w, b = classify._fourier(2, gamma, size, cfg.seed)
        for cost in cfg.tune_costs:
            right = 0
            for k in range(3):
                out = fold != k
                mean, sd = x[out].mean(0), x[out].std(0, ddof=1)
                z = np.column_stack([np.ones(n), np.sqrt(2 / size) * np.cos((x - mean) / sd @ w.T + b)])
                scores = []
                for c in (1, 2, 3):
                    y, beta = np.where(cls == c, 1.0, -1.0), np.zeros(size + 1)
                    pen = np.diag([0.0] + [1 / (cost * out.sum())] * size)
                    loss = lambda v: np.mean(np.maximum(0, 1 - y[out] * (z[out] @ v)) ** 2) + v @ pen @ v / 2  # noqa: B023, E731
                    for _ in range(200):
                        short = np.maximum(0, 1 - y[out] * (z[out] @ beta))
                        a = z[out][short > 0]
                        grad = -2 * z[out].T @ (y[out] * short) / out.sum() + pen @ beta
                        move, t = np.linalg.solve(2 * a.T @ a / out.sum() + pen + 1e-12 * np.eye(size + 1), grad), 1.0
                        while loss(beta - t * move) > loss(beta) and t > 1e-9:
                            t /= 2
                        beta = beta - t * move
                    scores.append(z[~out] @ beta)
                right += (np.argmax(scores, axis=0) + 1 == cls[~out]).sum()
            assert got[cost, gamma] == pytest.approx(right / n, abs=1e-9)


def test_report_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "report")
    table = lambda *rows: spark.createDataFrame(rows, "k int, v int")
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).collect())
    products.refresh_report(table((1, 1), (2, 2)), path, ["k"])
    products.refresh_report(table((2, 3)), path, ["k"])
    assert read() == [(1, 1), (2, 3)]
    (tmp_path / "report").rename(tmp_path / "report-last")  # stopped after the old report went
    table((1, 7), (2, 3)).write.parquet(f"{path}-next")
    products.refresh_report(table((3, 3)), path, ["k"])
    assert read() == [(1, 7), (2, 3), (3, 3)]
    (tmp_path / "report").rename(tmp_path / "report-last")  # and with a new one half written
    (tmp_path / "report-next").mkdir()
    products.refresh_report(table((4, 4)), path, ["k"])
    assert read() == [(1, 7), (2, 3), (3, 3), (4, 4)] and not (tmp_path / "report-last").exists()


def patch_table(spark, groups=(1, 2, 3), n=120):
    rng = np.random.default_rng(8)
    cols = patches.summary_columns(["b"])
    rows = []
    for g in groups:
        for i in range(n):
            y = int(i % (g + 2) == 0)
            rows.append((g, f"{g}-{i}", ["train", "val", "test"][i // (n // 3)], y, *map(float, rng.normal(size=6) * 0.8 * g + y * (-1) ** g)))
    rows.append((1, "1-null", "train", 1, *[None] * 6))
    return spark.createDataFrame(rows, "transition_id int, patch_id string, split string, y int, " + ", ".join(f"{c} double" for c in cols)), cols


def newton(x, y, penalty):
    """Weighted penalised logistic regression of one group on scaled inputs, back in their units."""
    mean, sd = x.mean(0), x.std(0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    w = np.where(y == 1, (y == 0).sum() / max(1, y.sum()), 1.0)
    pen = np.diag([0.0] + [penalty] * x.shape[1])
    beta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + pen, z.T @ (w * (p - y)) / w.sum() + pen @ beta)
    return beta[0] - (beta[1:] / sd) @ mean, beta[1:] / sd


def test_grouped_models_equal_separate_fits(spark):
    df, cols = patch_table(spark)
    train = df.filter("split = 'train'")
    got = {(r["transition_id"], r["penalty"]): r for r in changemodel.fit_models(train, ["transition_id"], ["b"]).collect()}
    assert len(got) == 9
    for g in (1, 2, 3):
        rows = [r for r in train.collect() if r["transition_id"] == g and r[cols[0]] is not None]
        x, y = np.array([[r[c] for c in cols] for r in rows]), np.array([r["y"] for r in rows])
        for penalty in changemodel.PENALTIES:
            a, b = newton(x, y, penalty)
            r = got[g, penalty]
            assert r["intercept"] == pytest.approx(a, abs=1e-6) and r["coef"] == pytest.approx(b, abs=1e-6)
            assert (r["n_pos"], r["n_neg"], r["pos_weight"]) == (y.sum(), (1 - y).sum(), (1 - y).sum() / y.sum())
            assert r["steepness"] < 1e-9


def test_change_models_separate_and_report(spark):
    df, cols = patch_table(spark)
    val = df.filter("split = 'val'")
    models = changemodel.change_models(df.filter("split = 'train'"), val, ["transition_id"], ["b"])
    assert models.count() == 3
    every = changemodel.fit_models(df.filter("split = 'train'"), ["transition_id"], ["b"])
    for r in models.collect():  # no other penalty does better
        for other in every.filter(F.col("transition_id") == r["transition_id"]).collect():
            hits = [(1 / (1 + np.exp(-(other["intercept"] + sum(c * v[k] for c, k in zip(other["coef"], cols))))) >= 0.5, v["y"] == 1)
                    for v in val.filter(F.col("transition_id") == r["transition_id"]).collect()]
            tp = sum(a and b for a, b in hits)
            f1 = 2 * tp / max(sum(a for a, _ in hits) + sum(b for _, b in hits), 1)
            assert f1 <= r["val_f1"] + 1e-6
    scored = changemodel.score_patches(models, df.unionByName(df.limit(1).withColumn("transition_id", F.lit(9))), ["transition_id"], ["b"])
    assert scored.filter("transition_id = 9").first()["prob"] is None and scored.count() == df.count() + 1
    rep = {r["transition_id"]: r for r in changemodel.transition_report(scored, ["transition_id"]).collect()}
    assert (rep[2]["n_train"], rep[2]["n_val"], rep[2]["n_test"]) == (40, 40, 40) and rep[1]["F1"] > 0.8
    none = changemodel.transition_report(df.withColumn("prob", F.lit(0.1)).filter("split <> 'test'"), ["transition_id"]).first()
    assert none["n_test"] == 0 and none["F1"] is None
    one_class = changemodel.fit_models(df.filter("split = 'train' AND y = 0"), ["transition_id"], ["b"]).collect()
    assert all(r["n_pos"] == 0 and abs(c) < 1e-3 for r in one_class for c in r["coef"])


def test_change_of_one_pair_leaves_others(spark, tmp_path):
    """Two pairs, kept; a second run over one of them, and one with the kept models."""
    rng = np.random.default_rng(3)
    cfg, grid = Change(patch_size=4, stride_train=2, stride_infer=2, centre=2), Grid(10.0, 24, 24)
    rows = [(r * 24 + c, r, c, yr, float(rng.random()), int(rng.integers(1, 4)) if (r // 6 + c // 6 + yr) % 3 else 1)
            for yr in (2000, 2001, 2002) for r in range(24) for c in range(24)]
    stack = spark.createDataFrame(rows, "cell_id bigint, r bigint, c bigint, yr int, b double, cls int").cache()
    pairs, path = [(2000, 2001), (2001, 2002)], str(tmp_path / "change")
    run = lambda **kw: jobs.detect_change(stack, pairs, grid, cfg, ["b"], path=path, **kw)
    read = lambda name: {(r["pre_year"], r["post_year"]): r for r in spark.read.parquet(f"{path}/{name}").collect()}
    maps = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{path}/change_map").collect())
    first = run()
    assert set(read("report")) == set(pairs) == set(read("models")) and first.models.count() == 2
    report, models, whole = read("report"), read("models"), maps()
    marked = spark.read.parquet(f"{path}/report").withColumn("F1", F.when(F.col("pre_year") == 2000, F.lit(-1.0)).otherwise(F.col("F1")))
    rows_marked = marked.collect()
    spark.createDataFrame(rows_marked, marked.schema).write.mode("overwrite").parquet(f"{path}/report")
    again = run(only=[(2001, 2002)])
    assert read("report")[2000, 2001]["F1"] == -1.0  # untouched
    assert read("report")[2001, 2002].asDict() == report[2001, 2002].asDict() and set(read("models")) == set(pairs)
    assert maps() == whole and {r["transition_id"] for r in again.models.collect()} == {2}
    kept = run(only=[(2000, 2001)], skip_train=True)
    assert read("report")[2000, 2001].asDict() == report[2000, 2001].asDict() and kept.models.first()["coef"] == models[2000, 2001]["coef"]
    with pytest.raises(ValueError, match="no such transitions"):
        run(only=[(1990, 1991)])
    with pytest.raises(ValueError, match="no kept models"):
        jobs.detect_change(stack, pairs, grid, cfg, ["b"], path=f"{path}-none", skip_train=True)
    with pytest.raises(ValueError, match="no map"):
        jobs.detect_change(stack, [(2000, 1999)], grid, cfg, ["b"])
    with pytest.raises(ValueError, match="no patch with change"):
        jobs.detect_change(stack.withColumn("cls", F.lit(2)), pairs, grid, cfg, ["b"])


def test_driver_models_end_to_end(spark, samples):
    df, _ = samples
    stack = df.select(F.col("id").alias("cell_id"), F.col("id").alias("r"), F.lit(0).alias("c"), "x", "y",
                      "growth", F.col("a").alias("dist_roads"), F.col("b").alias("dist_urban"))
    out = jobs.driver_models(stack, Drivers(per_stratum=60), run_gwr=True, bandwidths=(40, 60))
    assert out.logit.count() == 3 and out.spatial_lag.count() == 4
    assert out.correlation.count() == 3 and out.gwr.count() == out.samples.count()
    assert -1 <= out.moran.first()["I"] <= 1
    with pytest.raises(ValueError):
        jobs.driver_models(stack.filter("growth = 1"))


def test_windows_of_equal_strides_are_summed_once(spark, monkeypatch):
    """The pairs are kept in files, and the windows that train also score; another stride sums its own."""
    rng = np.random.default_rng(3)
    rows = [(r * 24 + c, r, c, yr, float(rng.random()), int(rng.integers(1, 4)) if (r // 6 + c // 6 + yr) % 3 else 1)
            for yr in (2000, 2001) for r in range(24) for c in range(24)]
    stack = spark.createDataFrame(rows, "cell_id bigint, r bigint, c bigint, yr int, b double, cls int").cache()
    calls, summed = [], changemodel.patch_summaries
    monkeypatch.setattr(changemodel, "patch_summaries", lambda *a, **kw: calls.append(a[3]) or summed(*a, **kw))
    for stride, want in ((2, []), (4, [4])):
        calls.clear()
        cfg = Change(patch_size=4, stride_train=2, stride_infer=stride, centre=2)
        out = jobs.detect_change(stack, [(2000, 2001)], Grid(10.0, 24, 24), cfg, ["b"])
        assert calls == want and out.probability.inputFiles()
        pairs = jobs.labelled_pairs(stack, [(2000, 2001)], ["b"])
        alone = changemodel.change_probability(pairs, lambda p: changemodel.score_patches(out.models, p, ["transition_id"], ["b"]),
                                               cfg, ["transition_id"], ["b"])
        got, expected = ({r["cell_id"]: r["prob"] for r in df.collect()} for df in (out.probability, alone))
        assert got == pytest.approx(expected)


@pytest.mark.parametrize("name", ("svm_tune", "svm_rbf_train", "rf_train", "rf_importance", "predict_pixels", "predict_test",
                                  "train_and_evaluate"))
def test_registered_models_use_the_configured_settings(spark, monkeypatch, name):
    """No argument of a registered model differs from its default, which is the configuration."""
    class Reached(Exception):
        pass

    def caught(function):
        def stop(*args, **kwargs):
            bound = inspect.signature(function).bind(*args, **kwargs)
            changed = {k: v for k, v in bound.arguments.items()
                       if (d := inspect.signature(function).parameters[k].default) is not inspect.Parameter.empty and v != d}
            raise Reached(changed)
        return stop

    for module, function in ((classify, "rf_train"), (classify, "svm_rbf_train"), (classify, "svm_tune"), (jobs, "train_models")):
        monkeypatch.setattr(module, function, caught(getattr(module, function)))
    with pytest.raises(Reached) as found:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.value.args[0] == {}
