"""Queries on samples, models, spatial statistics and composed jobs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from landgrid.config import Drivers, Geometry, Grid, Sprawl
from landgrid.functions import classes as C
from landgrid.functions.bands import FEATURES
from landgrid.operators.change import change_reference, transition_pairs, transition_values
from landgrid.operators import (changemodel, classify, patches, pixels, regression, report,
                                sampling, stats, weights)
from landgrid.plans import jobs
from landgrid.plans.common import keep, register, rounded
from landgrid.plans.drivers import PREDICTORS, coarse_grid, driver_stack
from landgrid.plans.queries_grids import patch_labels, patch_pairs
from landgrid.plans.queries_zones import NEXT_YEAR
from landgrid.session import cut_lineage, scratch_path
from landgrid.sources import products, testbed
from landgrid.sources.products import write_product

QUERIES = {}
query = register(QUERIES)
SPRAWL = Sprawl(centre_xy=testbed.CENTRE)
SEED, FACTOR = 42, 2
Y0, Y1 = 1995, 2001
BY = ["transition_id"]


def stored_stack(spark, sf):
    """The stack as the later steps see it: written once."""
    return cut_lineage(stack(spark, sf))


def stack(spark, sf):
    """Predictor stack on cells of twice the size."""
    px = testbed.px(spark, sf)
    feat = pixels.feature_stack(px).select("cell_id", "r", "c", "yr", "sensor", "ndvi")
    norm = pixels.minmax_normalize(feat, pixels.minmax_params(feat, ["ndvi"]), ["ndvi"])
    cover = testbed.land_cover(spark, sf)
    return driver_stack(testbed.lulc(spark, sf), Y0, Y1, testbed.grid(spark, sf), FACTOR,
                        testbed.CENTRE, roads=testbed.roads(spark, sf), ndvi=norm,
                        population=cover, dem=cover)


def drivers(spark, sf):
    """Complete sampled rows of the stack."""
    return jobs.sample_drivers(stored_stack(spark, sf), Drivers(), PREDICTORS)[0]


def sample_weights(df):
    return cut_lineage(weights.knn_weights(df.select("id", "x", "y"), 8))


def training(spark, sf):
    """Features of all years with the reference class of the cell, and the unlabelled frame."""
    feat = pixels.feature_stack(testbed.px(spark, sf))
    cover = testbed.land_cover(spark, sf).select(
        "cell_id", C.remap(F.col("code"), C.WORLDCOVER).alias("cls"))
    return feat.join(cover, "cell_id", "left")


@query("stratified_points")
def stratified_points(spark, sf):
    lulc = testbed.lulc(spark, sf)
    return sampling.stratified_points(lulc, 100, SEED, ["yr", "cls"]).select("yr", "cls", "cell_id", "rk")


@query("train_test_split")
def train_test_split(spark, sf):
    known = testbed.lulc(spark, sf).dropna(subset=["cls"])
    return sampling.train_test_split(known, ["yr", "cls"], ["cell_id"], 0.7, SEED).select(
        "yr", "cls", "cell_id", "split")


@query("paired_split")
def paired_split(spark, sf):
    """Two sensors' tables over the cells that have a class in both years."""
    lulc = testbed.lulc(spark, sf)
    both = cut_lineage(transition_values(lulc, ["cls"], [(1997, 1998)]).dropna(subset=["pre_cls", "post_cls"]))
    a = both.select("cell_id", F.col("pre_cls").alias("cls"))
    b = both.select("cell_id", F.col("post_cls").alias("cls"))
    left, right = sampling.paired_split(a, b, ["cls"], ["cell_id"], 0.7, SEED)
    tag = lambda df, s: df.select(F.lit(s).alias("sensor"), "cell_id", "cls", "split")
    return tag(left, "landsat").unionByName(tag(right, "sentinel"))


@query("spatial_block_split")
def spatial_block_split(spark, sf):
    labelled, st = patch_labels(spark, sf)
    return labelled.select("transition_id", "r0", "c0",
                           patches.split_column(SEED, st.change).alias("split"))


@query("split_seed_search")
def split_seed_search(spark, sf):
    labelled, st = patch_labels(spark, sf)
    return patches.choose_split_seed(labelled, BY, st.change)


@query("balance_negatives")
def balance_negatives(spark, sf):
    """Cells of each transition: all changed ones and as many unchanged."""
    cells = change_reference(testbed.lulc(spark, sf), testbed.TRANSITIONS) \
        .select("transition_id", "cell_id", F.col("change").alias("y"))
    return sampling.balance_negatives(cells, BY, ["cell_id"], 1, SEED)


@query("driver_stack")
def driver_stack_query(spark, sf):
    return keep(stack(spark, sf), ["cell_id", "growth"], PREDICTORS)


@query("growth_sample")
def growth_sample(spark, sf):
    return sampling.growth_sample(stored_stack(spark, sf), 100, SEED).select("cell_id", "growth")


@query("regression_frame")
def regression_frame(spark, sf):
    return keep(drivers(spark, sf), ["cell_id", "growth"], ["x", "y", *PREDICTORS])


@query("dedupe_coordinates")
def dedupe_coordinates(spark, sf):
    """Line starts: many share their position."""
    points = testbed.roads(spark, sf).select(F.col("seg_id").alias("id"), F.col("x1").alias("x"),
                                             F.col("y1").alias("y"))
    return keep(sampling.jitter_duplicates(points, SEED), ["id"], ["x", "y"])


@query("correlation_matrix")
def correlation_matrix(spark, sf):
    cols = ["growth", *PREDICTORS]
    return keep(stats.correlation_matrix(stack(spark, sf), cols), ["variable"], cols)


@query("corr_long_lower")
def corr_long_lower(spark, sf):
    cols = ["growth", *PREDICTORS]
    matrix = stats.correlation_matrix(stack(spark, sf), cols)
    return keep(report.corr_lower(matrix, cols), ["variable", "other"], ["r"])


@query("driver_ci")
def driver_ci(spark, sf):
    """Correlations with growth as coefficients, with their standard error."""
    df = stack(spark, sf)
    n = F.col("n")
    one = df.agg(*[F.corr(F.when(F.col(p).isNotNull(), F.col("growth")), p).alias(p) for p in PREDICTORS],
                 F.avg("growth").alias("(Intercept)"), F.count("growth").alias("n"))
    terms = one.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("term"), F.col(f"`{t}`").alias("estimate"),
                 F.sqrt((1 - F.col(f"`{t}`") * F.col(f"`{t}`")) / (n - 2)).alias("std_error"))
        for t in ("(Intercept)", *PREDICTORS)])))
    return keep(report.driver_ci(terms), ["term", "direction"], ["estimate", "lo", "hi"])


@query("knn_weights")
def knn_weights(spark, sf):
    return weights.knn_weights(drivers(spark, sf).select("id", "x", "y"), 8)


@query("spatial_lag_column")
def spatial_lag_column(spark, sf):
    df = drivers(spark, sf)
    lagged = weights.lag_columns(df, sample_weights(df), ["growth", "elevation"])
    return keep(lagged, ["id"], ["lag_growth", "lag_elevation"])


@query("morans_i")
def morans_i(spark, sf):
    df = drivers(spark, sf)
    out = weights.morans_i(df.select("id", F.col("growth").alias("z")), sample_weights(df))
    return keep(out, [], ["I", "expected", "variance", "z", "p"])


@query("logistic_regression")
def logistic_regression(spark, sf):
    out = regression.logistic_regression(drivers(spark, sf), PREDICTORS)
    fine = [F.round(c, 9).alias(c) for c in ("estimate", "std_error")]
    return out.select("term", *fine, *rounded("z_value", "p_value", "odds_ratio", "pseudo_r2"))


@query("driver_importance")
def driver_importance(spark, sf):
    out = regression.driver_importance(regression.logistic_regression(drivers(spark, sf), PREDICTORS))
    return out.withColumn("abs_coef", F.round("abs_coef", 9))


@query("spatial_lag_model")
def spatial_lag_model(spark, sf):
    df = drivers(spark, sf)
    return regression.spatial_lag_model(df, sample_weights(df), PREDICTORS)


@query("gwr")
def gwr(spark, sf):
    return regression.gwr(drivers(spark, sf), PREDICTORS, 60)


@query("gwr_bandwidth")
def gwr_bandwidth(spark, sf):
    return regression.gwr_bandwidth(drivers(spark, sf), PREDICTORS)


def sensor_points(spark, sf):
    """Stored training points of every sensor."""
    return cut_lineage(classify.training_points(training(spark, sf)))


def by_sensor(points):
    """(sensor, its points); sensors are few."""
    names = sorted(r["sensor"] for r in points.select("sensor").distinct().collect())
    return [(s, points.filter(F.col("sensor") == s)) for s in names]


def scored_by_sensor(spark, sf, fit, first_label=0):
    """Every pixel of every year under the model of its sensor; the incomplete ones without a class."""
    px, out = training(spark, sf), None
    for sensor, points in by_sensor(sensor_points(spark, sf)):
        scored = classify.predict_pixels(fit(points), px.filter(F.col("sensor") == sensor), ["cell_id", "yr"],
                                         first_label=first_label)
        out = scored if out is None else out.unionByName(scored)
    return out


@query("rf_train")
def rf_train(spark, sf):
    """Class counts predicted by the forest of each sensor."""
    return scored_by_sensor(spark, sf, classify.rf_train).groupBy("yr", "cls").count()


@query("rf_importance")
def rf_importance(spark, sf):
    out = None
    for sensor, points in by_sensor(sensor_points(spark, sf)):
        imp = classify.rf_importance(classify.rf_train(points), points).withColumn("sensor", F.lit(sensor))
        out = imp if out is None else out.unionByName(imp)
    return out


@query("svm_rbf_train")
def svm_rbf_train(spark, sf):
    return scored_by_sensor(spark, sf, classify.svm_rbf_train, 1).groupBy("yr", "cls").count()


@query("svm_tune")
def svm_tune(spark, sf):
    out = None
    for sensor, points in by_sensor(sensor_points(spark, sf)):
        tuned = classify.svm_tune(points).withColumn("sensor", F.lit(sensor))
        out = tuned if out is None else out.unionByName(tuned)
    return out


@query("predict_pixels")
def predict_pixels(spark, sf):
    return scored_by_sensor(spark, sf, classify.rf_train)


@query("predict_test")
def predict_test(spark, sf):
    out = None
    for sensor, points in by_sensor(sensor_points(spark, sf)):
        df = points.withColumn("id", F.concat_ws("-", "cell_id", "yr"))
        marked = cut_lineage(sampling.train_test_split(df, ["cls"], ["id"], 0.7, SEED))
        model = classify.rf_train(marked.filter("split = 'train'"))
        pred = classify.predict_test(model, marked.filter("split = 'test'"), "RandomForest", sensor)
        out = pred if out is None else out.unionByName(pred)
    return out


@query("model_facts")
def model_facts(spark, sf):
    """What must hold of the models whatever they learned: points per sensor, shares of importance that sum to one, a class
    exactly where no layer is missing, and that only classes of the points are predicted."""
    points = sensor_points(spark, sf)
    px, out = training(spark, sf), None
    for sensor, own in by_sensor(points):
        model = classify.rf_train(own)
        total = sum(r["importance"] for r in classify.rf_importance(model, own).collect())
        scored = classify.predict_pixels(model, px.filter(F.col("sensor") == sensor), ["cell_id", "yr"])
        known = [r["cls"] for r in own.select("cls").distinct().collect()]
        facts = scored.groupBy("yr").agg(
            F.count(F.lit(1)).alias("n_pixels"), F.count("cls").alias("n_classed"),
            F.count(F.when(~F.col("cls").isin(known), 1)).alias("n_unknown")).select(
            F.lit(sensor).alias("sensor"), "yr", "n_pixels", "n_classed", "n_unknown",
            F.lit(own.count()).cast("long").alias("n_points"), F.lit(round(total, 6)).alias("importance_sum"))
        out = facts if out is None else out.unionByName(facts)
    return out


@query("pick_best_model")
def pick_best_model(spark, sf):
    """The class one and two years later as two competing models of each sensor."""
    two = [(a, b + 1) for a, b in NEXT_YEAR[:-1]]
    pairs = transition_pairs(testbed.lulc(spark, sf), [*NEXT_YEAR, *two])
    pred = pairs.select(
        F.when(F.col("post_year") - F.col("pre_year") == 1, "one_year").otherwise("two_years").alias("model"),
        F.when(F.col("pre_year") <= 1997, "landsat").otherwise("sentinel").alias("sensor"),
        F.col("post_cls").alias("pred"), F.col("pre_cls").alias("ref"))
    acc = stats.accuracy_report(stats.confusion_matrix(pred, ["model", "sensor"]), ["model", "sensor"])
    return classify.pick_best_model(acc)


@query("classify_year")
def classify_year(spark, sf):
    """Post-processing of a given class map."""
    norm, params, _ = jobs.preprocess_year(testbed.px(spark, sf))
    out = classify.classify_year(testbed.lulc(spark, sf), norm, params)
    return out.select("cell_id", "yr", "cls")


@query("class_weight")
def class_weight(spark, sf):
    labelled, _ = patch_labels(spark, sf)
    return keep(classify.class_weight(labelled, BY), ["transition_id", "n_pos", "n_neg"], ["pos_weight"])


@query("transition_report")
def transition_report(spark, sf):
    """Report of a plain score: the share of change in the whole window."""
    st = testbed.study(spark, sf)
    pairs = patch_pairs(spark, sf)
    p = patches.patch_summaries(pairs, ["ndvi"], st.change, st.change.stride_train, BY)
    p = p.withColumn("block", patches.block_id(st.grid, st.change))
    p = p.withColumns({"split": patches.split_column(SEED, st.change),
                       "prob": F.col("diff_ndvi_mean") * 2})
    out = changemodel.transition_report(p, BY)
    return keep(out, ["transition_id", "n_train", "n_val", "n_test"], ["F1", "Precision", "Recall", "IoU"])


@query("change_model_train")
def change_model_train(spark, sf):
    """Patch probabilities of the trained change models."""
    marked, models = _models(spark, sf)
    scored = changemodel.score_patches(models, marked, BY)
    return scored.select("transition_id", "patch_id", "split", "y", "prob")


@query("change_models")
def change_models(spark, sf):
    """What must hold of the models: one per transition, weighted by its own patches, at rest."""
    _, models = _models(spark, sf)
    return models.select("transition_id", "n_pos", "n_neg", F.round("pos_weight", 6).alias("pos_weight"),
                         (F.col("steepness") < 1e-7).alias("at_rest"))


def _models(spark, sf):
    labelled, st = _summaries(spark, sf)
    marked = cut_lineage(jobs.split_patches(labelled, st.change, BY))
    return marked, changemodel.change_models(marked.filter("split = 'train'"), marked.filter("split = 'val'"), BY)


def _summaries(spark, sf):
    st = testbed.study(spark, sf)
    p = patches.patch_summaries(patch_pairs(spark, sf), FEATURES, st.change, st.change.stride_train, BY)
    return cut_lineage(p.withColumn("block", patches.block_id(st.grid, st.change))), st


@query("sliding_change_prob")
def sliding_change_prob(spark, sf):
    """Probability per cell from a user scorer over all windows."""
    st = testbed.study(spark, sf)
    score = lambda p: p.withColumn("prob", F.least(F.col("diff_ndvi_mean") * 2, F.lit(1.0)))
    out = changemodel.change_probability(patch_pairs(spark, sf), score, st.change, BY)
    return keep(out, ["transition_id", "cell_id"], ["prob"])


@query("preprocess_year")
def preprocess_year(spark, sf):
    norm, _, _ = jobs.preprocess_year(testbed.px(spark, sf))
    return keep(norm, ["cell_id", "yr", "sensor"], FEATURES)


@query("preprocess_scene")
def preprocess_scene(spark, sf):
    """A stored scene of one year, laid on another grid: two features on cells of 800 m."""
    src = Geometry(testbed.grid(spark, sf), "UTM37S")
    path = scratch_path(spark, "scene")
    scene = testbed.px(spark, sf).filter("yr = 2001").select("cell_id", "r", "c", "yr", *[
        F.col(b).alias(b.upper()) for b in ("b02", "b03", "b04", "b08", "b11", "b12", "scl")])
    write_product(scene, path, geometry=src)
    dst = Geometry(Grid(res=800.0, nrows=int(src.grid.nrows * 1.25), ncols=62, x0=150.0, y0=-100.0), "UTM37S")
    out = jobs.preprocess_scene(spark, path, "sentinel", dst)
    return keep(out.features, ["r", "c", "yr"], ["b08", "ndvi"])


@query("compare_products")
def compare_products(spark, sf):
    """Products with equal cells on the same geometry, and on others that differ in one thing each."""
    grid = testbed.grid(spark, sf)
    base = Geometry(grid, "UTM37S")
    cases = {"same": base, "resolution": Geometry(replace(grid, res=900.0), "UTM37S"), "origin": Geometry(replace(grid, x0=500.0), "UTM37S"),
             "system": Geometry(grid, "EPSG:4326"), "size": Geometry(replace(grid, nrows=grid.nrows + 1), "UTM37S")}
    cells = testbed.lulc(spark, sf).filter("yr = 2001")
    first, out = scratch_path(spark, "product"), None
    write_product(cells, first, geometry=base)
    for name, geometry in cases.items():
        path = scratch_path(spark, "product")
        write_product(cells, path, geometry=geometry)
        row = products.compare_products(spark, first, path).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("auto_training_samples")
def auto_training_samples(spark, sf):
    grid = testbed.grid(spark, sf)
    return jobs.auto_training_samples(testbed.land_cover(spark, sf), grid, grid, 100, SEED)


@query("train_and_evaluate")
def train_and_evaluate(spark, sf):
    grid = testbed.grid(spark, sf)
    points = jobs.auto_training_samples(testbed.land_cover(spark, sf), grid, grid, 400, SEED)
    feat = pixels.feature_stack(testbed.px(spark, sf))
    out = jobs.train_models(feat, cut_lineage(points), grid, {"landsat": 1997, "sentinel": 2001})
    return out.accuracy


@query("detect_change")
def detect_change(spark, sf):
    st = testbed.study(spark, sf)
    out = jobs.detect_change(testbed.channels(spark, sf), testbed.TRANSITIONS, st.grid, st.change)
    return out.change_map.groupBy("transition_id", "change").count()


@query("change_report")
def change_report(spark, sf):
    """The report that the composed job keeps: a row per pair, with metrics exactly where there are test patches."""
    st = testbed.study(spark, sf)
    out = jobs.detect_change(testbed.channels(spark, sf), testbed.TRANSITIONS, st.grid, st.change, path=scratch_path(spark, "change")).report
    known = (F.col("F1").isNotNull() == (F.col("n_test") > 0)) & (F.col("F1").isNull() | F.col("F1").between(0, 1))
    return out.select("pre_year", "post_year", "n_train", "n_val", "n_test", known.alias("known"))


@query("sprawl_metrics")
def sprawl_metrics(spark, sf):
    """Entropy and landscape tables of the composed job side by side."""
    out = jobs.sprawl_metrics(testbed.lulc(spark, sf), testbed.study(spark, sf))
    both = out.entropy.join(out.landscape, "year")
    return keep(both, ["year", "n_zones"], ["H", "H_rel", "PD", "LPI", "ED", "AI", "MPA"])


@query("driver_models")
def driver_models(spark, sf):
    """Terms of the logistic and the spatial lag model of the composed job."""
    out = jobs.driver_models(stored_stack(spark, sf), grid=coarse_grid(testbed.grid(spark, sf), FACTOR))
    tag = lambda df, m: df.select(F.lit(m).alias("model"), "term", "estimate", "std_error", "p_value")
    return tag(out.logit, "logistic").unionByName(tag(out.spatial_lag, "spatial_lag"))
