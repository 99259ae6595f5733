"""Composed jobs: the entry points of a study."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.config import Change, Classification, Drivers, Geometry, Grid, Study
from landgrid.functions import bands as B
from landgrid.functions import classes as C
from landgrid.functions.classes import became
from landgrid.operators import (change, changemodel, classify, components, landscape, patches,
                                pixels, regression, resample, sampling, stats, vectors,
                                weights, zones)
from landgrid.plans.drivers import PREDICTORS
from landgrid.session import cut_lineage, join_bounded, stored
from landgrid.sources.products import product_geometry, refresh_report, scan_scene, stored_product, write_product


def preprocess_year(px: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw scenes of all years to normalised features, their parameters and quality figures.
    Two passes over the scenes: one for all statistics, one to normalise."""
    feat = pixels.feature_stack(px)
    layer_table = cut_lineage(pixels.layer_stats(feat))
    params = pixels.params_of(layer_table)
    return pixels.minmax_normalize(feat, params), params, pixels.quality_of(layer_table)


@dataclass
class Preprocessed:
    features: DataFrame
    params: DataFrame
    quality: DataFrame


def preprocess_scene(spark: SparkSession, path: str, sensor: str, dst: Geometry) -> Preprocessed:
    """A stored scene from its reader to normalised features: named, masked, scaled, laid on the study's geometry (the scene
    brings its own record), with indices, parameters and quality figures."""
    src = product_geometry(spark, path)
    if src is None:
        raise ValueError(f"no geometry record beside {path}")
    keys = ("cell_id", "r", "c", "yr")
    px = pixels.canonicalize(scan_scene(spark, path, sensor, keys)).withColumnsRenamed({"SCL": "scl", "QA_PIXEL": "qa"})
    flag = "qa" if sensor == "sentinel" else "scl"
    px = px.withColumns({"sensor": F.lit(sensor), flag: F.lit(None).cast("bigint")})
    aligned = resample.align(pixels.reflectance(px), src, dst, B.BANDS, ["yr", "sensor"])
    feat = pixels.with_indices(aligned).withColumn("cell_id", F.col("r") * dst.grid.ncols + F.col("c"))
    feat = feat.select("cell_id", "r", "c", "yr", "sensor", *B.FEATURES)
    layer_table = cut_lineage(pixels.layer_stats(feat))
    params = pixels.params_of(layer_table)
    return Preprocessed(pixels.minmax_normalize(feat, params), params, pixels.quality_of(layer_table))


def auto_training_samples(land_cover: DataFrame, src: Grid, dst: Grid, per_class: int,
                          seed: int, source: str = "worldcover") -> DataFrame:
    """Training points (id, class, x, y) drawn from a reference land-cover map."""
    table = C.WORLDCOVER if source == "worldcover" else C.GLOBELAND30
    cls = land_cover.select("r", "c", C.remap(F.col("code"), table).alias("cls"))
    grid = resample.resample_nearest(cls, src, dst, ["cls"])
    if grid.filter(F.col("cls").between(1, 4)).isEmpty():
        raise ValueError("reference map has no usable class")
    numbered = grid.withColumn("cell_id", F.col("r") * dst.ncols + F.col("c"))
    points = sampling.stratified_points(numbered, per_class, seed)
    return pixels.cell_xy(points, dst).select(F.col("cell_id").alias("id"),
                                              F.col("cls").alias("class"), "x", "y")


@dataclass
class TrainedModels:
    models: dict[tuple[str, str], PipelineModel]
    accuracy: DataFrame
    importance: DataFrame
    best: DataFrame
    low_classes: DataFrame


def train_models(feat: DataFrame, points: DataFrame, grid: Grid, train_years: dict[str, int],
                 cfg: Classification = Classification(), trees: int | None = None,
                 svm_size: int = 48, path: str | None = None) -> TrainedModels:
    """Forest and RBF machine per sensor on one shared split, with accuracy and importance."""
    tables = {}
    for sensor, year in train_years.items():
        year_px = feat.filter((F.col("sensor") == sensor) & (F.col("yr") == year))
        tables[sensor] = cut_lineage(
            vectors.extract_at_points(year_px, points, grid, B.FEATURES, "inner")
            .select("id", F.col("class").alias("cls"), *B.FEATURES))
    first = next(iter(tables))
    # Points seen by every sensor, so that both tables hold the same rows.
    ids = tables[first].select("id")
    for df in tables.values():
        ids = ids.join(df.select("id"), "id", "left_semi")
    tables = {s: df.join(ids, "id", "left_semi") for s, df in tables.items()}
    marks = cut_lineage(sampling.train_test_split(tables[first], ["cls"], ["id"], cfg.train_share,
                                                  cfg.seed).select("id", "split"))
    models, accuracy, importance = {}, None, None
    for sensor, df in tables.items():
        df = cut_lineage(df.join(marks, "id"))
        train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
        fits = {"RandomForest": (classify.rf_train(train, cfg=cfg, trees=trees), 0),
                "SVM": (classify.svm_rbf_train(train, cost=cfg.svm_cost, size=svm_size), 1)}
        for name, (model, shift) in fits.items():
            models[(sensor, name)] = model
            if path:
                model.write().overwrite().save(f"{path}/{sensor}-{name}")
            pred = classify.predict_test(model, test, name, sensor, first_label=shift)
            conf = stats.confusion_matrix(pred, ["model", "sensor"])
            acc = stats.accuracy_report(conf, ["model", "sensor"])
            accuracy = acc if accuracy is None else accuracy.unionByName(acc)
        imp = classify.rf_importance(fits["RandomForest"][0], df).withColumn("sensor", F.lit(sensor))
        importance = imp if importance is None else importance.unionByName(imp)
    accuracy = cut_lineage(accuracy)
    return TrainedModels(models, accuracy, importance, classify.pick_best_model(accuracy),
                         stats.low_classes(tables[first], cfg.min_samples))


@dataclass
class ChangeResult:
    patches: DataFrame
    models: DataFrame
    probability: DataFrame
    change_map: DataFrame
    report: DataFrame


def labelled_pairs(stack: DataFrame, transitions: Sequence[tuple[int, int]], channels: Sequence[str] = B.FEATURES,
                   numbers: Sequence[int] | None = None) -> DataFrame:
    pairs = change.transition_values(stack, [*channels, "cls"], transitions, numbers=numbers)
    return pairs.withColumn("change", became(F.col("pre_cls"), F.col("post_cls")))


def split_patches(labelled: DataFrame, cfg: Change, by: Sequence[str]) -> DataFrame:
    """Spatial split under the first seed that works for each transition."""
    seeds = cut_lineage(patches.choose_split_seed(labelled, by, cfg))
    bad = [tuple(r[c] for c in by) for r in seeds.filter("seed IS NULL").collect()]  # one row per transition
    if bad:
        raise ValueError(f"no split seed of {cfg.seeds} puts a positive patch into training and any into validation: {by} {bad}")
    marked = join_bounded(labelled, seeds, list(by), "inner")
    out = F.lit(None).cast("string")
    for s in cfg.seeds:
        out = F.when(F.col("seed") == s, patches.split_column(s, cfg)).otherwise(out)
    return marked.withColumn("split", out)


def detect_change(stack: DataFrame, transitions: Sequence[tuple[int, int]], grid: Grid, cfg: Change,
                  channels: Sequence[str] = B.FEATURES, seed: int = 42, only: Sequence[tuple[int, int]] | None = None,
                  path: str | None = None, skip_train: bool = False) -> ChangeResult:
    """Label, split, balance, train, score and clean the change maps of all transitions, or of those in ``only``.

    Every transition has its own model, class weight and row of the report. With ``path``, models, report, probability and change
    map are kept there; a run over some pairs replaces their rows and leaves the others as they are. ``skip_train`` takes
    the models kept by an earlier run."""
    by = ["transition_id"]
    number = {pair: i for i, pair in enumerate(transitions, start=1)}
    pairs_now = [tuple(pair) for pair in (transitions if only is None else only)]
    if unknown := [pair for pair in pairs_now if pair not in number]:
        raise ValueError(f"no such transitions: {unknown} of {list(transitions)}")
    there = {r["yr"] for r in stack.select("yr").distinct().collect()}
    if missing := sorted({y for pair in pairs_now for y in pair} - there):
        raise ValueError(f"no map for {missing}")
    numbers = [number[pair] for pair in pairs_now]
    # The wide tables are kept as Parquet: made once, and later steps read the columns they need.
    pairs = stored(labelled_pairs(stack, pairs_now, channels, numbers), "pairs")
    labelled = patches.patch_summaries(pairs, channels, cfg, cfg.stride_train, by)
    labelled = cut_lineage(labelled.withColumn("block", patches.block_id(grid, cfg)))
    changed = {r["transition_id"] for r in labelled.filter("y = 1").select("transition_id").distinct().collect()}
    if bare := [pair for pair in pairs_now if number[pair] not in changed]:
        raise ValueError(f"no patch with change in {bare}: lower the label's threshold, its square or the training stride")
    marked = cut_lineage(split_patches(labelled, cfg, by))
    years = stack.sparkSession.createDataFrame([(number[a, b], a, b) for a, b in pairs_now],
                                               "transition_id int, pre_year int, post_year int")
    if skip_train:
        kept = stored_product(stack.sparkSession, f"{path}/models") if path else None
        models = None if kept is None else kept.join(F.broadcast(years), ["pre_year", "post_year"]).select(
            "transition_id", "penalty", "n_pos", "n_neg", "pos_weight", "intercept", "coef", "steepness", "val_f1")
        if models is None or models.count() < len(pairs_now):
            raise ValueError(f"no kept models of {pairs_now} in {path}")
    else:
        train = sampling.balance_negatives(marked.filter("split = 'train'"), by, ["patch_id"],
                                           cfg.negatives_per_positive, seed)
        models = changemodel.change_models(train, marked.filter("split = 'val'"), by, channels)
    score = lambda p: changemodel.score_patches(models, p, by, channels)
    same = labelled if cfg.stride_infer == cfg.stride_train else None
    prob = stored(changemodel.change_probability(pairs, score, cfg, by, channels, same), "prob")
    post = pairs.select(*by, "cell_id", F.col("post_cls").alias("cls"))
    clean = components.sieve_small(prob, post, cfg.min_component, by)
    report = changemodel.transition_report(score(marked), by).join(F.broadcast(years), by)
    if path:
        keys = ["pre_year", "post_year"]
        if not skip_train:
            refresh_report(models.join(F.broadcast(years), by).drop("transition_id"), f"{path}/models", keys)
        report = refresh_report(report.drop("transition_id"), f"{path}/report", keys)
        tag = F.concat_ws("_", "pre_year", "post_year").alias("transition")
        for name, table in (("change_prob", prob), ("change_map", clean)):
            write_product(table.join(F.broadcast(years), by).select(*table.columns, tag), f"{path}/{name}", True, "transition")
    return ChangeResult(marked, models, prob, clean, report)


@dataclass
class SprawlTables:
    zones: DataFrame
    entropy: DataFrame
    shares: DataFrame
    ueii: DataFrame
    hotspots: DataFrame
    landscape: DataFrame
    directions: DataFrame


def sprawl_metrics(lulc: DataFrame, study: Study) -> SprawlTables:
    """All ring, wedge and landscape tables of a class-map series."""
    grid, cfg, years = study.grid, study.sprawl, study.years
    there = {r["yr"] for r in lulc.select("yr").distinct().collect()}
    if missing := sorted(set(years) - there):
        raise ValueError(f"no class map for {missing}")
    counts = cut_lineage(zones.zone_counts(zones.with_ring(lulc, grid, cfg), years))
    area = cut_lineage(zones.zone_area(lulc, grid, cfg))
    ueii = zones.expansion_intensity(counts, area, study.transitions, grid)
    sectors = zones.sector_counts(lulc, grid, cfg, (years[0], years[-1]))
    return SprawlTables(
        zones=zones.zone_wide(counts, area, years, grid, cfg),
        entropy=zones.shannon_entropy(counts),
        shares=zones.zone_shares(counts),
        ueii=ueii,
        hotspots=zones.hotspots(ueii, cfg, len(study.transitions)),
        landscape=landscape.landscape_metrics(lulc, grid.res),
        directions=zones.directional_growth(sectors, years[0], years[-1]))


@dataclass
class DriverTables:
    samples: DataFrame
    dropped: DataFrame
    logit: DataFrame
    importance: DataFrame
    moran: DataFrame
    spatial_lag: DataFrame
    correlation: DataFrame
    gwr: DataFrame | None = None
    bandwidths: DataFrame | None = None
    local_r2: DataFrame | None = None


def sample_drivers(stack: DataFrame, cfg: Drivers,
                   predictors: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    drawn = cut_lineage(sampling.growth_sample(stack, cfg.per_stratum, cfg.seed))
    rows, counts = sampling.regression_frame(drawn, predictors)
    rows = rows.withColumn("id", F.col("cell_id"))
    return cut_lineage(rows), counts


def driver_models(stack: DataFrame, cfg: Drivers = Drivers(), run_gwr: bool = False,
                  bandwidths: Sequence[int] | None = None, grid: Grid | None = None) -> DriverTables:
    """Sample the stack and explain growth: logistic, Moran, spatial lag, correlation, and the
    local regression on request, at the best of ``bandwidths`` or the one a search finds."""
    names = [p for p in PREDICTORS if p in stack.columns]
    df, dropped = sample_drivers(stack, cfg, names)
    n = df.count()
    if n < 10:
        raise ValueError(f"only {n} complete samples")
    logit, residuals = regression.logistic_regression(df, names, residuals=True)
    points = sampling.jitter_duplicates(df.select("id", "x", "y"), cfg.seed)
    w = cut_lineage(weights.knn_weights(points, cfg.knn))
    out = DriverTables(
        samples=df, dropped=dropped, logit=logit, importance=regression.driver_importance(logit),
        moran=weights.morans_i(residuals.select("id", "z"), w),
        spatial_lag=regression.spatial_lag_model(df, w, names),
        correlation=stats.correlation_matrix(df, ["growth", *names]))
    if run_gwr:
        usable = None if bandwidths is None else [b for b in bandwidths if b < n] or [max(2, n - 1)]
        out.bandwidths = cut_lineage(regression.gwr_bandwidth(df, names, usable))
        out.gwr = regression.gwr(df, names, out.bandwidths.first()["bw"])
        if grid is not None:
            out.local_r2 = vectors.points_to_cells(out.gwr, grid, "local_r2", "local_r2")
    return out


