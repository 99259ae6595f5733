"""Land-cover classifiers on MLlib and their use on pixel tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.config import Classification
from landgrid.functions import classes as C
from landgrid.functions.bands import FEATURES
from landgrid.operators.focal import focal_majority
from landgrid.operators.forest import forest_classes
from landgrid.operators.newton import SUMS, Fit, added, packed_sums
from landgrid.operators.pixels import denormalize
from landgrid.operators.ranking import hash_first, seeded_hash
from landgrid.session import compact


def complete(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    return df.dropna(subset=list(features))


def training_points(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "cls", by: Sequence[str] = ("sensor",),
                    ids: Sequence[str] = ("cell_id", "yr"), cfg: Classification = Classification()) -> DataFrame:
    """The labelled rows models are fitted on: of each sensor and class at most ``cfg.n_per_class`` complete rows, those of
    least seeded hash. Tasks pass on no more than that many rows of a class, so the sample costs one narrow shuffle."""
    known = complete(df, [*features, label]).select(*by, label, *ids, *features)
    return hash_first(known, [*by, label], ids, cfg.seed, cfg.n_per_class).drop("rk")


def rf_train(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "cls",
             cfg: Classification = Classification(), trees: int | None = None) -> PipelineModel:
    """Random forest on the complete rows; four features are tried per split."""
    rows = compact(complete(df, [*features, label]).select(
        *features, F.col(label).cast("double").alias("label_")))
    forest = RandomForestClassifier(
        labelCol="label_", featuresCol="features_", numTrees=trees or cfg.trees,
        featureSubsetStrategy=str(cfg.features_per_split), maxDepth=cfg.depth, seed=cfg.seed,
        # Rows keep the node they have reached, so a level does not ship the forest grown so far.
        cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=1024)
    assemble = VectorAssembler(inputCols=list(features), outputCol="features_", handleInvalid="keep")
    try:
        return Pipeline(stages=[assemble, forest]).fit(rows)
    finally:
        rows.unpersist()


def rf_importance(model: PipelineModel, df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Gini importance per feature, highest first."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double") \
             .orderBy(F.desc("importance"))


def _fourier_statement(df: DataFrame, features: Sequence[str], gamma: float, size: int,
                       seed: int) -> str:
    """Random Fourier features of the RBF kernel on standardised inputs (Rahimi and Recht 2007)
    as one SQL projection: weights are literals, the cosine runs inside generated code."""
    stats = df.agg(*[e for f in features for e in (F.avg(f).alias(f"a_{f}"),
                                                   F.stddev_samp(f).alias(f"s_{f}"))]).first()
    w, b = _fourier(len(features), gamma, size, seed)
    std = [f"((`{f}` - {stats[f'a_{f}']!r}D) / {(stats[f's_{f}'] or 1.0)!r}D)" for f in features]
    amp = math.sqrt(2.0 / size)
    cols = []
    for i in range(size):
        dot = " + ".join(f"{float(w[i, j])!r}D * {std[j]}" for j in range(len(features)))
        cols.append(f"{amp!r}D * cos({dot} + {float(b[i])!r}D) AS rff_{i}")
    return "SELECT *, " + ", ".join(cols) + " FROM __THIS__"


def _training_rows(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Complete labelled rows with labels from 0."""
    return compact(complete(df, [*features, label]).select(
        *features, (F.col(label).cast("double") - 1).alias("label_")))


def svm_pipeline(df: DataFrame, features: Sequence[str], gamma: float, cost: float, rows: int, size: int = 48,
                 seed: int = 42, max_iter: int = 20) -> tuple[Pipeline, OneVsRest, LinearSVC]:
    project = SQLTransformer(statement=_fourier_statement(df, features, gamma, size, seed))
    assemble = VectorAssembler(inputCols=[f"rff_{i}" for i in range(size)], outputCol="features_",
                               handleInvalid="keep")
    svc = LinearSVC(maxIter=max_iter, regParam=1.0 / (cost * max(rows, 1)), standardization=False,
                    aggregationDepth=2)
    ovr = OneVsRest(classifier=svc, labelCol="label_", featuresCol="features_", parallelism=4)
    return Pipeline(stages=[project, assemble, ovr]), ovr, svc


def svm_rbf_train(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "cls",
                  gamma: float | None = None, cost: float = 1.0, size: int = 48,
                  seed: int = 42, max_iter: int = 20) -> PipelineModel:
    """RBF machine: random Fourier features and one linear machine per class."""
    rows = _training_rows(df, features, label)
    try:
        pipeline, _, _ = svm_pipeline(rows, features, gamma or 1.0 / len(features), cost, rows.count(), size,
                                      seed, max_iter)
        return pipeline.fit(rows)
    finally:
        rows.unpersist()


def _fourier(features: int, gamma: float, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, math.sqrt(2.0 * gamma), (size, features)), rng.uniform(0.0, 2 * math.pi, size)


def svm_tune(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "cls",
             cfg: Classification = Classification(), size: int = 48, max_iter: int = 20) -> DataFrame:
    """Cross-validated accuracy of every (cost, gamma), best first.

    Folds are seeded hashes of the inputs, so equal rows share one. Inputs are scaled and projected by the rows outside a fold, learned
    on those and judged on the rows inside. The machines of all grid points, folds and classes (squared hinge, so that they have
    a curvature) take their steps together: a job per step over the rows, one more to judge."""
    features, costs, gammas = list(features), cfg.tune_costs, cfg.tune_gammas
    fold = F.conv(F.substring(seeded_hash(cfg.seed, *[F.col(f) for f in features]), 1, 8), 16, 10).cast("bigint") % cfg.tune_folds
    known = complete(df, [*features, label]).select(*features, F.col(label).cast("int").alias("label_"))
    rows = compact(known.withColumn("fold_", fold.cast("int")))
    try:
        moments = rows.groupBy("fold_").agg(F.count(F.lit(1)), *[F.sum(f) for f in features], *[F.sum(F.col(f) * F.col(f)) for f in features],
                                            F.collect_set("label_")).collect()  # a row per fold
        classes = sorted({c for r in moments for c in r[-1]})
        sums = {r[0]: np.array(r[1:-1], float) for r in moments}
        whole = sum(sums.values(), np.zeros(1 + 2 * len(features)))
        scale, n_out = {}, {}
        for k, own in sums.items():
            out = whole - own
            n_out[k] = max(out[0], 1.0)
            mean, square = out[1:1 + len(features)] / n_out[k], out[1 + len(features):] / n_out[k]
            sd = np.sqrt(np.maximum(square - mean * mean, 0.0) * n_out[k] / max(n_out[k] - 1, 1))
            scale[k] = mean, np.where(sd > 0, sd, 1.0)
        maps = [_fourier(len(features), gamma, size, cfg.seed) for gamma in gammas]
        units = [(g, k) for g in range(len(gammas)) for k in sorted(sums)]
        machines = [(cost, c) for cost in costs for c in classes]
        fits = {(u, m): Fit(1.0 / (cost * n_out[k]), np.zeros(size + 1)) for u, (_, k) in enumerate(units) for m, (cost, _) in enumerate(machines)}
        upper = np.triu_indices(size + 1)

        def projected(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            """(unit, projected rows, labels, whether inside the fold)."""
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
            y, at = batch.column("label_").to_numpy(zero_copy_only=False), batch.column("fold_").to_numpy(zero_copy_only=False)
            for u, (g, k) in enumerate(units):
                w, b = maps[g]
                mean, sd = scale[k]
                z = math.sqrt(2.0 / size) * np.cos((x - mean) / sd @ w.T + b)
                yield u, np.column_stack([np.ones(len(x)), z]), y, at == k

        def steps(live: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total: dict[tuple[int, int], np.ndarray] = {}
                for batch in batches:
                    for u, z, y, inside in projected(batch) if batch.num_rows else ():
                        z, y = z[~inside], y[~inside]
                        for m, (_, c) in enumerate(machines):
                            if (u, m) not in live or not len(z):
                                continue
                            sign = np.where(y == c, 1.0, -1.0)
                            short = np.maximum(0.0, 1.0 - sign * (z @ live[u, m]))
                            wrong = z[short > 0]
                            part = np.concatenate([[len(z), short @ short], -2.0 * (z.T @ (sign * short)), 2.0 * (wrong.T @ wrong)[upper]])
                            total[u, m] = total.get((u, m), 0.0) + part
                if total:
                    yield packed_sums(total)

            return added(rows.mapInArrow(scan, SUMS))

        for _ in range(max_iter):
            live = {key: f.at for key, f in fits.items() if not f.rest}
            if not live:
                break
            for key, v in steps(live).items():
                fits[key].take_sums(v, 1e-6)
        weights = {u: np.stack([fits[u, m].beta for m in range(len(machines))], axis=1) for u in range(len(units))}

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            right = {(u, j): np.zeros(1) for u in range(len(units)) for j in range(len(costs))}
            for batch in batches:
                for u, z, y, inside in projected(batch) if batch.num_rows else ():
                    score = (z[inside] @ weights[u]).reshape(-1, len(costs), len(classes))
                    best = np.array(classes)[score.argmax(axis=2)] if len(score) else np.zeros((0, len(costs)))
                    for j in range(len(costs)):
                        right[u, j] += (best[:, j] == y[inside]).sum()
            yield packed_sums(right)

        hits = {key: v[0] for key, v in added(rows.mapInArrow(judge, SUMS)).items()}
    finally:
        rows.unpersist()
    table = [(float(cost), float(gamma), float(sum(hits.get((u, j), 0.0) for u, (at, _) in enumerate(units) if at == g) / max(whole[0], 1.0)))
             for g, gamma in enumerate(gammas) for j, cost in enumerate(costs)]
    return df.sparkSession.createDataFrame(table, "cost double, gamma double, accuracy double") \
                .orderBy(F.desc("accuracy"), "cost", "gamma")


def predict_pixels(model: PipelineModel, px: DataFrame, keys: Sequence[str],
                   features: Sequence[str] = FEATURES, first_label: int = 0) -> DataFrame:
    """Class of every pixel; a pixel with a missing layer keeps its row with a NULL class."""
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    px = px.withColumn("whole_", whole)
    if isinstance(model.stages[-1], RandomForestClassificationModel):
        scored = forest_classes(model.stages[-1], px, keys, model.stages[0].getInputCols(), "whole_")
        return scored.withColumn("cls", F.col("cls") + first_label) if first_label else scored
    scored = model.transform(px)
    return scored.select(*keys, F.when(F.col("whole_"), F.col("prediction").cast("int") + first_label)
                         .alias("cls"))


def predict_test(model: PipelineModel, df: DataFrame, name: str, sensor: str,
                 features: Sequence[str] = FEATURES, label: str = "cls",
                 first_label: int = 0) -> DataFrame:
    """(model, sensor, pred, ref) of the complete test rows."""
    rows = complete(df, features)
    out = predict_pixels(model, rows.withColumn("ref_", F.col(label)), ["ref_"], features, first_label)
    return out.select(F.lit(name).alias("model"), F.lit(sensor).alias("sensor"),
                      F.col("cls").alias("pred"), F.col("ref_").cast("int").alias("ref"))


def pick_best_model(accuracy: DataFrame, by: Sequence[str] = ("sensor",)) -> DataFrame:
    """Model with the highest kappa per sensor, the first name on ties, the random forest when
    no kappa is known. A minimum of structs, so no sort."""
    k = accuracy.filter(F.col("metric") == "Kappa")
    usable = F.col("value").isNotNull() & ~F.isnan("value")
    best = k.groupBy(*by).agg(F.min(F.when(usable, F.struct((-F.col("value")).alias("v"), "model")))
                              .alias("b"))
    return best.select(*by, F.coalesce("b.model", F.lit("RandomForest")).alias("model"))


def classify_year(predicted: DataFrame, norm: DataFrame, params: DataFrame,
                  skip_focal: bool = False) -> DataFrame:
    """Round and clamp, majority filter, spectral rules on physical index values, clamp."""
    cls = predicted.select("cell_id", "r", "c", "yr", C.clamp_class(F.col("cls")).alias("cls"))
    if not skip_focal:
        cls = focal_majority(cls)
    raw = denormalize(norm, params, ["mndwi", "ndvi"]).select("cell_id", "yr", "raw_mndwi", "raw_ndvi")
    ruled = C.spectral_rules(F.col("cls"), F.col("raw_mndwi"), F.col("raw_ndvi"))
    return cls.join(raw, ["cell_id", "yr"], "left").select(
        "cell_id", "r", "c", "yr", C.clamp_class(ruled).alias("cls"))


def class_weight(df: DataFrame, by: Sequence[str], label: str = "y") -> DataFrame:
    """pos_weight = negatives / max(1, positives)."""
    g = df.groupBy(*by).agg(F.count(F.when(F.col(label) == 1, 1)).alias("n_pos"),
                            F.count(F.when(F.col(label) == 0, 1)).alias("n_neg"))
    return g.withColumn("pos_weight", F.col("n_neg") / F.greatest("n_pos", F.lit(1)))
