"""Patch-level change classifiers, one per transition, and their use as a sliding window.

All transitions and penalties are fitted together: one job per step adds up weighted gradient and curvature sums for every
model that has not come to rest, and each model takes its own damped Newton step. A fitted model is a row of a table,
so any number of transitions is scored in one join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.config import Change
from landgrid.functions.bands import FEATURES
from landgrid.operators.newton import SUMS, Fit, added, packed_sums
from landgrid.operators.patches import overlap_mean, patch_summaries, summary_columns
from landgrid.operators.stats import binary_metrics
from landgrid.session import compact, join_bounded

Scorer = Callable[[DataFrame], DataFrame]
PENALTIES = (0.001, 0.01, 0.1)


def _sums(rows: DataFrame, by: Sequence[str], inputs: Sequence[str], scale: dict[tuple, tuple[np.ndarray, np.ndarray, float]],
          live: dict[tuple[tuple, int], np.ndarray]) -> dict[tuple[tuple, int], np.ndarray]:
    """Loss, gradient and upper curvature sums of every live model, in one job. ``scale`` has mean, deviation and weight of
    positives of each group. Tasks add up their own rows, Spark the tasks."""
    groups = {g: n for n, g in enumerate(scale)}
    upper = np.triu_indices(len(inputs) + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * batch.num_rows
            of = np.array([groups[k] for k in keys], np.int64)
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in inputs])
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            for group, n in groups.items():
                own = of == n
                if not own.any():
                    continue
                mean, sd, positive = scale[group]
                z = np.column_stack([np.ones(own.sum()), (x[own] - mean) / sd])
                weight = np.where(y[own] == 1, positive, 1.0)
                for (g, k), beta in live.items():
                    if g != group:
                        continue
                    margin = z @ beta
                    p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                    loss = weight @ (np.logaddexp(0, margin) - y[own] * margin)
                    curve = z.T @ (z * (weight * p * (1 - p))[:, None])
                    part = np.concatenate([[weight.sum(), loss], z.T @ (weight * (p - y[own])), curve[upper]])
                    total[n, k] = total.get((n, k), 0.0) + part
        if total:
            yield packed_sums(total)

    parts = rows.select(*by, *inputs, "y").mapInArrow(scan, SUMS)
    names = list(groups)
    return {(names[g], k): v for (g, k), v in added(parts).items()}


def fit_models(train: DataFrame, by: Sequence[str], channels: Sequence[str] = FEATURES, penalties: Sequence[float] = PENALTIES,
               tolerance: float = 1e-9, max_steps: int = 60) -> DataFrame:
    """A model per group of ``by`` and penalty: (by, penalty, n_pos, n_neg, pos_weight, intercept, coef, steepness).

    ``coef`` is in the order of ``summary_columns`` and in their units; ``steepness`` is the largest derivative of the loss where
    the fit came to rest. Positives weigh as much as the negatives of their group. A group with one class only learns its
    share; inputs that do not vary in a group have coefficient 0. Rows with a missing input or label take no part.
    """
    by, inputs = list(by), summary_columns(channels)
    rows = compact(train.select(*by, "y", *inputs).dropna(subset=["y", *inputs]))
    try:
        positive = F.col("y") == 1
        stats = rows.groupBy(*by).agg(F.count(F.when(positive, 1)).alias("n_pos"), F.count(F.when(~positive, 1)).alias("n_neg"),
                                      F.array(*[F.avg(c) for c in inputs]).alias("mean"),
                                      F.array(*[F.stddev_pop(c) for c in inputs]).alias("sd")).collect()  # a row per group
        scale, counts, fits = {}, {}, {}
        for r in stats:
            group = tuple(r[c] for c in by)
            mean, sd = np.array(r["mean"]), np.array(r["sd"])
            flat = sd <= 1e-12 * np.maximum(np.abs(mean), 1.0)
            weight = float(r["n_neg"] / max(1, r["n_pos"]))
            scale[group] = (mean, np.where(flat, np.inf, sd), weight)
            counts[group] = (r["n_pos"], r["n_neg"], weight)
            for k, penalty in enumerate(penalties):
                fits[group, k] = Fit(float(penalty), np.zeros(len(inputs) + 1))
        for _ in range(max_steps):
            live = {key: f.at for key, f in fits.items() if not f.rest}
            if not live:
                break
            for key, v in _sums(rows, by, inputs, scale, live).items():
                fits[key].take_sums(v, tolerance)
    finally:
        rows.unpersist()
    table = []
    for (group, k), f in fits.items():
        mean, sd, _ = scale[group]
        coef = f.beta[1:] / sd
        table.append((*group, float(penalties[k]), *counts[group], float(f.beta[0] - coef @ mean), coef.tolist(), f.steepness))
    schema = T.StructType([*(train.schema[c] for c in by), T.StructField("penalty", T.DoubleType()),
                           T.StructField("n_pos", T.LongType()), T.StructField("n_neg", T.LongType()),
                           T.StructField("pos_weight", T.DoubleType()), T.StructField("intercept", T.DoubleType()),
                           T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("steepness", T.DoubleType())])
    return train.sparkSession.createDataFrame(table, schema)


def change_models(train: DataFrame, val: DataFrame, by: Sequence[str], channels: Sequence[str] = FEATURES,
                  penalties: Sequence[float] = PENALTIES) -> DataFrame:
    """Of each group's models the one with the best F1 on its validation patches, as ``val_f1``; the first penalty wins ties and
    where a group has no validation patch."""
    by = list(by)
    fitted = fit_models(train, by, channels, penalties)
    judged = binary_metrics(_scored(fitted, val.filter(F.col("y").isNotNull()), by, channels, ["penalty"]), [*by, "penalty"])
    f1 = judged.select(*by, "penalty", F.coalesce("F1", F.lit(0.0)).alias("val_f1")).toArrow().to_pylist()
    known = {(*(r[c] for c in by), r["penalty"]): r["val_f1"] for r in f1}  # a number per model
    best: dict[tuple, tuple] = {}
    order = {float(p): k for k, p in enumerate(penalties)}
    for r in fitted.toArrow().to_pylist():
        group = tuple(r[c] for c in by)
        score = known.get((*group, r["penalty"]), 0.0)
        rank = (-score, order[r["penalty"]])
        if group not in best or rank < best[group][0]:
            best[group] = (rank, (*r.values(), score))
    return train.sparkSession.createDataFrame([v for _, v in best.values()],
                                              T.StructType([*fitted.schema, T.StructField("val_f1", T.DoubleType())]))


def _scored(models: DataFrame, patches: DataFrame, by: Sequence[str], channels: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    margin = F.col("intercept")
    for k, c in enumerate(summary_columns(channels)):
        margin = margin + F.col("coef")[k] * F.col(c)
    own = models.select(*by, *more, "intercept", "coef")
    joined = join_bounded(patches, own, by, "left")
    return joined.select(*patches.columns, *more, (1 / (1 + F.exp(-margin))).alias("prob"))


def score_patches(models: DataFrame, patches: DataFrame, by: Sequence[str], channels: Sequence[str] = FEATURES) -> DataFrame:
    """``patches`` with ``prob`` by the model of their group; NULL where the group has none."""
    return _scored(models, patches, list(by), channels)


def change_probability(pairs: DataFrame, score: Scorer, cfg: Change, by: Sequence[str],
                       channels: Sequence[str] = FEATURES, windows: DataFrame | None = None) -> DataFrame:
    """Score of every complete window, averaged over the windows of each cell. ``score`` maps
    patch summaries to rows with ``prob``: fitted models or any user scorer. ``windows`` are the summaries, where
    the caller has them."""
    if windows is None:
        windows = patch_summaries(pairs, channels, cfg, cfg.stride_infer, by)
    scores = score(windows).select(*by, "r0", "c0", "prob")
    return overlap_mean(scores, pairs.select(*by, "cell_id", "r", "c"), cfg.patch_size,
                        cfg.stride_infer, by)


def transition_report(patches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per transition: patches per split and the test metrics (NULL without test patches).
    ``patches`` has columns split, prob, y."""
    counts = patches.groupBy(*by).agg(*[
        F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}") for s in ("train", "val", "test")])
    test = binary_metrics(patches.filter((F.col("split") == "test") & F.col("y").isNotNull()), by)
    return counts.join(test.select(*by, "F1", "Precision", "Recall", "IoU"), list(by), "left")
