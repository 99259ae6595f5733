"""Class areas, accuracy tables and correlation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.config import CLASSES

AREA_COLUMNS = {1: "Urban_km2", 2: "Vegetation_km2", 3: "BareSoil_km2", 4: "Water_km2"}


def class_area(lulc: DataFrame, res: float) -> DataFrame:
    known = lulc.filter(F.col("cls").isNotNull())
    return known.groupBy("yr", "cls").agg(
        (F.count(F.lit(1)) * (res * res / 1e6)).alias("area_km2"))


def area_stats(lulc: DataFrame, res: float) -> DataFrame:
    """One row per year; an absent class is NULL and does not count in the total."""
    km2 = res * res / 1e6
    counts = lulc.groupBy(F.col("yr").alias("Year")).agg(
        *[F.count(F.when(F.col("cls") == k, 1)).alias(f"n{k}") for k in AREA_COLUMNS])
    area = {k: F.when(F.col(f"n{k}") > 0, F.col(f"n{k}") * km2) for k in AREA_COLUMNS}
    total = sum((F.col(f"n{k}") for k in AREA_COLUMNS), F.lit(0))
    return counts.select("Year", *[e.alias(AREA_COLUMNS[k]) for k, e in area.items()],
                         F.when(total > 0, total * km2).alias("Total_km2"))


def class_histogram(lulc: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    return (lulc.filter(F.col("cls").isin(*classes)).groupBy("yr", "cls")
            .agg(F.count(F.lit(1)).alias("n")))


def low_classes(df: DataFrame, minimum: int, by: Sequence[str] = ()) -> DataFrame:
    """Classes with too few samples."""
    return (df.groupBy(*by, "cls").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") < minimum))


def confusion_matrix(pred: DataFrame, by: Sequence[str], levels: Sequence[int] = CLASSES,
                     complete: str | None = None) -> DataFrame:
    """Counts over every (predicted, reference) level pair, zeros included. Rows whose
    ``complete`` flag is false are dropped first and counted in ``n_dropped``."""
    usable = F.col(complete) if complete else F.lit(True)
    cells = [(p, r) for p in levels for r in levels]
    hit = lambda p, r: F.count(F.when(usable & (F.col("pred") == p) & (F.col("ref") == r), 1))
    wide = pred.groupBy(*by).agg(F.count(F.when(~usable, 1)).alias("n_dropped"),
                                 *[hit(p, r).alias(f"m_{p}_{r}") for p, r in cells])
    return wide.select(*by, "n_dropped", F.inline(F.array(*[
        F.struct(F.lit(p).alias("pred"), F.lit(r).alias("ref"), F.col(f"m_{p}_{r}").alias("n"))
        for p, r in cells])))


def accuracy_report(confusion: DataFrame, by: Sequence[str],
                    levels: Sequence[int] = CLASSES) -> DataFrame:
    """Overall accuracy, kappa, producer's and user's accuracy in long form."""
    n, p, r = F.col("n"), F.col("pred"), F.col("ref")
    g = confusion.groupBy(*by).agg(
        F.sum("n").alias("all"), F.sum(F.when(p == r, n)).alias("diag"),
        *[e for k in levels for e in (
            F.sum(F.when(p == k, n)).alias(f"row{k}"), F.sum(F.when(r == k, n)).alias(f"col{k}"),
            F.sum(F.when((p == k) & (r == k), n)).alias(f"d{k}"))])
    ratio = lambda a, b: F.when(b > 0, a / b)
    total = F.col("all")
    po = ratio(F.col("diag"), total)
    chance = sum((F.col(f"row{k}").cast("double") * F.col(f"col{k}") for k in levels), F.lit(0.0))
    pe = ratio(chance, total.cast("double") * total)
    metrics = {"OA": po, "Kappa": F.when(pe < 1, (po - pe) / (1 - pe))}
    for k in levels:
        metrics[f"PA_{k}"] = ratio(F.col(f"d{k}"), F.col(f"col{k}"))
        metrics[f"UA_{k}"] = ratio(F.col(f"d{k}"), F.col(f"row{k}"))
    return g.select(*by, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), e.cast("double").alias("value"))
        for m, e in metrics.items()])))


def binary_metrics(scored: DataFrame, by: Sequence[str], prob: str = "prob", truth: str = "y",
                   threshold: float = 0.5) -> DataFrame:
    """Counts, precision, recall, F1 and IoU; NULL metrics for an empty set."""
    eps = 1e-9
    hit, real = F.col(prob) >= threshold, F.col(truth) == 1
    g = scored.groupBy(*by).agg(
        F.count(F.when(hit & real, 1)).alias("TP"), F.count(F.when(hit & ~real, 1)).alias("FP"),
        F.count(F.when(~hit & real, 1)).alias("FN"), F.count(F.when(~hit & ~real, 1)).alias("TN"))
    tp, fp, fn, tn = (F.col(c) for c in ("TP", "FP", "FN", "TN"))
    some = (tp + fp + fn + tn) > 0
    p, r = tp / (tp + fp + eps), tp / (tp + fn + eps)
    return g.select(*by, "TP", "FP", "FN", "TN",
                    F.when(some, p).alias("Precision"), F.when(some, r).alias("Recall"),
                    F.when(some, 2 * p * r / (p + r + eps)).alias("F1"),
                    F.when(some, tp / (tp + fp + fn + eps)).alias("IoU"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation over pairwise complete rows, one aggregation for all pairs."""
    name = {frozenset(p): f"k{i}" for i, p in enumerate(combinations(range(len(cols)), 2))}
    x = [F.col(c).cast("double") for c in cols]

    def pairwise(i: int, j: int):
        # Both sides NULL together, so that the moments see the same rows.
        both = x[i].isNotNull() & x[j].isNotNull()
        return F.corr(F.when(both, x[i]), F.when(both, x[j]))

    one = df.agg(*[pairwise(*sorted(p)).alias(k) for p, k in name.items()],
                 *[F.when(F.count(x[i]) > 1, F.lit(1.0)).alias(f"d{i}") for i in range(len(cols))])
    rows = [F.struct(F.lit(cols[i]).alias("variable"), *[
        (F.col(f"d{i}") if i == j else F.col(name[frozenset((i, j))])).alias(cols[j])
        for j in range(len(cols))]) for i in range(len(cols))]
    return one.select(F.inline(F.array(*rows)))
