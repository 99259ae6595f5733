"""Stratified samples, splits and balancing with seeded hashes instead of a random stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.operators.ranking import hash_first, hash_rank, seeded_hash
from landgrid.session import bounded_local


def stratified_points(lulc: DataFrame, per_class: int, seed: int, by: Sequence[str] = ("cls",),
                      at_least: int = 50, minimum_total: int = 40) -> DataFrame:
    """Up to ``max(50, per_class)`` cells of each class; too few cells overall is an error."""
    known = lulc.filter(F.col("cls").isNotNull())
    n = max(at_least, per_class)
    if known.limit(minimum_total).count() < minimum_total:
        raise ValueError(f"fewer than {minimum_total} cells to sample from")
    return hash_first(known, by, ["cell_id"], seed, n)


def train_test_split(df: DataFrame, by: Sequence[str], ids: Sequence[str], share: float,
                     seed: int) -> DataFrame:
    """Exactly ``ceil(share * n)`` rows of each class are marked ``train``."""
    ranked = hash_rank(df, by, ids, seed)
    return ranked.withColumn("split", F.when(F.col("rk") <= F.ceil(F.col("group_n") * share), "train")
                             .otherwise("test")).drop("rk", "group_n")


def paired_split(a: DataFrame, b: DataFrame, by: Sequence[str], ids: Sequence[str],
                 share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The same rows train in both tables; tables of different size are an error."""
    left, right = a.count(), b.count()
    if left != right:
        raise ValueError(f"paired tables differ in size: {left} and {right}")
    marks = train_test_split(a, by, ids, share, seed).select(*ids, "split")
    return a.join(marks, list(ids)), b.join(marks, list(ids))


def balance_negatives(df: DataFrame, by: Sequence[str], ids: Sequence[str], ratio: int,
                      seed: int) -> DataFrame:
    """All positives and at most ``ratio`` negatives per positive; no positive is an error."""
    positives = df.filter(F.col("y") == 1)
    if positives.isEmpty():
        raise ValueError("no positive patches")
    quota = positives.groupBy(*by).agg((F.count(F.lit(1)) * ratio).alias("quota"))
    local = bounded_local(quota)
    side = quota if local is None else F.broadcast(local)
    negatives = df.filter(F.col("y") == 0).join(side, list(by))
    kept = hash_rank(negatives, by, ids, seed).filter(F.col("rk") <= F.col("quota"))
    return positives.unionByName(kept.select(*df.columns))


def growth_sample(px: DataFrame, per_stratum: int, seed: int, minimum: int = 10) -> DataFrame:
    """Up to ``per_stratum`` cells of each growth class; fewer than ten of either is an error."""
    known = px.filter(F.col("growth").isNotNull())
    sizes = known.agg(*[F.count(F.when(F.col("growth") == k, 1)) for k in (0, 1)]).first()
    if min(sizes) < minimum:
        raise ValueError(f"fewer than {minimum} cells of a growth class: {tuple(sizes)}")
    return hash_first(known, ["growth"], ["cell_id"], seed, per_stratum).drop("rk")


def regression_frame(px: DataFrame, predictors: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Complete rows, and one row with the numbers kept and dropped."""
    cols = ["growth", "x", "y", *predictors]
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    counts = px.agg(F.count(F.when(complete, 1)).alias("kept"),
                    F.count(F.when(~complete, 1)).alias("dropped"))
    return px.filter(complete), counts


def jitter_duplicates(points: DataFrame, seed: int) -> DataFrame:
    """Move points that share their coordinates by a tiny hashed offset, so that they have an
    order of nearness."""
    dup = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(
        "x", "y", F.lit(1).alias("dup"))
    span = points.agg((F.max("x") - F.min("x")).alias("sx"), (F.max("y") - F.min("y")).alias("sy"))
    sx, sy = span.first()
    spread = [s for s in (sx, sy) if s is not None and s > 0]
    eps = max(1.5e-8, 1e-6 * min(spread)) if spread else 1.5e-8

    def unit(tag: str):
        digits = F.substring(seeded_hash(seed, F.lit(tag), F.col("id")), 1, 8)
        return F.conv(digits, 16, 10).cast("double") / 4294967296.0

    joined = points.join(dup, ["x", "y"], "left")
    move = lambda axis: F.when(F.col("dup") == 1, F.col(axis) + unit(axis) * eps).otherwise(F.col(axis))
    return joined.select(*[c for c in points.columns if c not in ("x", "y")],
                         move("x").alias("x"), move("y").alias("y"))
