"""Nearest-neighbour weights and the statistics built on them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.operators.quadtree import Quadtree


def nearest_neighbours(points: DataFrame, k: int) -> DataFrame:
    """(i, j, d, rank) for the ``k`` nearest other points, the lower id first on ties."""
    return Quadtree(points, k).nearest()


def knn_weights(points: DataFrame, k: int = 8) -> DataFrame:
    """Row-standardised weights (i, j, w) of the nearest neighbours."""
    near = nearest_neighbours(points, k)
    share = F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("i"))
    return near.select("i", "j", share.alias("w"))


def lag_columns(df: DataFrame, weights: DataFrame, cols: Sequence[str], key: str = "id",
                prefix: str = "lag_") -> DataFrame:
    """Weighted mean of the neighbours for several columns with one join."""
    right = df.select(F.col(key).alias("j"), *cols)
    lags = weights.join(right, "j").groupBy("i").agg(
        *[F.sum(F.col("w") * F.col(c)).alias(f"{prefix}{c}") for c in cols])
    return df.join(lags.withColumnRenamed("i", key), key, "left")


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z): the series of the error function with positive terms only, and beyond 2.5 the continued
    fraction of its complement, which keeps the digits of small tails."""
    x = F.abs(z) / math.sqrt(2.0)
    below = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda acc, i: x + (i / 2.0) / acc)
    far = F.exp(-x * x) / (math.sqrt(math.pi) * below) / 2.0
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(250)),
        F.struct(x.alias("t"), x.alias("s")),
        lambda acc, i: F.struct((acc["t"] * x * x * 2.0 / (i * 2 + 1)).alias("t"),
                                (acc["s"] + acc["t"] * x * x * 2.0 / (i * 2 + 1)).alias("s")),
        lambda acc: acc["s"])
    erf = F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-x * x) * terms
    tail = F.when(x > 2.5, far).otherwise((1.0 - erf) / 2.0)
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def morans_i(values: DataFrame, weights: DataFrame, value: str = "z") -> DataFrame:
    """Moran's I of ``value`` (column ``id`` names the point) with its moments under
    randomisation and the one-sided p."""
    mean = values.agg(F.avg(value)).first()[0]
    dev = values.select("id", (F.col(value) - F.lit(mean)).alias("d"))
    moments = dev.agg(F.count(F.lit(1)).cast("double").alias("n"),
                      F.sum(F.col("d") * F.col("d")).alias("m2"),
                      F.sum(F.pow("d", F.lit(4))).alias("m4"))
    cross = (weights.join(dev.select(F.col("id").alias("i"), F.col("d").alias("di")), "i")
             .join(dev.select(F.col("id").alias("j"), F.col("d").alias("dj")), "j")
             .agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("di") * F.col("dj")).alias("zz")))
    pair = weights.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(
        F.sum("w").alias("s"))
    s1 = pair.agg(F.sum(F.col("s") * F.col("s")).alias("s1"))
    ends = weights.select(F.inline(F.array(F.struct(F.col("i").alias("p"), "w"),
                                           F.struct(F.col("j").alias("p"), "w"))))
    s2 = ends.groupBy("p").agg(F.sum("w").alias("s")).agg(
        F.sum(F.col("s") * F.col("s")).alias("s2"))
    # Four one-row tables side by side.
    one = lambda df: df.withColumn("k_", F.lit(0))
    row = reduce(lambda a, b: a.join(b, "k_"), [one(t) for t in (moments, cross, s1, s2)])
    n, s0, s1c, s2c, m2 = (F.col(c) for c in ("n", "s0", "s1", "s2", "m2"))
    b2 = n * F.col("m4") / (m2 * m2)
    expect = F.lit(-1.0) / (n - 1)
    second = (n * ((n * n - 3 * n + 3) * s1c - n * s2c + 3 * s0 * s0)
              - b2 * ((n * n - n) * s1c - 2 * n * s2c + 6 * s0 * s0)) / (
        (n - 1) * (n - 2) * (n - 3) * s0 * s0)
    row = row.withColumns({"I": n / s0 * F.col("zz") / m2, "expected": expect,
                           "variance": second - expect * expect})
    row = row.withColumn("z", (F.col("I") - F.col("expected")) / F.sqrt("variance"))
    return row.select("I", "expected", "variance", "z", normal_upper_tail(F.col("z")).alias("p"))
