"""Regressions of growth on its drivers: logistic, spatial lag, geographically weighted."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.operators.weights import lag_columns, nearest_neighbours
from landgrid.session import compact, cut_lineage

TERMS = "term string, estimate double, std_error double, z_value double, p_value double"


def usable_predictors(df: DataFrame, predictors: Sequence[str]) -> dict[str, float]:
    """Predictors that vary, with their standard deviation."""
    sd = df.agg(*[F.stddev_samp(c).alias(c) for c in predictors]).first()
    return {c: sd[c] for c in predictors if sd[c] is not None and sd[c] > 0}


def logistic_regression(df: DataFrame, predictors: Sequence[str], response: str = "growth",
                        residuals: bool = False):
    """Binomial GLM: one row per term with odds ratio and pseudo R2. With ``residuals``, also
    ``df`` with the response residual ``z``."""
    sd = usable_predictors(df, predictors)
    names = list(sd)
    scaled = df.withColumns({f"s_{c}": F.col(c) / sd[c] for c in names})
    data = VectorAssembler(inputCols=[f"s_{c}" for c in names], outputCol="features_").transform(scaled)
    rows = compact(data.select(response, "features_"))
    model = GeneralizedLinearRegression(family="binomial", link="logit", labelCol=response,
                                        featuresCol="features_", predictionCol="fit_",
                                        maxIter=50, tol=1e-12).fit(rows)
    s = model.summary
    r2 = 1.0 - s.deviance / s.nullDeviance if s.nullDeviance else None
    est = [model.intercept, *model.coefficients]
    # The summary lists the intercept last.
    turn = lambda v: [v[-1], *v[:-1]]
    se, z, p = (turn(list(v)) for v in (s.coefficientStandardErrors, s.tValues, s.pValues))
    rows.unpersist()
    scale = [1.0, *sd.values()]
    terms = [(t, float(e / k), float(x / k), float(a), float(b), _ratio(e / k), r2)
              for t, e, x, a, b, k in zip(["(Intercept)", *names], est, se, z, p, scale)]
    table = df.sparkSession.createDataFrame(terms, TERMS + ", odds_ratio double, pseudo_r2 double")
    if not residuals:
        return table
    fitted = model.transform(data).withColumn("z", F.col(response) - F.col("fit_"))
    return table, fitted.select(*df.columns, "z")


def _ratio(log_odds: float) -> float:
    """Odds ratio; infinite where it exceeds the largest double."""
    return math.exp(log_odds) if log_odds < 709.0 else math.inf


def driver_importance(table: DataFrame) -> DataFrame:
    return (table.filter(F.col("term") != "(Intercept)")
            .select(F.col("term").alias("variable"), F.abs("estimate").alias("abs_coef"))
            .orderBy(F.desc("abs_coef")))


def _moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), weight: str | None = None):
    w = F.col(weight) if weight else F.lit(1.0)
    pairs = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
    return df.groupBy(*by).agg(*[F.sum(w * F.col(cols[a]) * F.col(cols[b])).alias(f"m_{a}_{b}")
                                 for a, b in pairs]), pairs


def spatial_lag_model(df: DataFrame, weights: DataFrame, predictors: Sequence[str],
                      response: str = "growth", key: str = "id") -> DataFrame:
    """y = rho W y + X b + e by spatial two-stage least squares (Kelejian and Prucha 1998) with
    instruments X, WX, WWX. Only a small matrix of cross moments reaches the driver."""
    stats = df.agg(*[e for c in predictors for e in (F.avg(c).alias(f"a_{c}"),
                                                      F.stddev_samp(c).alias(f"s_{c}"))]).first()
    names = [c for c in predictors if stats[f"s_{c}"]]
    base = df.select(F.col(key).alias("id"), F.col(response).cast("double").alias("y"), *[
        ((F.col(c) - stats[f"a_{c}"]) / stats[f"s_{c}"]).alias(c) for c in names])
    one = lag_columns(base, weights, ["y", *names], prefix="w_")
    two = cut_lineage(lag_columns(one, weights, [f"w_{c}" for c in names], prefix="w"))
    cols = ["one_", *names, *[f"w_{c}" for c in names], *[f"ww_{c}" for c in names], "w_y", "y"]
    full = two.withColumn("one_", F.lit(1.0)).fillna(0.0, [c for c in cols if c != "one_"])
    agg, pairs = _moments(full, cols)
    row = agg.withColumn("n", F.lit(None)).first()
    m = np.zeros((len(cols), len(cols)))
    for a, b in pairs:
        m[a, b] = m[b, a] = row[f"m_{a}_{b}"]
    n, p = m[0, 0], len(names)
    z = list(range(1 + 3 * p))
    x = [cols.index("w_y"), *range(1 + p)]
    y = cols.index("y")
    inv = np.linalg.pinv(m[np.ix_(z, z)], hermitian=True)
    xz = m[np.ix_(x, z)]
    bread = np.linalg.pinv(xz @ inv @ xz.T, hermitian=True)
    beta = bread @ (xz @ inv @ m[z, y])
    rss = m[y, y] - 2 * beta @ m[x, y] + beta @ m[np.ix_(x, x)] @ beta
    cov = bread * (rss / n)
    # Back to the units of the predictors.
    back = np.eye(len(x))
    for i, c in enumerate(names, start=2):
        back[i, i] = 1.0 / stats[f"s_{c}"]
        back[1, i] = -stats[f"a_{c}"] / stats[f"s_{c}"]
    est, se = back @ beta, np.sqrt(np.maximum(np.diag(back @ cov @ back.T), 0.0))
    rows = []
    for t, e, s in zip(["rho", "(Intercept)", *names], est, se):
        zv = float(e / s) if s > 0 else None
        rows.append((t, float(e), float(s), zv,
                     math.erfc(abs(zv) / math.sqrt(2)) if zv is not None else None))
    return df.sparkSession.createDataFrame(rows, TERMS)


def _local_moments(df: DataFrame, near: DataFrame, names: Sequence[str], by: Sequence[str]):
    """Bisquare-weighted cross moments of each point's neighbourhood; ``near`` has columns
    i, j, d, h (bandwidth distance)."""
    u = F.col("d") / F.col("h")
    weighted = near.withColumn("w", F.when(F.col("h") <= 0, 1.0)
                               .when(u < 1, F.pow(1 - u * u, F.lit(2))).otherwise(0.0))
    joined = weighted.join(df.withColumnRenamed("id", "j"), "j")
    return weighted, *_moments(joined, ["one_", *names, "y"], by, "w")


def _solve(moments: DataFrame, own: DataFrame, names: Sequence[str], pairs, by: Sequence[str]) -> DataFrame:
    """Local coefficients, fitted value and hat value for each point from its moments."""
    p = len(names) + 1
    keys = [f"{f.name} {f.dataType.simpleString()}" for f in moments.select(*by).schema.fields]
    beta = [f"b_{c}" for c in ("intercept", *names)]
    schema = ", ".join([*keys, "y double", "fit double", "hat double", *[f"{b} double" for b in beta]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = np.zeros((len(f), p + 1, p + 1))
            for a, b in pairs:
                m[:, a, b] = m[:, b, a] = f[f"m_{a}_{b}"].to_numpy()
            x = np.column_stack([np.ones(len(f)), *[f[c].to_numpy() for c in names]])
            inv = np.linalg.pinv(m[:, :p, :p], hermitian=True)
            coef = np.einsum("nij,nj->ni", inv, m[:, :p, p])
            out = f[[*by, "y"]].copy()
            out["fit"] = np.einsum("ni,ni->n", x, coef)
            out["hat"] = np.einsum("ni,nij,nj->n", x, inv, x)
            for i, b in enumerate(beta):
                out[b] = coef[:, i]
            yield out

    return moments.join(own.withColumnRenamed("id", "i"), "i").mapInPandas(run, schema=schema)


def _standardised(df: DataFrame, predictors: Sequence[str], response: str, key: str):
    stats = df.agg(*[e for c in predictors for e in (F.avg(c).alias(f"a_{c}"),
                                                      F.stddev_samp(c).alias(f"s_{c}"))]).first()
    names = [c for c in predictors if stats[f"s_{c}"]]
    base = df.select(F.col(key).alias("id"), "x", "y", F.col(response).cast("double").alias("resp_"),
                     *[((F.col(c) - stats[f"a_{c}"]) / stats[f"s_{c}"]).alias(c) for c in names])
    values = base.select("id", F.lit(1.0).alias("one_"), *names, F.col("resp_").alias("y"))
    return cut_lineage(base.select("id", "x", "y")), cut_lineage(values), names, stats


def _with_self(near: DataFrame, points: DataFrame) -> DataFrame:
    own = points.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d"),
                        F.lit(0).alias("rank"))
    return near.select("i", "j", "d", "rank").unionByName(own)


def gwr(df: DataFrame, predictors: Sequence[str], bandwidth: int, response: str = "growth",
        key: str = "id") -> DataFrame:
    """Local coefficients and local R2 of an adaptive bisquare regression. ``bandwidth`` counts
    the point itself."""
    points, values, names, stats = _standardised(df, predictors, response, key)
    near = cut_lineage(_with_self(nearest_neighbours(points, bandwidth - 1), points))
    reach = near.groupBy("i").agg(F.max("d").alias("h"))
    near = near.join(reach, "i")
    weighted, moments, pairs = _local_moments(values, near, names, ["i"])
    local = cut_lineage(_solve(moments, values.drop("one_"), names, pairs, ["i"]))
    fitted = local.select(F.col("i").alias("j"), F.col("y").alias("yj"), F.col("fit").alias("fj"))
    w, y, e = F.col("w"), F.col("yj"), F.col("yj") - F.col("fj")
    fit = weighted.join(fitted, "j").groupBy("i").agg(
        F.sum(w).alias("sw"), F.sum(w * y).alias("swy"), F.sum(w * y * y).alias("swyy"),
        F.sum(w * e * e).alias("rss"))
    tss = F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")
    r2 = fit.select("i", F.when(tss > 1e-12, 1 - F.col("rss") / tss).alias("local_r2"))
    shift = F.col("b_intercept")
    for c in names:
        shift = shift - F.col(f"b_{c}") * (stats[f"a_{c}"] / stats[f"s_{c}"])
    slopes = [(F.col(f"b_{c}") / stats[f"s_{c}"]).alias(f"b_{c}") for c in names]
    return (local.join(r2, "i").join(points.withColumnsRenamed({"id": "i", "y": "py"}), "i")
            .select(F.col("i").alias("id"), "x", F.col("py").alias("y"), "fit", "hat",
                    shift.alias("b_intercept"), *slopes, "local_r2"))


def _bandwidth_scores(near: DataFrame, values: DataFrame, names: Sequence[str], bandwidths: Sequence[int]) -> list[tuple]:
    """(bw, n, rss, enp, aicc) of each bandwidth, in one job over the neighbour table."""
    wide = near.select("*", F.explode(F.array(*[F.lit(int(b)) for b in bandwidths])).alias("bw"))
    wide = wide.filter(F.col("rank") < F.col("bw"))
    reach = wide.groupBy("i", "bw").agg(F.max("d").alias("h"))
    _, moments, pairs = _local_moments(values, wide.join(reach, ["i", "bw"]), names, ["i", "bw"])
    local = _solve(moments, values.drop("one_"), names, pairs, ["i", "bw"])
    e = F.col("y") - F.col("fit")
    sums = local.groupBy("bw").agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("rss"), F.sum("hat").alias("tr"))
    out = []
    for r in sums.collect():  # a row per bandwidth
        n, tr = r["n"], r["tr"]
        free = n - 2 - tr
        known = free > 0 and r["rss"] > 0
        aicc = n * math.log(r["rss"] / n) + n * math.log(2 * math.pi) + n * (n + tr) / free if known else math.inf
        out.append((r["bw"], n, r["rss"], tr, aicc))
    return out


def golden_section(scores: Callable[[list[int]], dict[int, float]], low: int, high: int) -> dict[int, float]:
    """Scores met on the way to the least one of a unimodal function on the integers ``low`` to ``high``; each is asked for once."""
    known: dict[int, float] = {}

    def ask(*places: int) -> None:
        new = sorted({p for p in places if p not in known})
        if new:
            known.update(scores(new))

    ratio = (math.sqrt(5) - 1) / 2
    while high - low > 2:
        step = ratio * (high - low)
        left = round(high - step)
        right = max(round(low + step), left + 1)
        ask(left, right)
        if known[left] <= known[right]:
            high = right
        else:
            low = left
    ask(*range(low, high + 1))
    return known


def gwr_bandwidth(df: DataFrame, predictors: Sequence[str], candidates: Sequence[int] | None = None, response: str = "growth",
                  key: str = "id", lower: int = 20, upper: int | None = None) -> DataFrame:
    """AICc of bandwidths from one neighbour search, best first: of all ``candidates``, or of those that a golden-section search
    meets between ``lower`` and ``upper`` (every point by default). The neighbour table has n times the widest bandwidth rows,
    so a large sample should bound ``upper``."""
    points, values, names, _ = _standardised(df, predictors, response, key)
    n = points.count()
    low, high = max(lower, len(names) + 3), min(upper or n, n)
    widest = max(candidates) if candidates else max(high, min(low, n))
    near = cut_lineage(_with_self(nearest_neighbours(points, widest - 1), points))
    rows: dict[int, tuple] = {}

    def scores(bandwidths: list[int]) -> dict[int, float]:
        found = _bandwidth_scores(near, values, names, bandwidths)
        rows.update({r[0]: r for r in found})
        return {r[0]: r[4] for r in found}

    if candidates:
        scores(list(candidates))
    else:
        golden_section(scores, min(low, high), high)
    return df.sparkSession.createDataFrame(list(rows.values()), "bw int, n bigint, rss double, enp double, aicc double").orderBy("aicc")
