"""Regressions in plain SQL: sums, Gauss-Jordan elimination column by column, Newton steps written out."""

from __future__ import annotations

from collections.abc import Sequence

#: Marks an expression that is to be computed once.
ONCE = "/* once */"


def eliminate(name: str, source: str, keys: Sequence[str], size: int, right: int) -> dict[str, str]:
    """CTEs ``name0`` on: the systems in columns ``m_i_j`` of ``source`` (``right`` right-hand sides behind ``size`` columns) solved
    for every row; solutions stand in columns ``size`` on of the last one, ``name{size - 1}``."""
    out = {}
    for k in range(size):
        cells = []
        for i in range(size):
            for j in range(k + 1, size + right):
                cells.append(f"m_{k}_{j} / m_{k}_{k} AS m_{k}_{j}" if i == k else f"m_{i}_{j} - m_{i}_{k} * m_{k}_{j} / m_{k}_{k} AS m_{i}_{j}")
        out[f"{name}{k}"] = f"{ONCE} SELECT {', '.join([*keys, *cells])} FROM {source}"
        source = f"{name}{k}"
    return out


def logistic(rows: str, y: str, predictors: Sequence[str], steps: int = 12) -> dict[str, str]:
    """CTEs of a binomial regression by Newton steps on predictors over their deviation; ``terms`` has (k, est, se, pr2)."""
    p = len(predictors) + 1
    scaled = ", ".join(f"{c} / s_{k} AS x{k}" for k, c in enumerate(predictors, 1))
    out = {
        "spread": f"{ONCE} SELECT " + ", ".join(f"stddev_samp({c}) AS s_{k}" for k, c in enumerate(predictors, 1)) + f" FROM {rows}",
        "lx": f"{ONCE} SELECT CAST({y} AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS x0, {scaled} FROM {rows}, spread",
        "beta0": "SELECT " + ", ".join(f"CAST(0 AS DOUBLE) AS b{i}" for i in range(p)),
    }
    eta = " + ".join(f"b{i} * x{i}" for i in range(p))
    for t in range(steps + 1):
        out[f"mu{t}"] = f"SELECT *, 1 / (1 + exp(-e)) AS mu FROM (SELECT *, {eta} AS e FROM lx, beta{t}) z"
        sums = [f"sum(mu * (1 - mu) * x{min(i, j)} * x{max(i, j)}) AS m_{i}_{j}" for i in range(p) for j in range(p)]
        if t < steps:
            sums += [f"sum(x{i} * (mu * (1 - mu) * e + y - mu)) AS m_{i}_{p}" for i in range(p)]
            out[f"sums{t}"] = f"{ONCE} SELECT {', '.join(sums)} FROM mu{t}"
            out |= eliminate(f"it{t}_", f"sums{t}", [], p, 1)
            out[f"beta{t + 1}"] = f"{ONCE} SELECT " + ", ".join(f"m_{i}_{p} AS b{i}" for i in range(p)) + f" FROM it{t}_{p - 1}"
        else:
            sums += [f"CAST({int(i == j)} AS DOUBLE) AS m_{i}_{p + j}" for i in range(p) for j in range(p)]
            out["information"] = f"{ONCE} SELECT {', '.join(sums)} FROM mu{t}"
            out |= eliminate("inverse", "information", [], p, p)
    out["fits"] = f"{ONCE} SELECT 1 - sum(y * ln(mu) + (1 - y) * ln(1 - mu)) / (count(*) * (any_value(q) * ln(any_value(q)) + (1 - any_value(q)) * ln(1 - any_value(q)))) AS pr2 " \
                  f"FROM mu{steps}, (SELECT avg(y) AS q FROM lx) a"
    out["terms"] = " UNION ALL ".join(
        f"SELECT {i} AS k, b{i} / {'s_%d' % i if i else '1'} AS est, sqrt(m_{i}_{p + i}) / {'s_%d' % i if i else '1'} AS se, pr2 FROM beta{steps}, inverse{p - 1}, fits, spread"
        for i in range(p))
    return out


#: Two-sided tail of the normal distribution by the series of the error function, for z of at most about 8.
TAIL = """SELECT z.k, CASE WHEN abs(z.z) > 8 THEN 0 ELSE 1 - sum(exp(ln(x) + n * ln(2 * x * x) - lf)) * 2 / sqrt(pi()) * exp(-x * x) END AS p FROM
 (SELECT k, est / se AS z, abs(est / se) / sqrt(2e0) AS x FROM terms) z,
 (SELECT n, sum(CASE WHEN n = 0 THEN 0 ELSE ln(2e0 * n + 1) END) OVER (ORDER BY n) AS lf FROM generate_series(0, 250) g(n)) s GROUP BY z.k, z.z, x"""
