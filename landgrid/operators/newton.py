"""Damped Newton steps for many small models at once.

Tasks add up loss, gradient and curvature of every model over their own rows, Spark adds up the tasks, and each model takes
its own step on the driver, where it is a few thousand numbers whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = "g int, k int, v array<double>"


@dataclass
class Fit:
    """One model under way: weighted logistic loss with ``penalty`` half the squared norm of the slopes, on scaled inputs."""

    penalty: float
    beta: np.ndarray
    at: np.ndarray = field(init=False)
    loss: float = np.inf
    step: float = 1.0
    direction: np.ndarray | None = None
    steepness: float = np.inf
    rest: bool = False

    def __post_init__(self) -> None:
        self.at = self.beta

    def take(self, loss: float, slope: np.ndarray, curve: np.ndarray, tolerance: float) -> None:
        """Loss and its derivatives at ``at``: go on from there if it is lower, else shorten the step."""
        loss += self.penalty / 2 * float(self.at[1:] @ self.at[1:])
        if loss <= self.loss or self.step < 1e-6:
            if loss <= self.loss:
                slope, curve = slope.copy(), curve.copy()
                slope[1:] += self.penalty * self.at[1:]
                curve[np.arange(1, len(curve)), np.arange(1, len(curve))] += self.penalty
                self.beta, self.loss, self.steepness = self.at, loss, float(np.abs(slope).max())
                self.direction, self.step = -np.linalg.pinv(curve, hermitian=True) @ slope, 1.0
            else:
                self.rest = True
            self.rest |= self.steepness < tolerance
        else:
            self.step /= 2
        self.at = self.beta + self.step * self.direction

    def take_sums(self, v: np.ndarray, tolerance: float) -> None:
        """``take`` from weight, loss, gradient and upper curvature, all summed."""
        size = len(self.beta)
        curve = np.zeros((size, size))
        curve[np.triu_indices(size)] = v[2 + size:]
        whole = max(v[0], 1e-300)
        self.take(v[1] / whole, v[2:2 + size] / whole, (curve + np.triu(curve, 1).T) / whole, tolerance)


def packed_sums(total: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    """The sums of one task as rows of ``SUMS``."""
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in total], pa.int32()), pa.array([k for _, k in total], pa.int32()),
                                       pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["g", "k", "v"])


def added(parts: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Sums over all tasks, by model."""
    total = parts.select("g", "k", F.posexplode("v").alias("at", "v")).groupBy("g", "k", "at").agg(F.sum("v").alias("v"))
    table = total.toArrow()
    g, k, at, v = (table.column(c).to_numpy() for c in ("g", "k", "at", "v"))
    out: dict[tuple[int, int], np.ndarray] = {}
    order = np.lexsort((at, k, g))
    cuts = np.flatnonzero(np.diff(g[order]) | np.diff(k[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            out[int(g[part[0]]), int(k[part[0]])] = v[part]
    return out
