"""Two-date operators. The dates of a cell meet in one aggregation instead of a self join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.functions import classes as C

CELL = ("cell_id", "r", "c")


def spread_years(df: DataFrame, values: Sequence[str], years: Sequence[int],
                 keys: Sequence[str] = CELL) -> DataFrame:
    """One row per cell with ``<value>_<year>`` and ``has_<year>`` columns."""
    here = {y: F.col("yr") == y for y in years}
    return df.filter(F.col("yr").isin(*years)).groupBy(*keys).agg(
        *[F.max(F.when(here[y], F.col(v))).alias(f"{v}_{y}") for y in years for v in values],
        *[F.max(here[y]).alias(f"has_{y}") for y in years])


def pick_transitions(transitions: Sequence[tuple[int, int]], index: int | None = None,
                     pair: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """All configured pairs, one by 1-based index, or one explicit pair."""
    if pair is not None:
        return [tuple(pair)]
    if index is None:
        return list(transitions)
    if not 1 <= index <= len(transitions):
        raise IndexError(f"transition {index} of {len(transitions)}")
    return [transitions[index - 1]]


def transition_values(df: DataFrame, values: Sequence[str],
                      transitions: Sequence[tuple[int, int]],
                      keys: Sequence[str] = CELL, numbers: Sequence[int] | None = None) -> DataFrame:
    """One row per cell and transition where both dates have the cell, with
    ``pre_<value>`` and ``post_<value>``. Transitions are numbered from 1, or by ``numbers``."""
    years = sorted({y for t in transitions for y in t})
    wide = spread_years(df, values, years, keys)
    rows = [F.struct(F.lit(i).alias("transition_id"), F.lit(a).alias("pre_year"),
                     F.lit(b).alias("post_year"),
                     (F.col(f"has_{a}") & F.col(f"has_{b}")).alias("both"),
                     *[F.col(f"{v}_{a}").alias(f"pre_{v}") for v in values],
                     *[F.col(f"{v}_{b}").alias(f"post_{v}") for v in values])
            for i, (a, b) in zip(numbers or range(1, len(transitions) + 1), transitions)]
    return wide.select(*keys, F.inline(F.array(*rows))).filter("both").drop("both")


def transition_pairs(lulc: DataFrame, transitions: Sequence[tuple[int, int]],
                     index: int | None = None, pair: tuple[int, int] | None = None) -> DataFrame:
    return transition_values(lulc, ["cls"], pick_transitions(transitions, index, pair))


def change_reference(lulc: DataFrame, transitions: Sequence[tuple[int, int]],
                     keys: Sequence[str] = CELL) -> DataFrame:
    """1 where a cell turned urban between the two dates."""
    pairs = transition_values(lulc, ["cls"], transitions, keys)
    return pairs.withColumn("change", C.became(F.col("pre_cls"), F.col("post_cls")))


def new_urban(change: DataFrame) -> DataFrame:
    return change.filter(F.col("change") == 1)


def ndvi_loss(norm: DataFrame, y0: int, y1: int, keys: Sequence[str] = CELL) -> DataFrame:
    """Loss of the (separately normalised) NDVI, never below zero."""
    both = transition_values(norm, ["ndvi"], [(y0, y1)], keys)
    diff = F.col("pre_ndvi") - F.col("post_ndvi")
    return both.select(*keys, F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0)))
                       .alias("ndvi_loss"))
