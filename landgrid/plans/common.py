"""Helpers of the query modules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def register(into: dict[str, Query]):
    def named(name: str):
        def add(fn: Query) -> Query:
            if name in into:
                raise KeyError(name)
            into[name] = fn
            return fn
        return add
    return named


def rounded(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def keep(df: DataFrame, exact: Sequence[str], real: Sequence[str] = ()) -> DataFrame:
    return df.select(*exact, *rounded(*real))
