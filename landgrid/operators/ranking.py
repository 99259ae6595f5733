"""Exact ranks that never gather a whole group in one task.

All ranks of a group: rows are dealt by range of (group, order) into as many parts as their number needs, sorted
inside the part and numbered as they are written. The first place and the number of rows of each group in each
part, one small row, give the rank at which the part begins. So a group with a third of all rows is ranked in many parts
and no rank passes the driver. The first n ranks only: ``row_number() <= n``, of which Spark lets every task pass on at
most n rows of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.session import stored

#: Rows sorted by one task.
PART_ROWS = 500_000


def seeded_hash(seed: int, *ids: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` first rows of each group with their rank ``rk``."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rk", F.row_number().over(window)).filter(F.col("rk") <= n).withColumn("rk", F.col("rk").cast("long"))


def exact_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with ``rk`` (1-based rank of the row in its group) and ``group_n``. Rows whose order is equal are ranked in
    any order; many of them should be told apart by a last column of ``order``, or they share a part."""
    by = list(by)
    held = stored(df, "unranked")
    parts = max(1, -(-held.count() // part_rows))
    keys = [F.col(c) for c in by] + list(order)
    numbered = stored(held.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                      .withColumn("at_", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at_", 33)
    counts = numbered.groupBy(part.alias("part_"), *by).agg(F.min("at_").alias("low_"), F.count(F.lit(1)).alias("n_"))
    earlier = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part_", *[F.col(c).alias(f"{c}_of") for c in by], (
        F.coalesce(F.sum("n_").over(earlier), F.lit(0)) - F.col("low_") + 1).alias("shift_"),
        F.sum("n_").over(Window.partitionBy(*by)).alias("group_n"))
    same = part == F.col("part_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    return numbered.join(starts, same).select(*df.columns, (F.col("at_") + F.col("shift_")).alias("rk"), "group_n")


def hash_rank(df: DataFrame, by: Sequence[str], ids: Sequence[str], seed: int) -> DataFrame:
    """``df`` with ``rk`` (1-based rank of the row's seeded hash in its group) and ``group_n``."""
    keyed = df.withColumn("h_", seeded_hash(seed, *[F.col(i) for i in ids]))
    return exact_rank(keyed, by, [F.col("h_"), *[F.col(i) for i in ids]]).drop("h_")


def hash_first(df: DataFrame, by: Sequence[str], ids: Sequence[str], seed: int, n: int) -> DataFrame:
    """The ``n`` rows of each group whose seeded hash is least, with their rank ``rk``."""
    return first_rows(df, by, [seeded_hash(seed, *[F.col(i) for i in ids]), *[F.col(i) for i in ids]], n)
