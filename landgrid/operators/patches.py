"""Sliding windows over two-date stacks: assembly, labels, splits, overlap mean."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.config import Change, Grid

WINDOW = ("r0", "c0")


def origins(v: Column, size: int, stride: int) -> Column:
    """Origins 0, stride, 2*stride, ... of the windows that hold index ``v``."""
    first = F.greatest(F.ceil((v - (size - 1)) / stride).cast("bigint"), F.lit(0).cast("bigint"))
    last = F.floor(v / stride).cast("bigint")
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * stride))


def to_windows(px: DataFrame, size: int, stride: int) -> DataFrame:
    """Each cell once per window that holds it."""
    rows = px.withColumn("r0", F.explode(origins(F.col("r"), size, stride)))
    return rows.withColumn("c0", F.explode(origins(F.col("c"), size, stride)))


def _complete(channels: Sequence[str], size: int) -> Column:
    whole = F.lit(True)
    for c in channels:
        whole = whole & F.col(f"pre_{c}").isNotNull() & F.col(f"post_{c}").isNotNull()
    return F.count(F.when(whole, 1)) == size * size


def patch_windows(pairs: DataFrame, channels: Sequence[str], size: int, stride: int,
                  by: Sequence[str]) -> DataFrame:
    """Complete windows with one array per channel and date, in row-major order. A window
    with any missing cell or value is dropped."""
    pos = (F.col("r") - F.col("r0")) * size + F.col("c") - F.col("c0")
    cell = F.struct(pos.alias("pos"), *[f"{d}_{c}" for c in channels for d in ("pre", "post")])
    g = to_windows(pairs, size, stride).groupBy(*by, *WINDOW).agg(
        _complete(channels, size).alias("ok"), F.array_sort(F.collect_list(cell)).alias("cells"))
    return g.filter("ok").select(*by, *WINDOW, *[
        F.col(f"cells.{d}_{c}").alias(f"{d}_{c}") for c in channels for d in ("pre", "post")])


def _complete_cell(channels: Sequence[str]) -> Column:
    whole = F.lit(True)
    for c in channels:
        whole = whole & F.col(f"pre_{c}").isNotNull() & F.col(f"post_{c}").isNotNull()
    return whole


def _centre_sums(pairs: DataFrame, cfg: Change, stride: int, by: Sequence[str]) -> DataFrame:
    """Cells with known change, and changed ones, of every window's central square. Only the cells of such squares are sent."""
    off, k = (cfg.patch_size - cfg.centre) // 2, cfg.centre
    known = pairs.filter(F.col("change").isNotNull())
    rows = known.withColumn("r0", F.explode(origins(F.col("r") - off, k, stride)))
    cells = rows.withColumn("c0", F.explode(origins(F.col("c") - off, k, stride)))
    return cells.groupBy(*by, *WINDOW).agg(F.count(F.lit(1)).alias("n_change"), F.sum("change").alias("s_change"))


def patch_summaries(pairs: DataFrame, channels: Sequence[str], cfg: Change, stride: int,
                    by: Sequence[str], statistics: bool = True) -> DataFrame:
    """Complete windows with their label ``y`` (1 when the share of change in the central square reaches the threshold)
    and, per channel, mean and deviation of both dates and of their absolute difference.

    Windows are unions of ``gcd(size, stride)`` blocks: cells add up per block, and only the block's sums go to the windows
    that hold it. The label takes the cells of central squares alone."""
    size = cfg.patch_size
    g = math.gcd(size, stride)
    sums = [F.count(F.when(_complete_cell(channels), 1)).alias("n_")]
    values: dict[str, Column] = {}
    if statistics:
        for c in channels:
            pre, post = F.col(f"pre_{c}"), F.col(f"post_{c}")
            values |= {f"pre_{c}": pre, f"post_{c}": post, f"diff_{c}": F.abs(post - pre)}
    for name, v in values.items():
        sums += [F.sum(v).alias(f"{name}_s"), F.sum(v * v).alias(f"{name}_ss")]
    blocks = pairs.groupBy(*by, F.expr(f"r div {g}").alias("br"), F.expr(f"c div {g}").alias("bc")).agg(*sums)
    rows = blocks.withColumn("r0", F.explode(origins(F.col("br") * g, size, stride)))
    held = rows.withColumn("c0", F.explode(origins(F.col("bc") * g, size, stride))).drop("br", "bc")
    both = held.unionByName(_centre_sums(pairs, cfg, stride, by), allowMissingColumns=True)
    added = ["n_", "n_change", "s_change", *[f"{name}_{s}" for name in values for s in ("s", "ss")]]
    whole = both.groupBy(*by, *WINDOW).agg(*[F.sum(c).alias(c) for c in added]).filter(F.col("n_") == size * size)
    share = F.col("s_change") / F.col("n_change")
    out = [F.when(share.isNotNull(), (share >= cfg.centre_threshold).cast("int")).alias("y")]
    for name in values:
        mean, square = F.col(f"{name}_s") / float(size * size), F.col(f"{name}_ss") / float(size * size)
        spread = square - mean * mean
        # What is left of a constant window is rounding.
        out += [mean.alias(f"{name}_mean"), F.sqrt(F.when(spread > 1e-13 * square, spread).otherwise(0.0)).alias(f"{name}_sd")]
    return whole.select(*by, *WINDOW, *out).withColumn("patch_id", F.concat_ws("-", *by, *WINDOW))


def summary_columns(channels: Sequence[str]) -> list[str]:
    return [f"{t}_{c}_{s}" for c in channels for t in ("pre", "post", "diff")
            for s in ("mean", "sd")]


def block_id(grid: Grid, cfg: Change) -> Column:
    """Number 1..16 of the block that holds the window centre, row-major."""
    def part(origin: Column, n: int) -> Column:
        centre = origin + 1 + cfg.patch_size // 2
        up = F.floor((centre * cfg.blocks + (n - 1)) / n)
        return F.least(F.greatest(up, F.lit(1)), F.lit(cfg.blocks))

    return ((part(F.col("r0"), grid.nrows) - 1) * cfg.blocks
            + part(F.col("c0"), grid.ncols)).cast("int")


def block_splits(seed: int, cfg: Change) -> dict[int, str]:
    """Split of each block under a seeded order: the first 11 train, the next 3 validate."""
    ids = range(1, cfg.blocks**2 + 1)
    order = sorted(ids, key=lambda b: hashlib.md5(f"{seed}|{b}".encode()).hexdigest())
    names = (["train"] * cfg.train_blocks + ["val"] * cfg.val_blocks
             + ["test"] * (len(order) - cfg.train_blocks - cfg.val_blocks))
    return dict(zip(order, names))


def split_column(seed: int, cfg: Change, block: str = "block") -> Column:
    out = F.lit(None).cast("string")
    for b, name in sorted(block_splits(seed, cfg).items()):
        out = F.when(F.col(block) == b, name).otherwise(out)
    return out


def choose_split_seed(patches: DataFrame, by: Sequence[str], cfg: Change) -> DataFrame:
    """First seed that puts a positive patch into training and any patch into validation.
    All seeds are judged in one aggregation; ``seed`` is NULL when none works."""
    aggs = []
    for s in cfg.seeds:
        split = split_column(s, cfg)
        aggs += [F.count(F.when((split == "train") & (F.col("y") == 1), 1)).alias(f"pos_{s}"),
                 F.count(F.when(split == "val", 1)).alias(f"val_{s}")]
    g = patches.groupBy(*by).agg(*aggs)
    good = F.lit(None).cast("int")
    for s in reversed(cfg.seeds):
        good = F.when((F.col(f"pos_{s}") >= 1) & (F.col(f"val_{s}") >= 1), s).otherwise(good)
    return g.select(*by, good.alias("seed"))


def overlap_mean(scores: DataFrame, px: DataFrame, size: int, stride: int, by: Sequence[str],
                 score: str = "prob") -> DataFrame:
    """Mean score of all windows over each cell, NULL where there is none.

    Windows are unions of ``gcd(size, stride)`` blocks, so scores are summed per block and only
    the block result meets the cells."""
    g = math.gcd(size, stride)
    steps = F.sequence(F.lit(0), F.lit(size // g - 1))
    blocks = scores.select(*by, score, "c0", F.explode(F.transform(
        steps, lambda k: F.col("r0").cast("bigint") + k * g)).alias("br"))
    blocks = blocks.select(*by, score, "br", F.explode(F.transform(
        steps, lambda k: F.col("c0").cast("bigint") + k * g)).alias("bc"))
    mean = blocks.groupBy(*by, "br", "bc").agg(F.avg(score).alias(score))
    cells = px.withColumns({"br": F.expr(f"r div {g} * {g}"), "bc": F.expr(f"c div {g} * {g}")})
    return cells.join(mean, [*by, "br", "bc"], "left").drop("br", "bc")
