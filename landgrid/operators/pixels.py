"""Per-pixel map algebra on scene and feature tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.config import SCENE_LAYERS, Grid
from landgrid.functions import bands as B
from landgrid.functions import geo
from landgrid.session import join_bounded

# Band names of the first sensor and their canonical counterparts.
LANDSAT_TO_CANONICAL = {"SR_B2": "b02", "SR_B3": "b03", "SR_B4": "b04", "SR_B5": "b08",
                        "SR_B6": "b11", "SR_B7": "b12", "QA_PIXEL": "qa"}
KEYS = ("cell_id", "r", "c", "yr", "sensor")


def conform_layers(df: DataFrame, sensor: str, keys: Sequence[str]) -> DataFrame:
    """Give a scene its layer names: by position if the names differ, an error if the
    number of layers is wrong."""
    want = SCENE_LAYERS[sensor]
    have = [c for c in df.columns if c not in keys]
    if len(have) != len(want):
        raise ValueError(f"{sensor} scene needs {len(want)} layers, found {len(have)}")
    if set(have) != set(want):
        warnings.warn(f"{sensor} layers renamed by position: {have}", stacklevel=2)
        df = df.withColumnsRenamed(dict(zip(have, want)))
    return df.select(*keys, *want)


def sensor_of(columns: Sequence[str]) -> str:
    if any(c.upper().startswith("SR_B") for c in columns):
        return "landsat"
    if any(c.upper() == "B02" for c in columns):
        return "sentinel"
    raise ValueError("cannot tell the sensor from the layer names")


def canonicalize(df: DataFrame, need: Sequence[str] = B.BANDS) -> DataFrame:
    """Shared band names for both sensors; a missing layer is an error."""
    if sensor_of(df.columns) == "landsat":
        df = df.withColumnsRenamed({k: v for k, v in LANDSAT_TO_CANONICAL.items()
                                    if k in df.columns})
    else:
        df = df.withColumnsRenamed({c: c.lower() for c in SCENE_LAYERS["sentinel"]
                                    if c in df.columns})
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"missing layers: {missing}")
    return df


def mask_scl(df: DataFrame) -> DataFrame:
    clear = B.scl_is_clear(F.col("scl"))
    return df.withColumns({b: F.when(clear, F.col(b)) for b in B.BANDS}).drop("scl")


def mask_qa(df: DataFrame) -> DataFrame:
    clear = B.qa_is_clear(F.col("qa"))
    return df.withColumns({b: F.when(clear, F.col(b)) for b in B.BANDS}).drop("qa")


def scale_sentinel(df: DataFrame) -> DataFrame:
    return df.withColumns({b: B.sentinel_reflectance(F.col(b)) for b in B.BANDS})


def scale_landsat(df: DataFrame) -> DataFrame:
    return df.withColumns({b: B.landsat_reflectance(F.col(b)) for b in B.BANDS})


def reflectance(px: DataFrame) -> DataFrame:
    """Mask and scale both sensors in one pass over the scene table. Each step is its own
    projection: small generated methods, which the JVM compiles."""
    landsat = F.col("sensor") == "landsat"
    clear = F.when(landsat, B.qa_is_clear(F.col("qa"))).otherwise(B.scl_is_clear(F.col("scl")))
    flagged = px.withColumn("clear_", clear)
    masked = flagged.withColumns({b: F.when(F.col("clear_"), F.col(b)).cast("double")
                                  for b in B.BANDS}).drop("scl", "qa", "clear_")
    scaled = masked.withColumns({b: F.when(landsat, F.col(b) * 0.0000275 - 0.2)
                                 .otherwise(F.col(b) / 10000.0) for b in B.BANDS})
    return scaled.withColumns({b: B.saturate(F.col(b)) for b in B.BANDS})


def with_indices(df: DataFrame, names: Sequence[str] = B.INDICES) -> DataFrame:
    exprs = B.index_columns()
    return df.withColumns({n: exprs[n] for n in names})


def feature_stack(px: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Six reflectances and five indices in fixed order."""
    return with_indices(reflectance(px)).select(*keys, *B.FEATURES)


def layer_stats(feat: DataFrame, layers: Sequence[str] = B.FEATURES) -> DataFrame:
    """One row per year and sensor with minimum, maximum and known cells of every layer: the
    single pass behind the parameters and the quality figures."""
    return feat.groupBy("yr", "sensor").agg(
        F.count(F.lit(1)).alias("n"),
        *[e for n in layers for e in (F.min(n).alias(f"min_{n}"), F.max(n).alias(f"max_{n}"),
                                      F.count(n).alias(f"k_{n}"))])


def params_of(layer_table: DataFrame, layers: Sequence[str] = B.FEATURES) -> DataFrame:
    return layer_table.select(
        F.col("yr").alias("year"), "sensor",
        F.inline(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(f"min_{n}").alias("min"),
                                    F.col(f"max_{n}").alias("max")) for n in layers])))


def minmax_params(feat: DataFrame, layers: Sequence[str] = B.FEATURES) -> DataFrame:
    """Minimum and maximum of each layer by year and sensor, in long form; NULLs ignored."""
    return params_of(layer_stats(feat, layers), layers)


def _params_wide(params: DataFrame, layers: Sequence[str], unique: bool = False) -> DataFrame:
    """One row per year and sensor with ``lo_<layer>`` and ``spread_<layer>``, both NULL where
    they cannot be used: not finite, no spread, or (``unique``) more than one parameter row."""
    inf = float("inf")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)
    own = lambda n, e: F.max(F.when(F.col("layer") == n, e))
    wide = params.groupBy(F.col("year").alias("yr"), "sensor").agg(*[e for n in layers for e in (
        own(n, F.col("min")).alias(f"lo_{n}"), own(n, F.col("max")).alias(f"hi_{n}"),
        F.count(F.when(F.col("layer") == n, 1)).alias(f"k_{n}"))])

    def usable(n: str):
        lo, hi = F.col(f"lo_{n}"), F.col(f"hi_{n}")
        if unique:
            return F.col(f"k_{n}") == 1
        return finite(lo) & finite(hi) & (F.abs(hi - lo) >= 1e-6)

    return wide.select("yr", "sensor", *[e for n in layers for e in (
        F.when(usable(n), F.col(f"lo_{n}")).alias(f"lo_{n}"),
        F.when(usable(n), F.col(f"hi_{n}") - F.col(f"lo_{n}")).alias(f"spread_{n}"))])


def minmax_normalize(feat: DataFrame, params: DataFrame,
                     layers: Sequence[str] = B.FEATURES) -> DataFrame:
    """(x - min) / (max - min) per layer and year. A layer without spread becomes x * 0."""
    joined = join_bounded(feat, _params_wide(params, layers), ["yr", "sensor"], "left")
    scaled = {n: F.when(F.col(f"spread_{n}").isNull(), F.col(n) * 0.0)
              .otherwise((F.col(n) - F.col(f"lo_{n}")) / F.col(f"spread_{n}")) for n in layers}
    return joined.withColumns(scaled).select(*feat.columns)


def denormalize(norm: DataFrame, params: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Back to physical values, as ``raw_<layer>``; NULL unless exactly one parameter row
    describes the layer-year."""
    joined = join_bounded(norm, _params_wide(params, layers, unique=True), ["yr", "sensor"], "left")
    out = {f"raw_{n}": F.col(n) * F.col(f"spread_{n}") + F.col(f"lo_{n}") for n in layers}
    return joined.withColumns(out).select(*norm.columns, *out)


def quality_of(layer_table: DataFrame, layers: Sequence[str] = B.FEATURES) -> DataFrame:
    lowest = F.least(*[F.col(f"min_{b}") for b in B.BANDS])
    return layer_table.select(
        "yr", "sensor", "min_ndvi", "max_ndvi", "min_ndbi", "max_ndbi",
        lowest.alias("min_reflectance"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("layer"),
                                    (1.0 - F.col(f"k_{n}") / F.col("n")).alias("null_share"))
                           for n in layers])))


def quality_checks(feat: DataFrame, layers: Sequence[str] = B.FEATURES) -> DataFrame:
    """Per year: NULL share of each layer, NDVI and NDBI range, lowest reflectance."""
    return quality_of(layer_stats(feat, layers), layers)


def aoi_crop(df: DataFrame, box: tuple[float, float, float, float], grid: Grid) -> DataFrame:
    """Cells whose centre lies in the box, as literal ranges on the stored row and column so
    the filter reaches the file statistics."""
    xmin, ymin, xmax, ymax = box
    lo = lambda v, o: -int(-((v - o) / grid.res - 0.5) // 1)
    hi = lambda v, o: int(((v - o) / grid.res - 0.5) // 1)
    return df.filter(F.col("c").between(lo(xmin, grid.x0), hi(xmax, grid.x0))
                     & F.col("r").between(lo(ymin, grid.y0), hi(ymax, grid.y0)))


def cell_xy(df: DataFrame, grid: Grid) -> DataFrame:
    return df.withColumns({"x": geo.cell_x(F.col("c"), grid), "y": geo.cell_y(F.col("r"), grid)})


def with_tile(df: DataFrame, grid: Grid, nx: int, ny: int) -> DataFrame:
    """Tile of each cell when the extent is cut into ``nx`` by ``ny`` equal parts."""
    part = lambda v, parts, n: F.least(F.floor((v + F.lit(0.5)) * parts / n),
                                       F.lit(parts - 1)).cast("int")
    return df.withColumns({"tile_r": part(F.col("r"), ny, grid.nrows),
                           "tile_c": part(F.col("c"), nx, grid.ncols)})


def same_geometry(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do two cell tables have the same extent and number of distinct cells?"""
    def bounds(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("r", "c").agg(F.count(F.lit(1)).alias("k")).agg(
            *[F.struct(F.min("r"), F.max("r"), F.min("c"), F.max("c"), F.count(F.lit(1)))
              .cast("struct<r0:bigint,r1:bigint,c0:bigint,c1:bigint,n:bigint>").alias("b")]
        ).select(F.lit(tag).alias("side"), "b")

    both = bounds(a, "a").unionByName(bounds(b, "b"))
    return both.agg((F.min("b") == F.max("b")).alias("same"),
                    F.max(F.when(F.col("side") == "a", F.col("b.n"))).alias("cells_a"),
                    F.max(F.when(F.col("side") == "b", F.col("b.n"))).alias("cells_b"))


def stack_bands(long: DataFrame, bands: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Single-band rows to one wide row per cell, bands in fixed order."""
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands])


def mosaic_tiles(tiles: DataFrame, keys: Sequence[str], value: str = "cls",
                 order: str = "tile_order") -> DataFrame:
    """Overlapping class tiles to one grid: the first non-NULL class in tile order."""
    # Order and class packed into one number keep this a hash aggregation.
    packed = F.when(F.col(value).isNotNull(), F.shiftleft(F.col(order).cast("bigint"), 32)
                    .bitwiseOR(F.col(value).cast("bigint")))
    best = tiles.groupBy(*keys).agg(F.min(packed).alias("f"))
    return best.select(*keys, F.col("f").bitwiseAND(0xFFFFFFFF).cast("int").alias(value))
