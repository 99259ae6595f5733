"""Reading scenes, writing products, idempotent re-runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.config import Geometry, Grid
from landgrid.operators.pixels import conform_layers, same_geometry
from landgrid.session import cut_lineage, join_bounded


def scan_scene(spark: SparkSession, path: str, sensor: str,
               keys: Sequence[str] = ("cell_id", "r", "c", "yr")) -> DataFrame:
    return conform_layers(spark.read.parquet(path), sensor, keys)


def stored_product(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


GEOMETRY = "_geometry"
RECORD = "res double, nrows long, ncols long, x0 double, y0 double, crs string"


def product_geometry(spark: SparkSession, path: str) -> Geometry | None:
    """The geometry record kept beside a product, if it has one."""
    kept = stored_product(spark, f"{path}/{GEOMETRY}")
    row = None if kept is None else kept.first()
    return None if row is None else Geometry(Grid(row["res"], row["nrows"], row["ncols"], row["x0"], row["y0"]), row["crs"])


def write_product(df: DataFrame, path: str, overwrite: bool = False,
                  partition: str = "yr", geometry: Geometry | None = None) -> None:
    """Write one partition per year. Years that exist are skipped unless ``overwrite``, and
    then only the years in ``df`` are replaced. With ``geometry`` its record is kept beside them; years of
    another geometry cannot join a product."""
    old = stored_product(df.sparkSession, path)
    if geometry is not None:
        known = product_geometry(df.sparkSession, path)
        if known is None:
            g = geometry.grid
            df.sparkSession.createDataFrame([(float(g.res), g.nrows, g.ncols, float(g.x0), float(g.y0), geometry.crs)], RECORD) \
                .coalesce(1).write.mode("overwrite").parquet(f"{path}/{GEOMETRY}")
        elif not known.same(geometry):
            raise ValueError(f"{path} is laid on {known}, not on {geometry}")
    if not overwrite and old is not None:
        df = join_bounded(df, old.select(partition).distinct(), partition, "left_anti")
    # Rebalancing gives each file one year and a sensible size, splitting a year that is large;
    # rows sorted by position let row and column filters skip row groups.
    (df.hint("rebalance", partition)
       .sortWithinPartitions(partition, *[c for c in ("r", "c") if c in df.columns])
       .write.mode("overwrite" if overwrite else "append")
       .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A small report table as one CSV file with a header."""
    out = df.coalesce(1)
    if order:
        out = out.sortWithinPartitions(*order)
    out.write.mode("overwrite").option("header", True).csv(path)


def _swap_in(spark: SparkSession, path: str) -> None:
    """Put a table written in full at ``<path>-next`` in the place of the one at ``path``. A crash on the way leaves one
    of the two complete, and the next call goes on from there."""
    jvm = spark._jvm.org.apache.hadoop.fs
    place = lambda name: jvm.Path(name)
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    here, new, last = place(path), place(f"{path}-next"), place(f"{path}-last")
    if not files.exists(place(f"{path}-next/_SUCCESS")):
        if files.exists(last) and not files.exists(here):
            files.rename(last, here)
        return
    if files.exists(here):
        files.delete(last, True)
        files.rename(here, last)
    files.rename(new, here)
    files.delete(last, True)


def refresh_report(new: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Upsert ``new`` into the report stored at ``path`` and return the merged table. The new report is written beside the
    old one and then takes its place, so a crash loses neither."""
    spark = new.sparkSession
    _swap_in(spark, path)
    old = stored_product(spark, path)
    merged = cut_lineage(new if old is None else upsert(old, new, keys))
    merged.coalesce(1).write.mode("overwrite").parquet(f"{path}-next")
    _swap_in(spark, path)
    return merged


def compare_products(spark: SparkSession, a: str, b: str) -> DataFrame:
    """One row: do two stored products have the same geometry record and the same cells?"""
    one, two = product_geometry(spark, a), product_geometry(spark, b)
    if one is None or two is None:
        raise ValueError(f"no geometry record beside {a if one is None else b}")
    cells = same_geometry(spark.read.parquet(a), spark.read.parquet(b))
    return cells.withColumn("same", F.col("same") & F.lit(one.same(two)))


def available_years(scenes: Sequence[DataFrame], want: Sequence[int] | None = None) -> DataFrame:
    """Distinct years over the scene tables, optionally only the wanted ones."""
    years = None
    for df in scenes:
        one = df.select("yr")
        years = one if years is None else years.unionByName(one)
    if want is not None:
        years = years.filter(F.col("yr").isin(*want))
    return years.distinct()
