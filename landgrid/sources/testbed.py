"""Pixel, catalog and vector views derived from the relational test tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.config import Change, Grid, Sprawl, Study
from landgrid.functions import bands as B

NCOLS = 50
RES = 1_000.0
YEARS = (1995, 1996, 1997, 1998, 1999, 2000, 2001)
TRANSITIONS = ((1995, 1997), (1997, 1999), (1999, 2001))
CENTRE = (25_000.0, 20_000.0)

_CLASS = """CASE WHEN ok % 13 = 0 THEN NULL WHEN b08 % 100 < 30 + (yr - 1995) * 4 THEN 1
            WHEN b08 % 100 < 70 THEN 2 WHEN b08 % 100 < 90 THEN 3 ELSE 4 END"""


# Column types of the input tables, so that no job is spent on inferring them.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    """Raster geometry, from the extent of the cell ids."""
    top = table(spark, sf_dir, "lineitem").agg(F.max("l_partkey")).first()[0]
    return Grid(res=RES, nrows=int(top) // NCOLS + 1, ncols=NCOLS)


def study(spark: SparkSession, sf_dir: str) -> Study:
    return Study(
        grid=grid(spark, sf_dir),
        sprawl=Sprawl(centre_xy=CENTRE),
        transitions=TRANSITIONS,
        years=YEARS,
        change=Change(patch_size=8, stride_train=4, stride_infer=4, centre=2),
    )


def _cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scene row per cell and year: the smallest observation of the cell-year, taken as
    the minimum of a struct so that it combines before the shuffle."""
    obs = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("cell_id"),
        F.year("l_shipdate").alias("yr"),
        F.struct(
            _cents("l_discount").alias("dsc"),
            _cents("l_extendedprice").alias("e"),
            F.col("l_orderkey").alias("ok"),
            F.col("l_linenumber").cast("bigint").alias("ln"),
            F.col("l_suppkey").alias("sk"),
            F.round("l_quantity").cast("bigint").alias("q"),
            _cents("l_tax").alias("tx"),
        ).alias("o"),
    )
    scene = obs.groupBy("cell_id", "yr").agg(F.min("o").alias("o"))
    return scene.select(
        "cell_id",
        F.expr("cell_id div 50").alias("r"),
        F.expr("cell_id % 50").alias("c"),
        "yr",
        F.when(F.col("yr") <= 1997, "landsat").otherwise("sentinel").alias("sensor"),
        F.col("o.ok").alias("ok"),
        F.expr("CASE WHEN o.ok % 3 = 0 THEN (o.sk + o.ln) % 12 ELSE 4 + o.sk % 4 END").alias("scl"),
        F.expr("CASE WHEN o.ok % 4 = 0 THEN (o.e * 7) % 64 ELSE 64 END").alias("qa"),
        F.expr("200 + o.e % 2600").alias("b02"),
        F.expr("300 + (o.e + o.q * 131) % 3000").alias("b03"),
        F.expr("300 + (o.q * 97 + o.ok * 3) % 3300").alias("b04"),
        F.expr("500 + (o.e * 3 + o.tx * 211 + o.ok * 7) % 5500").alias("b08"),
        F.expr("400 + (o.e * 5 + o.q * 17) % 4600").alias("b11"),
        F.expr("300 + (o.e * 11 + o.dsc * 29) % 4200").alias("b12"),
    )


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw scene: digital numbers by sensor, with the cloud and quality layers."""
    df = base(spark, sf_dir)
    dn = [F.when(F.col("sensor") == "landsat", 7300 + 4 * F.col(b)).otherwise(F.col(b)).alias(b)
          for b in B.BANDS]
    return df.select("cell_id", "r", "c", "yr", "sensor", "scl", "qa", *dn)


def lulc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("cell_id", "r", "c", "yr", F.expr(_CLASS).alias("cls"))


def land_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference land-cover codes with an elevation and a population layer."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("cell_id"),
        F.expr("p_partkey div 50").alias("r"),
        F.expr("p_partkey % 50").alias("c"),
        F.expr("""CASE p_size % 12 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 40
                  WHEN 4 THEN 50 WHEN 5 THEN 60 WHEN 6 THEN 70 WHEN 7 THEN 80 WHEN 8 THEN 90
                  WHEN 9 THEN 95 WHEN 10 THEN 100 ELSE 96 END""").alias("code"),
        F.col("p_retailprice").alias("elev"),
        F.col("p_size").cast("double").alias("pop"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene catalog items with a footprint and an ordered asset map."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.col("o_orderkey").alias("item_seq"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'landsat-c2-l2' ELSE 'sentinel-2-l2a' END")
        .alias("collection"),
        F.to_date("o_orderdate").alias("dt"),
        F.year("o_orderdate").alias("yr"),
        F.expr("""CASE o_custkey % 3 WHEN 0 THEN ' Landsat_5' WHEN 1 THEN 'landsat-7 '
                  ELSE 'LANDSAT_8' END""").alias("platform"),
        F.expr("""CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE
                  CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 10000 AS DOUBLE) / 100 END""")
        .alias("eo_cloud"),
        F.expr("""CASE WHEN o_custkey % 5 < 3 THEN NULL
                  ELSE CAST(o_custkey % 101 AS DOUBLE) END""").alias("land_cloud"),
        (36.0 + (F.col("o_custkey") % 20) / 10.0).alias("xmin"),
        (36.5 + (F.col("o_custkey") % 20) / 10.0).alias("xmax"),
        (-2.0 + (F.col("o_custkey") % 7) / 10.0).alias("ymin"),
        (-1.6 + (F.col("o_custkey") % 7) / 10.0).alias("ymax"),
        F.expr("""map_from_arrays(
            array('thumb', CASE o_custkey % 4 WHEN 0 THEN 'map' WHEN 1 THEN 'data'
                           WHEN 2 THEN 'classification' ELSE 'other' END, 'tail'),
            array(named_struct('href', 'http://x/' || o_orderkey || '.png'),
                  named_struct('href', CASE WHEN o_custkey % 6 = 0 THEN ''
                                            ELSE 'http://x/' || o_orderkey || '/a.bin' END),
                  named_struct('href', 'http://x/' || o_orderkey ||
                               CASE WHEN o_orderkey % 5 = 0 THEN '.TIF?sig=1' ELSE '.xml' END)))
            """).alias("assets"),
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("seg_id"),
        F.expr("CAST(((s_suppkey * 13) % 45) * 1000 + 500 AS DOUBLE)").alias("x1"),
        F.expr("CAST(((s_suppkey * 7) % 35) * 1000 + 500 AS DOUBLE)").alias("y1"),
        F.expr("CAST(((s_suppkey * 13) % 45) * 1000 + 4500 AS DOUBLE)").alias("x2"),
        F.expr("CAST(((s_suppkey * 7) % 35 + s_nationkey % 5) * 1000 + 500 AS DOUBLE)").alias("y2"),
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmasked reflectances and indices with the class: the input of the patch operators,
    which need complete windows."""
    df = base(spark, sf_dir)
    df = df.select("cell_id", "r", "c", "yr", F.expr(_CLASS).alias("cls"),
                   *[B.sentinel_reflectance(F.col(b)).alias(b) for b in B.BANDS])
    return df.select("*", *[e.alias(n) for n, e in B.index_columns().items()])


def change_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change probability per cell and year beside its class."""
    return base(spark, sf_dir).select(
        "cell_id", "r", "c", "yr", F.expr(_CLASS).alias("cls"),
        F.expr("CASE WHEN ok % 13 <> 0 THEN CAST(b08 % 97 AS DOUBLE) / 97 END").alias("prob"))
