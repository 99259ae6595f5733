"""Class maps that arrive as files: each batch replaces the cells it brings, keeps the other cells of
those years and refreshes the area report, with the same idempotent sinks the batch jobs use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from landgrid.operators.stats import area_stats
from landgrid.session import cut_lineage
from landgrid.sources.products import refresh_report, stored_product, upsert, write_product

LULC_SCHEMA = "cell_id bigint, r bigint, c bigint, yr int, cls int"


def area_refresh(spark: SparkSession, arrivals: str, product: str, report: str, res: float,
                 checkpoint: str) -> StreamingQuery:
    """Start the refresh over everything that is available; a repeated batch changes nothing."""
    columns = [c.split()[0] for c in LULC_SCHEMA.split(", ")]

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            years = [row["yr"] for row in batch.select("yr").distinct().collect()]
            if not years:
                return
            merged = batch.select(*columns).dropDuplicates(["yr", "cell_id"])
            old = stored_product(spark, product)
            if old is not None:
                # A year may arrive in parts: cells that this batch does not bring stay as they are.
                merged = cut_lineage(upsert(old.filter(F.col("yr").isin(years)).select(*columns), merged, ["yr", "cell_id"]))
            write_product(merged, product, overwrite=True)
            stored = spark.read.schema(LULC_SCHEMA).parquet(product)
            refresh_report(area_stats(stored.filter(F.col("yr").isin(years)), res), report, ["Year"])
        finally:
            batch.unpersist()

    return (spark.readStream.schema(LULC_SCHEMA).parquet(arrivals).writeStream
            .option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(apply).start())
