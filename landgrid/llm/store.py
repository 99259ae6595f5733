"""Tables kept in the shared folder, and texts packed for a shuffle."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from landgrid.llm.tokens import CHUNK_BYTES, chunks, trim
from landgrid.session import scratch_path


#: Bytes of rows that go to a Python worker at once. Of long texts the usual number of rows takes tens of megabytes, which both the
#: executor's JVM and the worker hold outside the heap, for each task.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let batches for Python workers be of ``BATCH_BYTES`` at most, or less where the session says so."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the folder of ``spark.checkpoint.dir`` and read again: lineage ends
    here, and every executor can read the files after another one is lost. A collection of the driver's
    garbage then lets Spark's cleaner delete the shuffle files of earlier steps, which would otherwise fill disks
    until one happens by chance."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give back what earlier tasks of this worker have left, cycles included."""
    gc.collect()
    trim()


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with text compressed row by row: ``packed`` and its full ``size`` in bytes take its place."""
    names = [c for c in docs.columns if c != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        codec = pa.Codec("zstd", compression_level=3)
        for batch in chunks(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([len(t) for t in texts], pa.int32()),
                 pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())], [*names, "size", "packed"])

    fields = [docs.schema[c] for c in names]
    return docs.mapInArrow(scan, T.StructType([*fields, T.StructField("size", T.IntegerType()), T.StructField("packed", T.BinaryType())]))


def unpacked(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of ``packed`` rows with ``text`` as bytes again, about ``limit`` bytes each."""
    codec = pa.Codec("zstd")
    for batch in batches:
        names = [c for c in batch.schema.names if c not in ("size", "packed")]
        texts, held, first = [], 0, 0
        for i, (size, data) in enumerate(zip(batch.column("size").to_pylist(), batch.column("packed").to_pylist())):
            texts.append(codec.decompress(data, size, asbytes=True) if size else b"")
            held += size or 0
            if held > limit or i + 1 == batch.num_rows:
                cut = batch.slice(first, i + 1 - first)
                yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in names), pa.array(texts, pa.binary())], [*names, "text"])
                texts, held, first = [], 0, i + 1
