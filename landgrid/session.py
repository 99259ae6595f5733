"""Session defaults, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A derived side is broadcast only when it has at most this many rows.
BROADCAST_ROWS = 20_000


def local_session(cpus: int | str = 8, app: str = "landgrid") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture costs several gateway calls per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # The JVM does not compile methods beyond 8000 bytes: let wide projections fall back.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    known = spark.conf.get("landgrid.local.dir", None)
    if known is None:
        known = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("landgrid.local.dir", known)
    return known


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/landgrid-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here, later reads take only the
    columns they need, and every executor can read the files after another one is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_local(df: DataFrame, cap: int = BROADCAST_ROWS) -> DataFrame | None:
    """``df`` as a local relation when it has at most ``cap`` rows, else ``None``."""
    table = df.limit(cap + 1).toArrow()
    if table.num_rows > cap:
        return None
    if table.num_rows == 0:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def join_bounded(big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "left",
                 cap: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` after checking its row count; beyond ``cap`` rows let the
    shuffle join run, where adaptive execution splits skewed partitions."""
    on = [on] if isinstance(on, str) else list(on)
    local = bounded_local(small, cap)
    if local is None:
        return big.join(small, on, how)
    return big.join(F.broadcast(local), on, how)


def compact(df: DataFrame, rows_per_task: int = 20_000) -> DataFrame:
    """``df`` cached in as many partitions as its rows need. Iterative solvers run one job per
    step, so tasks without work would dominate a small training set; a large one keeps its
    partitions. Release with ``unpersist``."""
    whole = df.cache()
    out = whole.coalesce(max(1, -(-whole.count() // rows_per_task))).cache()
    out.count()
    whole.unpersist()
    return out
