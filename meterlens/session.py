"""Session helpers: defaults, size checks and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table whose files are below this size fits one ordinary task, so none of
# its groups can need splitting and its one-row summaries need no refinement.
SMALL_BYTES = 64 * 1024 * 1024
# Largest side that is broadcast after its rows were counted.
BROADCAST_ROWS = 1_000_000


def build_session(app: str = "meterlens", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the library expects; the cluster's own win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.scheduler.mode": "FAIR",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def estimated_bytes(df: DataFrame) -> int:
    """Total size of the tables ``df`` reads, by file size (runs no job)."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def is_small(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """True when the inputs of ``df`` are known to fit a single task."""
    return estimated_bytes(df) <= limit


def bounded_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, small_bytes: int = SMALL_BYTES
) -> DataFrame:
    """Mark ``df`` for broadcast only when its size has been checked.

    Small inputs pass on the file-size estimate. Otherwise the side is written
    to the shared folder and its own rows are counted; a larger table is returned
    unmarked, so the join stays a shuffle join that AQE may split on skewed keys.
    """
    if is_small(df, small_bytes):
        return F.broadcast(df)
    kept = settle(df)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="meterlens-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder.

    The result is a parquet table: later jobs read only the columns they need,
    its size is known, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/meterlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def discard(settled: DataFrame) -> None:
    """Delete the files of a table that ``settle`` wrote and nothing reads any more."""
    spark = settled.sparkSession
    for path in {p.rsplit("/", 1)[0] for p in settled.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getName().startswith("meterlens-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
