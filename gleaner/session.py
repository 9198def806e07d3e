"""Session defaults and the shared folder for reliable checkpoints."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keys a stream has seen grow with its life, so they are kept on disk and in its checkpoint, not on the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Pages are large and their node lists larger, so few travel in one batch to Python.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # Call-site capture costs several JVM round trips per column expression; ours are many.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
_SHIPPED: set[tuple[str, str]] = set()


def build_session(app_name: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession, *packages: str) -> None:
    """Give the executors these packages of the source tree, once per application.

    Needed where the library is not installed on the cluster: Python steps run its functions there.
    """
    root = Path(__file__).resolve().parent.parent
    for package in packages or (Path(__file__).resolve().parent.name,):
        if (spark.sparkContext.applicationId, package) in _SHIPPED:
            continue
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='gleaner-')}/{package}", "zip", root, package)
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add((spark.sparkContext.applicationId, package))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where the session names none."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="gleaner-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and continue from the files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame) -> DataFrame:
    """Write the frame as Parquet below the checkpoint folder and continue from the files.

    Unlike a checkpoint, later reads take only the columns and row groups they need, and ``drop_table`` can delete it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete the files of a table that ``write_table`` gave; frames that still read it can't be used any more."""
    spark = table.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        if not folder.rsplit("/", 1)[-1].startswith("table-"):
            raise ValueError(f"{folder} was not written by write_table")
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
