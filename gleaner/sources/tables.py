"""Reading tables and picking columns from them."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, source: str | dict, name: str, spread: bool = False) -> DataFrame:
    """A parquet table below a folder, or a JDBC table when ``source`` is a dict of JDBC options.

    ``spread`` shares out a table stored in fewer pieces than there are cores, ahead of costly row work.
    """
    if isinstance(source, dict):
        return spark.read.format("jdbc").options(**source, dbtable=name).load()
    table = spark.read.parquet(f"{source.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and table.rdd.getNumPartitions() < cores:
        return table.repartition(cores)
    return table


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders right below a folder, in any file system; none where it does not exist."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in system.listStatus(target) if s.isDirectory()) if system.exists(target) else []


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies right below a folder, hidden entries left out; none where it does not exist."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(target)] if system.exists(target) else []
    return sorted(name for name in names if not name.startswith(("_", ".")))


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Make a small file appear whole and at once, in any file system; FileExistsError where there is one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".draft-{uuid.uuid4().hex}")
    system = target.getFileSystem(conf)
    stream = system.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    # Unlike FileSystem, FileContext refuses to rename onto a file.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else system.getUri(), conf)
    try:
        context.rename(draft, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        system.delete(draft, False)
        if "FileAlreadyExistsException" in str(error.java_exception):
            raise FileExistsError(path) from error
        raise


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def first_existing_table(spark: SparkSession, names: list[str], schema: StructType | str) -> DataFrame:
    """The first catalog table of that name; an empty frame when none exists."""
    for name in names:
        if spark.catalog.tableExists(name):
            return spark.table(name)
    return spark.createDataFrame([], schema)


def lookup_by_id(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is wanted."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")


def split_fetch_results(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages to parse, and the error report. An HTTP error page is in both."""
    failed = F.col("status_code") >= 400
    message = F.when(failed, F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))).otherwise(F.col("error"))
    marked = pages.withColumns({"error": message, "html": F.coalesce("html", F.lit(""))})
    return marked, marked.filter(F.col("error") != "").select("page", "url", "status_code", "error")
