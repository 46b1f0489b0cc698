"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"

# Adaptive execution re-plans joins from real sizes and splits skewed partitions;
# UTC keeps timestamp casts equal on every machine.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Rows that one task takes on where ``spread`` deals them out.
ROWS_A_TASK = 500_000


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The recommended settings on a session builder."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Without that setting it is a folder beside the tables of the warehouse, which
    every executor has to reach anyway.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    return (folder or f"{spark.conf.get(WAREHOUSE_DIR).rstrip('/')}/shelfline-scratch").rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new folder name inside the shared folder."""
    return f"{shared_dir(spark)}/shelfline-{uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage above the written files, so a lost executor costs
    the running task only, and every later use sees the same rows.
    """
    spark = df.sparkSession
    path = f"{(folder := scratch_path(spark))}/{label}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._staged_in = folder
    return written


def stage_by(df: DataFrame, column: str, label: str) -> Callable[[object], DataFrame]:
    """Like ``stage``, but the rows of each value of ``column``, of which there are few, are read, and discarded, alone."""
    spark = df.sparkSession
    path = f"{scratch_path(spark)}/{label}"
    df.write.partitionBy(column).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)

    def rows(value: object) -> DataFrame:
        part = written.filter(F.col(column) == value)
        part._staged_in = f"{path}/{column}={str(value).lower()}"
        return part

    return rows


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt out by ``keys`` so that a task's share does not grow with the table.

    The sums and joins by these keys that follow need no other shuffle, and what they hold in a
    task is bounded whatever the number of shuffle partitions of the session is.
    """
    return df.repartition(tasks_for(df.sparkSession, rows), *keys)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for ``rows`` rows: one a core at least, and more where their shares would get large."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def discard(*staged: DataFrame) -> None:
    """Remove what ``stage`` or ``stage_by`` wrote for tables that nothing reads any more."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_in)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
