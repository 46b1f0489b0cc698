"""Running streams over all input that is there."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryProgress

from shelfline.session import ROWS_A_TASK, scratch_path, stage

#: Rows of a file that a stream reads as one piece, until there are so many files for each core; from then on a file takes what a task does.
ROWS_A_FILE, FILES_A_CORE = 50_000, 4
_FILLER = "_filler"
_ROCKS = "spark.sql.streaming.stateStore.rocksdb"
#: State on local disk, in memory only what these bounds let each executor hold of it, whatever its tasks.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKS}.boundedMemoryUsage": "true",
    f"{_ROCKS}.maxMemoryUsageMB": "500",
}


def require_utc(spark: SparkSession) -> None:
    """Watermarks and windows count instants, the tables hold wall-clock times: both agree in UTC only."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "GMT", "+00:00"):
        raise ValueError(f"the session time zone is {zone}; streams over timestamps need UTC")


@contextmanager
def rocks(spark: SparkSession, counted: bool = True) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed processors need; any other state may outgrow memory too.

    ``counted`` has the progress tell how many rows there are, for a look at the key before every change.
    """
    settings = _STATE | {f"{_ROCKS}.trackTotalNumberOfRows": str(counted).lower()}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_to_end(stream: DataFrame, label: str) -> DataFrame:
    """Run an append stream over all input there is and return what it wrote."""
    return stream.sparkSession.read.schema(stream.schema).parquet(_written(stream, label))


def relay(stream: DataFrame, label: str) -> DataFrame:
    """Run an append stream over all input there is; a stream over what it wrote, for the next query."""
    return stream.sparkSession.readStream.schema(stream.schema).parquet(_written(stream, label))


def _written(stream: DataFrame, label: str) -> str:
    folder = scratch_path(stream.sparkSession)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    with rocks(stream.sparkSession, counted=False):
        query = writer.trigger(availableNow=True).start(f"{folder}/{label}")
    query.awaitTermination()
    return f"{folder}/{label}"


def update_to_end(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run an update stream over all input there is and return the last row of each key."""
    return updated(stream, keys, label)[0]


def updated(stream: DataFrame, keys: list[str], label: str) -> tuple[DataFrame, list[StreamingQueryProgress]]:
    """The last row of each key of an update stream, and the progress of its batches.

    A batch writes its changed rows to a folder of its own, again if it runs again. Spark keeps the progress of
    the last ``spark.sql.streaming.numRecentProgressUpdates`` batches.
    """
    spark = stream.sparkSession
    folder = scratch_path(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{label}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/{label}")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return written.withColumn("_age", newest).filter("_age = 1").drop("_age", "batch"), query.recentProgress


def dropped_rows(progress: Iterable[StreamingQueryProgress]) -> int:
    """Rows that keyed state refused for being later than the watermark.

    Before an aggregation Spark adds up a task's rows of a key, which count as one row here.
    """
    return sum(state.numRowsDroppedByWatermark for p in progress for state in p.stateOperators)


def observed(progress: Iterable[StreamingQueryProgress], name: str, metric: str) -> int:
    """A counted metric, observed in every batch, added up."""
    return sum(p.observedMetrics[name][metric] or 0 for p in progress if name in p.observedMetrics)


def in_batches(df: DataFrame, order: str, batches: int, *closing: DataFrame) -> DataFrame:
    """A stream that brings ``df`` in ranges of ``order``, a range a batch, with an empty one between.

    ``closing`` rows come last, a batch each, to move the watermark past everything before them.
    Every batch is the same number of files, by the rows of the largest, so Spark tasks share it.
    ``df`` is computed once, and a batch is one write: each file begins with a row that the stream leaves out,
    so that none is missing where a batch has fewer rows than files.
    """
    spark = df.sparkSession
    folder = scratch_path(spark)
    schema = df.schema
    rows = df if hasattr(df, "_staged_in") else stage(df, "rows")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    cuts = [low + (high - low) * k / batches for k in range(1, batches)] if low is not None else []
    part = sum((F.when(F.col(order) > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    largest = rows.groupBy(part.alias("_part")).count().agg(F.max("count")).first()[0] or 0
    files = max(1, min(-(-largest // ROWS_A_FILE), max(FILES_A_CORE * spark.sparkContext.defaultParallelism, -(-largest // ROWS_A_TASK))))
    frames = [rows.filter(part == k) for k in range(len(cuts) + 1)]
    frames.insert(1, rows.limit(0))
    at = F.monotonically_increasing_id() % files
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    filler = spark.range(files).select(*empty, F.lit(True).alias(_FILLER), F.col("id").alias("_file"))
    for k, frame in enumerate([*frames, *closing]):
        filled = frame.select(*schema.names, F.lit(False).alias(_FILLER), at.alias("_file")).unionByName(filler)
        filled.repartitionById(files, F.col("_file").cast("int")).drop("_file").write.parquet(f"{folder}/part={k:03d}")
    arriving = spark.readStream.schema(schema.add(_FILLER, "boolean")).option("maxFilesPerTrigger", files).parquet(f"{folder}/part=*")
    return arriving.filter(f"NOT {_FILLER}").drop(_FILLER)
