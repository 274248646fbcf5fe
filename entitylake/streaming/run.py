"""Running a stream over what is there and reading its result table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import first_per_key
from ..session import checkpoint_root, file_system


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over `folder/name*.parquet` with the schema of the files already there."""
    schema = spark.read.parquet(f"{folder}/{name}*.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def in_batches(rows: DataFrame, batches: int, order: str) -> DataFrame:
    """A stream over `rows` that takes `batches` micro-batches, one after the other in ranges of a hash or of `order`.

    `order` is a column: its ranges arrive in order. Given "", rows are dealt by their hash, so they arrive in no order at all.
    The parts are written to the shared folder one after the other, as a writer of files would do.
    """
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession)
    if order:
        span = rows.select(F.col(order).cast("timestamp").cast("double").alias("t")).agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
        low, width = span["low"] or 0.0, ((span["high"] or 0.0) - (span["low"] or 0.0)) / batches or 1.0
        part = F.least(F.floor((F.col(order).cast("timestamp").cast("double") - low) / width), F.lit(batches - 1))
    else:
        part = F.pmod(F.xxhash64(*rows.columns), F.lit(batches))
    dealt = rows.withColumn("_part", part.cast("int"))
    for i in range(batches):
        dealt.filter(F.col("_part") == i).drop("_part").coalesce(1).write.parquet(f"{folder}/part{i}")
        time.sleep(0.01)  # files are taken in the order of their time stamps
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(f"{folder}/part*")


def numbered_folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the `batch=` folders under a path, ascending."""
    target, system = file_system(spark, f"{path}/batch=*")
    return sorted(int(x.getPath().getName().rpartition("=")[2]) for x in system.globStatus(target) or [])


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"


def run_batches(stream: DataFrame, mode: str, folder: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Process everything available, one sink call per micro-batch; offsets live in the folder."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", f"{folder}/_offsets")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_to_table(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream and return its result as a table.

    Every micro-batch overwrites its own sub-folder, so a repeated batch changes nothing. Complete
    mode: the last batch is the result. Update mode: per key the row of the newest batch counts. Append mode: all rows.
    """
    spark = stream.sparkSession
    folder = new_folder(spark)
    last: list[int] = []

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
        last[:] = [batch]

    run_batches(stream, mode, folder, sink)
    if not last:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(f"{_ddl(stream)}, batch BIGINT").parquet(f"{folder}/rows")
    if mode == "complete":
        return rows.filter(F.col("batch") == last[0]).drop("batch")
    if mode == "append":
        return rows.drop("batch")
    return first_per_key(rows, keys, [F.col("batch").desc()]).drop("batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
