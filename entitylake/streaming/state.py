"""Rows by key that a stream keeps up to date, and lets go of.

The state is a table in the shared folder: one sub-folder of live rows per micro-batch, of which only the newest two are kept,
and one of the rows that ended in that batch. A batch is reduced per key where its rows are (partial sums), so a hot key
is one row when it meets the live one. The clock is the largest event time seen; a row that has been idle for longer than the
time-out ends, which bounds the live rows by the keys that are active.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import file_system, stored
from .run import numbered_folders, run_batches


class KeyedTable:
    """`reduce` turns rows of a batch into one partial row per key with `last_ts`; `combine` makes one row per key of partial rows.

    `ends(clock)` is the condition on a row under which it leaves. Applying a batch again overwrites what it wrote.
    """

    def __init__(self, folder: str, reduce: Callable[[DataFrame], DataFrame], combine: Callable[[DataFrame], DataFrame], ends: Callable[[Column], Column]):
        self.folder, self.reduce, self.combine, self.ends = folder, reduce, combine, ends

    def _read(self, spark: SparkSession, name: str, schema, batch: int | None = None) -> DataFrame:
        path = f"{self.folder}/{name}" + ("" if batch is None else f"/batch={batch}")
        target, system = file_system(spark, path)
        return spark.read.schema(schema).parquet(path) if system.exists(target) else spark.createDataFrame([], schema)

    def apply(self, rows: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
        """Take one micro-batch in. Returns the live rows before it and the partial rows of the batch."""
        spark = rows.sparkSession
        partial = stored(self.reduce(rows))
        before = [b for b in numbered_folders(spark, f"{self.folder}/live") if b < batch]
        old = self._read(spark, "live", partial.schema, max(before)) if before else partial.limit(0)
        now = stored(self.combine(old.unionByName(partial)))
        clocks = self._read(spark, "clock", "clock timestamp", max(before)) if before else spark.createDataFrame([], "clock timestamp")
        clock = clocks.unionAll(partial.agg(F.max(F.col("last_ts").cast("timestamp")))).agg(F.max("clock").alias("clock"))
        stored_clock = stored(clock).first()["clock"]
        gone = F.coalesce(self.ends(F.lit(stored_clock).cast("timestamp")), F.lit(False))
        now.filter(gone).write.mode("overwrite").parquet(f"{self.folder}/ended/batch={batch}")
        clock.write.mode("overwrite").parquet(f"{self.folder}/clock/batch={batch}")
        now.filter(~gone).write.mode("overwrite").parquet(f"{self.folder}/live/batch={batch}")
        for b in before:
            if b < batch - 1:
                target, system = file_system(spark, f"{self.folder}/live/batch={b}")
                system.delete(target, True)
        return old, partial

    def run(self, stream: DataFrame) -> None:
        run_batches(stream, "append", self.folder, lambda rows, batch: self.apply(rows, batch) and None)

    def live(self, spark: SparkSession) -> DataFrame:
        """Rows that have not ended, after the newest batch."""
        return spark.read.parquet(f"{self.folder}/live/batch={max(numbered_folders(spark, f'{self.folder}/live'))}")

    def ended(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/ended").drop("batch")

    def result(self, spark: SparkSession) -> DataFrame:
        """One row per key over live and ended rows; a key that ended and came back is one row again."""
        return self.combine(self.live(spark).unionByName(self.ended(spark)))


def idle(timeout: str) -> Callable[[Column], Column]:
    """Ends where the last event of the key is longer ago than `timeout`."""
    return lambda clock: F.col("last_ts").cast("timestamp") + F.expr(f"INTERVAL {timeout}") < clock
