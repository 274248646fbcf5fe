"""Aggregations over progress events and crawl-log states. Each works on a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.serve import success_rate
from .run import run_batches
from .state import KeyedTable, idle


def event_time(df: DataFrame, col: str = "ts", delay: str | None = None) -> DataFrame:
    """Event time as TIMESTAMP, which watermarks need; with a delay, the watermark itself."""
    timed = df.withColumn(col, F.col(col).cast("timestamp"))
    return timed.withWatermark(col, delay) if delay else timed


def job_progress(events: DataFrame) -> DataFrame:
    """One row per job: progress so far, error flag, events, last_ts. Rows of job_progress may be events again: see combine_progress."""
    return events.groupBy("job_id").agg(
        F.greatest(F.max("progress"), F.lit(0)).cast("bigint").alias("progress"),
        F.bool_or(F.col("type") == "error").alias("has_error"),
        F.count(F.lit(1)).alias("events"),
        F.max("ts").alias("last_ts"),
    )


def combine_progress(partial: DataFrame) -> DataFrame:
    return partial.groupBy("job_id").agg(
        F.max("progress").alias("progress"), F.bool_or("has_error").alias("has_error"), F.sum("events").alias("events"), F.max("last_ts").alias("last_ts")
    )


def progress_table(folder: str, timeout: str = "15 minutes") -> KeyedTable:
    """Progress of the jobs of a stream; a job that is silent for longer than the time-out leaves the state."""
    return KeyedTable(folder, job_progress, combine_progress, idle(timeout))


def stage_rank(event_type: Column) -> Column:
    return (
        F.when(event_type == "error", 3).when(event_type == "stage_done", 2)
        .when(event_type.isin("stage_start", "log"), 1).otherwise(0)
    )


def stage_ranks(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id", "stage").agg(F.max(stage_rank(F.col("type"))).alias("rank"), F.max("ts").alias("last_ts"))


def combine_ranks(partial: DataFrame) -> DataFrame:
    return partial.groupBy("job_id", "stage").agg(F.max("rank").alias("rank"), F.max("last_ts").alias("last_ts"))


def stage_names(ranks: DataFrame) -> DataFrame:
    """error over done over running over pending per job and stage."""
    names = F.array(*[F.lit(x) for x in ("pending", "running", "done", "error")])
    return ranks.select("job_id", "stage", F.get(names, F.col("rank")).alias("status"))


def stage_status(events: DataFrame) -> DataFrame:
    return stage_names(stage_ranks(events))


def stage_table(folder: str, timeout: str = "15 minutes") -> KeyedTable:
    return KeyedTable(folder, stage_ranks, combine_ranks, idle(timeout))


# --- crawl statistics ---------------------------------------------------------------------------

FINISHED = ("success", "failed", "skipped", "unsupported", "no_new_results")


def log_states(states: DataFrame) -> DataFrame:
    """The newest state per crawl log: log_id, s (updated_at, event_id, status), last_ts."""
    newest = F.max(F.struct("updated_at", "event_id", "status"))
    return states.groupBy("log_id").agg(newest.alias("s"), F.max("updated_at").alias("last_ts"))


def combine_states(partial: DataFrame) -> DataFrame:
    return partial.groupBy("log_id").agg(F.max("s").alias("s"), F.max("last_ts").alias("last_ts"))


class CrawlCounters:
    """Counts per status with corrections: a log that changes its status takes one from the old count and gives one to the new.

    State is kept for logs that are under way; a finished one leaves after `timeout`, and is then final: a state that comes
    still later counts as a log of its own. What is summed is one small table of changes per batch, not the logs.
    """

    def __init__(self, folder: str, timeout: str = "1 day"):
        def ends(clock: Column) -> Column:
            return idle(timeout)(clock) & F.col("s.status").isin(*FINISHED)

        self.folder, self.table = folder, KeyedTable(folder, log_states, combine_states, ends)

    def apply(self, rows: DataFrame, batch: int) -> None:
        old, partial = self.table.apply(rows, batch)
        was = old.select("log_id", F.col("s").alias("was"))
        met = partial.join(was, "log_id", "left")
        newer = met.filter(F.col("was").isNull() | (F.col("s") > F.col("was")))
        steps = F.array(
            F.struct(F.col("s.status").alias("status"), F.lit(1).alias("n")), F.struct(F.col("was.status").alias("status"), F.when(F.col("was").isNotNull(), -1).otherwise(0).alias("n"))
        )
        deltas = newer.select(F.inline(steps)).filter("n <> 0").groupBy("status").agg(F.sum("n").alias("n"))
        deltas.write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")

    def run(self, stream: DataFrame) -> None:
        run_batches(stream, "append", self.folder, self.apply)

    def stats(self, spark) -> DataFrame:
        """total, success, failed, pending and the rounded success rate, from the changes alone."""
        counted = spark.read.parquet(f"{self.folder}/deltas").agg(
            F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("success", "failed", "pending")]
        )
        return counted.withColumn("success_rate", success_rate(F.col("success"), F.col("total")))


def job_sessions(events: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """Bursts of a job's events; a job silent for longer than the gap is evicted and starts anew.

    In append mode over a stream with a watermark a burst comes out once, when the watermark has passed its end, and its state goes.
    """
    return (
        events.groupBy("job_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.max("progress").alias("progress"))
        .select("job_id", F.col("w.start").alias("started"), F.col("w.end").alias("evicted"), "events", "progress")
    )


def crawl_windows(states: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Crawl states per time window and status."""
    window = F.window("updated_at", width, slide) if slide else F.window("updated_at", width)
    return (
        states.groupBy(window.alias("w"), "status")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"))
        .select(F.col("w.start").alias("window_start"), "status", "n", "duration")
    )
