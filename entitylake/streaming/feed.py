"""Incremental entity feed: versions in, current entities, snapshots and changes out, in any order of arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import TRACKED, changed_fields, only_moved, versions_with_previous
from ..operators.ordering import first_per_key
from ..session import file_system, release, settle, stored
from .run import numbered_folders, run_batches


class EntityFeed:
    """State of the feed as tables of one shared folder.

    versions   every different version once, a sub-folder per batch and hash bucket of the domain: the memory of the feed. A
               batch reads the buckets it touches; a version that is there already is dropped, however late it comes again.
    entities   the newest version per domain with first_seen, a folder per bucket; a batch rewrites the buckets it touches.
    changes, snapshots   signed rows, a sub-folder per batch: +1 is a row that holds now, -1 takes back one that was
               written before a late version came in between. Sums of signs are what holds.

    A batch computes everything from the versions of earlier batches and its own rows, and overwrites its own folders, so it
    can be run again after a lost executor or driver. What it keeps for its own steps goes as soon as no step reads it any more.
    """

    def __init__(self, folder: str, order: Sequence[str], tracked: Sequence[str] = TRACKED, buckets: int = 16):
        self.folder, self.order, self.tracked, self.buckets = folder, list(order), list(tracked), buckets

    def bucket(self, domain: Column) -> Column:
        return F.pmod(F.xxhash64(domain), F.lit(self.buckets)).cast("int")

    def _exists(self, spark: SparkSession, path: str) -> bool:
        target, system = file_system(spark, path)
        return system.exists(target)

    def _before(self, versions: DataFrame, batch: int, buckets: list[int]) -> DataFrame:
        """Versions of earlier batches in the touched buckets."""
        spark = versions.sparkSession
        schema = versions.withColumns({"bucket": F.lit(0), "batch": F.lit(0)}).schema
        if not self._exists(spark, f"{self.folder}/versions"):
            return spark.createDataFrame([], schema).drop("bucket", "batch")
        rows = spark.read.schema(schema).parquet(f"{self.folder}/versions")
        return rows.filter((F.col("batch") < batch) & F.col("bucket").isin(buckets)).drop("bucket", "batch")

    def apply(self, versions: DataFrame, batch: int) -> None:
        spark, columns = versions.sparkSession, versions.columns
        same = ["domain", *self.order]
        incoming = stored(first_per_key(versions, same, [F.xxhash64(*columns)]))
        touched = [r["b"] for r in incoming.select(self.bucket(F.col("domain")).alias("b")).distinct().collect()]
        domains = incoming.select("domain").distinct()
        known = stored(self._before(versions, batch, touched).join(domains, "domain", "left_semi"))
        fresh = incoming.join(known.select(*same).hint("merge"), same, "left_anti")
        own = f"{self.folder}/versions/batch={batch}"
        fresh.withColumn("bucket", self.bucket(F.col("domain"))).write.mode("overwrite").partitionBy("bucket").parquet(own)
        fresh = spark.read.schema(incoming.schema).parquet(own).select(*columns)
        settle(spark)
        self._write_moved(known, fresh, batch)
        self._write_entities(known.unionByName(fresh), domains, touched, batch)
        release(incoming)
        release(known)
        settle(spark)

    def _write_moved(self, known: DataFrame, fresh: DataFrame, batch: int) -> None:
        """Changes and snapshots that hold with the batch and did not without it, and the other way round.

        Only fresh versions and those that follow one directly can differ; the others are left where they are. Versions are put in
        order once, and known versions once without the fresh ones.
        """
        key, spark = ["domain", *self.order], known.sparkSession
        kept = list(dict.fromkeys([*key, *self.tracked]))
        timeline = known.select(*kept, F.lit(False).alias("_fresh")).unionByName(fresh.select(*kept, F.lit(True).alias("_fresh")))
        ordered = stored(versions_with_previous(timeline, self.order, self.tracked, also=["_fresh"]))
        settle(spark)
        behind = F.coalesce("previous._fresh", F.lit(False))
        now = only_moved(ordered.filter(F.col("_fresh") | behind))
        alone = ordered.filter(~F.col("_fresh")).select(*kept, behind.alias("_behind"))
        before = stored(only_moved(versions_with_previous(alone, self.order, self.tracked).filter("_behind")))
        settle(spark)
        self._write_signed("changes", *[changed_fields(v, self.order, self.tracked) for v in (now, before)], batch)
        settle(spark)
        self._write_signed("snapshots", *[v.select(*key, "hash") for v in (now, before)], batch)
        release(ordered)
        release(before)
        settle(spark)

    def _write_signed(self, name: str, now: DataFrame, before: DataFrame, batch: int) -> None:
        """Rows of `now` with sign +1 and those of `before` with -1; rows of both cancel out."""
        both = now.withColumn("sign", F.lit(1)).unionByName(before.withColumn("sign", F.lit(-1)))
        moved = both.groupBy(*now.columns).agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")
        moved.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def _write_entities(self, timeline: DataFrame, domains: DataFrame, touched: list[int], batch: int) -> None:
        """Touched buckets only. They are written aside first: a batch that dies while it replaces them finds them there."""
        spark, aside, path = timeline.sparkSession, f"{self.folder}/aside/batch={batch}", f"{self.folder}/entities"
        if not self._exists(spark, f"{aside}/_SUCCESS"):
            newest = first_per_key(timeline, ["domain"], [F.col(c).desc() for c in self.order])
            starts = timeline.groupBy("domain").agg(F.min(self.order[0]).alias("first_seen"))
            current = newest.join(starts, "domain").withColumn("bucket", self.bucket(F.col("domain")))
            if self._exists(spark, path):
                others = spark.read.schema(current.schema).parquet(path).filter(F.col("bucket").isin(touched)).join(domains, "domain", "left_anti")
                current = current.unionByName(others)
            current.write.mode("overwrite").parquet(aside)
        rows = spark.read.parquet(aside).repartition("bucket").sortWithinPartitions("bucket", "domain")
        rows.write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        for earlier in numbered_folders(spark, f"{self.folder}/aside"):
            if earlier < batch:
                target, system = file_system(spark, f"{self.folder}/aside/batch={earlier}")
                system.delete(target, True)

    def run(self, stream: DataFrame) -> int:
        """Apply every available micro-batch; returns the number of the last one, of an earlier run if none is new."""
        run_batches(stream, "append", self.folder, self.apply)
        return self.last_batch(stream.sparkSession)

    def last_batch(self, spark: SparkSession) -> int:
        """The newest batch in the folder, -1 without any."""
        return max(numbered_folders(spark, f"{self.folder}/changes"), default=-1)

    def entities(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/entities").drop("bucket")

    def history(self, spark: SparkSession, name: str) -> DataFrame:
        """The rows of "changes" or "snapshots" that hold after the newest batch."""
        rows = spark.read.parquet(f"{self.folder}/{name}").drop("batch")
        return rows.groupBy(*[c for c in rows.columns if c != "sign"]).agg(F.sum("sign").alias("sign")).filter("sign > 0").drop("sign")
