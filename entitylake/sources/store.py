"""The saved tables of discovery runs, in one folder that all executors share.

`entities` is one row per domain, dealt over hash buckets of the domain and sorted inside them: a lookup opens the files of one
bucket, and an upsert rewrites only the buckets it touches. All other tables are logs: every run writes its own partition
and overwrites it when it is repeated, so a retry adds nothing. What a run is about to write is kept under `runs/` until it is
done; a run that died half way goes on from there and never compares its rows with what it has written itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import first_per_key
from ..operators.people import PERSON
from ..session import file_system

#: Columns of an entity that a run brings; time stamps, validity and bucket are the store's own.
DATA = {
    "domain": "string", "name": "string", "description": "string", "services": "array<string>", "founders": f"array<{PERSON}>",
    "linkedin": "string", "twitter": "string", "technologies": "array<string>", "locations": "array<string>",
    "emails": "array<string>", "phones": "array<string>", "confidence": "double", "relevance": "double", "category": "string",
    "source": "string", "meta_title": "string", "meta_description": "string", "positioning": "string", "competitor_tier": "string",
}
STAMPS = {"is_valid": "boolean", "first_seen": "timestamp_ntz", "last_seen": "timestamp_ntz"}
ENTITY = DATA | STAMPS
LOGS = {
    "links": "query_id bigint, raw string, domain string, score double, is_new boolean, linked_at timestamp_ntz",
    "snapshots": "domain string, query_id bigint, hash string, created_at timestamp_ntz",
    "changes": "domain string, query_id bigint, field string, old_value string, new_value string, change_type string, detected_at timestamp_ntz",
    "validations": "domain string, query_id bigint, validation_type string, passed boolean, score double, reason string, created_at timestamp_ntz",
    "crawl_logs": "query_id bigint, url string, round int, pos int, event int, status string, error string, entities_found int, created_at timestamp_ntz",
}


def as_rows(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """`df` with exactly these columns and types; those it lacks are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


class EntityStore:
    """Tables under `folder`. `buckets` belongs to the folder: it must be the same whenever the folder is opened."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        target, system = file_system(self.spark, self.path(name))
        return system.exists(target)

    def drop(self, name: str) -> None:
        target, system = file_system(self.spark, self.path(name))
        system.delete(target, True)

    def bucket(self, domain) -> "F.Column":
        return F.pmod(F.xxhash64(domain), F.lit(self.buckets)).cast("int")

    # --- steps of a run

    def once(self, run_id: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A step of a run: made and written the first time, read by every repetition."""
        path = f"runs/{run_id}/{name}"
        if not self.exists(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(self.path(path))
        return self.spark.read.parquet(self.path(path))

    def is_done(self, run_id: str) -> bool:
        return self.exists(f"done/{run_id}")

    def finish(self, run_id: str) -> None:
        target, system = file_system(self.spark, self.path(f"done/{run_id}"))
        system.mkdirs(target)
        self.drop(f"runs/{run_id}")

    # --- logs

    def put(self, name: str, rows: DataFrame, run_id: str) -> None:
        """The rows of a run in a log. Writing them again replaces them."""
        columns = dict(part.strip().split(" ", 1) for part in LOGS[name].split(","))
        as_rows(rows, columns).write.mode("overwrite").parquet(self.path(f"{name}/run_id={run_id}"))

    def log(self, name: str, but: str | None = None) -> DataFrame:
        """All rows of a log with their run_id, those of run `but` left out (its partition is not read)."""
        schema = f"{LOGS[name]}, run_id string"
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.path(name))
        return rows if but is None else rows.filter(F.col("run_id") != but)

    # --- entities

    def entities(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """Stored entities with their bucket; of the given buckets only, if any are given."""
        schema = ", ".join(f"{c} {t}" for c, t in ENTITY.items()) + ", bucket int"
        if not self.exists("entities"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.path("entities"))
        return rows if buckets is None else rows.filter(F.col("bucket").isin(list(buckets)))

    def lookup(self, *domains: str) -> DataFrame:
        """Entities by domain: their buckets are the only folders listed, and the filter reaches the sorted files."""
        keys = self.spark.createDataFrame([(d,) for d in domains], "domain string")
        buckets = [r["b"] for r in keys.select(self.bucket(F.col("domain")).alias("b")).distinct().collect()]
        return self.entities(buckets).filter(F.col("domain").isin(list(domains)))

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of `rows` (domain); never more than there are."""
        return sorted(r["b"] for r in rows.select(self.bucket(F.col("domain")).alias("b")).distinct().collect())

    def merged(self, incoming: DataFrame, as_of, order: Sequence[str]) -> DataFrame:
        """The touched buckets after the upsert of `incoming`, whose last row per domain in `order` counts.

        A known domain gets all data columns, last_seen and is_valid and keeps first_seen; a new one is first seen now. Rows
        without a domain are left out.
        """
        last = first_per_key(incoming.filter(F.col("domain").isNotNull()), ["domain"], [F.col(c).desc() for c in order])
        new = as_rows(last, DATA).select(F.struct(*DATA).alias("i"))
        old = self.entities(self.touched(incoming)).select(F.struct(*ENTITY).alias("c"))
        both = old.join(new, F.col("c.domain") == F.col("i.domain"), "full")
        hit, now = F.col("i.domain").isNotNull(), as_of
        columns = [F.when(hit, F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in DATA]
        stamps = [
            F.when(hit, F.lit(True)).otherwise(F.col("c.is_valid")).alias("is_valid"),
            F.coalesce("c.first_seen", now).alias("first_seen"),
            F.when(hit, now).otherwise(F.col("c.last_seen")).alias("last_seen"),
        ]
        return both.select(*columns, *stamps).withColumn("bucket", self.bucket(F.col("domain")))

    def write_buckets(self, rows: DataFrame) -> None:
        """Replace the buckets that `rows` (entities with bucket) come from, one sorted file each; the others keep their files."""
        (
            rows.repartition("bucket").sortWithinPartitions("bucket", "domain").write.partitionBy("bucket")
            .mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path("entities"))
        )

    def load(self, rows: DataFrame) -> None:
        """Entities as they are, time stamps and all, into an empty store; one row per domain."""
        self.write_buckets(as_rows(rows, ENTITY).withColumn("bucket", self.bucket(F.col("domain"))))

    def upsert(self, incoming: DataFrame, as_of, order: Sequence[str], run_id: str) -> None:
        """Merge rows into `entities`. The merged buckets are kept as a step of the run until they are in place, so a run that
        dies while it replaces them writes the same files again."""
        self.write_buckets(self.once(run_id, "merged", lambda: self.merged(incoming, as_of, order)))
