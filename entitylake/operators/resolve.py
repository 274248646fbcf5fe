"""Duplicates by domain and by similar name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import bind
from ..functions.text import name_key
from ..functions.urls import domain_key
from .ordering import first_per_key, top_k_per_key


def dedup_by_domain(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """First row per domain key (and `keys`) in `order`."""
    keyed = df.withColumn("_key", domain_key(F.col("domain")))
    return first_per_key(keyed, [*keys, "_key"], order).drop("_key")


# A segment shared by more names than this is cut into pieces, so that no task gets a whole one.
SEGMENT_LIMIT = 2000


def _max_edits(longer: Column, threshold: float) -> Column:
    """Most edits two names may be apart when the longer one has this length."""
    return (F.ceil(longer * F.lit(1 - threshold)) - 1).cast("int")


def _segment(edits: Column, length: Column, i: Column) -> tuple[Column, Column]:
    """Start and size of segment i when a name is cut into edits + 1 nearly equal segments."""
    size = F.floor(length / (edits + 1)).cast("int")
    longer_from = edits + 1 - length % (edits + 1)
    start = i * size + F.greatest(i - longer_from, F.lit(0)) + 1
    return start.cast("int"), (size + (i >= longer_from).cast("int")).cast("int")


def _segments(names: DataFrame, threshold: float) -> DataFrame:
    """Every name under each of its segments, for each number of edits a longer partner allows."""
    length = F.length("name")
    allowed = F.array_distinct(
        F.transform(F.sequence(length, F.floor(length / threshold).cast("int")), lambda n: _max_edits(n, threshold))
    )
    cut = (
        names.filter(length > 0)
        .withColumn("length", length)
        .withColumn("edits", F.explode(F.filter(allowed, lambda e: e >= 1)))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    )
    start, size = _segment(F.col("edits"), F.col("length"), F.col("i"))
    return cut.withColumn("segment", F.substr("name", start, size))


def _probes(names: DataFrame, threshold: float) -> DataFrame:
    """The substrings of every name that could equal a segment of a partner no longer than it.

    With e edits allowed, one of e + 1 segments of the partner is untouched and sits at most
    (e +- difference in length) / 2 places away.
    """
    full = F.length("name")
    spread = (
        names.withColumn("edits", _max_edits(full, threshold))
        .filter("edits >= 1")
        .withColumn("length", F.explode(F.sequence(full - F.col("edits"), full)))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    )
    start, size = _segment(F.col("edits"), F.col("length"), F.col("i"))
    gap = full - F.col("length")
    low = F.greatest(start - F.floor((F.col("edits") - gap) / 2).cast("int"), F.lit(1))
    high = F.least(start + F.floor((F.col("edits") + gap) / 2).cast("int"), full - size + 1)
    placed = spread.withColumn("low", low).withColumn("high", high).filter("low <= high")
    return placed.withColumn(
        "segment", F.explode_outer(F.transform(F.sequence("low", "high"), lambda at: F.substr("name", at, size)))
    ).drop("low", "high")


def _meet(probes: DataFrame, segments: DataFrame) -> DataFrame:
    """probes and segments (name, key, ...) joined on the segment, large ones in pieces."""
    by = ["length", "edits", "i", "segment"]
    pieces = (
        segments.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > SEGMENT_LIMIT)
        .select(*by, F.ceil(F.col("n") / SEGMENT_LIMIT).cast("int").alias("pieces"))
    )
    one = F.lit(1)
    left = probes.join(pieces, by, "left").withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", one) - 1))
    )
    right = segments.join(pieces, by, "left").withColumn(
        "piece", F.pmod(F.xxhash64("name"), F.coalesce("pieces", one)).cast("int")
    )
    parallel = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, "piece"]
    # Few rows may meet in many pairs: a fixed number of partitions keeps them from being merged.
    a = left.drop("pieces").repartition(parallel, *keys).alias("p")
    b = right.drop("pieces").withColumnRenamed("name", "other").alias("s")
    return a.join(b, keys)


def _nearest_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(name, match_id): smallest id of a different right name above the threshold.

    left(name), right(name, id), names distinct. Exact: segments lose no pair and every pair that
    meets is verified. Pairs are reduced to the smallest id where they meet and never shuffled.
    """
    a, b = F.col("name"), F.col("other")
    longer = F.greatest(F.length(a), F.length(b))
    # the distance is given up as -1 once it passes what the length allows
    edits = F.call_function("levenshtein", a, b, _max_edits(longer, threshold) + 1)
    similar = (a != b) & bind(edits, lambda d: (d >= 0) & ((longer - d) / longer > threshold))
    shorter_right = (
        _meet(_probes(left, threshold), _segments(right, threshold))
        .filter(similar)
        .groupBy("name")
        .agg(F.min("id").alias("match_id"))
    )
    longer_right = (
        _meet(_probes(right, threshold), _segments(left, threshold))
        .filter((F.length(a) > F.length(b)) & similar)
        .groupBy(b.alias("name"))
        .agg(F.min("id").alias("match_id"))
    )
    return shorter_right.union(longer_right).groupBy("name").agg(F.min("match_id").alias("match_id"))


def similar_entities(left: DataFrame, right: DataFrame, threshold: float = 0.85) -> DataFrame:
    """For each left entity the first right entity with the same domain key or a similar name.

    Both: id, name, domain. "First" is the smallest right id other than the own one. Output:
    id, match_id, reason. Equal names are collapsed before names are compared, so a name that a
    third of all rows share is compared once.
    """
    l = left.select("id", name_key(F.col("name")).alias("name"), domain_key(F.col("domain")).alias("key"))
    r = right.select("id", name_key(F.col("name")).alias("name"), domain_key(F.col("domain")).alias("key"))

    def two_smallest(groups: DataFrame, by: str) -> DataFrame:
        # The smallest id, and the next one for the row that is the smallest itself. Two rows per
        # group leave each task, however large the group.
        two = top_k_per_key(groups.select(by, "id"), [by], [F.col("id")], 2, "_rank")
        return two.groupBy(by).agg(
            F.min("id").alias("first_id"), F.min(F.when(F.col("_rank") == 2, F.col("id"))).alias("second_id")
        )

    by_key = two_smallest(r, "key")
    by_name = two_smallest(r, "name")
    other = F.when(F.col("first_id") != F.col("id"), F.col("first_id")).otherwise(F.col("second_id"))
    same_domain = l.join(by_key, "key").select("id", other.alias("match_id"), F.lit("domain").alias("reason"))
    same_name = l.join(by_name, "name").select("id", other.alias("match_id"), F.lit("name").alias("reason"))

    named = by_name.select("name", F.col("first_id").alias("id"))
    nearest = _nearest_names(l.select("name").distinct(), named, threshold)
    near_name = l.join(nearest, "name").select("id", "match_id", F.lit("name").alias("reason"))
    found = same_domain.union(same_name).union(near_name).filter(F.col("match_id").isNotNull())
    return found.groupBy("id").agg(F.min(F.struct("match_id", "reason")).alias("m")).select(
        "id", "m.match_id", "m.reason"
    )
