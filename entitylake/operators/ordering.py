"""First-per-key, top-k, ranking and previous-row operators that stand a hot key.

A plain window puts a whole key into one task. First-per-key and top-k keep a row_number filter,
which Spark turns into a per-task group limit before the shuffle, so a hot key sends k rows per
task. Full ranking and lag cannot drop rows: the rows of a hot key are cut at sampled values of its
order, like a range sort does, and small per-bucket summaries are joined. The sample is a table of the same
plan: nothing is run ahead. It has one row in 125,000 at most and is broadcast, so rows are shuffled once, for the window.
Where no key is hot it is empty, and adaptive execution takes the joins with it out of the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import bind

# Rows of one key that a single task may sort, about.
HOT_KEY_ROWS = 1_000_000
# Sampled cuts per that many rows; a key with fewer cuts is not cut at all.
CUTS = 8


def top_k_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str | None = None
) -> DataFrame:
    name = rank_col or "_row"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= k)
    return kept if rank_col else kept.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k_per_key(df, keys, order, 1)


def _count_below(cuts: Column, key: Column) -> Column:
    """How many of the sorted cuts lie below the key, by halving."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(cuts, middle) < key
        return F.struct(
            F.when((s["low"] < s["high"]) & below, middle + 1).otherwise(s["low"]).alias("low"),
            F.when((s["low"] < s["high"]) & ~below, middle).otherwise(s["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(cuts).cast("long"))))
    start = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))
    return F.aggregate(steps, start, halve, lambda s: s["low"])


def joined_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null: null equals null. The right side brings its other columns only."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def _placed(order: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])


def hot_cuts(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """keys and `_cuts`: sampled values of `order`, sorted, of the keys that have CUTS of them or more.

    One row in hot_rows / CUTS is sampled by the hash of key and order, the same in every run, so a key that is cut has about
    `hot_rows` rows or more, and the table has at most one cut per hot_rows / CUTS rows. Only key and order columns are read.
    """
    every = max(1, hot_rows // CUTS)
    placed = df.select(*keys, _placed(order).alias("_at"))
    sample = placed.filter(F.pmod(F.xxhash64(*keys, "_at"), F.lit(every)) == 0)
    return sample.groupBy(*keys).agg(F.sort_array(F.collect_set("_at")).alias("_cuts")).filter(F.size("_cuts") >= CUTS)


def with_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Add `_bucket`, which never falls along (keys, order), all ascending with nulls first; null for keys that are not hot."""
    cut = joined_on(df.withColumn("_at", _placed(order)), F.broadcast(hot_cuts(df, keys, order, hot_rows)), keys, "left")
    bucket = F.when(F.col("_cuts").isNotNull(), bind(F.struct("_cuts", "_at"), lambda x: _count_below(x["_cuts"], x["_at"])))
    return cut.withColumn("_bucket", bucket).drop("_cuts", "_at")


def rank_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank_col: str = "rank",
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Row number 1..n per key; the rows of a key with many more than `hot_rows` are spread over tasks.

    `order` must be ascending expressions that end in a unique one (negate a number to go down). The input is read three
    times, twice for key and order only, so a costly one should be a stored table.
    """
    cut = with_buckets(df, keys, order, hot_rows)
    group = [*keys, "_bucket"]
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = with_buckets(df.select(*keys, *[c.alias(f"_o{i}") for i, c in enumerate(order)]), keys, [F.col(f"_o{i}") for i in range(len(order))], hot_rows)
    counted = sizes.filter(F.col("_bucket").isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counted.select(*group, F.sum("_n").over(before).alias("_before"))
    placed = joined_on(local, F.broadcast(offsets), group, "left")
    return placed.withColumn(rank_col, F.coalesce("_before", F.lit(0)) + F.col("_local")).drop("_bucket", "_local", "_before")


def previous_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str], name: str = "prev",
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Add struct `name` with `values` of the previous row of the key, null for the first row."""
    payload = F.struct(*[F.col(v) for v in values])
    cut = with_buckets(df, keys, order, hot_rows)
    group = [*keys, "_bucket"]
    inside = Window.partitionBy(*group).orderBy(*order)
    local = cut.withColumn("_lag", F.lag(payload).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    tails = cut.filter(F.col("_bucket").isNotNull()).groupBy(*group).agg(F.max_by(payload, _placed(order)).alias("_tail"))
    carried = tails.select(*group, F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry"))
    carried = carried.filter(F.col("_carry").isNotNull())
    found = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))
    return joined_on(local, F.broadcast(carried), group, "left").withColumn(name, found).drop("_bucket", "_lag", "_first", "_carry")
