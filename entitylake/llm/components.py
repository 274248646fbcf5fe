"""Connected components of a link table, by alternating large and small stars.

Each round hangs every node under the smallest node it knows; the links shrink to one star per component.
Rounds are written to the shared folder, so lineage does not grow and a lost executor costs its tasks only.
Only two sums per round reach the driver: links are merged with their least neighbours, never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("least"))
    hung = both.hint("merge").join(least, F.col("a") == F.col("of")).where("b > a")
    return hung.select(F.col("b").alias("a"), F.least("least", "a").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("least"))
    hung = links.hint("merge").join(least, F.col("a") == F.col("of"))
    moved = hung.where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("of", "least")).toDF("a", "b").distinct()


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (two columns of one type, null and self links ignored) but the roots themselves.

    The root is the smallest node of the component. No links give no rows.
    """
    links = links.toDF("a", "b").where("a <> b")
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _state(now)
    while True:
        after = stored(_small_star(_large_star(now)))
        release(now)
        now, state = after, _state(after)
        if state == seen:
            return now.toDF("node", "root")
        seen = state
