"""Arrays to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame) -> DataFrame:
    """The same rows, out of an array: no filter on what is made of them moves below this point.

    Spark moves filters below joins and repartitions, and with them the work their columns stand for.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def exploded(
    df: DataFrame, keep: Sequence[str | Column], values: Column | str, value: str, pos: str | None = None
) -> DataFrame:
    """One row per array element; empty arrays give none and elements must not be null.

    A plain explode makes Spark add a "size > 0" filter that repeats the array expression twice, down
    at the scan. The outer form plus a filter on its output evaluates the array once.
    """
    rows = F.posexplode_outer(values).alias(pos, value) if pos else F.explode_outer(values).alias(value)
    return df.select(*keep, rows).filter(F.col(pos or value).isNotNull())
