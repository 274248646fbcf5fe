"""Vectors as tables: which rows take part, and distinct vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample


def usable(embedding: Column) -> Column:
    """Not null, not empty, all components finite, not all zero. Never null itself."""
    finite = F.forall(embedding, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def common_length(vectors: DataFrame) -> int:
    """The number of components that most usable rows have (the smaller of equals); 0 for no rows."""
    row = vectors.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row["n"] if row else 0


def sample(vectors: DataFrame, rows: int) -> np.ndarray:
    """At most `rows` vectors, unit length, a row each; a bounded sample to fit an index on."""
    some = bounded_sample(vectors.select("embedding"), rows).toArrow().column(0)
    return unit(matrix(some.combine_chunks()))


def matrix(arrow_list) -> np.ndarray:
    values = arrow_list.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(arrow_list), -1) if len(arrow_list) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    if not x.size:
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that neither squares nor their sum leave the range of doubles
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
