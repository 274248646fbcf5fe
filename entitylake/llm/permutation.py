"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of the pivots nearest to it. Rows are dealt into blocks by a hash; each block keeps an inverted file: for
every pivot the rows that have it among their nearest, with its place. A query sums the footrule distance to all rows of a block
over the pivots' lists, and the share of the block with the smallest footrule is reranked with the original vectors, in double
precision. The nearest of every block meet once more per query. The query set meets all rows in blocks of both, so no task holds
all queries or all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .vectors import common_length, matrix, sample, usable

#: Pivots (from a bounded sample), how many of them a vector is ordered by, and the share of rows reranked.
#: On 10,000 random vectors of 64 components this finds 0.99 of the 10 nearest; see the tests.
PIVOTS, PREFIX, SHARE = 256, 128, 0.15
SAMPLE_ROWS = 20_000
ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 8_192, 2_048


def pivots(vectors: DataFrame, count: int = PIVOTS, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> np.ndarray:
    """Evenly random rows of the sample, unit length; fewer than `count` if the sample has fewer."""
    given = np.unique(sample(vectors, sample_rows), axis=0)
    return given[np.random.default_rng(seed).permutation(len(given))[:count]]


def orders(x: np.ndarray, given: np.ndarray, prefix: int) -> np.ndarray:
    """The `prefix` nearest pivots of each row, nearest first."""
    far = (given * given).sum(axis=1)[None, :] - 2 * x @ given.T
    part = np.argpartition(far, prefix - 1, axis=1)[:, :prefix] if prefix < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(x), 1))
    near = np.take_along_axis(far, part, axis=1)
    return np.take_along_axis(part, np.lexsort((part, near), axis=1), axis=1)


class InvertedFile:
    """Posting lists of a block: rows that have a pivot in their prefix, and its place there."""

    def __init__(self, prefixes: np.ndarray, n_pivots: int):
        self.rows, self.prefix = prefixes.shape
        flat = prefixes.ravel()
        order = np.argsort(flat, kind="stable")
        self.row, self.place = order // self.prefix, (order % self.prefix).astype(np.int32)
        self.start = np.searchsorted(flat[order], np.arange(n_pivots + 1))
        # a row that lacks a pivot has it at place `prefix`
        self.base = (self.prefix - np.arange(self.prefix, dtype=np.int32)).sum()

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Distance of a query's prefix to every row: pivots outside a prefix stand right behind it.

        Rows start as if they shared no pivot with the query; each shared one corrects both sides of that.
        """
        out = np.full(self.rows, 2 * self.base, dtype=np.int32)
        for place, pivot in enumerate(query.tolist()):
            a, b = self.start[pivot], self.start[pivot + 1]
            there = self.place[a:b]
            out[self.row[a:b]] += np.abs(there - place) - (self.prefix - place) - (self.prefix - there)
        return out


def nearest(ids, x: np.ndarray, wanted_ids, wanted: np.ndarray, given: np.ndarray, prefix: int, share: float, k: int) -> Iterator[tuple[int, list, np.ndarray]]:
    """Per query its k nearest rows of the block that are not its own: (query number, row numbers, distances)."""
    file = InvertedFile(orders(x, given, prefix), len(given))
    own = {}
    for i, name in enumerate(ids):
        own.setdefault(name, []).append(i)
    take = min(len(x), max(4 * k, int(np.ceil(share * len(x)))) + 1)
    places = orders(wanted, given, prefix)
    for q, name in enumerate(wanted_ids):
        far = file.footrule(places[q])
        rows = np.flatnonzero(far <= np.partition(far, take - 1)[take - 1])  # all ties with the last
        rows = np.setdiff1d(rows, own.get(name, []))
        if not len(rows):
            continue
        apart = x[rows] - wanted[q]
        distance = np.sqrt((apart * apart).sum(axis=1))
        close = np.flatnonzero(distance <= np.partition(distance, min(k, len(rows)) - 1)[min(k, len(rows)) - 1])
        best = sorted(close.tolist(), key=lambda i: (distance[i], ids[rows[i]] is None, ids[rows[i]] or 0))[:k]
        yield q, rows[best].tolist(), distance[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE, n_pivots: int = PIVOTS, prefix: int = PREFIX) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `vectors` found for each row of `queries` (vec_id, embedding each).

    Rows with the query's own id are no candidates of it. Vectors that are null, empty or zero, hold null or non-finite components, or have
    another number of components than most rows take no part. Fewer than k candidates are all returned. A repeated query row
    is answered each time; ties go to the smaller id, null ids last.
    """
    rows = vectors.select("vec_id", "embedding").where(usable(F.col("embedding")))
    length = common_length(rows)
    rows = rows.where(F.size("embedding") == length)
    wanted = queries.select("vec_id", "embedding").where(usable(F.col("embedding")) & (F.size("embedding") == length))
    schema = "number bigint, query_id bigint, vec_id bigint, score double"
    if length:
        given = pivots(rows, n_pivots)
        sent = vectors.sparkSession.sparkContext.broadcast((given, min(prefix, len(given))))
        wanted = stored(wanted.withColumn("number", F.monotonically_increasing_id()))
        n_rows, n_queries = rows.count(), wanted.count()
        row_blocks, query_blocks = -(-n_rows // ROWS_PER_BLOCK), max(1, -(-n_queries // QUERIES_PER_BLOCK))

        def meet(key, left, right):
            given, prefix = sent.value
            a, b = left.combine_chunks(), right.combine_chunks()
            if not a.num_rows or not b.num_rows:
                return pa.table({"number": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            ids, numbers, names = a["vec_id"].to_pylist(), b["number"].to_pylist(), b["vec_id"].to_pylist()
            x, y = (matrix(_one(t["embedding"])) for t in (a, b))
            out = [(numbers[q], names[q], ids[row], far) for q, found, distance in nearest(ids, x, names, y, given, prefix, share, k) for row, far in zip(found, distance.tolist())]
            columns = list(zip(*out)) or [[], [], [], []]
            return pa.table({n: pa.array(c, t) for n, c, t in zip(("number", "query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))})

        block = lambda parts: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(parts)).cast("int")
        left = rows.select(block(row_blocks).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "vec_id", "embedding")
        right = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), F.pmod(F.col("number"), F.lit(query_blocks)).cast("int").alias("qb"), "number", "vec_id", "embedding")
        found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(meet, schema)
    else:
        found = vectors.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("number").orderBy("score", F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def self_search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """search() with the rows whose vec_id is divisible by `every` as queries, against all rows."""
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)
