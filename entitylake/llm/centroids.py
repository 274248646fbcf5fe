"""Centroid clustering with exact integers: vectors and centroids are compared in the Walsh-Hadamard domain, coarse to fine.

The transform of an integer vector is an integer vector, and squared distances grow by exactly its width, so nothing is rounded
and ties are ties. Coefficients are ordered by sequency. A search adds up squared differences slice by slice; after each slice
the centroid that looks best is finished, and every centroid whose part already exceeds that distance is out. Those that are
left after the last slice have all their coefficients counted.

Vectors are transformed once and stored. A round reads them, sums coefficients per cluster inside each task, and sends one row
per cluster and task on; the transform is linear, so the sums of coefficients are the coefficients of the sums. Only the
centroids (k rows) reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, stored

WIDTH, CENTROIDS, ROUNDS, SCALE, SALT = 64, 40, 5, 256, 2
#: Integers beyond this size are set to it, so that distances and their sums stay within longs.
LARGEST = 1 << 20
#: Vectors of a batch that are searched at a time.
SLICE = 2048


def hadamard(width: int) -> np.ndarray:
    """The Walsh-Hadamard matrix, rows by sequency (number of sign changes); symmetric up to that order, entries 1 and -1."""
    made = np.ones((1, 1), dtype=np.int64)
    while len(made) < width:
        made = np.block([[made, made], [made, -made]])
    if len(made) != width:
        raise ValueError(f"the width must be a power of two, not {width}")
    return made[np.argsort((np.diff(made, axis=1) != 0).sum(axis=1), kind="stable")]


def slices(width: int) -> list[tuple[int, int]]:
    """Coarse to fine: an eighth of the coefficients, then as many again each time."""
    edges = sorted({0, max(1, width // 8), max(1, width // 4), max(1, width // 2), width})
    return list(zip(edges, edges[1:]))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For coefficient rows the number of the nearest centroid (of equals the smaller) and the squared distance of coefficients."""
    n, k = len(x), len(centres)
    far = np.zeros((n, k), dtype=np.int64)
    row, col = (a.ravel() for a in np.mgrid[0:n, 0:k])
    parts = slices(x.shape[1])
    for i, (a, b) in enumerate(parts):
        differ = x[row, a:b] - centres[col, a:b]
        far[row, col] += (differ * differ).sum(axis=1)
        if i + 1 == len(parts):
            break
        open_far = np.full((n, k), np.iinfo(np.int64).max)
        open_far[row, col] = far[row, col]
        likely = open_far.argmin(axis=1)
        rest = x[:, b:] - centres[likely, b:]
        bound = far[np.arange(n), likely] + (rest * rest).sum(axis=1)
        left = far[row, col] <= bound[row]  # only the strictly worse are out
        row, col = row[left], col[left]
    whole = np.full((n, k), np.iinfo(np.int64).max)
    whole[row, col] = far[row, col]
    best = whole.argmin(axis=1)
    return best, whole[np.arange(n), best]


def coefficients(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE, largest: int = LARGEST) -> DataFrame:
    """(vec_id, coef) of the rows of vectors (vec_id, embedding) with exactly `width` components, none null or non-finite."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    kept = vectors.where(F.coalesce((F.size(x) == width) & finite, F.lit(False))).select("vec_id", x.cast("array<double>").alias("embedding"))
    turn = hadamard(width)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(1)
                values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)
                whole = np.clip(np.floor(values * scale), -largest, largest).astype(np.int64)
                coef = (whole @ turn.T).astype(np.int32).ravel()
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, len(coef) + 1, width), pa.int32()), pa.array(coef))
                yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["vec_id", "coef"])

    schema = kept.select("vec_id").withColumn("coef", F.array(F.lit(0)).cast("array<int>")).schema
    return kept.mapInArrow(run, schema)


def numbers(batch: pa.RecordBatch, at: int, name: str = "coef") -> np.ndarray:
    lists = batch.slice(at, SLICE).column(batch.schema.get_field_index(name))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def sums(coefs: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cluster, n, total) of one assignment: per task one row for each cluster it met, summed by Spark."""

    def run(batches):
        total, count = np.zeros(centres.shape, dtype=np.int64), np.zeros(len(centres), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                x = numbers(batch, at)
                cluster, _ = nearest(x, centres)
                np.add.at(total, cluster, x)
                count += np.bincount(cluster, minlength=len(centres))
        met = np.flatnonzero(count)
        width = centres.shape[1]
        columns = (np.repeat(met, width), np.tile(np.arange(width), len(met)), np.repeat(count[met], width), total[met].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["cluster", "place", "n", "total"])

    parts = coefs.select("coef").mapInArrow(run, "cluster bigint, place bigint, n bigint, total bigint")
    return parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def moved(coefs: DataFrame, centres: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor of the mean; those without vectors stay."""
    after = centres.copy()
    total: dict[int, list] = {}
    for r in sums(coefs, centres).collect():  # k times width rows
        total.setdefault(r["cluster"], [0, [0] * centres.shape[1]])
        total[r["cluster"]][0] = r["n"]
        total[r["cluster"]][1][r["place"]] = int(r["total"])
    for cluster, (n, coef) in total.items():
        whole = (np.array(coef, dtype=object) @ turn) // len(turn)  # the transform back, exact
        after[cluster] = turn @ np.array([int(v) // n for v in whole], dtype=np.int64)
    return after


def assigned(coefs: DataFrame, centres: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of every vector."""
    width = centres.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                cluster, far = nearest(numbers(batch, at), centres)
                ids = batch.slice(at, SLICE).column(0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(far // width)], names=["vec_id", "cluster", "distance"])

    schema = coefs.select("vec_id").withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}).schema
    return coefs.mapInArrow(run, schema)


def first_centroids(coefs: DataFrame, k: int, salt: int) -> np.ndarray:
    """The k vectors with the smallest hash of `salt:<vec_id>` (a null id is empty text); equal ids go by their components."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = coefs.withColumn("digest", digest).orderBy("digest", "coef").limit(k).collect()
    return np.array([r["coef"] for r in chosen], dtype=np.int64)


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, salt: int = SALT) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept row of vectors (vec_id, embedding).

    Kept are rows with exactly `width` components, none null or non-finite; the others have no row. Integers beyond 2^20 are set
    to 2^20. With fewer than k kept rows each is a centroid. Repeated rows stay, and may both be centroids; equal distances go to
    the smaller number; other columns are not read. Without kept rows there are none in the result. Sums beyond a long stop at
    its largest value.
    """
    spark = vectors.sparkSession
    turn = hadamard(width)
    coefs = stored(coefficients(vectors.select("vec_id", "embedding"), width))
    centres = first_centroids(coefs, k, salt)
    if not len(centres):
        return coefs.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        centres = moved(coefs, centres, turn)
    rows = stored(assigned(coefs, centres))
    release(coefs)
    found = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most = (1 << 63) - 1
    named = []
    for c, centre in enumerate(centres):
        text = ",".join(str(int(v)) for v in (turn.T @ centre) // width)
        named.append((c, min(found.get(c, 0), most), min(sum(found.values()), most), hashlib.sha256(text.encode()).hexdigest()))
    known = spark.createDataFrame(named, "of int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return rows.join(F.broadcast(known), F.col("cluster") == F.col("of")).drop("of")


def _round(i: int) -> str:
    return f"""d{i} AS (SELECT x.r, c.c, sum((x.v - c.v) * (x.v - c.v)) AS far FROM x JOIN c{i} c ON c.j = x.j GROUP BY x.r, c.c),
a{i} AS MATERIALIZED (SELECT r, arg_min(c, far * 64 + c) AS c, min(far) AS far FROM d{i} GROUP BY r),
m{i} AS (SELECT c, j, (s - ((s % n) + n) % n) // n AS v FROM (SELECT a.c, x.j, sum(x.v) AS s, count(*) AS n FROM a{i} a JOIN x ON x.r = a.r GROUP BY a.c, x.j)),
c{i + 1} AS MATERIALIZED (SELECT c.c, c.j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c AND m.j = c.j),
"""


SQL = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
x AS MATERIALIZED (SELECT r, j, CAST(floor(256 * CAST(embedding[j] AS DOUBLE)) AS HUGEINT) AS v FROM (SELECT r, embedding, unnest(range(1, 65)) AS j FROM kept)),
c0 AS MATERIALIZED (SELECT r AS c, j, v FROM x WHERE r < 40),
{"".join(_round(i) for i in range(ROUNDS))}
d AS (SELECT x.r, c.c, sum((x.v - c.v) * (x.v - c.v)) AS far FROM x JOIN c{ROUNDS} c ON c.j = x.j GROUP BY x.r, c.c),
a AS MATERIALIZED (SELECT r, arg_min(c, far * 64 + c) AS c, min(far) AS far FROM d GROUP BY r),
named AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY j)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.far AS BIGINT) AS distance, CAST(sum(a.far) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.far) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a JOIN kept k ON k.r = a.r JOIN named n ON n.c = a.c
"""
