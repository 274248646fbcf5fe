"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the vectors.

A rotation of the principal axes is learned on a bounded sample so that the signs of the rotated components make balanced codes.
Codes are cut into `tables` substrings. Each vector is posted under every substring within `reach` bits of its own, so two
vectors meet in a table if their substrings differ in 2 * reach bits or fewer. A meeting counts in one place only: the
first table in which the pair meets, under the smallest substring between them. There the codes are compared whole; only vectors with a
partner within `radius` bits go on, with their original components, and the cosine is taken in double precision.
Meetings are cut into chunks that meet pairwise, and return a count per vector and a spanning forest, never all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .vectors import common_length, matrix, sample, unit, usable

SAMPLE_ROWS, ROUNDS = 20_000, 50
BITS, TABLES, RADIUS = 64, 4, 16
#: Vectors of a meeting that one task compares with as many others.
CHUNK = 512


@dataclass
class Codes:
    turn: np.ndarray  # components x bits

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Codes of unit vectors as unsigned longs; unused high bits are 0.

        The mean is not taken off: that would widen the angles between vectors that share a direction, and with them the
        number of differing bits of near copies.
        """
        signs = x @ self.turn > 0
        padded = np.zeros((len(x), 64), dtype=np.uint8)
        padded[:, : signs.shape[1]] = signs
        return np.packbits(padded, axis=1, bitorder="little").view("<u8").ravel()


def learn(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> Codes:
    """Iterative quantisation (alternate codes and the orthogonal rotation that fits them best) of unit vectors."""
    centred = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(centred.T @ centred)
    axes = axes[: min(bits, x.shape[1])].T
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1],) * 2))[0]
    projected = centred @ axes
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(projected @ turn).T @ projected)
        turn = (left @ right).T
    return Codes(axes @ turn)


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest substring within one bit of both; for substrings that differ in at most two bits."""
    differ = a ^ b
    low = differ & (~differ + np.uint64(1))
    single = differ == low
    return np.where(differ == 0, a, np.where(single, np.minimum(a, b), np.minimum(a ^ low, b ^ low)))


def meets(codes: np.ndarray, other: np.ndarray, table: int, key: int, width: int, radius: int) -> np.ndarray:
    """Pairs (a row of `codes`, a row of `other`) that count in this meeting."""
    a, b = codes[:, None], other[None, :]
    near = np.bitwise_count(a ^ b) <= radius
    if not near.any():
        return near
    low = np.uint64((1 << width) - 1)
    for earlier in range(table):
        near &= np.bitwise_count(((a ^ b) >> np.uint64(earlier * width)) & low) > 2
    mine = np.uint64(table * width)
    return near & (between((a >> mine) & low, (b >> mine) & low) == np.uint64(key))


def posted(coded: DataFrame, tables: int, width: int) -> DataFrame:
    """table, key, class, code: every code under each of its substrings and their neighbours by one bit."""
    low = (1 << width) - 1
    own = lambda t: F.shiftrightunsigned("code", t * width).bitwiseAND(F.lit(low))
    places = [
        F.struct(F.lit(t).cast("short").alias("table"), own(t).bitwiseXOR(F.lit(flip)).alias("key"))
        for t in range(tables) for flip in (0, *(1 << i for i in range(width)))
    ]
    return coded.select("class", "code", F.explode(F.array(*places)).alias("x")).select("x.table", "x.key", "class", "code")


def meetings(rows: DataFrame, *columns: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of one (table, key) in chunks that meet pairwise: table, key, one, two, side and the columns, as lists."""
    busy = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").toDF("t", "k", "members")
    parts = F.ceil(F.col("members") / F.lit(chunk)).cast("int")
    met = rows.join(busy, (F.col("table") == F.col("t")) & (F.col("key") == F.col("k"))).drop("t", "k")
    return (
        met.withColumn("mine", F.pmod(F.xxhash64("class"), parts.cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .groupBy("table", "key", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))
        .agg(F.collect_list(F.struct("mine", *columns)).alias("x"))
        .select("table", "key", "one", "two", F.col("x.mine").alias("mine"), *(F.col(f"x.{c}").alias(c) for c in columns))
    )


def sides(mine: list, one: int, two: int) -> tuple[np.ndarray, np.ndarray]:
    side = np.array(mine)
    return np.flatnonzero(side == one), np.flatnonzero(side == two)


def promising(coded: DataFrame, tables: int, width: int, radius: int) -> DataFrame:
    """table, key, class of vectors with a partner within `radius` bits that counts there."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            out: list[tuple[int, int, int]] = []
            for i, table in enumerate(rows["table"]):
                code, key = np.array(rows["code"][i], dtype=np.int64).view(np.uint64), rows["key"][i]
                a, b = sides(rows["mine"][i], rows["one"][i], rows["two"][i])
                near = meets(code[a], code[b], table, key, width, radius)
                if rows["one"][i] == rows["two"][i]:
                    np.fill_diagonal(near, False)
                if near.any():
                    names = rows["class"][i]
                    out += [(table, key, names[j]) for j in {*a[near.any(axis=1)].tolist(), *b[near.any(axis=0)].tolist()}]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int16(), pa.int64(), pa.int64()))], names=["table", "key", "class"])

    return meetings(posted(coded, tables, width), "class", "code").mapInArrow(run, "table short, key bigint, class bigint").distinct()


def verified(classes: DataFrame, hits: DataFrame, least: float, width: int, radius: int) -> DataFrame:
    """a, b, copies: b null in rows that count the copies linked with class a, else a star of a forest of links."""
    rows = hits.withColumnRenamed("class", "of").join(classes, F.col("of") == F.col("class")).drop("of")

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int | None, int]] = []
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("table", "key", "one", "two", "mine", "class", "code", "copies")}
                x = unit(matrix(batch.column("embedding")[i].values))
                code, names, copies = np.array(row["code"], dtype=np.int64).view(np.uint64), np.array(row["class"]), np.array(row["copies"])
                a, b = sides(row["mine"], row["one"], row["two"])
                near = meets(code[a], code[b], row["table"], row["key"], width, radius)
                near &= x[a] @ x[b].T >= least
                same = row["one"] == row["two"]
                if same:
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                counts = np.zeros(len(names), dtype=np.int64)
                counts[a] += (near * copies[b][None, :]).sum(axis=1)
                if not same:
                    counts[b] += (near * copies[a][:, None]).sum(axis=0)
                out += [(int(names[j]), None, int(counts[j])) for j in np.flatnonzero(counts)]
                whole = np.zeros((len(names), len(names)), dtype=bool)
                whole[np.ix_(a, b)] = near
                whole |= whole.T
                np.fill_diagonal(whole, True)
                root = np.arange(len(names))
                while True:
                    lower = np.where(whole, root[None, :], len(names)).min(axis=1)
                    if (lower == root).all():
                        break
                    root = lower
                out += [(int(names[j]), int(names[r]), 0) for j, r in enumerate(root.tolist()) if j != r]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b", "copies"])

    return meetings(rows, "class", "code", "copies", "embedding").mapInArrow(run, "a bigint, b bigint, copies bigint")


def near_vectors(vectors: DataFrame, least: float = 0.95, tables: int = TABLES, radius: int = RADIUS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding).

    Rows whose embedding is null, empty or zero, or holds null or non-finite components, or has another number of components than most
    rows, link with nothing: n_links 0, component_id their own id, kept. Equal embeddings are one class with copies, linked with
    each other and alike with the rest; ids may repeat or be null (the smallest id that isn't null names a component).
    """
    width = BITS // tables
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding")
    good = rows.where(usable(F.col("embedding")))
    length = common_length(good)
    good = good.where(F.size("embedding") == length)
    if length == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    coder = spark.sparkContext.broadcast(learn(sample(good, sample_rows)))
    grouped = stored(
        good.groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")).withColumn("class", F.monotonically_increasing_id())
    )

    def run(batches):
        for batch in batches:
            code = coder.value(unit(matrix(batch.column(0)))) if batch.num_rows else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.view(np.int64))], names=[*batch.schema.names, "code"])

    schema = grouped.withColumn("code", F.lit(0).cast("long")).schema
    classes = stored(grouped.mapInArrow(run, schema))
    hits = stored(promising(classes.select("class", "code"), tables, width, radius))
    found = stored(verified(classes.select("class", "code", "copies", "embedding"), hits, least, width, radius))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("of")).agg(F.sum("copies").alias("linked"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    rooted = (
        classes.select("embedding", "copies", "least", "class").join(counts, F.col("class") == F.col("of"), "left")
        .join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
        .select("embedding", "least", "root", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    rooted = stored(rooted)
    smallest = rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, F.col("root") == F.col("of")).select(F.col("embedding").alias("e"), "n_links", "component_id")
    together = rows.join(named, F.col("embedding") == F.col("e"), "left")
    component = F.coalesce("component_id", "vec_id")
    return together.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
