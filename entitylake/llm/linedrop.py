"""Line dedup by levelled sorted runs of line hashes.

A run is a table of (h1, h2, n): the 128-bit hash of a line and the number of documents it was found in, dealt into buckets and
sorted there. Every batch of documents counts its own lines, leaves out by a merge anti-join with the runs those that are
already settled (found often enough), and adds the rest as a new run of level 0. Two runs of one level are merged into one of
the next, so there are never more runs than the logarithm of the batches. All runs share their buckets: joins and merges of
runs need no shuffle.

Settled lines then find their documents: the few that make up a noticeable share of all lines go to every task (by counting there
cannot be more than SHARE * batches of them), the others meet the documents' lines in a shuffle.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, file_system, release, stored
from .common import free_names

LEAST_DOCS, LEAST_CHARS, BATCHES = 10, 1, 4
#: Line hashes of a bucket, about; decides only how many buckets there are.
BUCKET_ROWS = 2_000_000
#: A line is frequent where it makes up more than one in SHARE of the lines.
SHARE = 1000
BLANK = b" \t\n\x0b\x0c\r"

RUN = "h1 long, h2 long, n long"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # of bytes: A-Z only


def line_hashes(text: bytes, least_chars: int) -> list[bytes]:
    """The hash of every line, None for those whose key is too short to count."""
    from xxhash import xxh3_128_digest

    keys = map(line_key, text.split(b"\n"))
    return [xxh3_128_digest(k) if len(k) >= least_chars and (len(k) >= 4 * least_chars or len(k.decode()) >= least_chars) else None for k in keys]


def row_key(doc_id: str, text: str) -> list[Column]:
    """128 bits that rows of one id and text share; such rows have the same lines dropped."""
    of = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(doc_id).isNull(), F.coalesce(F.col(text), F.lit(""))]
    return [F.xxhash64(*of).alias("r1"), F.xxhash64(F.lit(1), *of).alias("r2")]


def hashed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(r1, r2, lines) of docs (doc_id, text): the hashes of the different lines of a row, each once."""
    rows = docs.select(*row_key("doc_id", "text"), F.col("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                found = [sorted({h for h in line_hashes((x or "").encode(), least_chars) if h}) for x in some.column(2).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64))).astype(np.int32)
                both = np.frombuffer(b"".join(h for x in found for h in x), dtype="<i8").reshape(-1, 2)
                hashes = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["h1", "h2"])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.ListArray.from_arrays(pa.array(offsets), hashes)], names=["r1", "r2", "lines"])

    return rows.mapInArrow(run, "r1 long, r2 long, lines array<struct<h1: long, h2: long>>")


class LineRuns:
    """The runs of one job. `add` takes the lines of a batch, `settled` gives those found in `least` documents or more.

    A settled line's n is a lower bound, as later batches leave it out; that of every other line is exact.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCS, buckets: int = 8):
        self.spark, self.least, self.buckets = spark, least, buckets
        self.folder = f"{checkpoint_root(spark)}/runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        target, system = file_system(self.spark, f"{self.folder}/{name}")
        system.delete(target, True)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """One batch: rows (h1, h2), one for every document that holds the line."""
        own = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).repartition(self.buckets, "h1", "h2")
        for name in self.runs():
            own = own.join(self.spark.table(name).where(F.col("n") >= self.least).select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._write(own, 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) > 1:
                self._compact(self.levels[level], level + 1)

    def _compact(self, names: list[str], level: int) -> None:
        """Two sorted runs become one of the next level."""
        one, two = names
        other = self.spark.table(two).select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("n").alias("more"))
        both = self.spark.table(one).join(other, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")), "full")
        total = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
        self._write(both.select(F.coalesce("h1", "o1").alias("h1"), F.coalesce("h2", "o2").alias("h2"), total.alias("n")), level)
        for name in (one, two):
            names.remove(name)
            self._drop(name)

    def settled(self) -> DataFrame:
        """(h1, h2, n) of all lines found in `least` documents or more, written, after the last merges."""
        while len(self.runs()) > 1:
            names = self.runs()[:2]
            level = max(i for i, level in enumerate(self.levels) if set(names) & set(level)) + 1
            self.levels = [[n for n in level if n not in names] for level in self.levels]
            self._compact(names, level)
        if not self.runs():
            return self.spark.createDataFrame([], RUN)
        return stored(self.spark.table(self.runs()[0]).where(F.col("n") >= self.least))

    def close(self) -> None:
        for name in self.runs():
            self._drop(name)
        self.levels = []


def lines_to_drop(docs: DataFrame, least: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """(r1, r2, gone): for every different row of docs (doc_id, text) that has any, the hashes of its lines to drop."""
    spark = docs.sparkSession
    part = F.pmod(F.col("r1"), F.lit(batches)).cast("int")
    rows = stored(hashed_lines(docs, least_chars))
    total = rows.agg(F.sum(F.size("lines"))).first()[0] or 0
    runs = LineRuns(spark, least, max(8, math.ceil(total / BUCKET_ROWS)))
    for batch in range(batches):
        runs.add(rows.where(part == batch).select(F.inline("lines")))
    settled = runs.settled()
    runs.close()
    hot = F.col("n") * (SHARE * batches) >= total
    few = settled.where(hot).select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.lit(True).alias("often"))
    places = rows.select("r1", "r2", F.inline("lines")).join(F.broadcast(few), (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")), "left")
    often = places.where("often").select("r1", "r2", "h1", "h2")
    seldom = places.where("often IS NULL").select("r1", "r2", "h1", "h2").join(settled.where(~hot).select("h1", "h2"), ["h1", "h2"], "left_semi")
    gone = often.unionByName(seldom).groupBy("r1", "r2").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    return gone


def with_kept_lines(docs: DataFrame, least: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """`docs` (doc_id, text, ...) with (n_lines, n_dropped, kept) under free names behind its own columns.

    A row is a document, repeated rows included: a line counts once per row. Null and empty texts are one empty line, which
    stays. Keys shorter than `least_chars` code points never go. All copies of a line go, wherever they stand. An empty
    table gives no rows. `kept` is never null.
    """
    r1, r2, m1, m2, gone, *made = free_names(docs.columns, "r1", "r2", "m1", "m2", "gone", "n_lines", "n_dropped", "kept")
    marked = lines_to_drop(docs.select("doc_id", "text"), least, least_chars, batches).toDF(m1, m2, gone)
    keys = [k.alias(n) for k, n in zip(row_key("doc_id", "text"), (r1, r2))]
    keyed = docs.select("*", *keys)
    # A row that is a copy of many others meets its marks in one of several tasks only where adaptive execution splits the task.
    rows = keyed.join(marked, (F.col(r1) == F.col(m1)) & (F.col(r2) == F.col(m2)), "left").drop(m1, m2, r1, r2)
    schema = docs.withColumns({made[0]: F.lit(0).cast("long"), made[1]: F.lit(0).cast("long"), made[2]: F.lit("")}).schema
    text_at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts, lists = some.column(text_at).to_pylist(), some.column(width)
                out = [drop_lines((t or "").encode(), packed(lists, i), least_chars) for i, t in enumerate(texts)]
                n_lines, n_dropped, kept = zip(*out)
                arrays = [some.column(i) for i in range(width)] + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array([k.decode() for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def packed(lists: pa.ListArray, i: int) -> set[bytes]:
    if not lists[i].is_valid:
        return set()
    values = lists[i].values
    both = np.stack([values.field(0).to_numpy(), values.field(1).to_numpy()], axis=1).astype("<i8")
    return {row.tobytes() for row in both}


def drop_lines(text: bytes, gone: set[bytes], least_chars: int) -> tuple[int, int, bytes]:
    """Number of lines, number dropped, and the kept ones joined."""
    if not gone:
        return text.count(b"\n") + 1, 0, text
    lines, hashes = text.split(b"\n"), line_hashes(text, least_chars)
    kept = [line for line, h in zip(lines, hashes) if h not in gone]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def without_common_lines(docs: DataFrame, least: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """`docs` with its columns, common lines taken out of `text`; null texts stay null."""
    made = with_kept_lines(docs, least, least_chars, batches)
    kept = made.columns[-1]
    return made.withColumn("text", F.when(F.col("text").isNotNull(), F.col(kept))).select(*docs.columns)


def line_digests(docs: DataFrame, least: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per row of docs; see with_kept_lines for nulls, ties and repeated rows."""
    made = with_kept_lines(docs.select("doc_id", "text"), least, least_chars, batches)
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS MATERIALIZED (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM rows),
keyed AS MATERIALIZED (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c ON c.k = keyed.k GROUP BY r, doc_id
"""
