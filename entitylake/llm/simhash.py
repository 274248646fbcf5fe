"""Near-duplicates by SimHash fingerprints and pigeonhole blocks.

64 bits are split into blocks; fingerprints at `distance` or fewer differing bits differ in at most that many blocks, so with
`blocks` blocks they agree in some choice of blocks - distance of them. Every choice is a table: equal fingerprints are one
class, classes that agree in a choice meet in a bucket, and the Hamming distance is verified there. Buckets are cut into
chunks that meet pairwise, so no task holds a large bucket, and each meeting gives a spanning forest of its links at most,
never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import content_key
from .components import components

DISTANCE, BLOCKS, SHINGLE, SEED = 4, 7, 4, 42
#: Classes of a bucket that one task compares with as many others.
CHUNK = 256


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and blanks are 32 and 9 to 13
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1)[: max(1, len(words) - shingle + 1)]
    ends = ends[min(shingle, len(words)) - 1 :] - 1
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 8192):
        hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[at : at + 8192].tolist(), ends[at : at + 8192].tolist())], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, digest of the content, fp (64 bits as a long). Null text has no words, so fingerprint 0."""
    rows = docs.select(*content_key(doc_id, text), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    schema = rows.select("id", "digest").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                made = np.array([fingerprint(x or b"") for x in some.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(made)], names=["id", "digest", "fp"])

    return rows.mapInArrow(run, schema)


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """One mask for each choice of blocks - distance blocks, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    made = [sum(choice) for choice in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def bucket_links(members: list, chunks: list, choice: int, all_masks: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Star links of the components in one meeting; a pair counts in the first choice in which it agrees."""
    fp = np.array(members, dtype=np.int64)
    differ = fp[:, None] ^ fp[None, :]
    near = np.bitwise_count(differ.view(np.uint64)) <= distance
    for mask in all_masks[:choice]:
        near &= (differ & mask) != 0
    side = np.array(chunks)
    if len(set(chunks)) > 1:
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, True)
    if near.sum() == len(fp):
        return []
    root = np.arange(len(fp))
    while True:
        least = np.where(near, root[None, :], len(fp)).min(axis=1)
        if (least == root).all():
            break
        root = least
    return [(int(fp[i]), int(fp[r])) for i, r in enumerate(root.tolist()) if i != r]


def class_links(classes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between fingerprints (distinct longs in `fp`) whose components are those of all links in distance.

    Every fingerprint is posted once for each choice of blocks, but Spark takes what comes out of the array for no larger than the
    fingerprints, so a hint keeps it from being broadcast.
    """
    all_masks = masks(blocks, distance)
    choice = F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(all_masks)]))
    posted = classes.select("fp", choice.alias("x")).select("x.choice", "x.key", "fp")
    busy = posted.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").toDF("of_choice", "of_key", "members")
    met = posted.hint("merge").join(busy, (F.col("choice") == F.col("of_choice")) & (F.col("key") == F.col("of_key"))).drop("of_choice", "of_key")
    parts = F.ceil(F.col("members") / F.lit(chunk)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts.cast("long")).cast("int")
    meetings = (
        met.withColumn("parts", parts).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .groupBy("choice", "key", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))
        .agg(F.collect_list("fp").alias("members"), F.collect_list("mine").alias("chunks"))
    )
    given = np.array(all_masks, dtype=np.int64)

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            links = [x for c, m, k in zip(rows["choice"], rows["members"], rows["chunks"]) if len(m) > 1 for x in bucket_links(m, k, c, given, distance)]
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return meetings.select("choice", "members", "chunks").mapInArrow(run, "a bigint, b bigint")


def near_groups(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """Rows (id, digest, fp) and groups (of_fp, component_id): fingerprint and the smallest id reachable from it.

    Tables with a row per document or fingerprint are merged here and below, never broadcast.
    """
    rows = stored(fingerprints(docs))
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(class_links(classes.select("fp"), distance, blocks))
    rooted = classes.hint("merge").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    groups = rooted.hint("merge").join(smallest, F.col("root") == F.col("of")).select(F.col("fp").alias("of_fp"), "component_id", F.col("root").alias("group"))
    return rows, stored(groups)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of `docs` (doc_id, text).

    Null and empty texts have fingerprint 0 and are linked like any other. component_id is the smallest id of the group;
    it is null only where no row of the group has an id. Repeated rows stay. An empty table gives no rows.
    """
    rows, groups = near_groups(docs, distance, blocks)
    return rows.hint("merge").join(groups, F.col("fp") == F.col("of_fp")).select(F.col("id").alias("doc_id"), hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """`docs` with its columns, one row of each group: the one with the smallest id, then the smallest digest.

    Rows without a word all have fingerprint 0, so one of them stays. Null ids come last. Identical rows come once.
    """
    rows, groups = near_groups(docs.select("doc_id", "text"), distance, blocks)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")
    chosen = (
        rows.hint("merge").join(groups, F.col("fp") == F.col("of_fp")).groupBy("group").agg(F.min(order).alias("one"))
        .select(F.col("one.id").alias("of_id"), F.col("one.digest").alias("of_digest"))
    )
    copies = rows.groupBy(F.col("id").alias("c_id"), F.col("digest").alias("c_digest")).agg(F.count(F.lit(1)).alias("copies"))
    chosen = stored(
        chosen.hint("merge").join(copies, F.col("of_id").eqNullSafe(F.col("c_id")) & (F.col("of_digest") == F.col("c_digest"))).select("of_id", "of_digest", "copies")
    )
    whole = docs.select(F.struct("*").alias("row"), *content_key("doc_id", "text"))
    kept = whole.hint("merge").join(chosen, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")))
    place = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.to_json("row")))
    many = kept.where("copies > 1").withColumn("place", place).where("place = 1").drop("place")
    return kept.where("copies = 1").union(many).select(*(F.col("row")[name].alias(name) for name in docs.columns))
