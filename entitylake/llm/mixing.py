"""Mixing sources to target weights: hash-random order, distributed prefix sums, one exact cut a source.

Every row gets a key that is random but the same in every run. A source is ordered by that key in
ranges of about `rows_per_range` rows, whose word sums are added up over the ranges; only the one
range that holds the source's budget is ordered row by row. The cut is then a single key per source,
so the wide rows are never shuffled by it. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import word_count

WEIGHTS = (3, 1, 2)


def random_key(doc_id: Column, text: Column) -> Column:
    """32 hexadecimal digits; equal only for rows with the same id and text."""
    name = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", name, F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets per source from (source, source_size).

    Sources by code point, null last, weigh as `weights` in turn and share `share` of all words. No target
    is above `most` times its source; the excess goes to the others by weight. Ordered by the level at
    which a source is full, the full ones come first, so one running sum finds them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", "place")
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("full", F.col("source_size") * F.lit(float(most)))
        .withColumn("level", F.col("full") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("rate", F.col("left") / F.sum("weight").over(onward))
        .withColumn("is_full", F.col("level") <= F.col("rate"))
        .withColumn("shared", F.max(F.when(~F.col("is_full"), F.col("rate"))).over(everything))
    )
    return ranked.select(
        "source", "source_size", F.when(F.col("is_full"), F.col("full")).otherwise(F.col("weight") * F.col("shared")).alias("target")
    )


def source_cuts(rows: DataFrame, rows_per_range: int = 2_000, **targets) -> DataFrame:
    """Per source: source_size, target, whole `epochs`, and where the last epoch ends.

    `rows` has (source, size, key). Rows below `cut_key` are taken once more than `epochs`, rows at it give
    `cut_words` more words each (several rows only if they are identical), rows above it none.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    plan = (
        source_targets(sizes.select("source", "source_size"), **targets)
        .join(sizes.select(F.col("source").alias("s"), "n_rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("budget", F.floor(F.col("target") + 0.5))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("n_ranges", F.ceil(F.col("n_rows") / F.lit(rows_per_range)))
    )
    plan = stored(plan)
    cut = plan.select(F.col("source").alias("of"), "n_ranges", "rest")
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranged = rows.join(cut, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "range", F.floor(head * F.col("n_ranges") / F.lit(2**32))
    )
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    so_far = Window.partitionBy("source").orderBy("range")
    holds = (
        sums.withColumn("before", F.sum("words").over(so_far) - F.col("words"))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select(F.col("source").alias("h_source"), F.col("range").alias("h_range"), "before")
    )
    inside = ranged.join(holds, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("range") == F.col("h_range")))
    same = inside.groupBy("source", "key").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("copies"), F.first("rest").alias("rest"), F.first("before").alias("before")
    )
    at = (
        same.withColumn("before", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("key")) - F.col("words"))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select(F.col("source").alias("of"), F.col("key").alias("cut_key"), F.floor((F.col("rest") - F.col("before")) / F.col("copies")).alias("cut_words"))
    )
    return plan.join(at, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source", "source_size", "target", "epochs", F.coalesce("cut_key", F.lit("")).alias("cut_key"), F.coalesce("cut_words", F.lit(0)).alias("cut_words")
    )


def keyed(docs: DataFrame) -> DataFrame:
    """(row, source, size, key): the whole row in one struct, so its column names cannot clash."""
    return docs.select(
        F.struct("*").alias("row"), F.col("source"), word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text")).alias("key")
    )


def with_taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds source_size, target and taken (words the mix takes of a row, repeats counted)."""
    cuts = cuts.withColumnRenamed("source", "of")
    more = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.col("cut_words")).otherwise(0)
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "taken", (F.col("epochs") * F.col("size") + more).cast("long")
    )


def mix_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs` (doc_id, text, source).

    Null text and text without words have size 0 and take 0. A null source is a source of its own, the
    last. Identical rows at the cut share its words evenly. An empty table gives no rows.
    """
    rows = stored(keyed(docs.select("doc_id", "text", "source")).select(F.col("row.doc_id").alias("doc_id"), "source", "size", "key"))
    cuts = stored(source_cuts(rows, **options))
    return with_taken(rows, cuts).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves, with the columns of `docs`.

    A row comes as often as the mix takes it whole; at the cut it comes once more with as many of its first
    words, joined by one blank. Rows of which nothing is taken go, rows without words among them.
    n_chars, where `docs` has it, counts the characters of the text that stays.
    """
    rows = keyed(docs)
    cuts = stored(source_cuts(stored(rows.select("source", "size", "key")), **options))
    taken = with_taken(rows, cuts).where(F.col("taken") > 0)
    part = F.col("taken") % F.col("size")
    pieces = F.concat(
        F.array_repeat(F.lit(None).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int")),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")),
    )
    whole = F.col("row.text")
    words = F.regexp_extract_all(whole, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    each = taken.select("row", F.explode(pieces).alias("words")).withColumn(
        "text", F.when(F.col("words").isNull(), whole).otherwise(F.array_join(F.slice(words, 1, F.col("words").cast("int")), " "))
    )
    out = []
    for name in docs.columns:
        if name == "text":
            out.append(F.col("text"))
        elif name == "n_chars":
            out.append(F.length("text").cast(docs.schema[name].dataType).alias(name))
        else:
            out.append(F.col("row")[name].alias(name))
    return each.select(*out)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))) AS key
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most
  FROM named),
levels AS (
  SELECT *, most / weight AS level,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN level <= rate THEN most ELSE weight * max(CASE WHEN level > rate THEN rate END) OVER () END AS target
  FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
ordered AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, floor(b.target + 0.5)::BIGINT - b.epochs * b.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         - sum(s.size) OVER (PARTITION BY s.source, s.key) AS before,
         count(*) OVER (PARTITION BY s.source, s.key) AS copies
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, floor((rest - before) / copies))))::BIGINT AS taken
FROM ordered
"""
