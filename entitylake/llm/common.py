"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than blank and the controls 9 to 13, in every operator here.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one given table; whatever other columns it has are left out of the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def content_key(name: str, text: str) -> list[Column]:
    """Columns that tell rows apart by id and content, so that neither must be unique or non-null.

    Rows that agree in both are copies of one another in everything an operator here computes.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return [F.col(name).alias("id"), F.unhex(F.substring(digest, 1, 32)).alias("digest")]


def fold_part(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`: the split into learning and held-out rows."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores behind it as it needs to be free."""
    out = []
    for name in wanted:
        while name.lower() in {x.lower() for x in taken}:
            name += "_"
        out.append(name)
    return out


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """`rows` different rows, or all if there are fewer, the same in every run: those with the smallest hash of the whole row.

    Copies count once, so a table of few different rows gives all of them, and only an empty one gives none. The share is
    cut first where the rows are, so tasks send on little more than is kept.
    """
    df = df.distinct()
    total = df.count()
    if total <= rows:
        return df
    place = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31))
    share = (rows + 8 * rows**0.5 + 8) / total  # more than `rows` of them, but for a chance of nothing
    return df.where(place < int((1 << 31) * min(1.0, share))).orderBy(F.xxhash64(*df.columns), *df.columns).limit(rows)
