"""Readers and writers."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import held
from ..functions.text import decode_json_list

LIST_COLUMNS = ("services", "technologies", "founders", "emails", "locations", "phones")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that is too small to have a full split per core.

    For plain scans. Extraction costs far more than reading, and a file of one row group is one
    task. Inputs with a split per core, so all large ones, are left alone and never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int = 5_000) -> DataFrame:
    """Give each task about `rows` rows at most, for a plain scan of a narrow table of which every row becomes much work.

    Splits are cut by bytes, so some MB of keys are one task, whatever they stand for. Only the narrow rows are shuffled; parquet
    tells their number without a scan. Spark moves filters below a repartition, and with them the work their columns stand for,
    back into the one task that scans; it does not move them below rows that come out of an array.
    """
    tasks = ceil(df.count() / rows)
    if df.rdd.getNumPartitions() >= tasks:
        return df
    return held(df.repartition(tasks))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Captured pages with content; a failed fetch has no html and is left out."""
    return read_table(spark, folder, "pages").filter(F.col("html") != "")


def decode_lists(entities: DataFrame, columns=LIST_COLUMNS) -> DataFrame:
    """JSON-text list columns as arrays; null and broken text give an empty array."""
    for name in columns:
        if name in entities.columns:
            entities = entities.withColumn(name, decode_json_list(F.col(name)))
    return entities


def find_by_key(table: DataFrame, key: str, values) -> DataFrame:
    """Point lookup; the filter reaches the parquet scan."""
    return table.filter(F.col(key).isin(values if isinstance(values, (list, tuple)) else [values]))


def csv_lines(rows: DataFrame) -> DataFrame:
    """Export text: a plain header line, then every value quoted with quotes doubled."""
    quoted = [
        F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
        for c in rows.columns
    ]
    line = F.concat_ws(",", *quoted)
    numbered = rows.coalesce(1).select(F.monotonically_increasing_id().alias("n"), line.alias("line"))
    header = F.lit(",".join(rows.columns))
    both = F.when(F.col("n") == 0, F.array(header, F.col("line"))).otherwise(F.array("line"))
    return numbered.select(F.explode(both).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    """One file in row order, written by one task: an export has the limited number of rows its caller asked for."""
    csv_lines(rows).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)
