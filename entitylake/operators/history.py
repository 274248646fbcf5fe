"""Upserts, snapshots and field changes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import exploded
from .ordering import HOT_KEY_ROWS, previous_per_key
from .scoring import as_of_literal

TRACKED = ("name", "description", "services", "linkedin", "emails", "category")


def snapshot_hash(tracked: Sequence[str] = TRACKED) -> Column:
    """MD5 of the tracked columns as JSON, nulls written out."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in tracked]), {"ignoreNullFields": "false"}))


def versions_with_previous(
    versions: DataFrame, order: Sequence[str], tracked: Sequence[str] = TRACKED, key: str = "domain",
    hot_rows: int = HOT_KEY_ROWS, also: Sequence[str] = (),
) -> DataFrame:
    """Versions with hash and `previous`: tracked columns, hash and the columns `also` of the version before, null for the first."""
    hashed = versions.withColumn("hash", snapshot_hash(tracked))
    return previous_per_key(
        hashed, [key], [F.col(c) for c in order], [*tracked, "hash", *also], "previous", hot_rows
    )


def entity_changes(
    versions: DataFrame, order: Sequence[str], tracked: Sequence[str] = TRACKED, key: str = "domain",
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """One row per changed field between a version and the one before: key, order columns, field,
    old_value, new_value, change_type. Equal hashes stop before any field is looked at."""
    return changed_fields(moved_versions(versions, order, tracked, key, hot_rows), order, tracked, key)


def moved_versions(
    versions: DataFrame, order: Sequence[str], tracked: Sequence[str] = TRACKED, key: str = "domain",
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Versions with hash and `previous`: the first of an entity and those that differ from the one before."""
    return only_moved(versions_with_previous(versions, order, tracked, key, hot_rows))


def only_moved(ordered: DataFrame) -> DataFrame:
    """The moved_versions of versions_with_previous."""
    return ordered.filter(F.col("previous").isNull() | (F.col("hash") != F.col("previous.hash")))


def changed_fields(moved: DataFrame, order: Sequence[str], tracked: Sequence[str] = TRACKED, key: str = "domain") -> DataFrame:
    """The entity_changes of moved_versions."""
    pairs = moved.filter(F.col("previous").isNotNull())
    types = dict(moved.dtypes)

    def as_text(col: str) -> Column:
        value = F.col(col)
        plain = types[col.split(".")[-1]]
        return value.cast("string") if not plain.startswith(("array", "struct", "map")) else F.to_json(value)

    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                as_text(f"previous.{name}").alias("old_value"),
                as_text(name).alias("new_value"),
            )
            for name in tracked
        ]
    )
    return (
        exploded(pairs, [key, *order], cells, "c")
        .select(key, *order, "c.*")
        .filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
        .withColumn(
            "change_type",
            F.when(F.col("old_value").isNull(), "added")
            .when(F.col("new_value").isNull(), "removed")
            .otherwise("modified"),
        )
    )


def entity_snapshots(
    versions: DataFrame, order: Sequence[str], tracked: Sequence[str] = TRACKED, key: str = "domain",
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Versions worth storing: the first of an entity and those that differ from the one before."""
    return moved_versions(versions, order, tracked, key, hot_rows).drop("previous")


def change_counts(changes: DataFrame, key: str = "domain") -> DataFrame:
    return changes.groupBy(key).agg(F.count(F.lit(1)).alias("recent_changes"))


def merge_entities(current: DataFrame, incoming: DataFrame, as_of: datetime) -> DataFrame:
    """Upsert on domain. A known entity gets all data columns, last_seen and is_valid = true, and
    keeps its id and first_seen; a new one is first seen now. One row per domain on either side.
    """
    now = as_of_literal(as_of)
    kept = {"entity_id", "first_seen"}
    stamps = {"last_seen": now, "is_valid": F.lit(True)}
    c, i = current.alias("c"), incoming.alias("i")
    hit = F.col("i.domain").isNotNull()
    columns = []
    for name in current.columns:
        old = F.col(f"c.{name}")
        if name in stamps:
            value = F.when(hit, stamps[name]).otherwise(old)
        elif name == "first_seen":
            value = F.coalesce(old, now)
        elif name in kept:
            value = F.coalesce(old, F.col(f"i.{name}")) if name in incoming.columns else old
        elif name in incoming.columns:
            value = F.when(hit, F.col(f"i.{name}")).otherwise(old)
        else:
            value = old
        columns.append(value.alias(name))
    return c.join(i, F.col("c.domain") == F.col("i.domain"), "full_outer").select(*columns)


def merge_links(links: DataFrame, order: Sequence[str]) -> DataFrame:
    """Upsert log (query_id, entity_id, score, is_new, ...) -> one row per pair: is_new of the first
    write, score of the last."""
    at = F.struct(*order)
    return links.groupBy("query_id", "entity_id").agg(
        F.max_by("score", at).alias("score"), F.min_by("is_new", at).alias("is_new")
    )


def validation_audit(saved: DataFrame, as_of: datetime) -> DataFrame:
    """Audit rows to append for saved entities."""
    return saved.select(
        "entity_id",
        F.lit("full").alias("validation_type"),
        F.lit(True).alias("passed"),
        F.col("confidence").alias("score"),
        F.lit("Passed validation").alias("reason"),
        as_of_literal(as_of).alias("created_at"),
    )
