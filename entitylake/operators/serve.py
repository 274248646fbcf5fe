"""Listing, drill-down, statistics and export frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import exploded
from ..functions.text import decode_json_list, words_of
from .ordering import top_k_per_key
from .scoring import confidence_band

# Fields a listing may be sorted by.
SORT_FIELDS = {
    "name": "name", "domain": "domain", "confidenceScore": "confidence", "relevanceScore": "relevance",
    "lastSeen": "last_seen", "firstSeen": "first_seen", "createdAt": "created_at",
}
EXPORT_LIMIT = 1000


def listing_filter(
    entities: DataFrame, links: DataFrame | None = None, query_id: int | None = None,
    search: str | None = None, min_score: float = 0.0,
) -> DataFrame:
    """Valid entities of at least min_score, of one query, with a text in name, domain or description."""
    kept = entities.filter(F.col("is_valid") & (F.col("confidence") >= min_score))
    if query_id is not None:
        own = links.filter(F.col("query_id") == query_id)
        kept = kept.join(own.select("entity_id"), "entity_id", "left_semi")
    if search:
        word = search.lower()
        kept = kept.filter(
            F.lower("name").contains(word) | F.lower("domain").contains(word)
            | F.coalesce(F.lower("description").contains(word), F.lit(False))
        )
    return kept


def entity_listing(
    entities: DataFrame, links: DataFrame | None = None, query_id: int | None = None, search: str | None = None,
    min_score: float = 0.0, sort: str = "confidenceScore", order: str = "desc", page: int = 1, limit: int = 20,
) -> DataFrame:
    """One page of a listing. An unknown sort field falls back to confidence; ties go by id."""
    field = SORT_FIELDS.get(sort, "confidence")
    field = field if field in entities.columns else "confidence"
    by = F.col(field).asc() if order == "asc" else F.col(field).desc()
    kept = listing_filter(entities, links, query_id, search, min_score)
    if query_id is None:
        kept = kept.withColumn("is_new", F.lit(None).cast("boolean"))
    else:  # before the sort, which a join after it would undo
        flags = links.filter(F.col("query_id") == query_id).select("entity_id", "is_new")
        kept = kept.join(flags, "entity_id", "left")
    return kept.orderBy(by, F.col("entity_id")).offset((page - 1) * limit).limit(limit)


def listing_pagination(kept: DataFrame, page: int = 1, limit: int = 20) -> DataFrame:
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    return total.select(
        "total", F.lit(page).alias("page"), F.lit(limit).alias("limit"),
        F.ceil(F.col("total") / limit).alias("pages"),
    )


def entities_for_query(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Every (query, entity) pair with the per-query is_new, for all queries at once."""
    return links.select("query_id", "entity_id", "is_new", F.col("score").alias("link_score")).join(
        entities.filter("is_valid"), "entity_id"
    )


def query_detail(queries: DataFrame, links: DataFrame, entities: DataFrame, logs: DataFrame) -> DataFrame:
    """All queries with their entities and crawl logs, as rows of kind 'query', 'entity', 'log'.

    Rows instead of nested lists: a query may own any number of entities.
    """
    head = queries.select(
        "query_id", F.lit("query").alias("kind"), F.col("query_id").alias("item_id"), F.col("raw").alias("label"),
        F.lit(None).cast("string").alias("status"),
    )
    linked = links.join(entities, "entity_id").join(queries.select("query_id"), "query_id", "left_semi").select(
        "query_id", F.lit("entity").alias("kind"), F.col("entity_id").alias("item_id"), F.col("domain").alias("label"),
        F.when(F.col("is_new"), "new").otherwise("known").alias("status"),
    )
    logged = logs.join(queries.select("query_id"), "query_id", "left_semi").select(
        "query_id", F.lit("log").alias("kind"), F.col("log_id").alias("item_id"), F.col("url").alias("label"), "status"
    )
    return head.unionByName(linked).unionByName(logged)


def entity_detail(
    entities: DataFrame, snapshots: DataFrame, changes: DataFrame, validations: DataFrame, newest_of: tuple[int, int, int] = (5, 10, 5)
) -> DataFrame:
    """Per entity the newest snapshots, changes and validations (`newest_of` each) as rows (domain, kind, pos).

    snapshots(domain, at, uid, label), changes and validations alike.
    """
    parts = []
    for (kind, rows), k in zip((("snapshot", snapshots), ("change", changes), ("validation", validations)), newest_of):
        newest = top_k_per_key(rows, ["domain"], [F.col("at").desc(), F.col("uid").desc()], k, "pos")
        parts.append(newest.select("domain", F.lit(kind).alias("kind"), "pos", "at", "uid", "label"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.join(entities.select("domain").distinct(), "domain", "left_semi")


def crawl_latest(logs: DataFrame) -> DataFrame:
    """Append log of states -> current state per log id."""
    at = F.struct("updated_at", "event_id")
    return logs.groupBy("log_id").agg(
        F.max_by(F.struct("query_id", "url", "status", "duration", "entities_found", "updated_at"), at).alias("s"),
        F.min("updated_at").alias("created_at"),
    ).select("log_id", "s.*", "created_at")


def recent_logs(latest: DataFrame, query_id: int | None = None, limit: int = 100) -> DataFrame:
    rows = latest if query_id is None else latest.filter(F.col("query_id") == query_id)
    return rows.orderBy(F.col("created_at").desc(), F.col("log_id").desc()).limit(limit)


def recent_queries(queries: DataFrame, limit: int = 50) -> DataFrame:
    return queries.orderBy(F.col("created_at").desc(), F.col("query_id").desc()).limit(limit)


def crawl_stats(logs: DataFrame) -> DataFrame:
    """total, success, failed, pending and the rounded success rate in one pass."""
    counted = logs.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "pending")],
    )
    return counted.withColumn("success_rate", success_rate(F.col("success"), F.col("total")))


def success_rate(success: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(success * 100.0 / total + 0.5).cast("bigint"))


def tier_groups(tiered: DataFrame) -> DataFrame:
    """Counts per query and tier with the display order direct, partial, broader, untiered."""
    tier = F.coalesce("competitor_tier", F.lit("untiered"))
    rank = F.when(tier == "direct", 1).when(tier == "partial", 2).when(tier == "broader", 3).otherwise(4)
    return tiered.groupBy("query_id", tier.alias("tier"), rank.alias("tier_rank")).agg(F.count(F.lit(1)).alias("n"))


def rejection_summary(filtered: DataFrame) -> DataFrame:
    return filtered.groupBy("query_id").agg(
        F.count_if("accepted").alias("accepted"),
        *[
            F.count_if(F.coalesce(F.col("reason_class") == c, F.lit(False))).alias(f"rejected_{c}")
            for c in ("tool", "low_score", "no_match")
        ],
    )


def confidence_bands(entities: DataFrame) -> DataFrame:
    return entities.groupBy(confidence_band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def run_outcome(queries: DataFrame, candidates: DataFrame, saved: DataFrame) -> DataFrame:
    """Per query: saved and new entities, all-known flag, and the outcome of the run.

    queries(query_id, is_rerun), candidates(query_id, n_candidates), saved(query_id, is_new).
    """
    counts = saved.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("saved"),
        F.count_if("is_new").alias("new_entities"),
        F.bool_and(~F.col("is_new")).alias("all_known"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        queries.join(candidates.hint("merge"), "query_id", "left")
        .join(counts.hint("merge"), "query_id", "left")
        .select(
            "query_id",
            F.coalesce("saved", zero).alias("saved"),
            F.coalesce("new_entities", zero).alias("new_entities"),
            F.coalesce("all_known", F.lit(False)).alias("all_known"),
            F.when(F.coalesce("n_candidates", zero) == 0, "unsupported")
            .when(F.col("is_rerun") & (F.coalesce("new_entities", zero) == 0), "no_new_results")
            .otherwise("completed")
            .alias("outcome"),
        )
    )


def key_phrases(docs: DataFrame, key: str, text: str, n: int = 10) -> DataFrame:
    """(key, pos, phrase, uses): the n most used words of more than three letters per document.

    Ties go by first use. Documents are dealt by their key once, as text; counting and choosing then stay in the task.
    """
    words = exploded(docs.repartition(F.col(key)), [key], words_of(F.col(text)), "phrase", "at").filter(F.length("phrase") > 3)
    counted = words.groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("uses"), F.min("at").alias("at"))
    top = top_k_per_key(counted, [key], [F.col("uses").desc(), F.col("at")], n, "pos")
    return top.select(key, "pos", "phrase", "uses")


def _export_source(entities: DataFrame, links: DataFrame | None, query_id: int | None, limit: int) -> DataFrame:
    kept = entities.filter("is_valid")
    if query_id is not None:
        own = links.filter(F.col("query_id") == query_id)
        kept = kept.join(own.select("entity_id"), "entity_id", "left_semi")
    return kept.orderBy(F.col("confidence").desc(), F.col("entity_id")).limit(limit)


def export_csv_rows(
    entities: DataFrame, links: DataFrame | None = None, query_id: int | None = None, limit: int = EXPORT_LIMIT
) -> DataFrame:
    """The first `limit` valid entities by confidence as export text columns."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    def listed(name: str) -> Column:
        return F.coalesce(F.array_join(name, "; "), F.lit(""))

    def stamp(name: str) -> Column:
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    return _export_source(entities, links, query_id, limit).select(
        "name", "domain", text("description").alias("description"), text("category").alias("category"),
        listed("services").alias("services"), listed("technologies").alias("technologies"),
        text("linkedin").alias("linkedin"), listed("emails").alias("emails"),
        F.format_string("%.2f", "confidence").alias("confidenceScore"),
        F.format_string("%.2f", "relevance").alias("relevanceScore"),
        stamp("first_seen").alias("firstSeen"), stamp("last_seen").alias("lastSeen"),
        text("source").alias("source"),
    )


def export_json_rows(
    entities: DataFrame, links: DataFrame | None = None, query_id: int | None = None, limit: int = EXPORT_LIMIT
) -> DataFrame:
    """The same rows with lists kept as lists (phones stay text) and every column.

    founders, where the entities have it as stored JSON text, becomes a list too; text that is no list gives an empty one.
    """
    lists = ("services", "technologies", "emails", "locations")
    out = _export_source(entities, links, query_id, limit)
    if "founders" in out.columns and isinstance(out.schema["founders"].dataType, T.StringType):
        out = out.withColumn("founders", decode_json_list(F.col("founders")))
    for name in lists:
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.withColumn("phones", F.to_json("phones"))
