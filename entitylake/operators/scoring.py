"""Confidence, relevance, verdict and rank of entities.

Entity columns: name, domain, description, services, technologies, linkedin, emails, locations,
category, meta_title, meta_description. Query columns: q_intent, q_industry, q_keywords, q_location.
All scores are doubles summed in a fixed order, because the bands compare against exact limits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import bind, count_hits, string_array, terms_found
from ..rules import domain_lists, validation_rules as rules
from .ordering import HOT_KEY_ROWS, rank_per_key


def filled(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0)) > 0


def _points(condition: Column, weight: float) -> Column:
    return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))


def confidence_score() -> Column:
    # Weights.
    score = _points(F.length("name") > 2, 0.15)
    score = score + _points(F.col("domain").contains("."), 0.15)
    score = score + _points(F.length("description") > 50, 0.15)
    score = score + _points(filled(F.col("services")), 0.15)
    score = score + _points(filled(F.col("technologies")), 0.10)
    score = score + _points(F.col("linkedin") != "", 0.10)
    score = score + _points(filled(F.col("emails")), 0.10)
    score = score + _points(filled(F.col("locations")), 0.10)
    return F.least(F.lit(1.0), score)


def confidence_band(score: Column) -> Column:
    return (
        F.when(score >= rules.CONFIDENCE_HIGH, "high")
        .when(score >= rules.CONFIDENCE_MEDIUM, "medium")
        .when(score >= rules.CONFIDENCE_LOW, "low")
        .otherwise("very_low")
    )


def _entity_text() -> Column:
    def or_empty(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    services = F.coalesce(F.array_join("services", " "), F.lit(""))
    parts = [or_empty("name"), or_empty("description"), or_empty("category"), services,
             or_empty("meta_title"), or_empty("meta_description")]
    return F.lower(F.concat_ws(" ", *parts))


def relevance_score() -> Column:
    """Industry, keyword and location overlap of entity and query, plus the agency adjustment."""
    return _relevance(_entity_text(), _phrases(rules.AGENCY_PHRASES), _phrases(rules.TOOL_PHRASES))


def _phrases(phrases: Sequence[str]) -> Callable[[Column], Column]:
    return lambda text: F.size(F.filter(string_array(phrases), lambda p: text.contains(p)))


def _relevance(entity_text: Column, agency: Callable[[Column], Column], tool: Callable[[Column], Column]) -> Column:

    def score(text: Column) -> Column:
        slug = F.replace("q_industry", F.lit("_"), F.lit(" "))
        words = F.split(slug, " ")
        hits = F.size(F.filter(words, lambda w: text.contains(w)))
        category = F.regexp_replace(F.lower("category"), r"\s+", " ")
        same = category.contains(F.get(words, F.lit(0))) | slug.contains(F.substring_index(category, " ", 1))
        total = F.when(
            F.col("q_industry").isNotNull(),
            (hits.cast("double") / F.size(words)) * F.lit(0.35)
            + _points((F.col("category") != "") & same, 0.35),
        ).otherwise(F.lit(0.3))

        operators = string_array(rules.OPERATOR_WORDS)
        topical = F.filter("q_keywords", lambda k: ~F.array_contains(operators, k) & (F.length(k) > 2))
        total = total + bind(
            topical,
            lambda ks: F.when(
                F.size(ks) > 0,
                (F.size(F.filter(ks, lambda k: text.contains(k))).cast("double") / F.size(ks)) * F.lit(0.3),
            ).otherwise(F.lit(0.2)),
        )
        total = total + F.when(F.col("q_location").isNull(), F.lit(0.1)).otherwise(
            _points(text.contains(F.lower("q_location")), 0.15)
        )
        boost = bind(agency(text), lambda n: F.when(n >= 2, 0.15).when(n >= 1, 0.07).otherwise(0.0))
        malus = bind(tool(text), lambda n: F.when(n >= 3, 0.35).when(n >= 2, 0.2).when(n >= 1, 0.05).otherwise(0.0))
        adjusted = F.col("q_intent").isin(rules.SERVICE_INTENTS)
        return bind(total, lambda t: F.when(adjusted, t + boost - malus).otherwise(t))

    return F.least(F.lit(1.0), F.greatest(F.lit(0.05), bind(entity_text, score)))


def with_entity_signals(entities: DataFrame) -> DataFrame:
    """What scoring and verdict need of the entity alone: confidence, spam, tool_signals,
    agency_signals. Adding them before entities are paired with queries runs the patterns once per
    entity, not once per pair. Entities with a category of their own get the text that queries are held against, too:
    entity_text, agency_phrases, tool_phrases."""
    described = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")))
    if "category" in entities.columns:
        entities = entities.withColumn("entity_text", _entity_text()).withColumns({
            "agency_phrases": _phrases(rules.AGENCY_PHRASES)(F.col("entity_text")),
            "tool_phrases": _phrases(rules.TOOL_PHRASES)(F.col("entity_text")),
        })
    return (
        entities.withColumn("confidence", confidence_score())
        .withColumn("spam", spam_terms(described))
        .withColumn("tool_signals", tool_signal_count(signal_text()))
        .withColumn("agency_signals", agency_signal_count(signal_text()))
    )


def score_entities(pairs: DataFrame) -> DataFrame:
    """Adds confidence and relevance; rows without entity signals get them too."""
    if "tool_signals" not in pairs.columns:
        pairs = with_entity_signals(pairs)
    if "entity_text" in pairs.columns:
        known = _relevance(F.col("entity_text"), lambda _: F.col("agency_phrases"), lambda _: F.col("tool_phrases"))
        return pairs.withColumn("relevance", known).drop("entity_text", "agency_phrases", "tool_phrases")
    return pairs.withColumn("relevance", relevance_score())


def spam_terms(text: Column) -> Column:
    return terms_found(F.lower(text), rules.SPAM_TERMS)


def signal_text() -> Column:
    return F.concat_ws(
        " ", *[F.coalesce(F.col(c), F.lit("")) for c in ("description", "meta_description", "meta_title")]
    )


def tool_signal_count(text: Column) -> Column:
    return count_hits(text, rules.TOOL_SIGNALS)


def agency_signal_count(text: Column) -> Column:
    return count_hits(text, rules.AGENCY_SIGNALS)


def validate_entities(
    scored: DataFrame, blocklist: Sequence[str] = tuple(domain_lists.VERDICT_BLOCKLIST)
) -> DataFrame:
    """Adds is_valid, reasons and flags to scored rows."""
    sensitive = F.coalesce(F.col("q_industry").isin(rules.SERVICE_INDUSTRIES), F.lit(False))
    service_query = F.col("q_intent").isin(rules.SERVICE_INTENTS) | (
        (F.col("q_intent") == "competitor_analysis") & sensitive
    )
    signals = F.struct(
        F.coalesce(F.col("domain").isin(list(blocklist)), F.lit(False)).alias("blocked"),
        F.col("spam"),
        (F.coalesce(F.length("name"), F.lit(0)) < 2).alias("no_name"),
        (~F.coalesce(F.col("domain").contains("."), F.lit(False))).alias("bad_domain"),
        sensitive.alias("sensitive"),
        service_query.alias("service_query"),
        F.col("tool_signals").alias("tool"),
        F.col("agency_signals").alias("agency"),
        F.col("confidence"),
        F.col("relevance"),
    )
    verdict = scored.withColumn("_verdict", bind(bind(signals, _findings), _verdict))
    return verdict.select(
        *scored.columns,
        F.col("_verdict.is_valid").alias("is_valid"),
        F.col("_verdict.reasons").alias("reasons"),
        F.col("_verdict.flags").alias("flags"),
    )


def _findings(s: Column) -> Column:
    """Which checks an entity failed, from its signals."""
    clean = ~(s["blocked"] | (F.size(s["spam"]) > 0) | s["no_name"] | s["bad_domain"])
    pure_tool = clean & s["service_query"] & (s["tool"] >= 2) & (s["agency"] == 0)
    return F.struct(
        s.alias("s"),
        clean.alias("clean"),
        pure_tool.alias("pure_tool"),
        (clean & s["service_query"] & ~pure_tool & (s["tool"] >= 3)).alias("strong_tool"),
        (clean & ~s["service_query"] & s["sensitive"] & (s["tool"] >= 3)).alias("soft_tool"),
        (s["confidence"] < rules.CONFIDENCE_MINIMUM).alias("low_confidence"),
        (s["relevance"] < 0.1).alias("low_relevance"),
    )


def _verdict(f: Column) -> Column:
    s, spam = f["s"], f["s"]["spam"]
    valid = f["clean"] & ~f["pure_tool"] & ~f["strong_tool"] & ~f["low_confidence"] & ~f["low_relevance"]
    high = valid & (s["confidence"] >= rules.CONFIDENCE_HIGH) & (s["relevance"] >= 0.7)

    def listed(*entries: tuple[Column, Column | str]) -> Column:
        cells = F.array(*[F.when(c, F.lit(v) if isinstance(v, str) else v) for c, v in entries])
        return F.filter(cells, lambda x: x.isNotNull())

    tools = s["tool"].cast("string")
    # Reason texts and flag labels.
    reasons = listed(
        (s["blocked"], "Review/directory site — not a company entity"),
        (F.size(spam) > 0, F.concat(F.lit("Spam indicators found: "), F.array_join(spam, ", "))),
        (s["no_name"], "Missing company name"),
        (s["bad_domain"], "Invalid domain"),
        (f["pure_tool"], F.concat(F.lit("SaaS tool/platform, not a service agency (tool signals: "), tools, F.lit(")"))),
        (f["strong_tool"], F.concat(F.lit("Self-serve platform detected ("), tools, F.lit(" tool signals override agency signals)"))),
        (f["low_confidence"], "Confidence score too low"),
        (f["low_relevance"], "Not relevant to query"),
        (valid, "Passed all validation checks"),
    )
    flags = listed(
        (s["blocked"], "irrelevant"),
        (F.size(spam) > 0, "spam"),
        (s["no_name"], "incomplete"),
        (s["bad_domain"], "incomplete"),
        (f["pure_tool"] | f["strong_tool"], "tool_not_agency"),
        (f["soft_tool"], "possible_tool_not_agency"),
        (f["low_confidence"], "low_quality"),
        (f["low_relevance"], "irrelevant"),
        (high, "high_confidence"),
        (valid, "verified"),
    )
    return F.struct(valid.alias("is_valid"), reasons.alias("reasons"), flags.alias("flags"))


# --- rank ---------------------------------------------------------------------------------------


def seconds_between(earlier: Column, later: Column) -> Column:
    """Whole seconds between two timestamps without zone; the session zone plays no part."""
    return (later - earlier.cast("timestamp_ntz")).cast("interval second").cast("bigint")


def as_of_literal(as_of: datetime) -> Column:
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def freshness(last_seen: Column, as_of: datetime) -> Column:
    def band(seconds: Column) -> Column:
        # Hours and their freshness.
        chain = F.when(F.lit(False), F.lit(0.0))
        for hours, value in ((1, 1.0), (24, 0.9), (72, 0.7), (168, 0.5), (720, 0.3)):
            chain = chain.when(seconds < hours * 3600, value)
        return chain.otherwise(0.1)

    return bind(seconds_between(last_seen, as_of_literal(as_of)), band)


def is_new(first_seen: Column, as_of: datetime, hours: int = 48) -> Column:
    return seconds_between(first_seen, as_of_literal(as_of)) < hours * 3600


def completeness() -> Column:
    parts = [
        F.col("name").isNotNull(), F.col("description").isNotNull(), filled(F.col("services")),
        filled(F.col("technologies")), F.col("linkedin").isNotNull(), filled(F.col("emails")),
    ]
    total = F.lit(0)
    for part in parts:
        total = total + part.cast("int")
    return total.cast("double") / len(parts)


def rank_score() -> Column:
    # Weights.
    return (
        F.col("confidence") * 0.35
        + F.col("relevance") * 0.30
        + F.col("freshness") * 0.20
        + F.col("completeness") * 0.15
        + F.when(F.col("is_new"), F.lit(0.1)).otherwise(F.lit(0.0))
    )


def with_rank_score(entities: DataFrame, as_of: datetime) -> DataFrame:
    return (
        entities.withColumn("freshness", freshness(F.col("last_seen"), as_of))
        .withColumn("is_new", is_new(F.col("first_seen"), as_of))
        .withColumn("completeness", completeness())
        .withColumn("score", rank_score())
    )


def rank_entities(
    entities: DataFrame, as_of: datetime, by: Sequence[str] = ("query_id",), tie: Sequence[str] = ("domain",),
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """rank 1..n by score within `by`; ties go by the `tie` columns, which must make rows unique."""
    scored = with_rank_score(entities, as_of)
    return rank_per_key(scored, by, [-F.col("score"), *[F.col(t) for t in tie]], hot_rows=hot_rows)


def filter_by_min_score(ranked: DataFrame, min_score: float) -> DataFrame:
    return ranked.filter(F.col("score") >= min_score)


def rank_by_freshness(ranked: DataFrame, by: Sequence[str] = ("query_id",), hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Adds fresh_pos, 1..n within `by`: the freshest first, equals in the order of their rank."""
    return rank_per_key(ranked, by, [-F.col("freshness"), F.col("rank")], "fresh_pos", hot_rows=hot_rows)


def review_queue(scored: DataFrame) -> DataFrame:
    """Agency searches with middling confidence: rows to be looked at before they are stored."""
    return scored.filter(
        (F.col("q_intent") == "agency_search") & (F.col("confidence") < 0.7) & (F.col("description") != "")
    )
