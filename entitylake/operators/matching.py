"""Profile-to-candidate matching, relevancy verdicts, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import ASCII_EDGE, bind, string_array
from ..rules import validation_rules as rules


def service_phrases(service: Column) -> Column:
    """Neighbouring word pairs, then single words, of a service name without weightless words."""
    words = F.filter(
        F.split(F.regexp_replace(F.lower(service), "[^a-z0-9/ ]", " "), r"\s+"),
        lambda w: (F.length(w) > 2) & ~F.array_contains(string_array(rules.SERVICE_STOP_WORDS), w),
    )

    def phrases(ws: Column) -> Column:
        pairs = F.transform(
            F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))),
            lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1)),
        )
        return F.concat(pairs, ws)

    return bind(words, phrases)


def matched_services(wanted: Column, offered: Column, body_text: Column, max_chars: int | None = None) -> Column:
    """The wanted services of which a phrase occurs in the offered ones or in the body text."""
    body = F.substring(body_text, 1, max_chars) if max_chars else body_text
    corpus = F.lower(F.concat_ws(" ", F.array_join(offered, " "), F.coalesce(body, F.lit(""))))

    def found(text: Column) -> Column:
        def hit(phrase: Column) -> Column:
            word = F.concat(F.lit(ASCII_EDGE), phrase, F.lit(ASCII_EDGE))
            # The pattern differs from row to row, so it is compiled only where the phrase occurs at all.
            return text.contains(phrase) & (phrase.contains(" ") | F.rlike(text, word))

        return F.filter(wanted, lambda s: F.exists(service_phrases(s), hit))

    return bind(corpus, found)


def _alignment(left: Column, right: Column, unknown: Column) -> Column:
    return F.when(unknown, F.lit(0.5)).when(left == right, F.lit(1.0)).otherwise(F.lit(0.0))


def match_scores(pairs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Adds matched_services, match_score.

    Profile columns (null without a profile): primary_services, profile_model, profile_industry.
    Candidate columns: services, body_text; stored_services, stored_model, stored_industry (nullable).
    """
    has_profile = F.coalesce(F.size("primary_services"), F.lit(0)) > 0
    offered = F.when(
        F.coalesce(F.size("stored_services"), F.lit(0)) > 0, F.col("stored_services")
    ).otherwise(F.col("services"))
    none = F.array().cast("array<string>")
    model = F.coalesce("stored_model", F.lit("unknown"))
    models = _alignment(
        F.col("profile_model"), model, (F.col("profile_model") == "unknown") | (model == "unknown")
    )
    industries = _alignment(
        F.col("profile_industry"),
        F.col("stored_industry"),
        F.col("profile_industry").isNull() | F.col("stored_industry").isNull(),
    )
    matched = pairs.withColumn(
        "matched_services",
        F.when(has_profile, matched_services(F.col("primary_services"), offered, F.col("body_text"), max_chars))
        .otherwise(none),
    )
    share = F.size("matched_services").cast("double") / F.size("primary_services")
    # Weights.
    return matched.withColumn(
        "match_score",
        F.when(has_profile, share * 0.6 + models * 0.2 + industries * 0.2).otherwise(F.lit(0.5)),
    )


def relevancy_filter(validated: DataFrame) -> DataFrame:
    """Adds accepted, rejection_reason, reason_class to validated candidates of a query.

    Needs the verdict columns, match_score, business_model, primary_services, profile_domain.
    Rows of the query company itself are left out; rejected rows stay with their reason.
    """
    others = validated.filter(
        F.col("profile_domain").isNull() | (F.col("domain") != F.col("profile_domain"))
    )
    tool_flag = F.array_contains("flags", "tool_not_agency")
    service_tool = F.coalesce(F.col("q_industry").isin(rules.SERVICE_INDUSTRIES), F.lit(False)) & (
        F.col("business_model") == "tool"
    )
    no_match = (F.coalesce(F.size("primary_services"), F.lit(0)) > 0) & (
        F.col("match_score") < rules.MIN_MATCH_SCORE
    )
    # Rejection texts.
    reason = (
        F.when(~F.col("is_valid") & tool_flag, F.lit("SaaS tool — not a service competitor"))
        .when(~F.col("is_valid"), F.coalesce(F.get("reasons", F.lit(0)), F.lit("failed validation")))
        .when(service_tool, F.lit("Self-serve tool — not an agency competitor"))
        .when(no_match, F.lit("No service overlap with query company profile"))
    )
    reason_class = (
        F.when(~F.col("is_valid") & tool_flag, "tool")
        .when(~F.col("is_valid"), "low_score")
        .when(service_tool, "tool")
        .when(no_match, "no_match")
    )
    return (
        others.withColumn("rejection_reason", reason)
        .withColumn("reason_class", reason_class)
        .withColumn("accepted", F.col("rejection_reason").isNull())
    )


def accepted_order() -> list[Column]:
    """A total order for accepted candidates; the closeness rule it stands for has none."""
    return [F.col("match_score").desc(), F.col("confidence").desc(), F.col("domain")]


def competitor_tier() -> Column:
    """From match_score, business_model and profile_model."""
    return (
        F.when((F.col("match_score") >= 0.6) & (F.col("business_model") == F.col("profile_model")), "direct")
        .when(F.col("match_score") >= 0.2, "partial")
        .otherwise("broader")
    )


def positioning_text(matched: Column) -> Column:
    count = F.size(matched)
    return F.when(
        count > 0,
        F.concat(
            F.lit("Shares "), count.cast("string"), F.lit(" key service"),
            F.when(count > 1, "s").otherwise(""), F.lit(": "), F.array_join(F.slice(matched, 1, 3), ", "),
        ),
    )


def merge_profiles(stored: DataFrame, from_pages: DataFrame) -> DataFrame:
    """Both: domain, name, description, industry, primary_services, secondary_services,
    business_model; pages also tech_stack. The stored profile wins, the page fills gaps, and
    secondary services are the union less the primary ones."""
    s, p = stored.alias("s"), from_pages.alias("p")
    none = F.array().cast("array<string>")

    def either(name: str) -> Column:
        return F.coalesce(F.col(f"s.{name}"), F.col(f"p.{name}"))

    def items(name: str) -> Column:
        return F.coalesce(F.col(name), none)

    joined = s.join(p, F.col("s.domain") == F.col("p.domain"), "full_outer")
    primary = F.when(F.size(items("s.primary_services")) > 0, F.col("s.primary_services")).otherwise(
        items("p.primary_services")
    )
    return joined.select(
        either("domain").alias("domain"),
        either("name").alias("name"),
        F.coalesce(either("description"), F.lit("")).alias("description"),
        F.col("s.industry").alias("industry"),
        primary.alias("primary_services"),
        F.array_except(
            F.array_union(items("s.secondary_services"), items("p.secondary_services")), primary
        ).alias("secondary_services"),
        items("p.tech_stack").alias("tech_stack"),
        F.coalesce(either("business_model"), F.lit("unknown")).alias("business_model"),
    )
