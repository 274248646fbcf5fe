"""The competitor run for all queries at once: links of queries and entities and company profiles in, accepted competitors out.

Everything known of a query and its company (analysis, target, profile) is one small row per query, and everything known of an entity
(signals, stored profile, model) one row per entity before the two meet. A link takes its query's columns along to its entity, whose
texts are dealt once per entity and never per link; page text is read where the profile is built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import domain_of
from ..operators.entities import company_description, company_name, matcher_business_model, page_services, profile_business_model, service_prominence, with_engagement
from ..operators.matching import accepted_order, competitor_tier, match_scores, positioning_text, relevancy_filter
from ..operators.pages import chosen_pages, with_body_text, with_domain, with_headings, with_meta, with_technologies
from ..operators.queries import company_to_domain, target_company
from ..operators.scoring import score_entities, validate_entities, with_entity_signals
from ..operators.serve import rejection_summary
from ..session import stored


#: Columns of a candidate with its verdict and match.
FILTERED = (
    "query_id", "entity_id", "domain", "confidence", "relevance", "is_valid", "reasons", "flags", "profile_domain", "profile_model",
    "business_model", "matched_services", "match_score", "accepted", "rejection_reason", "reason_class",
)


@dataclass
class Outputs:
    """filtered: every candidate with verdict and match (FILTERED); accepted: ordered, with tier and positioning; rejections: counts per query."""

    filtered: DataFrame
    accepted: DataFrame
    rejections: DataFrame


def page_profiles(pages: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Company profile of the first captured page (smallest page_id) of each domain, or of the given ones (domain) only.

    The pages are found by id alone; only theirs are extracted, and html is never sorted.
    """
    named = pages.select(domain_of(F.col("url")).alias("domain"), "page_id")
    asked = named if domains is None else named.join(domains, "domain", "left_semi")
    first = asked.groupBy("domain").agg(F.min("page_id").alias("page_id"))
    home = with_domain(chosen_pages(pages, first))
    page = with_technologies(with_headings(with_body_text(with_meta(home))))
    roles = service_prominence(with_engagement(page.withColumn("services", page_services())))

    def named(primary: bool):
        kept = F.filter("service_roles", lambda r: r["primary"] if primary else ~r["primary"])
        return F.transform(kept, lambda r: r["service"])

    return roles.select(
        "domain", company_name().alias("name"), company_description().alias("description"),
        named(True).alias("primary_services"), named(False).alias("secondary_services"),
        F.col("technologies").alias("tech_stack"), profile_business_model(F.col("body_text")).alias("business_model"),
    )


def query_profiles(queries: DataFrame, profiles: DataFrame, pattern_order: str = "literal") -> DataFrame:
    """query_id and the profile of the company it is about: profile_domain, primary_services, profile_model, profile_industry."""
    target = queries.select("query_id", company_to_domain(target_company(F.col("raw"), pattern_order)).alias("profile_domain"))
    wanted = profiles.select(
        F.col("domain").alias("profile_domain"), "primary_services", F.col("business_model").alias("profile_model"),
        F.col("industry").alias("profile_industry"),
    )
    return target.join(wanted, "profile_domain")


def candidate_sites(entities: DataFrame, profiles: DataFrame) -> DataFrame:
    """Entities with all that scoring, verdict and matching need of them alone."""
    known = profiles.select(
        "domain", F.col("primary_services").alias("stored_services"), F.col("business_model").alias("stored_model"),
        F.col("industry").alias("stored_industry"),
    )
    rows = entities.withColumn("body_text", F.coalesce("description", F.lit(""))).join(known, "domain", "left")
    return with_entity_signals(rows).withColumn("business_model", F.coalesce("stored_model", matcher_business_model(F.col("body_text"))))


def matched_candidates(links: DataFrame, entities: DataFrame, asked: DataFrame, profiles: DataFrame) -> DataFrame:
    """links(query_id, entity_id) with entity, query, verdict, match_score, matched_services and business_model.

    asked: query_id, raw and the query columns of scoring, one row per query. Links meet their query first: its columns are fewer
    than an entity's texts, and only they are dealt with the links.
    """
    context = asked.join(query_profiles(asked, profiles), "query_id", "left")
    pairs = links.join(context, "query_id").join(candidate_sites(entities, profiles), "entity_id")
    return match_scores(validate_entities(score_entities(pairs)))


def run_competitors(links: DataFrame, entities: DataFrame, asked: DataFrame, profiles: DataFrame) -> Outputs:
    """Judge, match, filter, tier, position and order the candidates of every query. A query without a profile has no tiers.

    What is stored is the verdict and the match; texts and lists of an entity stay with the entity.
    """
    filtered = stored(relevancy_filter(matched_candidates(links, entities, asked, profiles)).select(*FILTERED))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*accepted_order(), "entity_id"))
    accepted = (
        filtered.filter("accepted")
        .withColumn("competitor_tier", F.when(F.col("profile_domain").isNotNull(), competitor_tier()))
        .withColumn("positioning", positioning_text(F.col("matched_services")))
        .withColumn("place", place)
    )
    return Outputs(filtered, accepted, rejection_summary(filtered))
