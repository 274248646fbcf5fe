"""Company, product and local-business records from profiled pages. Narrow: one page, one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import (
    all_groups, bind, count_hits, first_group, matches, terms_found,
)
from ..functions.text import title_case_words, trim_all
from ..functions.urls import stem_of
from ..rules import page_rules as rules
from .people import people_in_text

SEPARATOR_TAIL = r"\s*[-|–]\s*.+\z"


def is_tagline(text: Column) -> Column:
    trimmed = trim_all(text)
    many = F.size(F.split(trimmed, r"\s+")) >= 6
    return many | trimmed.rlike(f"(?i)^(?:{rules.TAGLINE_STARTERS})")


def _title_stem(title: Column) -> Column:
    stem = trim_all(F.regexp_replace(title, SEPARATOR_TAIL, ""))
    return bind(stem, lambda s: F.when((F.length(s) > 1) & ~is_tagline(s), s))


def name_from_domain(domain: Column) -> Column:
    return title_case_words(F.replace(stem_of(domain), F.lit("-"), F.lit(" ")))


def company_name() -> Column:
    """From og_title, headings, title and domain columns."""
    h1 = F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"]
    h2 = F.get(
        F.filter("headings", lambda h: (h["level"] == 2) & (F.length(h["text"]) < 40) & ~is_tagline(h["text"])),
        F.lit(0),
    )["text"]
    return F.coalesce(
        F.when(F.col("og_title") != "", _title_stem(F.col("og_title"))),
        bind(h1, lambda t: F.when((F.length(t) < 50) & ~is_tagline(t), t)),
        F.when(F.col("title") != "", _title_stem(F.col("title"))),
        h2,
        name_from_domain(F.col("domain")),
    )


def first_sentence(text: Column, longer_than: int = 50) -> Column:
    sentences = F.transform(F.split(text, r"[.!?]+"), trim_all)
    return F.get(F.filter(sentences, lambda s: F.length(s) > longer_than), F.lit(0))


def company_description() -> Column:
    meta = F.coalesce(F.col("description"), F.col("og_description"))
    return F.coalesce(F.when(F.length(meta) > 20, meta), first_sentence(F.col("body_text")))


def service_terms(text: Column, limit: int = 8, terms=None) -> Column:
    """Service phrases that occur anywhere in the text, also inside words, in rule order."""
    return F.slice(terms_found(F.lower(text), terms or rules.SERVICE_TERMS), 1, limit)


def page_services(limit: int = 8) -> Column:
    headings = F.array_join(F.transform("headings", lambda h: h["text"]), " ")
    return service_terms(F.concat_ws(" ", F.col("body_text"), headings), limit)


def text_locations(text: Column, limit: int = 3) -> Column:
    found = [all_groups(text, p, 1, ignore_case=False) for p in rules.LOCATION_PATTERNS]
    return F.slice(F.array_distinct(F.concat(*found)), 1, limit)


def text_rating(text: Column) -> Column:
    value = first_group(text, rules.RATING_PATTERN)
    return bind(value.cast("double"), lambda r: F.when(r <= 5, r))


def text_pricing(text: Column) -> Column:
    return F.coalesce(*[first_group(text, p, 0) for p in rules.PRICE_PATTERNS])


def product_category(text: Column, title: Column) -> Column:
    combined = F.lower(F.concat_ws(" ", text, F.coalesce(title, F.lit(""))))

    def decide(t: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(""))
        for words, label in rules.PRODUCT_CATEGORIES:
            hit = F.lit(False)
            for word in words:
                hit = hit | t.contains(word)
            chain = chain.when(hit, F.lit(label))
        return chain.otherwise(F.lit(rules.DEFAULT_PRODUCT_CATEGORY))

    return bind(combined, decide)


def _same_as(pattern: str) -> Column:
    return F.get(F.filter("schema_org.same_as", lambda u: matches(u, pattern)), F.lit(0))


def company_entities(profiled: DataFrame, *also: str) -> DataFrame:
    """Structured data first, heuristics where it is silent. `also` names columns of the profile to keep."""
    stated = F.coalesce(F.col("schema_org.services"), F.array().cast("array<string>"))
    services = F.when(F.size(stated) > 0, F.slice(F.array_distinct(stated), 1, 8)).otherwise(page_services())
    return profiled.select(
        "page_id",
        "url",
        "domain",
        F.coalesce(F.col("schema_org.name"), company_name()).alias("name"),
        F.coalesce(F.col("schema_org.description"), company_description()).alias("description"),
        services.alias("services"),
        F.when(F.size("page_people") > 0, F.slice("page_people", 1, 6))
        .otherwise(people_in_text(F.col("body_text")))
        .alias("founders"),
        F.coalesce(_same_as(r"linkedin\.com"), F.try_element_at("social_links", F.lit("linkedin"))).alias("linkedin"),
        F.coalesce(_same_as(r"twitter\.com|x\.com"), F.try_element_at("social_links", F.lit("twitter"))).alias("twitter"),
        "technologies",
        F.when(F.col("schema_org.address").isNotNull(), F.array(F.col("schema_org.address")))
        .otherwise(text_locations(F.col("body_text")))
        .alias("locations"),
        "emails",
        "phones",
        F.lit(None).cast("string").alias("category"),
        F.col("url").alias("source"),
        F.col("title").alias("meta_title"),
        F.col("description").alias("meta_description"),
        *also,
    )


def local_business_entities(profiled: DataFrame) -> DataFrame:
    return profiled.select(
        "page_id",
        "domain",
        company_name().alias("name"),
        F.coalesce(F.get(text_locations(F.col("body_text")), F.lit(0)), F.lit("Unknown")).alias("location"),
        page_services().alias("services"),
        text_rating(F.col("body_text")).alias("rating"),
        F.get("phones", F.lit(0)).alias("phone"),
        F.col("url").alias("website"),
    )


def product_entities(profiled: DataFrame) -> DataFrame:
    return profiled.select(
        "page_id",
        "domain",
        company_name().alias("name"),
        product_category(F.col("body_text"), F.col("title")).alias("category"),
        name_from_domain(F.col("domain")).alias("brand"),
        text_pricing(F.col("body_text")).alias("pricing"),
        F.col("url").alias("source"),
        company_description().alias("description"),
    )


# --- business signals ---------------------------------------------------------------------------


def matcher_business_model(text: Column) -> Column:
    return (
        F.when(count_hits(text, rules.MATCHER_TOOL_SIGNALS) >= 2, "tool")
        .when(matches(text, rules.MATCHER_AGENCY), "agency")
        .when(matches(text, rules.BRAND_SIGNAL), "brand")
        .otherwise("unknown")
    )


def engagement_flags(text: Column) -> dict[str, Column]:
    return {name: matches(text, pattern) for name, pattern in rules.ENGAGEMENT_PATTERNS.items()}


def with_engagement(df: DataFrame, text: str = "body_text") -> DataFrame:
    return df.withColumns(engagement_flags(F.col(text)))


def profile_business_model(text: Column) -> Column:
    """Needs the engagement flag columns."""
    agency = (
        F.when(F.col("has_case_studies"), 2).otherwise(0)
        + F.col("has_team_page").cast("int")
        + F.col("has_testimonials").cast("int")
        + count_hits(text, rules.PROFILE_AGENCY_SIGNALS)
    )
    return (
        F.when(count_hits(text, rules.PROFILE_TOOL_SIGNALS) >= 2, "tool")
        .when(agency >= 3, "agency")
        .when(matches(text, rules.PLATFORM_SIGNAL), "platform")
        .when(matches(text, rules.BRAND_SIGNAL), "brand")
        .otherwise("unknown")
    )


FLAT_HEADING = r"(?i)<h[12][^>]*>([^<]+)</h[12]>"
HERO_CHARS = 1400


def flat_headings(html: Column) -> Column:
    """Level 1 and 2 headings that hold plain text only, joined."""
    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(FLAT_HEADING), F.lit(1)), trim_all), " ")


def service_prominence(pages: DataFrame) -> DataFrame:
    """Split services into primary and secondary.

    Primary: the first word stands in a heading, in the meta text, in the hero part of the body and
    at least twice overall, or at least four times. With none primary, the first three become it.
    Needs html, title, description, body_text, services.
    """
    texts = F.struct(
        F.lower(flat_headings(F.col("html"))).alias("headings"),
        F.lower(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("title", F.lit("")))).alias("meta"),
        F.lower(F.substring("body_text", 1, HERO_CHARS)).alias("hero"),
        F.lower("body_text").alias("body"),
    )

    def rate(t: Column) -> Column:
        def one(service: Column) -> Column:
            word = F.regexp_replace(F.substring_index(F.lower(service), " ", 1), "[^a-z0-9]", "")
            hits = bind(
                word,
                lambda w: F.struct(
                    w.alias("w"),
                    # a service without any of a-z and 0-9 in its first word counts as found everywhere
                    F.when(w == "", F.length(t["body"]))
                    .otherwise((F.length(t["body"]) - F.length(F.replace(t["body"], w, F.lit("")))) / F.length(w))
                    .cast("int")
                    .alias("n"),
                ),
            )
            return bind(
                hits,
                lambda h: F.struct(
                    service.alias("service"),
                    (
                        t["headings"].contains(h["w"])
                        | t["meta"].contains(h["w"])
                        | (t["hero"].contains(h["w"]) & (h["n"] >= 2))
                        | (h["n"] >= 4)
                    ).alias("primary"),
                ),
            )

        return F.transform("services", one)

    def settle(rated: Column) -> Column:
        none = ~F.exists(rated, lambda r: r["primary"])
        return bind(
            none,
            lambda no: F.transform(
                rated,
                lambda r, i: F.struct(r["service"].alias("service"), (r["primary"] | (no & (i < 3))).alias("primary")),
            ),
        )

    return pages.withColumn("service_roles", bind(bind(texts, rate), settle))
