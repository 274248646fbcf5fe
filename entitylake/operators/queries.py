"""Query-log jobs. Input: queries(query_id, raw). Narrow: all rules are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import bind, first_group, first_label, java_pattern, lookup, matches, string_array
from ..functions.rows import exploded
from ..functions.text import trim_all
from ..functions.urls import host_of, stem_of, strip_www
from ..rules import domain_lists, query_rules as rules


def normalized_query(raw: Column) -> Column:
    """A phrase that starts with a URL keeps its bare domain and the rest."""
    def parts(trimmed: Column) -> Column:
        url = F.regexp_extract(trimmed, r"^\S+", 0)
        return F.struct(
            trimmed.alias("trimmed"),
            strip_www(host_of(url)).alias("domain"),
            trim_all(F.regexp_replace(trimmed, r"^\S+", "")).alias("rest"),
        )

    def shorten(p: Column) -> Column:
        short = F.when(p["rest"] != "", F.concat_ws(" ", p["domain"], p["rest"])).otherwise(p["domain"])
        with_url = p["trimmed"].rlike("(?i)^https?://") & p["domain"].isNotNull()
        return F.when(with_url, short).otherwise(p["trimmed"])

    return bind(bind(trim_all(raw), parts), shorten)


def is_domain_query(query: Column) -> Column:
    cleaned = F.lower(trim_all(query))
    return bind(cleaned, lambda c: matches(c, rules.BARE_DOMAIN) & ~c.contains(" "))


def domain_in_query(query: Column) -> Column:
    return strip_www(F.lower(first_group(trim_all(query), rules.BARE_DOMAIN)))


def query_intent(query: Column, is_domain: Column) -> Column:
    label = first_label(query, rules.INTENT_RULES, rules.DEFAULT_INTENT)
    return F.when(is_domain, F.lit("competitor_analysis")).otherwise(label)


def query_industry(query: Column) -> Column:
    return first_label(query, rules.QUERY_INDUSTRY_RULES)


def query_location(query: Column) -> Column:
    candidates = []
    for pattern in rules.QUERY_LOCATION_PATTERNS:
        found = trim_all(first_group(query, pattern))
        candidates.append(bind(found, lambda x: F.when((F.length(x) > 2) & ~x.rlike(r"^\d+$"), x)))
    cities = first_group(query, r"\b(" + "|".join(rules.CITIES) + r")\b")
    return F.coalesce(*candidates, cities)


def entity_type(query: Column, intent: Column) -> Column:
    return (
        F.when(intent == "local_business_search", "local_business")
        .when(intent == "product_discovery", "product")
        .when(matches(query, rules.PERSON_WORDS), "person")
        .otherwise("company")
    )


def query_keywords(query: Column, is_domain: Column) -> Column:
    domain = F.coalesce(domain_in_query(query), query)
    parts = F.filter(F.split(stem_of(domain), "[-_]"), lambda p: F.length(p) > 2)
    from_domain = bind(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(domain)))
    words = F.split(F.regexp_replace(F.lower(query), r"[^\w\s]", " "), r"\s+")
    stop = string_array(rules.KEYWORD_STOP_WORDS)
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return F.when(is_domain, from_domain).otherwise(F.slice(F.array_distinct(kept), 1, 10))


def query_objective(query: Column, intent: Column, industry: Column, is_domain: Column) -> Column:
    within = F.coalesce(F.concat(F.lit(" in "), F.replace(industry, F.lit("_"), F.lit(" "))), F.lit(""))

    def say(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    # Objective sentences.
    return (
        F.when(
            is_domain,
            say("Discover direct competitors of ", query, " and analyze the competitive landscape"),
        )
        .when(intent == "competitor_analysis", say("Discover direct competitors", within, " for: ", query))
        .when(intent == "market_discovery", say("Map the market landscape", within, " for: ", query))
        .when(intent == "local_business_search", say("Find local businesses matching: ", query))
        .when(intent == "agency_search", say("Identify agencies", within, " matching: ", query))
        .when(intent == "product_discovery", say("Discover products/tools matching: ", query))
        .when(intent == "brand_discovery", say("Find brands/companies matching: ", query))
        .otherwise(say("General discovery for: ", query))
    )


ANALYSED = (
    "query", "is_domain", "intent", "industry", "location", "entity_type", "keywords", "objective",
)


def _analysis(query: Column) -> Column:
    def labels(a: Column) -> Column:
        return F.struct(
            a["query"].alias("query"),
            a["is_domain"].alias("is_domain"),
            query_intent(a["query"], a["is_domain"]).alias("intent"),
            query_industry(a["query"]).alias("industry"),
            query_location(a["query"]).alias("location"),
            query_keywords(a["query"], a["is_domain"]).alias("keywords"),
        )

    def complete(b: Column) -> Column:
        return F.struct(
            *[b[c].alias(c) for c in ("query", "is_domain", "intent", "industry", "location", "keywords")],
            entity_type(b["query"], b["intent"]).alias("entity_type"),
            query_objective(b["query"], b["intent"], b["industry"], b["is_domain"]).alias("objective"),
        )

    start = bind(query, lambda q: F.struct(q.alias("query"), is_domain_query(q).alias("is_domain")))
    return bind(bind(start, labels), complete)


def analyze_queries(queries: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds query, is_domain, intent, industry, location, entity_type, keywords, objective.

    One bound expression: a later filter on a label repeats it once instead of unfolding every rule
    into every place that reads the label.
    """
    out = queries.withColumn("_a", _analysis(normalized_query(F.col(raw))))
    return out.select(*queries.columns, *[F.col(f"_a.{c}").alias(c) for c in ANALYSED])


def expand_queries(analyzed: DataFrame, year: int, limit: int = 6) -> DataFrame:
    """Up to six distinct search phrases per query, as rows (query_id, pos, phrase)."""
    q, industry = F.col("query"), F.replace("industry", F.lit("_"), F.lit(" "))
    domain = F.coalesce(domain_in_query(q), q)
    company = stem_of(domain)

    def say(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    # Search phrase templates.
    of_domain = F.array(
        say('"', company, '" competitors'),
        say("alternatives to ", domain),
        say("sites like ", domain),
        say("companies similar to ", company),
        F.coalesce(say("best ", industry, " companies"), say(company, f" competitors {year}")),
        say("top ", industry, " agencies 2024"),
    )
    named = F.when(
        F.col("intent") == "competitor_analysis", first_group(q, r"(?:of|for)\s+([\w.-]+\.[\w]{2,})")
    )
    three = F.array_join(F.slice("keywords", 1, 3), " ")
    has_keywords = F.size("keywords") > 0
    of_phrase = F.array(
        q,
        say("competitors of ", named),
        say("alternatives to ", named),
        say('"', stem_of(named), '" competitors'),
        say("best ", industry, " companies"),
        say("top ", industry, " agencies"),
        say(three, " in ", F.col("location")),
        F.when(has_keywords, say(three, " companies")),
    )
    phrases = F.filter(
        F.when(F.col("is_domain"), of_domain).otherwise(of_phrase), lambda p: p.isNotNull()
    )
    kept = F.slice(F.array_distinct(phrases), 1, limit)
    return exploded(analyzed, ["query_id"], kept, "phrase", "pos")


def profile_queries(profiled_queries: DataFrame, year: int, limit: int = 5) -> DataFrame:
    """(query_id, raw, name, primary_services, industry) -> rows (query_id, pos, phrase).

    A query without a profile (name null) searches for its raw text only.
    """
    service = F.lower(F.get("primary_services", F.lit(0)))
    has_profile = F.col("name").isNotNull()
    # Search phrase templates.
    phrases = F.array(
        F.col("raw"),
        F.concat("name", F.lit(" alternative")),
        F.concat(F.lit("top "), service, F.lit(f" companies {year}")),
        F.concat(F.lit("best "), service, F.lit(" agency")),
        F.concat(F.lit("top "), F.replace("industry", F.lit("_"), F.lit(" ")), F.lit(" companies")),
    )
    kept = F.when(has_profile, F.filter(phrases, lambda p: p.isNotNull())).otherwise(F.array("raw"))
    first = F.slice(F.array_distinct(kept), 1, limit)
    return exploded(profiled_queries, ["query_id"], first, "phrase", "pos")


def target_company(query: Column, order: str = "documented") -> Column:
    return F.coalesce(*[first_group(query, p) for p in rules.TARGET_COMPANY_PATTERNS[order]])


def company_to_domain(company: Column, known=None) -> Column:
    slug = F.regexp_replace(F.lower(company), "[^a-z0-9-]", "")
    return bind(
        slug,
        lambda s: F.coalesce(lookup(s, known or domain_lists.KNOWN_COMPANY_DOMAINS), F.concat(s, F.lit(".com"))),
    )


def domain_to_company(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, "^https?://", ""), r"^www\.", "")
    return trim_all(F.regexp_replace(bare, java_pattern(rules.NAME_TLDS), ""))
