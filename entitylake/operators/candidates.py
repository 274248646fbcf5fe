"""Candidate domains of queries: seeds, suggestions, web results, brands, block lists, caps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import bind, lookup, string_array
from ..functions.rows import exploded
from ..functions.urls import clean_candidate, stem_of
from ..rules import domain_lists, query_rules
from ..session import stored
from .ordering import joined_on, top_k_per_key
from .queries import domain_in_query, target_company

URL_CAP = 15


def drop_blocked(df: DataFrame, blocklist: Sequence[str] | DataFrame, col: str = "domain") -> DataFrame:
    """Rows whose domain is not listed. A list becomes a set filter inside the scan stage; a table
    (one column of that name) an anti join whose strategy Spark picks by size."""
    if isinstance(blocklist, DataFrame):
        return df.join(blocklist.select(col).distinct(), col, "left_anti")
    return df.filter(F.col(col).isNull() | ~F.col(col).isin(list(blocklist)))


def cleaned_candidates(df: DataFrame, col: str = "domain") -> DataFrame:
    return df.withColumn(col, clean_candidate(F.col(col))).filter(F.col(col).contains("."))


def is_company_variant(domain: Column, company: Column) -> Column:
    """The company's own site, its plural, or a longer word that holds its name."""
    pair = F.struct(
        F.lower(stem_of(domain)).alias("slug"), F.regexp_replace(F.lower(company), "[^a-z0-9]", "").alias("c")
    )
    return bind(
        pair,
        lambda p: (F.length(p["c"]) >= 3)
        & (
            (p["slug"] == p["c"])
            | (p["slug"] == F.concat(p["c"], F.lit("s")))
            | (p["slug"] == F.concat(p["c"], F.lit("es")))
            | ((F.length(p["slug"]) > F.length(p["c"]) + 2) & p["slug"].contains(p["c"]))
        ),
    )


def drop_company_variants(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """candidates(query_id, domain), targets(query_id, company), one row per query."""
    joined = candidates.join(targets, "query_id", "left")
    return joined.filter(
        ~F.coalesce(is_company_variant(F.col("domain"), F.col("company")), F.lit(False))
    ).drop("company")


def industry_key(industry: Column) -> Column:
    """Industry as named by anyone -> known key, or null."""
    key = F.regexp_replace(F.lower(industry), r"[\s-]", "_")
    return bind(
        key,
        lambda k: F.when(F.array_contains(string_array(domain_lists.INDUSTRY_KEYS), k), k).otherwise(
            lookup(k, domain_lists.INDUSTRY_ALIASES)
        ),
    )


def seed_expansion(queries: DataFrame, seeds: DataFrame) -> DataFrame:
    """queries(query_id, industry) x seeds(industry, pos, domain), equal on industry."""
    return queries.select("query_id", "industry").join(seeds, "industry")


def seed_keyword_match(queries: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, industry): first industry, by priority, with a seed whose stem is in the raw text.

    The text is cut into all pieces as long as some stem, so "contains" is one equality join on the whole stem. The
    different stem lengths, of which a host name allows 63, are the only thing that is collected. Spark takes the pieces for
    no larger than their texts, so a hint keeps it from sending them to every worker.
    """
    text = F.lower("raw")
    stems = (
        seeds.select(stem_of(F.col("domain")).alias("piece"), "industry", "priority")
        .filter(F.length("piece") > 0)
        .groupBy("piece")
        .agg(F.min(F.struct("priority", "industry")).alias("best"))
    )
    lengths = sorted(r[0] for r in seeds.select(F.length(stem_of(F.col("domain")))).distinct().collect() if r[0])
    sizes = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")

    def cut(t: Column) -> Column:
        fitting = F.filter(sizes, lambda n: n <= F.length(t))
        return F.array_distinct(
            F.flatten(
                F.transform(
                    fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, n))
                )
            )
        )

    keyed = exploded(queries, ["query_id"], bind(text, cut), "piece")
    return (
        keyed.hint("merge").join(stems, "piece")
        .groupBy("query_id")
        .agg(F.min("best").alias("best"))
        .select("query_id", F.col("best.industry").alias("industry"))
    )


def brand_domain(raw: Column, brands: Mapping[str, str] | None = None) -> Column:
    """Site of the first known brand word of a phrase."""
    words = F.split(F.regexp_replace(F.lower(raw), r"[^a-z0-9\s]", ""), r"\s+")
    sites = F.transform(words, lambda w: lookup(w, brands or domain_lists.KNOWN_BRANDS))
    return F.get(F.filter(sites, lambda s: s.isNotNull()), F.lit(0))


def category_industry(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, industry): stored category of the domain a query names, as an industry key."""
    asked = queries.filter("is_domain").select("query_id", domain_in_query(F.col("query")).alias("domain"))
    known = entities.filter(F.col("category") != "").select("domain", "category")
    key = F.lower(F.regexp_replace("category", r"\s+", "_"))
    return asked.join(known.hint("merge"), "domain").select("query_id", key.alias("industry"))


def resolve_industry(
    queries: DataFrame, suggestions: DataFrame, web: DataFrame, entities: DataFrame, seeds: DataFrame
) -> DataFrame:
    """Adds seed_industry: the query's own industry, else the suggested, the web's, the stored one;
    then the keyword match, then the fallback of the intent. Only industries with seeds count.

    Tables with a row per query or entity are merged, never broadcast: their files are far smaller than their rows, and the
    driver would hold them all.
    """
    queries = stored(queries)
    with_seeds = seeds.select("industry").distinct()
    suggested = suggestions.filter("confidence >= 0.5").select("query_id", F.col("industry").alias("_suggested"))
    from_web = (
        web.filter(F.col("industry").isNotNull())
        .groupBy("query_id")
        .agg(F.min_by("industry", "pos").alias("_web"))
    )
    categorised = (
        category_industry(queries, entities)
        .join(with_seeds, "industry", "left_semi")
        .groupBy("query_id")
        .agg(F.min("industry").alias("_stored"))
    )
    keyword = seed_keyword_match(queries, seeds).withColumnRenamed("industry", "_keyword")
    joined = reduce(lambda d, o: d.join(o.hint("merge"), "query_id", "left"), (suggested, from_web, categorised, keyword), queries)
    plain, uses_web = ~F.col("is_domain"), F.col("intent").isin(query_rules.WEB_INTENTS)
    resolved = F.coalesce(
        F.col("industry"),
        F.when(plain, F.col("_suggested")),
        F.when(plain & uses_web, F.col("_web")),
        F.when(~plain, F.col("_stored")),
    )
    place = F.coalesce(F.lower("location"), F.lit(""))
    local = F.when(place.rlike("delhi|india|mumbai"), "apparel").otherwise("food")
    fallback = F.when(F.col("intent") == "agency_search", F.lit("cro_agency")).when(
        F.col("intent") == "local_business_search", local
    )
    marked = joined.withColumn("_resolved", resolved).join(
        with_seeds.select(F.col("industry").alias("_resolved"), F.lit(True).alias("_has_seeds")), "_resolved", "left"
    )
    return (
        marked.withColumn("has_industry_seeds", F.coalesce("_has_seeds", F.lit(False)))
        .withColumn(
            "seed_industry",
            F.when(F.col("has_industry_seeds"), F.col("_resolved")).otherwise(F.coalesce("_keyword", fallback)),
        )
        .drop("_resolved", "_has_seeds", "_suggested", "_web", "_stored", "_keyword")
    )


def candidate_urls(
    queries: DataFrame,
    suggestions: DataFrame,
    web: DataFrame,
    seeds: DataFrame,
    entities: DataFrame,
    directories: DataFrame,
    brands: Mapping[str, str] | None = None,
    blocklist: Sequence[str] = tuple(domain_lists.CANDIDATE_BLOCKLIST),
    cap: int = URL_CAP,
    web_cap: int = 10,
) -> DataFrame:
    """Tiered union of candidate sources, first source of a domain wins, first `cap` per query.

    A query takes at most its first `web_cap` domains from the web tier.

    queries: analysed, with query_id. suggestions: query_id, company, competitors array, confidence,
    industry. web: query_id, pos, domain, industry. seeds: industry, priority, pos, domain.
    directories: industry, pos, url. Output: query_id, pos, url, tier, links_only.
    """
    resolved = resolve_industry(queries, suggestions, web, entities, seeds)
    base = stored(
        resolved.select("query_id", "raw", "query", "is_domain", "intent", "seed_industry", "has_industry_seeds")
    )
    plain = base.filter(~F.col("is_domain"))

    listed = F.concat("competitors", F.when(F.col("company") != "", F.array("company")).otherwise(
        F.array().cast("array<string>")))
    suggested = (
        suggestions.filter("confidence >= 0.5")
        .join(plain.select("query_id").hint("merge"), "query_id", "left_semi")
        .select("query_id", F.lit(1).alias("tier"), F.posexplode(listed).alias("pos", "domain"))
    )
    asked = plain.filter(F.col("intent").isin(query_rules.WEB_INTENTS)).select("query_id")
    asked_web = web.select("query_id", "pos", "domain").join(asked.hint("merge"), "query_id", "left_semi")
    from_web = top_k_per_key(asked_web, ["query_id"], [F.col("pos")], web_cap).select(
        "query_id", F.lit(2).alias("tier"), "pos", "domain"
    )
    itself = base.filter("is_domain").select(
        "query_id", F.lit(3).alias("tier"), F.lit(0).alias("pos"), domain_in_query(F.col("query")).alias("domain")
    )
    # Blocked and repeated seeds never count and a query takes at most `cap` domains, so more distinct ones cannot be used.
    distinct_seeds = (
        seeds.withColumn("domain", clean_candidate(F.col("domain"))).filter(~F.col("domain").isin(list(blocklist)))
        .groupBy("industry", "domain").agg(F.min("pos").alias("pos"))
    )
    usable = top_k_per_key(distinct_seeds, ["industry"], [F.col("pos"), F.col("domain")], cap)
    from_seeds = base.join(
        usable.select(F.col("industry").alias("seed_industry"), "pos", "domain"), "seed_industry"
    ).select("query_id", F.lit(4).alias("tier"), "pos", "domain")
    unseeded = base.filter(F.col("seed_industry").isNull())
    guess = F.concat(
        F.regexp_replace(F.lower(target_company(F.col("raw"))), "[^a-z0-9-]", ""), F.lit(".com")
    )
    guessed = unseeded.withColumn(
        "domain", F.when(F.col("intent").isin("competitor_analysis", "market_discovery"), guess)
    ).withColumn("domain", F.when(~F.col("domain").isin(list(blocklist)), F.col("domain")))
    last = guessed.select(
        "query_id",
        F.when(F.col("domain").isNotNull(), 6).otherwise(7).alias("tier"),
        F.lit(0).alias("pos"),
        F.coalesce("domain", brand_domain(F.col("raw"), brands)).alias("domain"),
    )
    domains = reduce(DataFrame.unionByName, (suggested, from_web, itself, from_seeds, last))
    domains = domains.withColumn("domain", clean_candidate(F.col("domain"))).filter(F.col("domain").isNotNull())
    hosts = drop_blocked(domains, blocklist).select(
        "query_id", "tier", "pos", F.concat(F.lit("https://"), F.col("domain")).alias("url"), F.lit(False).alias("links_only")
    )
    pages = (
        base.filter("has_industry_seeds")
        .join(directories.withColumnRenamed("industry", "seed_industry"), "seed_industry")
        .select("query_id", F.lit(5).alias("tier"), "pos", "url", F.lit(True).alias("links_only"))
    )
    distinct = (
        hosts.unionByName(pages)
        .groupBy("query_id", "url")
        .agg(F.min(F.struct("tier", "pos", "links_only")).alias("b"))
        .select("query_id", "url", "b.*")
    )
    ranked = top_k_per_key(
        distinct, ["query_id"], [F.col("tier"), F.col("pos"), F.col("url")], cap, "_rank"
    )
    return ranked.select("query_id", F.col("_rank").alias("pos"), "url", "tier", "links_only")


def candidates_with_fallback(
    layers: DataFrame,
    fallback: DataFrame,
    blocklist: Sequence[str] = tuple(domain_lists.SEARCH_BLOCKLIST),
    cap: int = 18,
) -> DataFrame:
    """layers(query_id, layer, pos, domain) cleaned, in order, once each; a query left with nothing
    takes its rows of fallback(query_id, pos, domain)."""

    def tidy(df: DataFrame) -> DataFrame:
        return drop_blocked(cleaned_candidates(df), blocklist)

    main = tidy(layers)
    broader = (
        tidy(fallback)
        .join(main.select("query_id").distinct(), "query_id", "left_anti")
        .select("query_id", F.lit(99).alias("layer"), "pos", "domain")
    )
    distinct = (
        main.select("query_id", "layer", "pos", "domain")
        .unionByName(broader)
        .groupBy("query_id", "domain")
        .agg(F.min(F.struct("layer", "pos")).alias("b"))
        .select("query_id", "domain", "b.*")
    )
    ranked = top_k_per_key(
        distinct, ["query_id"], [F.col("layer"), F.col("pos"), F.col("domain")], cap, "_rank"
    )
    return ranked.select("query_id", F.col("_rank").alias("pos"), "domain", "layer")


def merge_searches(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results(query_id, ordinal, industry, description, source, domains array) -> two tables.

    Summary per query: first industry, first description, last source that is not 'none', number of
    domains. Domains per query: one row each with its first (ordinal, pos), never one big array.
    """
    found = exploded(results, ["query_id", "ordinal"], "domains", "domain", "pos")
    domains = (
        found.groupBy("query_id", "domain")
        .agg(F.min(F.struct("ordinal", "pos")).alias("b"))
        .select("query_id", "domain", "b.*")
    )
    counts = domains.groupBy("query_id").agg(F.count(F.lit(1)).alias("domain_count"))

    def given(name: str) -> Column:
        return F.when(F.col(name) != "", F.col("ordinal"))

    summary = results.groupBy("query_id").agg(
        F.min_by("industry", given("industry")).alias("industry"),
        F.min_by("description", given("description")).alias("description"),
        F.coalesce(
            F.max_by("source", F.when(F.col("source") != "none", F.col("ordinal"))), F.lit("none")
        ).alias("source"),
    )
    summary = summary.join(counts, "query_id", "left").withColumn(
        "domain_count", F.coalesce("domain_count", F.lit(0))
    )
    return summary, domains


def rerun_new_entities(queries: DataFrame, links: DataFrame, entities: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(query_id, domain, is_new): false where an earlier query with the same raw text had the domain.

    Earlier is by created_at, where queries has it, then query_id; the first query that finds a domain is new. `earlier` (raw,
    domain) are links stored before these queries. No self join of queries: one minimum per (raw, domain), null texts included. Queries
    and entities are merged, not broadcast, as in resolve_industry.
    """
    when = F.struct("created_at", "query_id") if "created_at" in queries.columns else F.struct("query_id")
    found = (
        links.select("query_id", "entity_id")
        .join(queries.select("query_id", "raw", when.alias("run")).hint("merge"), "query_id")
        .join(entities.select("entity_id", "domain").hint("merge"), "entity_id")
        .select("query_id", "raw", "domain", "run")
        .distinct()
    )
    first = found.groupBy("raw", "domain").agg(F.min("run").alias("first"))
    flagged = joined_on(found, first.hint("merge"), ["raw", "domain"]).withColumn("is_new", F.col("run") == F.col("first"))
    if earlier is not None:
        known = earlier.select("raw", "domain").distinct().withColumn("known", F.lit(True))
        known = known.toDF("k_raw", "k_domain", "known")
        same = F.col("raw").eqNullSafe(F.col("k_raw")) & F.col("domain").eqNullSafe(F.col("k_domain"))
        flagged = flagged.join(known.hint("merge"), same, "left").withColumn("is_new", F.col("is_new") & F.col("known").isNull())
    return flagged.select("query_id", "domain", "is_new")


def rerun_flags(queries: DataFrame, saved: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(query_id, is_rerun): whether an earlier query with the same raw text, null included, has a saved entity.

    saved(query_id) are the links of these queries, earlier(raw) those stored before.
    """
    when = F.struct("created_at", "query_id") if "created_at" in queries.columns else F.struct("query_id")
    runs = queries.select("query_id", "raw", when.alias("run"))
    linked = runs.join(saved.select("query_id").distinct().hint("merge"), "query_id", "left_semi").groupBy("raw").agg(F.min("run").alias("first"))
    flagged = runs.join(linked.withColumnRenamed("raw", "l_raw").hint("merge"), F.col("raw").eqNullSafe(F.col("l_raw")), "left").withColumn(
        "is_rerun", F.coalesce(F.col("first") < F.col("run"), F.lit(False))
    )
    if earlier is not None:
        known = earlier.select(F.col("raw").alias("k_raw")).distinct().withColumn("known", F.lit(True))
        flagged = flagged.join(known.hint("merge"), F.col("raw").eqNullSafe(F.col("k_raw")), "left").withColumn(
            "is_rerun", F.col("is_rerun") | F.col("known").isNotNull()
        )
    return flagged.select("query_id", "is_rerun")
