"""The main path for all queries at once: profile, search, match, filter and save.

A query's company is profiled first (stored profile, else its captured page); the profile's industry is authoritative. Candidates
come from stored suggestions and web searches, with a broader search for queries left with nothing. Their home pages and, one round
on, the sites these link to become records; every pair of query and record is judged, matched against the profile, filtered
and tiered. Accepted rows are saved as in plans.saved_run, rejected ones are logged with their reason.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import domain_of, host_of, strip_www
from ..operators.candidates import candidates_with_fallback, industry_key, rerun_flags, rerun_new_entities
from ..operators.entities import company_entities, matcher_business_model
from ..operators.matching import competitor_tier, match_scores, merge_profiles, positioning_text, relevancy_filter
from ..operators.ordering import first_per_key, top_k_per_key
from ..operators.pages import chosen_pages, page_profile, subpage_url, with_body_text
from ..operators.queries import analyze_queries, company_to_domain, target_company
from ..operators.resolve import dedup_by_domain
from ..operators.serve import run_outcome
from ..operators.subpages import people_of_about_pages
from ..rules import domain_lists, run_rules
from ..session import stored
from ..sources.store import DATA, EntityStore
from .competitors import page_profiles, query_profiles
from .discovery import judge
from .harvest import first_pages
from .saved_run import save_rows, sentinels

#: Domains of a query from web searches, candidates in all, links followed, and characters in which services are looked for.
WEB_CAP, CANDIDATE_CAP, LINK_CAP, MATCH_CHARS = 25, 18, 4, 3000


@dataclass
class MainInputs:
    """queries(query_id, raw[, created_at]), pages(page_id, url, html); suggestions(query_id, company, competitors, confidence,
    industry), web and broader(query_id, pos, domain[, industry]): captured answers; profiles as for merge_profiles."""

    queries: DataFrame
    pages: DataFrame
    suggestions: DataFrame
    web: DataFrame
    broader: DataFrame
    profiles: DataFrame


def site_records(pages: DataFrame, homes: DataFrame, domains: DataFrame) -> DataFrame:
    """Records of the home pages of `domains` with page_model, match_text and `links` (the first external ones, see LINK_CAP).

    match_text is the text of the services page, if the home page names one that was captured, and of the home page itself.
    """
    wanted = homes.join(domains, "domain", "left_semi").select("page_id")
    profile = page_profile(chosen_pages(pages, wanted))
    open_links = F.filter("external_links", lambda u: host_of(u).isNotNull() & ~strip_www(host_of(u)).isin(list(domain_lists.SEARCH_BLOCKLIST)))
    profile = profile.withColumns({"services_url": subpage_url("services"), "out_links": F.slice(F.array_distinct(open_links), 1, LINK_CAP)})
    records = stored(company_entities(profile, "body_text", "services_url", "out_links"))
    asked = records.filter("services_url IS NOT NULL").select(F.col("services_url").alias("url")).distinct()
    ids = pages.select("url", "page_id").join(asked, "url", "left_semi").groupBy("url").agg(F.min("page_id").alias("page_id"))
    texts = with_body_text(chosen_pages(pages, ids)).filter("body_text <> ''")
    offered = texts.select(F.col("url").alias("services_url"), F.substring("body_text", 1, MATCH_CHARS).alias("_offered"))
    both = F.concat_ws("\n\n", "_offered", "body_text")
    return records.join(offered, "services_url", "left").select(
        *[c for c in records.columns if c not in ("body_text", "services_url")],
        matcher_business_model(F.col("body_text")).alias("page_model"), F.substring(both, 1, MATCH_CHARS).alias("match_text"),
    )


@dataclass
class MainRun:
    inputs: MainInputs
    earlier: DataFrame | None = None

    @cached_property
    def analysed(self) -> DataFrame:
        return stored(analyze_queries(self.inputs.queries))

    @cached_property
    def homes(self) -> DataFrame:
        return stored(first_pages(self.inputs.pages))

    @cached_property
    def targets(self) -> DataFrame:
        """query_id and the profile of its company; queries without a known company have no row."""
        named = company_to_domain(target_company(F.col("raw"), "literal"))
        asked = self.inputs.queries.select(named.alias("domain")).distinct()
        from_pages = page_profiles(self.inputs.pages, asked)
        known = merge_profiles(self.inputs.profiles.join(asked, "domain", "left_semi"), from_pages)
        return stored(query_profiles(self.inputs.queries, known))

    @cached_property
    def context(self) -> DataFrame:
        """Analysed queries with the industry that counts: the profile's, the query's own, the suggestion's, the first web search's."""
        locked = self.targets.select("query_id", industry_key(F.col("profile_industry")).alias("_locked"), "profile_industry")
        suggested = self.inputs.suggestions.filter("confidence >= 0.5").select("query_id", F.col("industry").alias("_suggested"))
        web = self.inputs.web.filter("industry IS NOT NULL").groupBy("query_id").agg(F.min_by("industry", "pos").alias("_web"))
        joined = self.analysed.join(locked, "query_id", "left").join(suggested, "query_id", "left").join(web, "query_id", "left")
        own = F.when(F.col("profile_industry").isNull(), F.col("_suggested"))
        return stored(joined.withColumn("industry", F.coalesce("_locked", "industry", own, "_web")).drop("_locked", "profile_industry", "_suggested", "_web"))

    @cached_property
    def candidates(self) -> DataFrame:
        """(query_id, pos, domain, layer)"""
        listed = F.concat("competitors", F.when(F.col("company") != "", F.array("company")).otherwise(F.array().cast("array<string>")))
        suggested = self.inputs.suggestions.filter("confidence >= 0.5").select("query_id", F.lit(1).alias("layer"), F.posexplode(listed).alias("pos", "domain"))
        web = top_k_per_key(self.inputs.web, ["query_id"], [F.col("pos")], WEB_CAP).select("query_id", F.lit(2).alias("layer"), "pos", "domain")
        return stored(candidates_with_fallback(suggested.unionByName(web), self.inputs.broader, cap=CANDIDATE_CAP))

    @cached_property
    def first_records(self) -> DataFrame:
        return stored(site_records(self.inputs.pages, self.homes, self.candidates.select("domain").distinct()))

    @cached_property
    def links(self) -> DataFrame:
        """(query_id, pos, domain): the first different links of the pages of a query's candidates, in their order."""
        outs = self.first_records.select("domain", "out_links").filter(F.size("out_links") > 0)
        rows = self.candidates.join(outs, "domain").select("query_id", "pos", F.posexplode("out_links").alias("at", "link"))
        first = rows.groupBy("query_id", "link").agg(F.min(F.struct("pos", "at")).alias("b"))
        kept = top_k_per_key(first, ["query_id"], [F.col("b"), F.col("link")], LINK_CAP, "rank")
        return stored(kept.select("query_id", F.col("rank").alias("pos"), domain_of(F.col("link")).alias("domain")))

    @cached_property
    def judged(self) -> DataFrame:
        """Every candidate and followed link with a record: verdict, match and whether it is accepted."""
        known = self.first_records.select("domain")
        more = self.links.select("domain").distinct().join(known, "domain", "left_anti")
        records = self.first_records.unionByName(site_records(self.inputs.pages, self.homes, more)).drop("out_links")
        rounds = [self.candidates.select("query_id", F.lit(1).alias("round"), "pos", "domain"), self.links.select("query_id", F.lit(2).alias("round"), "pos", "domain")]
        asked = rounds[0].unionByName(rounds[1]).withColumns({"url": F.concat(F.lit("https://"), F.col("domain")), "links_only": F.lit(False)})
        verdicts = judge(asked, self.context, stored(records))
        profiles = self.inputs.profiles.select(
            "domain", F.col("primary_services").alias("stored_services"), F.col("business_model").alias("stored_model"), F.col("industry").alias("stored_industry"),
        )
        pairs = verdicts.withColumn("body_text", F.col("match_text")).join(self.targets, "query_id", "left").join(profiles, "domain", "left")
        matched = match_scores(pairs).withColumn("business_model", F.coalesce("stored_model", "page_model"))
        return stored(relevancy_filter(matched).drop("body_text", "match_text"))

    @cached_property
    def _kept(self) -> DataFrame:
        return stored(dedup_by_domain(self.judged.filter("accepted"), [F.col("round"), F.col("pos")], ["query_id"]))

    @cached_property
    def flags(self) -> DataFrame:
        links = self._kept.select("query_id", F.col("domain").alias("entity_id"))
        return stored(rerun_new_entities(self.inputs.queries, links, links.select("entity_id", F.col("entity_id").alias("domain")).distinct(), self.earlier))

    @cached_property
    def saved(self) -> DataFrame:
        """One row per query and accepted domain, with tier and positioning; place is its rank by match."""
        sites = first_per_key(self._kept.select("page_id", F.col("source").alias("url"), "founders"), ["page_id"], [F.col("url")])
        people = people_of_about_pages(sites, self.inputs.pages)
        queries = self.inputs.queries
        when = F.col("created_at") if "created_at" in queries.columns else F.lit(None)
        asked = queries.select("query_id", "raw", when.cast("timestamp_ntz").alias("asked_at"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("match_score").desc(), F.col("confidence").desc(), F.col("domain")))
        rows = (
            self._kept.drop("founders", "raw", "source", "positioning", "competitor_tier").join(people.select("page_id", "founders"), "page_id").join(self.flags, ["query_id", "domain"])
            .withColumn("competitor_tier", F.when(F.col("profile_domain").isNotNull(), competitor_tier()))
            .withColumn("positioning", positioning_text(F.col("matched_services"))).withColumn("source", F.concat(F.lit("https://"), F.col("domain")))
            .withColumn("place", place)
        )
        data = [c for c in DATA if c in rows.columns]
        return rows.join(asked, "query_id").select("query_id", "raw", "asked_at", "round", "pos", "place", "match_score", "is_new", *data)

    @cached_property
    def outcome(self) -> DataFrame:
        counted = self.candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"))
        return stored(run_outcome(rerun_flags(self.inputs.queries, self.flags, self.earlier), counted, self.flags))

    @cached_property
    def logs(self) -> DataFrame:
        """One row per saved and per rejected row, and the sentinels."""
        site = F.concat(F.lit("https://"), F.col("domain"))
        where = ["query_id", site.alias("url"), "round", F.col("pos").cast("int").alias("pos"), F.lit(1).alias("event")]
        saved = self.flags.join(self._kept.select("query_id", "domain", "round", "pos"), ["query_id", "domain"])
        good = saved.select(*where, F.lit(run_rules.SUCCESS).alias("status"), F.lit(None).cast("string").alias("error"), F.col("is_new").cast("int").alias("entities_found"))
        bad = self.judged.filter("NOT accepted").select(*where, F.lit(run_rules.SKIPPED).alias("status"), F.col("rejection_reason").alias("error"), F.lit(0).alias("entities_found"))
        return good.unionByName(bad).unionByName(sentinels(self.inputs.queries, self.outcome))


def run_main_and_save(store: EntityStore, inputs: MainInputs, run_id: str, as_of: datetime) -> None:
    """From queries, captured pages and captured answers to stored tables. Running the same id again changes nothing."""
    if store.is_done(run_id):
        return
    found = MainRun(inputs, store.log("links", but=run_id).select("raw", "domain"))
    saved = store.once(run_id, "saved", lambda: found.saved)
    logs = store.once(run_id, "logs", lambda: found.logs)
    save_rows(store, run_id, saved, logs, as_of)
