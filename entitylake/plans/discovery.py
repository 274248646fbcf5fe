"""The first round of the discovery run for all queries at once: queries and captured pages in, accepted entities out.

Order of work follows the cost: block lists and caps come before the page join; only the home pages of
asked domains become records, once, before any join with queries, so page text never travels with a query. plans.saved_run
adds the second round and saves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain_of
from ..operators.candidates import candidate_urls, rerun_flags, rerun_new_entities
from ..operators.entities import company_entities
from ..operators.pages import chosen_pages, page_profile
from ..operators.queries import analyze_queries
from ..operators.resolve import dedup_by_domain
from ..operators.scoring import score_entities, validate_entities, with_entity_signals
from ..operators.serve import run_outcome
from ..session import stored


@dataclass
class Inputs:
    """Tables of a run; see candidate_urls for their columns."""

    queries: DataFrame
    pages: DataFrame
    suggestions: DataFrame
    web: DataFrame
    seeds: DataFrame
    directories: DataFrame
    known_entities: DataFrame


@dataclass
class Outputs:
    candidates: DataFrame
    judged: DataFrame
    saved: DataFrame
    outcome: DataFrame


def with_site(candidates: DataFrame) -> DataFrame:
    """Candidates (url, ...) with the `domain` of their address, read once for all steps that ask for it."""
    return candidates if "domain" in candidates.columns else candidates.withColumn("domain", domain_of(F.col("url")))


def asked_domains(candidates: DataFrame) -> DataFrame:
    """(domain) of candidates(url, links_only[, domain]) whose pages become records."""
    return with_site(candidates).filter("NOT links_only").select("domain").distinct()


def home_records(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """One company record for each of `domains` (domain), from its first captured page with content.

    The pages are found by id; only theirs are extracted, and html is never sorted.
    """
    named = pages.filter(F.col("html") != "").select(domain_of(F.col("url")).alias("domain"), "page_id")
    first = named.join(domains, "domain", "left_semi").groupBy("domain").agg(F.min("page_id").alias("page_id"))
    return company_entities(page_profile(chosen_pages(pages, first)))


def judge(candidates: DataFrame, analysed: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates with their record, scores and verdict for the query that asked.

    Candidates meet their query before their record and are merged with it, never broadcast: their files are far smaller than
    their rows, of which there are many per query.
    """
    rounds = ["round"] if "round" in candidates.columns else []
    asked = with_site(candidates).filter(~F.col("links_only")).select("query_id", *rounds, "pos", "domain")
    context = analysed.select(
        "query_id",
        F.col("intent").alias("q_intent"),
        F.col("industry").alias("q_industry"),
        F.col("keywords").alias("q_keywords"),
        F.col("location").alias("q_location"),
    )
    pairs = (
        asked.hint("merge").join(context, "query_id")
        .join(with_entity_signals(records.drop("category")), "domain")
        .withColumn("category", F.replace("q_industry", F.lit("_"), F.lit(" ")))
    )
    return validate_entities(score_entities(pairs))


def run_discovery(inputs: Inputs) -> Outputs:
    analysed = stored(analyze_queries(inputs.queries))
    named = candidate_urls(analysed, inputs.suggestions, inputs.web, inputs.seeds, inputs.known_entities, inputs.directories)
    candidates = stored(with_site(named))
    judged = stored(judge(candidates, analysed, stored(home_records(inputs.pages, asked_domains(candidates)))))
    saved = dedup_by_domain(judged.filter("is_valid"), [F.col("pos")], ["query_id"])
    links = saved.select("query_id", F.col("domain").alias("entity_id"))
    entities = saved.select(F.col("domain").alias("entity_id"), "domain").distinct()
    flags = stored(rerun_new_entities(inputs.queries, links, entities))
    saved = saved.join(flags, ["query_id", "domain"])
    runs = rerun_flags(inputs.queries, flags)
    counted = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    outcome = run_outcome(runs, counted, flags)
    return Outputs(candidates, judged, saved, outcome)
