"""The discovery run that saves: queries and captured pages in, stored tables out.

Two rounds of candidates, the second from links of the first one's pages; records of the asked domains only; people of about
pages; entities upserted, and links, snapshots, changes, audit rows and crawl logs written as logs of the run. A run has an
id. It can be repeated at any time: steps that are written are read again, partitions are overwritten, and a finished
run does nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain_of
from ..operators.candidates import candidate_urls, rerun_flags, rerun_new_entities
from ..operators.entities import company_entities
from ..operators.history import TRACKED, changed_fields, merge_links, moved_versions
from ..operators.pages import chosen_pages, page_profile
from ..operators.queries import analyze_queries
from ..operators.resolve import dedup_by_domain
from ..operators.scoring import as_of_literal
from ..operators.serve import run_outcome
from ..operators.subpages import people_of_about_pages
from ..rules import run_rules as rules
from ..session import stored
from ..sources.store import DATA, EntityStore
from .discovery import Inputs, asked_domains, judge, with_site
from .harvest import first_pages, frontier, link_sources, page_targets

#: Order of the versions of an entity within a run: the stored one, then one per query that saves it.
VERSION_ORDER = ("step", "asked_at", "query_id")


def records_of(pages: DataFrame, homes: DataFrame, domains: DataFrame) -> DataFrame:
    """Company records of the home pages of `domains` (domain). The pages are found by id; only theirs are extracted."""
    wanted = homes.join(domains, "domain", "left_semi").select("page_id")
    return company_entities(page_profile(chosen_pages(pages, wanted)))


@dataclass
class Discovery:
    """One run over all queries. Every step is computed when it is first asked for, and stored where several steps read it.

    `earlier` (raw, domain) are the links that earlier runs stored.
    """

    inputs: Inputs
    earlier: DataFrame | None = None

    @cached_property
    def analysed(self) -> DataFrame:
        return stored(analyze_queries(self.inputs.queries))

    @cached_property
    def candidates(self) -> DataFrame:
        i = self.inputs
        return stored(with_site(candidate_urls(self.analysed, i.suggestions, i.web, i.seeds, i.known_entities, i.directories)))

    @cached_property
    def homes(self) -> DataFrame:
        return stored(first_pages(self.inputs.pages))

    @cached_property
    def listed(self) -> DataFrame:
        """(url, page_id) of the directory pages that candidates name and that were captured."""
        urls = self.candidates.filter("links_only").select("url").distinct()
        return stored(first_pages(self.inputs.pages.join(urls, "url", "left_semi"), "url"))

    @cached_property
    def frontier(self) -> DataFrame:
        sources = stored(link_sources(self.candidates, self.analysed, self.homes, self.listed))
        return stored(with_site(frontier(sources, page_targets(self.inputs.pages, sources), self.candidates)))

    @cached_property
    def asked(self) -> DataFrame:
        """(query_id, round, pos, url, links_only, domain) of both rounds."""
        first = self.candidates.select("query_id", F.lit(1).alias("round"), "pos", "url", "links_only", "domain")
        second = self.frontier.select("query_id", F.lit(2).alias("round"), F.col("rank").alias("pos"), "url", F.lit(False).alias("links_only"), "domain")
        return first.unionByName(second)

    @cached_property
    def records(self) -> DataFrame:
        return stored(records_of(self.inputs.pages, self.homes, asked_domains(self.asked)))

    @cached_property
    def judged(self) -> DataFrame:
        """Keys, scores and verdict of each candidate with a record; what a record says of itself stays with it, by page_id."""
        rows = judge(self.asked, self.analysed, self.records)
        return stored(rows.select("query_id", "round", "pos", "domain", "page_id", "confidence", "relevance", "category", "is_valid"))

    @cached_property
    def flags(self) -> DataFrame:
        """(query_id, domain, is_new) of what is saved."""
        links = self._kept.select("query_id", F.col("domain").alias("entity_id"))
        entities = links.select("entity_id", F.col("entity_id").alias("domain")).distinct()
        return stored(rerun_new_entities(self.inputs.queries, links, entities, self.earlier))

    @cached_property
    def _kept(self) -> DataFrame:
        """Valid rows, the first of a domain in each query."""
        return stored(dedup_by_domain(self.judged.filter("is_valid"), [F.col("round"), F.col("pos")], ["query_id"]))

    @cached_property
    def saved(self) -> DataFrame:
        """One row per query and saved domain: round, pos, the data columns, is_new, raw and asked_at.

        Links meet their query and flags as narrow rows; records, with the people of their about pages, join them once, at the end.
        """
        pages = self._kept.select("page_id").distinct()
        records = self.records.join(pages, "page_id", "left_semi").drop("domain", "category")
        entities = people_of_about_pages(records, self.inputs.pages)
        queries = self.inputs.queries
        when = F.col("created_at") if "created_at" in queries.columns else F.lit(None)
        asked = queries.select("query_id", "raw", when.cast("timestamp_ntz").alias("asked_at"))
        links = self._kept.drop("is_valid").hint("merge").join(self.flags, ["query_id", "domain"]).hint("merge").join(asked, "query_id")
        rows = links.hint("merge").join(entities, "page_id")
        return rows.select("query_id", "raw", "asked_at", "round", "pos", "is_new", *[c for c in DATA if c in rows.columns])

    @cached_property
    def outcome(self) -> DataFrame:
        counted = self.candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"))
        return stored(run_outcome(rerun_flags(self.inputs.queries, self.flags, self.earlier), counted, self.flags))

    @cached_property
    def logs(self) -> DataFrame:
        """Crawl-log states: crawling and the end of every candidate, and a sentinel for queries that end without results."""
        return candidate_states(self).unionByName(sentinels(self.inputs.queries, self.outcome))


def candidate_states(run: Discovery) -> DataFrame:
    """Two states per candidate (event 1 and 2). A page that was captured without content, or not at all, has failed."""
    pages = run.inputs.pages
    asked = run.asked
    # One key per candidate: directory pages are looked up by address, the others by domain.
    key = F.when(F.col("links_only"), F.concat(F.lit("page "), "url")).otherwise(F.concat(F.lit("site "), "domain"))
    with_content = run.homes.select(F.concat(F.lit("site "), "domain").alias("of")).unionByName(run.listed.select(F.concat(F.lit("page "), "url").alias("of")))
    captured = pages.filter("html = ''").select(F.array(F.concat(F.lit("site "), domain_of(F.col("url"))), F.concat(F.lit("page "), "url")).alias("k"))
    known = with_content.withColumn("full", F.lit(True)).unionByName(captured.select(F.explode("k").alias("of")).withColumn("full", F.lit(False)))
    known = known.groupBy("of").agg(F.max("full").alias("full"))
    new = run.saved.filter("is_new AND round = 1").select("query_id", "pos", F.lit(1).alias("round"), F.lit(1).alias("found"))
    rows = asked.withColumn("of", key).hint("merge").join(known, "of", "left").hint("merge").join(new, ["query_id", "round", "pos"], "left")
    ok = F.coalesce("full", F.lit(False))
    status = F.when(~ok, rules.FAILED).when(F.col("links_only"), rules.SKIPPED).otherwise(rules.SUCCESS)
    error = F.when(F.col("full").isNull(), rules.NOT_CAPTURED).when(~ok, rules.NO_CONTENT).when(F.col("links_only"), rules.DIRECTORY_ONLY)
    states = F.array(
        F.struct(F.lit(1).alias("event"), F.lit(rules.CRAWLING).alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("entities_found")),
        F.struct(F.lit(2).alias("event"), status.alias("status"), error.alias("error"), F.coalesce("found", F.lit(0)).alias("entities_found")),
    )
    return rows.select("query_id", "url", "round", F.col("pos").cast("int").alias("pos"), F.inline(states))


def sentinels(queries: DataFrame, outcome: DataFrame) -> DataFrame:
    """One log row for a query without candidates, and for a repeated one that finds nothing new."""
    before, after = rules.UNSUPPORTED_ERROR.split("{}")
    rows = outcome.filter(F.col("outcome").isin(rules.UNSUPPORTED, rules.NO_NEW)).join(queries.select("query_id", "raw"), "query_id")
    unsupported = F.col("outcome") == rules.UNSUPPORTED
    message = F.concat(F.lit(before), F.coalesce("raw", F.lit("")), F.lit(after))
    return rows.select(
        "query_id", F.when(unsupported, rules.UNSUPPORTED_URL).otherwise(rules.NO_NEW_URL).alias("url"), F.lit(0).alias("round"), F.lit(0).alias("pos"),
        F.lit(1).alias("event"), F.col("outcome").alias("status"), F.when(unsupported, message).otherwise(rules.NO_NEW_ERROR).alias("error"), F.lit(0).alias("entities_found"),
    )


def version_logs(before: DataFrame, saved: DataFrame, now) -> dict[str, DataFrame]:
    """changes and snapshots of a run: every saved row against the version before it, the stored one first. Versions are put in order once."""
    data = [c for c in DATA if c in saved.columns]
    old = before.select(F.lit(0).alias("step"), F.lit(None).cast("timestamp_ntz").alias("asked_at"), F.lit(None).cast("long").alias("query_id"), *data)
    kept = list(dict.fromkeys(["domain", *VERSION_ORDER, *TRACKED]))
    timeline = old.unionByName(saved.select(F.lit(1).alias("step"), "asked_at", F.col("query_id").cast("long").alias("query_id"), *data)).select(*kept)
    moved = stored(moved_versions(timeline, VERSION_ORDER))
    changes = changed_fields(moved, VERSION_ORDER).withColumn("detected_at", now)
    snapshots = moved.filter("step = 1").select("domain", *VERSION_ORDER, "hash").withColumn("created_at", now)
    return {"changes": changes, "snapshots": snapshots}


def save_rows(store: EntityStore, run_id: str, saved: DataFrame, logs: DataFrame, as_of: datetime) -> None:
    """Write what a run found. `saved` and `logs` are steps of the run, so that every repetition writes the same."""
    now = as_of_literal(as_of)
    domains = saved.select("domain").distinct()
    before = store.once(run_id, "before", lambda: store.entities(store.touched(domains)).join(domains, "domain", "left_semi"))
    for name, rows in version_logs(before, saved, now).items():
        store.put(name, rows, run_id)
    store.put("links", saved.withColumns({"score": F.col("relevance"), "linked_at": now}), run_id)
    audit = {"validation_type": F.lit("full"), "passed": F.lit(True), "score": F.col("confidence"), "reason": F.lit("Passed validation"), "created_at": now}
    store.put("validations", saved.withColumns(audit), run_id)
    store.put("crawl_logs", logs.withColumn("created_at", now), run_id)
    store.upsert(saved, now, ("asked_at", "query_id"), run_id)
    store.finish(run_id)


def run_and_save(store: EntityStore, inputs: Inputs, run_id: str, as_of: datetime) -> None:
    """Everything from captured pages and queries to stored tables. Running the same id again changes nothing."""
    if store.is_done(run_id):
        return
    found = Discovery(inputs, store.log("links", but=run_id).select("raw", "domain"))
    saved = store.once(run_id, "saved", lambda: found.saved)
    logs = store.once(run_id, "logs", lambda: found.logs)
    save_rows(store, run_id, saved, logs, as_of)


def current_links(store: EntityStore) -> DataFrame:
    """query_id, domain, score, is_new of every stored link: is_new of its first write, score of the last."""
    rows = store.log("links").withColumnRenamed("domain", "entity_id")
    return merge_links(rows, ["linked_at", "run_id"]).withColumnRenamed("entity_id", "domain")
