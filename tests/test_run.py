"""The run that saves: two rounds, upserts, logs, repetition and recovery."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from entitylake.plans.discovery import Inputs
from entitylake.plans.main_run import MainInputs, run_main_and_save
from entitylake.plans.saved_run import current_links, run_and_save
from entitylake.sources.store import EntityStore
from entitylake.streaming.run import new_folder

MARCH, APRIL = datetime(2024, 3, 1), datetime(2024, 4, 1)
TEXT = "<main><p>A plain company that sells shoes in many places. Contact info@{0}.com today for conversion rate optimization and CRO work.</p></main>"


def page(name, links="", description="We are a CRO agency and help shops with conversion rate optimization and testing every day."):
    return f'<html><head><title>{name.title()}</title><meta name="description" content="{description}"></head><body>{links}{TEXT.format(name)}</body></html>'


PAGES = [
    (1, "https://seedone.com/", page("seedone", '<a href="https://linked.com/">l</a><a href="/about-us">a</a><a href="https://seedtwo.com">s</a>')),
    (2, "https://seedtwo.com/", page("seedtwo")),
    (3, "https://clutch.co/agencies/conversion-rate-optimization", page("clutch", '<a href="https://www.hidden.com/">h</a><a href="https://google.com/">g</a><a href="https://deep.com/page">d</a>')),
    (4, "https://www.hidden.com/", page("hidden")),
    (5, "https://linked.com/", page("linked")),
    (6, "https://seedone.com/about-us", "<main><p>CEO: Peter Stone. Jane Roe, Founder.</p></main>"),
    (7, "https://empty.com/", ""),
]
SEEDS = [("cro_agency", 1, i, d) for i, d in enumerate(["seedone.com", "seedtwo.com", "empty.com", "missing.com"])]


def tables(spark, pages=PAGES, queries=((1, "Best CRO agencies"), (2, "zzzz qqqq"))):
    empty = lambda schema: spark.createDataFrame([], schema)
    return Inputs(
        spark.createDataFrame([(i, raw) for i, raw in queries], "query_id long, raw string"),
        spark.createDataFrame(pages, "page_id long, url string, html string"),
        empty("query_id long, company string, competitors array<string>, confidence double, industry string"),
        empty("query_id long, pos long, domain string, industry string"),
        spark.createDataFrame(SEEDS, "industry string, priority long, pos long, domain string"),
        spark.createDataFrame([("cro_agency", 0, "https://clutch.co/agencies/conversion-rate-optimization")], "industry string, pos int, url string"),
        empty("entity_id long, domain string, category string"),
    )


def rows(df, *but):
    return sorted(str(r.asDict()) for r in df.select(*[c for c in df.columns if c not in but]).collect())


def everything(store):
    logs = {name: rows(store.log(name)) for name in ("links", "snapshots", "changes", "validations", "crawl_logs")}
    return logs | {"entities": rows(store.entities())}


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def store(spark):
    store = EntityStore(spark, new_folder(spark), buckets=8)
    run_and_save(store, tables(spark), "march", MARCH)
    return store


def test_links_of_directories_and_pages_are_saved(store):
    saved = {r.domain: r for r in store.entities().collect()}
    assert set(saved) == {"seedone.com", "seedtwo.com", "hidden.com", "linked.com"}
    assert [p.name for p in saved["seedone.com"].founders] == ["Peter Stone", "Jane Roe"]
    assert {r.first_seen for r in saved.values()} == {MARCH} and all(r.is_valid for r in saved.values())
    assert {(r.domain, r.is_new) for r in current_links(store).collect()} == {(d, True) for d in saved}
    assert store.log("changes").count() == 0 and store.log("snapshots").count() == store.log("validations").count() == 4


def test_logs_tell_every_candidate_and_the_sentinel(store):
    logs = [(r.query_id, r.round, r.url, r.event, r.status, r.error, r.entities_found) for r in store.log("crawl_logs").collect()]
    ends = {x[2]: x[4:] for x in logs if x[3] == 2}
    assert ends["https://seedone.com"] == ("success", None, 1) and ends["https://hidden.com"] == ("success", None, 0)
    assert ends["https://clutch.co/agencies/conversion-rate-optimization"] == ("skipped", "directory-only: links extracted", 0)
    assert ends["https://empty.com"] == ("failed", "no content", 0) and ends["https://missing.com"] == ("failed", "not captured", 0)
    assert sum(x[3] == 1 and x[4] == "crawling" for x in logs) == len(ends)
    assert [x[2:5] for x in logs if x[0] == 2] == [("unsupported:query", 1, "unsupported")]


def test_lookup_opens_one_bucket(store):
    found = store.lookup("hidden.com")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]
    assert "domain,hidden.com" in plan or "EqualTo(domain,hidden.com)" in plan
    bucket = found.collect()[0].bucket
    assert {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()} >= {str(bucket)}


def test_second_run_changes_only_what_changed(spark, store):
    before, old = files(store.path("entities")), everything(store)
    changed = [p if p[0] != 4 else (4, p[1], page("hidden", description="A wholly new line about conversion rate optimization agencies and CRO.")) for p in PAGES[2:4]]
    only = tables(spark, changed, queries=[(5, "Best CRO agencies")])
    run_and_save(store, only, "april", APRIL)
    after = files(store.path("entities"))
    kept = [f for f in before if f in after]
    assert kept and all(before[f] == after[f] for f in kept) and len(set(after) - set(before)) == 1
    assert [(r.domain, r.field, r.change_type) for r in store.log("changes").collect()] == [("hidden.com", "description", "modified")]
    entity = store.lookup("hidden.com").collect()[0]
    assert (entity.first_seen, entity.last_seen) == (MARCH, APRIL)
    assert {(r.query_id, r.is_new) for r in store.log("links").filter("run_id = 'april'").collect()} == {(5, False)}
    assert "no_new_results:query" in {r.url for r in store.log("crawl_logs").filter("query_id = 5").collect()}
    once = everything(store)
    run_and_save(store, only, "april", APRIL)
    assert everything(store) == once and files(store.path("entities")) == after
    assert old["validations"] == [x for x in once["validations"] if "april" not in x]


@pytest.mark.parametrize("step", ["put", "write_buckets"])
def test_a_run_that_died_goes_on_to_the_same_tables(spark, store, step, monkeypatch):
    clean = EntityStore(spark, new_folder(spark), buckets=8)
    again = EntityStore(spark, clean.folder, buckets=8)
    first = spark.createDataFrame([("seedtwo.com", "Old Name", "x", MARCH), ("other.com", "Other", "y", MARCH)], "domain string, name string, description string, first_seen timestamp_ntz")
    clean.load(first)
    calls, real = [], getattr(EntityStore, step)

    def dies(self, *args):
        calls.append(step)
        if len(calls) == 2 or step != "put":
            raise RuntimeError("lost")
        return real(self, *args)

    monkeypatch.setattr(EntityStore, step, dies)
    with pytest.raises(RuntimeError):
        run_and_save(clean, tables(spark), "march", APRIL)
    monkeypatch.setattr(EntityStore, step, real)
    run_and_save(again, tables(spark), "march", APRIL)
    names = {r.domain: r.name for r in again.entities().collect()}
    assert len(names) == 5 and names["other.com"] == "Other"
    assert "name" in {r.field for r in again.log("changes").collect()}
    assert again.log("snapshots").count() == 4 and again.log("links").count() == 4
    assert not again.exists("runs/march")


def test_upsert_reduces_rows_of_one_domain(spark):
    store = EntityStore(spark, new_folder(spark), buckets=4)
    rows = [("a.com", f"name {i}", i) for i in range(50)] + [(None, "nobody", 1)]
    given = spark.createDataFrame(rows, "domain string, name string, at int")
    store.upsert(given, F.lit(MARCH).cast("timestamp_ntz"), ["at"], "one")
    assert [(r.domain, r.name) for r in store.entities().collect()] == [("a.com", "name 49")]
    assert EntityStore(spark, new_folder(spark)).entities().count() == 0


def main_tables(spark, queries=((1, "seedone alternative"), (2, "zzzz qqqq"))):
    given = tables(spark, queries=queries)
    listed = [(1, "seedone.com", ["seedtwo.com", "google.com"], 0.9, None)]
    return MainInputs(
        given.queries, given.pages, spark.createDataFrame(listed, "query_id long, company string, competitors array<string>, confidence double, industry string"),
        given.web, spark.createDataFrame([], "query_id long, pos long, domain string"),
        spark.createDataFrame([("seedone.com", "Seed One", "x", "cro_agency", ["CRO"], ["SEO"], "agency")], "domain string, name string, description string, industry string, primary_services array<string>, secondary_services array<string>, business_model string"),
    )


def test_main_path_saves_competitors_and_logs_the_rest(spark):
    store = EntityStore(spark, new_folder(spark), buckets=4)
    run_main_and_save(store, main_tables(spark), "march", MARCH)
    saved = {r.domain: r for r in store.entities().collect()}
    assert "seedtwo.com" in saved and "seedone.com" not in saved  # the company itself is no competitor
    assert saved["seedtwo.com"].positioning == "Shares 1 key service: CRO" and saved["seedtwo.com"].competitor_tier in ("direct", "partial")
    logs = {(r.query_id, r.status) for r in store.log("crawl_logs").collect()}
    assert (1, "success") in logs and (2, "unsupported") in logs
    once = everything(store)
    run_main_and_save(store, main_tables(spark), "march", MARCH)
    assert everything(store) == once


def test_candidates_are_judged_without_being_broadcast(spark, tmp_path):
    """Files of candidates are far smaller than their rows, which must not pass through the driver."""
    from entitylake.operators.entities import company_entities
    from entitylake.operators.pages import page_profile
    from entitylake.operators.queries import analyze_queries
    from entitylake.plans.discovery import asked_domains, judge, with_site

    given = tables(spark)
    named = spark.createDataFrame([(1, 1, "https://seedone.com", False), (1, 2, "https://www.seedtwo.com/x", False), (1, 3, "https://clutch.co/a", True)], "query_id long, pos int, url string, links_only boolean")
    with_site(named).write.parquet(f"{tmp_path}/candidates")
    asked = spark.read.parquet(f"{tmp_path}/candidates")
    assert sorted(r.domain for r in asked_domains(asked).collect()) == ["seedone.com", "seedtwo.com"]
    records = company_entities(page_profile(given.pages.filter("page_id < 3")))
    judged = judge(asked, analyze_queries(given.queries), records)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not any("query_id" in line for line in plan.splitlines() if "BroadcastExchange" in line or "BuildRight" in line and "query_id" in line)
    assert sum("SortMergeJoin" in line for line in plan.splitlines()) >= 1 and sorted(r.pos for r in judged.collect()) == [1, 2]
    assert rows(judge(named, analyze_queries(given.queries), records)) == rows(judged)


def test_links_of_a_run_stay_narrow_and_versions_are_ordered_once(spark, monkeypatch):
    """What a record says of itself meets the links of its domain once, when they are saved."""
    from entitylake.operators import history
    from entitylake.plans import saved_run

    found = saved_run.Discovery(tables(spark))
    assert set(found.judged.columns) == {"query_id", "round", "pos", "domain", "page_id", "confidence", "relevance", "category", "is_valid"}
    saved = found.saved
    plan = [line for line in saved._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastExchange" in line and "query_id" in line]
    assert plan == [] and {(r.domain, bool(r.name)) for r in saved.collect()} == {(r.domain, True) for r in found._kept.collect()}
    calls, ordered = [], history.previous_per_key
    monkeypatch.setattr(history, "previous_per_key", lambda *given: calls.append(1) or ordered(*given))
    before = saved.filter("query_id < 0").select(*[c for c in saved_run.DATA if c in saved.columns])
    logs = saved_run.version_logs(before, saved, F.lit(None).cast("timestamp_ntz"))
    pairs = saved.groupBy("domain").count().collect()
    assert len(calls) == 1 and len(pairs) > 0 and logs["snapshots"].select("domain").distinct().count() == len(pairs)
