"""Streaming queries; each must equal the batch statement over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitylake.functions.text import join_list, split_list
from entitylake.streaming import jobs as J
from entitylake.streaming.feed import EntityFeed
from entitylake.streaming.run import in_batches, new_folder, read_stream, run_to_table

from .derived import DERIVED, spark_table
from .registry import checked
from .serve_checks import CHANGES, LATEST, ORDER, VERSIONS


def stream_of(spark, sf, derived, given):
    """A derived table as a stream over the given one."""
    sql = DERIVED[derived].replace("$TS", "TIMESTAMP_NTZ")
    return spark.sql(sql, **{given: read_stream(spark, sf, given)})


def batches_of(spark, sf, derived, order="", batches=3):
    """A derived table as a stream of several micro-batches, in time or in no order."""
    return in_batches(spark_table(spark, sf, derived), batches, order)


@checked("stream_job_progress", "fx_agent_events", "SELECT job_id, greatest(max(progress), 0) AS progress, bool_or(type = 'error') AS has_error, count(*) AS events FROM fx_agent_events GROUP BY job_id")
def stream_job_progress(spark, sf):
    table = J.progress_table(new_folder(spark))
    table.run(batches_of(spark, sf, "fx_agent_events", "ts"))
    return table.result(spark).drop("last_ts")


@checked("stream_stage_status", "fx_agent_events", """SELECT job_id, stage, ['pending', 'running', 'done', 'error'][1 + max(CASE type WHEN 'error' THEN 3 WHEN 'stage_done' THEN 2 WHEN 'stage_start' THEN 1 WHEN 'log' THEN 1 ELSE 0 END)] AS status
FROM fx_agent_events GROUP BY job_id, stage""")
def stream_stage_status(spark, sf):
    table = J.stage_table(new_folder(spark))
    table.run(batches_of(spark, sf, "fx_agent_events", "ts"))
    return J.stage_names(table.result(spark))


_ST = "count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending"


@checked("stream_crawl_stats", "fx_crawl_logs", f"WITH {LATEST}, st AS (SELECT {_ST} FROM la) SELECT *, CAST(floor(success * 100.0::DOUBLE / total + 0.5) AS BIGINT) AS success_rate FROM st")
def stream_crawl_stats(spark, sf):
    counters = J.CrawlCounters(new_folder(spark))
    counters.run(batches_of(spark, sf, "fx_crawl_logs", "updated_at"))
    return counters.stats(spark)


@checked("stream_job_sessions", "fx_agent_events", """WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts) <= INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS opens FROM fx_agent_events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY job_id ORDER BY ts) AS n FROM l),
b AS (SELECT job_id, min(ts) AS started, max(ts) + INTERVAL 15 MINUTE AS evicted, count(*) AS events, max(progress) AS progress FROM s GROUP BY job_id, n)
SELECT * FROM b WHERE evicted <= (SELECT date_trunc('millisecond', max(ts)) FROM fx_agent_events) - INTERVAL 1 HOUR""")
def stream_job_sessions(spark, sf):
    """Sessions that have ended: the others are still in the state when the stream has nothing more to read."""
    events = J.event_time(batches_of(spark, sf, "fx_agent_events", "ts"), "ts", "1 hour")
    found = run_to_table(J.job_sessions(events), "append")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "evicted")})


@checked("stream_crawl_windows", "fx_crawl_logs", "SELECT date_trunc('day', updated_at) AS window_start, status, count(*) AS n, CAST(sum(duration) AS BIGINT) AS duration FROM fx_crawl_logs GROUP BY ALL")
def stream_crawl_windows(spark, sf):
    states = J.event_time(stream_of(spark, sf, "fx_crawl_logs", "events"), "updated_at", "1 hour")
    found = run_to_table(J.crawl_windows(states), "update", ["window_start", "status"])
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_FEEDS: dict[tuple[str, str], EntityFeed] = {}


def run_feed(spark, sf):
    """Versions in no order at all, over three batches; one run serves the queries that read the tables of the feed."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FEEDS:
        stream = batches_of(spark, sf, "fx_versions", batches=3)
        feed = EntityFeed(new_folder(spark), ORDER)
        feed.run(stream.withColumns({c: split_list(F.col(c)) for c in ("services", "emails")}))
        _FEEDS[key] = feed
    return _FEEDS[key]


@checked("stream_entity_upsert", "fx_versions", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY version_ts DESC, version_id DESC) AS n, min(version_ts) OVER (PARTITION BY domain) AS first_seen FROM fx_versions)
SELECT domain, version_id, version_ts AS last_seen, first_seen, name, description, services, linkedin, emails, category FROM r WHERE n = 1""")
def stream_entity_upsert(spark, sf):
    found = run_feed(spark, sf).entities(spark).withColumns({c: join_list(F.col(c)) for c in ("services", "emails")})
    return found.select("domain", "version_id", F.col("version_ts").alias("last_seen"), "first_seen", "name", "description", "services", "linkedin", "emails", "category")


@checked("stream_entity_changes", "fx_versions", f"WITH {VERSIONS}, {CHANGES} SELECT domain, version_id, field, old_value, new_value, change_type FROM changes")
def stream_entity_changes(spark, sf):
    return run_feed(spark, sf).history(spark, "changes").select("domain", "version_id", "field", "old_value", "new_value", "change_type")


@checked("stream_entity_snapshots", "fx_versions", f"WITH {VERSIONS}, {CHANGES} SELECT domain, version_id, hash FROM snaps")
def stream_entity_snapshots(spark, sf):
    return run_feed(spark, sf).history(spark, "snapshots").select("domain", "version_id", "hash")
