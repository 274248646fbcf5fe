import os
import tempfile

import pytest
from pyspark.sql import functions as F

from checks.derived import spark_table
from checks.serve_checks import ORDER, versions
from entitylake.operators.history import entity_changes, entity_snapshots
from entitylake.streaming import jobs as J
from entitylake.streaming.feed import EntityFeed
from entitylake.streaming.run import in_batches, new_folder, read_stream

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def slices(spark):
    """The versions cut by time into three files, so a stream takes three batches."""
    folder = tempfile.mkdtemp(prefix="spark-")
    v = versions(spark, FOLDER)
    bounds = ["1900-01-01", "1996-01-01", "1999-01-01", "2100-01-01"]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = v.filter((F.col("version_ts") >= low) & (F.col("version_ts") < high)).coalesce(1)
        part.write.parquet(f"{folder}/tmp{i}")
        name = next(n for n in os.listdir(f"{folder}/tmp{i}") if n.endswith(".parquet"))
        os.rename(f"{folder}/tmp{i}/{name}", f"{folder}/versions{i}.parquet")
        os.utime(f"{folder}/versions{i}.parquet", (1000 + i, 1000 + i))
    return folder


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_three_batches_equal_one_job(spark, slices):
    feed = EntityFeed(new_folder(spark), ORDER)
    last = feed.run(read_stream(spark, slices, "versions", files_per_batch=1))
    assert last == 2
    check_feed(spark, feed, versions(spark, FOLDER))


FIELDS = ("domain", "version_id", "field", "old_value", "new_value", "change_type")


def check_feed(spark, feed, everything):
    assert rows(feed.history(spark, "changes"), *FIELDS) == rows(entity_changes(everything, ORDER), *FIELDS)
    assert rows(feed.history(spark, "snapshots"), "domain", "version_id", "hash") == rows(entity_snapshots(everything, ORDER), "domain", "version_id", "hash")
    newest = everything.groupBy("domain").agg(F.max(F.struct(*ORDER)).alias("m"), F.min("version_ts").alias("first_seen"))
    want = rows(newest.select("domain", "m.version_id", "first_seen"), "domain", "version_id", "first_seen")
    assert rows(feed.entities(spark), "domain", "version_id", "first_seen") == want


@pytest.mark.parametrize("arrival", [(2, 0, 1), (1, 2, 0)])
def test_late_versions_come_in_between(spark, slices, arrival):
    """Batches in any order, one repeated as a whole, and rows that come twice."""
    parts = [spark.read.parquet(f"{slices}/versions{i}.parquet") for i in range(3)]
    feed = EntityFeed(new_folder(spark), ORDER, buckets=4)
    for batch, i in enumerate(arrival):
        feed.apply(parts[i].unionByName(parts[arrival[0]].limit(20)), batch)
        if batch == 1:
            feed.apply(parts[i].unionByName(parts[arrival[0]].limit(20)), batch)
    check_feed(spark, feed, versions(spark, FOLDER))
    taken_back = spark.read.parquet(f"{feed.folder}/changes").filter("sign = -1").count()
    assert (taken_back > 0) == (arrival == (2, 0, 1))  # versions before all others take nothing back
    assert feed.last_batch(spark) == 2 and EntityFeed(new_folder(spark), ORDER).last_batch(spark) == -1


def test_a_batch_writes_what_it_touches(spark, slices):
    everything = versions(spark, FOLDER)
    feed = EntityFeed(new_folder(spark), ORDER, buckets=8)
    feed.apply(everything, 0)

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(f"{feed.folder}/entities") for f in names if f.endswith(".parquet")}

    before = files()
    feed.apply(everything.limit(1).withColumn("version_id", F.lit(10**9).cast(everything.schema["version_id"].dataType)), 1)
    assert len(files() - before) == 1 and len(before - files()) == 1
    assert spark.read.parquet(f"{feed.folder}/versions/batch=1").count() == 1


def events(spark, given):
    frame = spark.createDataFrame(given, "job_id long, stage string, type string, progress int, t string")
    return frame.select("job_id", "stage", "type", "progress", F.to_timestamp_ntz("t").alias("ts"))


def test_progress_forgets_idle_jobs(spark):
    table = J.progress_table(new_folder(spark))
    table.apply(events(spark, [(1, "a", "log", 10, "2024-01-01 00:00:00"), (2, "a", "log", 50, "2024-01-01 00:10:00"), (2, "a", "error", 20, "2024-01-01 00:12:00")]), 0)
    assert rows(table.live(spark), "job_id") == rows(spark.createDataFrame([(1,), (2,)], "job_id long"), "job_id")
    second = events(spark, [(2, "b", "log", 40, "2024-01-01 00:20:00"), (3, "a", "log", 1, "2024-01-01 00:21:00")])
    for _ in range(2):  # a repeated batch changes nothing
        table.apply(second, 1)
    assert sorted(r.job_id for r in table.live(spark).collect()) == [2, 3]
    table.apply(events(spark, [(1, "a", "log", 90, "2024-01-01 02:00:00")]), 2)
    assert [r.job_id for r in table.live(spark).collect()] == [1]
    got = {r.job_id: (r.progress, r.has_error, r.events) for r in table.result(spark).collect()}
    assert got == {1: (90, False, 2), 2: (50, True, 3), 3: (1, False, 1)}


def test_counters_are_corrected_and_finished_logs_leave(spark):
    def states(*given):
        frame = spark.createDataFrame([*given], "log_id long, event_id long, status string, t string")
        return frame.select("log_id", "event_id", "status", F.to_timestamp_ntz("t").alias("updated_at"))

    counters = J.CrawlCounters(new_folder(spark), timeout="1 hour")
    counters.apply(states((1, 1, "crawling", "2024-01-01 00:00:00"), (2, 2, "pending", "2024-01-01 00:00:00"), (3, 3, "success", "2024-01-01 00:01:00")), 0)
    second = states((1, 4, "success", "2024-01-01 00:05:00"), (2, 5, "failed", "2024-01-01 00:05:00"), (1, 0, "failed", "2023-12-31 00:00:00"))
    for _ in range(2):
        counters.apply(second, 1)
    assert counters.stats(spark).first().asDict() == {"total": 3, "success": 2, "failed": 1, "pending": 0, "success_rate": 67}
    counters.apply(states((4, 6, "crawling", "2024-01-01 05:00:00"), (5, 7, "pending", "2024-01-01 01:00:00")), 2)
    assert sorted(r.log_id for r in counters.table.live(spark).collect()) == [4, 5]
    assert counters.stats(spark).first()["total"] == 5


def test_sessions_leave_the_state(spark):
    """Ended sessions come out in append mode; only those within the watermark are still held."""
    rows_in = events(spark, [(j, "a", "log", j, f"2024-01-01 {h:02}:00:00") for h in range(8) for j in range(5)])
    timed = J.event_time(in_batches(rows_in, 4, "ts"), "ts", "1 hour")
    held = []
    query = (
        J.job_sessions(timed).writeStream.outputMode("append").foreachBatch(lambda df, i: held.append(df.count()))
        .option("checkpointLocation", new_folder(spark)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sum(held) == 30  # sessions of the hours 0 to 5 have ended by 6:00, the watermark
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert state[-1] == 10


@pytest.mark.parametrize(
    "table, batch, derived, order",
    [(J.progress_table, J.job_progress, "fx_agent_events", ""), (J.stage_table, J.stage_ranks, "fx_agent_events", "ts")],
)
def test_stream_equals_batch(spark, table, batch, derived, order):
    whole = batch(spark_table(spark, FOLDER, derived))
    kept = table(new_folder(spark))
    kept.run(in_batches(spark_table(spark, FOLDER, derived), 3, order))
    assert rows(kept.result(spark), *sorted(whole.columns)) == rows(whole, *sorted(whole.columns))


def test_a_batch_puts_versions_in_order_once(spark, tmp_path, monkeypatch):
    """Changes and snapshots are read from one ordered result: one for the timeline, one for what was known before."""
    from entitylake.operators import history
    from entitylake.streaming.feed import EntityFeed

    calls, ordered = [], history.previous_per_key
    monkeypatch.setattr(history, "previous_per_key", lambda *given: calls.append(1) or ordered(*given))
    feed = EntityFeed(str(tmp_path), ["at"], ["name"])
    feed.apply(spark.createDataFrame([("a.com", 1, "A"), ("a.com", 3, "C"), ("b.com", 1, "B")], "domain string, at int, name string"), 0)
    assert len(calls) == 2
    changes = sorted((r.domain, r.at, r.old_value, r.new_value) for r in feed.history(spark, "changes").collect())
    assert changes == [("a.com", 3, "A", "C")] and feed.history(spark, "snapshots").count() == 3


def test_a_batch_leaves_no_steps_behind_and_orders_only_what_it_moves(spark, tmp_path, monkeypatch):
    """Steps of a batch go with it, and versions away from its own are neither shuffled for their fields nor written."""
    import os

    from entitylake.session import checkpoint_root
    from entitylake.streaming import feed as module

    def versions(*given):
        return spark.createDataFrame([*given], "domain string, at int, name string")

    compared, fields = [], module.changed_fields
    monkeypatch.setattr(module, "changed_fields", lambda moved, *given: compared.append(moved.count()) or fields(moved, *given))
    feed = module.EntityFeed(str(tmp_path), ["at"], ["name"])
    steps = lambda: set(os.listdir(checkpoint_root(spark).removeprefix("file:")))
    left = steps()
    feed.apply(versions(*[("a.com", 2 * i, f"A{i}") for i in range(50)], ("b.com", 1, "B")), 0)
    compared.clear()
    feed.apply(versions(("a.com", 31, "new"), ("a.com", 40, "A20"), ("a.com", -1, "A0"), ("c.com", 5, "C")), 1)
    # fresh: 31, -1 and c.com; behind one: 32 with "new" before it now and 30 before, 0 equal to the version before it now and the first before
    assert steps() == left and compared == [4, 2]
    changes = {(r.domain, r.at): (r.old_value, r.new_value) for r in feed.history(spark, "changes").collect()}
    assert changes == {("a.com", 2 * i): (f"A{i - 1}", f"A{i}") for i in range(1, 50) if i != 16} | {("a.com", 31): ("A15", "new"), ("a.com", 32): ("new", "A16")}
    snapshots = sorted((r.domain, r.at) for r in feed.history(spark, "snapshots").collect())
    assert snapshots == sorted([("a.com", at) for at in [-1, 31, *range(2, 100, 2)]] + [("b.com", 1), ("c.com", 5)])
