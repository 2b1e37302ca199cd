"""Alerts, their schedules, texts and streaming forms."""

import os
import random

import pytest
from conftest import TESTDATA
from helpers import at, events, failure, lockout, policy, rows
from pyspark.sql import functions as F

from nightdesk.operators.suppression import suppress
from nightdesk.plans import alerts as A
from nightdesk.plans.catalog import QUERIES
from nightdesk.sources import sinks
from nightdesk.sources.events import stream_security_events, write_events
from nightdesk.streaming import jobs
from nightdesk.streaming.stateful import stream_suppress

NOW = "2024-03-05 12:00:00"


def test_catalog(spark):
    got = {r["alert"]: r for r in A.alert_catalog(spark).collect()}
    assert {n: (r["cron"], r["lookback"], r["overlap"], r["severity_name"], r["mute_minutes"]) for n, r in got.items()} == {
        "lockout": ("*/5 * * * *", 6, 1, "Medium", 5),
        "brute_force": ("*/10 * * * *", 12, 2, "High", 10),
        "policy_change": ("*/5 * * * *", 6, 1, "High", None),
        "new_account": ("*/5 * * * *", 6, 1, "Medium", 1),
        "after_hours_admin": ("0 * * * *", 65, 5, "Medium", None),
    }


def test_single_runs(spark):
    e = events(spark, [lockout("11:54:00"), lockout("11:53:59"), lockout("12:00:00"), policy("11:58:00", "eve"),
                       policy("11:58:00", "system"), policy("11:58:00", None),
                       {"time": "11:59:00", "EventCode": "4720", "Target_Account_Name": ["rooty"]}])
    assert A.alert_lockout(e, NOW).count() == 1
    assert [r["actor"] for r in A.alert_policy_change(e, NOW).collect()] == ["eve"]
    assert A.alert_new_account(e, NOW).first()["is_privileged"] == "YES"


def test_aligned_bucket_is_cut_at_the_lookback(spark):
    """Six failures, two of them before the look-back: the run sees four."""
    data = [failure(t) for t in ("11:40:10", "11:41:00", "11:49:00", "11:49:10", "11:49:20", "11:49:30")]
    assert A.alert_brute_force(events(spark, data), NOW).count() == 0
    got = A.alert_brute_force(events(spark, data + [failure("11:48:30")]), NOW).collect()
    assert [(r["failure_count"], r["risk"]) for r in got] == [(5, "MEDIUM")]


def test_after_hours(spark):
    def logon(time, who):
        return {"time": time, "EventCode": "4624", "Account_Name": ["x", who]}

    e = events(spark, [logon(t, "jsmith") for t in ("06:59:59", "07:00:00", "18:59:59", "19:00:00")]
               + [logon("03:00:00", "ops"), logon("03:00:00", "carl"), logon("03:00:00", None)])
    admins = spark.createDataFrame([("ops", "true"), ("ops", "false"), ("carl", "false")], "username string, is_admin string")
    alone = A.search_after_hours_admin(e)
    assert sorted(r["logon_time"][11:] for r in alone.collect()) == ["06:59:59", "19:00:00"]
    with_lookup = A.search_after_hours_admin(e, admins=admins.filter("is_admin = 'true' or username = 'carl'"))
    assert sorted(r["actor"] for r in with_lookup.collect()) == ["jsmith", "jsmith", "ops"]


def test_lookup_writes_only_absent_fields(spark):
    df = spark.createDataFrame([("a", "kept"), ("b", None)], "k string, v string")
    lookup = spark.createDataFrame([("a", "new"), ("b", "new"), ("b", "other")], "key string, v string")
    assert sorted(rows(A.lookup_output_new(df, lookup, "k", "key", "v").select("k", "v"))) == [("a", "kept"), ("b", "new")]


def test_overlapping_runs_see_an_event_twice(spark):
    e = events(spark, [policy("11:59:30", "eve"), policy("11:57:00", "eve")])
    runs = rows(A.triggered(A.scheduled_results(e, A.ALERTS["policy_change"])).orderBy("run_time"))
    assert [(str(t), n) for t, n in runs] == [("2024-03-05 12:00:00", 2), ("2024-03-05 12:05:00", 1)]
    assert A.triggered(A.scheduled_results(e, A.ALERTS["policy_change"]), quantity=1).count() == 1


def test_render(spark):
    df = spark.createDataFrame([("a", None, ["x", "y"])], "s string, n int, l array<string>").withColumn(
        "_time", F.lit(NOW).cast("timestamp"))
    text = df.select(A.render(df, "$result.s$-$result.n$-$result.l$-$result.none$ at $result._time$.$").alias("t"))
    assert text.first()[0] == "a--x, y- at 2024-03-05 12:00:00.$"


def test_alert_log(spark, tmp_path):
    spec = A.ALERTS["lockout"]
    e = events(spark, [lockout("10:00:00"), lockout("10:04:59"), lockout("10:05:00")])
    fired = A.alert_records(A.alert_history(e, spec), spec)
    sinks.append_alerts(fired, str(tmp_path / "log"), "run1")
    sinks.append_alerts(fired, str(tmp_path / "log"), "run1")
    log = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(str(r["fired_at"])[11:] for r in log.collect()) == ["10:00:00", "10:05:00"]
    assert log.first()["subject"] == "[ALERT] AD Account Locked Out: bob"


# --- streaming: shuffled micro-batches give the batch result --------------------------------------


@pytest.fixture()
def store(spark, tmp_path):
    """An event store written in several files, slightly out of time order."""
    rng = random.Random(3)
    base = at("08:00:00").timestamp()
    data = []
    for i in range(240):
        t = base + i * 40 + rng.random() * 20
        stamp = str(at("08:00:00").fromtimestamp(t))
        who = f"u{rng.randrange(4)}"
        data.append(failure(stamp, who) if i % 3 else lockout(stamp, who))
    flush = [failure("2024-03-06 00:00:00", "flush"), lockout("2024-03-06 00:00:00", "flush")]
    path = str(tmp_path / "store")
    for i in range(0, 240, 60):
        part = data[i : i + 60]
        rng.shuffle(part)
        write_events(events(spark, part).coalesce(1), path)
    write_events(events(spark, flush).coalesce(1), path)
    jobs.use_rocksdb(spark)
    return path, events(spark, data)


def run_all(spark, rows_, name, tmp_path):
    query = (
        rows_.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    return spark.table(name)


def test_streaming_equals_batch(spark, store, tmp_path):
    path, batch = store
    stream = stream_security_events(spark, path)
    got = run_all(spark, stream_suppress(A.search_lockout(stream), "locked_account", 300, "2 hours"), "s1", tmp_path)
    want = suppress(A.search_lockout(batch), "locked_account", 300)
    assert sorted(rows(got.filter("locked_account <> 'flush'"))) == sorted(rows(want)) and want.count() > 10

    got = run_all(spark, jobs.failure_windows(stream, min_failures=3, delay="2 hours"), "s3", tmp_path)
    want = A.search_brute_force(batch, min_failures=3)
    assert sorted(rows(got)) == sorted(rows(want.select(*got.columns))) and want.count() > 3


def test_alert_stream_job_is_idempotent(spark, store, tmp_path):
    path, batch = store
    spec = A.ALERTS["policy_change"]
    assert spec.trigger == "5 minutes" and A.ALERTS["brute_force"].watermark == "2 minutes"
    spec = A.ALERTS["new_account"]
    log = str(tmp_path / "alerts")
    new = events(spark, [{"time": f"10:0{i}:00", "EventCode": "4720", "Target_Account_Name": ["n"]} for i in range(3)])
    write_events(new, path)
    stream = stream_security_events(spark, path)
    jobs.start_alert(stream, spec, log, str(tmp_path / "ck"), once=True, suppressed=False).awaitTermination(300)
    assert jobs.read_alert_log(spark, log).count() == 3
    # The same batch written again replaces itself.
    again = A.alert_records(A.search_new_account(new), spec)
    jobs.append_batch(log, spec.name)(again, 0)
    assert jobs.read_alert_log(spark, log).count() == 3
    # A later run starts from the checkpoint and finds nothing new.
    jobs.start_alert(stream, spec, log, str(tmp_path / "ck"), once=True, suppressed=False).awaitTermination(300)
    assert jobs.read_alert_log(spark, log).count() == 3


def test_streams_read_a_table_of_parts_in_any_file_order(spark, tmp_path):
    """The table is a folder, its files are older and newer than each other at random."""
    source = f"{TESTDATA}/sf0.001/events.parquet"
    if not os.path.exists(source):
        pytest.skip("test tables are not there")
    path = tmp_path / "events.parquet"
    spark.read.parquet(source).repartition(6).write.parquet(str(path))
    for k, part in enumerate(sorted(path.glob("part-*"))):
        os.utime(part, (1_600_000_000 + (k * 7 % 6) * 1000,) * 2)
    whole = rows(QUERIES["st06_suppression"](spark, str(tmp_path)))
    got = rows(QUERIES["st06_stream_suppression"](spark, str(tmp_path)))
    newest = max(t for _, t in whole)
    assert sorted(r for r in whole if r[1] < newest) == sorted(r for r in got if r[1] < newest) and len(got) > 10


def test_stream_goes_on_from_a_batch_run(spark, tmp_path):
    """Firings of the batch run over history mute the stream's first events."""
    jobs.use_rocksdb(spark)
    old = [lockout("10:00:00"), lockout("10:02:00")]
    new = [lockout("10:04:00"), lockout("10:05:00"), lockout("10:06:00"), lockout("23:00:00", "flush")]
    fired = suppress(A.search_lockout(events(spark, old)), "locked_account", 300)
    write_events(events(spark, new), str(tmp_path / "store"))
    stream = A.search_lockout(stream_security_events(spark, str(tmp_path / "store")))
    got = run_all(spark, stream_suppress(stream, "locked_account", 300, "1 minute", fired=fired), "seeded", tmp_path)
    times = [str(r["_time"])[11:] for r in got.filter("locked_account <> 'flush'").collect()]
    assert times == ["10:05:00"]
    with pytest.raises(ValueError):
        stream_suppress(stream, "locked_account", 0, "1 minute")
