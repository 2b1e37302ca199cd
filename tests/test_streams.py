"""Streams over many micro-batches: late rows, dropped rows, muted windows, and history day by day."""

import os
import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from helpers import events, failure, lockout, rows
from pyspark.sql import functions as F

from nightdesk.operators.suppression import suppress
from nightdesk.plans import alerts as A
from nightdesk.sources.events import security_events, stream_security_events, write_events
from nightdesk.streaming import jobs
from nightdesk.streaming.stateful import stream_suppress

START = datetime(2024, 3, 5)


def stamp(minutes):
    return str(START + timedelta(minutes=minutes))


@pytest.fixture
def narrow(spark):
    """One state partition, so that many micro-batches take little time."""
    jobs.use_rocksdb(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def in_turn(spark, folder, batches):
    """A stream that gives one of the row lists after the other."""
    parts = [k for k, batch in enumerate(batches) for _ in batch]
    flat = events(spark, [row for batch in batches for row in batch]).coalesce(1)
    numbered = flat.withColumn("part", F.get(F.lit(parts), F.monotonically_increasing_id().cast("int")))
    numbered.write.partitionBy("part").parquet(str(folder))
    for k in range(len(batches)):
        part = f"{folder}/part={k}"
        for name in os.listdir(part):
            os.utime(f"{part}/{name}", (1_600_000_000 + k,) * 2)
    return spark.readStream.schema(flat.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def worked_off(spark, frame, folder):
    """Rows of a stream once it has ended, and its run."""
    run = (
        frame.writeStream.option("checkpointLocation", f"{folder}/ck").foreachBatch(jobs.append_batch(f"{folder}/out", "q"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(frame.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out"), run


def test_late_rows_go_to_quarantine_and_nothing_else_changes(narrow, tmp_path):
    """Micro-batches in the order of time; two events come hours late."""
    spark, spec = narrow, A.ALERTS["lockout"]
    batches = [[lockout(stamp(3 * k)), lockout(stamp(3 * k + 1), f"user{k % 4}")] for k in range(30)]
    batches[20].append(lockout(stamp(21), "bob", source="LATE"))
    batches[25].append(lockout(stamp(22), "newcomer"))  # nothing of this key is folded yet, so it is not too late
    batches.append([lockout(stamp(10_000), "flush")])
    log = str(tmp_path / "log")
    counter = jobs.drop_counter(spark)
    run = jobs.start_alert(in_turn(spark, tmp_path / "in", batches), spec, log, str(tmp_path / "ck"), once=True)
    jobs.fail_on_dropped(run, counter)
    assert counter.batches[str(run.runId)] > 30 and counter.count(run) == 0
    held = [(r["key"], str(r["fired_at"])) for r in jobs.read_quarantine(spark, log).collect()]
    assert held == [("bob", stamp(21))]
    on_time = [r for b in batches for r in b if r.get("Caller_Computer_Name") != ["LATE"] and r["Account_Name"] != ["flush"]]
    want = suppress(A.search_lockout(events(spark, on_time)), "locked_account", spec.mute_minutes * 60)
    got = jobs.read_alert_log(spark, log).filter("key <> 'flush'").select("key", "fired_at")
    assert sorted(rows(got)) == sorted(rows(want.select("locked_account", "_time"))) and want.count() > 20


def test_dropped_rows_are_counted_over_all_batches(narrow, tmp_path):
    """A window aggregate drops what is late; progress reports of the first batches are gone at the end."""
    spark = narrow
    batches = [[failure(stamp(20 * k), "bob")] for k in range(105)]
    batches[5] += [failure(stamp(0), "amy"), failure(stamp(1), "amy"), failure(stamp(2), "amy")]
    stream = jobs.failure_windows(in_turn(spark, tmp_path / "in", batches), min_failures=1, delay="0 seconds")
    counter = jobs.drop_counter(spark)
    _, run = worked_off(spark, stream, tmp_path)
    with pytest.raises(RuntimeError, match="rows came later"):
        jobs.fail_on_dropped(run, counter)
    assert counter.count(run) >= 1 and counter.batches[str(run.runId)] > 100
    assert sum(s["numRowsDroppedByWatermark"] for p in run.recentProgress for s in p["stateOperators"]) == 0


def test_muted_windows_equal_batch(narrow, tmp_path):
    """Counted and muted in one stream, over many batches of rows in disorder."""
    spark, rng = narrow, random.Random(1)
    spec = replace(A.ALERTS["brute_force"], mute_minutes=30)
    times = sorted(rng.randrange(0, 1500) for _ in range(900))
    made = [failure(stamp(t), rng.choice(["bob", "amy", "eve"]), ip=f"10.0.0.{rng.randrange(4)}") for t in times]
    batches = [made[k : k + 75] for k in range(0, len(made), 75)]
    for batch in batches:
        rng.shuffle(batch)
    batches.append([failure(stamp(100_000), "flush")])
    rows_ = jobs.alert_rows(in_turn(spark, tmp_path / "in", batches), spec, delay="2 minutes", min_failures=2)
    got, run = worked_off(spark, rows_, tmp_path)
    jobs.fail_on_dropped(run, jobs.drop_counter(spark))
    found = A.search_brute_force(events(spark, made), min_failures=2)
    want = suppress(found, "target_account", 1800)
    columns = ["target_account", "_time", "failure_count", "source_ips", "risk"]
    assert sorted(rows(got.select(columns))) == sorted(rows(want.select(columns)))
    assert 30 < want.count() < found.count()


def test_stream_in_slots_equals_batch(narrow, tmp_path):
    """A long delay keeps many slots of a hot key waiting; each timer reads its own."""
    spark, rng = narrow, random.Random(5)
    made = [lockout(stamp(rng.randrange(0, 600) + k), "bob") for k in range(600)]
    batches = [made[k : k + 100] for k in range(0, 600, 100)] + [[lockout(stamp(100_000), "flush")]]
    stream = A.search_lockout(in_turn(spark, tmp_path / "in", batches))
    got, _ = worked_off(spark, stream_suppress(stream, "locked_account", 600, "20 hours"), tmp_path)
    want = suppress(A.search_lockout(events(spark, made)), "locked_account", 600)
    assert sorted(rows(got.filter("locked_account <> 'flush'"))) == sorted(rows(want)) and want.count() > 50


def test_backfill_day_by_day(narrow, tmp_path):
    """Each day is a batch of its own; a run that is stopped goes on; the stream continues from its state."""
    spark, rng, spec = narrow, random.Random(9), A.ALERTS["lockout"]
    made = [lockout(stamp(1440 * k + rng.choice([0, 1, 3, 700, 1436, 1438, 1439])), rng.choice(["bob", "amy"])) for k in range(14) for _ in range(6)]
    store, log, state = (str(tmp_path / x) for x in ("store", "log", "state"))
    write_events(events(spark, made).coalesce(1), store)
    want = suppress(A.search_lockout(security_events(spark, store)), "locked_account", 300).select("locked_account", "_time")
    last = date(2024, 3, 5) + timedelta(13)
    jobs.backfill_alert(spark, store, spec, log, state, date(2024, 3, 5), date(2024, 3, 9))
    fired = jobs.backfill_alert(spark, store, spec, log, state, date(2024, 3, 5), last)
    got = jobs.read_alert_log(spark, log).select("key", "fired_at")
    assert sorted(rows(got)) == sorted(rows(want)) and want.count() > 30
    assert len([f for f in os.listdir(state) if f.startswith("day=")]) == 14
    assert fired.filter(F.col("_time") <= F.lit(stamp(1440 * 14 - 5))).count() == 0  # the state holds what can still mute


def test_backfill_with_a_mute_of_several_days(narrow, tmp_path):
    spark, spec = narrow, replace(A.ALERTS["lockout"], mute_minutes=3 * 1440)
    made = [lockout(stamp(1440 * k + 60), name) for k in range(6) for name in ("bob", "amy")]
    store, log, state = (str(tmp_path / x) for x in ("store", "log", "state"))
    write_events(events(spark, made).coalesce(1), store)
    jobs.backfill_alert(spark, store, spec, log, state, date(2024, 3, 5), date(2024, 3, 10))
    want = suppress(A.search_lockout(events(spark, made)), "locked_account", 3 * 86400).select("locked_account", "_time")
    assert sorted(rows(jobs.read_alert_log(spark, log).select("key", "fired_at"))) == sorted(rows(want)) and want.count() == 4
