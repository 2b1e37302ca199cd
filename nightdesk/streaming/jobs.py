"""Streaming alert jobs: windows, enrichment, triggers and the alert log."""

from __future__ import annotations

import threading
import weakref
from collections import defaultdict
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from nightdesk import vocab
from nightdesk.functions.chunked import HOT_ROWS
from nightdesk.functions.scalars import first_per_key, nth, risk, source_ip
from nightdesk.functions.timerange import TimeRange, as_datetime, ts_lit
from nightdesk.operators.base import security
from nightdesk.operators.suppression import suppress
from nightdesk.plans.alerts import ALERTS, AlertSpec, alert_records
from nightdesk.schemas import TRIGGERED_ALERT
from nightdesk.sources.events import security_events
from nightdesk.streaming.stateful import stream_suppress

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State on local disk with remote checkpoints: needed for large key spaces."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def failure_windows(
    events: DataFrame, span: str = "10 minutes", min_failures: int = 5, delay: str | None = None, event: str | None = None
) -> DataFrame:
    """Tumbling failure counts per account over the threshold.

    ``event`` adds the window's last instant under that name, the event time for operators that follow.

    The watermark is the alert's look-back minus its period.  Counts combine
    map-side before the shuffle, so a hot account costs one row per task.
    """
    delay = delay or ALERTS["brute_force"].watermark
    rows = (
        security(events, [vocab.LOGON_FAILED])
        .select("_time", nth("Account_Name", 1).alias("target_account"), source_ip().alias("ip"))
        .filter(F.col("target_account").isNotNull())
        .withWatermark("_time", delay)
    )
    return (
        rows.groupBy(F.window("_time", span).alias("w"), "target_account")
        .agg(F.count(F.lit(1)).alias("failure_count"), F.sort_array(F.collect_set("ip")).alias("source_ips"))
        .filter(F.col("failure_count") >= min_failures)
        .select(
            F.col("w.start").alias("_time"),
            "target_account",
            "failure_count",
            "source_ips",
            risk("failure_count", default="MEDIUM").alias("risk"),
            *([F.window_time("w").alias(event)] if event else []),
        )
    )


def alert_rows(events: DataFrame, spec: AlertSpec, suppressed: bool = True, late: bool = False, fired: DataFrame | None = None, **options) -> DataFrame:
    """Streaming rows of an alert: its search, then its suppression.

    ``late`` adds rows that came too late for the suppression, told by a column ``late``; ``fired``
    holds the firings of an earlier run.
    """
    muted = suppressed and spec.mute_minutes is not None
    if spec.name == "brute_force":
        # Two stateful operators in a row: windows are counted, then muted in the order of their ends.
        delay = options.pop("delay", spec.watermark)
        if not muted:
            return failure_windows(events, delay=delay, **options)
        rows = failure_windows(events, delay=delay, event="_end", **options)
        return stream_suppress(rows, spec.key, spec.mute_minutes * 60, None, fired=fired, late=late, event="_end")
    rows = spec.search(events, None, **options)
    if muted:
        return stream_suppress(rows, spec.key, spec.mute_minutes * 60, spec.watermark, fired=fired, late=late)
    return rows


def append_batch(path: str, name: str):
    """``foreachBatch`` writer that is idempotent: a batch id owns its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/query={name}/batch={batch_id}")

    return write


class DropCounter(StreamingQueryListener):
    """Counts the rows that stateful operators have dropped behind the watermark, over all batches of every run.

    A query's own progress reports reach back a hundred batches only, so a listener keeps the sum.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = defaultdict(int)
        self.batches: dict[str, int] = defaultdict(int)
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.batches[run] += 1
        self.dropped[run] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()

    def count(self, run: StreamingQuery, patience: int = 60) -> int:
        """Rows dropped by a run that has ended; reports come in order, the end last."""
        if not self.ended[str(run.runId)].wait(patience):
            raise RuntimeError("the run has not reported its end")
        return self.dropped[str(run.runId)]


def drop_counter(spark) -> DropCounter:
    """The session's counter, added to its listeners at the first call."""
    if spark not in _COUNTERS:
        _COUNTERS[spark] = DropCounter()
        spark.streams.addListener(_COUNTERS[spark])
    return _COUNTERS[spark]


_COUNTERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def fail_on_dropped(run: StreamingQuery, counter: DropCounter) -> None:
    """Wait for the end of a run; raise when it has dropped rows behind its watermark."""
    run.awaitTermination()
    dropped = counter.count(run)
    if dropped:
        raise RuntimeError(f"{dropped} rows came later than the watermark allows; run the batch operator over them")


def _scheduled(writer: DataStreamWriter, spec: AlertSpec, once: bool) -> DataStreamWriter:
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=spec.trigger)


def start_alert(
    events: DataFrame, spec: AlertSpec, path: str, checkpoint: str, once: bool = False, **options
) -> StreamingQuery:
    """Run an alert as a stream into the alert log.

    ``once`` works off what is there and stops, for an external scheduler;
    otherwise the alert's period is the trigger interval.  Rows that come too
    late for the suppression are written beside the log (:func:`read_quarantine`).
    """
    drop_counter(events.sparkSession)
    rows = alert_rows(events, spec, late=True, **options)
    late = F.col("late") if "late" in rows.columns else F.lit(False)
    records = alert_records(rows, spec, late.alias("late"))
    writer = (
        records.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(append_batch(path, spec.name))
    )
    return _scheduled(writer, spec, once).start()


def read_alert_log(spark, path: str) -> DataFrame:
    """The alert log, one row per (alert, key, time)."""
    log = spark.read.option("recursiveFileLookup", "true").schema(f"{TRIGGERED_ALERT}, late boolean").parquet(path)
    return first_per_key(log.filter(~F.coalesce("late", F.lit(False))).drop("late"), ["alert", "key", "fired_at"])


def read_quarantine(spark, path: str) -> DataFrame:
    """Rows of an alert's search that came too late to be put in order, for a batch run over them."""
    log = spark.read.option("recursiveFileLookup", "true").schema(f"{TRIGGERED_ALERT}, late boolean").parquet(path)
    return log.filter("late").drop("late")


def backfill_alert(spark, store: str, spec: AlertSpec, path: str, state: str, first: date, last: date, **options) -> DataFrame:
    """Work off the history of an alert day by day, in the order of event time.

    Each day reads its own partition of the event store, mutes its rows with the last firing of each
    key handed on from the day before, and writes its part of the alert log and its state.  A day
    whose state is there is done, so a run that was stopped goes on where it ended, and a day written
    twice replaces itself.  Returns the firings to start the stream with (``start_alert(fired=...)``).
    The loop holds one date at a time; the number of days is its only cost on the driver.
    """
    day, held = first, None
    while day <= last:
        here = f"{state.rstrip('/')}/day={day}"
        if not _is_written(spark, here):
            events = security_events(spark, store, time=TimeRange(as_datetime(f"{day} 00:00:00"), as_datetime(f"{day + timedelta(1)} 00:00:00")))
            rows = spec.search(events, None, **options)
            if spec.mute_minutes is not None:
                # A day rarely has a hot key; then the plan for such keys is left out.
                most = rows.groupBy(spec.key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
                hot = HOT_ROWS if most > HOT_ROWS else None
                rows = suppress(rows, spec.key, spec.mute_minutes * 60, fired=held, hot_rows=hot)
            out = f"{path.rstrip('/')}/query={spec.name}/day={day}"
            alert_records(rows, spec, F.lit(False).alias("late")).write.mode("overwrite").parquet(out)
            fired = spark.read.schema(TRIGGERED_ALERT).parquet(out).select(F.col("key").alias(spec.key), F.col("fired_at").alias("_time"))
            if held is not None:
                fired = fired.unionByName(held)
            # What has fired earlier than one mute before the day's end mutes nothing any more.
            still = ts_lit(day + timedelta(1)) - F.make_dt_interval(mins=F.lit(spec.mute_minutes or 0))
            fired.filter(F.col("_time") > still).groupBy(spec.key).agg(F.max("_time").alias("_time")).write.mode("overwrite").parquet(here)
        held = spark.read.schema(f"{spec.key} string, _time timestamp").parquet(here)
        day += timedelta(1)
    return held


def _is_written(spark, folder: str) -> bool:
    """Whether a job has committed its output there."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
