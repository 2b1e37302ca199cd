"""Event store: scans, streams, writer and catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.scalars import same_text
from nightdesk.functions.timerange import TimeRange, in_range
from nightdesk.schemas import WIN_EVENT

_STORED = WIN_EVENT + ", event_date date"


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append events partitioned by index, sourcetype and date.

    Rows are clustered by date and code before the write, so files hold long
    runs of one code and a code filter skips row groups.  The rebalance hint
    lets adaptive execution split a hot day over many files.
    """
    (
        events.withColumn("event_date", F.to_date("_time"))
        .hint("rebalance", "index", "sourcetype", "event_date")
        .sortWithinPartitions("index", "sourcetype", "event_date", "EventCode", "_time")
        .write.mode(mode)
        .partitionBy("index", "sourcetype", "event_date")
        .parquet(path)
    )


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """All events of a store, whatever their index and source type."""
    return spark.read.schema(_STORED).parquet(path)


def security_events(
    spark: SparkSession,
    path: str,
    index: str = vocab.SECURITY_INDEX,
    sourcetype: str | None = vocab.SECURITY_SOURCETYPE,
    time: TimeRange | None = None,
) -> DataFrame:
    """Batch scan of the event store; names and dates prune partitions."""
    df = spark.read.schema(_STORED).parquet(path).filter(F.col("index") == index)
    if sourcetype is not None:
        df = df.filter(F.col("sourcetype") == sourcetype)
    return in_range(df, time)


def stream_security_events(
    spark: SparkSession,
    path: str,
    index: str = vocab.SECURITY_INDEX,
    sourcetype: str | None = vocab.SECURITY_SOURCETYPE,
) -> DataFrame:
    """Streaming twin of :func:`security_events`.

    All files that are there form one micro-batch.  A limit on files would cut history into batches
    in the order of file times, and events behind the watermark of an earlier batch would be lost.
    For a long history run the batch operator and start the stream with its result as state.
    """
    df = spark.readStream.schema(_STORED).parquet(path).filter(F.col("index") == index)
    return df if sourcetype is None else df.filter(F.col("sourcetype") == sourcetype)


def system_events(spark: SparkSession, path: str, time: TimeRange | None = None) -> DataFrame:
    return security_events(spark, path, sourcetype=vocab.SYSTEM_SOURCETYPE, time=time)


def application_events(spark: SparkSession, path: str, time: TimeRange | None = None) -> DataFrame:
    return security_events(spark, path, sourcetype=vocab.APPLICATION_SOURCETYPE, time=time)


def catalog_summary(events: DataFrame, like: str = "WinEventLog%") -> DataFrame:
    """Event count and first and last time per source type."""
    return (
        events.filter(F.lower("sourcetype").like(like.lower()))
        .groupBy("sourcetype")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.min("_time").alias("first_time"),
            F.max("_time").alias("last_time"),
        )
        .orderBy("sourcetype")
    )


def probe(events: DataFrame, host: str = "DC01", n: int = 5) -> DataFrame:
    """Newest few events of one host, to see whether data flows; ties by the other columns."""
    return events.filter(same_text("host", host)).orderBy(F.desc("_time"), *sorted(set(events.columns) - {"_time"})).limit(n)
