"""Event counts and times per source type from stored statistics, not from the events.

The statistics of an event store lie beside it, a row per partition (index, source type, date) with
the number and bytes of its files at the time.  A partition whose files are no longer those is read
anew; all others are answered from their row.  So a catalogue over years of events reads the file
listing and what has come since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk.sources.events import stored_events
from nightdesk.sources.keyed import KeyedTable
from nightdesk.sources.tables import list_files

PART = ["index", "sourcetype", "event_date"]
STATS = "index string, sourcetype string, event_date string, files bigint, bytes bigint, total bigint, first_time timestamp, last_time timestamp"


def stats_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, f"{path.rstrip('/')}_stats", STATS, PART, buckets=8)


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """Number and bytes of the files of each partition, from the listing alone."""
    files = list_files(spark, path, "*.parquet")
    named = [F.url_decode(F.regexp_extract("path", rf"/{c}=([^/]*)/", 1)).alias(c) for c in PART]
    return files.select(*named, "length").groupBy(*PART).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def _changed(spark: SparkSession, path: str, held: DataFrame) -> DataFrame:
    """Statistics of the partitions whose files are not those of their row, read from the events."""
    stale = partitions(spark, path).join(held.select(*PART, "files", "bytes"), [*PART, "files", "bytes"], "left_anti")
    if stale.isEmpty():
        return spark.createDataFrame([], STATS)
    events = stored_events(spark, path).withColumn("event_date", F.col("event_date").cast("string"))
    counted = events.join(stale.select(*PART), PART, "left_semi").groupBy(*PART).agg(
        F.count(F.lit(1)).alias("total"), F.min("_time").alias("first_time"), F.max("_time").alias("last_time")
    )
    return stale.join(counted, PART).select(*[c.split()[0] for c in STATS.split(", ")])


def refresh_stats(spark: SparkSession, path: str) -> None:
    """Bring the statistics up to date; run it after a load."""
    table = stats_table(spark, path)
    table.upsert(_changed(spark, path, table.read()))


def catalog_from_stats(spark: SparkSession, path: str, like: str = "WinEventLog%") -> DataFrame:
    """Event count and first and last time per source type, as ``catalog_summary`` gives it."""
    held = stats_table(spark, path).read()
    valid = held.join(partitions(spark, path), [*PART, "files", "bytes"], "left_semi")
    rows = valid.unionByName(_changed(spark, path, held)).filter(F.lower("sourcetype").like(like.lower()))
    return rows.groupBy("sourcetype").agg(
        F.sum("total").alias("total"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time")
    ).orderBy("sourcetype")
