"""Zero-filled time charts in long form, and their wide form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.scalars import label, nth
from nightdesk.functions.timerange import TimeRange, bucket, bucket_bounds, span_seconds
from nightdesk.operators.base import security

OTHER = "OTHER"
NULL = "NULL"


def _buckets(first: int, count: int, span: str) -> Column:
    """All bucket starts as an array literal expression."""
    width = span_seconds(span)
    stops = F.sequence(F.lit(first).cast("bigint"), F.lit(first + (count - 1) * width).cast("bigint"),
                       F.lit(width).cast("bigint"))
    return F.transform(stops, lambda s: F.timestamp_seconds(s))


def timechart_count(rows: DataFrame, span: str, time: TimeRange) -> DataFrame:
    """Rows per bucket; buckets of the range without rows give 0."""
    counts = rows.groupBy(bucket(span).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    first, count = bucket_bounds(time, span)
    grid = rows.sparkSession.range(count).select(
        F.timestamp_seconds(F.lit(first) + F.col("id") * span_seconds(span)).alias("bucket")
    )
    return (
        grid.join(counts, "bucket", "left")
        .select("bucket", F.coalesce("n", F.lit(0)).alias("count"))
        .orderBy("bucket")
    )


def timechart(
    rows: DataFrame,
    span: str,
    time: TimeRange,
    series: Column | str,
    limit: int | None = 10,
) -> DataFrame:
    """Rows per (bucket, series), zero-filled, in long form.

    The ``limit`` largest series keep their name, the rest become ``OTHER`` and
    rows without a series ``NULL``.  Rows are counted per (bucket, series) once;
    ranking, relabelling and zero-filling all read that one small exchange, and
    the zero rows come from exploding a bucket sequence per kept label.
    """
    series = F.col(series) if isinstance(series, str) else series
    counts = rows.groupBy(bucket(span).alias("bucket"), series.alias("series")).agg(
        F.count(F.lit(1)).alias("n")
    )
    if limit is None:
        named = counts.withColumn("series", F.coalesce("series", F.lit(NULL)))
    else:
        # Null series sort last and are dropped after the limit, so the counts
        # below stay the same subplan everywhere and are computed once.
        top = (
            counts.groupBy("series")
            .agg(F.sum("n").alias("total"))
            .orderBy(F.col("series").isNull(), F.desc("total"), "series")
            .limit(limit)
            .filter(F.col("series").isNotNull())
            .select("series", F.lit(True).alias("kept"))
        )
        named = counts.join(F.broadcast(top), "series", "left").select(  # at most ``limit`` rows
            "bucket",
            F.when(F.col("series").isNull(), F.lit(NULL))
            .when(F.col("kept"), F.col("series"))
            .otherwise(F.lit(OTHER))
            .alias("series"),
            "n",
        )
    named = named.groupBy("bucket", "series").agg(F.sum("n").alias("n"))
    first, count = bucket_bounds(time, span)
    zeros = (
        named.filter(F.col("n") > 0)
        .select("series")
        .distinct()
        .select(F.explode(_buckets(first, count, span)).alias("bucket"), "series", F.lit(0).cast("bigint").alias("n"))
    )
    return (
        named.unionByName(zeros)
        .groupBy("bucket", "series")
        .agg(F.sum("n").alias("count"))
        .orderBy("bucket", "series")
    )


def wide(chart: DataFrame, series: Sequence[str]) -> DataFrame:
    """One column per named series.  Naming them keeps the plan free of a first pass."""
    return (
        chart.groupBy("bucket")
        .pivot("series", list(series))
        .agg(F.first("count"))
        .na.fill(0)
        .orderBy("bucket")
    )


def event_category(labels: str = "file") -> Column:
    """Timeline category of an event code."""
    code = F.col("EventCode")
    other = F.concat(F.lit("Other (EC:"), code, F.lit(")")) if labels == "file" else "Other"
    return label(code, vocab.TIMELINE_LABELS[labels], other)


def security_timeline(
    events: DataFrame, now, span: str = "1 hour", labels: str = "file", time: TimeRange | None = None
) -> DataFrame:
    """Security events per hour and category over the last 24 hours."""
    time = time or (TimeRange.last(now, hours=24) if labels == "file" else TimeRange.default(now))
    rows = security(events, vocab.TIMELINE_CODES, time)
    return timechart(rows, span, time, event_category(labels))


def unlocks_timeline(events: DataFrame, time: TimeRange, span: str = "4 hours") -> DataFrame:
    """Unlocks per bucket and agent."""
    rows = security(events, [vocab.UNLOCKED], time)
    return timechart(rows, span, time, nth("Subject_Account_Name", 0))


def failed_logons_timeline(events: DataFrame, now, span: str = "1 hour") -> DataFrame:
    """Failed logons per hour over the last 24 hours."""
    time = TimeRange.last(now, hours=24)
    return timechart_count(security(events, [vocab.LOGON_FAILED], time), span, time)
