"""Helpdesk log views and endpoint evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.parsing import event_data, line_level, parse_event_xml
from nightdesk.functions.scalars import matches
from nightdesk.functions.timerange import TimeRange, ts_lit


def recent_log(log: DataFrame, n: int = 40) -> DataFrame:
    """Last ``n`` audit lines with their level class.

    ``log`` is a parsed log; a ``line_no`` column, when present, orders lines
    of the same second.
    """
    tie = ["line_no"] if "line_no" in log.columns else []
    return (
        log.withColumn("level_class", line_level("_raw"))
        .orderBy(F.desc("ts"), *[F.desc(c) for c in tie], F.desc("_raw"))
        .limit(n)
        .select("ts", *tie, "level_class", F.col("_raw").alias("line"))
    )


def action_counts(log: DataFrame) -> DataFrame:
    """Actions per agent, ticket and kind."""
    return (
        log.filter(F.col("action").isNotNull())
        .groupBy("agent", "ticket", "action")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("agent", "ticket", "action")
    )


def recent_app_errors(
    app_events: DataFrame, pattern: str = vocab.OFFICE_SOURCE, n: int = 20
) -> DataFrame:
    """Of the newest ``n`` error records, those whose source matches.

    The limit comes first: older matches are not brought in to fill the list.
    """
    newest = (
        app_events.filter(F.lower("entry_type") == "error")
        .orderBy(F.desc("time_generated"), "source", "message")
        .limit(n)
    )
    return newest.filter(matches("source", pattern)).select("time_generated", "source", "event_id", "message")


def recent_hotfixes(hotfix: DataFrame, now, days: int = 7) -> DataFrame:
    """Updates installed after the cut-off, newest first."""
    cutoff = TimeRange.last(now, days=days).earliest
    return hotfix.filter(F.col("installed_on") > ts_lit(cutoff)).orderBy(F.desc("installed_on"), "id")


def crash_files(files: DataFrame, pattern: str = r"(?i)\.dmp$") -> DataFrame:
    """File listing filtered by path, newest first."""
    return files.filter(matches("path", pattern)).orderBy(F.desc("last_write"), "path")


def lockout_xml(xml_events: DataFrame, user: str | None = None, n: int | None = 10) -> DataFrame:
    """Newest lockout documents of a user, read from event XML text."""
    rows = parse_event_xml(xml_events).select(
        "_time",
        F.col("event.System.EventID").alias("event_id"),
        event_data("TargetUserName").alias("user"),
        event_data("CallerComputerName").alias("source"),
    ).filter(F.col("event_id") == vocab.LOCKED_OUT)
    if user is not None:
        rows = rows.filter(F.col("user") == user)
    rows = rows.orderBy(F.desc("_time"), "user", "source")
    return (rows if n is None else rows.limit(n)).drop("event_id")
