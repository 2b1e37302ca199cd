"""Lockout lists, frequencies and causes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.scalars import distinct_values, is_blank, nth, time_text
from nightdesk.functions.timerange import TimeRange
from nightdesk.operators.base import newest_first, security


def lockouts(events: DataFrame, time: TimeRange | None = None, ordered: bool = True) -> DataFrame:
    """Every lockout: time, account, source workstation, domain controller."""
    rows = security(events, [vocab.LOCKED_OUT], time).select(
        time_text("_time", vocab.SECOND).alias("lockout_time"),
        nth("Account_Name", 0).alias("locked_account"),
        nth("Caller_Computer_Name", 0).alias("locked_by_host"),
        F.col("host").alias("dc_host"),
    )
    return newest_first(rows, "lockout_time", ordered)


def lockout_frequency(events: DataFrame, now, days: int = 7, ordered: bool = True) -> DataFrame:
    """Lockouts per account: count, sources, first and last.

    Counts per (account, source) first, so the list aggregate only ever sees
    one row per distinct source of an account.
    """
    base = security(events, [vocab.LOCKED_OUT], TimeRange.last(now, days=days)).select(
        "_time",
        nth("Account_Name", 0).alias("locked_account"),
        nth("Caller_Computer_Name", 0).alias("source_host"),
    )
    per_source = (
        base.filter(F.col("locked_account").isNotNull())
        .groupBy("locked_account", "source_host")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_time").alias("first"), F.max("_time").alias("last"))
    )
    out = per_source.groupBy("locked_account").agg(
        F.sum("n").alias("total_lockouts"),
        F.count("source_host").alias("unique_sources"),
        distinct_values("source_host").alias("workstations"),
        time_text(F.min("first"), vocab.MINUTE).alias("first_lockout"),
        time_text(F.max("last"), vocab.MINUTE).alias("last_lockout"),
    )
    return out.orderBy(F.desc("total_lockouts"), "locked_account") if ordered else out


def top_locked_accounts(events: DataFrame, now, days: int = 7, k: int | None = 10) -> DataFrame:
    """Accounts with the most lockouts."""
    out = (
        security(events, [vocab.LOCKED_OUT], TimeRange.last(now, days=days))
        .select(nth("Account_Name", 0).alias("locked_account"))
        .filter(F.col("locked_account").isNotNull())
        .groupBy("locked_account")
        .agg(F.count(F.lit(1)).alias("lockout_count"))
        .orderBy(F.desc("lockout_count"), "locked_account")
    )
    return out if k is None else out.limit(k)


def recent_lockouts(
    events: DataFrame,
    now,
    hours: int = 4,
    k: int | None = None,
    time: TimeRange | None = None,
    pattern: str | None = vocab.CLOCK,
    compat_text_sort: bool = False,
) -> DataFrame:
    """Latest lockouts, newest first.

    Sorted on the event time; ``compat_text_sort`` sorts on the formatted text
    instead, which goes wrong across midnight or a new year.  ``pattern=None``
    keeps the timestamp itself in the time column.
    """
    shown = F.col("_time") if pattern is None else time_text("_time", pattern)
    rows = security(events, [vocab.LOCKED_OUT], time or TimeRange.last(now, hours=hours)).select(
        "_time",
        shown.alias("lockout_time"),
        nth("Account_Name", 0).alias("locked_account"),
        nth("Caller_Computer_Name", 0).alias("source_workstation"),
        "host",
    )
    first = "lockout_time" if compat_text_sort else "_time"
    rows = rows.orderBy(F.desc(first), "locked_account", "source_workstation", "host")
    return (rows if k is None else rows.limit(k)).drop("_time")


def lockout_sources(events: DataFrame, user: str | None = None, n: int | None = 10) -> DataFrame:
    """Newest ``n`` lockouts of each account with the shown source.

    The rank filter is pushed below the shuffle by the engine (group limit), so
    a hot account sends at most ``n`` rows per task.
    """
    rows = security(events, [vocab.LOCKED_OUT]).select(
        "_time",
        nth("Account_Name", 0).alias("account"),
        nth("Caller_Computer_Name", 0).alias("source"),
        "host",
    )
    rows = rows.filter(F.col("account").isNotNull())
    if user is not None:
        rows = rows.filter(F.lower("account") == user.lower())
    if n is not None:
        newest = Window.partitionBy("account").orderBy(F.desc("_time"), "source", "host")
        rows = rows.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)
    return rows.select(
        "account",
        *(["rank"] if n is not None else []),
        "_time",
        time_text("_time", vocab.SECOND).alias("lockout_time"),
        "source",
        F.when(is_blank("source"), F.lit("(blank — Kerberos or network logon)"))
        .otherwise(F.col("source"))
        .alias("shown_source"),
    )


def lockout_root_cause(events: DataFrame, n: int = 10, compat_oldest: bool = False) -> DataFrame:
    """Likely cause per account from the source of a recent lockout.

    Decides on the newest event.  ``compat_oldest`` decides on the oldest of
    the newest ``n`` events instead.
    """
    if compat_oldest:
        recent = lockout_sources(events, n=n)
        picked = recent.groupBy("account").agg(
            F.max_by("source", "rank").alias("source"),
            F.min("_time").alias("decided_on"),
        )
    else:
        rows = security(events, [vocab.LOCKED_OUT]).select(
            "_time",
            nth("Account_Name", 0).alias("account"),
            nth("Caller_Computer_Name", 0).alias("source"),
            "host",
        )
        # Same pick as rank 1 above, by an aggregate that combines map-side.
        newest = F.max_by(
            F.struct("source"), F.struct("_time", F.col("source").isNull().alias("blank"), "source")
        )
        picked = (
            rows.filter(F.col("account").isNotNull())
            .groupBy("account")
            .agg(newest["source"].alias("source"), F.max("_time").alias("decided_on"))
        )
    cause = (
        F.when(is_blank("source"), F.lit("mobile device or webmail"))
        .when(F.col("source").rlike(vocab.SERVER_SOURCE), F.lit("saved service credential on server"))
        .otherwise(F.lit("saved credential on workstation"))
    )
    return picked.select(
        "account", "source", time_text("decided_on", vocab.SECOND).alias("decided_on"), cause.alias("cause")
    )
