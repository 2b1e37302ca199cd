"""Failed-logon and logon detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.scalars import (
    distinct_values, failure_reason, logon_type_name, logon_type_short, nth, ratio, risk,
    source_ip, time_text,
)
from nightdesk.functions.timerange import TimeRange, bucket
from nightdesk.operators.base import security


def brute_force(
    events: DataFrame,
    span: str = "10 minutes",
    min_failures: int = 5,
    time: TimeRange | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Accounts with many failures in one tumbling window.

    Two aggregates: the first counts per distinct (window, account, address,
    type, reason) with plain hash aggregation, which spreads a hot account over
    tasks and collapses repeats; the second builds the lists from what is left.
    """
    combos = (
        security(events, [vocab.LOGON_FAILED], time)
        .select(
            bucket(span).alias("_window"),
            nth("Account_Name", 1).alias("target_account"),
            logon_type_name().alias("logon_type"),
            failure_reason().alias("reason"),
            source_ip().alias("ip"),
        )
        .filter(F.col("target_account").isNotNull())
        .groupBy("_window", "target_account", "logon_type", "reason", "ip")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = (
        combos.groupBy("_window", "target_account")
        .agg(
            F.sum("n").alias("failure_count"),
            distinct_values("ip").alias("source_ips"),
            distinct_values("logon_type").alias("logon_types"),
            distinct_values("reason").alias("failure_reasons"),
        )
        .filter(F.col("failure_count") >= min_failures)
    )
    out = found.select(
        time_text("_window", vocab.MINUTE).alias("window_start"),
        risk("failure_count").alias("risk"),
        "target_account",
        "failure_count",
        F.size("source_ips").cast("bigint").alias("unique_ips"),
        "source_ips",
        "logon_types",
        "failure_reasons",
    )
    return out.orderBy(F.desc("failure_count"), "window_start", "target_account") if ordered else out


def failure_windows(
    events: DataFrame, span: str = "10 minutes", min_failures: int = 5, time: TimeRange | None = None
) -> DataFrame:
    """Windows over the failure threshold with their source addresses only."""
    return (
        security(events, [vocab.LOGON_FAILED], time)
        .select(
            bucket(span).alias("window_start"),
            nth("Account_Name", 1).alias("target_account"),
            source_ip().alias("ip"),
        )
        .filter(F.col("target_account").isNotNull())
        .groupBy("window_start", "target_account", "ip")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("window_start", "target_account")
        .agg(F.sum("n").alias("failures"), distinct_values("ip").alias("source_ips"))
        .filter(F.col("failures") >= min_failures)
    )


def brute_force_panel(
    events: DataFrame,
    time: TimeRange | None,
    k: int | None = 20,
    span: str = "10 minutes",
    min_failures: int = 5,
) -> DataFrame:
    """Dashboard form of the brute-force list: fewer columns, top ``k``."""
    found = failure_windows(events, span, min_failures, time)
    out = found.orderBy(F.desc("failures"), "window_start", "target_account")
    out = out if k is None else out.limit(k)
    return out.select(
        time_text("window_start", vocab.SHORT_MINUTE).alias("window"),
        risk("failures", default="MEDIUM").alias("risk"),
        "target_account",
        "failures",
        "source_ips",
    )


def password_spray(
    events: DataFrame,
    now=None,
    span: str = "10 minutes",
    min_accounts: int = 5,
    max_ratio: int = 2,
    hours: int = 1,
    ordered: bool = True,
) -> DataFrame:
    """Addresses that try many accounts a few times each in one window.

    ``now=None`` turns the look-back off.  Attempts without a target account
    count as attempts but not as accounts.
    """
    time = None if now is None else TimeRange.last(now, hours=hours)
    per_target = (
        security(events, [vocab.LOGON_FAILED], time)
        .select(bucket(span).alias("_window"), source_ip().alias("source_ip"),
                nth("Account_Name", 1).alias("target_account"))
        .groupBy("_window", "source_ip", "target_account")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = (
        per_target.groupBy("_window", "source_ip")
        .agg(
            F.count("target_account").alias("accounts_targeted"),
            F.sum("n").alias("total_attempts"),
            # One entry per account: attempts have collapsed to one row each before.
            distinct_values("target_account").alias("accounts"),
        )
        .filter(
            (F.col("accounts_targeted") >= min_accounts)
            & (F.col("total_attempts") <= F.col("accounts_targeted") * max_ratio)
        )
    )
    out = found.select(
        "source_ip",
        "accounts_targeted",
        "total_attempts",
        "accounts",
        ratio("total_attempts", "accounts_targeted").alias("spray_ratio"),
        time_text("_window", vocab.MINUTE).alias("window_start"),
    )
    return out.orderBy(F.desc("accounts_targeted"), "window_start", "source_ip") if ordered else out


def failed_logons_by_ip(
    events: DataFrame,
    now,
    k: int | None = 10,
    exclude: Sequence[str] = vocab.LOCAL_ADDRESSES,
    time: TimeRange | None = None,
    with_accounts: bool = True,
) -> DataFrame:
    """Top source addresses by failures, with distinct accounts over all elements.

    The account list is exploded with a weight of one on its first element
    only, so one linear plan gives both the event count and the distinct count;
    the middle aggregate is keyed by (address, account) and spreads a hot address.
    """
    base = security(events, [vocab.LOGON_FAILED], time or TimeRange.last(now, hours=24)).select(
        source_ip().alias("source_ip"), "Account_Name"
    )
    base = base.filter(~F.col("source_ip").isin(list(exclude)))
    if with_accounts:
        out = (
            base.select("source_ip", F.posexplode_outer("Account_Name").alias("pos", "account"))
            .groupBy("source_ip", "account")
            .agg(F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("n"))
            .groupBy("source_ip")
            .agg(F.sum("n").alias("failures"), F.count("account").alias("accounts_targeted"))
        )
    else:
        out = base.groupBy("source_ip").agg(F.count(F.lit(1)).alias("failures"))
    out = out.orderBy(F.desc("failures"), "source_ip")
    return out if k is None else out.limit(k)


def logon_type_breakdown(events: DataFrame, time: TimeRange | None) -> DataFrame:
    """Successful logons by type name."""
    return (
        security(events, [vocab.LOGON], time)
        .select(logon_type_short().alias("logon_type_name"))
        .filter(F.col("logon_type_name").isNotNull())
        .groupBy("logon_type_name")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "logon_type_name")
    )
