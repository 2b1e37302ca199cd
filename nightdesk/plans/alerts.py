"""The five alerts: searches, schedules, suppression and texts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.scalars import (
    distinct_values, label, left_lookup, matches, nth, risk, source_ip, time_text, to_number, yes_no,
)
from nightdesk.functions.timerange import TimeRange, bucket
from nightdesk.operators.base import security
from nightdesk.operators.suppression import suppress


@dataclass(frozen=True)
class AlertSpec:
    """One alert.  Times are minutes; ``mute_minutes=None`` means no suppression."""

    name: str
    title: str
    codes: tuple[str, ...]
    search: Callable[..., DataFrame]
    severity: int
    period: int
    lookback: int
    key: str
    subject: str
    message: str
    mute_minutes: int | None = None
    quantity: int = 0

    @property
    def cron(self) -> str:
        return "0 * * * *" if self.period == 60 else f"*/{self.period} * * * *"

    @property
    def overlap(self) -> int:
        """Minutes two runs share: how late an event may arrive and still be seen."""
        return self.lookback - self.period

    @property
    def watermark(self) -> str:
        return f"{self.overlap} minutes"

    @property
    def trigger(self) -> str:
        return f"{self.period} minutes"


# --- searches: (events, time, carry) -> rows; ``carry`` columns ride along ----------


def search_lockout(events: DataFrame, time: TimeRange | None = None, carry=()) -> DataFrame:
    return security(events, [vocab.LOCKED_OUT], time).select(
        *carry,
        "_time",
        nth("Account_Name", 0).alias("locked_account"),
        nth("Caller_Computer_Name", 0).alias("source_workstation"),
        "host",
    )


def search_brute_force(
    events: DataFrame, time: TimeRange | None = None, carry=(), span: str = "10 minutes", min_failures: int = 5
) -> DataFrame:
    return (
        security(events, [vocab.LOGON_FAILED], time)
        .select(*carry, bucket(span).alias("_bucket"), nth("Account_Name", 1).alias("target_account"),
                source_ip().alias("ip"))
        .filter(F.col("target_account").isNotNull())
        .groupBy(*carry, "_bucket", "target_account", "ip")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*carry, F.col("_bucket").alias("_time"), "target_account")
        .agg(F.sum("n").alias("failure_count"), distinct_values("ip").alias("source_ips"))
        .filter(F.col("failure_count") >= min_failures)
        .withColumn("risk", risk("failure_count", default="MEDIUM"))
    )


def search_policy_change(events: DataFrame, time: TimeRange | None = None, carry=()) -> DataFrame:
    actor = nth("Subject_Account_Name", 0)
    return security(events, vocab.POLICY_CODES, time).filter(~matches(actor, vocab.EXPECTED_ACTOR_ALERT)).select(
        *carry,
        "_time",
        label("EventCode", vocab.POLICY_LABELS["alert"], "Unknown").alias("change_type"),
        actor.alias("actor"),
        nth("Object_DN", 0).alias("gpo_dn"),
        "host",
    )


def search_new_account(events: DataFrame, time: TimeRange | None = None, carry=()) -> DataFrame:
    account = nth("Target_Account_Name", 0)
    return security(events, [vocab.ACCOUNT_CREATED], time).select(
        *carry,
        "_time",
        account.alias("new_account"),
        nth("Subject_Account_Name", 0).alias("created_by"),
        yes_no(matches(account, vocab.PRIVILEGED_NAME_ALERT), "YES", "No").alias("is_privileged"),
        "host",
    )


def lookup_output_new(df: DataFrame, lookup: DataFrame, on: str, key: str, output: str) -> DataFrame:
    """Left lookup that fills ``output`` only where the row does not have it yet.

    The lookup is reduced to one row per key, so it can never multiply rows.
    """
    one = lookup.groupBy(F.col(key).alias("_key")).agg(F.min(output).alias("_new"))
    joined = left_lookup(df, on, one, "_key")
    current = F.coalesce(F.col(output), F.col("_new")) if output in df.columns else F.col("_new")
    return joined.withColumn(output, current).drop("_new")


def after_hours(time: str = "_time", hours: tuple[int, int] = vocab.BUSINESS_HOURS) -> Column:
    hour = to_number(time_text(time, vocab.HOUR))
    return (hour < hours[0]) | (hour >= hours[1])


def search_after_hours_admin(
    events: DataFrame, time: TimeRange | None = None, carry=(), admins: DataFrame | None = None,
    pattern: str = vocab.KNOWN_ADMIN,
) -> DataFrame:
    rows = (
        security(events, [vocab.LOGON, vocab.LOGON_EXPLICIT], time)
        .filter(after_hours())
        .select(*carry, "_time", nth("Account_Name", 1).alias("actor"), "WorkstationName", "IpAddress", "host")
    )
    if admins is None:
        rows = rows.filter(matches("actor", pattern))
    else:
        rows = lookup_output_new(rows, admins, "actor", "username", "is_admin")
        rows = rows.filter((F.col("is_admin") == "true") | matches("actor", pattern)).drop("is_admin")
    return rows.withColumn("logon_time", time_text("_time", vocab.SECOND))


ALERTS = {
    spec.name: spec
    for spec in [
        AlertSpec(
            "lockout", "Account Lockout Detected", (vocab.LOCKED_OUT,), search_lockout, 3, 5, 6,
            "locked_account",
            "[ALERT] AD Account Locked Out: $result.locked_account$",
            "Account $result.locked_account$ was locked out on $result.host$ "
            "from $result.source_workstation$ at $result._time$.",
            mute_minutes=5,
        ),
        AlertSpec(
            "brute_force", "Brute Force Login Attempt", (vocab.LOGON_FAILED,), search_brute_force, 4, 10, 12,
            "target_account",
            "[ALERT $result.risk$] Brute Force Detected: $result.target_account$",
            "Account $result.target_account$ failed to log on $result.failure_count$ times in 10 minutes "
            "from $result.source_ips$ (risk $result.risk$).",
            mute_minutes=10,
        ),
        AlertSpec(
            "policy_change", "GPO or Audit Policy Changed", tuple(vocab.POLICY_CODES), search_policy_change,
            4, 5, 6, "actor",
            "[ALERT] GPO/AD Policy Change by $result.actor$",
            "$result.change_type$ by $result.actor$ on $result.host$ at $result._time$: $result.gpo_dn$.",
        ),
        AlertSpec(
            "new_account", "New AD User Account Created", (vocab.ACCOUNT_CREATED,), search_new_account,
            3, 5, 6, "new_account",
            "[INFO] New AD Account Created: $result.new_account$",
            "Account $result.new_account$ was created by $result.created_by$ on $result.host$ "
            "at $result._time$ (privileged name: $result.is_privileged$).",
            mute_minutes=1,
        ),
        AlertSpec(
            "after_hours_admin", "After-Hours Admin Logon", (vocab.LOGON, vocab.LOGON_EXPLICIT),
            search_after_hours_admin, 3, 60, 65, "actor",
            "[ALERT] After-Hours Admin Logon: $result.actor$",
            "$result.actor$ logged on from $result.WorkstationName$ ($result.IpAddress$) to $result.host$ "
            "at $result.logon_time$.",
        ),
    ]
}


# --- one scheduled run ---------------------------------------------------------------


def _run(name: str, events: DataFrame, now, **options) -> DataFrame:
    spec = ALERTS[name]
    return spec.search(events, TimeRange.last(now, minutes=spec.lookback), **options)


def alert_lockout(events: DataFrame, now) -> DataFrame:
    return _run("lockout", events, now)


def alert_brute_force(events: DataFrame, now) -> DataFrame:
    return _run("brute_force", events, now)


def alert_policy_change(events: DataFrame, now) -> DataFrame:
    return _run("policy_change", events, now)


def alert_new_account(events: DataFrame, now) -> DataFrame:
    return _run("new_account", events, now)


def alert_after_hours_admin(events: DataFrame, now, admins: DataFrame | None = None) -> DataFrame:
    return _run("after_hours_admin", events, now, admins=admins)


# --- all runs over a history -----------------------------------------------------------


def with_runs(events: DataFrame, spec: AlertSpec) -> DataFrame:
    """Events repeated for every scheduled run whose look-back covers them.

    A run at ``r`` sees ``[r - lookback, r)``; an event in the overlap of two
    runs is seen twice, as it is by the schedule.
    """
    t = F.unix_micros("_time")
    step = spec.period * 60_000_000
    first = (F.floor(t / F.lit(step)) + 1).cast("bigint") * F.lit(step)
    last = t + F.lit(spec.lookback * 60_000_000)
    runs = F.transform(F.sequence(first, last, F.lit(step).cast("bigint")), lambda r: F.timestamp_micros(r))
    return events.select("*", F.explode(runs).alias("run_time"))


def scheduled_results(events: DataFrame, spec: AlertSpec, **options) -> DataFrame:
    """Result rows of every scheduled run, with the run's time."""
    narrow = security(events, list(spec.codes))
    return spec.search(with_runs(narrow, spec), None, carry=("run_time",), **options)


def triggered(results: DataFrame, quantity: int = 0, by: str = "run_time") -> DataFrame:
    """Runs that fire: more than ``quantity`` result rows, with the row count."""
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("events")).filter(F.col("events") > quantity)


def alert_history(events: DataFrame, spec: AlertSpec, **options) -> DataFrame:
    """Alert rows over all events, with the alert's suppression applied."""
    rows = spec.search(events, None, **options)
    if spec.mute_minutes is None:
        return rows
    return suppress(rows, spec.key, spec.mute_minutes * 60)


# --- texts and the alert record ----------------------------------------------------------

_TOKEN = re.compile(r"\$result\.(\w+)\$")


def render(df: DataFrame, template: str) -> Column:
    """Text of a template whose ``$result.field$`` tokens take the row's values.

    Lists are joined by a comma; a null or missing field gives empty text.
    """
    types = dict(df.dtypes)
    pieces: list[Column] = []
    for i, part in enumerate(_TOKEN.split(template)):
        if i % 2 == 0:
            pieces.append(F.lit(part))
        elif part in types:
            value = F.array_join(part, ", ") if types[part].startswith("array") else F.col(part).cast("string")
            if types[part] == "timestamp":
                value = time_text(part, vocab.SECOND)
            pieces.append(F.coalesce(value, F.lit("")))
    return F.concat(*pieces)


def severity_name(severity: Column) -> Column:
    return label(severity, vocab.SEVERITY)


def alert_records(rows: DataFrame, spec: AlertSpec, *more: Column) -> DataFrame:
    """Triggered-alert rows for the alert log, with further columns if any."""
    return rows.select(
        F.lit(spec.name).alias("alert"),
        F.lit(spec.severity).alias("severity"),
        F.col(spec.key).alias("key"),
        F.col("_time").alias("fired_at"),
        render(rows, spec.subject).alias("subject"),
        render(rows, spec.message).alias("message"),
        *more,
    )


def alert_catalog(spark) -> DataFrame:
    """Schedule, look-back, overlap and severity of every alert."""
    rows = [
        (s.name, s.title, s.cron, s.period, s.lookback, s.overlap, s.severity, vocab.SEVERITY[s.severity],
         s.mute_minutes, s.key)
        for s in ALERTS.values()
    ]
    return spark.createDataFrame(
        rows,
        "alert string, title string, cron string, period int, lookback int, overlap int, severity int, "
        "severity_name string, mute_minutes int, key string",
    )
