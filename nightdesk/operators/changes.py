"""Policy, account and group changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.scalars import (
    distinct_values, label, matches, nth, same_text, time_text, yes_no,
)
from nightdesk.functions.timerange import TimeRange
from nightdesk.operators.base import newest_first, security


PANEL_ROWS = 15


def _actor():
    return nth("Subject_Account_Name", 0)


def gpo_changes(events: DataFrame, time: TimeRange | None = None, ordered: bool = True) -> DataFrame:
    """Changes to group-policy containers with old and new values."""
    rows = (
        security(events, vocab.OBJECT_CODES, time)
        .filter(same_text("Object_Class", "groupPolicyContainer"))
        .select(
            time_text("_time", vocab.SECOND).alias("change_time"),
            label("EventCode", vocab.GPO_CHANGE_TYPES, "Unknown").alias("change_type"),
            _actor().alias("changed_by"),
            nth("Subject_Account_Domain", 0).alias("changed_by_domain"),
            nth("Object_DN", 0).alias("gpo_name"),
            F.coalesce("LDAP_Display_Name", F.lit("N/A")).alias("attribute"),
            F.coalesce("Old_Value", F.lit("(new)")).alias("old_value"),
            F.coalesce("New_Value", F.lit("(deleted)")).alias("new_value"),
            F.col("host").alias("dc_host"),
        )
    )
    return newest_first(rows, "change_time", ordered)


def audit_policy_changes(events: DataFrame, time: TimeRange | None = None) -> DataFrame:
    """Direct changes of the audit policy."""
    return security(events, [vocab.AUDIT_POLICY_CHANGED], time).select(
        time_text("_time", vocab.SECOND).alias("change_time"),
        "host",
        _actor().alias("changed_by"),
        F.col("Policy_Change").alias("policy_name"),
    )


def policy_changes_by_unexpected_actor(
    events: DataFrame,
    time: TimeRange | None = None,
    allow: str = vocab.EXPECTED_ACTOR,
    ordered: bool = True,
) -> DataFrame:
    """Policy changes per actor outside the allow pattern; unknown actors drop."""
    per_code = (
        security(events, vocab.POLICY_CODES, time)
        .select("_time", "EventCode", _actor().alias("actor"))
        .filter(~matches("actor", allow))
        .groupBy("actor", "EventCode")
        .agg(F.count(F.lit(1)).alias("n"), F.max("_time").alias("last"))
    )
    out = per_code.groupBy("actor").agg(
        F.sum("n").alias("changes"),
        distinct_values("EventCode").alias("event_codes"),
        time_text(F.max("last"), vocab.SECOND).alias("last_seen"),
    )
    return out.orderBy(F.desc("changes"), "actor") if ordered else out


def policy_changes(
    events: DataFrame,
    now,
    labels: str = "file",
    time: TimeRange | None = None,
    k: int | None = None,
    compat_text_sort: bool = False,
) -> DataFrame:
    """The ``k`` most recent policy changes (default: all); ``labels`` picks wording and columns.

    ``panel`` adds the changed object or policy; the panel itself shows ``PANEL_ROWS`` of them.
    """
    time = time or TimeRange.last(now, hours=24)
    panel = labels == "panel"
    rows = security(events, vocab.POLICY_CODES, time).select(
        "_time",
        time_text("_time", vocab.SHORT_MINUTE if panel else vocab.MINUTE).alias("ev_time"),
        label("EventCode", vocab.POLICY_LABELS[labels], "Unknown").alias("change_type"),
        _actor().alias("actor"),
        F.coalesce(nth("Object_DN", 0), F.col("Policy_Change"), F.lit("N/A")).alias("obj"),
        "host",
    )
    first = "ev_time" if compat_text_sort else "_time"
    rows = rows.orderBy(F.desc(first), "change_type", "actor", "obj", "host")
    rows = rows if k is None else rows.limit(k)
    columns = ["ev_time", "change_type", "actor", *(["obj"] if panel else []), "host"]
    return rows.select(*columns)


def new_accounts(
    events: DataFrame,
    time: TimeRange | None = None,
    pattern: str = vocab.PRIVILEGED_NAME,
    ordered: bool = True,
) -> DataFrame:
    """Created accounts, flagged when the name looks privileged."""
    account = nth("Target_Account_Name", 0)
    rows = security(events, [vocab.ACCOUNT_CREATED], time).select(
        time_text("_time", vocab.SECOND).alias("create_time"),
        account.alias("new_account"),
        _actor().alias("created_by"),
        nth("Subject_Account_Domain", 0).alias("created_by_dom"),
        yes_no(matches(account, pattern), vocab.YES_FLAG, "No").alias("is_privileged"),
        F.col("host").alias("dc_host"),
    )
    return newest_first(rows, "create_time", ordered)


def new_accounts_panel(events: DataFrame, now, days: int = 30) -> DataFrame:
    """Dashboard form of the created accounts of the last days."""
    account = nth("Target_Account_Name", 0)
    rows = security(events, [vocab.ACCOUNT_CREATED], TimeRange.last(now, days=days)).select(
        "_time",
        time_text("_time", vocab.MINUTE).alias("create_time"),
        account.alias("new_account"),
        _actor().alias("created_by"),
        yes_no(matches(account, vocab.PRIVILEGED_NAME), vocab.YES_FLAG_PANEL, "No").alias("priv_flag"),
        "host",
    )
    return newest_first(rows, "_time").drop("_time")


def new_accounts_by_day(events: DataFrame, now, days: int = 30) -> DataFrame:
    """Created accounts per date with account and creator lists."""
    pairs = (
        security(events, [vocab.ACCOUNT_CREATED], TimeRange.last(now, days=days))
        .select(
            time_text("_time", vocab.DAY).alias("create_date"),
            nth("Target_Account_Name", 0).alias("account"),
            _actor().alias("creator"),
        )
        .groupBy("create_date", "account", "creator")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        pairs.groupBy("create_date")
        .agg(
            F.sum("n").alias("total"),
            distinct_values("account").alias("accounts"),
            distinct_values("creator").alias("created_by"),
        )
        .orderBy(F.desc("create_date"))
    )


def account_lifecycle(events: DataFrame, time: TimeRange | None = None, ordered: bool = True) -> DataFrame:
    """Created, enabled, changed, reset, deleted and unlocked accounts."""
    rows = security(events, vocab.LIFECYCLE_CODES, time).select(
        time_text("_time", vocab.SECOND).alias("ev_time"),
        label(
            "EventCode", vocab.LIFECYCLE_LABELS, F.concat(F.lit("EventCode "), F.col("EventCode"))
        ).alias("event_desc"),
        nth("Target_Account_Name", 0).alias("target"),
        _actor().alias("actor"),
        "host",
    )
    return newest_first(rows, "ev_time", ordered)


def high_privilege_group_adds(
    events: DataFrame,
    time: TimeRange | None = None,
    pattern: str = vocab.PRIVILEGED_GROUP,
    ordered: bool = True,
) -> DataFrame:
    """Members added to high-privilege groups."""
    group = nth("Target_Account_Name", 0)
    rows = (
        security(events, vocab.GROUP_ADD_CODES, time)
        .select(
            time_text("_time", vocab.SECOND).alias("ev_time"),
            nth("Member_Account_Name", 0).alias("member_added"),
            group.alias("added_to_group"),
            yes_no(matches(group, pattern), vocab.HIGH_PRIVILEGE, "Standard").alias("is_high_priv"),
            _actor().alias("performed_by"),
            "host",
        )
        .filter(F.col("is_high_priv") == vocab.HIGH_PRIVILEGE)
    )
    return newest_first(rows, "ev_time", ordered)


def group_changes(
    events: DataFrame, now, days: int = 7, flag: bool = False, compat_text_sort: bool = False
) -> DataFrame:
    """Members added to groups; ``flag`` gives the panel form with a risk column."""
    group = nth("Target_Account_Name", 0)
    high = yes_no(matches(group, vocab.PRIVILEGED_GROUP), vocab.HIGH_PRIVILEGE_PANEL, "Standard")
    rows = security(events, vocab.GROUP_ADD_CODES, TimeRange.last(now, days=days)).select(
        "_time",
        time_text("_time", vocab.SHORT_MINUTE if flag else vocab.MINUTE).alias("ev_time"),
        nth("Member_Account_Name", 0).alias("member"),
        group.alias("grp"),
        *([high.alias("is_high_priv")] if flag else []),
        _actor().alias("actor"),
        "host",
    )
    return newest_first(rows, "ev_time" if compat_text_sort else "_time").drop("_time")
