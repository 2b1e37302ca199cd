"""Shared first step of every security query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.scalars import same_text
from nightdesk.functions.timerange import TimeRange, in_range


def security(
    events: DataFrame,
    codes: Sequence[str] | None = None,
    time: TimeRange | None = None,
    index: str | None = vocab.SECURITY_INDEX,
    sourcetype: str | None = vocab.SECURITY_SOURCETYPE,
    account: str | None = None,
) -> DataFrame:
    """Security events of the given codes and time range.

    Names compare without case.  ``account`` is the optional dashboard filter:
    a ``*`` wildcard over every element of ``Account_Name``.
    """
    if index is not None:
        events = events.filter(same_text("index", index))
    if sourcetype is not None:
        events = events.filter(same_text("sourcetype", sourcetype))
    if codes is not None:
        events = events.filter(F.col("EventCode").isin(list(codes)))
    events = in_range(events, time)
    if account is not None and account != "*":
        pattern = account.lower().replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%")
        events = events.filter(F.exists("Account_Name", lambda name: F.lower(name).like(pattern)))
    return events


def newest_first(df: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    """Descending by ``column`` with the other columns as a stable tie-break."""
    if not ordered:
        return df
    return df.orderBy(F.desc(column), *[c for c in df.columns if c != column])
