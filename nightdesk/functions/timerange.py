"""Time bounds.  ``now`` is always an argument; nothing reads the clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1)


def as_datetime(value: str | date | datetime) -> datetime:
    """Naive wall-clock datetime in the session time zone."""
    if isinstance(value, datetime):
        return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.fromisoformat(value)


def ts_lit(value: str | date | datetime) -> Column:
    """Timestamp literal read in the session time zone, not the driver's."""
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp")


def snap(value: datetime, unit: str | None) -> datetime:
    """Round down to the start of the ``hour`` or ``day``."""
    if unit is None:
        return value
    value = value.replace(minute=0, second=0, microsecond=0)
    return value.replace(hour=0) if unit == "day" else value


@dataclass(frozen=True)
class TimeRange:
    """Half-open range ``[earliest, latest)``."""

    earliest: datetime
    latest: datetime

    @classmethod
    def last(cls, now, *, minutes=0, hours=0, days=0, snap_to: str | None = None) -> "TimeRange":
        """The span before ``now``; ``snap_to`` rounds the lower bound down."""
        end = as_datetime(now)
        start = end - timedelta(minutes=minutes, hours=hours, days=days)
        return cls(snap(start, snap_to), end)

    @classmethod
    def default(cls, now) -> "TimeRange":
        """The time picker's default: 24 hours, lower bound on the hour."""
        return cls.last(now, hours=24, snap_to="hour")

    def covers(self, column: str = "_time") -> Column:
        c = F.col(column)
        return (c >= ts_lit(self.earliest)) & (c < ts_lit(self.latest))


def in_range(df: DataFrame, time_range: TimeRange | None, column: str = "_time") -> DataFrame:
    """Keep rows of the range.

    Where the table carries an ``event_date`` partition column a date predicate
    is added, so whole days are skipped before any file is opened.
    """
    if time_range is None:
        return df
    if "event_date" in df.columns:
        last = time_range.latest - timedelta(microseconds=1)
        df = df.filter(
            F.col("event_date").between(
                F.lit(time_range.earliest.date()), F.lit(last.date())
            )
        )
    return df.filter(time_range.covers(column))


def span_seconds(span: str) -> int:
    """Length of a fixed span such as ``10 minutes`` or ``1 hour``."""
    amount, unit = span.split()
    unit = unit.rstrip("s")
    return int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit]


def bucket(span: str, column: str = "_time") -> Column:
    """Start of the epoch-aligned tumbling bucket."""
    return F.window(F.col(column), span).start


def bucket_bounds(time_range: TimeRange, span: str) -> tuple[int, int]:
    """Epoch seconds of the first bucket in the range, and the bucket count."""
    width = timedelta(seconds=span_seconds(span))
    first = (time_range.earliest - EPOCH) // width
    last = (time_range.latest - timedelta(microseconds=1) - EPOCH) // width
    return first * span_seconds(span), max(0, last - first + 1)
