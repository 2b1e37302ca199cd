"""Single-value tiles and their colour bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.scalars import band
from nightdesk.functions.timerange import TimeRange
from nightdesk.operators.base import security


def count_rows(df: DataFrame, name: str) -> DataFrame:
    """Global count: one row, 0 on empty input."""
    return df.agg(F.count(F.lit(1)).alias(name))


def with_band(df: DataFrame, name: str, limits: Sequence[int] | None = None) -> DataFrame:
    """Add the colour step of a tile value."""
    return df.withColumn("band", band(name, limits or vocab.KPI_BANDS[name]))


def _tile(events: DataFrame, codes: Sequence[str], time: TimeRange | None, name: str) -> DataFrame:
    return with_band(count_rows(security(events, codes, time), name), name)


def kpi_failed_logons(events: DataFrame, now, time: TimeRange | None = None) -> DataFrame:
    return _tile(events, [vocab.LOGON_FAILED], time or TimeRange.last(now, hours=24), "failures")


def kpi_lockouts(events: DataFrame, now, time: TimeRange | None = None) -> DataFrame:
    return _tile(events, [vocab.LOCKED_OUT], time or TimeRange.last(now, hours=24), "lockouts")


def kpi_new_accounts(events: DataFrame, now, time: TimeRange | None = None) -> DataFrame:
    return _tile(events, [vocab.ACCOUNT_CREATED], time or TimeRange.last(now, days=30), "new_accounts")


def kpi_password_resets(events: DataFrame, now, time: TimeRange | None = None) -> DataFrame:
    return _tile(events, [vocab.PASSWORD_RESET], time or TimeRange.last(now, days=7), "resets")


def kpi_policy_changes(events: DataFrame, time: TimeRange) -> DataFrame:
    return _tile(events, vocab.POLICY_CODES, time, "changes")


def kpi_board(events: DataFrame, now) -> DataFrame:
    """All five tiles from one scan: one row per tile with value and band."""
    ranges = {
        "lockouts": ([vocab.LOCKED_OUT], TimeRange.last(now, hours=24)),
        "failures": ([vocab.LOGON_FAILED], TimeRange.last(now, hours=24)),
        "resets": ([vocab.PASSWORD_RESET], TimeRange.last(now, days=7)),
        "new_accounts": ([vocab.ACCOUNT_CREATED], TimeRange.last(now, days=30)),
        "changes": (vocab.POLICY_CODES, TimeRange.default(now)),
    }
    codes = sorted({c for names, _ in ranges.values() for c in names})
    widest = TimeRange(min(t.earliest for _, t in ranges.values()), max(t.latest for _, t in ranges.values()))
    sums = security(events, codes, widest).agg(
        *[
            F.count_if(F.col("EventCode").isin(list(names)) & time.covers()).alias(tile)
            for tile, (names, time) in ranges.items()
        ]
    )
    tiles = F.array(
        *[
            F.struct(F.lit(t).alias("tile"), F.col(t).alias("value"), band(t, vocab.KPI_BANDS[t]).alias("band"))
            for t in ranges
        ]
    )
    return sums.select(F.inline(tiles))
