"""Column helpers for the field operations the queries use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, LongType, StringType

from nightdesk import vocab


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nth(c: Column | str, i: int) -> Column:
    """Element ``i`` of a multivalue field, null when it is out of range."""
    return F.get(_col(c), i)


def label(c: Column | str, names: Mapping[str, str], default: Column | str | None = None) -> Column:
    """First matching name for a code; ``default`` (or null) otherwise."""
    c = _col(c)
    branch = F
    for code, name in names.items():
        branch = branch.when(c == code, F.lit(name))
    if default is None:
        return branch
    return branch.otherwise(F.lit(default) if isinstance(default, str) else default)


def time_text(c: Column | str, pattern: str) -> Column:
    return F.date_format(_col(c), pattern)


def to_number(c: Column | str, kind: str = "int") -> Column:
    """Numeric value of a text field, null when it does not look numeric."""
    return _col(c).try_cast(kind)


def matches(c: Column | str, pattern: str) -> Column:
    return _col(c).rlike(pattern)


def yes_no(condition: Column, yes: str, no: str) -> Column:
    """``yes`` where the condition holds; null and false both give ``no``."""
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def is_blank(c: Column | str) -> Column:
    c = _col(c)
    return c.isNull() | c.rlike(r"^\s*$")


def distinct_values(c: Column | str) -> Column:
    """Aggregate: sorted distinct non-null values."""
    return F.sort_array(F.collect_set(_col(c)))


def list_text(c: Column | str, separator: str = ", ") -> Column:
    return F.array_join(_col(c), separator)


def date_or(c: Column | str, default: str, pattern: str = vocab.MINUTE) -> Column:
    return F.coalesce(time_text(c, pattern), F.lit(default))


def ratio(a: Column | str, b: Column | str, digits: int = 2) -> Column:
    return F.round(F.try_divide(_col(a).cast("double"), _col(b).cast("double")), digits)


def contains_text(c: Column | str, text: str) -> Column:
    """Case-insensitive ``*text*`` match."""
    return F.lower(_col(c)).contains(text.lower())


def same_text(c: Column | str, text: str) -> Column:
    """Case-insensitive equality, as base searches compare strings."""
    return F.lower(_col(c)) == text.lower()


def band(c: Column | str, limits: Sequence[int]) -> Column:
    """Index of the first limit the value does not exceed; ``len(limits)`` above all."""
    c = _col(c)
    branch = F
    for i, limit in enumerate(limits):
        branch = branch.when(c <= limit, F.lit(i))
    return branch.otherwise(F.lit(len(limits)))


def risk(c: Column | str, bands: Mapping[int, str] = vocab.RISK_BANDS, default: str = "LOW") -> Column:
    c = _col(c)
    branch = F
    for floor, name in sorted(bands.items(), reverse=True):
        branch = branch.when(c >= floor, F.lit(name))
    return branch.otherwise(F.lit(default))


def source_ip(df: DataFrame | None = None) -> Column:
    return F.coalesce(F.col("IpAddress"), F.col("Source_Network_Address"), F.lit("unknown"))


def logon_type_name(c: Column | str = "Logon_Type") -> Column:
    c = _col(c)
    return label(c, vocab.LOGON_TYPES, F.concat(F.lit("Type "), c))


def logon_type_short(c: Column | str = "Logon_Type") -> Column:
    c = _col(c)
    return label(c, vocab.LOGON_TYPES_SHORT, F.concat(F.lit("Other (Type "), c, F.lit(")")))


def failure_reason(status: Column | str = "Status", sub_status: Column | str = "Sub_Status") -> Column:
    """Reason text; the first rule that matches wins.

    A bad-logon status is therefore always "Wrong password": the unknown-user
    sub-status is only reported when the status is something else.
    """
    status, sub = _col(status), _col(sub_status)
    bad_logon = status == vocab.STATUS_BAD_LOGON
    branch = F.when(bad_logon | (sub == vocab.SUB_STATUS_WRONG_PASSWORD), F.lit("Wrong password"))
    branch = branch.when(bad_logon | (sub == vocab.SUB_STATUS_UNKNOWN_USER), F.lit("Unknown username"))
    for code, text in vocab.FAILURE_STATUS.items():
        branch = branch.when(status == code, F.lit(text))
    return branch.otherwise(F.concat(F.lit("Code: "), status, F.lit(" / "), sub))


def status_class(c: Column | str = "status") -> Column:
    number = to_number(c)
    branch = F
    for floor, text in vocab.STATUS_CLASSES.items():
        branch = branch.when(number >= floor, F.lit(text))
    return branch.otherwise(F.lit("Other"))


def ticket_source(c: Column | str = "source") -> Column:
    return label(F.lower(_col(c)), vocab.TICKET_SOURCES, "Other")


def latest_of(expr: Column | str, time: str = "_time") -> Column:
    """Aggregate: value of ``expr`` on the newest row, the largest where several share its time."""
    return F.max_by(_col(expr), F.struct(F.col(time), _col(expr)))


def with_display_names(df: DataFrame, table: str) -> DataFrame:
    """Rename snake_case columns to the labels a report shows."""
    names = vocab.DISPLAY_NAMES[table]
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the smallest by ``order`` and then by the other columns.

    A rank filter of 1 is applied below the shuffle too (group limit), so a hot
    key sends one row per task.  Ordering by every column keeps the pick the
    same when a lost task is computed again.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(list(order) + rest or [F.lit(1)])))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def left_lookup(df: DataFrame, on: str, lookup: DataFrame, key: str) -> DataFrame:
    """Left join of a lookup that has one row per ``key``; the key column is dropped.

    The engine broadcasts the lookup while its size is under the session's
    threshold.  Beyond it both sides shuffle, and a hot key must be split over
    tasks: adaptive execution does that only when each side has a shuffle of
    its own for the join.  A lookup that was just aggregated by its key has
    none, so the key is written as a new expression here, which adds one.  Keys
    keep their type; whole numbers of two widths meet
    as the wider one, other numbers as doubles.
    """
    mine, other = df.select(on).schema[0].dataType, lookup.schema[key].dataType
    kind = other if mine == other else StringType() if StringType() in (mine, other) else DoubleType()
    if isinstance(mine, IntegralType) and isinstance(other, IntegralType):
        kind = LongType()
    wrap = (lambda c: F.concat(c, F.lit(""))) if kind == StringType() else F.struct
    held = lookup.filter(F.col(key).isNotNull())
    right = held.select(wrap(F.col(key).cast(kind)).alias("_lookup"), *[c for c in lookup.columns if c != key])
    return df.join(right, wrap(F.col(on).cast(kind)) == F.col("_lookup"), "left").drop("_lookup")
