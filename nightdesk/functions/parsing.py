"""Text to fields: access lines, audit lines, event XML, directory names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.scalars import status_class, to_number
from nightdesk.functions.timerange import TimeRange, in_range

_MARK = "\u0001"
_BRACKET_TIME = r"^[^\[]*\[(\d{1,2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})"

AUDIT_LINE = r"^\[([^\]]+)\]\[(\w+)\](?: \[TKT:([^\]]*)\])? \[([^\]]*)\] (.*)"
INSTALL_LINE = r"^\[([^\]]+)\]\[(\w+)\]\s*(?:\[[^\]]*\]\s*)?(.*)"
ACTION_TEXT = r"^ACTION:\s*([^|]*?)\s*(?:\|\s*(.*))?$"


def capture(lines: DataFrame, column: str, pattern: str, names: list[str]) -> DataFrame:
    """The groups of ``pattern`` as text columns; null where a line does not match.

    One regex pass per line: the match (extended to the end of the line) is
    rewritten to a separated row, which is then split.  Lines that hold the
    separator themselves take the field-by-field route, which stays out of the
    plan for fields a query does not read.  The text itself stays as ``_raw``.
    """
    line, raw, parts = F.col(column), F.col("_raw"), F.col("_parts")
    groups = _MARK + _MARK.join(f"${i}" for i in range(1, len(names) + 1))
    row = F.split(F.regexp_replace(line, f"(?s){pattern}.*", groups), _MARK)
    keep = [c for c in lines.columns if c != column]
    split = lines.select(*keep, line.alias("_raw"), once(row).alias("_parts"))

    def field(i: int) -> Column:
        odd = F.when(raw.rlike(pattern), F.regexp_extract(raw, pattern, i))
        even = F.when(F.size(parts) == len(names) + 1, F.get(parts, i))
        return F.when(raw.contains(_MARK), odd).otherwise(even)

    return split.select(*keep, "_raw", *[field(i + 1).alias(name) for i, name in enumerate(names)])


def once(c: Column) -> Column:
    """Evaluate a costly expression once per row.

    As a generator of one element it cannot be copied into every filter and
    projection that refers to it.
    """
    return F.explode(F.array(c))


def access_time(line: Column) -> Column:
    """Event time: the first bracketed stamp of the raw line."""
    return F.try_to_timestamp(F.regexp_extract(line, _BRACKET_TIME, 1), F.lit(vocab.ACCESS_TIME))


def access_times(lines: DataFrame, time: TimeRange | None = None, column: str = "value") -> DataFrame:
    """Access lines of a range as ``_raw`` with their ``_time``; no field is parsed."""
    return in_range(lines.withColumnRenamed(column, "_raw").withColumn("_time", access_time(F.col("_raw"))), time)


def parse_access(lines: DataFrame, column: str = "value", time: TimeRange | None = None) -> DataFrame:
    """Combined-format access lines to nine text fields, ``_time`` and ``status_class``.

    Lines the pattern does not match keep null fields; the time is read from
    the first bracketed stamp of any line, and only lines of the range are parsed.
    """
    kept = access_times(lines, time, column).withColumnRenamed("_raw", column)
    return capture(kept, column, vocab.ACCESS_LINE, vocab.ACCESS_FIELDS).withColumns(
        {
            "bytes_sent": to_number("bytes", "bigint"),
            "status_class": status_class("status"),
        }
    )


EVENT_XML = """
    System struct<EventID: string>,
    EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>
"""


def parse_event_xml(df: DataFrame, column: str = "xml", alias: str = "event") -> DataFrame:
    """Parse each event document once; read single values with :func:`event_data`."""
    return df.select("*", once(F.from_xml(column, EVENT_XML)).alias(alias))


def event_data(name: str, event: str = "event") -> Column:
    """Text of the first ``Data`` element of that name; empty when blank or absent."""
    named = F.filter(F.col(f"{event}.EventData.Data"), lambda item: item["_Name"] == name)
    return F.coalesce(F.get(named, 0)["_VALUE"], F.lit(""))


def xml_data(xml: Column | str, name: str) -> Column:
    """One named ``Data`` value by XPath; for several values parse once instead."""
    return F.xpath_string(xml, F.lit(f"//Data[@Name='{name}']"))


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def action_name(message: Column | str) -> Column:
    message = F.col(message) if isinstance(message, str) else message
    return F.when(message.startswith("ACTION:"), _group(message, ACTION_TEXT, 1))


def action_fields(message: Column | str) -> Column:
    """``K=V | K=V`` tail of an action message as a map; null without a tail.

    A key that repeats keeps its first value: building the map from raw text
    would fail the whole job on one odd line.
    """
    message = F.col(message) if isinstance(message, str) else message
    tail = F.when(message.startswith("ACTION:"), _group(message, ACTION_TEXT, 2))
    pairs = F.split(tail, r"\s*\|\s*")
    keys = F.transform(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            F.split_part(p, F.lit("="), F.lit(1)).alias("key"),
            F.when(p.contains("="), F.regexp_replace(p, r"^[^=]*=", "")).alias("value"),
        ),
    )
    return F.map_from_entries(
        F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    )


def _stamp(c: str) -> Column:
    return F.try_to_timestamp(F.col(c), F.lit(vocab.SECOND))


def parse_audit(lines: DataFrame, column: str = "value") -> DataFrame:
    """Helpdesk audit lines to ts, level, ticket, agent, message, action, kv."""
    parts = capture(lines, column, AUDIT_LINE, ["ts", "level", "ticket", "agent", "message"])
    return parts.withColumns(
        {
            "ts": _stamp("ts"),
            "ticket": F.nullif("ticket", F.lit("")),
            "action": action_name("message"),
            "kv": action_fields("message"),
        }
    )


def parse_install(lines: DataFrame, column: str = "value") -> DataFrame:
    """Agent-installer lines: no agent field, padding after the level allowed."""
    parts = capture(lines, column, INSTALL_LINE, ["ts", "level", "message"])
    return parts.withColumn("ts", _stamp("ts"))


def prefix_level(message: Column | str) -> Column:
    """Log level carried by a message's bracketed prefix."""
    message = F.col(message) if isinstance(message, str) else message
    return (
        F.when(message.rlike(r"^\[OK\]"), F.lit("OK"))
        .when(message.rlike(r"^\[(WARN|EXISTS)\]"), F.lit("WARN"))
        .when(message.rlike(r"^\[(FAIL|MISSING)\]"), F.lit("ERROR"))
        .otherwise(F.lit("INFO"))
    )


def line_level(line: Column | str) -> Column:
    """Level class of a whole audit line, INFO when none is marked."""
    line = F.col(line) if isinstance(line, str) else line
    branch = F
    for level in ["OK", "WARN", "ERROR", "ACTION"]:
        branch = branch.when(line.contains(f"[{level}]"), F.lit(level))
    return branch.otherwise(F.lit("INFO"))


def dn_name(dn: Column | str) -> Column:
    return _group(F.col(dn) if isinstance(dn, str) else dn, r"^OU=([^,]+),(.*)$", 1)


def dn_parent(dn: Column | str) -> Column:
    return _group(F.col(dn) if isinstance(dn, str) else dn, r"^OU=([^,]+),(.*)$", 2)
