"""Writers: alert log, reports, audit lines, ticket tables, reset."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk import vocab


def append_alerts(fired: DataFrame, path: str, run: str) -> None:
    """Add the triggered-alert rows of one run, partitioned by run, alert and date.

    The same run again replaces its own rows and no others.
    """
    (
        fired.withColumns({"run": F.lit(run), "fired_date": F.to_date("fired_at")})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "alert", "fired_date")
        .parquet(path)
    )


#: Reports in one file are parted by a form feed; the two characters are escaped inside of them.
PAGE_END, ESCAPE = "\f", "\x1b"


def write_reports(reports: DataFrame, path: str, mode: str = "append", pooled: bool = False) -> None:
    """Text reports, one folder per employee and date; a refused request has none.

    A folder takes some ten milliseconds to make and one more to list, whatever it holds.  For many employees
    ``pooled`` makes one folder per date, whose files hold one report after the other, each
    a page with its employee on top (:func:`read_reports`).
    """
    rows = reports.filter(F.col("report").isNotNull()).select("username", "report_date", F.col("report").alias("value"))
    if not pooled:
        rows.write.mode(mode).partitionBy("username", "report_date").text(path)
        return
    text = F.replace(F.replace("value", F.lit(ESCAPE), F.lit(f"{ESCAPE}E")), F.lit(PAGE_END), F.lit(f"{ESCAPE}F"))
    head = F.concat(F.lit("username="), F.coalesce(F.url_encode("username"), F.lit("")))
    pages = rows.select("report_date", F.concat(head, F.lit("\n"), text).alias("value"))
    pages.write.mode(mode).option("lineSep", PAGE_END).partitionBy("report_date").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Pooled reports as (username, report_date, value), one row per report; as with folders, an empty name reads as null."""
    pages = spark.read.schema("value string, report_date string").option("lineSep", PAGE_END).text(path)
    head, text = (F.get(F.split("value", "\n", 2), k) for k in (0, 1))
    name = F.url_decode(F.replace(head, F.lit("username="), F.lit("")))
    return pages.select(
        F.nullif(name, F.lit("")).alias("username"),
        "report_date",
        F.replace(F.replace(text, F.lit(f"{ESCAPE}F"), F.lit(PAGE_END)), F.lit(f"{ESCAPE}E"), F.lit(ESCAPE)).alias("value"),
    )


def audit_line(
    ts: Column, level: Column, agent: Column, message: Column, ticket: Column | None = None
) -> Column:
    """Audit text line of the helpdesk log format."""
    tag = F.lit("") if ticket is None else F.coalesce(F.concat(F.lit(" [TKT:"), ticket, F.lit("]")), F.lit(""))
    return F.concat(
        F.lit("["), F.date_format(ts, vocab.SECOND), F.lit("]["), level, F.lit("]"), tag,
        F.lit(" ["), agent, F.lit("] "), message,
    )


def append_audit(lines: DataFrame, path: str) -> None:
    """Append audit lines (one ``value`` column) as text files."""
    lines.select("value").write.mode("append").text(path)


def write_ticket_tables(tables: Mapping[str, DataFrame], folder: str, mode: str = "append") -> None:
    """Write service-desk tables as parquet, one folder each."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def keep_unless(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows a delete by ``predicate`` would leave: false or unknown stay."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))
