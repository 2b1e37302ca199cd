"""Text log sources and the transforms bound to a source type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.parsing import parse_access, parse_audit, parse_install
from nightdesk.functions.timerange import TimeRange

AUDIT_SOURCETYPE = "helpdesk_audit"
INSTALL_SOURCETYPE = "agent_install"


def raw_line(lines: DataFrame) -> DataFrame:
    """No field extraction: the raw text stays the only event field."""
    return lines.withColumnRenamed("value", "_raw")


TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {
    vocab.ACCESS_SOURCETYPE: parse_access,
    vocab.ERROR_SOURCETYPE: raw_line,
    vocab.SYSLOG_SOURCETYPE: raw_line,
    AUDIT_SOURCETYPE: parse_audit,
    INSTALL_SOURCETYPE: parse_install,
}


def register(sourcetype: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Bind an extraction to a source type; it is applied on every read."""
    TRANSFORMS[sourcetype] = transform


def apply_sourcetype(lines: DataFrame, sourcetype: str, time: TimeRange | None = None) -> DataFrame:
    """The fields of a source type; access lines outside ``time`` go before they are parsed."""
    transform = TRANSFORMS.get(sourcetype, raw_line)
    return transform(lines, time=time) if transform is parse_access else transform(lines)


def _tagged(lines: DataFrame, sourcetype: str, index: str, host: str | None) -> DataFrame:
    return lines.withColumns(
        {
            "index": F.lit(index),
            "sourcetype": F.lit(sourcetype),
            "host": F.lit(host).cast("string"),
            "source": F.col("_metadata.file_path"),
        }
    )


def read_lines(
    spark: SparkSession,
    path: str,
    sourcetype: str,
    index: str = vocab.WEB_INDEX,
    host: str | None = vocab.WEB_HOST,
) -> DataFrame:
    """One event per line of the text files under ``path``."""
    return apply_sourcetype(_tagged(spark.read.text(path), sourcetype, index, host), sourcetype)


def stream_lines(
    spark: SparkSession,
    path: str,
    sourcetype: str,
    index: str = vocab.WEB_INDEX,
    host: str | None = vocab.WEB_HOST,
) -> DataFrame:
    """Streaming twin of :func:`read_lines` over a folder of rolled files."""
    lines = spark.readStream.text(path)
    return apply_sourcetype(_tagged(lines, sourcetype, index, host), sourcetype)


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, vocab.ACCESS_SOURCETYPE)


def read_error_log(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, vocab.ERROR_SOURCETYPE)


def read_syslog(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, vocab.SYSLOG_SOURCETYPE, host=None)


def read_helpdesk_log(spark: SparkSession, folder: str) -> DataFrame:
    """All monthly audit files of a folder."""
    return read_lines(spark, f"{folder.rstrip('/')}/helpdesk-*.log", AUDIT_SOURCETYPE, "helpdesk", None)
