"""Web-traffic tiles, charts and lists over parsed access lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightdesk.functions.scalars import to_number
from nightdesk.functions.timerange import TimeRange, in_range
from nightdesk.operators.kpi import count_rows, with_band
from nightdesk.operators.timechart import timechart


def _day(web: DataFrame, now) -> DataFrame:
    return in_range(web, TimeRange.last(now, hours=24))


def _errors(web: DataFrame) -> DataFrame:
    return web.filter(to_number("status") >= 400)


def kpi_requests(web: DataFrame, now) -> DataFrame:
    return count_rows(_day(web, now), "requests")


def kpi_http_errors(web: DataFrame, now) -> DataFrame:
    return with_band(count_rows(_errors(_day(web, now)), "http_errors"), "http_errors")


def kpi_unique_clients(web: DataFrame, now) -> DataFrame:
    return _day(web, now).agg(F.countDistinct("client_ip").alias("clients"))


def kpi_portal_hits(web: DataFrame, now) -> DataFrame:
    """Requests under ``/scp/`` or of exactly ``/``."""
    uri = F.lower("uri")
    return count_rows(_day(web, now).filter(uri.like("/scp/%") | (uri == "/")), "hits")


def requests_by_class(web: DataFrame, now, span: str = "30 minutes") -> DataFrame:
    time = TimeRange.last(now, hours=24)
    return timechart(in_range(web, time), span, time, "status_class")


def top_uris(web: DataFrame, now, k: int | None = 10) -> DataFrame:
    out = (
        _day(web, now)
        .filter(F.col("uri").isNotNull())
        .groupBy("uri")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "uri")
    )
    return out if k is None else out.limit(k)


def status_breakdown(web: DataFrame, now) -> DataFrame:
    return (
        _day(web, now)
        .filter(F.col("status").isNotNull())
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "status")
    )


def recent_errors(web: DataFrame, now, k: int | None = 20) -> DataFrame:
    out = (
        _errors(_day(web, now))
        .select("_time", "client_ip", "method", "uri", "status")
        .orderBy(F.desc("_time"), "client_ip", "method", "uri", "status")
    )
    return out if k is None else out.limit(k)
