"""Registered queries: access-log parsing, web traffic, audit text, endpoint evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions import parsing
from nightdesk.functions.timerange import TimeRange
from nightdesk.operators import helpdesk, web
from nightdesk.plans import bridge
from nightdesk.plans.bridge import NOW as T_NOW
from nightdesk.plans.registry import EPOCH, MICRO, NOW, SECOND, WEB, WIN, query, with_
from nightdesk.sources.logs import apply_sourcetype

DAY = TimeRange.last(T_NOW, hours=24)
WITH_WEB = with_(WEB)
DAY_SQL = f"_time >= {NOW} - INTERVAL '24 hours' AND _time < {NOW}"
CLASS = """CASE WHEN status::INTEGER >= 500 THEN '5xx - Server Error' WHEN status::INTEGER >= 400 THEN '4xx - Client Error'
  WHEN status::INTEGER >= 300 THEN '3xx - Redirect' WHEN status::INTEGER >= 200 THEN '2xx - Success' ELSE 'Other' END"""


def parsed(spark, d, time=None):
    """Access lines of the range, parsed by the source type's transform."""
    return apply_sourcetype(bridge.access_lines(spark, d, time), vocab.ACCESS_SOURCETYPE, time)


def timed(spark, d, time=None):
    """Access lines of the range with their time only."""
    return parsing.access_times(bridge.access_lines(spark, d, time), time)


@query("x01_access_fields", WITH_WEB + """SELECT client_ip, '-' AS user, stamp AS timestamp, method, uri, status, bytes,
  TRY_CAST(bytes AS BIGINT) AS bytes_sent, '-' AS referrer, 'ua' AS user_agent FROM web""")
def x01(spark, d):
    return parsed(spark, d).select(*vocab.ACCESS_FIELDS, "bytes_sent")


@query("x02_access_time", WITH_WEB + f"""SELECT strftime(_time, {MICRO}) AS _time, count(*) AS n FROM web GROUP BY 1""")
def x02(spark, d):
    return timed(spark, d).groupBy("_time").agg(F.count(F.lit(1)).alias("n"))


@query("x09_status_class", WITH_WEB + f"""SELECT {CLASS} AS status_class, status, count(*) AS n FROM web GROUP BY ALL""")
def x09(spark, d):
    return parsed(spark, d).groupBy("status_class", "status").agg(F.count(F.lit(1)).alias("n"))


@query("w01_kpi_requests", WITH_WEB + f"SELECT count(*) AS requests FROM web WHERE {DAY_SQL}")
def w01(spark, d):
    return web.kpi_requests(timed(spark, d, DAY), T_NOW)


@query("w02_kpi_http_errors", WITH_WEB + f"""SELECT n AS http_errors, CASE WHEN n <= 0 THEN 0 WHEN n <= 10 THEN 1 ELSE 2 END AS band
  FROM (SELECT count(*) AS n FROM web WHERE {DAY_SQL} AND status::INTEGER >= 400)""")
def w02(spark, d):
    return web.kpi_http_errors(parsed(spark, d, DAY), T_NOW)


@query("w03_kpi_unique_clients", WITH_WEB + f"SELECT count(DISTINCT client_ip) AS clients FROM web WHERE {DAY_SQL}")
def w03(spark, d):
    return web.kpi_unique_clients(parsed(spark, d, DAY), T_NOW)


@query("w04_kpi_portal_hits", WITH_WEB + f"""SELECT count(*) AS hits FROM web WHERE {DAY_SQL} AND (uri LIKE '/scp/%' OR uri = '/')""")
def w04(spark, d):
    return web.kpi_portal_hits(parsed(spark, d, DAY), T_NOW)


@query("w05_requests_by_class", WITH_WEB + f""", named AS (
  SELECT time_bucket(INTERVAL '30 minutes', _time, {EPOCH}) AS bucket, {CLASS} AS series FROM web WHERE {DAY_SQL})
SELECT strftime(g.bucket, {MICRO}) AS bucket, g.series, count(n.series) AS count FROM (
  SELECT bucket, series FROM (SELECT unnest(generate_series({NOW} - INTERVAL '24 hours', {NOW} - INTERVAL '30 minutes',
    INTERVAL '30 minutes')) AS bucket) CROSS JOIN (SELECT DISTINCT series FROM named)) g
LEFT JOIN named n ON n.bucket = g.bucket AND n.series = g.series GROUP BY g.bucket, g.series""")
def w05(spark, d):
    return web.requests_by_class(parsed(spark, d, DAY), T_NOW)


@query("w06_top_uris", WITH_WEB + f"""SELECT uri, count(*) AS count FROM web WHERE {DAY_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def w06(spark, d):
    return web.top_uris(parsed(spark, d, DAY), T_NOW)


@query("w07_status_breakdown", WITH_WEB + f"SELECT status, count(*) AS count FROM web WHERE {DAY_SQL} GROUP BY 1")
def w07(spark, d):
    return web.status_breakdown(parsed(spark, d, DAY), T_NOW)


@query("w08_recent_errors", WITH_WEB + f"""SELECT strftime(_time, {MICRO}) AS _time, client_ip, method, uri, status FROM web
  WHERE {DAY_SQL} AND status::INTEGER >= 400 ORDER BY web._time DESC, 2, 3, 4, 5 LIMIT 20""")
def w08(spark, d):
    return web.recent_errors(parsed(spark, d, DAY), T_NOW)


# --- event XML, audit text ---------------------------------------------------------------------


@query("x03_xml_data", with_(WIN) + """SELECT EventCode AS code, Account_Name[1] AS user, caller AS source, count(*) AS n
  FROM win GROUP BY ALL""")
def x03(spark, d):
    xml = parsing.parse_event_xml(bridge.event_xml(bridge.win_event(spark, d)))
    return xml.groupBy(
        F.col("event.System.EventID").alias("code"),
        parsing.event_data("TargetUserName").alias("user"),
        parsing.event_data("CallerComputerName").alias("source"),
    ).agg(F.count(F.lit(1)).alias("n"))


LOG = """
log AS (
  SELECT event_id AS line_no, date_trunc('second', ts) AS ts,
    CASE WHEN event_id % 5 < 2 THEN 'ACTION' WHEN event_id % 5 = 2 THEN 'OK' WHEN event_id % 5 = 3 THEN 'WARN'
      WHEN event_id % 15 = 4 THEN 'ERROR' ELSE 'INFO' END AS level,
    CASE WHEN event_id % 3 <> 0 THEN (event_id % 100)::VARCHAR END AS ticket,
    'agent' || (user_id % 5)::VARCHAR AS agent,
    CASE WHEN event_id % 5 < 2 THEN CASE event_id % 4 WHEN 0 THEN 'Password reset' WHEN 1 THEN 'Account unlocked'
      WHEN 2 THEN 'Group add' ELSE 'Offboarding complete' END END AS action,
    'user' || user_id::VARCHAR AS usr, event_id
  FROM events
)
"""


@query("x04_audit_line", with_(LOG) + f"""SELECT line_no, strftime(ts, {MICRO}) AS ts, level, ticket, agent, action FROM log""")
def x04(spark, d):
    log = parsing.parse_audit(bridge.audit_lines(spark, d))
    return log.select("line_no", "ts", "level", "ticket", "agent", "action")


@query("x05_action_fields", with_(LOG) + """SELECT action, usr AS usr,
  CASE event_id % 4 WHEN 0 THEN 'HR' WHEN 3 THEN NULL ELSE 'IT' END AS dept,
  CASE event_id % 4 WHEN 2 THEN 'GRP-VPN-Users' END AS grp, CASE event_id % 4 WHEN 3 THEN '3' END AS removed, count(*) AS n
  FROM log WHERE action IS NOT NULL GROUP BY ALL""")
def x05(spark, d):
    log = parsing.parse_audit(bridge.audit_lines(spark, d)).filter(F.col("action").isNotNull())
    kv = {"usr": "User", "dept": "Dept", "grp": "Group", "removed": "GroupsRemoved"}
    return log.groupBy(
        "action", *[F.try_element_at("kv", F.lit(k)).alias(n) for n, k in kv.items()]
    ).agg(F.count(F.lit(1)).alias("n"))


@query("x06_install_line", f"""SELECT strftime(date_trunc('second', ts), {MICRO}) AS ts,
  CASE event_id % 3 WHEN 0 THEN 'INFO' WHEN 1 THEN 'OK' ELSE 'WARN' END AS level, 'step ' || event_id::VARCHAR AS message FROM events""")
def x06(spark, d):
    e = F.col("event_id")
    level = F.when(e % 3 == 0, F.lit("INFO")).when(e % 3 == 1, F.lit("OK")).otherwise(F.lit("WARN"))
    pad = F.when(e % 2 == 0, F.lit(" ")).otherwise(F.lit("    "))
    lines = bridge.table(spark, d, "events").select(
        F.concat(F.lit("["), F.date_format("ts", vocab.SECOND), F.lit("]["), level, F.lit("]"), pad,
                 F.lit("step "), e.cast("string")).alias("value")
    )
    return parsing.parse_install(lines).select("ts", "level", "message")


@query("x07_prefix_level", """SELECT CASE event_id % 6 WHEN 0 THEN 'OK' WHEN 1 THEN 'WARN' WHEN 2 THEN 'WARN' WHEN 3 THEN 'ERROR'
  WHEN 4 THEN 'ERROR' ELSE 'INFO' END AS level, count(*) AS n FROM events GROUP BY 1""")
def x07(spark, d):
    tags = F.array(*[F.lit(t) for t in ("[OK]", "[WARN]", "[EXISTS]", "[FAIL]", "[MISSING]", "mapped")])
    message = F.concat(F.get(tags, (F.col("event_id") % 6).cast("int")), F.lit(" drive"))
    rows = bridge.table(spark, d, "events").select(parsing.prefix_level(message).alias("level"))
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("x08_dn_split", """SELECT c_mktsegment AS name, 'OU=CorpUsers,DC=example,DC=test' AS parent, count(*) AS n FROM customer GROUP BY 1""")
def x08(spark, d):
    rows = bridge.table(spark, d, "customer").select(
        F.concat(F.lit("OU="), F.col("c_mktsegment"), F.lit(",OU=CorpUsers,DC=example,DC=test")).alias("dn")
    )
    return rows.groupBy(parsing.dn_name("dn").alias("name"), parsing.dn_parent("dn").alias("parent")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("dr12_recent_log", with_(LOG) + f"""SELECT strftime(ts, {MICRO}) AS ts, line_no, level AS level_class,
  '[' || strftime(ts, {SECOND}) || '][' || level || ']' || coalesce(' [TKT:' || ticket || ']', '') || ' [' || agent || '] ' ||
  CASE WHEN action IS NULL THEN 'Looking up user: ' || usr ELSE 'ACTION: ' || action || ' | User=' || usr ||
    CASE event_id % 4 WHEN 0 THEN ' | Dept=HR | ForceChange=True' WHEN 1 THEN ' | Dept=IT'
      WHEN 2 THEN ' | Group=GRP-VPN-Users | Dept=IT' ELSE ' | Reason=Resigned | GroupsRemoved=3' END END AS line
  FROM log ORDER BY log.ts DESC, line_no DESC LIMIT 40""")
def dr12(spark, d):
    return helpdesk.recent_log(parsing.parse_audit(bridge.audit_lines(spark, d)))


@query("dr13_action_counts", with_(LOG) + """SELECT agent, ticket, action, count(*) AS n FROM log WHERE action IS NOT NULL GROUP BY ALL""")
def dr13(spark, d):
    return helpdesk.action_counts(parsing.parse_audit(bridge.audit_lines(spark, d)))


# --- endpoint evidence ----------------------------------------------------------------------------


@query("dr14_recent_app_errors", f"""SELECT strftime(ts, {MICRO}) AS time_generated, source, code AS event_id, message FROM (
  SELECT ts, CASE event_id % 5 WHEN 0 THEN 'Microsoft Office 16' WHEN 1 THEN 'EXCEL' WHEN 2 THEN 'Outlook' WHEN 3 THEN 'WINWORD'
    ELSE '.NET Runtime' END AS source, CASE WHEN event_id % 3 = 0 THEN '1000' ELSE '1001' END AS code,
    'message ' || event_id::VARCHAR AS message
  FROM events WHERE event_type = 'error' ORDER BY ts DESC LIMIT 20)
  WHERE regexp_matches(source, '(?i)(Microsoft Office|Excel|WINWORD)')""")
def dr14(spark, d):
    return helpdesk.recent_app_errors(bridge.app_events(spark, d))


@query("dr15_recent_hotfixes", f"""SELECT 'KB' || event_id::VARCHAR AS id,
  CASE WHEN event_id % 2 = 0 THEN 'Update' ELSE 'Security Update' END AS description, strftime(ts, {MICRO}) AS installed_on
  FROM events WHERE ts > {NOW} - INTERVAL '7 days'""")
def dr15(spark, d):
    return helpdesk.recent_hotfixes(bridge.hotfixes(spark, d), T_NOW)


@query("dr16_crash_files", """SELECT '/dumps/' || source || '/' || doc_id::VARCHAR || '.dmp' AS path,
  octet_length(encode(text))::BIGINT AS length,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S.%f') AS last_write
  FROM documents WHERE doc_id % 2 = 0""")
def dr16(spark, d):
    return helpdesk.crash_files(bridge.crash_files(spark, d))
