"""Registered queries: scans, filters, detections, lists, tiles and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions import scalars as S
from nightdesk.functions.timerange import TimeRange, bucket, in_range
from nightdesk.operators import changes, helpdesk, kpi, lockouts, logons, timechart
from nightdesk.operators.base import security
from nightdesk.plans import bridge
from nightdesk.plans.alerts import after_hours
from nightdesk.plans.bridge import NOW as T_NOW
from nightdesk.plans.bridge import win_event
from nightdesk.plans.registry import EPOCH, MICRO, MINUTE, NOW, SECOND, WIN, query, with_
from nightdesk.sources.events import catalog_summary, probe

DAY = TimeRange.last(T_NOW, hours=24)
WEEK = TimeRange.last(T_NOW, days=7)
MONTH = TimeRange.last(T_NOW, days=30)
W = with_(WIN)


def last(interval: str) -> str:
    return f"_time >= {NOW} - INTERVAL {interval} AND _time < {NOW}"


def values(expr: str) -> str:
    return f"array_to_string(list_sort(list(DISTINCT {expr}) FILTER ({expr} IS NOT NULL)), ',')"


REASON = """CASE WHEN Status = '0xC000006D' OR Sub_Status = '0xC000006A' THEN 'Wrong password'
  WHEN Sub_Status = '0xC0000064' THEN 'Unknown username'
  WHEN Status = '0xC0000234' THEN 'Account locked out' WHEN Status = '0xC0000072' THEN 'Account disabled'
  WHEN Status = '0xC000006F' THEN 'Outside allowed logon hours' WHEN Status = '0xC0000070' THEN 'Workstation restriction'
  WHEN Status = '0xC0000193' THEN 'Account expired' ELSE 'Code: ' || Status || ' / ' || Sub_Status END"""
TYPE_NAME = """CASE Logon_Type WHEN '2' THEN 'Interactive (local)' WHEN '3' THEN 'Network (SMB/RPC)' WHEN '4' THEN 'Batch'
  WHEN '5' THEN 'Service' WHEN '7' THEN 'Unlock' WHEN '8' THEN 'NetworkCleartext' WHEN '10' THEN 'RemoteInteractive (RDP)'
  WHEN '11' THEN 'CachedInteractive' ELSE 'Type ' || Logon_Type END"""
IP = "coalesce(IpAddress, Source_Network_Address, 'unknown')"
POLICY = "EventCode IN ('5136', '5137', '5141', '4719')"
GROUPS = "EventCode IN ('4728', '4732', '4756')"
HIGH = "regexp_matches(Target_Account_Name[1], '(?i)(Domain Admin|Enterprise Admin|Schema Admin|Administrator|Backup Operator)')"
PRIV = "regexp_matches(Target_Account_Name[1], '(?i)(admin|svc|service|sa_|adm_)')"


def buckets(span: str, c: str = "_time") -> str:
    return f"time_bucket(INTERVAL {span}, {c}, {EPOCH})"


# --- sources and filters -------------------------------------------------------------------


@query("s01_security_scan", W + f"""SELECT EventCode, host, count(*) AS n, strftime(min(_time), {MICRO}) AS first_time,
  strftime(max(_time), {MICRO}) AS last_time FROM win WHERE {last("'7 days'")} GROUP BY ALL""")
def s01(spark, d):
    rows = security(win_event(spark, d, time=WEEK), None, WEEK)
    return rows.groupBy("EventCode", "host").agg(
        F.count(F.lit(1)).alias("n"), F.min("_time").alias("first_time"), F.max("_time").alias("last_time")
    )


@query("s11_lockouts_by_xpath", W + f"""SELECT strftime(_time, {MICRO}) AS _time, Account_Name[1] AS user, caller AS source
  FROM win WHERE EventCode = '4740' AND Account_Name[1] = 'svc_backup' ORDER BY win._time DESC LIMIT 10""")
def s11(spark, d):
    xml = bridge.event_xml(win_event(spark, d, [vocab.LOCKED_OUT]))
    return helpdesk.lockout_xml(xml, "svc_backup", 10)


@query("s13_catalog_summary", f"""SELECT 'WinEventLog:Security' AS sourcetype, count(*) AS total,
  strftime(min(ts), {MICRO}) AS first_time, strftime(max(ts), {MICRO}) AS last_time FROM events""")
def s13(spark, d):
    return catalog_summary(win_event(spark, d))


@query("s14_probe", W + f"""SELECT strftime(_time, {MICRO}) AS _time, host, EventCode
  FROM win WHERE host = 'DC01' ORDER BY win._time DESC LIMIT 5""")
def s14(spark, d):
    return probe(win_event(spark, d), "dc01", 5).select("_time", "host", "EventCode")


@query("p02_display_names", W + f"""SELECT strftime(_time, {SECOND}) AS "Lockout Time", Account_Name[1] AS "Locked Account",
  caller AS "Source Workstation", host AS "Domain Controller" FROM win WHERE EventCode = '4740'""")
def p02(spark, d):
    return S.with_display_names(lockouts.lockouts(win_event(spark, d, [vocab.LOCKED_OUT])), "lockouts")


@query("f03_relative_time", W + f"""SELECT EventCode, count(*) AS n FROM win WHERE {last("'4 hours'")} GROUP BY ALL""")
def f03(spark, d):
    time = TimeRange.last(T_NOW, hours=4)
    return in_range(win_event(spark, d, time=time), time).groupBy("EventCode").agg(F.count(F.lit(1)).alias("n"))


@query("f04_snapped_time", W + """SELECT 'hour' AS snap, count(*) AS n FROM win
  WHERE _time >= TIMESTAMP '2024-01-29 12:00:00' AND _time < TIMESTAMP '2024-01-30 12:34:56'
  UNION ALL SELECT 'day', count(*) FROM win
  WHERE _time >= TIMESTAMP '2024-01-23 00:00:00' AND _time < TIMESTAMP '2024-01-30 12:34:56'""")
def f04(spark, d):
    now = "2024-01-30 12:34:56"
    hour, day = TimeRange.last(now, hours=24, snap_to="hour"), TimeRange.last(now, days=7, snap_to="day")
    events = win_event(spark, d, time=day)
    return events.agg(F.count_if(hour.covers()).alias("hour"), F.count_if(day.covers()).alias("day")).select(
        F.explode(F.create_map(F.lit("hour"), "hour", F.lit("day"), "day")).alias("snap", "n")
    )


@query("f06_account_filter", W + """SELECT EventCode, count(*) AS n FROM win
  WHERE list_contains(list_transform(Account_Name, lambda x: lower(x) LIKE 'user1%'), true) GROUP BY ALL""")
def f06(spark, d):
    return security(win_event(spark, d), account="USER1*").groupBy("EventCode").agg(F.count(F.lit(1)).alias("n"))


@query("f13_hour_of_day", W + """SELECT EventCode, hour(_time)::INTEGER AS h, count(*) AS n FROM win
  WHERE hour(_time) < 7 OR hour(_time) >= 19 GROUP BY ALL""")
def f13(spark, d):
    rows = win_event(spark, d).filter(after_hours())
    return rows.groupBy("EventCode", F.hour("_time").alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query("f14_sql_filters", """SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
  AND c_name BETWEEN 'Customer#000000100' AND 'Customer#000000899' AND c_name LIKE '%5%' AND c_name NOT LIKE '%7'
  GROUP BY ALL""")
def f14(spark, d):
    name = F.col("c_name")
    return (
        bridge.table(spark, d, "customer")
        .filter(
            F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")
            & name.between("Customer#000000100", "Customer#000000899")
            & name.like("%5%")
            & ~name.like("%7")
        )
        .groupBy("c_mktsegment")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("t02_text_sort", W + f"""SELECT strftime(_time, '%H:%M:%S') AS lockout_time, Account_Name[1] AS locked_account,
  caller AS source_workstation, host FROM win WHERE EventCode = '4740' AND {last("'7 days'")}
  ORDER BY lockout_time DESC, locked_account, source_workstation, host LIMIT 15""")
def t02(spark, d):
    return lockouts.recent_lockouts(
        win_event(spark, d, [vocab.LOCKED_OUT], WEEK), T_NOW, k=15, time=WEEK, compat_text_sort=True
    )


# --- aggregate forms -----------------------------------------------------------------------


@query("g02_count_by", W + """SELECT EventCode, Account_Name[2] AS account, count(*) AS n FROM win
  WHERE Account_Name[2] IS NOT NULL GROUP BY ALL""")
def g02(spark, d):
    rows = win_event(spark, d).select("EventCode", S.nth("Account_Name", 1).alias("account"))
    return rows.filter(F.col("account").isNotNull()).groupBy("EventCode", "account").agg(F.count(F.lit(1)).alias("n"))


@query("g03_distinct_counts", W + """SELECT EventCode, count(DISTINCT a) AS accounts, count(DISTINCT _time) AS instants FROM (
  SELECT EventCode, _time, unnest(Account_Name) AS a FROM win) GROUP BY ALL""")
def g03(spark, d):
    # The element count and the plain distinct count are separate aggregates of
    # one distinct set each, joined on the code: no multi-distinct expansion.
    events = win_event(spark, d)
    elements = events.select("EventCode", F.explode("Account_Name").alias("a")).distinct()
    instants = events.select("EventCode", "_time").distinct()
    a = elements.groupBy("EventCode").agg(F.count("a").alias("accounts"))
    b = instants.groupBy("EventCode").agg(F.count("_time").alias("instants"))
    return a.join(b, "EventCode")


@query("g04_value_lists", W + f"""SELECT EventCode, {values("caller")} AS callers, {values("domain")} AS domains
  FROM win GROUP BY ALL""")
def g04(spark, d):
    events = win_event(spark, d).select(
        "EventCode", S.nth("Caller_Computer_Name", 0).alias("caller"), S.nth("Subject_Account_Domain", 0).alias("dom")
    )
    return events.groupBy("EventCode").agg(
        S.distinct_values("caller").alias("callers"), S.distinct_values("dom").alias("domains")
    )


@query("g06_latest_value", W + f"""SELECT EventCode, arg_max(caller, _time) AS last_caller,
  strftime(min(_time), {MICRO}) AS first_seen, strftime(max(_time), {MICRO}) AS last_seen FROM win GROUP BY ALL""")
def g06(spark, d):
    return win_event(spark, d).groupBy("EventCode").agg(
        S.latest_of(S.nth("Caller_Computer_Name", 0)).alias("last_caller"),
        F.min("_time").alias("first_seen"),
        F.max("_time").alias("last_seen"),
    )


@query("g07_tumbling_counts", W + f"""SELECT strftime({buckets("'10 minutes'")}, {MICRO}) AS bucket, EventCode, count(*) AS n
  FROM win GROUP BY ALL""")
def g07(spark, d):
    return win_event(spark, d).groupBy(bucket("10 minutes").alias("bucket"), "EventCode").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("g09_timechart_other", W + f""", rows AS (
  SELECT {buckets("'1 day'")} AS bucket, Account_Name[2] AS series FROM win
  WHERE EventCode = '4625' AND {last("'30 days'")}),
top AS (SELECT series FROM rows WHERE series IS NOT NULL GROUP BY series ORDER BY count(*) DESC, series LIMIT 10),
named AS (SELECT bucket, CASE WHEN series IS NULL THEN 'NULL' WHEN series IN (SELECT series FROM top) THEN series
  ELSE 'OTHER' END AS series FROM rows),
grid AS (SELECT b AS bucket, s AS series FROM (SELECT unnest(generate_series({NOW} - INTERVAL '30 days',
  {NOW} - INTERVAL '1 day', INTERVAL '1 day')) AS b) CROSS JOIN (SELECT DISTINCT series AS s FROM named))
SELECT strftime(g.bucket, {MICRO}) AS bucket, g.series, count(n.series) AS count FROM grid g
  LEFT JOIN named n ON n.bucket = g.bucket AND n.series = g.series GROUP BY g.bucket, g.series""")
def g09(spark, d):
    rows = security(win_event(spark, d, [vocab.LOGON_FAILED], MONTH), [vocab.LOGON_FAILED], MONTH)
    return timechart.timechart(rows, "1 day", MONTH, S.nth("Account_Name", 1))


@query("g09_timechart_wide", W + f"""SELECT strftime(b, {MICRO}) AS bucket,
  count(*) FILTER (host = 'DC01') AS DC01, count(*) FILTER (host = 'DC02') AS DC02
  FROM (SELECT unnest(generate_series({NOW} - INTERVAL '7 days', {NOW} - INTERVAL '4 hours', INTERVAL '4 hours')) AS b)
  LEFT JOIN win ON {buckets("'4 hours'")} = b AND {last("'7 days'")} GROUP BY b""")
def g09_wide(spark, d):
    rows = in_range(win_event(spark, d, time=WEEK), WEEK)
    return timechart.wide(timechart.timechart(rows, "4 hours", WEEK, "host"), ["DC01", "DC02"])


# --- detections ------------------------------------------------------------------------------


@query("q01_lockouts", W + f"""SELECT strftime(_time, {SECOND}) AS lockout_time, Account_Name[1] AS locked_account,
  caller AS locked_by_host, host AS dc_host FROM win WHERE EventCode = '4740'""")
def q01(spark, d):
    return lockouts.lockouts(win_event(spark, d, [vocab.LOCKED_OUT]))


@query("q02_lockout_frequency", W + f"""SELECT Account_Name[1] AS locked_account, count(*) AS total_lockouts,
  count(DISTINCT caller) AS unique_sources, {values("caller")} AS workstations,
  strftime(min(_time), {MINUTE}) AS first_lockout, strftime(max(_time), {MINUTE}) AS last_lockout
  FROM win WHERE EventCode = '4740' AND {last("'7 days'")} GROUP BY ALL""")
def q02(spark, d):
    return lockouts.lockout_frequency(win_event(spark, d, [vocab.LOCKED_OUT], WEEK), T_NOW)


@query("q03_brute_force", W + f"""SELECT strftime(w, {MINUTE}) AS window_start,
  CASE WHEN n >= 20 THEN 'CRITICAL' WHEN n >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS risk, target_account,
  n AS failure_count, unique_ips, source_ips, logon_types, failure_reasons
  FROM (SELECT {buckets("'7 days'")} AS w, Account_Name[2] AS target_account, count(*) AS n,
    count(DISTINCT {IP}) AS unique_ips, {values(IP)} AS source_ips, {values(TYPE_NAME)} AS logon_types,
    {values(REASON)} AS failure_reasons
    FROM win WHERE EventCode = '4625' AND Account_Name[2] IS NOT NULL GROUP BY 1, 2) WHERE n >= 5""")
def q03(spark, d):
    # The test events are sparse: a wide span makes every risk band occur.
    return logons.brute_force(win_event(spark, d, [vocab.LOGON_FAILED]), span="7 days")


@query("q04_password_spray", W + f"""SELECT source_ip, a AS accounts_targeted, n AS total_attempts, accounts,
  round(n / a, 2) AS spray_ratio, strftime(w, {MINUTE}) AS window_start
  FROM (SELECT {buckets("'1 day'")} AS w, {IP} AS source_ip, count(*) AS n, count(DISTINCT Account_Name[2]) AS a,
    {values("Account_Name[2]")} AS accounts FROM win WHERE EventCode = '4625' GROUP BY 1, 2)
  WHERE a >= 5 AND n <= a * 2""")
def q04(spark, d):
    return logons.password_spray(win_event(spark, d, [vocab.LOGON_FAILED]), None, span="1 day")


@query("q05_gpo_changes", W + f"""SELECT strftime(_time, {SECOND}) AS change_time,
  CASE EventCode WHEN '5136' THEN 'GPO Modified' WHEN '5137' THEN 'GPO Created' ELSE 'GPO Deleted' END AS change_type,
  actor AS changed_by, domain AS changed_by_domain, dn AS gpo_name, coalesce(attr, 'N/A') AS attribute,
  coalesce(old_v, '(new)') AS old_value, coalesce(new_v, '(deleted)') AS new_value, host AS dc_host
  FROM win WHERE EventCode IN ('5136', '5137', '5141') AND Object_Class = 'groupPolicyContainer'""")
def q05(spark, d):
    return changes.gpo_changes(win_event(spark, d, vocab.OBJECT_CODES))


@query("q06_audit_policy_changes", W + f"""SELECT strftime(_time, {SECOND}) AS change_time, host, actor AS changed_by,
  policy AS policy_name FROM win WHERE EventCode = '4719'""")
def q06(spark, d):
    return changes.audit_policy_changes(win_event(spark, d, [vocab.AUDIT_POLICY_CHANGED]))


@query("q07_unexpected_actors", W + f"""SELECT actor, count(*) AS changes, {values("EventCode")} AS event_codes,
  strftime(max(_time), {SECOND}) AS last_seen FROM win
  WHERE {POLICY} AND NOT regexp_matches(actor, '^(Administrator|SYSTEM|DC01\\$)$') GROUP BY actor""")
def q07(spark, d):
    return changes.policy_changes_by_unexpected_actor(win_event(spark, d, vocab.POLICY_CODES))


@query("q08_new_accounts", W + f"""SELECT strftime(_time, {SECOND}) AS create_time, Target_Account_Name[1] AS new_account,
  actor AS created_by, domain AS created_by_dom, CASE WHEN {PRIV} THEN 'YES ⚠' ELSE 'No' END AS is_privileged,
  host AS dc_host FROM win WHERE EventCode = '4720'""")
def q08(spark, d):
    return changes.new_accounts(win_event(spark, d, [vocab.ACCOUNT_CREATED]))


@query("q09_account_lifecycle", W + f"""SELECT strftime(_time, {SECOND}) AS ev_time,
  CASE EventCode WHEN '4720' THEN 'Account Created' WHEN '4722' THEN 'Account Enabled' WHEN '4723' THEN 'Password Change Attempt'
    WHEN '4724' THEN 'Password Reset (Admin)' WHEN '4726' THEN 'Account DELETED' WHEN '4738' THEN 'Account Modified'
    ELSE 'Account Unlocked' END AS event_desc, Target_Account_Name[1] AS target, actor, host FROM win
  WHERE EventCode IN ('4720', '4722', '4723', '4724', '4726', '4738', '4767')""")
def q09(spark, d):
    return changes.account_lifecycle(win_event(spark, d, vocab.LIFECYCLE_CODES))


@query("q10_high_privilege_group_adds", W + f"""SELECT strftime(_time, {SECOND}) AS ev_time, member AS member_added,
  Target_Account_Name[1] AS added_to_group, 'HIGH PRIVILEGE ⚠' AS is_high_priv, actor AS performed_by, host
  FROM win WHERE {GROUPS} AND {HIGH}""")
def q10(spark, d):
    return changes.high_privilege_group_adds(win_event(spark, d, vocab.GROUP_ADD_CODES))


def timeline_sql(labels: str) -> str:
    gpo = "GPO/AD Object Changed" if labels == "file" else "GPO/AD Changed"
    return W + f""", named AS (SELECT {buckets("'1 hour'")} AS bucket, CASE EventCode WHEN '4625' THEN 'Failed Logon'
  WHEN '4740' THEN 'Account Lockout' WHEN '4720' THEN 'User Created' WHEN '4724' THEN 'Password Reset'
  WHEN '4728' THEN 'Group Membership Change' WHEN '5136' THEN '{gpo}' WHEN '4719' THEN 'Audit Policy Changed'
  ELSE 'Account Unlocked' END AS series FROM win
  WHERE EventCode IN ('4625', '4740', '4720', '4724', '4728', '5136', '4719', '4767') AND {last("'24 hours'")})
SELECT strftime(g.bucket, {MICRO}) AS bucket, g.series, count(n.series) AS count FROM (
  SELECT bucket, series FROM (SELECT unnest(generate_series({NOW} - INTERVAL '24 hours', {NOW} - INTERVAL '1 hour',
    INTERVAL '1 hour')) AS bucket) CROSS JOIN (SELECT DISTINCT series FROM named)) g
LEFT JOIN named n ON n.bucket = g.bucket AND n.series = g.series GROUP BY g.bucket, g.series"""


@query("q11_security_timeline", timeline_sql("file"))
def q11(spark, d):
    return timechart.security_timeline(win_event(spark, d, vocab.TIMELINE_CODES, DAY), T_NOW)


@query("q11_security_timeline_panel", timeline_sql("panel"))
def q11_panel(spark, d):
    return timechart.security_timeline(win_event(spark, d, vocab.TIMELINE_CODES, DAY), T_NOW, labels="panel")


def top_locked_sql(k: int) -> str:
    return W + f"""SELECT Account_Name[1] AS locked_account, count(*) AS lockout_count FROM win
  WHERE EventCode = '4740' AND {last("'7 days'")} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}"""


@query("q12_top_locked_accounts", top_locked_sql(10))
def q12(spark, d):
    return lockouts.top_locked_accounts(win_event(spark, d, [vocab.LOCKED_OUT], WEEK), T_NOW)


@query("q12_top_locked_accounts_panel", top_locked_sql(8))
def q12_panel(spark, d):
    return lockouts.top_locked_accounts(win_event(spark, d, [vocab.LOCKED_OUT], WEEK), T_NOW, k=8)


@query("q13_failed_logons_by_ip", W + f""", f AS (SELECT {IP} AS source_ip, Account_Name FROM win
  WHERE EventCode = '4625' AND {last("'24 hours'")} AND {IP} NOT IN ('-', 'unknown', '127.0.0.1')),
a AS (SELECT source_ip, count(DISTINCT x) AS accounts_targeted FROM (SELECT source_ip, unnest(Account_Name) AS x FROM f) GROUP BY 1)
SELECT source_ip, count(*) AS failures, any_value(accounts_targeted) AS accounts_targeted FROM f JOIN a USING (source_ip)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def q13(spark, d):
    return logons.failed_logons_by_ip(win_event(spark, d, [vocab.LOGON_FAILED], DAY), T_NOW)


@query("q13_failed_logons_by_ip_panel", W + f"""SELECT {IP} AS source_ip, count(*) AS failures FROM win
  WHERE EventCode = '4625' AND {last("'24 hours'")} AND {IP} NOT IN ('-', 'unknown', '127.0.0.1', '::1')
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def q13_panel(spark, d):
    return logons.failed_logons_by_ip(
        win_event(spark, d, [vocab.LOGON_FAILED], DAY), T_NOW, exclude=vocab.LOCAL_ADDRESSES_PANEL,
        time=TimeRange.default(T_NOW), with_accounts=False,
    )


def recent_sql(fmt: str, interval: str, limit: str) -> str:
    return W + f"""SELECT strftime(_time, {fmt}) AS lockout_time, Account_Name[1] AS locked_account,
  caller AS source_workstation, host FROM win WHERE EventCode = '4740' AND {last(interval)}
  ORDER BY win._time DESC, 2, 3, 4 {limit}"""


@query("q14_recent_lockouts", recent_sql("'%H:%M:%S'", "'4 hours'", ""))
def q14(spark, d):
    time = TimeRange.last(T_NOW, hours=4)
    return lockouts.recent_lockouts(win_event(spark, d, [vocab.LOCKED_OUT], time), T_NOW)


@query("q14_recent_lockouts_panel", recent_sql("'%m/%d %H:%M:%S'", "'24 hours'", "LIMIT 15"))
def q14_panel(spark, d):
    return lockouts.recent_lockouts(
        win_event(spark, d, [vocab.LOCKED_OUT], DAY), T_NOW, k=15, time=TimeRange.default(T_NOW),
        pattern=vocab.SHORT_SECOND,
    )


@query("q14_recent_lockouts_day", recent_sql(MICRO, "'24 hours'", ""))
def q14_day(spark, d):
    return lockouts.recent_lockouts(win_event(spark, d, [vocab.LOCKED_OUT], DAY), T_NOW, hours=24, pattern=None)


@query("q15_new_accounts_by_day", W + f"""SELECT strftime(_time, '%Y-%m-%d') AS create_date, count(*) AS total,
  {values("Target_Account_Name[1]")} AS accounts, {values("actor")} AS created_by FROM win
  WHERE EventCode = '4720' AND {last("'30 days'")} GROUP BY 1""")
def q15(spark, d):
    return changes.new_accounts_by_day(win_event(spark, d, [vocab.ACCOUNT_CREATED], MONTH), T_NOW)


@query("q16_policy_changes", W + f"""SELECT strftime(_time, {MINUTE}) AS ev_time, CASE EventCode WHEN '5136' THEN 'GPO Modified'
  WHEN '5137' THEN 'GPO/Object Created' WHEN '5141' THEN 'Object Deleted' ELSE 'Audit Policy Changed' END AS change_type,
  actor, host FROM win WHERE {POLICY} AND {last("'24 hours'")}""")
def q16(spark, d):
    return changes.policy_changes(win_event(spark, d, vocab.POLICY_CODES, DAY), T_NOW)


@query("q16_policy_changes_panel", W + f"""SELECT strftime(_time, '%m/%d %H:%M') AS ev_time, CASE EventCode WHEN '5136' THEN 'Modified'
  WHEN '5137' THEN 'Created' WHEN '5141' THEN 'Deleted' ELSE 'Audit Policy' END AS change_type,
  actor, coalesce(dn, policy, 'N/A') AS obj, host FROM win WHERE {POLICY} AND {last("'24 hours'")}
  ORDER BY win._time DESC, 2, 3, 4, 5 LIMIT 15""")
def q16_panel(spark, d):
    return changes.policy_changes(
        win_event(spark, d, vocab.POLICY_CODES, DAY), T_NOW, "panel", TimeRange.default(T_NOW), k=changes.PANEL_ROWS
    )


def tile_sql(name: str, where: str, interval: str, limits: list[int]) -> str:
    bands = " ".join(f"WHEN n <= {v} THEN {i}" for i, v in enumerate(limits))
    return W + f"""SELECT n AS {name}, CASE {bands} ELSE {len(limits)} END AS band
  FROM (SELECT count(*) AS n FROM win WHERE {where} AND {last(interval)})"""


@query("q17_kpi_failed_logons", tile_sql("failures", "EventCode = '4625'", "'24 hours'", [0, 20, 99]))
def q17(spark, d):
    return kpi.kpi_failed_logons(win_event(spark, d, [vocab.LOGON_FAILED], DAY), T_NOW)


@query("q18_kpi_lockouts", tile_sql("lockouts", "EventCode = '4740'", "'24 hours'", [0, 3, 9]))
def q18(spark, d):
    return kpi.kpi_lockouts(win_event(spark, d, [vocab.LOCKED_OUT], DAY), T_NOW)


@query("q19_kpi_new_accounts", tile_sql("new_accounts", "EventCode = '4720'", "'30 days'", [0, 1]))
def q19(spark, d):
    return kpi.kpi_new_accounts(win_event(spark, d, [vocab.ACCOUNT_CREATED], MONTH), T_NOW)


@query("q20_kpi_password_resets", tile_sql("resets", "EventCode = '4724'", "'7 days'", [0, 10]))
def q20(spark, d):
    return kpi.kpi_password_resets(win_event(spark, d, [vocab.PASSWORD_RESET], WEEK), T_NOW)


@query("q21_kpi_policy_changes", tile_sql("changes", POLICY, "'24 hours'", [0, 1]))
def q21(spark, d):
    return kpi.kpi_policy_changes(win_event(spark, d, vocab.POLICY_CODES, DAY), TimeRange.default(T_NOW))


@query("q17_kpi_board", W + f""", v AS (SELECT
  count(*) FILTER (EventCode = '4740' AND {last("'24 hours'")}) AS lockouts,
  count(*) FILTER (EventCode = '4625' AND {last("'24 hours'")}) AS failures,
  count(*) FILTER (EventCode = '4724' AND {last("'7 days'")}) AS resets,
  count(*) FILTER (EventCode = '4720' AND {last("'30 days'")}) AS new_accounts,
  count(*) FILTER ({POLICY} AND {last("'24 hours'")}) AS changes FROM win)
SELECT 'lockouts' AS tile, lockouts AS value, CASE WHEN lockouts <= 0 THEN 0 WHEN lockouts <= 3 THEN 1 WHEN lockouts <= 9 THEN 2 ELSE 3 END AS band FROM v
UNION ALL SELECT 'failures', failures, CASE WHEN failures <= 0 THEN 0 WHEN failures <= 20 THEN 1 WHEN failures <= 99 THEN 2 ELSE 3 END FROM v
UNION ALL SELECT 'resets', resets, CASE WHEN resets <= 0 THEN 0 WHEN resets <= 10 THEN 1 ELSE 2 END FROM v
UNION ALL SELECT 'new_accounts', new_accounts, CASE WHEN new_accounts <= 0 THEN 0 WHEN new_accounts <= 1 THEN 1 ELSE 2 END FROM v
UNION ALL SELECT 'changes', changes, CASE WHEN changes <= 0 THEN 0 WHEN changes <= 1 THEN 1 ELSE 2 END FROM v""")
def q17_board(spark, d):
    return kpi.kpi_board(win_event(spark, d), T_NOW)


@query("q22_group_changes", W + f"""SELECT strftime(_time, {MINUTE}) AS ev_time, member, Target_Account_Name[1] AS grp, actor, host
  FROM win WHERE {GROUPS} AND {last("'7 days'")}""")
def q22(spark, d):
    return changes.group_changes(win_event(spark, d, vocab.GROUP_ADD_CODES, WEEK), T_NOW)


@query("q22_group_changes_panel", W + f"""SELECT strftime(_time, '%m/%d %H:%M') AS ev_time, member, Target_Account_Name[1] AS grp,
  CASE WHEN {HIGH} THEN 'HIGH ⚠' ELSE 'Standard' END AS is_high_priv, actor, host
  FROM win WHERE {GROUPS} AND {last("'7 days'")}""")
def q22_panel(spark, d):
    return changes.group_changes(win_event(spark, d, vocab.GROUP_ADD_CODES, WEEK), T_NOW, flag=True)


@query("q23_brute_force_panel", W + f"""SELECT strftime(w, '%m/%d %H:%M') AS window,
  CASE WHEN failures >= 20 THEN 'CRITICAL' WHEN failures >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS risk, target_account,
  failures, source_ips FROM (SELECT {buckets("'1 day'")} AS w, Account_Name[2] AS target_account, count(*) AS failures,
    {values(IP)} AS source_ips FROM win WHERE EventCode = '4625' AND Account_Name[2] IS NOT NULL GROUP BY 1, 2)
  WHERE failures >= 5 ORDER BY failures DESC, w, target_account LIMIT 20""")
def q23(spark, d):
    return logons.brute_force_panel(win_event(spark, d, [vocab.LOGON_FAILED]), None, span="1 day")


@query("q24_new_accounts_panel", W + f"""SELECT strftime(_time, {MINUTE}) AS create_time, Target_Account_Name[1] AS new_account,
  actor AS created_by, CASE WHEN {PRIV} THEN '⚠ YES' ELSE 'No' END AS priv_flag, host FROM win
  WHERE EventCode = '4720' AND {last("'30 days'")}""")
def q24(spark, d):
    return changes.new_accounts_panel(win_event(spark, d, [vocab.ACCOUNT_CREATED], MONTH), T_NOW)


@query("q25_unlocks_timeline", W + f""", rows AS (SELECT {buckets("'4 hours'")} AS bucket, actor AS series FROM win
  WHERE EventCode = '4767' AND {last("'7 days'")}),
top AS (SELECT series FROM rows GROUP BY series ORDER BY count(*) DESC, series LIMIT 10),
named AS (SELECT bucket, CASE WHEN series IN (SELECT series FROM top) THEN series ELSE 'OTHER' END AS series FROM rows)
SELECT strftime(g.bucket, {MICRO}) AS bucket, g.series, count(n.series) AS count FROM (
  SELECT bucket, series FROM (SELECT unnest(generate_series({NOW} - INTERVAL '7 days', {NOW} - INTERVAL '4 hours',
    INTERVAL '4 hours')) AS bucket) CROSS JOIN (SELECT DISTINCT series FROM named)) g
LEFT JOIN named n ON n.bucket = g.bucket AND n.series = g.series GROUP BY g.bucket, g.series""")
def q25(spark, d):
    return timechart.unlocks_timeline(win_event(spark, d, [vocab.UNLOCKED], WEEK), WEEK)


@query("q26_logon_type_breakdown", W + f"""SELECT CASE Logon_Type WHEN '2' THEN 'Interactive' WHEN '3' THEN 'Network' WHEN '4' THEN 'Batch'
  WHEN '5' THEN 'Service' WHEN '7' THEN 'Unlock' WHEN '10' THEN 'RemoteInteractive (RDP)' WHEN '11' THEN 'CachedInteractive'
  ELSE 'Other (Type ' || Logon_Type || ')' END AS logon_type_name, count(*) AS count
  FROM win WHERE EventCode = '4624' AND {last("'24 hours'")} GROUP BY 1""")
def q26(spark, d):
    return logons.logon_type_breakdown(win_event(spark, d, [vocab.LOGON], DAY), TimeRange.default(T_NOW))


@query("q27_failed_logons_timeline", W + f"""SELECT strftime(b, {MICRO}) AS bucket, count(EventCode) AS count FROM (
  SELECT unnest(generate_series({NOW} - INTERVAL '24 hours', {NOW} - INTERVAL '1 hour', INTERVAL '1 hour')) AS b)
  LEFT JOIN win ON {buckets("'1 hour'")} = b AND EventCode = '4625' GROUP BY b""")
def q27(spark, d):
    return timechart.failed_logons_timeline(win_event(spark, d, [vocab.LOGON_FAILED], DAY), T_NOW)


@query("q28_logon_type_name", W + f"""SELECT {TYPE_NAME} AS logon_type, count(*) AS n FROM win GROUP BY 1""")
def q28(spark, d):
    return win_event(spark, d).groupBy(S.logon_type_name().alias("logon_type")).agg(F.count(F.lit(1)).alias("n"))


@query("q29_failure_reason", W + f"""SELECT Status, Sub_Status, {REASON} AS reason, count(*) AS n FROM win GROUP BY ALL""")
def q29(spark, d):
    return win_event(spark, d).groupBy("Status", "Sub_Status", S.failure_reason().alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("q30_source_ip", W + f"""SELECT {IP} AS source_ip, count(*) AS n FROM win GROUP BY 1""")
def q30(spark, d):
    return win_event(spark, d).groupBy(S.source_ip().alias("source_ip")).agg(F.count(F.lit(1)).alias("n"))


@query("c06_time_formats", W + f"""SELECT strftime(_time, {SECOND}) AS full_time, strftime(_time, {MINUTE}) AS minute_time,
  strftime(_time, '%Y-%m-%d') AS day_time, strftime(_time, '%H:%M:%S') AS clock, strftime(_time, '%m/%d %H:%M') AS short_minute,
  strftime(_time, '%m/%d %H:%M:%S') AS short_second, hour(_time)::INTEGER AS hour FROM win WHERE EventCode = '4767'""")
def c06(spark, d):
    formats = {
        "full_time": vocab.SECOND, "minute_time": vocab.MINUTE, "day_time": vocab.DAY, "clock": vocab.CLOCK,
        "short_minute": vocab.SHORT_MINUTE, "short_second": vocab.SHORT_SECOND,
    }
    return security(win_event(spark, d, [vocab.UNLOCKED]), [vocab.UNLOCKED]).select(
        *[S.time_text("_time", f).alias(n) for n, f in formats.items()],
        S.to_number(S.time_text("_time", vocab.HOUR)).alias("hour"),
    )


@query("c18_blank_sources", W + """SELECT EventCode, count(*) FILTER (caller IS NULL OR regexp_full_match(caller, '\\s*')) AS blank,
  count(*) AS total FROM win GROUP BY 1""")
def c18(spark, d):
    return win_event(spark, d).groupBy("EventCode").agg(
        F.count_if(S.is_blank(S.nth("Caller_Computer_Name", 0))).alias("blank"), F.count(F.lit(1)).alias("total")
    )


# --- lockout investigation ---------------------------------------------------------------------


@query("dr10_lockout_sources", W + f"""SELECT account, rank, strftime(_time, {MICRO}) AS _time,
  strftime(_time, {SECOND}) AS lockout_time, source,
  CASE WHEN source = '' THEN '(blank — Kerberos or network logon)' ELSE source END AS shown_source FROM (
  SELECT Account_Name[1] AS account, _time, caller AS source,
    row_number() OVER (PARTITION BY Account_Name[1] ORDER BY _time DESC, caller, host)::INTEGER AS rank
  FROM win WHERE EventCode = '4740') WHERE rank <= 10""")
def dr10(spark, d):
    return lockouts.lockout_sources(win_event(spark, d, [vocab.LOCKED_OUT]))


CAUSE = """CASE WHEN source = '' THEN 'mobile device or webmail' WHEN regexp_matches(source, '(?i)^(DC|SRV|SERVER)')
  THEN 'saved service credential on server' ELSE 'saved credential on workstation' END AS cause"""


@query("dr11_lockout_root_cause", W + f"""SELECT account, source, strftime(t, {SECOND}) AS decided_on, {CAUSE} FROM (
  SELECT Account_Name[1] AS account, arg_max(caller, _time) AS source, max(_time) AS t
  FROM win WHERE EventCode = '4740' GROUP BY 1)""")
def dr11(spark, d):
    return lockouts.lockout_root_cause(win_event(spark, d, [vocab.LOCKED_OUT]))


@query("dr11_lockout_root_cause_oldest", W + f"""SELECT account, source, strftime(t, {SECOND}) AS decided_on, {CAUSE} FROM (
  SELECT account, arg_min(caller, _time) AS source, min(_time) AS t FROM (
    SELECT Account_Name[1] AS account, caller, _time,
      row_number() OVER (PARTITION BY Account_Name[1] ORDER BY _time DESC, caller, host) AS r
    FROM win WHERE EventCode = '4740') WHERE r <= 10 GROUP BY 1)""")
def dr11_oldest(spark, d):
    return lockouts.lockout_root_cause(win_event(spark, d, [vocab.LOCKED_OUT]), compat_oldest=True)
