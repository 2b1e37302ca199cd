"""Registered queries: alerts, suppression and their streaming forms."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from nightdesk.functions.timerange import TimeRange
from nightdesk.operators.suppression import suppress
from nightdesk.plans import alerts as A
from nightdesk.plans import bridge
from nightdesk.plans.bridge import win_event
from nightdesk.plans.queries_security import IP, POLICY, buckets, values
from nightdesk.plans.registry import MICRO, SECOND, WIN, query, with_
from nightdesk.session import shared_folder
from nightdesk.streaming import jobs
from nightdesk.streaming.stateful import stream_suppress

W = with_(WIN)


def events(spark, d, name, time=None):
    return win_event(spark, d, A.ALERTS[name].codes, time)


def muted_sql(source: str, key: str, seconds: int) -> str:
    """Greedy suppression as a recursive query over a ``source`` view (key, t)."""
    return f"""WITH RECURSIVE {WIN.strip()}, {source},
fire AS (
  SELECT k, min(t) AS t FROM src GROUP BY k
  UNION ALL
  SELECT f.k, min(s.t) AS t FROM fire f JOIN src s ON s.k = f.k AND s.t >= f.t + INTERVAL '{seconds} seconds' GROUP BY f.k)
SELECT k AS {key}, strftime(t, {MICRO}) AS _time FROM fire"""


LOCKED = "src AS (SELECT Account_Name[1] AS k, _time AS t FROM win WHERE EventCode = '4740')"
CREATED = "src AS (SELECT Target_Account_Name[1] AS k, _time AS t FROM win WHERE EventCode = '4720')"


@query("al01_alert_lockout", muted_sql(LOCKED, "locked_account", 300))
def al01(spark, d):
    spec = A.ALERTS["lockout"]
    return A.alert_history(events(spark, d, "lockout"), spec).select("locked_account", "_time")


@query("al01_alert_lockout_run", W + f"""SELECT strftime(_time, {MICRO}) AS _time, Account_Name[1] AS locked_account,
  caller AS source_workstation, host FROM win WHERE EventCode = '4740' AND _time >= TIMESTAMP '2024-01-30 09:54:00'
  AND _time < TIMESTAMP '2024-01-30 10:00:00' + INTERVAL '1 day'""")
def al01_run(spark, d):
    # The look-back of one run holds a handful of rows; a day of runs is checked.
    time = TimeRange.last("2024-01-31 10:00:00", hours=24, minutes=6)
    return A.search_lockout(events(spark, d, "lockout", time), time)


@query("al02_alert_brute_force", W + f"""SELECT strftime({buckets("'1 day'")}, {MICRO}) AS _time, Account_Name[2] AS target_account,
  count(*) AS failure_count, {values(IP)} AS source_ips,
  CASE WHEN count(*) >= 20 THEN 'CRITICAL' WHEN count(*) >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS risk
  FROM win WHERE EventCode = '4625' AND Account_Name[2] IS NOT NULL GROUP BY {buckets("'1 day'")}, 2 HAVING count(*) >= 5""")
def al02(spark, d):
    return A.search_brute_force(events(spark, d, "brute_force"), span="1 day")


@query("al03_alert_policy_change", W + f"""SELECT strftime(_time, {MICRO}) AS _time, CASE EventCode WHEN '5136' THEN 'GPO Modified'
  WHEN '5137' THEN 'GPO/Object Created' WHEN '5141' THEN 'AD Object Deleted' ELSE 'Audit Policy Changed' END AS change_type,
  actor, dn AS gpo_dn, host FROM win WHERE {POLICY} AND NOT regexp_matches(actor, '(?i)^(SYSTEM|DC01\\$|Administrator)$')""")
def al03(spark, d):
    return A.alert_history(events(spark, d, "policy_change"), A.ALERTS["policy_change"])


@query("al04_alert_new_account", muted_sql(CREATED, "new_account", 60))
def al04(spark, d):
    spec = A.ALERTS["new_account"]
    return A.alert_history(events(spark, d, "new_account"), spec).select("new_account", "_time")


@query("al04_alert_new_account_rows", W + f"""SELECT strftime(_time, {MICRO}) AS _time, Target_Account_Name[1] AS new_account,
  actor AS created_by, CASE WHEN regexp_matches(Target_Account_Name[1], '(?i)(admin|svc|service|sa_|adm_|root)') THEN 'YES' ELSE 'No' END
  AS is_privileged, host FROM win WHERE EventCode = '4720'""")
def al04_rows(spark, d):
    return A.search_new_account(events(spark, d, "new_account"))


@query("al05_alert_after_hours_admin", W + f"""SELECT strftime(_time, {MICRO}) AS _time, strftime(_time, {SECOND}) AS logon_time,
  Account_Name[2] AS actor, WorkstationName, IpAddress, host FROM win
  WHERE EventCode IN ('4624', '4648') AND (hour(_time) < 7 OR hour(_time) >= 19)
  AND (regexp_matches(Account_Name[2], '(?i)(admin|jsmith|mchen)')
    OR Account_Name[2] IN (SELECT actor FROM win WHERE EventCode = '4719'))""")
def al05(spark, d):
    return A.search_after_hours_admin(
        events(spark, d, "after_hours_admin"), admins=bridge.admin_accounts(spark, d)
    )


RUNS = """runs AS (
  SELECT win.*, unnest(generate_series(time_bucket(INTERVAL '{p} minutes', _time, TIMESTAMP '1970-01-01') + INTERVAL '{p} minutes',
    _time + INTERVAL '{l} minutes', INTERVAL '{p} minutes')) AS run_time FROM win)"""


@query("al06_triggered_runs", with_(WIN, RUNS.format(p=5, l=6)) + f"""SELECT strftime(run_time, {MICRO}) AS run_time, count(*) AS events
  FROM runs WHERE EventCode = '4740' GROUP BY runs.run_time""")
def al06(spark, d):
    spec = A.ALERTS["lockout"]
    return A.triggered(A.scheduled_results(events(spark, d, "lockout"), spec))


@query("al07_alert_text", W + f"""SELECT 'new_account' AS alert, 3 AS severity, 'Medium' AS severity_name, Target_Account_Name[1] AS key,
  strftime(_time, {MICRO}) AS fired_at, '[INFO] New AD Account Created: ' || Target_Account_Name[1] AS subject FROM win
  WHERE EventCode = '4720'""")
def al07(spark, d):
    spec = A.ALERTS["new_account"]
    records = A.alert_records(A.search_new_account(events(spark, d, "new_account")), spec)
    return records.select(
        "alert", "severity", A.severity_name(F.col("severity")).alias("severity_name"), "key", "fired_at", "subject"
    )


@query("al08_scheduled_results", with_(WIN, RUNS.format(p=60, l=65)) + f"""SELECT strftime(run_time, {MICRO}) AS run_time,
  strftime(_time, {MICRO}) AS _time, Account_Name[2] AS actor, host FROM runs
  WHERE EventCode IN ('4624', '4648') AND (hour(_time) < 7 OR hour(_time) >= 19)
  AND regexp_matches(Account_Name[2], '(?i)(admin|jsmith|mchen)')""")
def al08(spark, d):
    rows = A.scheduled_results(events(spark, d, "after_hours_admin"), A.ALERTS["after_hours_admin"])
    return rows.select("run_time", "_time", "actor", "host")


@query("st06_suppression", muted_sql(LOCKED, "locked_account", 86400))
def st06(spark, d):
    # A day instead of minutes, so that long chains of muted events occur.
    rows = A.search_lockout(events(spark, d, "lockout"))
    return suppress(rows, "locked_account", 86400).select("locked_account", "_time")


# --- streaming forms: the files are read as a stream and worked off once, when the query is built -


def _stream(spark, d):
    # A pattern, as a stream takes a folder or a pattern: it fits the table as one file and as a folder of parts.
    raw = spark.readStream.schema(bridge.TABLES["events"]).parquet(f"{d}/events.parque[t]")
    return bridge.win_event_columns(raw)


def _work_off(spark, rows, name, mode="append"):
    """Run a stream over what is there and return the table it wrote; dropped rows are an error."""
    base = shared_folder(spark, f"{name}-{uuid.uuid4().hex}")
    jobs.use_rocksdb(spark)
    run = (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(jobs.append_batch(f"{base}/out", name))
        .trigger(availableNow=True)
        .start()
    )
    jobs.fail_on_dropped(run, jobs.drop_counter(spark))
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


@query("st03_stream_windows", W + f"""SELECT strftime(w, {MICRO}) AS _time, target_account, n AS failure_count, source_ips,
  CASE WHEN n >= 20 THEN 'CRITICAL' WHEN n >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM (
  SELECT {buckets("'1 day'")} AS w, Account_Name[2] AS target_account, count(*) AS n, {values(IP)} AS source_ips
  FROM win WHERE EventCode = '4625' AND Account_Name[2] IS NOT NULL GROUP BY 1, 2) WHERE n >= 5
  AND w + INTERVAL '1 day' <= (SELECT max(_time) FROM win WHERE EventCode = '4625' AND Account_Name[2] IS NOT NULL)""")
def st03(spark, d):
    # Append mode: a window is written once the watermark has passed its end.
    return _work_off(spark, jobs.failure_windows(_stream(spark, d), span="1 day", delay="0 seconds"), "st03")


@query("al02_stream_brute_force_muted", f"""WITH RECURSIVE {WIN.strip()}, src AS (
  SELECT Account_Name[2] AS k, {buckets("'1 day'")} AS t FROM win
  WHERE EventCode = '4625' AND Account_Name[2] IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2
  AND {buckets("'1 day'")} + INTERVAL '1 day' <= (SELECT max(_time) FROM win WHERE EventCode = '4625' AND Account_Name[2] IS NOT NULL)),
fire AS (
  SELECT k, min(t) AS t FROM src GROUP BY k
  UNION ALL
  SELECT f.k, min(s.t) AS t FROM fire f JOIN src s ON s.k = f.k AND s.t >= f.t + INTERVAL '5 days' GROUP BY f.k)
SELECT k AS target_account, strftime(t, {MICRO}) AS _time FROM fire""")
def al02_stream_muted(spark, d):
    """Windows counted, then muted, as two stateful operators in a row; days instead of minutes."""
    spec = replace(A.ALERTS["brute_force"], mute_minutes=5 * 1440)
    rows = jobs.alert_rows(_stream(spark, d), spec, delay="0 seconds", span="1 day", min_failures=2)
    return _work_off(spark, rows, "al02").select("target_account", "_time")


@query("st06_stream_suppression", muted_sql(LOCKED, "locked_account", 86400))
def st06_stream(spark, d):
    rows = stream_suppress(A.search_lockout(_stream(spark, d)), "locked_account", 86400, "0 seconds")
    return _work_off(spark, rows, "st06").select("locked_account", "_time")


@query("st07_stream_lookup", W + f"""SELECT strftime(_time, {MICRO}) AS _time, Account_Name[2] AS actor, host FROM win
  WHERE EventCode IN ('4624', '4648') AND (hour(_time) < 7 OR hour(_time) >= 19)
  AND (regexp_matches(Account_Name[2], '(?i)(admin|jsmith|mchen)')
    OR Account_Name[2] IN (SELECT actor FROM win WHERE EventCode = '4719'))""")
def st07(spark, d):
    rows = A.search_after_hours_admin(_stream(spark, d), admins=bridge.admin_accounts(spark, d))
    return _work_off(spark, rows, "st07").select("_time", "actor", "host")
