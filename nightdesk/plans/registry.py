"""Registry of the queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame, separator: str = ",") -> DataFrame:
    """Comparable columns: arrays joined to text, times and dates as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "array<string>":
            c = F.array_join(c, separator)
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its result is made comparable and its times are UTC."""

    def bind(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(build(spark, sf_dir))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return bind


# --- SQL views of the same inputs -----------------------------------------------------

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
MICRO = "'%Y-%m-%d %H:%M:%S.%f'"
SECOND = "'%Y-%m-%d %H:%M:%S'"
MINUTE = "'%Y-%m-%d %H:%M'"
EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"

WIN = """
win AS (
  SELECT ts AS _time, event_id, user_id,
    CASE WHEN event_id % 10 = 0 THEN 'DC02' ELSE 'DC01' END AS host,
    code AS EventCode,
    CASE WHEN event_type IN ('error', 'click')
      THEN CASE WHEN event_id % 17 = 0 THEN ['DC01$'] ELSE ['DC01$', acct] END
      ELSE [acct] END AS Account_Name,
    CASE WHEN code IN ('4728', '4732', '4756') THEN
      [CASE event_id % 6 WHEN 0 THEN 'Domain Admins' WHEN 1 THEN 'Backup Operators' WHEN 2 THEN 'GRP-VPN-Users'
        WHEN 3 THEN 'GRP-HR-Staff' WHEN 4 THEN 'administrators' ELSE 'GRP-IT-Admins' END]
      ELSE [acct] END AS Target_Account_Name,
    CASE event_id % 5 WHEN 0 THEN 'Administrator' WHEN 1 THEN 'SYSTEM' ELSE acct END AS actor,
    CASE WHEN event_id % 23 <> 0 THEN 'CORP' END AS domain,
    CASE WHEN code IN ('4728', '4732', '4756') AND event_id % 19 <> 0
      THEN 'user' || (user_id * 7 % 1000)::VARCHAR END AS member,
    CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'SRV1' ELSE 'WS' || (event_id % 7)::VARCHAR END AS caller,
    CASE event_id % 9 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN '4' WHEN 3 THEN '5' WHEN 4 THEN '7'
      WHEN 5 THEN '8' WHEN 6 THEN '9' WHEN 7 THEN '10' ELSE '11' END AS Logon_Type,
    CASE event_id % 8 WHEN 0 THEN '0xC000006D' WHEN 1 THEN '0xC0000234' WHEN 2 THEN '0xC0000072'
      WHEN 3 THEN '0xC000006F' WHEN 4 THEN '0xC0000070' WHEN 5 THEN '0xC0000193' WHEN 6 THEN '0xC0000001'
      ELSE '0xC0000002' END AS Status,
    CASE WHEN event_id % 8 IN (0, 6) THEN '0xC0000064' WHEN event_id % 8 = 7 THEN '0x0' ELSE '0xC000006E' END AS Sub_Status,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '127.0.0.1'
      ELSE '10.0.0.' || (event_id % 20)::VARCHAR END AS IpAddress,
    CASE WHEN event_id % 22 = 0 THEN '-' END AS Source_Network_Address,
    CASE WHEN event_id % 15 <> 0 THEN 'WS' || (event_id % 30)::VARCHAR END AS WorkstationName,
    CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'groupPolicyContainer' END AS Object_Class,
    CASE WHEN code IN ('5136', '5137', '5141') AND event_id % 29 <> 0
      THEN 'CN={gpo' || (event_id % 12)::VARCHAR || '},CN=Policies,CN=System' END AS dn,
    CASE event_id % 4 WHEN 0 THEN 'gPCFileSysPath' WHEN 1 THEN 'versionNumber' WHEN 2 THEN 'displayName' END AS attr,
    CASE WHEN event_id % 5 <> 0 THEN 'v' || (event_id % 7)::VARCHAR END AS old_v,
    CASE WHEN event_id % 6 <> 0 THEN 'v' || (event_id % 9)::VARCHAR END AS new_v,
    CASE WHEN code = '4719' THEN CASE event_id % 3 WHEN 0 THEN 'Success removed' WHEN 1 THEN 'Failure added' END END AS policy
  FROM (
    SELECT *,
      CASE event_type
        WHEN 'error' THEN '4625'
        WHEN 'click' THEN CASE WHEN event_id % 5 = 0 THEN '4648' ELSE '4624' END
        WHEN 'signup' THEN CASE event_id % 4 WHEN 0 THEN '4720' WHEN 1 THEN '4722' WHEN 2 THEN '4738' ELSE '4724' END
        WHEN 'purchase' THEN CASE event_id % 4 WHEN 2 THEN '4767' WHEN 3 THEN '4726' ELSE '4740' END
        WHEN 'view' THEN CASE event_id % 8 WHEN 0 THEN '5136' WHEN 1 THEN '5137' WHEN 2 THEN '5141' WHEN 3 THEN '4719'
          WHEN 4 THEN '4728' WHEN 5 THEN '4732' WHEN 6 THEN '4756' ELSE '4723' END
      END AS code,
      CASE user_id % 20 WHEN 3 THEN 'svc_backup' WHEN 7 THEN 'adm_jsmith' WHEN 9 THEN 'mchen'
        ELSE 'user' || user_id::VARCHAR END AS acct
    FROM events
  )
)
"""

WEB = """
web AS (
  SELECT date_trunc('second', ts) AS _time, '10.0.1.' || (user_id % 50)::VARCHAR AS client_ip, 'GET' AS method,
    CASE WHEN event_id % 10 = 1 THEN '/' WHEN event_id % 9 = 0 THEN '/scp/tickets.php'
      ELSE regexp_extract(url, '^https?://[^/]+(/[^ ]*)', 1) END AS uri,
    CASE event_id % 10 WHEN 5 THEN '301' WHEN 6 THEN '304' WHEN 7 THEN '403' WHEN 8 THEN '404' WHEN 9 THEN '500'
      ELSE '200' END AS status,
    CASE WHEN event_id % 19 = 0 THEN '-' ELSE (event_id % 5000)::VARCHAR END AS bytes,
    strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' AS stamp
  FROM events JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages)
)
"""


def with_(*views: str) -> str:
    return "WITH " + ", ".join(v.strip() for v in views) + "\n"
