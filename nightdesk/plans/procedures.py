"""The service desk's stored procedures as SQL table functions.

``register_procedures`` makes them known to a session.  A call with arguments is a lateral join::

    SELECT t.* FROM requests r, LATERAL seed_ticket(r.number, r.subject, ...) t

The optimizer makes joins with the desk's tables of it, but it first reduces the rows to their distinct
arguments and joins the result back on all of them, so every row is shuffled with all its arguments twice
more.  For whole tables of calls there is the same procedure over a view of arguments, which is joined with the
desk's tables at once and reads no argument that is not asked for::

    SELECT ticket_id, number FROM seed_tickets()
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.timerange import as_datetime

#: Per view of the desk: its table, the column that is looked up and the columns that are found.
VIEWS = {
    "desk_mail": ("user_email", "address", ["id", "user_id"]),
    "desk_department": ("department", "name", ["id"]),
    "desk_topic": ("help_topic", "topic", ["topic_id"]),
    "desk_sla": ("sla", "name", ["id"]),
    "desk_staff": ("staff", "username", ["staff_id"]),
    "desk_status": ("ticket_status", "lower(name)", ["id"]),
}
_USER = "id STRING, org_id INT, default_email_id STRING, status INT, name STRING, created TIMESTAMP, updated TIMESTAMP"
_PERSON = "name STRING, mail STRING"
_TICKET = """ticket_id STRING, number STRING, user_id STRING, user_email_id STRING, status_id INT, dept_id INT, sla_id INT,
  topic_id INT, staff_id INT, team_id INT, source STRING, ip_address STRING, flags INT, isoverdue INT, created TIMESTAMP,
  updated TIMESTAMP, lastupdate TIMESTAMP, duedate TIMESTAMP, closed TIMESTAMP, priority INT, subject STRING, body STRING, reply STRING"""
_ARGUMENTS = """number STRING, subject STRING, body STRING, user_email STRING, dept_name STRING, topic_name STRING, sla_name STRING,
  priority INT, status STRING, source STRING, created TIMESTAMP, agent_user STRING, reply STRING"""


def _rows(arguments: str, view: str | None = None) -> str:
    """The calls as a table: one of the function's arguments, or all of a view's rows in the arguments' types."""
    pairs = [a.split() for a in arguments.replace("\n", " ").split(", ")]
    if view is None:
        return "SELECT " + ", ".join(f"p_{name} AS {name}" for name, _ in pairs)
    return "SELECT " + ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in pairs) + f" FROM {view}"


def register_procedures(
    spark: SparkSession, tables: Mapping[str, DataFrame], now, tickets: DataFrame | None = None,
    people: DataFrame | None = None, requests: DataFrame | None = None,
) -> None:
    """``upsert_user(name, mail)`` and ``seed_ticket(...)`` over the given desk tables.

    ``upsert_user`` gives the new user and nothing where the address is known; ``seed_ticket`` gives
    the ticket and nothing where the number is.  Tables are reduced to one row per looked-up name, so
    a call gives one row at most.  Calls of one statement do not see each other: reduce the requests
    to one per address or number first.  ``people`` and ``requests`` hold the arguments of many calls under
    the arguments' names: with them there are ``upsert_users()`` and ``seed_tickets()``, a call per row.
    """
    for view, (name, key, columns) in VIEWS.items():
        picked = F.min(F.struct(*columns)).alias("found")
        tables[name].groupBy(F.expr(key).alias("key")).agg(picked).select("key", "found.*").createOrReplaceTempView(view)
    if tickets is None:
        tickets = spark.createDataFrame([], "number string")
    tickets.select("number").distinct().createOrReplaceTempView("desk_ticket")
    stamp = f"TIMESTAMP '{as_datetime(now)}'"
    sources = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.TICKET_SOURCES.items())

    def user(rows: str) -> str:
        return f"""SELECT x.mail, 0, x.mail, 0, x.name, {stamp}, {stamp} FROM ({rows}) x LEFT ANTI JOIN desk_mail e ON e.key = x.mail"""

    def ticket(rows: str) -> str:
        return f"""SELECT x.number, x.number, coalesce(m.user_id, '0'), coalesce(m.id, '0'),
        CASE WHEN coalesce(st.id, 1) = 0 THEN 1 ELSE coalesce(st.id, 1) END, coalesce(d.id, 0), coalesce(s.id, 0),
        coalesce(tp.topic_id, 0), coalesce(a.staff_id, 0), 0, CASE lower(x.source) {sources} ELSE 'Other' END, '{vocab.TICKET_IP}', 0, 0,
        x.created, x.created, x.created, x.created + INTERVAL 8 HOURS,
        CASE WHEN lower(x.status) IN ('resolved', 'closed') THEN x.created + INTERVAL 2 HOURS END, x.priority, x.subject, x.body, x.reply
      FROM ({rows}) x
      LEFT ANTI JOIN desk_ticket k ON k.number = x.number
      LEFT JOIN desk_mail m ON m.key = x.user_email LEFT JOIN desk_department d ON d.key = x.dept_name
      LEFT JOIN desk_topic tp ON tp.key = x.topic_name LEFT JOIN desk_sla s ON s.key = x.sla_name
      LEFT JOIN desk_staff a ON a.key = x.agent_user LEFT JOIN desk_status st ON st.key = lower(x.status)"""

    for name, many, arguments, returns, body, calls in (
        ("upsert_user", "upsert_users", _PERSON, _USER, user, people), ("seed_ticket", "seed_tickets", _ARGUMENTS, _TICKET, ticket, requests)
    ):
        given = ", ".join(f"p_{a.strip()}" for a in arguments.replace("\n", " ").split(", "))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE ({returns}) RETURN {body(_rows(arguments))}")
        if calls is not None:
            calls.createOrReplaceTempView(f"desk_{many}")
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {many}() RETURNS TABLE ({returns}) RETURN {body(_rows(arguments, f'desk_{many}'))}")
