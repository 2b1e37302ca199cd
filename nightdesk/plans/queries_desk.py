"""Registered queries: service-desk tables and directory."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nightdesk.functions import scalars as S
from nightdesk.operators import directory as D
from nightdesk.operators import tickets as T
from nightdesk.plans import bridge
from nightdesk.plans.procedures import register_procedures
from nightdesk.plans.registry import MICRO, ORACLE, query, with_
from nightdesk.session import shared_folder

# --- SQL views ------------------------------------------------------------------------------

REQ = """
people AS (
  SELECT c_custkey, lower(c_name) || '@example.test' AS mail, c_name, c_mktsegment, r_name, r_regionkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
talk AS (
  SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS body, arg_min(text, turn) FILTER (role = 'assistant') AS reply
  FROM conversations GROUP BY conv_id),
known AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_discount >= 0.09),
req AS (
  SELECT o_orderkey, o_orderkey::VARCHAR AS number,
    'Order ' || o_orderkey::VARCHAR || ' needs attention from the service desk team' AS subject, mail, c_name, r_name,
    r_regionkey, c_mktsegment, o_orderpriority, substr(o_orderpriority, 1, 1)::INTEGER AS pri, o_orderstatus,
    CASE o_orderkey % 6 WHEN 0 THEN 'Web' WHEN 1 THEN 'Email' WHEN 2 THEN 'Phone' WHEN 3 THEN 'API' ELSE 'Other' END AS source,
    o_orderdate AS created, s_suppkey, s_name, coalesce(body, 'no message') AS body, reply
  FROM orders JOIN people ON o_custkey = c_custkey
  LEFT JOIN supplier ON s_suppkey = CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % (SELECT count(*) FROM supplier) END
  LEFT JOIN talk ON conv_id = o_orderkey),
tk AS (
  SELECT *, coalesce(s_suppkey + 1, 0)::INTEGER AS staff_id, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS status_id,
    created + INTERVAL '8 hours' AS duedate,
    CASE WHEN o_orderstatus <> 'O' THEN created + INTERVAL '2 hours' END AS closed
  FROM req WHERE o_orderkey NOT IN (SELECT l_orderkey FROM known))
"""
TK = with_(REQ)
STATUS_NAME = "CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Resolved' ELSE 'Closed' END"


def build(spark, d, due="fixed"):
    dims = bridge.ticket_dims(spark, d)
    tickets = T.build_tickets(bridge.ticket_requests(spark, d), dims, bridge.known_tickets(spark, d), due)
    return tickets, dims


# --- tickets ---------------------------------------------------------------------------------


@query("tk01_load_dimension", """SELECT p_brand AS name, 'old' AS origin FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 40)
  UNION ALL SELECT p_brand, 'new' FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 40)
  UNION ALL SELECT DISTINCT p_type, 'new' FROM part""")
def tk01(spark, d):
    part = bridge.table(spark, d, "part")
    old = part.filter("p_size > 40").select(F.col("p_brand").alias("name"), F.lit("old").alias("origin")).distinct()
    new = part.select(F.explode(F.array("p_brand", "p_type")).alias("name"), F.lit("new").alias("origin"))
    return T.load_dimension(old, new, "name")


@query("tk01_load_topics", """SELECT DISTINCT c_mktsegment AS topic, length(c_mktsegment)::INTEGER AS topic_id, 5 AS sla_id,
  CASE WHEN length(c_mktsegment) > 8 THEN 1 ELSE 2 END AS dept_id,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 8 END AS topic_pid FROM customer""")
def tk01_topics(spark, d):
    dims = bridge.ticket_dims(spark, d)
    topic = F.col("topic")
    new = dims["help_topic"].select(
        "topic",
        "topic_id",
        F.lit("5-LOW").alias("sla_name"),
        F.when(F.length(topic) > 8, F.lit("AFRICA")).otherwise(F.lit("AMERICA")).alias("dept_name"),
        F.when(topic != "BUILDING", F.lit("BUILDING")).alias("parent_topic"),
    )
    existing = new.filter(F.lit(False)).select("topic", "topic_id")
    return T.load_topics(existing, new, dims["sla"], dims["department"])


@query("tk02_upsert_users", """SELECT lower(c_name) || '@example.test' AS id, c_name AS name FROM customer
  UNION ALL SELECT lower(s_name) || '@example.test', s_name FROM supplier""")
def tk02(spark, d):
    dims = bridge.ticket_dims(spark, d)
    people = dims["staff"].select(F.col("username").alias("name"), "email").unionByName(
        bridge.table(spark, d, "customer").select(
            F.lit("already known").alias("name"), F.concat(F.lower("c_name"), F.lit("@example.test")).alias("email")
        )
    )
    users, _ = T.upsert_users(dims["user"], dims["user_email"], people, bridge.NOW)
    return users.select("id", "name")


@query("tk02_upsert_emails", """SELECT lower(c_name) || '@example.test' AS address, lower(c_name) || '@example.test' AS user_id FROM customer
  UNION ALL SELECT lower(s_name) || '@example.test', lower(s_name) || '@example.test' FROM supplier""")
def tk02_emails(spark, d):
    dims = bridge.ticket_dims(spark, d)
    new = dims["staff"].select(F.col("username").alias("name"), "email")
    _, emails = T.upsert_users(dims["user"], dims["user_email"], new, bridge.NOW)
    return emails.select("address", "user_id")


@query("tk03_build_tickets", TK + f"""SELECT number AS ticket_id, number, mail AS user_id, mail AS user_email_id, status_id,
  (r_regionkey + 1)::INTEGER AS dept_id, pri AS sla_id, length(c_mktsegment)::INTEGER AS topic_id, staff_id, 0 AS team_id, source,
  '10.10.10.1' AS ip_address, 0 AS flags, 0 AS isoverdue, strftime(created, {MICRO}) AS created,
  strftime(created, {MICRO}) AS updated, strftime(created, {MICRO}) AS lastupdate, strftime(duedate, {MICRO}) AS duedate,
  strftime(closed, {MICRO}) AS closed FROM tk""")
def tk03(spark, d):
    return build(spark, d)[0].select(*T.TICKET_COLUMNS)


@query("tk03_due_by_sla", TK + f"""SELECT number, strftime(created + to_hours(pri * 4), {MICRO}) AS duedate FROM tk""")
def tk03_sla(spark, d):
    return build(spark, d, due="sla")[0].select("number", "duedate")


@query("tk04_build_threads", TK + f"""SELECT number AS thread_id, number AS object_id, 'T' AS object_type, '{{}}' AS extra,
  strftime(created, {MICRO}) AS lastmessage,
  CASE WHEN reply IS NOT NULL THEN strftime(created + INTERVAL '45 minutes', {MICRO}) END AS lastresponse,
  strftime(created, {MICRO}) AS created FROM tk""")
def tk04(spark, d):
    return T.build_threads(build(spark, d)[0])


@query("tk04_build_cdata", TK + "SELECT number AS ticket_id, subject FROM tk")
def tk04_cdata(spark, d):
    return T.build_cdata(build(spark, d)[0])


@query("tk05_build_entries", TK + f"""SELECT number AS thread_id, 0 AS staff_id, mail AS user_id, 'M' AS type, 0 AS flags, source,
  'html' AS format, subject AS title, body, strftime(created, {MICRO}) AS created, strftime(created, {MICRO}) AS updated,
  c_name AS poster FROM tk
UNION ALL SELECT number, staff_id, '0', 'R', 0, 'Web', 'html', 'Re: ' || subject, reply,
  strftime(created + INTERVAL '45 minutes', {MICRO}), strftime(created + INTERVAL '45 minutes', {MICRO}),
  'Agent ' || substr(s_name, 10, 12) FROM tk WHERE reply IS NOT NULL AND staff_id > 0""")
def tk05(spark, d):
    tickets, dims = build(spark, d)
    return T.build_entries(tickets, dims["user"], dims["staff"])


@query("tk06_ticket_report", TK + f"""SELECT number, subject, c_name AS requester, 'Agent ' || substr(s_name, 10, 12) AS agent,
  r_name AS department, {STATUS_NAME} AS status, strftime(created, {MICRO}) AS created FROM tk""")
def tk06(spark, d):
    tickets, dims = build(spark, d)
    return T.ticket_report(tickets, None, dims)


@query("tk06_ticket_report_short", TK + f"""SELECT number, substr(subject, 1, 45) AS subject, c_name AS requester,
  'Agent ' || substr(s_name, 10, 12) AS agent, {STATUS_NAME} AS status FROM tk""")
def tk06_short(spark, d):
    tickets, dims = build(spark, d)
    return T.ticket_report(tickets, T.build_cdata(tickets), dims, short=True)


@query("tk07_people_listing", """SELECT 'Agent' AS type, 'Agent ' || substr(s_name, 10, 12) AS name, lower(s_name) || '@example.test' AS email,
  CASE WHEN s_suppkey % 7 = 0 THEN 'Admin' ELSE 'Agent' END AS role FROM supplier
UNION ALL SELECT 'End User', c_name, lower(c_name) || '@example.test', 'Requester' FROM customer""")
def tk07(spark, d):
    dims = bridge.ticket_dims(spark, d)
    return T.people_listing(dims["staff"], dims["user"], dims["user_email"])


@query("tk08_config_listing", """SELECT 'SLA' AS section, o_orderpriority AS item FROM (SELECT DISTINCT o_orderpriority FROM orders)
UNION ALL SELECT 'Department', r_name FROM region
UNION ALL SELECT 'Help Topic', c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def tk08(spark, d):
    dims = bridge.ticket_dims(spark, d)
    return T.config_listing(dims["sla"], dims["department"], dims["help_topic"])


@query("v02_upsert_user_call", """SELECT lower(c_name) || '@example.test' AS id, c_name AS name FROM customer
  UNION ALL SELECT lower(s_name) || '@example.test', s_name FROM supplier""")
def v02(spark, d):
    """The procedure called in SQL for suppliers and for customers, whose addresses are known."""
    dims = bridge.ticket_dims(spark, d)
    people = bridge.table(spark, d, "customer").selectExpr("'already known' AS name", "lower(c_name) || '@example.test' AS mail").unionByName(
        dims["staff"].select(F.col("username").alias("name"), F.col("email").alias("mail"))
    )
    register_procedures(spark, dims, bridge.NOW, people=people)
    dims["user"].createOrReplaceTempView("desk_user")
    return spark.sql("SELECT id, name FROM desk_user UNION ALL SELECT id, name FROM upsert_users()")


@query("v03_seed_ticket_call", ORACLE["tk03_build_tickets"])
def v03(spark, d):
    """The procedure called in SQL for every request."""
    register_procedures(
        spark, bridge.ticket_dims(spark, d), bridge.NOW, bridge.known_tickets(spark, d), requests=bridge.ticket_requests(spark, d)
    )
    return spark.sql(f"SELECT {', '.join(T.TICKET_COLUMNS)} FROM seed_tickets()")


def queue_query(name, where, sql_where, **options):
    @query(name, TK + f"SELECT number, mail AS user_id, staff_id FROM tk WHERE o_orderstatus = 'O' AND {sql_where}")
    def run(spark, d):
        tickets, dims = build(spark, d)
        return T.queue(tickets, dims["ticket_status"], where, **options).select("number", "user_id", "staff_id")

    return run


queue_query("tk09_queue_my_open", "My Open", "staff_id = 3", me=3)
queue_query("tk09_queue_unassigned", "Unassigned", "staff_id = 0")
queue_query("tk09_queue_high_priority", "High Priority", "pri <= 2")
queue_query(
    "tk09_queue_closing_today", "Closing Today", "duedate::DATE = DATE '1996-03-01'", now="1996-03-01 12:00:00"
)


@query("tk10_visible_tickets", TK + "SELECT number, dept_id FROM (SELECT number, (r_regionkey + 1)::INTEGER AS dept_id FROM tk) WHERE dept_id = 3")
def tk10(spark, d):
    tickets, dims = build(spark, d)
    return T.visible_tickets(tickets, dims["staff"], "Supplier#000000002", network_dept=3).select("number", "dept_id")


@query("tk10_visible_counts", TK + """SELECT s.s_name AS username, CASE WHEN s.s_suppkey % 7 = 0 THEN (SELECT count(*) FROM tk)
  WHEN s.s_suppkey % 5 + 1 = 3 THEN (SELECT count(*) FROM tk WHERE r_regionkey = 2)
  ELSE coalesce(n, 0) END AS visible
  FROM supplier s LEFT JOIN (SELECT s_suppkey AS k, count(*) AS n FROM tk GROUP BY 1) ON k = s.s_suppkey""")
def tk10_counts(spark, d):
    tickets, dims = build(spark, d)
    return T.visible_counts(tickets, dims["staff"], network_dept=3)


@query("tk12_reset_seed", """SELECT 'user' AS tbl, count(*) AS n FROM customer WHERE NOT (c_name IN ('Customer#000000001', 'Customer#000000002'))
UNION ALL SELECT 'user_email', count(*) FROM customer
  WHERE NOT (lower(c_name) || '@example.test' LIKE '%1@example.test' AND lower(c_name) || '@example.test' NOT LIKE 'customer#00000001%')
UNION ALL SELECT 'staff', count(*) FROM supplier WHERE NOT (s_name BETWEEN 'Supplier#000000002' AND 'Supplier#000000004')
UNION ALL SELECT 'department', count(*) FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE')""")
def tk12(spark, d):
    dims = bridge.ticket_dims(spark, d)
    tables = {k: dims[k] for k in ("user", "user_email", "staff", "department")}
    kept = T.reset_seed(
        tables,
        {
            "user": F.col("name").isin("Customer#000000001", "Customer#000000002"),
            "user_email": F.col("address").like("%1@example.test") & ~F.col("address").like("customer#00000001%"),
            "staff": F.col("username").between("Supplier#000000002", "Supplier#000000004"),
            "department": F.col("name").isin("ASIA", "EUROPE"),
        },
    )
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("tbl"), "n") for k, df in kept.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("t06_first_match_lookup", """SELECT o_orderkey, t.p AS cheapest FROM orders LEFT JOIN (
  SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY 1) t ON l_orderkey = o_orderkey""")
def t06(spark, d):
    orders = bridge.table(spark, d, "orders").select("o_orderkey")
    return T.resolve(
        orders, bridge.table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", "l_partkey", "cheapest", None
    )


# --- directory -----------------------------------------------------------------------------------

DIR = """
pairs AS (
  SELECT DISTINCT 'c' || o_custkey::VARCHAR AS sam, 'GRP-' || replace(o_orderpriority, ' ', '-') AS grp FROM orders
  UNION ALL SELECT 'c' || c_custkey::VARCHAR, 'GRP-' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'c' || c_custkey::VARCHAR, 'Domain Users' FROM customer),
grps AS (
  SELECT DISTINCT 'GRP-' || replace(o_orderpriority, ' ', '-') AS name FROM orders
  UNION SELECT 'GRP-' || n_name FROM nation UNION SELECT 'GRP-' || replace(r_name, ' ', '-') FROM region),
seen AS (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY 1),
usr AS (
  SELECT 'c' || c_custkey::VARCHAR AS sam, c_name AS name, CASE WHEN c_custkey % 19 <> 0 THEN c_mktsegment END AS dept,
    CASE WHEN c_custkey % 23 <> 0 THEN 'Tier ' || c_nationkey::VARCHAR END AS title,
    CASE WHEN c_custkey % 29 <> 0 THEN lower(c_name) || '@example.test' END AS mail,
    CASE WHEN c_custkey >= 10 THEN 'c' || (c_custkey // 10)::VARCHAR END AS manager,
    c_custkey % 7 <> 0 AS enabled, c_custkey % 11 = 0 AS locked_out, c_custkey % 13 = 0 AS password_expired,
    CASE WHEN c_custkey % 17 <> 0 THEN last_order END AS password_last_set, last_order AS last_logon, c_custkey
  FROM customer LEFT JOIN seen ON o_custkey = c_custkey),
wants AS (
  SELECT request_id, sam, CASE WHEN request_id % 3 = 0 THEN lower(grp) ELSE grp END AS grp, action FROM (
  SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 5 = 0 THEN 'C' ELSE 'c' END || (o_custkey + o_orderkey % 3)::VARCHAR AS sam,
    CASE WHEN o_orderkey % 10 = 7 THEN n_name WHEN o_orderkey % 10 = 8 THEN 'urgent' WHEN o_orderkey % 10 = 9 THEN 'no such group'
      WHEN o_orderkey % 2 = 0 THEN 'GRP-' || replace(o_orderpriority, ' ', '-') ELSE 'GRP-' || n_name END AS grp,
    CASE WHEN o_orderkey % 4 = 3 THEN 'Remove' ELSE 'Add' END AS action
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey)),
sugg AS (
  SELECT w.grp, array_to_string(list_sort(list(DISTINCT name)), ',') AS suggestions
  FROM (SELECT DISTINCT grp FROM wants WHERE lower(grp) NOT IN (SELECT lower(name) FROM grps)) w
  JOIN grps ON contains(lower(name), lower(w.grp)) GROUP BY 1),
plan AS (
  SELECT w.request_id, coalesce(u.sam, w.sam) AS sam, coalesce(g.name, w.grp) AS grp, w.action, u.sam IS NOT NULL AS has_user, g.name IS NOT NULL AS has_group, p.sam IS NOT NULL AS member, suggestions,
    CASE WHEN u.sam IS NULL THEN 'FAILED — user not found' WHEN g.name IS NULL THEN 'FAILED — group not found'
      WHEN action = 'Add' AND p.sam IS NOT NULL THEN 'Skipped — already a member'
      WHEN action = 'Remove' AND p.sam IS NULL THEN 'Skipped — not a member' ELSE 'SUCCESS' END AS result
  FROM wants w LEFT JOIN usr u ON u.sam = lower(w.sam) LEFT JOIN grps g ON lower(g.name) = lower(w.grp)
  LEFT JOIN pairs p ON p.sam = lower(w.sam) AND lower(p.grp) = lower(w.grp) LEFT JOIN sugg s ON s.grp = w.grp)
"""
DR = with_(DIR)


@query("dr01_memberships", DR + """SELECT sam, grp AS "group", CASE WHEN grp = 'Domain Users' THEN 'WARN' ELSE 'OK' END AS status FROM pairs""")
def dr01(spark, d):
    return D.memberships(bridge.ad_users(spark, d, with_groups=True), bridge.ad_groups(spark, d))


STATUS = """CASE WHEN enabled AND NOT locked_out AND NOT password_expired THEN 'Active' ELSE
  array_to_string(list_filter([CASE WHEN NOT enabled THEN 'DISABLED' END, CASE WHEN locked_out THEN 'LOCKED' END,
    CASE WHEN password_expired THEN 'PW-EXPIRED' END], lambda x: x IS NOT NULL), ', ') END"""


@query("dr02_user_summary", DR + f"""SELECT u.name AS display_name, u.sam AS username, coalesce(u.dept, 'N/A') AS department,
  coalesce(u.title, 'N/A') AS title, coalesce(m.name, 'N/A') AS manager, coalesce(u.mail, 'N/A') AS email,
  u.st AS status, coalesce(strftime(u.last_logon, '%Y-%m-%d %H:%M'), 'Never') AS last_logon,
  coalesce(strftime(u.password_last_set, '%Y-%m-%d %H:%M'), 'Never') AS pw_last_set
  FROM (SELECT *, {STATUS} AS st FROM usr) u LEFT JOIN usr m ON m.sam = u.manager""")
def dr02(spark, d):
    return D.user_summary(bridge.ad_users(spark, d))


@query("dr03_find_users", DR + """SELECT name, sam, dept, CASE WHEN NOT enabled AND locked_out THEN 'DISABLED,LOCKED'
  WHEN NOT enabled THEN 'DISABLED' WHEN locked_out THEN 'LOCKED' ELSE 'Active' END AS status FROM usr
  WHERE contains(lower(sam), '77') OR contains(lower(name), '77') OR contains(lower(mail), '77')""")
def dr03(spark, d):
    return D.find_users(bridge.ad_users(spark, d), "77")


@query("dr04_list_groups", DR + """SELECT name, count(sam) AS members FROM grps LEFT JOIN pairs ON grp = name GROUP BY 1""")
def dr04(spark, d):
    return D.list_groups(bridge.ad_groups(spark, d), bridge.ad_memberships(spark, d), "grp-")


def inventory(spark, d):
    """Expected: nations and suppliers' nations; actual: what customers refer to."""
    nation, customer = bridge.table(spark, d, "nation"), bridge.table(spark, d, "customer")
    part, supplier = bridge.table(spark, d, "part"), bridge.table(spark, d, "supplier")
    expected = nation.select(F.lit("nation").alias("kind"), F.col("n_name").alias("name")).unionByName(
        part.select(F.lit("brand").alias("kind"), F.col("p_brand").alias("name")).distinct()
    )
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    actual = joined.select(
        F.lit("nation").alias("kind"), F.col("n_name").alias("name"), F.lit("customer").alias("detail")
    ).unionByName(
        supplier.select(
            F.lit("brand").alias("kind"),
            F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 20).cast("string")).alias("name"),
            F.lit("supplier").alias("detail"),
        )
    )
    return expected, actual


CHECKS = """checks AS (
  SELECT e.kind, e.name, CASE WHEN a.name IS NULL THEN 'FAIL' ELSE 'PASS' END AS result, a.detail FROM (
    SELECT 'nation' AS kind, n_name AS name FROM nation UNION ALL SELECT DISTINCT 'brand', p_brand FROM part) e
  LEFT JOIN (SELECT DISTINCT 'nation' AS kind, n_name AS name, 'customer' AS detail FROM customer
      JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT DISTINCT 'brand', 'Brand#' || (s_suppkey % 20)::VARCHAR, 'supplier' FROM supplier) a
  ON a.kind = e.kind AND a.name = e.name)"""


@query("dr05_verify_inventory", with_(CHECKS) + "SELECT kind, name, result, detail FROM checks")
def dr05(spark, d):
    return D.verify_inventory(*inventory(spark, d))


@query("dr05_inventory_failures", with_(CHECKS) + "SELECT count(*) AS checks, count(*) FILTER (result = 'FAIL') AS failures FROM checks")
def dr05_failures(spark, d):
    return D.inventory_failures(D.verify_inventory(*inventory(spark, d)))


@query("dr06_reporting_lines", DR + "SELECT u.sam, u.manager, m.name AS manager_name FROM usr u JOIN usr m ON m.sam = u.manager")
def dr06(spark, d):
    return D.reporting_lines(bridge.ad_users(spark, d))


def stored(spark, df, name):
    """The same rows from a written table, for inputs that several branches of a plan read."""
    path = shared_folder(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def decisions(spark, d):
    groups = stored(spark, bridge.ad_groups(spark, d), "groups")
    requests = stored(spark, bridge.group_requests(spark, d), "requests")
    return D.plan_group_changes(requests, bridge.ad_users(spark, d).select("sam"), groups, bridge.ad_memberships(spark, d))


@query("dr07_plan_group_changes", DR + """SELECT request_id, sam, grp AS "group", action, result,
  action = 'Remove' AND member AND regexp_matches(grp, '(?i)(Domain Admin|Enterprise Admin|IT.Admin|Admin)') AS privileged_warning,
  suggestions FROM plan""")
def dr07(spark, d):
    return decisions(spark, d)


@query("dr08_apply_group_changes", DR + """SELECT sam, grp AS "group" FROM (
  SELECT sam, grp FROM pairs UNION SELECT sam, grp FROM plan WHERE result = 'SUCCESS' AND action = 'Add')
  EXCEPT SELECT sam, grp FROM plan WHERE result = 'SUCCESS' AND action = 'Remove'""")
def dr08(spark, d):
    return D.apply_group_changes(bridge.ad_memberships(spark, d), decisions(spark, d))


@query("dr09_offboarding_report", DR + """SELECT u.sam AS username, u.name AS employee, coalesce(dept, 'N/A') AS department,
  groups_removed, n::INTEGER AS n_groups,
  'DEPARTED 2024-01-31 | Reason: ' || reason || ' | Offboarded by: agent1 | Ticket: ' || coalesce(ticket, '') AS description,
  '[DEPARTED] ' || u.name AS display_name, '2024-04-30' AS delete_after FROM usr u
  JOIN (SELECT sam, array_to_string(list_sort(list(grp)), ',') AS groups_removed, count(*) AS n FROM pairs
    WHERE grp <> 'Domain Users' GROUP BY 1) g ON g.sam = u.sam
  JOIN (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Resigned' WHEN 1 THEN 'Terminated' WHEN 2 THEN 'Transferred'
    ELSE 'LeaveOfAbsence' END AS reason, CASE WHEN c_custkey % 3 <> 0 THEN 'T' || c_custkey::VARCHAR END AS ticket
    FROM customer) r ON r.c_custkey = u.c_custkey""")
def dr09(spark, d):
    k = F.col("c_custkey")
    reasons = F.array(*[F.lit(r) for r in ("Resigned", "Terminated", "Transferred", "LeaveOfAbsence")])
    requests = bridge.table(spark, d, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("username"),
        F.get(reasons, (k % 4).cast("int")).alias("reason"),
        F.lit("agent1").alias("agent"),
        F.when(k % 3 != 0, F.concat(F.lit("T"), k.cast("string"))).alias("ticket"),
    )
    report = D.offboarding_report(
        requests, bridge.ad_users(spark, d), bridge.ad_memberships(spark, d), bridge.NOW
    )
    return report.select(
        "username", "employee", "department", "groups_removed", "n_groups", "description", "display_name", "delete_after"
    )


@query("u04_removable_groups", DR + """SELECT sam, grp AS "group" FROM pairs WHERE grp <> 'Domain Users'""")
def u04(spark, d):
    return D.removable_groups(bridge.ad_memberships(spark, d))


@query("j08_membership_test", DR + """SELECT request_id, sam, grp AS "group", action FROM wants w
  WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.sam = lower(w.sam) AND lower(p.grp) = lower(w.grp))""")
def j08(spark, d):
    return D.is_member(bridge.ad_memberships(spark, d), bridge.group_requests(spark, d))


@query("j10_did_you_mean", """SELECT DISTINCT w.wanted, array_to_string(list_sort(list(DISTINCT p_name)), ',') AS suggestions FROM (
  SELECT DISTINCT substr(p_name, 2, 4) AS wanted FROM part UNION SELECT DISTINCT substr(p_brand, 6, 2) FROM part
  UNION SELECT 'no such name') w
  JOIN part ON contains(lower(p_name), lower(w.wanted)) GROUP BY w.wanted""")
def j10(spark, d):
    part = bridge.table(spark, d, "part")
    wanted = part.select(
        F.explode(F.array(F.substring("p_name", 2, 4), F.substring("p_brand", 6, 2), F.lit("no such name"))).alias("wanted")
    ).distinct()
    return D.suggest_groups(wanted, part.select(F.col("p_name").alias("name")))


@query("c03_ticket_source", TK + "SELECT source, count(*) AS n FROM req GROUP BY 1")
def c03(spark, d):
    return bridge.ticket_requests(spark, d).groupBy(S.ticket_source("source").alias("source")).agg(
        F.count(F.lit(1)).alias("n")
    )
