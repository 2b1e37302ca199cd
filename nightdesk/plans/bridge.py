"""The library's inputs derived from the star-schema test tables.

Each function is one lazy projection (plus joins where stated) over whole
tables, so every registered query grows with the data it is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.scalars import first_per_key
from nightdesk.functions.timerange import TimeRange

NOW = "2024-01-31 00:00:00"

_SOURCE_TYPE = {
    "error": [vocab.LOGON_FAILED],
    "click": [vocab.LOGON, vocab.LOGON_EXPLICIT],
    "signup": [vocab.ACCOUNT_CREATED, vocab.ACCOUNT_ENABLED, vocab.ACCOUNT_CHANGED, vocab.PASSWORD_RESET],
    "purchase": [vocab.LOCKED_OUT, vocab.UNLOCKED, vocab.ACCOUNT_DELETED],
    "view": vocab.POLICY_CODES + vocab.GROUP_ADD_CODES + [vocab.PASSWORD_CHANGE],
}


TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,
        props string""",
    "pages": "page_id bigint, url string, html string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by its fixed schema, so no file is opened to plan a query."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mod(c: str, n: int) -> Column:
    return F.col(c) % n


def _pick(index: Column, values: Sequence[str | None]) -> Column:
    """Value by position; null where the position holds none."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def raw_events(
    spark: SparkSession,
    sf_dir: str,
    codes: Sequence[str] | None = None,
    time: TimeRange | None = None,
) -> DataFrame:
    """The ``events`` table, narrowed at the scan.

    ``codes`` and ``time`` repeat the query's own filters on the stored columns
    so that they reach the file reader; they never change a result.
    """
    raw = table(spark, sf_dir, "events")
    if codes is not None:
        kinds = [k for k, produced in _SOURCE_TYPE.items() if set(produced) & set(codes)]
        raw = raw.filter(F.col("event_type").isin(kinds))
    if time is not None:
        low, high = (F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in (time.earliest, time.latest))
        raw = raw.filter((F.col("ts") >= low) & (F.col("ts") < high))
    return raw


def _case(index: str, *texts: str | None) -> str:
    """SQL text: one of the values by position."""
    items = ", ".join("NULL" if t is None else f"'{t}'" for t in texts)
    return f"get(array({items}), cast({index} AS int))"


def win_event_columns(raw: DataFrame) -> DataFrame:
    """Security events from event rows; works on batch and streaming input."""
    code = f"""CASE event_type
        WHEN 'error' THEN '4625'
        WHEN 'click' THEN if(event_id % 5 = 0, '4648', '4624')
        WHEN 'signup' THEN {_case("event_id % 4", "4720", "4722", "4738", "4724")}
        WHEN 'purchase' THEN {_case("event_id % 4", "4740", "4740", "4767", "4726")}
        WHEN 'view' THEN {_case("event_id % 8", "5136", "5137", "5141", "4719", "4728", "4732", "4756", "4723")}
        END AS EventCode"""
    acct = """CASE user_id % 20 WHEN 3 THEN 'svc_backup' WHEN 7 THEN 'adm_jsmith' WHEN 9 THEN 'mchen'
        ELSE concat('user', user_id) END AS acct"""
    is_group = "EventCode IN ('4728', '4732', '4756')"
    is_object = "EventCode IN ('5136', '5137', '5141')"
    group = _case("event_id % 6", "Domain Admins", "Backup Operators", "GRP-VPN-Users", "GRP-HR-Staff",
                  "administrators", "GRP-IT-Admins")
    logon_type = _case("event_id % 9", "2", "3", "4", "5", "7", "8", "9", "10", "11")
    status = _case("event_id % 8", "0xC000006D", "0xC0000234", "0xC0000072", "0xC000006F", "0xC0000070",
                   "0xC0000193", "0xC0000001", "0xC0000002")
    attribute = _case("event_id % 4", "gPCFileSysPath", "versionNumber", "displayName", None)
    policy = _case("event_id % 3", "Success removed", "Failure added", None)
    return raw.selectExpr("event_id", "event_type", "ts", "user_id", code, acct).selectExpr(
        "cast(ts AS timestamp) AS _time",
        "if(event_id % 10 = 0, 'DC02', 'DC01') AS host",
        f"'{vocab.SECURITY_INDEX}' AS index",
        f"'{vocab.SECURITY_SOURCETYPE}' AS sourcetype",
        "EventCode",
        """CASE WHEN event_type NOT IN ('error', 'click') THEN array(acct)
            WHEN event_id % 17 = 0 THEN array('DC01$') ELSE array('DC01$', acct) END AS Account_Name""",
        f"array(if({is_group}, {group}, acct)) AS Target_Account_Name",
        """array(CASE event_id % 5 WHEN 0 THEN 'Administrator' WHEN 1 THEN 'SYSTEM' ELSE acct END)
            AS Subject_Account_Name""",
        "if(event_id % 23 <> 0, array('CORP'), NULL) AS Subject_Account_Domain",
        f"""if({is_group} AND event_id % 19 <> 0, array(concat('user', user_id * 7 % 1000)), NULL)
            AS Member_Account_Name""",
        """array(CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'SRV1' ELSE concat('WS', event_id % 7) END)
            AS Caller_Computer_Name""",
        f"{logon_type} AS Logon_Type",
        f"{status} AS Status",
        """CASE WHEN event_id % 8 IN (0, 6) THEN '0xC0000064' WHEN event_id % 8 = 7 THEN '0x0'
            ELSE '0xC000006E' END AS Sub_Status""",
        """CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '127.0.0.1'
            ELSE concat('10.0.0.', event_id % 20) END AS IpAddress""",
        "if(event_id % 22 = 0, '-', NULL) AS Source_Network_Address",
        "if(event_id % 15 <> 0, concat('WS', event_id % 30), NULL) AS WorkstationName",
        "if(event_id % 3 = 0, 'user', 'groupPolicyContainer') AS Object_Class",
        f"""if({is_object} AND event_id % 29 <> 0,
            array(concat('CN={{gpo', event_id % 12, '}},CN=Policies,CN=System')), NULL) AS Object_DN""",
        f"{attribute} AS LDAP_Display_Name",
        "if(event_id % 5 <> 0, concat('v', event_id % 7), NULL) AS Old_Value",
        "if(event_id % 6 <> 0, concat('v', event_id % 9), NULL) AS New_Value",
        f"if(EventCode = '{vocab.AUDIT_POLICY_CHANGED}', {policy}, NULL) AS Policy_Change",
    )


def win_event(
    spark: SparkSession,
    sf_dir: str,
    codes: Sequence[str] | None = None,
    time: TimeRange | None = None,
) -> DataFrame:
    """Security events derived from ``events``."""
    return win_event_columns(raw_events(spark, sf_dir, codes, time))


def event_xml(events: DataFrame) -> DataFrame:
    """Security events as event XML text, one document per row."""
    data = [
        F.lit('<Event xmlns="urn:events"><System><EventID>'), F.col("EventCode"),
        F.lit('</EventID></System><EventData><Data Name="TargetUserName">'),
        F.coalesce(F.get("Account_Name", 0), F.lit("")),
        F.lit('</Data><Data Name="CallerComputerName">'),
        F.coalesce(F.get("Caller_Computer_Name", 0), F.lit("")),
        F.lit("</Data></EventData></Event>"),
    ]
    return events.select("_time", F.concat(*data).alias("xml"))


def access_lines(spark: SparkSession, sf_dir: str, time: TimeRange | None = None) -> DataFrame:
    """Combined-format access lines from ``events`` and all of ``pages``.

    The page of an event is its id modulo the page count, a scalar subquery.
    """
    pages = table(spark, sf_dir, "pages")
    total = pages.agg(F.count(F.lit(1))).scalar()
    paths = pages.select(
        "page_id", F.regexp_extract("url", r"^https?://[^/]+(/[^ ]*)", 1).alias("path")
    )
    raw = raw_events(spark, sf_dir, None, time).select(
        "event_id", "ts", "user_id", (F.col("event_id") % total).alias("page_id")
    )
    e = F.col("event_id")
    uri = (
        F.when(e % 10 == 1, F.lit("/"))
        .when(e % 9 == 0, F.lit("/scp/tickets.php"))
        .otherwise(F.col("path"))
    )
    status = (
        F.when(e % 10 == 5, F.lit("301"))
        .when(e % 10 == 6, F.lit("304"))
        .when(e % 10 == 7, F.lit("403"))
        .when(e % 10 == 8, F.lit("404"))
        .when(e % 10 == 9, F.lit("500"))
        .otherwise(F.lit("200"))
    )
    size = F.when(e % 19 == 0, F.lit("-")).otherwise((e % 5000).cast("string"))
    line = F.concat(
        F.lit("10.0.1."), (F.col("user_id") % 50).cast("string"), F.lit(" - - ["),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), uri, F.lit(' HTTP/1.1" '),
        status, F.lit(" "), size, F.lit(' "-" "ua"'),
    )
    return raw.join(paths, "page_id").select(line.alias("value"))


# --- tickets -------------------------------------------------------------------


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer key to department name, through nation and region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )


def ticket_dims(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Dimension tables of the service desk."""
    region = table(spark, sf_dir, "region")
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    supplier = table(spark, sf_dir, "supplier")
    priority = orders.select("o_orderpriority").distinct()
    created = F.lit("2024-01-01 00:00:00").cast("timestamp")
    address = F.concat(F.lower("c_name"), F.lit("@example.test"))
    number = F.substring("o_orderpriority", 1, 1).cast("int")
    return {
        "department": region.select(
            (F.col("r_regionkey") + 1).alias("id"), F.col("r_name").alias("name"), F.lit(1).alias("sla_id")
        ),
        "sla": priority.select(
            number.alias("id"), F.col("o_orderpriority").alias("name"), (number * 4).alias("grace_period")
        ),
        "help_topic": customer.select("c_mktsegment").distinct().select(
            F.length("c_mktsegment").alias("topic_id"), F.col("c_mktsegment").alias("topic")
        ),
        "staff": supplier.select(
            (F.col("s_suppkey") + 1).cast("int").alias("staff_id"),
            F.col("s_name").alias("username"),
            F.lit("Agent").alias("firstname"),
            F.substring("s_name", 10, 12).alias("lastname"),
            F.concat(F.lower("s_name"), F.lit("@example.test")).alias("email"),
            (F.col("s_suppkey") % 5 + 1).cast("int").alias("dept_id"),
            (F.col("s_suppkey") % 7 == 0).cast("int").alias("isadmin"),
        ),
        "user": customer.select(
            address.alias("id"), address.alias("default_email_id"), F.col("c_name").alias("name"),
            created.alias("created"),
        ),
        "user_email": customer.select(
            address.alias("id"), address.alias("user_id"), F.lit(0).alias("flags"), address.alias("address")
        ),
        "ticket_status": orders.select("o_orderstatus").distinct().select(
            F.when(F.col("o_orderstatus") == "O", F.lit(1)).when(F.col("o_orderstatus") == "P", F.lit(2))
            .otherwise(F.lit(3)).alias("id"),
            F.when(F.col("o_orderstatus") == "O", F.lit("Open")).when(F.col("o_orderstatus") == "P", F.lit("Resolved"))
            .otherwise(F.lit("Closed")).alias("name"),
        ),
    }


def ticket_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticket request per order, with the text of its conversation if any."""
    orders = table(spark, sf_dir, "orders")
    supplier = table(spark, sf_dir, "supplier")
    talk = (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") != "system")
        .groupBy("conv_id")
        .agg(
            F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("body"),
            F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("reply"),
        )
    )
    o = F.col("o_orderkey")
    agents = supplier.agg(F.count(F.lit(1))).scalar()
    agent_key = F.when(o % 13 != 0, o % agents)
    return (
        orders.withColumn("agent_key", agent_key)
        .join(regions(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier.select("s_suppkey", "s_name"), F.col("agent_key") == F.col("s_suppkey"), "left")
        .join(talk, o == F.col("conv_id"), "left")
        .select(
            o.cast("string").alias("number"),
            F.concat(F.lit("Order "), o.cast("string"), F.lit(" needs attention from the service desk team")).alias("subject"),
            F.concat(F.lower("c_name"), F.lit("@example.test")).alias("user_email"),
            F.col("r_name").alias("dept_name"),
            F.col("c_mktsegment").alias("topic_name"),
            F.col("o_orderpriority").alias("sla_name"),
            F.substring("o_orderpriority", 1, 1).cast("tinyint").alias("priority"),
            F.when(F.col("o_orderstatus") == "F", F.lit("closed")).when(F.col("o_orderstatus") == "P", F.lit("resolved"))
            .otherwise(F.lit("open")).alias("status"),
            _pick(o % 6, ["web", "email", "phone", "api", "FAX", None]).alias("source"),
            F.col("o_orderdate").cast("timestamp").alias("created"),
            F.col("s_name").alias("agent_user"),
            F.coalesce("body", F.lit("no message")).alias("body"),
            "reply",
        )
    )


def known_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets that already exist: those of discounted first lines."""
    return (
        table(spark, sf_dir, "lineitem")
        .filter((F.col("l_linenumber") == 1) & (F.col("l_discount") >= 0.09))
        .select(F.col("l_orderkey").cast("string").alias("number"))
        .distinct()
    )


# --- directory -----------------------------------------------------------------


def _group_slug(c: str) -> Column:
    return F.concat(F.lit("GRP-"), F.regexp_replace(F.trim(F.col(c)), " ", "-"))


def ad_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (account, group) pairs: one group per order priority and nation."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    sam = F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("sam")
    by_order = orders.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("sam"),
        _group_slug("o_orderpriority").alias("group"),
    ).distinct()
    by_nation = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        sam, _group_slug("n_name").alias("group")
    )
    everyone = customer.select(sam, F.lit(vocab.DEFAULT_GROUP).alias("group"))
    return by_order.unionByName(by_nation).unionByName(everyone)


def ad_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the directory, including region groups nobody belongs to."""
    names = (
        table(spark, sf_dir, "orders").select(_group_slug("o_orderpriority").alias("name"))
        .unionByName(table(spark, sf_dir, "nation").select(_group_slug("n_name").alias("name")))
        .unionByName(table(spark, sf_dir, "region").select(_group_slug("r_name").alias("name")))
        .distinct()
    )
    return names.select("name", F.lit("OU=CorpUsers,DC=example,DC=test").alias("path"), F.col("name").alias("desc"))


def ad_users(spark: SparkSession, sf_dir: str, with_groups: bool = False) -> DataFrame:
    """Directory users from customers; last logon is the newest order."""
    customer = table(spark, sf_dir, "customer")
    seen = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    k = F.col("c_custkey")
    users = customer.join(seen, k == F.col("o_custkey"), "left").select(
        F.concat(F.lit("c"), k.cast("string")).alias("sam"),
        F.lit("Customer").alias("first"),
        F.substring("c_name", 10, 20).alias("last"),
        F.col("c_name").alias("name"),
        F.when(k % 19 != 0, F.col("c_mktsegment")).alias("dept"),
        F.concat(F.lit("OU="), F.col("c_mktsegment"), F.lit(",OU=CorpUsers,DC=example,DC=test")).alias("ou"),
        F.when(k % 23 != 0, F.concat(F.lit("Tier "), F.col("c_nationkey").cast("string"))).alias("title"),
        F.when(k % 5 != 0, F.concat(F.lit("555-"), k.cast("string"))).alias("phone"),
        F.when(k % 29 != 0, F.concat(F.lower("c_name"), F.lit("@example.test"))).alias("mail"),
        F.when(k >= 10, F.concat(F.lit("c"), F.floor(k / 10).cast("bigint").cast("string"))).alias("manager"),
        (k % 7 != 0).alias("enabled"),
        (k % 11 == 0).alias("locked_out"),
        (k % 13 == 0).alias("password_expired"),
        F.when(k % 17 != 0, F.col("last_order").cast("timestamp")).alias("password_last_set"),
        F.col("last_order").cast("timestamp").alias("last_logon"),
    )
    if not with_groups:
        return users
    # A user's groups are bounded by the group catalogue, not by the rows.
    lists = ad_memberships(spark, sf_dir).groupBy("sam").agg(F.sort_array(F.collect_set("group")).alias("groups"))
    return users.join(lists, "sam", "left")


def ad_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisational units: one per market segment, with the number of its customers as description."""
    held = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return held.select(
        F.col("c_mktsegment").alias("name"), F.lit("OU=CorpUsers,DC=example,DC=test").alias("path"),
        F.concat(F.col("n").cast("string"), F.lit(" people")).alias("desc"),
    )


def ad_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies: one per nation, linked to its region's unit."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("GPO-"), "n_name").alias("name"), F.concat(F.lit("OU="), "r_name").alias("linked_to"),
        F.when(F.col("n_nationkey") % 2 == 0, F.lit("Computer")).otherwise(F.lit("User")).alias("scope"),
    )


def group_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-change requests from orders: some name no group, some only a part of one."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = F.col("o_orderkey")
    wanted = (
        F.when(o % 10 == 7, F.col("n_name"))
        .when(o % 10 == 8, F.lit("urgent"))
        .when(o % 10 == 9, F.lit("no such group"))
        .when(o % 2 == 0, _group_slug("o_orderpriority"))
        .otherwise(_group_slug("n_name"))
    )
    wanted = F.when(o % 3 == 0, F.lower(wanted)).otherwise(wanted)  # people type names in any case
    shifted = F.col("o_custkey") + o % 3
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .select(
            o.alias("request_id"),
            F.concat(F.when(o % 5 == 0, F.lit("C")).otherwise(F.lit("c")), shifted.cast("string")).alias("sam"),
            wanted.alias("group"),
            F.when(o % 4 == 3, F.lit("Remove")).otherwise(F.lit("Add")).alias("action"),
        )
    )


# --- helpdesk text and endpoint tables --------------------------------------------


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Helpdesk audit lines, one per event."""
    raw = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    e = F.col("event_id")
    user = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    level = (
        F.when(e % 5 < 2, F.lit("ACTION")).when(e % 5 == 2, F.lit("OK"))
        .when(e % 5 == 3, F.lit("WARN")).when(e % 15 == 4, F.lit("ERROR")).otherwise(F.lit("INFO"))
    )
    action = (
        F.when(e % 4 == 0, F.concat(F.lit("ACTION: Password reset | User="), user, F.lit(" | Dept=HR | ForceChange=True")))
        .when(e % 4 == 1, F.concat(F.lit("ACTION: Account unlocked | User="), user, F.lit(" | Dept=IT")))
        .when(e % 4 == 2, F.concat(F.lit("ACTION: Group add | User="), user, F.lit(" | Group=GRP-VPN-Users | Dept=IT")))
        .otherwise(F.concat(F.lit("ACTION: Offboarding complete | User="), user, F.lit(" | Reason=Resigned | GroupsRemoved=3")))
    )
    message = F.when(e % 5 < 2, action).otherwise(F.concat(F.lit("Looking up user: "), user))
    ticket = F.when(e % 3 != 0, F.concat(F.lit(" [TKT:"), (e % 100).cast("string"), F.lit("]"))).otherwise(F.lit(""))
    return raw.select(
        F.concat(
            F.lit("["), F.date_format("ts", vocab.SECOND), F.lit("]["), level, F.lit("]"), ticket,
            F.lit(" [agent"), (F.col("user_id") % 5).cast("string"), F.lit("] "), message,
        ).alias("value"),
        e.alias("line_no"),
    )


def app_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application-log rows, one per event."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("time_generated"),
        _pick(e % 5, ["Microsoft Office 16", "EXCEL", "Outlook", "WINWORD", ".NET Runtime"]).alias("source"),
        F.when(e % 3 == 0, F.lit(vocab.APP_CRASH)).otherwise(F.lit("1001")).alias("event_id"),
        F.when(F.col("event_type") == "error", F.lit("Error")).otherwise(F.lit("Information")).alias("entry_type"),
        F.concat(F.lit("message "), e.cast("string")).alias("message"),
    )


def hotfixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed updates, one per event."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("KB"), e.cast("string")).alias("id"),
        F.when(e % 2 == 0, F.lit("Update")).otherwise(F.lit("Security Update")).alias("description"),
        F.col("ts").cast("timestamp").alias("installed_on"),
    )


def crash_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing with lengths taken from whole document texts."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/dumps/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
                 F.when(F.col("doc_id") % 2 == 0, F.lit(".dmp")).otherwise(F.lit(".log"))).alias("path"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("last_write"),
    )


def admin_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of administrator accounts: every account seen on a policy change."""
    rows = win_event(spark, sf_dir, vocab.POLICY_CODES)
    names = rows.filter(F.col("EventCode") == vocab.AUDIT_POLICY_CHANGED).select(
        F.get("Subject_Account_Name", 0).alias("username")
    )
    return first_per_key(
        names.select("username", F.lit("true").alias("is_admin")), ["username"]
    )
