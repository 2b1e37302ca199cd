"""Service-desk tables as set-based plans over natural keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.scalars import first_per_key, left_lookup, ticket_source
from nightdesk.functions.timerange import as_datetime, ts_lit
from nightdesk.sources.sinks import keep_unless


def load_dimension(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Existing rows plus those new ones whose natural key is absent."""
    fresh = first_per_key(new, [key], order).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(*new.columns), allowMissingColumns=True)


def resolve(
    df: DataFrame, dim: DataFrame, on: str, name: str, value: str, alias: str, default: int | str | None = 0
) -> DataFrame:
    """Look ``df[on]`` up in ``dim[name]`` and add ``dim[value]`` as ``alias``.

    The dimension is reduced to one row per name first, so the join can never
    multiply rows.
    """
    one = dim.groupBy(F.col(name).alias("_name")).agg(F.min(value).alias("_value"))
    joined = left_lookup(df, on, one, "_name")
    found = F.col("_value") if default is None else F.coalesce("_value", F.lit(default))
    return joined.withColumn(alias, found).drop("_value")


def load_topics(existing: DataFrame, new: DataFrame, sla: DataFrame, departments: DataFrame) -> DataFrame:
    """Help topics with SLA, department and parent resolved by name.

    ``new`` has topic_id, topic, notes, sla_name, dept_name and parent_topic.
    """
    fresh = first_per_key(new, ["topic"]).join(existing.select("topic"), "topic", "left_anti")
    parents = existing.select("topic", "topic_id").unionByName(new.select("topic", "topic_id"))
    rows = resolve(fresh, sla, "sla_name", "name", "id", "sla_id", None)
    rows = resolve(rows, departments, "dept_name", "name", "id", "dept_id", None)
    rows = resolve(rows, parents, "parent_topic", "topic", "topic_id", "topic_pid")
    return existing.unionByName(
        rows.drop("sla_name", "dept_name", "parent_topic"), allowMissingColumns=True
    )


def upsert_users(users: DataFrame, emails: DataFrame, new: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Add requesters whose mail address is unknown; returns (users, emails).

    ``new`` has name and email.  The address is the natural key of both rows,
    so the user's default mail is known without a second pass.
    """
    fresh = (
        first_per_key(new.select("email", "name"), ["email"])
        .join(emails.select(F.col("address").alias("email")), "email", "left_anti")
    )
    stamp = ts_lit(now)
    user_rows = fresh.select(
        F.col("email").alias("id"),
        F.lit(0).alias("org_id"),
        F.col("email").alias("default_email_id"),
        F.lit(0).alias("status"),
        "name",
        stamp.alias("created"),
        stamp.alias("updated"),
    )
    email_rows = fresh.select(
        F.col("email").alias("id"),
        F.col("email").alias("user_id"),
        F.lit(0).alias("flags"),
        F.col("email").alias("address"),
    )
    return (
        users.unionByName(user_rows, allowMissingColumns=True),
        emails.unionByName(email_rows, allowMissingColumns=True),
    )


def _is_done(status: Column) -> Column:
    return F.lower(status).isin("resolved", "closed")


def build_tickets(
    requests: DataFrame,
    dims: Mapping[str, DataFrame],
    existing: DataFrame | None = None,
    due: str = "fixed",
) -> DataFrame:
    """Tickets from requests, with every name resolved to its id.

    Keeps the request's subject, body and reply for :func:`build_threads` and
    :func:`build_entries`.  A number that exists already is skipped and a number
    that repeats is built once.  Names that do not resolve give 0; an unknown
    status gives 1.  The due date is 8 hours after creation whatever the SLA;
    ``due="sla"`` uses the SLA's grace period.
    """
    rows = first_per_key(requests, ["number"], ["created"])
    if existing is not None:
        rows = rows.join(existing.select("number"), "number", "left_anti")
    mails = dims["user_email"].groupBy(F.col("address").alias("_address")).agg(
        F.min(F.struct("id", "user_id")).alias("_mail")
    )
    rows = left_lookup(rows, "user_email", mails, "_address").withColumns(
        {
            "user_id": F.coalesce(F.col("_mail.user_id"), F.lit("0")),
            "user_email_id": F.coalesce(F.col("_mail.id"), F.lit("0")),
        }
    ).drop("_mail")
    rows = resolve(rows, dims["department"], "dept_name", "name", "id", "dept_id")
    rows = resolve(rows, dims["help_topic"], "topic_name", "topic", "topic_id", "topic_id")
    rows = resolve(rows, dims["sla"], "sla_name", "name", "id", "sla_id")
    rows = resolve(rows, dims["staff"], "agent_user", "username", "staff_id", "staff_id")
    status = dims["ticket_status"].select(F.lower("name").alias("name"), "id")
    rows = resolve(
        rows.withColumn("_status", F.lower("status")), status, "_status", "name", "id", "status_id", 1
    ).withColumn("status_id", F.when(F.col("status_id") == 0, 1).otherwise(F.col("status_id")))
    hours = F.lit(8)
    if due == "sla":
        rows = resolve(rows, dims["sla"], "sla_name", "name", "grace_period", "grace_period", 8)
        hours = F.col("grace_period")
    created = F.col("created")
    return rows.select(
        F.col("number").alias("ticket_id"),
        "number",
        "user_id",
        "user_email_id",
        "status_id",
        "dept_id",
        "sla_id",
        "topic_id",
        "staff_id",
        F.lit(0).alias("team_id"),
        ticket_source("source").alias("source"),
        F.lit(vocab.TICKET_IP).alias("ip_address"),
        F.lit(0).alias("flags"),
        F.lit(0).alias("isoverdue"),
        "created",
        created.alias("updated"),
        created.alias("lastupdate"),
        (created + F.make_dt_interval(hours=hours)).alias("duedate"),
        F.when(_is_done(F.col("status")), created + F.expr("INTERVAL 2 HOURS")).alias("closed"),
        "priority",
        "subject",
        "body",
        "reply",
    )


TICKET_COLUMNS = [
    "ticket_id", "number", "user_id", "user_email_id", "status_id", "dept_id", "sla_id", "topic_id",
    "staff_id", "team_id", "source", "ip_address", "flags", "isoverdue", "created", "updated",
    "lastupdate", "duedate", "closed",
]


def reply_time(created: Column) -> Column:
    return created + F.expr("INTERVAL 45 MINUTES")


def build_threads(tickets: DataFrame) -> DataFrame:
    """One thread per ticket; the last response is set whenever a reply text exists."""
    created = F.col("created")
    return tickets.select(
        F.col("ticket_id").alias("thread_id"),
        F.col("ticket_id").alias("object_id"),
        F.lit("T").alias("object_type"),
        F.lit("{}").alias("extra"),
        created.alias("lastmessage"),
        F.when(F.col("reply").isNotNull(), reply_time(created)).alias("lastresponse"),
        "created",
    )


def build_cdata(tickets: DataFrame) -> DataFrame:
    return tickets.select("ticket_id", "subject")


def build_entries(tickets: DataFrame, users: DataFrame, staff: DataFrame) -> DataFrame:
    """The user's message and, with a reply and a known agent, the agent's answer.

    Each ticket is read once and unfolded into its one or two entries.
    """
    created = F.col("created")
    posters = users.groupBy(F.col("id").alias("_id")).agg(F.min("name").alias("_poster"))
    agents = staff.groupBy(F.col("staff_id").alias("_id")).agg(
        F.min(F.concat("firstname", F.lit(" "), "lastname")).alias("_agent")
    )
    named = left_lookup(left_lookup(tickets, "user_id", posters, "_id"), "staff_id", agents, "_id")

    def entry(kind, staff_id, user_id, source, title, body, at, poster) -> Column:
        return F.struct(
            staff_id.cast("int").alias("staff_id"), user_id.alias("user_id"), F.lit(kind).alias("type"),
            F.lit(0).alias("flags"), source.alias("source"), F.lit("html").alias("format"), title.alias("title"),
            body.alias("body"), at.alias("created"), at.alias("updated"), poster.alias("poster"),
        )

    message = entry(
        "M", F.lit(0), F.col("user_id"), F.col("source"), F.col("subject"), F.col("body"), created, F.col("_poster")
    )
    answer = entry(
        "R", F.col("staff_id"), F.lit("0"), F.lit("Web"), F.concat(F.lit("Re: "), F.col("subject")), F.col("reply"),
        reply_time(created), F.col("_agent"),
    )
    answered = F.col("reply").isNotNull() & (F.col("staff_id") > 0)
    entries = F.array_compact(F.array(message, F.when(answered, answer)))
    return named.select(F.col("ticket_id").alias("thread_id"), F.inline(entries))


def ticket_report(
    tickets: DataFrame, cdata: DataFrame | None, dims: Mapping[str, DataFrame], short: bool = False
) -> DataFrame:
    """Ticket list with requester, agent, department and status, by number.

    ``cdata`` holds the subjects of stored tickets; pass None for tickets that
    still carry theirs, which saves the join.  Dimensions are reduced to one row per key, so no
    ticket is listed twice.  ``short`` cuts the subject to 45 characters and leaves out department and date.
    """
    users = dims["user"].groupBy(F.col("id").alias("user_id")).agg(F.min("name").alias("requester"))
    depts = dims["department"].groupBy(F.col("id").alias("dept_id")).agg(F.min("name").alias("department"))
    status = dims["ticket_status"].groupBy(F.col("id").alias("status_id")).agg(F.min("name").alias("status"))
    staff = dims["staff"].groupBy("staff_id").agg(F.min(F.concat("firstname", F.lit(" "), "lastname")).alias("agent"))
    columns = ["number", "user_id", "dept_id", "status_id", "staff_id", "created"]
    if cdata is None:
        titled = tickets.select(*columns, "subject")
    else:
        subjects = cdata.groupBy("ticket_id").agg(F.min("subject").alias("subject"))
        titled = tickets.select("ticket_id", *columns).join(subjects, "ticket_id")
    rows = (
        titled.join(users, "user_id")
        .join(status, "status_id")
        .join(staff, "staff_id", "left")
    )
    if short:
        return rows.select(
            "number", F.substring("subject", 1, 45).alias("subject"), "requester", "agent", "status"
        ).orderBy("number")
    return (
        rows.join(depts, "dept_id")
        .select("number", "subject", "requester", "agent", "department", "status", "created")
        .orderBy("number")
    )


def people_listing(staff: DataFrame, users: DataFrame, emails: DataFrame) -> DataFrame:
    """Agents and requesters in one list."""
    mail = emails.groupBy(F.col("user_id").alias("_id")).agg(F.min("address").alias("email"))
    agents = staff.select(
        F.lit("Agent").alias("type"),
        F.concat("firstname", F.lit(" "), "lastname").alias("name"),
        "email",
        F.when(F.col("isadmin") == 1, F.lit("Admin")).otherwise(F.lit("Agent")).alias("role"),
    )
    requesters = left_lookup(users, "id", mail, "_id").select(
        F.lit("End User").alias("type"), "name", "email", F.lit("Requester").alias("role")
    )
    return agents.unionByName(requesters).orderBy("type", "name", "email")


def config_listing(sla: DataFrame, departments: DataFrame, topics: DataFrame) -> DataFrame:
    """SLA plans, departments and help topics in one list."""
    return (
        sla.select(F.lit("SLA").alias("section"), F.col("name").alias("item"))
        .unionByName(departments.select(F.lit("Department").alias("section"), F.col("name").alias("item")))
        .unionByName(topics.select(F.lit("Help Topic").alias("section"), F.col("topic").alias("item")))
        .orderBy("section", "item")
    )


QUEUES = ("My Open", "Unassigned", "High Priority", "Closing Today")


def queue(
    tickets: DataFrame, statuses: DataFrame, name: str, me: int | None = None, now=None, high: int = 2
) -> DataFrame:
    """Open tickets of one agent queue.

    ``tickets`` must carry the request's ``priority`` for the high-priority
    queue (1 and 2 are critical and high): the ticket table itself has none.
    """
    open_ids = statuses.filter(F.lower("name") == "open").select(F.col("id").alias("status_id"))
    rows = tickets.join(open_ids.distinct(), "status_id", "left_semi")
    if name == "My Open":
        return rows.filter(F.col("staff_id") == me)
    if name == "Unassigned":
        return rows.filter(F.coalesce("staff_id", F.lit(0)) == 0)
    if name == "High Priority":
        return rows.filter(F.col("priority") <= high)
    if name == "Closing Today":
        return rows.filter(F.to_date("duedate") == F.lit(as_datetime(now).date()))
    raise ValueError(f"unknown queue {name!r}")


def visible_tickets(
    tickets: DataFrame, staff: DataFrame, me: str, network_dept: int | None = None
) -> DataFrame:
    """Tickets one agent may see after logging in as ``me``.

    Admins see everything, members of the network department see their
    department, all others what is assigned to them.  The agent's facts are
    scalar subqueries, so tickets are read once and only filtered.
    """
    mine = staff.filter(F.col("username") == me)
    admin, home, number = (mine.agg(F.max(c)).scalar() for c in ("isadmin", "dept_id", "staff_id"))
    network = F.coalesce(home == F.lit(network_dept), F.lit(False))
    allowed = F.when(admin == 1, True).when(network, F.col("dept_id") == home).otherwise(F.col("staff_id") == number)
    return tickets.filter(allowed)


def visible_counts(tickets: DataFrame, staff: DataFrame, network_dept: int | None = None) -> DataFrame:
    """Tickets each agent may see, counted without listing the pairs.

    Tickets are counted per department and per assignee; admins take the grand
    total from the same table, so no pair list is ever built.
    """
    per_desk = tickets.groupBy("dept_id").agg(F.count(F.lit(1)).alias("desk_total"))
    per_agent = tickets.groupBy("staff_id").agg(F.count(F.lit(1)).alias("own_total"))
    total = tickets.agg(F.count(F.lit(1))).scalar()
    people = first_per_key(staff.select("staff_id", "username", "dept_id", "isadmin"), ["staff_id"])
    return (
        people.join(per_desk, "dept_id", "left")
        .join(per_agent, "staff_id", "left")
        .select(
            "username",
            F.when(F.col("isadmin") == 1, total)
            .when(F.col("dept_id") == F.lit(network_dept), F.coalesce("desk_total", F.lit(0)))
            .otherwise(F.coalesce("own_total", F.lit(0)))
            .alias("visible"),
        )
    )


def reset_seed(tables: Mapping[str, DataFrame], seeded: Mapping[str, Column]) -> dict[str, DataFrame]:
    """What stays of each table after deleting the seeded rows.

    All entries and ticket threads go, as a reset clears them whole; other
    tables lose the rows their predicate names.
    """
    kept = {name: keep_unless(df, seeded[name]) if name in seeded else df for name, df in tables.items()}
    if "thread_entry" in kept:
        kept["thread_entry"] = tables["thread_entry"].filter(F.lit(False))
    if "thread" in kept:
        kept["thread"] = keep_unless(tables["thread"], F.col("object_type") == "T")
    return kept
