"""Service-desk load and directory operators on a small company's data."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from nightdesk import schemas
from nightdesk.operators import directory as D
from nightdesk.operators import tickets as T
from nightdesk.sources.sinks import keep_unless

NOW = "2024-03-05 12:00:00"

# Number, department, status, agent of the fifteen seeded tickets.
TICKETS = [
    ("100001", "IT Helpdesk", "closed", "alopez"),
    ("100002", "IT Helpdesk", "closed", "tnguyen"),
    ("100003", "IT Helpdesk", "open", "jsmith"),
    ("100004", "IT Helpdesk", "closed", "tnguyen"),
    ("100005", "IT Helpdesk", "open", "alopez"),
    ("100006", "IT Helpdesk", "resolved", "jsmith"),
    ("100007", "IT Helpdesk", "closed", "alopez"),
    ("100008", "IT Helpdesk", "open", "tnguyen"),
    ("100009", "IT Helpdesk", "closed", "alopez"),
    ("100010", "Network Operations", "open", "mchen"),
    ("100011", "Network Operations", "closed", "mchen"),
    ("100012", "Network Operations", "open", "mchen"),
    ("100013", "IT Helpdesk", "resolved", "jsmith"),
    ("100014", "IT Helpdesk", "open", "jsmith"),
    ("100015", "IT Helpdesk", "closed", "tnguyen"),
]
SLAS = [("Critical - 1 Hour", 1), ("High - 4 Hours", 4), ("Normal - 8 Hours", 8), ("Low - 24 Hours", 24)]
TOPICS = [
    ("Account Issues", "Normal - 8 Hours", "IT Helpdesk", None),
    ("Hardware", "Normal - 8 Hours", "IT Helpdesk", None),
    ("Software", "Normal - 8 Hours", "IT Helpdesk", None),
    ("Network", "High - 4 Hours", "Network Operations", None),
    ("Password Reset", "High - 4 Hours", "IT Helpdesk", "Account Issues"),
    ("Account Lockout", "High - 4 Hours", "IT Helpdesk", "Account Issues"),
    ("New User Setup", "Normal - 8 Hours", "IT Helpdesk", "Account Issues"),
    ("Access Request", "Normal - 8 Hours", "IT Helpdesk", "Account Issues"),
]
STAFF = [(1, "jsmith", "James", "Smith", 1, 1), (2, "alopez", "Ana", "Lopez", 1, 0),
         (3, "tnguyen", "Tommy", "Nguyen", 1, 0), (4, "mchen", "Michael", "Chen", 2, 0)]
# Account, manager and groups of the ten directory users.
USERS = [
    ("jsmith", None, ["GRP-IT-Admins", "GRP-VPN-Users", "GRP-SharedDrive-RW"]),
    ("alopez", "jsmith", ["GRP-IT-HelpDesk", "GRP-VPN-Users", "GRP-SharedDrive-RW"]),
    ("mchen", "jsmith", ["GRP-IT-Admins", "GRP-VPN-Users", "GRP-SharedDrive-RW"]),
    ("swilliams", None, ["GRP-HR-Staff", "GRP-VPN-Users", "GRP-SharedDrive-RW"]),
    ("djohnson", "swilliams", ["GRP-HR-Staff", "GRP-SharedDrive-RO"]),
    ("rpatel", None, ["GRP-Finance-Staff", "GRP-VPN-Users", "GRP-SharedDrive-RW"]),
    ("kthompson", "rpatel", ["GRP-Finance-Staff", "GRP-SharedDrive-RW"]),
    ("bwashington", "rpatel", ["GRP-Finance-Staff", "GRP-SharedDrive-RO"]),
    ("lmartinez", "swilliams", ["GRP-HR-Staff", "GRP-SharedDrive-RO"]),
    ("tnguyen", "jsmith", ["GRP-IT-HelpDesk", "GRP-SharedDrive-RW"]),
]
GROUP_SIZES = {
    "GRP-IT-Admins": 2, "GRP-IT-HelpDesk": 2, "GRP-HR-Staff": 3, "GRP-Finance-Staff": 3, "GRP-VPN-Users": 5,
    "GRP-SharedDrive-RW": 7, "GRP-SharedDrive-RO": 3,
}


@pytest.fixture(scope="module")
def dims(spark):
    sla = spark.createDataFrame([(i + 1, n, g) for i, (n, g) in enumerate(SLAS)], "id int, name string, grace_period int")
    dept = spark.createDataFrame([(1, "IT Helpdesk"), (2, "Network Operations")], "id int, name string")
    topics = spark.createDataFrame(
        [(t, i + 1, s, d, p) for i, (t, s, d, p) in enumerate(TOPICS)],
        "topic string, topic_id int, sla_name string, dept_name string, parent_topic string",
    )
    empty = spark.createDataFrame([], "topic string, topic_id int")
    users = spark.createDataFrame([], "id string, default_email_id string, name string")
    emails = spark.createDataFrame([], "id string, user_id string, flags int, address string")
    new = spark.createDataFrame([(f"User {i}", f"u{i}@example.test") for i in range(6)], "name string, email string")
    users, emails = T.upsert_users(users, emails, new, NOW)
    return {
        "sla": sla, "department": dept, "help_topic": T.load_topics(empty, topics, sla, dept),
        "staff": spark.createDataFrame(
            STAFF, "staff_id int, username string, firstname string, lastname string, dept_id int, isadmin int"
        ).withColumn("email", F.concat("username", F.lit("@example.test"))),
        "user": users, "user_email": emails,
        "ticket_status": spark.createDataFrame([(1, "Open"), (2, "Resolved"), (3, "Closed")], "id int, name string"),
    }


def request(number, dept="IT Helpdesk", status="open", agent="jsmith", **more):
    base = {"number": number, "subject": f"Subject {number} " + "x" * 60, "user_email": "u1@example.test",
            "dept_name": dept, "topic_name": "Network", "sla_name": "High - 4 Hours", "priority": 2, "status": status,
            "source": "web", "created": "2024-03-05 08:00:00", "agent_user": agent, "body": "b", "reply": None}
    return {**base, **more}


def requests(spark, items):
    names = [p.split()[0] for p in schemas.TICKET_REQUEST.replace("\n", " ").split(",")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in items],
                               schemas.TICKET_REQUEST.replace("created timestamp", "created string"))
    return df.withColumn("created", F.col("created").cast("timestamp"))


@pytest.fixture(scope="module")
def seeded(spark, dims):
    items = [request(n, d, s, a, reply="done" if s != "open" else None) for n, d, s, a in TICKETS]
    return T.build_tickets(requests(spark, items), dims).cache()


def test_seeded_tickets(seeded, dims):
    report = T.ticket_report(seeded, T.build_cdata(seeded), dims).collect()
    assert [r["number"] for r in report] == [t[0] for t in TICKETS]
    status = [r["status"] for r in report]
    assert (status.count("Closed"), status.count("Resolved"), status.count("Open")) == (7, 2, 6)
    assert sum(r["department"] == "IT Helpdesk" for r in report) == 12
    assert report[0]["agent"] == "Ana Lopez"
    assert rows(T.ticket_report(seeded, None, dims)) == [tuple(r) for r in report]
    short = T.ticket_report(seeded, T.build_cdata(seeded), dims, short=True)
    assert {len(r["subject"]) for r in short.collect()} == {45}


def test_dimension_load_is_idempotent(spark, dims):
    new = spark.createDataFrame([("Normal - 8 Hours", 99), ("Extra", 5), ("Extra", 4)], "name string, grace_period int")
    once = T.load_dimension(dims["sla"].select("name", "grace_period"), new, "name")
    assert sorted(rows(T.load_dimension(once, new, "name"))) == sorted(rows(once))
    assert dict(rows(once)) == {**dict(SLAS), "Extra": 4}
    topics = {r["topic"]: r for r in dims["help_topic"].collect()}
    assert topics["Password Reset"]["topic_pid"] == topics["Account Issues"]["topic_id"]
    assert topics["Network"]["topic_pid"] == 0 and topics["Network"]["dept_id"] == 2


def test_user_upsert_twice_is_once(spark, dims):
    new = spark.createDataFrame([("User 1", "u1@example.test"), ("N", "n@example.test")], "name string, email string")
    users, emails = T.upsert_users(dims["user"], dims["user_email"], new, NOW)
    again, _ = T.upsert_users(users, emails, new, NOW)
    assert users.count() == again.count() == 7
    assert users.filter("name = 'N'").first()["default_email_id"] == "n@example.test"


def test_ticket_edges(spark, dims):
    items = [
        request("1", status="CLOSED", source="FAX", sla_name="Low - 24 Hours"),
        request("2", status="weird", source=None, dept="None such", agent=None, reply="r"),
        request("3", user_email="nobody@example.test"),
        request("4"), request("4", created="2024-03-05 07:00:00", subject="first"),
        request("9"),
    ]
    known = spark.createDataFrame([("9",)], "number string")
    built = T.build_tickets(requests(spark, items), dims, known)
    got = {r["number"]: r for r in built.collect()}
    assert set(got) == {"1", "2", "3", "4"}
    assert (got["1"]["status_id"], got["1"]["source"], str(got["1"]["closed"])) == (3, "Other", "2024-03-05 10:00:00")
    assert str(got["1"]["duedate"]) == "2024-03-05 16:00:00"
    assert (got["2"]["status_id"], got["2"]["dept_id"], got["2"]["staff_id"], got["2"]["closed"]) == (1, 0, 0, None)
    assert got["3"]["user_id"] == "0" and got["4"]["subject"] == "first"
    by_sla = {r["number"]: str(r["duedate"]) for r in T.build_tickets(requests(spark, items), dims, known, "sla").collect()}
    assert by_sla["1"] == "2024-03-06 08:00:00"
    # A reply without an agent marks the thread as answered but writes no entry.
    thread = {r["thread_id"]: r for r in T.build_threads(built).collect()}
    assert str(thread["2"]["lastresponse"]) == "2024-03-05 08:45:00" and thread["1"]["lastresponse"] is None
    entries = T.build_entries(built, dims["user"], dims["staff"]).collect()
    assert sorted(e["type"] for e in entries) == ["M"] * 4


def test_entries(seeded, dims):
    entries = T.build_entries(seeded, dims["user"], dims["staff"]).collect()
    replies = [e for e in entries if e["type"] == "R"]
    assert len(entries) == 15 + 9 and len(replies) == 9
    first = next(e for e in replies if e["thread_id"] == "100001")
    assert first["title"].startswith("Re: Subject 100001") and first["poster"] == "Ana Lopez" and first["source"] == "Web"
    assert str(first["created"]) == "2024-03-05 08:45:00"


def test_queues_and_visibility(seeded, dims):
    names = lambda df: {r["number"] for r in df.collect()}
    q = lambda name, **o: names(T.queue(seeded, dims["ticket_status"], name, **o))
    assert q("My Open", me=1) == {"100003", "100014"}
    assert q("Unassigned") == set() and len(q("High Priority")) == 6
    assert len(q("Closing Today", now=NOW)) == 6 and q("Closing Today", now="2024-03-06") == set()
    with pytest.raises(ValueError):
        q("Nope")
    see = lambda who: len(names(T.visible_tickets(seeded, dims["staff"], who, network_dept=2)))
    assert [see(w) for w in ("jsmith", "alopez", "tnguyen", "mchen", "stranger")] == [15, 4, 4, 3, 0]
    assert dict(rows(T.visible_counts(seeded, dims["staff"], 2))) == {"jsmith": 15, "alopez": 4, "tnguyen": 4, "mchen": 3}


def test_listings(dims):
    people = T.people_listing(dims["staff"], dims["user"], dims["user_email"]).collect()
    assert [p["role"] for p in people].count("Admin") == 1 and len(people) == 10
    listing = T.config_listing(dims["sla"], dims["department"], dims["help_topic"]).collect()
    assert [r["section"] for r in listing] == ["Department"] * 2 + ["Help Topic"] * 8 + ["SLA"] * 4


def test_reset(seeded, dims):
    tables = {"ticket": seeded, "thread_entry": T.build_entries(seeded, dims["user"], dims["staff"]),
              "thread": T.build_threads(seeded), "user": dims["user"]}
    kept = T.reset_seed(tables, {"ticket": F.col("number").between("100001", "100014")})
    assert {k: v.count() for k, v in kept.items()} == {"ticket": 1, "thread_entry": 0, "thread": 0, "user": 6}


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert sorted(rows(keep_unless(df, F.col("x") == "a")), key=str) == [("b",), (None,)]


# --- directory ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def users(spark):
    df = spark.createDataFrame(USERS, "sam string, manager string, groups array<string>")
    return df.select(
        "*", F.initcap("sam").alias("name"), F.concat("sam", F.lit("@example.test")).alias("mail"),
        F.lit("IT").alias("dept"), F.lit(None).cast("string").alias("title"),
        (F.col("sam") != "rpatel").alias("enabled"), F.col("sam").isin("rpatel", "alopez").alias("locked_out"),
        (F.col("sam") == "rpatel").alias("password_expired"),
        F.lit(None).cast("timestamp").alias("last_logon"), F.lit(NOW).cast("timestamp").alias("password_last_set"),
    )


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame([(g,) for g in [*GROUP_SIZES, "GRP-Empty"]], "name string")


@pytest.fixture(scope="module")
def pairs(users, groups):
    return D.memberships(users, groups)


def test_memberships(spark, users, groups, pairs):
    assert pairs.count() == 25 and pairs.filter("status <> 'OK'").count() == 0
    assert dict(rows(D.list_groups(groups, pairs))) == {**GROUP_SIZES, "GRP-Empty": 0}
    fewer = groups.filter("name <> 'GRP-VPN-Users'")
    assert D.memberships(users, fewer).filter("status = 'WARN'").count() == 5
    assert D.reporting_lines(users).count() == 7


def test_user_summary(users):
    got = {r["username"]: r for r in D.user_summary(users).collect()}
    assert got["rpatel"]["status"] == "DISABLED, LOCKED, PW-EXPIRED" and got["jsmith"]["status"] == "Active"
    assert got["alopez"]["manager"] == "Jsmith" and got["jsmith"]["manager"] == "N/A"
    assert (got["jsmith"]["title"], got["jsmith"]["last_logon"]) == ("N/A", "Never")
    found = D.find_users(users, "RPAT").collect()
    assert [(r["sam"], r["status"]) for r in found] == [("rpatel", "DISABLED,LOCKED")]


def test_inventory(spark, groups):
    expected = groups.select(F.lit("group").alias("kind"), "name")
    actual = expected.filter("name <> 'GRP-Empty'").withColumn("detail", F.lit("x"))
    checks = D.verify_inventory(expected, actual)
    assert tuple(D.inventory_failures(checks).first()) == (8, 1)


def test_group_changes(spark, users, groups, pairs):
    asked = [
        (1, "jsmith", "GRP-IT-Admins", "Add"), (2, "jsmith", "grp-hr-staff", "Add"), (3, "jsmith", "VPN", "Add"),
        (4, "jsmith", "GRP-Empty", "Remove"), (5, "JSMITH", "GRP-IT-Admins", "Remove"), (6, "ghost", "GRP-Empty", "Add"),
        (7, "alopez", "it", "Add"), (8, "alopez", "zzz", "Add"),
    ]
    requests_ = spark.createDataFrame(asked, "request_id int, sam string, `group` string, action string")
    plan = D.plan_group_changes(requests_, users, groups, pairs)
    got = {r["request_id"]: r for r in plan.collect()}
    assert [got[i]["result"] for i in range(1, 9)] == [
        "Skipped — already a member", "SUCCESS", "FAILED — group not found", "Skipped — not a member", "SUCCESS",
        "FAILED — user not found", "FAILED — group not found", "FAILED — group not found"]
    assert got[2]["group"] == "GRP-HR-Staff" and got[5]["privileged_warning"] and not got[2]["privileged_warning"]
    assert got[3]["suggestions"] == ["GRP-VPN-Users"] and got[7]["suggestions"] == ["GRP-IT-Admins", "GRP-IT-HelpDesk"]
    assert got[8]["suggestions"] is None
    assert got[5]["sam"] == "jsmith"
    decided = plan
    once = D.apply_group_changes(pairs, decided)
    assert once.count() == 25 and ("jsmith", "GRP-HR-Staff") in rows(once) and ("jsmith", "GRP-IT-Admins") not in rows(once)
    assert sorted(rows(D.apply_group_changes(once, decided))) == sorted(rows(once))
    assert {r["request_id"] for r in D.is_member(pairs, requests_).collect()} == {1, 5}


def test_suggestions_equal_pairwise_comparison(spark):
    names = ["alpha", "Alphabet", "beta", "al", "b", "zeta-alpha", "ta"]
    wanted = ["a", "AL", "alp", "eta", "lphab", "b", "nothing", "ta", "zeta-alpha"]
    got = D.suggest_groups(
        spark.createDataFrame([(w,) for w in wanted], "wanted string"),
        spark.createDataFrame([(n,) for n in names], "name string"),
    )
    expected = {w: sorted(n for n in names if w.lower() in n.lower()) for w in wanted}
    assert dict(rows(got)) == {w: n for w, n in expected.items() if n}


def test_offboarding(spark, users, pairs):
    admin = users.filter("sam = 'jsmith'").withColumn("sam", F.lit("Administrator"))
    asked = spark.createDataFrame(
        [("alopez", "Resigned", "mchen", "77"), ("Administrator", "Resigned", "mchen", None)],
        "username string, reason string, agent string, ticket string",
    )
    members = pairs.select("sam", "group").union(spark.createDataFrame([("alopez", "Domain Users")], "a string, b string"))
    got = {r["username"]: r for r in D.offboarding_report(asked, users.unionByName(admin), members, NOW).collect()}
    done = got["alopez"]
    assert done["groups_removed"] == ["GRP-IT-HelpDesk", "GRP-SharedDrive-RW", "GRP-VPN-Users"]
    assert done["description"] == "DEPARTED 2024-03-05 | Reason: Resigned | Offboarded by: mchen | Ticket: 77"
    assert str(done["delete_after"]) == "2024-06-03" and done["display_name"] == "[DEPARTED] Alopez"
    assert "  - GRP-VPN-Users" in done["report"]
    assert got["Administrator"]["decision"] == "REFUSED" and got["Administrator"]["report"] is None


def test_dimensions_with_repeated_keys_do_not_multiply_rows(spark):
    users = spark.createDataFrame(
        [("a", "Ann", "boss", ["GRP-A", "grp-b"]), ("boss", "Big Boss", None, []), ("boss", "Also Boss", None, ["grp-A"])],
        "sam string, name string, manager string, groups array<string>",
    )
    assert rows(D.reporting_lines(users)) == [("a", "boss", "Also Boss")]
    groups = spark.createDataFrame([("GRP-A",), ("GRP-B",), ("grp-b",)], "name string")
    got = sorted(rows(D.memberships(users, groups)))
    assert got == [("a", "GRP-A", "OK"), ("a", "GRP-B", "OK"), ("boss", "GRP-A", "OK")]
    ticket = spark.createDataFrame([("1", "u", 1, 1, 7, "2024-01-01", "s")], "number string, user_id string, dept_id int, status_id int, staff_id int, created string, subject string")
    dims = {
        "user": spark.createDataFrame([("u", "U1"), ("u", "U2")], "id string, name string"),
        "department": spark.createDataFrame([(1, "D"), (1, "E")], "id int, name string"),
        "ticket_status": spark.createDataFrame([(1, "Open"), (1, "Other")], "id int, name string"),
        "staff": spark.createDataFrame([(7, "A", "B"), (7, "C", "D")], "staff_id int, firstname string, lastname string"),
    }
    assert [tuple(r)[0:5] for r in T.ticket_report(ticket, None, dims).collect()] == [("1", "s", "U1", "A B", "D")]


def test_suggestions_of_hot_pieces_and_short_texts(spark, monkeypatch):
    """A piece that a third of all names holds is split; results are those of a comparison of all."""
    monkeypatch.setattr(D, "PIECE_NAMES", 7)
    names = [f"team-{k % 7}-{'vpn' if k % 3 == 0 else 'hr'}-{k}" for k in range(120)] + ["aaaa", "AAaa b"]
    wanted = ["VPN", "hr-1", "m-3-", "a", "9", "aaa", "aaaa b", "no such", "", "-", "team-0-vpn-0"]
    groups = spark.createDataFrame([(n,) for n in names], "name string")
    asked = spark.createDataFrame([(w,) for w in wanted], "wanted string")
    got = {r["wanted"]: r["suggestions"] for r in D.suggest_groups(asked, groups).collect()}
    want = {w: sorted(n for n in names if w.lower() in n.lower()) for w in wanted if w}
    assert got == {w: n for w, n in want.items() if n}
    few = {r["wanted"]: r["suggestions"] for r in D.suggest_groups(asked, groups, limit=3).collect()}
    assert few == {w: n[:3] for w, n in want.items() if n}
