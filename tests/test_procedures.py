"""The stored procedures called for whole tables: the rows of the lateral calls, from one pass over the arguments."""

from datetime import datetime

import pytest
from helpers import rows

from nightdesk.operators import tickets as T
from nightdesk.plans.procedures import register_procedures

NOW = "2024-01-31 00:00:00"
AT = datetime(2024, 1, 2, 3, 4, 5)
NAMES = "number string, subject string, body string, user_email string, dept_name string, topic_name string, sla_name string, priority tinyint, status string, source string, created timestamp, agent_user string, reply string"


@pytest.fixture
def desk(spark):
    made = spark.createDataFrame
    tables = {
        "user_email": made([("a@x", "a@x", "u1"), ("a@x", "b@x", "u2")], "address string, id string, user_id string"),
        "department": made([("IT", 4)], "name string, id int"),
        "help_topic": made([("Mail", 7)], "topic string, topic_id int"),
        "sla": made([("low", 3)], "name string, id int"),
        "staff": made([("ana", 9)], "username string, staff_id int"),
        "ticket_status": made([("Open", 1), ("Closed", 3)], "name string, id int"),
    }
    first = ("1", "s", "b", "a@x", "IT", "Mail", "low", 2, "CLOSED", "web", AT, "ana", "r")
    requests = made(
        [first, first, ("2",) + first[1:], ("3", None, None, None, None, None, None, None, None, None, None, None, None),
         (None,) + first[1:], ("4", "s", "b", "no@x", "HR", "?", "?", 1, "odd", "FAX", AT, "bob", None)], NAMES,
    )
    people = made([("n", "a@x"), ("n", "c@x"), ("n", "c@x"), (None, None)], "name string, mail string")
    register_procedures(spark, tables, NOW, made([("2",)], "number string"), people=people, requests=requests)
    requests.createOrReplaceTempView("asked")
    people.createOrReplaceTempView("met")
    return spark


def test_calls_for_a_table_give_what_single_calls_give(desk):
    arguments = ", ".join(f"r.{c.split()[0]}" for c in NAMES.split(", ")).replace("r.priority", "int(r.priority)")
    single = desk.sql(f"SELECT t.* FROM asked r, LATERAL seed_ticket({arguments}) t")
    many = desk.sql("SELECT * FROM seed_tickets()")
    assert many.dtypes == single.dtypes
    got = sorted(rows(many), key=repr)
    assert got == sorted(rows(single), key=repr) and len(got) == 5
    assert [r[0] for r in got].count("1") == 2 and [r[0] for r in got].count(None) == 1
    users = "SELECT u.* FROM met r, LATERAL upsert_user(r.name, r.mail) u"
    assert sorted(rows(desk.sql("SELECT * FROM upsert_users()")), key=repr) == sorted(rows(desk.sql(users)), key=repr)
    assert [r[0] for r in rows(desk.sql("SELECT * FROM upsert_users()"))].count("c@x") == 2


def test_arguments_are_read_once_and_only_those_asked_for(desk, tmp_path):
    """No join back on all arguments: the table of calls is scanned once, without the texts."""
    desk.table("asked").write.parquet(str(tmp_path / "asked"))
    empty = {n: desk.createDataFrame([], s) for n, s in (
        ("user_email", "address string, id string, user_id string"), ("department", "name string, id int"), ("help_topic", "topic string, topic_id int"),
        ("sla", "name string, id int"), ("staff", "username string, staff_id int"), ("ticket_status", "name string, id int"))}
    register_procedures(desk, empty, NOW, requests=desk.read.schema(NAMES).parquet(str(tmp_path / "asked")))
    plan = desk.sql(f"SELECT {', '.join(T.TICKET_COLUMNS)} FROM seed_tickets()")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    read = plan.split("ReadSchema:")[1].split("\n")[0]
    assert "number" in read and "subject" not in read and "body" not in read and "reply" not in read
