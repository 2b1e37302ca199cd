"""Event store, text logs, tables and sinks."""

import pytest
from helpers import events, failure, lockout, rows
from pyspark.sql import functions as F

from nightdesk import schemas, vocab
from nightdesk.functions.timerange import TimeRange
from nightdesk.session import shared_folder
from nightdesk.sources import events as store
from nightdesk.sources import logs, sinks, tables

NOW = "2024-03-05 12:00:00"
LINE = '10.0.0.1 - - [05/Mar/2024:11:00:00 +0000] "GET / HTTP/1.1" 200 5 "-" "ua"'


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_event_store_round_trip_and_pruning(spark, tmp_path):
    path = str(tmp_path / "store")
    data = [lockout("10:00:00"), lockout("2024-03-01 10:00:00"), failure("10:00:00"),
            failure("10:00:00", sourcetype=vocab.SYSTEM_SOURCETYPE), failure("10:00:00", index="other"),
            failure("10:00:00", sourcetype=vocab.APPLICATION_SOURCETYPE)]
    store.write_events(events(spark, data), path)
    day = TimeRange.last(NOW, hours=24)
    df = store.security_events(spark, path, time=day)
    assert df.count() == 2
    text = plan(df.filter(F.col("EventCode") == "4740").select("host"))
    assert "PartitionFilters" in text and "event_date" in text.split("PartitionFilters")[1][:400]
    assert "EqualTo(EventCode,4740)" in text
    assert store.system_events(spark, path).count() == 1 and store.application_events(spark, path).count() == 1
    every = store.security_events(spark, path, sourcetype=None)
    assert [tuple(r)[:2] for r in store.catalog_summary(every).collect()] == [
        ("WinEventLog:Application", 1), ("WinEventLog:Security", 3), ("WinEventLog:System", 1)]
    assert store.probe(every, "dc01", 2).count() == 2


def test_text_sources(spark, tmp_path):
    for name, text in {"access": LINE + "\nbad\n", "error": "2024 [error] x\n", "sys": "<13>x\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.log").write_text(text)
    access = logs.read_access_log(spark, str(tmp_path / "access"))
    assert sorted((r["client_ip"] or "", r["sourcetype"]) for r in access.collect()) == [
        ("", "nginx_access"), ("10.0.0.1", "nginx_access")]
    error = logs.read_error_log(spark, str(tmp_path / "error")).first()
    assert (error["_raw"], error["sourcetype"], error["source"].endswith("a.log")) == ("2024 [error] x", "nginx_error", True)
    assert logs.read_syslog(spark, str(tmp_path / "sys")).first()["host"] is None
    stream = logs.stream_lines(spark, str(tmp_path / "access"), vocab.ACCESS_SOURCETYPE)
    query = stream.select("client_ip").writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("tail").count() == 2


def test_registry(spark):
    logs.register("upper", lambda df: df.select(F.upper("value").alias("v")))
    df = spark.createDataFrame([("a",)], "value string")
    assert rows(logs.apply_sourcetype(df, "upper")) == [("A",)]
    assert logs.apply_sourcetype(df, "unknown").columns == ["_raw"]


def test_monthly_audit_files(spark, tmp_path):
    line = "[2024-0{}-05 10:00:00][OK] [ana] x\n"
    (tmp_path / "helpdesk-2024-03.log").write_text(line.format(3))
    (tmp_path / "helpdesk-2024-04.log").write_text(line.format(4))
    (tmp_path / "other.log").write_text("no\n")
    assert logs.read_helpdesk_log(spark, str(tmp_path)).filter("ts is not null").count() == 2


def test_audit_append_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(NOW, "OK", "ana", "m", "7"), (NOW, "WARN", "ana", "m", None)],
                               "t string, level string, agent string, message string, ticket string")
    value = sinks.audit_line(F.col("t").cast("timestamp"), F.col("level"), F.col("agent"), F.col("message"), F.col("ticket"))
    path = str(tmp_path / "log")
    for _ in range(2):
        sinks.append_audit(df.select(value.alias("value")), path)
    got = logs.read_lines(spark, path, logs.AUDIT_SOURCETYPE)
    assert got.count() == 4 and {r["ticket"] for r in got.collect()} == {"7", None}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("bob", "2024-03-05", "a\nb")], "username string, report_date string, report string")
    sinks.write_reports(df, str(tmp_path / "r"))
    got = spark.read.text(str(tmp_path / "r"), wholetext=True).first()
    assert got["value"].strip() == "a\nb" and got["username"] == "bob"


def test_ticket_and_directory_tables(spark, tmp_path):
    made = {n: spark.createDataFrame([], s) for n, s in schemas.TICKET_TABLES.items()}
    sinks.write_ticket_tables(made, str(tmp_path / "t"))
    assert set(tables.read_ticket_tables(spark, str(tmp_path / "t"))) == set(schemas.TICKET_TABLES)
    assert not any("passwd" == f.name for df in made.values() for f in df.schema)
    parts = {"ou": schemas.AD_OU, "group": schemas.AD_GROUP, "user": schemas.AD_USER, "gpo": schemas.GPO}
    sinks.write_ticket_tables({n: spark.createDataFrame([], s) for n, s in parts.items()}, str(tmp_path / "d"))
    assert tables.read_directory(spark, str(tmp_path / "d"))["user"].count() == 0


def test_lookup_and_endpoint_files(spark, tmp_path):
    (tmp_path / "admins.csv").write_text("username,is_admin\njsmith,true\nmchen,true\n")
    assert rows(tables.read_admin_accounts(spark, str(tmp_path / "admins.csv"))) == [("jsmith", "true"), ("mchen", "true")]
    (tmp_path / "app.json").write_text('{"time_generated":"2024-03-05T10:00:00","source":"EXCEL","event_id":"1000"}\n')
    assert tables.read_app_events(spark, str(tmp_path / "app.json")).first()["source"] == "EXCEL"
    (tmp_path / "fix.json").write_text('{"id":"KB1","installed_on":"2024-03-05T10:00:00"}\n')
    assert tables.read_hotfixes(spark, str(tmp_path / "fix.json")).first()["id"] == "KB1"
    (tmp_path / "dumps" / "u").mkdir(parents=True)
    (tmp_path / "dumps" / "u" / "x.dmp").write_bytes(b"12345")
    (tmp_path / "dumps" / "u" / "x.txt").write_bytes(b"1")
    got = tables.list_files(spark, str(tmp_path / "dumps"), "*.dmp").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["length"]) for r in got] == [("x.dmp", 5)]


def test_guards(spark):
    with pytest.raises(RuntimeError):
        tables.require_table(spark, "no_such_table")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            shared_folder(spark, "x")
        assert shared_folder(spark, "x", "/tmp/y") == "/tmp/y/x"
