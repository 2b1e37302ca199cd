"""Access lines, audit lines, installer lines, XML, names."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions import parsing as P
from nightdesk.functions import scalars as S
from nightdesk.functions.scalars import with_display_names
from nightdesk.functions.timerange import TimeRange
from nightdesk.operators import helpdesk, web

NOW = "2024-03-05 12:00:00"


def line(uri="/", status=200, size="5", referrer="-", agent="ua", time="05/Mar/2024:11:00:00 +0000", client="10.0.0.1"):
    return f'{client} - bob [{time}] "GET {uri} HTTP/1.1" {status} {size} "{referrer}" "{agent}"'


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_access_fields(spark):
    got = P.parse_access(lines(spark, [line(size="-", referrer="", agent="a b/1") + " tail", "junk", None])).collect()
    first = next(r for r in got if r["client_ip"])
    assert first["user"] == "bob" and first["bytes"] == "-" and first["bytes_sent"] is None
    assert first["referrer"] == "" and first["user_agent"] == "a b/1"
    assert str(first["_time"]) == "2024-03-05 11:00:00"
    rest = [r for r in got if r["client_ip"] is None]
    assert len(rest) == 2 and all(r["status"] is None and r["status_class"] == "Other" for r in rest)


def test_access_zone_and_line_with_separator(spark):
    odd = line(uri="/a\u0001b", time="05/Mar/2024:11:00:00 +0200")
    got = P.parse_access(lines(spark, [odd, "x\u0001" * 9])).collect()
    by_uri = {r["uri"]: r for r in got}
    assert str(by_uri["/a\u0001b"]["_time"]) == "2024-03-05 09:00:00" and None in by_uri


def test_unmatched_line_still_gets_its_time(spark):
    got = P.parse_access(lines(spark, ["- [05/Mar/2024:11:00:00 +0000] broken"])).first()
    assert str(got["_time"]) == "2024-03-05 11:00:00" and got["client_ip"] is None


@pytest.mark.parametrize(
    "status,name",
    [("199", "Other"), ("200", "2xx - Success"), ("299", "2xx - Success"), ("300", "3xx - Redirect"),
     ("399", "3xx - Redirect"), ("400", "4xx - Client Error"), ("499", "4xx - Client Error"),
     ("500", "5xx - Server Error"), ("x", "Other")],
)
def test_status_class(spark, status, name):
    assert spark.range(1).select(S.status_class(F.lit(status))).first()[0] == name


def test_web_panels(spark):
    values = [line("/"), line("/scp/"), line("/scp/x.php", 404), line("/scpx", 500), line("/SCP/y"),
              line("/old", time="04/Mar/2024:11:59:59 +0000"), "junk"]
    parsed = P.parse_access(lines(spark, values))
    assert web.kpi_requests(parsed, NOW).first()[0] == 5
    assert tuple(web.kpi_http_errors(parsed, NOW).first()) == (2, 1)
    assert web.kpi_portal_hits(parsed, NOW).first()[0] == 4
    assert web.kpi_unique_clients(parsed, NOW).first()[0] == 1
    assert [r["uri"] for r in web.recent_errors(parsed, NOW).collect()] == ["/scp/x.php", "/scpx"]
    assert sum(r["count"] for r in web.requests_by_class(parsed, NOW).collect()) == 5
    assert len(web.top_uris(parsed, NOW, k=2).collect()) == 2
    assert rows(web.status_breakdown(parsed, NOW))[0] == ("200", 3)


def test_audit_lines(spark):
    values = [
        "[2024-03-05 10:00:00][ACTION] [TKT:42] [ana] ACTION: Password reset | User=bob | Dept=HR | ForceChange=True",
        "[2024-03-05 10:00:01][ACTION] [ana] ACTION: Drive map | User=bob | Drive=Z: | UNC=\\\\srv\\a=b | User=dup",
        "[2024-03-05 10:00:02][OK] [ana] Verified: account is no longer locked",
        "garbage",
    ]
    got = P.parse_audit(lines(spark, values)).collect()
    assert (got[0]["ticket"], got[0]["agent"], got[0]["action"]) == ("42", "ana", "Password reset")
    assert got[0]["kv"] == {"User": "bob", "Dept": "HR", "ForceChange": "True"}
    assert got[1]["ticket"] is None and got[1]["kv"] == {"User": "bob", "Drive": "Z:", "UNC": "\\\\srv\\a=b"}
    assert got[2]["action"] is None and got[2]["kv"] is None and got[2]["level"] == "OK"
    assert got[3]["ts"] is None and got[3]["message"] is None


def test_install_lines(spark):
    got = P.parse_install(lines(spark, ["[2024-03-05 10:00:00][OK]    done", "[2024-03-05 10:00:00][WARN] x"])).collect()
    assert [(r["level"], r["message"]) for r in got] == [("OK", "done"), ("WARN", "x")]


def test_prefix_level(spark):
    cases = {"[OK] x": "OK", "[WARN] x": "WARN", "[EXISTS] x": "WARN", "[FAIL] x": "ERROR", "[MISSING] x": "ERROR",
             "x [OK]": "INFO"}
    df = lines(spark, cases).select("value", P.prefix_level("value"))
    assert dict(rows(df)) == cases


def test_dn_split(spark):
    df = lines(spark, ["OU=Disabled,DC=a,DC=b", "CN=x,DC=a"]).select(P.dn_name("value"), P.dn_parent("value"))
    assert rows(df) == [("Disabled", "DC=a,DC=b"), (None, None)]


XML = (
    '<Event xmlns="urn:x"><System><EventID>{code}</EventID></System><EventData>'
    '<Data Name="TargetUserName">{user}</Data><Data Name="CallerComputerName">{src}</Data></EventData></Event>'
)


def test_event_xml(spark):
    docs = [(f"2024-03-05 10:00:{i:02d}", XML.format(code="4740", user="bob", src=f"WS{i}")) for i in range(12)]
    docs += [("2024-03-05 11:00:00", XML.format(code="4740", user="eve", src="")),
             ("2024-03-05 11:00:00", XML.format(code="4625", user="bob", src="X"))]
    df = spark.createDataFrame(docs, "_time string, xml string").withColumn("_time", F.col("_time").cast("timestamp"))
    got = helpdesk.lockout_xml(df, "bob").collect()
    assert [r["source"] for r in got] == [f"WS{i}" for i in range(11, 1, -1)]
    one = df.filter("xml like '%eve%'").select(P.xml_data("xml", "TargetUserName"), P.xml_data("xml", "CallerComputerName"))
    assert rows(one) == [("eve", "")]
    parsed = P.parse_event_xml(df.filter("xml like '%eve%'")).select(
        P.event_data("TargetUserName"), P.event_data("CallerComputerName"), P.event_data("Nope"))
    assert rows(parsed) == [("eve", "", "")]


def test_helpdesk_views(spark):
    text = [f"[2024-03-05 10:00:{i:02d}][{'ERROR' if i % 2 else 'OK'}] [ana] step {i}" for i in range(50)]
    log = P.parse_audit(lines(spark, text))
    got = helpdesk.recent_log(log).collect()
    assert len(got) == 40 and got[0]["line"].endswith("step 49") and got[0]["level_class"] == "ERROR"


def test_limit_comes_before_the_source_filter(spark):
    rows_ = [(f"2024-03-05 10:00:{i:02d}", "Excel" if i < 5 else "Other", "1000", "Error", "m") for i in range(25)]
    df = spark.createDataFrame(rows_, "t string, source string, event_id string, entry_type string, message string")
    df = df.withColumn("time_generated", F.col("t").cast("timestamp"))
    assert helpdesk.recent_app_errors(df).count() == 0
    assert helpdesk.recent_app_errors(df, n=25).count() == 5


def test_hotfixes(spark):
    df = spark.createDataFrame(
        [("a", "2024-02-27 12:00:00"), ("b", "2024-02-27 12:00:01"), ("c", "2024-03-05 00:00:00")], "id string, t string"
    ).select("id", F.lit("d").alias("description"), F.col("t").cast("timestamp").alias("installed_on"))
    assert [r["id"] for r in helpdesk.recent_hotfixes(df, NOW).collect()] == ["c", "b"]


def test_span_of_range():
    assert TimeRange.last(NOW, minutes=6).earliest.minute == 54


@pytest.mark.parametrize("table", sorted(vocab.DISPLAY_NAMES))
def test_every_table_of_display_names(spark, table):
    """All columns of a table get their labels, each its own; others keep their names."""
    names = vocab.DISPLAY_NAMES[table]
    df = spark.createDataFrame([tuple(range(len(names) + 1))], [*names, "not_listed"])
    shown = with_display_names(df, table)
    assert shown.columns == [*names.values(), "not_listed"] and len(set(shown.columns)) == len(names) + 1
    assert tuple(shown.first()) == tuple(range(len(names) + 1))
    one = df.select(next(iter(names)))
    assert with_display_names(one, table).columns == [next(iter(names.values()))]
