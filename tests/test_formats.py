"""Log formats against the text readers."""

import os

import pytest
from helpers import rows

from nightdesk.sources import logs
from nightdesk.sources.formats import register_formats

ACCESS = [
    '10.0.0.1 - bob [05/Mar/2024:10:00:00 +0000] "GET /a HTTP/1.1" 200 12 "-" "ua x"',
    "not an access line", "", 'ünï [05/Mar/2024:10:00:01 +0000]',
    '10.0.0.2 - - [05/Mar/2024:10:00:02 +0000] "POST /b?c=d HTTP/1.1" 404 - "http://r" "é"',
]
AUDIT = ["[2024-03-05 10:00:00][OK] [TKT:7] [eve] done", "[2024-03-05 10:00:01][WARN] [bob] ACTION: x | User=y", "other"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    register_formats(spark)
    base = tmp_path_factory.mktemp("logs")
    (base / "sub").mkdir()
    (base / "access-1.log").write_text("\n".join(ACCESS * 20) + "\n")
    (base / "sub" / "access-2.log").write_text("\n".join(ACCESS))  # no line end at the end
    (base / "_hidden").write_text("x\n")
    (base / "empty.log").write_text("")
    return str(base)


FIELDS = ["client_ip", "method", "uri", "status", "bytes", "user_agent", "_raw", "sourcetype", "host"]


@pytest.mark.parametrize("size", [90, 1000, 10**9])
def test_access_format_equals_reader(spark, folder, size):
    got = spark.read.format("nightdesk_access").option("range_bytes", size).load(folder)
    want = logs.read_lines(spark, f"{folder}/*.log", "nginx_access").unionByName(logs.read_lines(spark, f"{folder}/sub", "nginx_access"))
    assert sorted(rows(got.select(FIELDS)), key=str) == sorted(rows(want.select(FIELDS)), key=str)
    assert got.count() == 21 * len(ACCESS)


def test_formats_in_sql_and_as_stream(spark, folder, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.log").write_text("\n".join(AUDIT))
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW helpdesk_lines USING nightdesk_helpdesk OPTIONS (path '{tmp_path}/log')")
    got = spark.sql("SELECT level, agent, ticket, message FROM helpdesk_lines ORDER BY _raw")
    assert rows(got) == [("OK", "eve", "7", "done"), ("WARN", "bob", None, "ACTION: x | User=y"), (None, None, None, None)]

    stream = spark.readStream.format("nightdesk_syslog").load(str(tmp_path / "log"))
    writer = stream.select("_raw", "sourcetype").writeStream.format("parquet").option("path", str(tmp_path / "out"))
    for k in range(2):
        writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
        assert sorted(r["_raw"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(AUDIT + ["new"] * k)
        (tmp_path / "log" / "b.log").write_text("new\n")
        os.utime(tmp_path / "log" / "b.log", (4_000_000_000,) * 2)


def test_a_path_is_needed(spark, folder):
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("nightdesk_error").load().count()
