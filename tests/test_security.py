"""Detections at their real thresholds and at the edges of the language's rules."""

import pytest
from helpers import at, events, failure, lockout, policy, rows
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions import scalars as S
from nightdesk.functions.timerange import TimeRange, in_range
from nightdesk.operators import changes, kpi, lockouts, logons, timechart
from nightdesk.operators.base import security

NOW = "2024-03-05 12:00:00"


def test_brute_force_threshold_is_five_in_one_bucket(spark):
    data = [failure(f"10:0{i}:00", "four") for i in range(4)]
    data += [failure(f"10:0{i}:30", "five", ip=f"10.0.0.{i}") for i in range(5)]
    data += [failure(t, "edge") for t in ("10:08:00", "10:09:00", "10:09:59", "10:10:00", "10:11:00")]
    data += [failure(f"10:05:{i:02d}", "ten") for i in range(10)] + [failure(f"10:06:{i:02d}", "twenty") for i in range(20)]
    data += [failure(f"10:07:{i:02d}", None) for i in range(9)]
    got = {r["target_account"]: r for r in logons.brute_force(events(spark, data)).collect()}
    assert set(got) == {"five", "ten", "twenty"}
    assert [got[a]["risk"] for a in ("five", "ten", "twenty")] == ["MEDIUM", "HIGH", "CRITICAL"]
    assert got["five"]["unique_ips"] == 5 and got["five"]["window_start"] == "2024-03-05 10:00"
    assert got["ten"]["logon_types"] == ["Network (SMB/RPC)"]
    assert got["ten"]["failure_reasons"] == ["Wrong password"]


def test_brute_force_panel_keeps_twenty(spark):
    data = [failure(f"10:01:{i:02d}", f"u{a:02d}") for a in range(25) for i in range(5)]
    got = logons.brute_force_panel(events(spark, data), TimeRange.last(NOW, hours=24)).collect()
    assert len(got) == 20 and got[0]["window"] == "03/05 10:00" and got[0]["target_account"] == "u00"


def test_password_spray_ratio_edge(spark):
    twice = [failure(f"11:01:{i:02d}", f"u{i % 5}", ip="1.1.1.1") for i in range(10)]
    more = [failure(f"11:02:{i:02d}", f"u{i % 5}", ip="2.2.2.2") for i in range(11)]
    few = [failure(f"11:03:{i:02d}", f"u{i}", ip="3.3.3.3") for i in range(4)]
    old = [failure(f"10:01:{i:02d}", f"u{i}", ip="4.4.4.4") for i in range(5)]
    got = logons.password_spray(events(spark, twice + more + few + old), NOW).collect()
    assert [(r["source_ip"], r["accounts_targeted"], r["total_attempts"], r["spray_ratio"]) for r in got] == [
        ("1.1.1.1", 5, 10, 2.0)
    ]


def test_addresses_fall_back_and_local_ones_are_left_out(spark):
    data = [
        failure("11:00:00", ip=None), failure("11:00:01", ip=None, Source_Network_Address="-"),
        failure("11:00:02", ip="127.0.0.1"), failure("11:00:03", ip="::1"),
        failure("11:00:04", "a", ip="9.9.9.9"), failure("11:00:05", "b", ip="9.9.9.9"),
        failure("11:00:06", None, ip="9.9.9.9", Account_Name=None),
    ]
    e = events(spark, data)
    assert rows(logons.failed_logons_by_ip(e, NOW)) == [("9.9.9.9", 3, 3), ("::1", 1, 2)]
    panel = logons.failed_logons_by_ip(e, NOW, exclude=vocab.LOCAL_ADDRESSES_PANEL, with_accounts=False)
    assert rows(panel) == [("9.9.9.9", 3)]


def test_failure_reason_order_is_kept(spark):
    cases = [
        ("0xC000006D", "0xC0000064", "Wrong password"),
        ("0xC0000001", "0xC0000064", "Unknown username"),
        ("0xC0000234", "0x0", "Account locked out"),
        ("0xC0000193", "0x0", "Account expired"),
        ("0x1", "0x2", "Code: 0x1 / 0x2"),
        ("0x1", None, None),
    ]
    df = spark.createDataFrame(cases, "Status string, Sub_Status string, want string")
    assert all(r[0] == r[1] for r in df.select("want", S.failure_reason()).collect())


def test_logon_type_names_differ_by_use(spark):
    df = spark.createDataFrame([("8",), ("9",), (None,)], "Logon_Type string")
    assert [r[0] for r in df.select(S.logon_type_name()).collect()] == ["NetworkCleartext", "Type 9", None]
    assert [r[0] for r in df.select(S.logon_type_short()).collect()] == ["Other (Type 8)", "Other (Type 9)", None]


def test_lockout_frequency_window_and_nulls(spark):
    data = [lockout("11:00:00"), lockout("11:30:00", source="WS2"), lockout("2024-02-27 12:00:00"),
            lockout("2024-02-27 11:59:59"), lockout("12:00:00"), lockout("11:00:00", account=None)]
    got = rows(lockouts.lockout_frequency(events(spark, data), NOW))
    assert got == [("bob", 3, 2, ["WS1", "WS2"], "2024-02-27 12:00", "2024-03-05 11:30")]


def test_recent_lockouts_sort_by_time_or_text(spark):
    e = events(spark, [lockout("2024-03-04 23:00:00", "late"), lockout("08:00:00", "early")])
    by_time = lockouts.recent_lockouts(e, NOW, hours=24)
    by_text = lockouts.recent_lockouts(e, NOW, hours=24, compat_text_sort=True)
    assert [r[1] for r in by_time.collect()] == ["early", "late"]
    assert [r[1] for r in by_text.collect()] == ["late", "early"]


def test_lockout_cause(spark):
    data = [lockout("10:00:00", "a", "SRV1"), lockout("11:00:00", "a", "  "), lockout("11:00:00", "b", "srv9"),
            lockout("11:00:00", "c", "LAPTOP")]
    e = events(spark, data)
    newest = {r["account"]: r["cause"] for r in lockouts.lockout_root_cause(e).collect()}
    assert newest == {"a": "mobile device or webmail", "b": "saved service credential on server",
                      "c": "saved credential on workstation"}
    oldest = {r["account"]: r["cause"] for r in lockouts.lockout_root_cause(e, compat_oldest=True).collect()}
    assert oldest["a"] == "saved service credential on server"
    assert lockouts.lockout_sources(e, user="A", n=1).collect()[0]["shown_source"].startswith("(blank")


def test_unexpected_actors_case_and_null(spark):
    data = [policy("10:00:00", a) for a in ("Administrator", "SYSTEM", "DC01$", "system", "eve", None)]
    data.append(policy("10:30:00", "eve", "4719"))
    got = rows(changes.policy_changes_by_unexpected_actor(events(spark, data)))
    assert got == [("eve", 2, ["4719", "5136"], "2024-03-05 10:30:00"),
                   ("system", 1, ["5136"], "2024-03-05 10:00:00")]


def test_gpo_changes_defaults(spark):
    data = [policy("10:00:00", "eve", Old_Value=None, New_Value=None, Object_DN=["CN=x"]),
            policy("10:00:01", "eve", Object_Class="user"),
            policy("10:00:02", "eve", "5141", Object_Class="GROUPPOLICYCONTAINER")]
    got = changes.gpo_changes(events(spark, data)).collect()
    assert [(r["change_type"], r["gpo_name"], r["attribute"], r["old_value"], r["new_value"]) for r in got] == [
        ("GPO Deleted", None, "N/A", "(new)", "(deleted)"), ("GPO Modified", "CN=x", "N/A", "(new)", "(deleted)")]


def test_privileged_names_and_groups(spark):
    data = [{"time": "10:00:00", "EventCode": "4720", "Target_Account_Name": [n]} for n in ("SVC_x", "bob", "root")]
    flags = {r["new_account"]: r["is_privileged"] for r in changes.new_accounts(events(spark, data)).collect()}
    assert flags == {"SVC_x": "YES ⚠", "bob": "No", "root": "No"}
    groups = [{"time": "10:00:00", "EventCode": "4728", "Target_Account_Name": [g]} for g in ("domain admins", "GRP-HR")]
    assert [r["added_to_group"] for r in changes.high_privilege_group_adds(events(spark, groups)).collect()] == ["domain admins"]
    panel = changes.group_changes(events(spark, groups), NOW, flag=True).collect()
    assert sorted(r["is_high_priv"] for r in panel) == ["HIGH ⚠", "Standard"]


def test_tiles_on_empty_input_give_one_zero_row(spark):
    e = events(spark, [])
    assert rows(kpi.kpi_lockouts(e, NOW)) == [(0, 0)]
    assert {r["value"] for r in kpi.kpi_board(e, NOW).collect()} == {0}
    assert kpi.kpi_board(e, NOW).count() == 5


@pytest.mark.parametrize("value,band", [(0, 0), (1, 1), (3, 1), (4, 2), (9, 2), (10, 3)])
def test_bands(spark, value, band):
    assert spark.range(1).select(S.band(F.lit(value), [0, 3, 9])).first()[0] == band


def test_timechart_fills_zeros_and_sums_to_the_count(spark):
    data = [failure(f"{h:02d}:15:00", a) for h, a in [(1, "a"), (1, "a"), (5, "b"), (9, None)]]
    time = TimeRange.last(NOW, hours=12)
    e = security(events(spark, data), ["4625"], time)
    chart = timechart.timechart(e, "1 hour", time, S.nth("Account_Name", 1)).collect()
    assert len(chart) == 12 * 3 and sum(r["count"] for r in chart) == 4
    assert {r["series"] for r in chart} == {"a", "b", "NULL"}
    plain = timechart.timechart_count(e, "1 hour", time).collect()
    assert len(plain) == 12 and sum(r["count"] for r in plain) == 4


def test_timechart_keeps_ten_series_plus_other(spark):
    data = [failure("10:00:00", f"u{i:02d}") for i in range(13) for _ in range(20 - i)]
    time = TimeRange.last(NOW, hours=4)
    e = events(spark, data)
    totals = (
        timechart.timechart(e, "1 hour", time, S.nth("Account_Name", 1)).groupBy("series").agg(F.sum("count").alias("n"))
    )
    got = dict(rows(totals))
    assert got.pop("OTHER") == 10 + 9 + 8
    assert got == {f"u{i:02d}": 20 - i for i in range(10)}


def test_timechart_empty_input(spark):
    time = TimeRange.last(NOW, hours=2)
    e = events(spark, [])
    assert [r["count"] for r in timechart.timechart_count(e, "1 hour", time).collect()] == [0, 0]
    assert timechart.timechart(e, "1 hour", time, "host").count() == 0


def test_timechart_wide(spark):
    time = TimeRange.last(NOW, hours=2)
    e = events(spark, [failure("10:30:00"), failure("11:30:00", host="DC02")])
    wide = timechart.wide(timechart.timechart(e, "1 hour", time, "host"), ["DC01", "DC02", "DC03"])
    assert [tuple(r)[1:] for r in wide.collect()] == [(1, 0, 0), (0, 1, 0)]


def test_time_ranges(spark):
    time = TimeRange.last("2024-03-05 12:34:56", hours=24, snap_to="hour")
    assert time.earliest == at("2024-03-04 12:00:00")
    assert TimeRange.last("2024-03-05 12:34:56", days=7, snap_to="day").earliest == at("2024-02-27 00:00:00")
    assert TimeRange.default("2024-03-05 12:34:56") == time
    e = events(spark, [lockout("2024-03-04 12:00:00"), lockout("2024-03-04 11:59:59"), lockout("12:34:56")])
    assert in_range(e, time).count() == 1


def test_base_filter_compares_names_without_case(spark):
    e = events(spark, [lockout("10:00:00", sourcetype="wineventlog:security", index="WINEVENTLOG"),
                       lockout("10:00:00", sourcetype="WinEventLog:System")])
    assert security(e, ["4740"]).count() == 1
    assert security(e, ["4740"], index=None, sourcetype=None).count() == 2


def test_account_filter(spark):
    e = events(spark, [failure("10:00:00", "Bob"), failure("10:00:00", "b_b"), failure("10:00:00", "alice")])
    assert security(e, account="b*").count() == 2
    assert security(e, account="b_b").count() == 1
    assert security(e, account="*").count() == 3


def test_display_names(spark):
    df = S.with_display_names(lockouts.lockouts(events(spark, [lockout("10:00:00")])), "lockouts")
    assert df.columns == ["Lockout Time", "Locked Account", "Source Workstation", "Domain Controller"]


def test_first_per_key_is_deterministic(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 5, "q")], "k string, o int, v string")
    assert sorted(rows(S.first_per_key(df, ["k"], ["o"]))) == [("a", 1, "y"), ("b", 5, "q")]
