"""The order of results, which row-set comparison does not see."""

import os
import random

import pytest
from conftest import TESTDATA
from helpers import at, events, failure
from order import check_order, out_of_order

from nightdesk.operators.logons import brute_force
from nightdesk.plans.catalog import QUERIES

SF_DIR = f"{TESTDATA}/sf0.01"

ORDERED = {
    "q01_lockouts": ["-lockout_time", "locked_account"],
    "q02_lockout_frequency": ["-total_lockouts", "locked_account"],
    "q03_brute_force": ["-failure_count", "window_start", "target_account"],
    "q04_password_spray": ["-accounts_targeted", "window_start", "source_ip"],
    "q05_gpo_changes": ["-change_time", "change_type"],
    "q07_unexpected_actors": ["-changes", "actor"],
    "q08_new_accounts": ["-create_time", "new_account"],
    "q09_account_lifecycle": ["-ev_time", "event_desc"],
    "q10_high_privilege_group_adds": ["-ev_time", "member_added"],
    "q11_security_timeline": ["bucket", "series"],
    "q12_top_locked_accounts": ["-lockout_count", "locked_account"],
    "q13_failed_logons_by_ip": ["-failures", "source_ip"],
    "t02_text_sort": ["-lockout_time"],
    "tk06_ticket_report": ["number"],
    "tk06_ticket_report_short": ["number"],
    "tk07_people_listing": ["type", "name", "email"],
    "tk08_config_listing": ["section", "item"],
    "dr03_find_users": ["name", "sam"],
    "dr04_list_groups": ["name"],
    "w06_top_uris": ["-count", "uri"],
}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(ORDERED))
def test_results_come_in_order(spark, name):
    check_order(QUERIES[name](spark, SF_DIR), ORDERED[name])


def attempts(spark):
    rng = random.Random(2)
    made = [failure(f"10:{rng.randrange(60):02d}:{k % 60:02d}", f"user{k % 17}") for k in range(600)]
    return events(spark, made)


def test_brute_force_loses_its_order_without_the_sort(spark):
    """The same rows without ``orderBy`` are told apart by the checker."""
    keys = ["-failure_count", "window_start", "target_account"]
    rows = check_order(brute_force(attempts(spark), min_failures=2), keys)
    unsorted = brute_force(attempts(spark), min_failures=2, ordered=False).collect()
    assert len(unsorted) == len(rows) and out_of_order(unsorted, keys) is not None


def test_checker():
    assert out_of_order([{"a": 3, "b": 1}, {"a": 3, "b": 0}, {"a": 1, "b": 9}], ["-a"]) is None
    assert out_of_order([{"a": 3, "b": 1}, {"a": 3, "b": 0}], ["-a", "b"]) == 1
    assert out_of_order([{"a": None}, {"a": 1}], ["a"]) is None and out_of_order([{"a": None}, {"a": 1}], ["-a"]) == 1
    assert out_of_order([{"t": at("10:00:00")}, {"t": at("09:00:00")}], ["-t"]) is None
