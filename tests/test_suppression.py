"""Folds over ordered events against plain single-pass code."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightdesk.functions import chunked
from nightdesk.operators.suppression import HOUR, suppress, suppression_compose, suppression_exit, suppression_summary

SECOND = 1_000_000


def greedy(times, period):
    out, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= period:
            out.append(t)
            last = t
    return out


@pytest.fixture(scope="module")
def bursts():
    """Keys from constant attack to rare events, with repeated instants."""
    rng = random.Random(7)
    times = {}
    for i, mean in enumerate([5, 30, 100, 400, 900, 2000]):
        t, series = 0, []
        for _ in range(400):
            t += int(rng.expovariate(1 / mean) * SECOND) + 1
            series += [t] * (2 if rng.random() < 0.05 else 1)
        times[f"k{i}"] = series
    times["single"] = [42 * SECOND]
    return times


def collected(df, key, time):
    out = {}
    for row in df.select(key, F.unix_micros(time).alias("t")).collect():
        out.setdefault(row[0], []).append(row[1])
    return {k: sorted(v) for k, v in out.items()}


# hot_rows=0 sends every key through the chunks, 10**9 none; chunk_rows=1 keeps
# the slots as chunks.
ROUTES = [(0, HOUR, 1), (0, HOUR // 12, 30), (0, 24 * HOUR, 1), (0, HOUR, 50), (10**9, HOUR, 1), (410, HOUR, 100)]


@pytest.mark.parametrize("hot,slot,size", ROUTES)
def test_suppress_equals_single_pass(spark, bursts, hot, slot, size):
    rows = [(k, t, "x") for k, ts in bursts.items() for t in ts]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, t bigint, x string").select(
        "key", F.timestamp_micros("t").alias("_time"), "x"
    )
    got = collected(suppress(df, "key", 300, slot_micros=slot, hot_rows=hot, chunk_rows=size), "key", "_time")
    assert got == {k: greedy(ts, 300 * SECOND) for k, ts in bursts.items()}
    for times in got.values():
        assert all(b - a >= 300 * SECOND for a, b in zip(times, times[1:]))


def test_suppression_boundary(spark):
    """One second short of the period is muted; exactly the period fires."""
    rows = [("a", 0), ("a", 299), ("a", 300), ("a", 599), ("b", 10), (None, 5)]
    df = spark.createDataFrame(rows, "key string, s bigint").select("key", F.timestamp_seconds("s").alias("_time"))
    got = collected(suppress(df, "key", 300), "key", "_time")
    assert got == {"a": [0, 300 * SECOND], "b": [10 * SECOND]}


def test_bad_arguments(spark):
    df = spark.createDataFrame([], "key string, _time timestamp")
    with pytest.raises(ValueError):
        suppress(df, "key", 0)


@pytest.mark.parametrize("period,slot", [(300, HOUR // 60), (7200, HOUR // 12), (10**6, HOUR)])
def test_tree_of_summaries(spark, bursts, monkeypatch, period, slot):
    """Four summaries a task at most, periods longer than a chunk; a task with more would fail."""
    monkeypatch.setattr(chunked, "FAN_BITS", 2)
    df = spark.createDataFrame([(k, t) for k, ts in bursts.items() for t in ts], "key string, t bigint")
    df = df.select("key", F.timestamp_micros("t").alias("_time"))
    got = collected(suppress(df, "key", period, slot_micros=slot, hot_rows=0, chunk_rows=1), "key", "_time")
    assert got == {k: greedy(ts, period * SECOND) for k, ts in bursts.items()}


def test_levels_leave_few_nodes():
    for slot in (1, 1000, HOUR // 60, HOUR, 24 * HOUR, 1 << 60):
        rounds = chunked.levels(slot)
        reach = (1 << chunked.TIME_BITS) // slot
        assert (reach >> chunked.FAN_BITS * rounds) - ((-reach - 1) >> chunked.FAN_BITS * rounds) <= (1 << chunked.FAN_BITS) + 1


@pytest.mark.parametrize("period", [50, 5_000, 2_000_000])
def test_composed_summaries_of_many_events(period):
    """A million events in chunks far shorter and far longer than the period: one summary of all tells every exit."""
    rng = np.random.default_rng(3)
    times = np.cumsum(rng.integers(1, 20, 1_000_000))
    parts = [(int(p[0]), suppression_summary(p, int(p[0]), period)) for p in np.array_split(times, 200)]
    while len(parts) > 1:
        joined = [(a[0], suppression_compose(a[1], b[1], a[0], period)) for a, b in zip(parts[::2], parts[1::2])]
        parts = joined + parts[len(joined) * 2 :]
    start, steps = parts[0]
    assert len(steps) <= np.searchsorted(times, start + period) + 1
    for entry in (None, start - 1, start - period // 2, start - period):
        at, last = (0 if entry is None else int(np.searchsorted(times, entry + period))), entry
        while at < len(times):
            last = int(times[at])
            at = int(np.searchsorted(times, last + period))
        assert suppression_exit(steps, entry, period) == last
