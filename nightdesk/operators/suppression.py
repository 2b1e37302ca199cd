"""Alert suppression over event history."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightdesk.functions.chunked import CHUNK_ROWS, HOT_ROWS, Fold, fold_by_key, micros
from nightdesk.functions.scalars import first_per_key, left_lookup

HOUR = 3600 * 1_000_000
FREE = None


def _follow(step: np.ndarray) -> np.ndarray:
    """Last index of each chain, where ``step[i]`` is i's successor or ``len(step)``."""
    n = len(step)
    end = np.where(step < n, step, np.arange(n))
    while True:
        further = end[end]
        if (further == end).all():
            return end
        end = further


def _merged(steps: np.ndarray, start: int, period: int) -> np.ndarray:
    """The steps that can be entered before ``start``, the last of each run with one exit."""
    reach = int(np.searchsorted(steps[:, 0], start + period, "left"))
    steps = steps[: reach + 1]
    return steps[np.append(steps[1:, 1] != steps[:-1, 1], True)]


def suppression_summary(times: np.ndarray, start: int, period: int) -> np.ndarray:
    """Exit state by entry state, as rows (highest first event, last firing).

    Firing at index i is followed by the first event at least ``period`` later,
    so the firings of a chunk form chains; an entry state only decides where the
    chain starts, and only within ``period`` of the chunk's start.
    """
    step = np.searchsorted(times, times + period, "left")
    return _merged(np.stack([times, times[_follow(step)]], 1).astype(np.int64), start, period)


def suppression_compose(one: np.ndarray, two: np.ndarray, start: int, period: int) -> np.ndarray:
    """Summary of two neighbouring stretches of time, the first of which begins at ``start``.

    Every exit of the first is an entry of the second; entries that let no event of the first fire
    meet the second's own steps.  Chains that come together stay together, so a summary has no more
    steps than there are events within one period of its start.
    """
    at = np.searchsorted(two[:, 0], one[:, 1] + period, "left")
    exits = np.where(at < len(two), two[np.minimum(at, len(two) - 1), 1], one[:, 1])
    through = two[np.searchsorted(two[:, 0], one[-1, 0], "right") :]
    return _merged(np.concatenate([np.stack([one[:, 0], exits], 1), through]), start, period)


def suppression_exit(steps: np.ndarray, entry: int | None, period: int) -> int | None:
    """Last firing after a chunk entered with ``entry`` as the last firing before it."""
    if entry is FREE:
        return int(steps[0, 1])
    at = int(np.searchsorted(steps[:, 0], entry + period, "left"))
    return int(steps[at, 1]) if at < len(steps) else entry


def _packed(steps: np.ndarray, start: int) -> bytes:
    return np.concatenate([[start], steps.ravel()]).astype("<i8").tobytes()


def _unpacked(summary: bytes) -> tuple[np.ndarray, int]:
    held = np.frombuffer(summary, "<i8")
    return held[1:].reshape(-1, 2), int(held[0])


def suppression_firings(times: np.ndarray, entry: int | None, period: int) -> list[int]:
    """Indices of the firing events of a sorted chunk."""
    fired, i = [], 0 if entry is FREE else int(np.searchsorted(times, entry + period, "left"))
    while i < len(times):
        fired.append(i)
        i = int(np.searchsorted(times, times[i] + period, "left"))
    return fired


def suppress(
    alerts: DataFrame,
    key: str,
    period: int,
    time: str = "_time",
    slot_micros: int = HOUR,
    hot_rows: int | None = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    fired: DataFrame | None = None,
) -> DataFrame:
    """Keep at most one firing per key and period, greedily from the first event.

    An event fires when the key has not fired yet or ``period`` seconds have
    passed since its last firing.  Events of the same instant fire once (the
    smallest by the other columns).  Rows without a key are dropped.  ``fired``
    holds firings of an earlier run (key and time) over events before these;
    what they mute is left out.
    """
    span = int(period) * 1_000_000
    if span <= 0:
        raise ValueError("the suppression period must be positive")
    shaped = alerts.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    if fired is not None:
        # Rows within the period of the last firing go; the rest is as if nothing had fired.
        last = fired.groupBy(F.col(key).alias("_key")).agg(F.max(time).alias("_last"))
        shaped = left_lookup(shaped, key, last, "_key")
        muted = F.col("_last").isNotNull() & (F.unix_micros(time) - F.unix_micros("_last") < span)
        shaped = shaped.filter(~muted).drop("_last")
    instants = first_per_key(shaped, [key, time])

    def native(rows):
        start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out"))

        def step(acc, row):
            fires = acc["last"].isNull() | (row["t"] - acc["last"] >= span)
            fired = F.struct(row["t"].alias("last"), F.array_append(acc["out"], row["t"]).alias("out"))
            return F.when(fires, fired).otherwise(acc)

        return F.aggregate(rows, start, step, lambda acc: acc["out"])

    def composed(one, two):
        (first, start), (second, _) = _unpacked(one), _unpacked(two)
        return _packed(suppression_compose(first, second, start, span), start)

    fold = Fold(
        native=native,
        summarise=lambda pdf, start: _packed(suppression_summary(pdf["t"].to_numpy(), start, span), start),
        compose=composed,
        advance=lambda summary, entry: suppression_exit(_unpacked(summary)[0], entry, span),
        replay=lambda pdf, entry: pdf["t"].iloc[suppression_firings(pdf["t"].to_numpy(), entry, span)].tolist(),
        initial=FREE,
        encode=json.dumps,
        decode=json.loads,
    )
    times = shaped.select(key, time).distinct().select(key, micros(time).alias("t"))
    fired = fold_by_key(times, key, fold, slot_micros, hot_rows, chunk_rows)
    fired = fired.select(key, F.timestamp_micros("t").alias(time))
    return instants.join(fired, [key, time], "left_semi").select(*alerts.columns)
