"""Suppression on streams."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from nightdesk.functions.chunked import micros

_OUTPUT = "key string, t bigint, payload string, late boolean"
_COLUMNS = ["key", "t", "payload", "late"]
SLOT = 60 * 1_000_000
_OUT_ROWS = 10_000


class OrderedFold(StatefulProcessor):
    """Buffer a key's rows until the watermark passes them, then fold in time order.

    Rows of one micro-batch, or of several within the watermark delay, may come
    in any order; the output equals that of the batch operator.  ``advance``
    maps (state, t) to (state, emit).  ``settled`` tells whether a buffered row
    can no longer change anything, so hot keys do not pile up in the state.
    Rows wait in slots of a minute, of which only those that are due are read.  Every call of the state
    is a message to the engine, so a key has one timer for all rows it was given together, and not
    one a slot: the timer works off all slots that are due, one after the other, and the next slot
    that waits gets the next timer.
    A row older than one of its key that is already folded comes too late to be
    put in order: it is handed out at once, marked ``late``, and changes nothing.
    """

    def __init__(self, advance: Callable, settled: Callable, initial):
        self.advance, self.settled, self.initial = advance, settled, initial

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", "v string")
        self.through = handle.getValueState("through", "t bigint")
        self.pending = handle.getMapState("pending", "slot bigint", "rows string")

    def _state(self):
        held = self.value.get()
        return self.initial if held is None else json.loads(held[0])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.value.update((json.dumps(int(initialState["t"].max())),))

    def _waiting(self, slot: int) -> list:
        held = self.pending.getValue((slot,))
        return [] if held is None else json.loads(held[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, through, some = self._state(), self.through.get(), self.pending.exists()
        for pdf in rows:
            slots, late = defaultdict(list), []
            for t, payload in zip(pdf["t"].tolist(), pdf["payload"].tolist()):
                if through is not None and t < through[0]:
                    late.append((key[0], t, payload, True))
                elif not self.settled(state, t):
                    slots[t // SLOT].append([t, payload])
            for slot, new in slots.items():
                held = self._waiting(slot) if some else []
                self.pending.updateValue((slot,), (json.dumps(held + new),))
            if slots:
                self.handle.registerTimer(min(t for t, _ in slots[min(slots)]) // 1000)
                some = True
            if late:
                yield pd.DataFrame(late, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        slots = sorted(slot for (slot,) in self.pending.keys())
        ripe = [slot for slot in slots if slot * SLOT // 1000 <= watermark]
        if not ripe:  # an earlier timer of the key has worked them off
            return
        state, through, out, later = self._state(), None, [], []
        for slot in ripe:
            for t, payload in sorted(self._waiting(slot)):
                if t // 1000 > watermark:  # in the last of them only
                    later.append([t, payload])
                    continue
                state, emit = self.advance(state, t)
                through = t
                if emit:
                    out.append((key[0], t, payload, False))
            if len(out) >= _OUT_ROWS:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        if len(ripe) == len(slots):
            self.pending.clear()
        else:
            for slot in ripe:
                self.pending.removeKey((slot,))
        later = [r for r in later if not self.settled(state, r[0])]
        if later:
            self.pending.updateValue((ripe[-1],), (json.dumps(later),))
            self.handle.registerTimer(later[0][0] // 1000)
        elif len(ripe) < len(slots):
            self.handle.registerTimer(slots[len(ripe)] * SLOT // 1000)
        if through is not None:
            self.value.update((json.dumps(state),))
            self.through.update((through,))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def stream_suppress(
    alerts: DataFrame, key: str, period: int, delay: str | None, time: str = "_time", fired: DataFrame | None = None,
    late: bool = False, event: str | None = None,
) -> DataFrame:
    """Streaming twin of :func:`nightdesk.operators.suppression.suppress`.

    ``fired`` holds earlier firings (the key and time columns), for a stream
    that goes on where a batch run over history ended.  ``late`` adds the rows
    that came too late to be put in order, told by a column ``late``; without it
    they are left out.  For rows that are themselves results of a watermarked
    aggregate, ``delay`` is None and ``event`` names the column that carries the
    aggregate's event time; ``time`` still decides order and distance.
    """
    span = int(period) * 1_000_000
    if span <= 0:
        raise ValueError("the suppression period must be positive")

    def advance(last, t):
        return (t, True) if last is None or t - last >= span else (last, False)

    def settled(last, t):
        return last is not None and 0 <= t - last < span

    columns = [c for c in alerts.columns if c != event]
    payload = F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    rows = alerts.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    shaped = rows.select(
        F.col(event or time).alias("_event"), F.col(key).cast("string").alias("key"), micros(time).alias("t"),
        payload.alias("payload"),
    )
    if delay is not None:
        # Without the column itself, no row is dropped behind the watermark: the fold tells the late ones.
        shaped = shaped.withWatermark("_event", delay).select("key", "t", "payload")
    seed = None
    if fired is not None:
        seed = fired.groupBy(F.col(key).cast("string").alias("key")).agg(F.max(micros(time)).alias("t")).groupBy("key")
    folded = shaped.groupBy("key").transformWithStateInPandas(
        statefulProcessor=OrderedFold(advance, settled, None),
        outputStructType=_OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
        initialState=seed,
    )
    schema = alerts.select(*columns).schema
    row = F.from_json("payload", schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("row")
    if late:
        return folded.select(row, "late").select("row.*", "late")
    return folded.filter(~F.col("late")).select(row).select("row.*")
