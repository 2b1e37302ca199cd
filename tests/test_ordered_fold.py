"""The streaming fold over a state that counts its calls: every call is a message to the engine."""

import random
from types import SimpleNamespace

import pandas as pd

from nightdesk.streaming.stateful import SLOT, OrderedFold

PERIOD = 600 * 1_000_000


class Store:
    """A state variable or a list of timers; all calls are counted in one place."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def _count(self):
        self.calls[0] += 1

    def exists(self):
        self._count()
        return bool(self.held)

    def get(self):
        self._count()
        return self.held.get(())

    def update(self, value):
        self._count()
        self.held[()] = value

    def keys(self):
        self._count()
        return iter(list(self.held))

    def containsKey(self, key):
        self._count()
        return key in self.held

    def getValue(self, key):
        self._count()
        return self.held.get(key)

    def updateValue(self, key, value):
        self._count()
        self.held[key] = value

    def removeKey(self, key):
        self._count()
        del self.held[key]

    def clear(self):
        self._count()
        self.held.clear()

    def registerTimer(self, at):
        self._count()
        self.held[at] = True


class Key:
    """One key of the stream: batches go in with the watermark they are worked off under."""

    def __init__(self):
        self.calls = [0]
        self.value, self.through, self.pending, self.timers = (Store(self.calls) for _ in range(4))
        handle = SimpleNamespace(
            getValueState=lambda name, _: self.value if name == "state" else self.through,
            getMapState=lambda *_: self.pending, registerTimer=self.timers.registerTimer,
        )
        self.fold = OrderedFold(
            lambda last, t: (t, True) if last is None or t - last >= PERIOD else (last, False),
            lambda last, t: last is not None and 0 <= t - last < PERIOD, None,
        )
        self.fold.init(handle)

    def batch(self, times, watermark):
        timer, out = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), []
        if times:
            pdf = pd.DataFrame({"t": times, "payload": [str(t) for t in times]})
            out += self.fold.handleInputRows(("k",), iter([pdf]), timer)
        for at in sorted(a for a in self.timers.held if a <= watermark):
            out += self.fold.handleExpiredTimer(("k",), timer, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
            del self.timers.held[at]
        rows = [tuple(r) for pdf in out for r in pdf.itertuples(index=False)]
        return [r[1] for r in rows if not r[3]], [r[1] for r in rows if r[3]]


def muted(times):
    last, out = None, []
    for t in sorted(times):
        if last is None or t - last >= PERIOD:
            last = t
            out.append(t)
    return out


def test_a_key_takes_few_calls_for_each_slot():
    """A thousand rows in as many minutes: a write and a read for each, and a handful for the key."""
    key, times = Key(), [k * SLOT + k for k in range(1000)]
    assert key.batch(random.Random(1).sample(times, 1000), -1) == ([], [])
    fired, late = key.batch([], times[-1] // 1000)
    assert fired == muted(times) and not late
    assert key.calls[0] <= 2 * 1000 + 20
    assert not key.pending.held and not key.timers.held


def test_batches_in_any_order_fire_as_one_sorted_run():
    """Rows wait for the watermark, also within a minute; a timer is there as long as a row waits."""
    for seed in range(30):
        chance, key = random.Random(seed), Key()
        times = sorted({chance.randrange(-5 * SLOT, 60 * SLOT) for _ in range(200)})
        fired, low, waits = [], -10 * SLOT, list(times)
        while waits:  # any rows that are not behind the watermark yet, then a later watermark
            part = chance.sample(waits, min(len(waits), chance.randrange(1, 40)))
            waits = [t for t in waits if t not in part]
            low = max(low, min(waits, default=low + 1) - 1)
            now, late = key.batch(part, low // 1000)
            assert not late
            fired += now
            assert not key.pending.held or key.timers.held
        fired += key.batch([], times[-1] // 1000 + 1)[0]
        assert fired == muted(times), seed
        assert not key.pending.held


def test_a_late_row_is_handed_out_and_changes_nothing():
    key = Key()
    key.batch([20 * SLOT, 40 * SLOT], 0)
    assert key.batch([], 41 * SLOT // 1000)[0] == [20 * SLOT, 40 * SLOT]
    assert key.batch([30 * SLOT, 60 * SLOT], 41 * SLOT // 1000) == ([], [30 * SLOT])
    assert key.batch([], 60 * SLOT // 1000) == ([60 * SLOT], [])
