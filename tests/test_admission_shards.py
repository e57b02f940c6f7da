"""Admission by shards: few state entries however many keys there are, null keys and ids, and times out of order."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd

from tessera.streaming import admission


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    """Spark's state of one key in plain dicts; writes are counted."""

    def __init__(self):
        self.entries, self.writes, self.timers = {}, 0, set()
        self.values = {}

    def getMapState(self, name, *schemas):
        def put(key, value):
            self.writes += 1
            self.entries[key] = value

        return SimpleNamespace(containsKey=self.entries.__contains__, getValue=self.entries.__getitem__, updateValue=put, removeKey=self.entries.pop, keys=lambda: iter(list(self.entries)))

    def getValueState(self, name, schema):
        return self.values.setdefault(name, Value())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def run(events, limit, window, parts, late, key=0):
    """Verdicts on (key, id, at) through the processor, with the watermark `late` seconds behind what has come."""
    handle, out = Handle(), []
    processor = admission.Admission(limit, window)
    processor.init(handle)

    def fire(now):
        while due := sorted(x for x in handle.timers if x <= now):
            handle.timers.discard(due[0])
            out.extend(processor.handleExpiredTimer((key,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), SimpleNamespace(getExpiryTimeInMs=lambda: due[0])))

    newest = 0.0
    for part in parts:
        rows = [events[i] for i in part]
        frame = pd.DataFrame({"key": [k or 0 for k, _, _ in rows], "event_id": [i or 0 for _, i, _ in rows], "nulls": np.array([2 * (k is None) + (i is None) for k, i, _ in rows], np.int32), "at": [at for *_, at in rows], "closing": False})
        out.extend(processor.handleInputRows((key,), iter([frame]), None))
        newest = max(newest, *(at for *_, at in rows))
        fire(int((newest - late) * 1000))
    fire(1 << 50)
    found = pd.concat([x for x in out if len(x)])
    return {tuple(None if pd.isna(x) else x for x in r) for r in found.itertuples(index=False)}, handle


def expected(events, limit, window):
    want, times = set(), {}
    for k, i, at in sorted(events, key=lambda e: (e[2], e[1] is None, e[1] or 0)):
        live = [x for x in times.get(k, []) if x > at - window]
        ok = len(live) < limit
        want.add((k, i, ok, 0.0 if ok else round(window - (at - live[0]), 6)))
        times[k] = live + [at] if ok else live
    return want


def test_a_shard_of_many_keys_has_few_state_entries():
    rng = random.Random(3)
    events = [(k, 1000 * k + i, 1e9 + rng.random() * 30 * 86400) for k in range(300) for i in range(20)]
    events += [(None, i, 1e9 + i * 3000.0) for i in range(20)] + [(7, None, 1e9 + 5.0)]
    found, handle = run(events, 2, 86400.0, [range(len(events))], 86400.0)
    assert found == expected(events, 2, 86400.0) and handle.writes <= 4 and not handle.entries and not handle.values["times"].exists()


def test_entries_that_overlap_are_judged_in_order(monkeypatch):
    monkeypatch.setattr(admission, "ENTRY", 16)
    monkeypatch.setattr(admission, "GATHERED", 64)
    rng = random.Random(4)
    for seed in range(5):
        rng.seed(seed)
        events = sorted(((rng.choice([1, 2, None]), i, 1e6 + rng.random() * 4000) for i in range(600)), key=lambda e: e[2] + rng.random() * 300)
        found, handle = run(events, 3, 120.0, [range(i, i + 50) for i in range(0, 600, 50)], 400.0)
        assert found == expected(events, 3, 120.0) and not handle.entries
