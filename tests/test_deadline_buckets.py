"""The deadline monitor's packed buckets: the same outcomes as a state per task, and few calls however many tasks a bucket holds."""

import random
from collections import Counter

import numpy as np
import pandas as pd

from tallyfield.streaming import deadlines


class Handle:
    """State and timers of one key in memory; counts the calls. ``forgets``: timers end with the state, so that none of a task that is over wakes a new one."""

    def __init__(self, forgets=False):
        self.calls, self.values, self.timers, self.forgets = Counter(), {}, set(), forgets

    def getValueState(self, name, schema):  # noqa: N802
        return Value(self, name)

    def getListState(self, name, schema):  # noqa: N802
        return Items(self, name)

    def registerTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1
        self.timers.discard(at)


class Value:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def get(self):
        self.handle.calls["get"] += 1
        return self.handle.values.get(self.name)

    def update(self, value):
        self.handle.calls["update"] += 1
        self.handle.values[self.name] = value

    def clear(self):
        self.handle.calls["clear"] += 1
        self.handle.values.pop(self.name, None)
        if self.handle.forgets and self.name == "task":
            self.handle.timers.clear()


class Items(Value):
    def get(self):
        return iter(self.handle.values.get(self.name, []))

    def appendList(self, rows):  # noqa: N802
        self.handle.values.setdefault(self.name, []).extend(rows)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


def _fire(monitor, handle, key, clock):
    out = []
    for at in sorted(t for t in handle.timers if t <= clock.at):
        if at in handle.timers:
            handle.timers.discard(at)
            out += list(monitor.handleExpiredTimer(key, clock, None))
    return out


def _frame(wave):
    code = {"task": deadlines.TASK, "arrival": deadlines.ARRIVAL, "end": 0}
    return pd.DataFrame({
        "task_id": [r["task_id"] for r in wave], "code": [code[r["kind"]] for r in wave],
        "sec": pd.array([r["deadline_sec"] if r["kind"] == "task" else r["event_sec"] for r in wave], dtype="float64")})


def _run(waves, retention):
    """Rows given out per wave, by tasks and by one bucket of all of them."""
    alone, bucket, store = {}, deadlines._Deadlines(retention), Handle()
    bucket.init(store)
    for at, wave in waves:
        clock, one, many = Watermark(at), [], []
        for task in sorted({r["task_id"] for r in wave}):
            if task not in alone:
                alone[task] = deadlines._Deadline(retention), Handle(forgets=True)
                alone[task][0].init(alone[task][1])
            one += alone[task][0].handleInputRows((task,), iter([r for r in wave if r["task_id"] == task]), clock)
        cut = len(wave) // 2
        many += bucket.handleInputRows((3,), iter([_frame(wave[:cut]), _frame(wave[cut:])]), clock) if wave else []
        for task, (monitor, handle) in alone.items():
            one += _fire(monitor, handle, (task,), clock)
        many += _fire(bucket, store, (3,), clock)
        yield sorted(map(tuple, one)), sorted(r for frame in many for r in frame.itertuples(index=False, name=None))
    assert not store.values and not store.timers


def test_buckets_give_what_tasks_alone_give():
    seen = Counter()
    for seed in range(60):
        rng = random.Random(seed)
        waves, at = [], 0
        for _ in range(12):
            wave = []
            for _ in range(rng.randrange(0, 25)):
                task, kind = rng.randrange(8), rng.choice(["task", "arrival", "arrival", "end"])
                sec = rng.choice([float("nan"), rng.randrange(0, 120) / 2]) if rng.random() < 0.2 else rng.randrange(0, 120) / 2
                wave.append({"task_id": task, "kind": kind, "event_sec": sec, "deadline_sec": sec if kind == "task" else None})
            waves.append((at, wave))
            at += rng.choice([0, 1, 4000, 20_000])
        waves += [(10**6, []), (10**7, [])]
        for one, many in _run(waves, rng.choice([5.0, 30.0])):
            assert one == many
            seen.update(outcome for _, outcome, _ in one)
    assert set(seen) == {*deadlines.OUTCOMES, *deadlines.SIDE}


def test_calls_do_not_grow_with_tasks():
    """A batch and the closing of a bucket's tasks cost as many calls for 5,000 tasks as for 5."""
    calls = []
    for n in (5, 5000):
        bucket, store = deadlines._Deadlines(100.0), Handle()
        bucket.init(store)
        frame = pd.DataFrame({"task_id": np.arange(n), "code": deadlines.TASK, "sec": np.arange(n) % 7 + 10.0})
        assert not list(bucket.handleInputRows((0,), iter([frame]), Watermark(0)))
        out = pd.concat(_fire(bucket, store, (0,), Watermark(50_000)))
        assert len(out) == n and set(out["outcome"]) == {"censored"}
        calls.append(dict(store.calls))
    assert calls[0] == calls[1]


def test_both_ways_run_as_streams(spark):
    from tests.test_sources_streams import _monitored

    waves = [
        [(1, "task", 1000, 1100), (2, "task", 1000, 1100), (5, "arrival", 1000, None), (None, "arrival", 1000, None)],
        [(6, "task", 2000, 2100)],
        [(1, "arrival", 1090, None), (2, "arrival", 1500, None), (6, "arrival", 2050, None)],
    ]
    got = []
    for buckets in (1, 7, None):
        rows, left = _monitored(spark, [*waves, deadlines.end_of_log(spark, 50_000.0)], retention_sec=3000.0, buckets=buckets)
        assert left == 0
        got.append(rows)
    assert got[0] == got[1] == got[2] and len(got[0]) == 6
