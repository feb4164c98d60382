"""The deadline monitor's work per task: plain rows, and few calls to the state store."""

from collections import Counter

from pyspark.sql import Row

from tallyfield.streaming import deadlines


class Store:
    """Counts the calls of one key's state."""

    def __init__(self):
        self.calls, self.value, self.items = Counter(), {}, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getListState(self, name, schema):  # noqa: N802
        return Waiting(self)

    def registerTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1

    def exists(self):
        self.calls["exists"] += 1
        return "task" in self.value

    def get(self):
        self.calls["get"] += 1
        return self.value.get("task")

    def update(self, value):
        self.calls["update"] += 1
        self.value["task"] = value


class Waiting:
    def __init__(self, store):
        self.store = store

    def get(self):
        self.store.calls["waiting"] += 1
        return iter(self.store.items)

    def clear(self):
        self.store.calls["waiting"] += 1


class Watermark:
    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def test_a_new_task_costs_three_calls_and_a_repeated_one_none_to_write():
    store = Store()
    monitor = deadlines._Deadline(100.0)
    monitor.init(store)
    rows = [
        Row(task_id=1, kind="arrival", event_sec=7.0, deadline_sec=None),
        Row(task_id=1, kind="task", event_sec=1.0, deadline_sec=9.0),
        Row(task_id=1, kind="task", event_sec=1.0, deadline_sec=float("nan")),
        Row(task_id=1, kind="arrival", event_sec=11.0, deadline_sec=None),
    ]
    assert [tuple(r) for r in monitor.handleInputRows((1,), iter(rows), Watermark())] == [(1, "late", 11.0)]
    assert store.value["task"] == (9.0, False, 7.0)
    assert store.calls == {"get": 1, "timer": 1, "update": 1}
    assert not list(monitor.handleInputRows((1,), iter(rows[:2]), Watermark()))
    assert store.calls == {"get": 2, "timer": 1, "update": 1}
