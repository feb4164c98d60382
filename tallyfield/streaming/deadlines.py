"""Deadline monitor: an outcome per task, every arrival accounted for, state that ends.

The input carries its own time, and rows may come in any order. A row behind the watermark is usually dropped before it
reaches a stateful operator. Here the watermark comes from a second branch of the same log, one row per task and batch
holding the newest time it has seen; the rows themselves carry a time in the far future, so none is ever behind. The
query's watermark is the smaller of both, which is the log's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

INPUT = "task_id long, kind string, event_ts timestamp, event_sec double, deadline_sec double"
OUTPUT = "task_id long, outcome string, at_sec double"
STATE = "deadline double, closed boolean, seen double"
#: Outcomes of tasks, one each, and the side output: arrivals after the deadline, arrivals in time that came after the task was closed
#: without one, and arrivals whose task is not known (never opened, or closed for longer than the retention).
OUTCOMES, SIDE = ("event", "censored"), ("late", "revised", "orphan")
#: The key of rows that only carry the time; rows without a task go there too and are ignored.
CLOCK = -(1 << 63)
_FAR = "timestamp'2262-01-01 00:00:00'"


def _given(seconds: float | None) -> bool:
    return seconds is not None and not math.isnan(seconds)


class _Deadline(StatefulProcessor):
    """State per task: its deadline, whether it is closed, the newest time seen, and arrivals that still wait for a decision.

    A task closes when the watermark passes its deadline: with the earliest arrival in time, or censored. Until its task is known an
    arrival waits. Everything about a task is dropped when the watermark is ``retention`` seconds past its deadline, or past
    the newest arrival if it was never opened; those arrivals are then given out as orphans.
    """

    def __init__(self, retention: float) -> None:
        self.retention = retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", STATE)
        self.waiting = handle.getListState("waiting", "at double")

    def _rows(self, key, rows: list[tuple[str, float]]) -> Iterator[Row]:
        return (Row(task_id=key[0], outcome=outcome, at_sec=at) for outcome, at in rows)

    def _alarm(self, at: float, timerValues) -> None:
        # A timer at or before the watermark would not fire again, so it is set just after it.
        self.handle.registerTimer(max(math.ceil(at * 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] == CLOCK:
            return
        kept = self.task.get()
        deadline, closed, seen = kept or (None, False, None)
        known, before = deadline, closed
        arrived: list[float] = []
        for row in rows:
            if row["kind"] == "task" and _given(row["deadline_sec"]) and not closed:
                deadline = row["deadline_sec"] if deadline is None else min(deadline, row["deadline_sec"])
            elif row["kind"] == "arrival" and _given(row["event_sec"]):
                arrived.append(row["event_sec"])
        out: list[tuple[str, float]] = []
        if deadline is None:
            if arrived:
                self.waiting.appendList([(t,) for t in arrived])
                newest = max([*arrived, *([seen] if seen is not None else [])])
                if newest != seen:
                    self._alarm(newest + self.retention, timerValues)
                self.task.update((None, False, newest))
            return
        if known is None and kept:
            arrived += [row[0] for row in self.waiting.get()]
            self.waiting.clear()
        if deadline != known:
            self._alarm(deadline, timerValues)
        if before:
            out += [("late" if t > deadline else "revised", t) for t in sorted(arrived)]
        else:
            out += [("late", t) for t in sorted(arrived) if t > deadline]
            in_time = [t for t in arrived if t <= deadline]
            seen = min([*in_time, *([seen] if known is not None and seen is not None else [])], default=None)
        if (deadline, closed, seen) != kept:
            self.task.update((deadline, closed, seen))
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.task.get()
        if not kept:
            return
        deadline, closed, seen = kept
        now = timerValues.getCurrentWatermarkInMs() / 1000
        out: list[tuple[str, float]] = []
        if deadline is None:
            if seen is not None and now >= seen + self.retention:
                out = [("orphan", row[0]) for row in self.waiting.get()]
                self.waiting.clear()
                self.task.clear()
        else:
            if not closed and now >= deadline:
                out = [("event", seen)] if seen is not None else [("censored", deadline)]
                closed = True
                self.task.update((deadline, closed, seen))
            if now >= deadline + self.retention:
                self.task.clear()
            elif closed:
                self._alarm(deadline + self.retention, timerValues)
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


#: One task of a bucket's state: like :class:`_Deadline`'s, with the time in ms when it is looked at next; NaN for what is not known.
PACKED = np.dtype([("task", "i8"), ("deadline", "f8"), ("closed", "?"), ("seen", "f8"), ("alarm", "i8")])
WAITING = np.dtype([("task", "i8"), ("at", "f8")])
NEVER = (1 << 63) - 1
#: Buckets of tasks, fixed for the life of a checkpoint.
BUCKETS = 1024
TASK, ARRIVAL = 1, 2


class _Deadlines(StatefulProcessor):
    """The rules of :class:`_Deadline` for a bucket of tasks at once, in columns.

    State and timer are one per bucket, so a batch costs a few calls per bucket and not per task. The timer is that of the task
    that is due first; each task keeps its own ``alarm``, and only those that are due are looked at.
    """

    def __init__(self, retention: float) -> None:
        self.retention = retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("bucket", "tasks binary, waiting binary, timer long")

    def _load(self) -> tuple[np.ndarray, np.ndarray, int]:
        kept = self.kept.get()
        if not kept:
            return np.empty(0, PACKED), np.empty(0, WAITING), NEVER
        return np.frombuffer(kept[0], PACKED).copy(), np.frombuffer(kept[1], WAITING), kept[2]

    def _save(self, tasks: np.ndarray, waiting: np.ndarray, timer: int) -> None:
        """Keep the bucket, with a timer for what is due first; ``timer`` is the one that is still to fire."""
        if not len(tasks):
            self.kept.clear()
            if timer != NEVER:
                self.handle.deleteTimer(timer)
            return
        due = int(tasks["alarm"].min())
        if due < timer:
            if timer != NEVER:
                self.handle.deleteTimer(timer)
            if due != NEVER:
                self.handle.registerTimer(due)
            timer = due
        self.kept.update((tasks.tobytes(), waiting.tobytes(), timer))

    @staticmethod
    def _alarms(at: np.ndarray, watermark: int) -> np.ndarray:
        # A timer at or before the watermark would not fire again, so it is set just after it.
        ms = np.ceil(at * 1000)
        return np.where(ms < 2.0**62, np.maximum(np.minimum(ms, 2.0**62), watermark + 1).astype("i8"), NEVER)

    @staticmethod
    def _out(parts: list[tuple[np.ndarray, str, np.ndarray]]) -> Iterator[pd.DataFrame]:
        for task, outcome, at in parts:
            if len(task):
                yield pd.DataFrame({"task_id": task, "outcome": outcome, "at_sec": at})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            return
        frames = [(f["task_id"].to_numpy("i8"), f["code"].to_numpy("i8"), f["sec"].to_numpy("f8")) for f in rows]
        task, code, sec = (np.concatenate(c) for c in zip(*frames))
        given = ~np.isnan(sec) & (code > 0)
        if not given.any():
            return
        task, code, sec = task[given], code[given], sec[given]
        watermark = timerValues.getCurrentWatermarkInMs()
        held, waiting, timer = self._load()
        ids = np.union1d(held["task"], task)
        tasks = np.empty(len(ids), PACKED)
        tasks["task"], tasks["deadline"], tasks["closed"], tasks["seen"], tasks["alarm"] = ids, np.nan, False, np.nan, NEVER
        tasks[np.searchsorted(ids, held["task"])] = held
        known, closed = tasks["deadline"].copy(), tasks["closed"]
        place, opens = np.searchsorted(ids, task), code == TASK
        lowest = np.full(len(ids), np.inf)
        opened = np.zeros(len(ids), dtype=bool)
        opened[place[opens]] = True
        np.minimum.at(lowest, place[opens], sec[opens])
        deadline = np.where(opened & ~closed, np.fmin(known, lowest), known)
        unknown = np.isnan(deadline)
        tasks["deadline"] = deadline
        moved = ~unknown & ~(deadline == known)
        tasks["alarm"][moved] = np.minimum(tasks["alarm"][moved], self._alarms(deadline[moved], watermark))
        # Arrivals that waited for a task that is known now are judged like new ones.
        at_place, at = place[~opens], sec[~opens]
        waited = np.searchsorted(ids, waiting["task"])
        ready = ~unknown[waited]
        at_place, at = np.concatenate([at_place, waited[ready]]), np.concatenate([at, waiting["at"][ready]])
        lost = unknown[at_place]
        more = np.empty(int(lost.sum()), WAITING)
        more["task"], more["at"] = ids[at_place[lost]], at[lost]
        newest = np.where(np.isnan(tasks["seen"]), -np.inf, tasks["seen"])
        np.maximum.at(newest, at_place[lost], at[lost])
        later = unknown & (newest != tasks["seen"])
        tasks["alarm"][later] = np.minimum(tasks["alarm"][later], self._alarms(newest[later] + self.retention, watermark))
        at_place, at = at_place[~lost], at[~lost]
        late, shut = at > deadline[at_place], closed[at_place]
        first = np.where(np.isnan(known) | np.isnan(tasks["seen"]), np.inf, tasks["seen"])
        np.minimum.at(first, at_place[~late & ~shut], at[~late & ~shut])
        first[np.isposinf(first)] = np.nan
        tasks["seen"] = np.where(unknown, newest, np.where(closed, tasks["seen"], first))
        self._save(tasks, np.concatenate([waiting[~ready], more]), timer)
        yield from self._out([(ids[at_place[late]], "late", at[late]), (ids[at_place[~late & shut]], "revised", at[~late & shut])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tasks, waiting, timer = self._load()
        if not len(tasks):
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        now = watermark / 1000
        due, unknown, seen = tasks["alarm"] <= watermark, np.isnan(tasks["deadline"]), tasks["seen"].copy()
        ends = np.where(unknown, seen, tasks["deadline"]) + self.retention
        close = due & ~unknown & ~tasks["closed"] & (now >= tasks["deadline"])
        tasks["closed"] |= close
        over = due & (now >= ends)
        again = np.where(unknown | tasks["closed"], ends, tasks["deadline"])[due]
        tasks["alarm"][due] = self._alarms(again, watermark)
        orphan = np.isin(waiting["task"], tasks["task"][over & unknown])
        event, censored = close & ~np.isnan(seen), close & np.isnan(seen)
        out = [(tasks["task"][event], "event", seen[event]), (tasks["task"][censored], "censored", tasks["deadline"][censored]),
               (waiting["task"][orphan], "orphan", waiting["at"][orphan])]
        self._save(tasks[~over], waiting[~orphan], NEVER if timer <= watermark else timer)
        yield from self._out(out)

    def close(self) -> None:
        pass


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    newest = None
    for batch in batches:
        at = pc.max(batch.column(0)).as_py()
        if at is not None:
            newest = at if newest is None else max(newest, at)
    if newest is not None:
        yield pa.RecordBatch.from_pydict({"at": pa.array([newest], pa.int64())})


def deadline_monitor(log: DataFrame, lateness: str = "0 seconds", retention_sec: float = 30 * 86400.0, buckets: int | None = BUCKETS) -> DataFrame:
    """Outcomes of a stream of ``task_id, kind ('task', 'arrival' or 'end'), event_ts, event_sec, deadline_sec``.

    Every opened task has one outcome when the watermark passes its deadline: ``event`` with its earliest arrival in time, or
    ``censored``. Every arrival that is no such event's cause and lies after the deadline is ``late``. ``lateness`` is how far behind the newest row an arrival in
    time may come and still be its task's outcome; a slower one is given out as ``revised``. Nothing is dropped: rows
    behind the watermark are judged like others as long as their task is kept, ``retention_sec`` past its deadline, and are ``orphan`` after that.
    A row of kind ``end`` moves the watermark only (see :func:`end_of_log`). Needs the RocksDB state store.

    Tasks are dealt out to ``buckets``, each with one packed state: for logs that come in large batches, since a batch writes anew the state of
    every bucket it touches. With None each task has a state of its own: for logs that trickle. A checkpoint is bound to its choice.
    """
    # A closing row goes through both branches: a branch without any row would hold the watermark back after a restart.
    clock = log.selectExpr("unix_micros(event_ts) as at").mapInArrow(_newest, "at long").selectExpr("timestamp_micros(at) as clock_ts").withWatermark("clock_ts", lateness)
    if buckets is None:
        columns = {"task_id": "long", "kind": "string", "event_sec": "double", "deadline_sec": "double"}
        rows = log.select(F.coalesce("task_id", F.lit(CLOCK)).alias("task_id"), *list(columns)[1:], F.expr(_FAR).alias("clock_ts"))
        key, empty = "task_id", {"task_id": CLOCK}
    else:
        columns = {"bucket": "long", "task_id": "long", "code": "int", "sec": "double"}
        rows = log.selectExpr(
            f"if(task_id is null, -1L, pmod(xxhash64(task_id), {buckets}L)) as bucket", f"coalesce(task_id, {CLOCK + 1}L) as task_id",
            f"case kind when 'task' then {TASK} when 'arrival' then {ARRIVAL} else 0 end as code",
            "case kind when 'task' then deadline_sec when 'arrival' then event_sec end as sec", f"{_FAR} as clock_ts")
        key, empty = "bucket", {"bucket": -1, "task_id": CLOCK, "code": 0}
    ticks = clock.select(*[F.lit(empty.get(c)).cast(t).alias(c) for c, t in columns.items()], "clock_ts")
    grouped = rows.withWatermark("clock_ts", "0 seconds").unionByName(ticks).groupBy(key)
    options = {"outputStructType": OUTPUT, "outputMode": "Append", "timeMode": "EventTime"}
    if buckets is None:
        return grouped.transformWithState(statefulProcessor=_Deadline(retention_sec), **options)
    return grouped.transformWithStateInPandas(statefulProcessor=_Deadlines(retention_sec), **options)


def end_of_log(spark: SparkSession, at_sec: float) -> DataFrame:
    """One row that moves the watermark past every deadline and retention before ``at_sec``: appended to a finished log, it closes what is still open."""
    return spark.range(1).selectExpr(
        "cast(null as long) as task_id", "'end' as kind", f"timestamp_micros(cast({at_sec!r}D * 1000000 as long)) as event_ts", f"{at_sec!r}D as event_sec", "cast(null as double) as deadline_sec")


def deadline_outcomes(log: DataFrame) -> DataFrame:
    """The same outcomes from a finished table: the batch twin used to check the stream."""
    tasks = log.filter("kind = 'task'").groupBy("task_id").agg({"deadline_sec": "min"}).toDF("task_id", "deadline_sec")
    arrivals = log.filter("kind = 'arrival'").select("task_id", "event_sec")
    first = arrivals.groupBy("task_id").agg({"event_sec": "min"}).toDF("task_id", "first_sec")
    closed = tasks.join(first, "task_id", "left").selectExpr(
        "task_id", "if(coalesce(first_sec <= deadline_sec, false), 'event', 'censored') as outcome",
        "if(coalesce(first_sec <= deadline_sec, false), first_sec, deadline_sec) as at_sec",
    )
    late = arrivals.join(tasks, "task_id").filter("event_sec > deadline_sec").selectExpr("task_id", "'late' as outcome", "event_sec as at_sec")
    return closed.unionByName(late)
