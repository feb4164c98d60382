"""Earliest arrival over blocks of nodes and cells of time: results of odd messages, and what is shuffled."""

import random
import re

import pytest

from tallyfield.operators import contacts

PLAN = "node_i long, node_j long, start_sec double, end_sec double, rate double"
TASKS = "task_id long, source long, created_sec double, cutoff_sec double, size double"


def _loop(plan, tasks, max_hops):
    """{(task, node): (arrival, hops)}; a message may use the limits of every row with its id."""
    both = [(a, b, s, e, r) for i, j, s, e, r in plan if None not in (i, j, s, e, r) for a, b in ((i, j), (j, i))]
    best = {}
    for task, source, created, _, _ in tasks:
        best[task, source] = min(best.get((task, source), (created, 0)), (created, 0))
    for hop in range(1, max_hops + 1):
        moved = {}
        for (task, node), (at, _) in best.items():
            for cutoff, size in {(c, z) for t, _, _, c, z in tasks if t is not None and t == task and None not in (c, z)}:
                for a, b, start, end, rate in both:
                    if a == node and end >= at and at <= cutoff:
                        there = max(at, start) + size / rate
                        if there <= end and there <= cutoff:
                            moved[task, b] = min(moved.get((task, b), (there, hop)), (there, hop))
        for key, value in moved.items():
            best[key] = min(best.get(key, value), value)
    return best


def _rows(out):
    rows = [tuple(r) for r in out.select("task_id", "node_id", "arrival_sec", "hops").collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return {r[:2]: (pytest.approx(r[2]), r[3]) for r in rows}


def test_odd_messages_and_contacts(spark):
    """Several blocks, lives of a second to ten days, contacts longer than any life, repeated and missing rows."""
    rng = random.Random(4)
    nodes = [60, 61, 63, 64, 66, 127, 128, 129, -3]
    plan = []
    for _ in range(220):
        a, b = rng.sample(nodes, 2)
        start = rng.uniform(-50_000, 900_000)
        plan.append((a, b, start, start + rng.choice([0.0, 900.0, 40_000.0, 3e6]), rng.choice([1.0, 2.0, 5.0])))
    plan += [plan[0], plan[1], (None, 60, 0.0, 9e5, 1.0), (60, 61, None, 9e5, 1.0), (60, 61, 0.0, None, 1.0), (60, 61, 0.0, 9e5, None), (60, 61, 9.0, 1.0, 1.0)]
    tasks = [(t, rng.choice(nodes), c, c + rng.choice([1.0, 600.0, 30_000.0, 860_000.0]), rng.choice([0.0, 0.5, 300.0]))
             for t in range(60) for c in [rng.uniform(0, 800_000)]]
    tasks += [(100, None, 5.0, 9e5, 1.0), (None, 60, 5.0, 9e5, 1.0), (101, 60, 5.0, None, 1.0), (102, 60, 5.0, 9e5, None), (103, 60, 9.0, 5.0, 1.0), (104, 999, 5.0, 9e5, 1.0)]
    tasks += [(105, 60, 5.0, 2e5, 300.0), (105, 64, 9.0, 9e5, 1.0), (106, 61, 5.0, 9e5, 1.0), (106, 61, 5.0, 9e5, 1.0)]
    for hops in (1, 3, 4):
        got = _rows(contacts.earliest_arrival(spark.createDataFrame(plan, PLAN), spark.createDataFrame(tasks, TASKS), hops))
        want = _loop(plan, tasks, hops)
        assert got.keys() == want.keys() and all(got[k] == v for k, v in want.items())
    assert {h for _, h in want.values()} >= {0, 1, 2, 3}


def test_a_message_is_not_shuffled_within_its_block(spark):
    """A hop deals out what leaves its block only: no step deals out by task, and arrivals of a block's own nodes stay where they are."""
    plan = spark.range(2000).selectExpr("id % 60 as node_i", "(id + 1) % 60 as node_j", "id * 40D as start_sec", "id * 40D + 3000 as end_sec", "2D as rate")
    tasks = spark.range(500).selectExpr("id as task_id", "id % 60 as source", "id * 100D as created_sec", "id * 100D + 20000 as cutoff_sec", "3D as size")
    out = contacts.earliest_arrival(plan, tasks, 3)
    rows = out.collect()
    assert max(r["hops"] for r in rows) == 3 and len(rows) > 1500
    made = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", made)
    assert dealt and all("task_id" not in d or "source" in d for d in dealt)
    assert all(re.match(r"block#\w+, cell#\w+, \d+$", d) for d in dealt if "source" not in d)
