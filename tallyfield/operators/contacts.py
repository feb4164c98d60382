"""Contact plans: earliest arrival, perturbed plans and audits of transfer logs."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.joins import cut_out, drop_failed_endpoints, topology_filter
from tallyfield.operators.ordered import attach
from tallyfield.operators.resample import sample_fraction
from tallyfield.operators.skyline import two_objective_front
from tallyfield.operators.topk import targeted_nodes
from tallyfield.functions.tables import check_counts
from tallyfield.session import pinned, scratch_path


LEVELS = 14  # dyadic levels of the time index


def _point_cells(at: str, top: int = LEVELS) -> str:
    """SQL array of the dyadic cells (level, number) that hold leaf ``at``, one a level up to ``top``."""
    return f"transform(sequence(0, {top}), l -> named_struct('level', l, 'cell', shiftright({at}, l)))"


def _cover_cells(lo: str, hi: str) -> str:
    """SQL array of disjoint dyadic cells that make up the leaves ``lo`` to ``hi``: at most two a level below the top.

    At level l the range still open begins at ceil(lo / 2^l) and ends before floor((hi + 1) / 2^l); an odd first
    cell or an odd end stands alone at this level. The top level takes what is left.
    """
    first, last = f"-shiftright(-({lo}), l)", f"shiftright({hi} + 1, l)"
    below = (f"filter(array(if({first} < {last} and {first} & 1L = 1L, {first}, null), "
             f"if({first} < {last} and {last} & 1L = 1L, {last} - 1, null)), c -> c is not null)")
    top_first, top_last = first.replace(", l)", f", {LEVELS})"), last.replace(", l)", f", {LEVELS})")
    top = f"if({top_first} < {top_last}, transform(sequence({top_first}, {top_last} - 1), c -> named_struct('level', {LEVELS}, 'cell', c)), array())"
    return (f"if({hi} < {lo}, array(), concat(flatten(transform(sequence(0, {LEVELS - 1}), l -> "
            f"transform({below}, c -> named_struct('level', l, 'cell', c)))), {top}))")


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], leaf: float) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals overlap in leaves of ``leaf`` seconds, each once.

    Two intervals overlap if the first begins in the second, or the second begins after the first's
    beginning and in it. Each case is a point in an interval: the point is looked up by the cells that hold it, the
    interval by the cells that make it up, which share exactly one cell. So a row is stored O(log) times, however
    long its interval. ``right`` should be pinned: its longest interval is looked up first. Other columns of the two sides must differ; callers keep the exact overlap.
    """
    leaf_of = lambda c: f"cast(floor({c} / {float(leaf)}D) as long)"
    spans = lambda df, span: df.selectExpr("*", f"{leaf_of(span[0])} as _lo", f"{leaf_of(span[1])} as _hi")
    a, b = spans(left, left_span), spans(right, right_span)
    at = lambda df, top=LEVELS: df.selectExpr("*", f"inline({_point_cells('_lo', top)})").drop("_lo", "_hi")
    cover = lambda df, lo: df.selectExpr("*", f"inline({_cover_cells(lo, '_hi')})").drop("_lo", "_hi")
    on = [*keys, "level", "cell"]
    # A row whose end lies before its beginning overlaps nothing.
    a, b = a.filter("_lo <= _hi"), b.filter("_lo <= _hi")
    # An interval is made up of cells no longer than itself, so points need no copy on levels above the longest one's.
    longest = b.agg(F.expr("max(_hi - _lo + 1)")).first()[0] or 1
    begun = at(a, min(LEVELS, int(longest).bit_length() - 1)).join(cover(b, "_lo"), on)
    later = cover(a, "(_lo + 1)").join(at(b), on)
    return begun.unionByName(later).drop("level", "cell")


def useful_contacts(contacts: DataFrame) -> DataFrame:
    """Contacts in both directions (a, b, start_sec, end_sec, rate), without those that another contact of the same
    pair and rate covers: they can never carry anything earlier."""
    both = contacts.selectExpr(
        "inline(array(named_struct('a', node_i, 'b', node_j), named_struct('a', node_j, 'b', node_i)))", "start_sec", "end_sec", "rate")
    pair = ["a", "b", "rate"]
    front = two_objective_front(both.distinct(), pair, ["end_sec"], ["start_sec"])
    return front.filter("is_front").drop("is_front")


#: Node numbers of one block: contacts mostly link near numbers, so that most hops stay in their block and need no shuffle.
BLOCK = 64
#: Messages of one task, hops planned at once, and how many cells of the next finer level of time make up one.
MESSAGES_A_TASK, HOPS_AT_ONCE, FINER = 20_000, 3, 16.0


def _block(df: DataFrame, node: str) -> str:
    """SQL: the block of a node, never null; whole numbers share one with their neighbours, others are dealt out."""
    whole = df.schema[node].dataType.typeName() in ("byte", "short", "integer", "long")
    return f"coalesce({node} div {BLOCK}L, 0L)" if whole else f"xxhash64({node})"


def _double(x: float) -> str:
    return f"double('{x!r}')"


def _dealt(contacts: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(messages, index, parts): both dealt out by (block, cell) of a grid of nodes and time.

    A message keeps its cell of time for life: the cells of its level are no shorter than its life, so it lives in its cell
    and the next. A contact is stored under every cell whose messages may meet it: two, and one more per length of
    a cell; cells are no shorter than a contact is on average. ``index`` has one row per (block, cell, first node).
    """
    both = contacts.selectExpr(
        "inline(array(named_struct('a', node_i, 'b', node_j), named_struct('a', node_j, 'b', node_i)))", "start_sec", "end_sec", "rate"
    ).filter("a is not null and end_sec >= start_sec and not isnan(end_sec)")
    over = both.agg(F.expr("max(end_sec)")).first()[0]
    until = f"least(cutoff_sec, {_double(float(over))})" if over is not None else "created_sec"
    life = f"greatest({until} - created_sec, 0.001D)"
    n_tasks, first, last, longest = tasks.selectExpr("created_sec", f"{until} as until", f"{life} as life").agg(
        F.expr("count(*)"), F.expr("min(created_sec)"), F.expr("max(until)"), F.expr("max(life)")).first()
    low, high = _double(float(first or 0.0)), _double(float(last or 0.0))
    met = both.filter(f"end_sec >= {low} and start_sec <= {high}")
    begin, end = f"greatest(start_sec, {low})", f"least(end_sec, {high})"
    mean = met.agg(F.expr(f"avg({end} - {begin})")).first()[0] or 0.0
    width = max(float(longest or 1.0), mean)
    finest = min(4, int(math.log(width / mean, FINER))) if mean and math.isfinite(width) else 0
    level = f"cast(least({finest}D, floor(greatest(0D, log({FINER}D, {_double(width)} / {life}) - 1e-9D))) as int)"
    levels = [r[0] for r in tasks.select(F.expr(level).alias("l")).distinct().collect()]
    # One number holds the cell and, in its last bits, the level.
    cell = lambda at, l: f"floor({at} / ({_double(width)} / power({FINER}D, {l})))"
    parts = max(int(contacts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_tasks // MESSAGES_A_TASK))
    messages = tasks.selectExpr("*", f"{level} as _level").selectExpr(
        f"{_block(tasks, 'source')} as block", f"coalesce({cell('created_sec', '_level')} * 8 + _level, 0L) as cell",
        "task_id", "source as node_id", "cutoff_sec", "size", "created_sec as arrival_sec", "0 as hops")
    cells = ", ".join(f"transform(sequence({cell(begin, l)} - 1, {cell(end, l)}), c -> c * 8 + {l})" for l in levels or [0])
    index = met.selectExpr(
        f"{_block(met, 'a')} as block", f"explode(concat({cells})) as cell", "a", "struct(b, start_sec, end_sec, rate) as open")
    # Equal contacts count once. Every hop reads the lists several times, so they are made once; a Parquet file is smaller than a checkpoint.
    index = index.repartition(parts, "block", "cell").groupBy("block", "cell", "a").agg(F.collect_set("open").alias("open"))
    path = scratch_path(contacts.sparkSession, "contacts")
    index.write.parquet(path)
    index = contacts.sparkSession.read.schema(index.schema).parquet(path).withColumns(
        {"block": F.expr("coalesce(block, 0L)"), "cell": F.expr("coalesce(cell, 0L)")})
    return messages.repartition(parts, "block", "cell"), index.repartition(parts, "block", "cell"), parts


def _hop(state: DataFrame, index: DataFrame, hop: int, parts: int) -> DataFrame:
    """``state`` after one more hop. It and the result are dealt out by (block, cell); only arrivals in another block are shuffled."""
    keys = ["block", "cell", "task_id", "node_id", "cutoff_sec", "size"]
    # Steps that are used several times are shuffled once if the planner sees them as equal: so nodes are known not to be null, and
    # the first hop, for which all messages wait, has no filter.
    waiting = state if hop == 1 else state.filter(f"hops = {hop - 1}")
    # The node is compared beside the join's keys: as one of them it would have both sides dealt out by node.
    met = waiting.join(index.hint("merge"), ["block", "cell"]).filter("a between node_id and node_id")
    moved = met.selectExpr("block", "cell", "task_id", "cutoff_sec", "size", "arrival_sec as since_sec", "inline(open)").selectExpr(
        "block", "cell", "task_id", "b as node_id", "cutoff_sec", "size", "since_sec", "end_sec",
        "greatest(since_sec, start_sec) + size / rate as arrival_sec",
    ).filter("node_id is not null and end_sec >= since_sec and arrival_sec <= end_sec and arrival_sec <= cutoff_sec").drop("since_sec", "end_sec")
    home = _block(moved, "node_id")
    here = moved.filter(f"block = {home}").withColumn("hops", F.lit(hop))
    away = moved.filter(f"block <> {home}").groupBy(*keys).agg(F.expr("min(arrival_sec) as arrival_sec"))
    away = away.selectExpr(f"{home} as block", *keys[1:], "arrival_sec", f"{hop} as hops").repartition(parts, "block", "cell")
    best = state.unionByName(here).unionByName(away).groupBy(*keys).agg(
        F.expr(f"min(arrival_sec) filter (where hops < {hop}) as known_sec"), F.expr(f"min(hops) as known_hops"),
        F.expr(f"min(arrival_sec) filter (where hops = {hop}) as new_sec"))
    better = "known_sec is null or new_sec < known_sec"
    return best.selectExpr(*keys, f"if({better}, new_sec, known_sec) as arrival_sec", f"if({better}, {hop}, known_hops) as hops")


def earliest_arrival(contacts: DataFrame, tasks: DataFrame, max_hops: int, leaf_sec: float = 900.0) -> DataFrame:
    """(task, node, arrival_sec, hops): time-respecting reachability over contacts in both directions.

    A hop leaves at max(arrival, start) and takes size / rate; it must end by the end of the contact
    and the cutoff. ``contacts``: node_i, node_j, start_sec, end_sec, rate. ``tasks``: task_id,
    source, created_sec, cutoff_sec, size. Contacts with a missing time or node, and tasks without one, carry nothing.

    Messages and contacts are dealt out once by blocks of nodes and cells of time (:func:`_dealt`); a hop shuffles only
    what leaves its block. At most ``max_hops`` rounds, or until nothing improves; only improved rows go on. The plan of a hop
    holds the one before three times, so the state is pinned after ``HOPS_AT_ONCE`` hops. Tasks whose id is
    not unique take the limits of all rows of that id; they go another way (:func:`_shared_arrival`).
    """
    contacts = contacts.filter("node_i is not null and node_j is not null")
    twice = tasks.groupBy("task_id").agg(F.expr("count(*) as n")).filter("n > 1 and task_id is not null").select("task_id")
    shared = None
    if not twice.isEmpty():
        shared = _shared_arrival(contacts, tasks.join(twice, "task_id", "left_semi"), max_hops, leaf_sec)
        tasks = tasks.join(twice, "task_id", "left_anti")
    moving = "coalesce(task_id is not null and source is not null and size is not null and created_sec <= cutoff_sec, false)"
    going = tasks.filter("task_id is not null and source is not null and size is not null and cutoff_sec is not null and created_sec <= cutoff_sec")
    still = tasks.filter(f"not {moving}").groupBy("task_id", "source").agg(F.expr("min(created_sec) as arrival_sec")).selectExpr(
        "task_id", "source as node_id", "arrival_sec", "0 as hops")
    state, index, parts = _dealt(contacts, going)
    for hop in range(1, max_hops + 1):
        state = _hop(state, index, hop, parts)
        if hop % HOPS_AT_ONCE == 0 and hop < max_hops:
            state = pinned(state).repartition(parts, "block", "cell")
            if state.filter(f"hops = {hop}").isEmpty():
                break
    out = state.select("task_id", "node_id", "arrival_sec", "hops").unionByName(still)
    return out if shared is None else out.unionByName(shared)


def _shared_arrival(contacts: DataFrame, tasks: DataFrame, max_hops: int, leaf_sec: float) -> DataFrame:
    """The same for tasks of which several rows share an id, so that each row's message may use the cutoff and size of any.

    Waiting tasks meet the contacts open between arrival and cutoff through a dyadic index of time
    (:func:`overlaps`), so neither long waits nor long contacts multiply rows. The state is pinned every round.
    """
    plan = pinned(useful_contacts(contacts.filter("end_sec >= start_sec")))
    limits = tasks.select("task_id", "cutoff_sec", "size")
    state = tasks.selectExpr("task_id", "source as node_id", "created_sec as arrival_sec", "0 as hops").groupBy("task_id", "node_id").agg(
        F.expr("min(arrival_sec) as arrival_sec"), F.expr("min(hops) as hops"))
    frontier = state
    for hop in range(1, max_hops + 1):
        waiting = frontier.join(limits, "task_id").filter("arrival_sec <= cutoff_sec").selectExpr(
            "task_id", "node_id as a", "arrival_sec", "cutoff_sec", "size")
        met = overlaps(waiting, plan, ["a"], ("arrival_sec", "cutoff_sec"), ("start_sec", "end_sec"), leaf_sec)
        moved = met.selectExpr(
            "task_id", "b as node_id", "greatest(arrival_sec, start_sec) + size / rate as arrival_sec", "end_sec", "cutoff_sec"
        ).filter("arrival_sec <= end_sec and arrival_sec <= cutoff_sec")
        best = moved.groupBy("task_id", "node_id").agg(F.expr("min(arrival_sec) as arrival_sec"), F.lit(hop).alias("hops"))
        known = state.selectExpr("task_id", "node_id", "arrival_sec as known_sec")
        frontier = pinned(
            best.join(known, ["task_id", "node_id"], "left").filter("known_sec is null or arrival_sec < known_sec").drop("known_sec")
        )
        if frontier.isEmpty():
            break
        merged = state.unionByName(frontier).groupBy("task_id", "node_id").agg(F.expr("min(struct(arrival_sec, hops)) as m"))
        state = pinned(merged.selectExpr("task_id", "node_id", "m.arrival_sec as arrival_sec", "m.hops as hops"))
    return state


def perturb(windows: DataFrame, nodes: DataFrame, scenario: Mapping[str, object], seed: str) -> tuple[DataFrame, DataFrame]:
    """A contact plan under one scenario: (windows, report).

    ``scenario``: topology, failure_type, failure_level_percent, capacity_factor, outage_start,
    outage_end. The report has the rows before and after, how many were removed or cut, and whether
    the scenario applies at all (failures of central nodes need central nodes).
    """
    level = float(scenario.get("failure_level_percent", 0.0))
    kind = str(scenario.get("failure_type", "none"))
    central = nodes.filter("is_central").select("node_id")
    base = topology_filter(windows, central, str(scenario.get("topology", "central_only")))
    out, cut = base, None
    if kind == "random_satellite_failure":
        out = drop_failed_endpoints(base, sample_fraction(nodes, [], "node_id", level, seed))
    elif kind == "random_cn_failure":
        out = drop_failed_endpoints(base, sample_fraction(central, [], "node_id", level, seed))
    elif kind == "targeted_cn_failure":
        out = drop_failed_endpoints(base, targeted_nodes(base, nodes, [], level).select("node_id"))
    elif kind == "link_window_outage":
        lost = sample_fraction(base, [], "window_id", level, seed)
        out = base.join(lost, "window_id", "left_anti").select(*base.columns)
    elif kind == "capacity_degradation":
        out = scale_capacity(base, float(scenario.get("capacity_factor", 1.0)))
    elif kind == "ground_station_outage":
        cut = f"{float(scenario['outage_start'])}D", f"{float(scenario['outage_end'])}D"
        lost = base.selectExpr("*", f"if(is_ground, {cut[0]}, null) as out_start", f"if(is_ground, {cut[1]}, null) as out_end")
        pieces = cut_out(lost, base.columns)
        out = pieces.select(*base.columns)
    elif kind != "none":
        raise ValueError(f"unknown failure {kind}")
    before = base.agg(F.expr("count(*) as windows_before"), F.expr(
        f"count_if(is_ground and start_sec < {cut[1]} and end_sec > {cut[0]}) as windows_cut" if cut else "0L as windows_cut"))
    after = out.agg(F.expr("count(*) as windows_after"))
    has = nodes.agg(F.expr("coalesce(bool_or(is_central), false) as has_central"))
    report = attach(attach(before, after, []), has, []).selectExpr(
        f"'{kind}' as failure_type", "windows_before", "windows_after", "greatest(0L, windows_before - windows_after) + windows_cut as removed",
        f"if('{kind}' in ('random_cn_failure', 'targeted_cn_failure') and not has_central, 'not_applicable_no_central_nodes', 'applicable') as applicability",
    )
    return out, report


def scale_capacity(windows: DataFrame, factor: float) -> DataFrame:
    """Every capacity and rate column times the factor; an unknown value counts as 0."""
    # The columns that carry a capacity or a rate.
    scaled = ("capacity_mbits", "window_capacity_mbits", "total_data_mbits", "data_rate_bps", "mean_data_rate_bps")
    return windows.selectExpr(*[f"coalesce({c}, 0D) * {float(factor)}D as {c}" if c in scaled else c for c in windows.columns])


def transfer_log_audit(transfers: DataFrame, windows: DataFrame, sources: DataFrame, max_hops: int, max_copies: int) -> DataFrame:
    """(check, violations, passed): volume within each window's capacity, transfer inside its window, sender
    had the task before, one reception per (task, node), hop limit, copies per task.

    ``transfers``: task_id, from_node, to_node, window_id, start_sec, end_sec, mbit, hop.
    ``sources``: task_id, node_id, since_sec (who has the task from the start).
    """
    used = transfers.groupBy("window_id").agg(F.expr("sum(mbit) as used"), F.expr("min(start_sec) as lo"), F.expr("max(end_sec) as hi"))
    plan = used.join(windows.selectExpr("window_id", "capacity_mbits", "start_sec as open_sec", "end_sec as close_sec"), "window_id", "left")
    window_checks = check_counts(plan, {
        "within_capacity": "coalesce(used > capacity_mbits + 1e-9, true)",
        "inside_window": "coalesce(lo < open_sec - 1e-9 or hi > close_sec + 1e-9, true)",
    })
    received = transfers.selectExpr("task_id", "to_node as node_id", "end_sec as since_sec").unionByName(sources)
    first = received.groupBy("task_id", "node_id").agg(F.expr("min(since_sec) as held_since"))
    senders = transfers.selectExpr("task_id", "from_node as node_id", "start_sec", "hop").join(first, ["task_id", "node_id"], "left")
    row_checks = check_counts(senders, {
        "sender_had_task": "coalesce(start_sec < held_since - 1e-9, true)", "hop_limit": f"hop > {max_hops}",
    })
    copies = transfers.groupBy("task_id", "to_node").agg(F.expr("count(*) as n"))
    once = check_counts(copies, {"one_reception": "n > 1"})
    spread = check_counts(copies.groupBy("task_id").agg(F.expr("count(*) as nodes")), {"copy_limit": f"nodes > {max_copies}"})
    return window_checks.unionByName(row_checks).unionByName(once).unionByName(spread)
