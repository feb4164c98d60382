"""Joins with checks: cardinality, pairing, membership, completeness, as-of, intervals and topology."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.scalars import DEADLINE_SLACK_SEC
from tallyfield.operators.ordered import attach, numbered


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def join_checked(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", cardinality: str = "many_to_one",
    quarantine: bool = False,
) -> DataFrame:
    """Equi-join that refuses a broken cardinality (``one_to_one`` or ``many_to_one``).

    The check reads only the key columns. With ``quarantine`` rows with an offending key are left
    out on the offending side instead of failing the job.
    """
    sides = {"one_to_one": ("left", "right"), "many_to_one": ("right",)}
    if cardinality not in sides:
        raise ValueError(f"unknown cardinality {cardinality}")
    frames = {"left": left, "right": right}
    for side in sides[cardinality]:
        repeated = duplicate_keys(frames[side].select(*keys), keys)
        if quarantine:
            frames[side] = frames[side].join(repeated, list(keys), "left_anti")
        elif not repeated.isEmpty():
            raise ValueError(f"{side} side is not unique on {list(keys)}")
    return frames["left"].join(frames["right"], list(keys), how)


def keep_members(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(members.select(*keys), list(keys), "left_semi")


def balanced_subset(
    df: DataFrame, base: Sequence[str], level: str, levels: Sequence | None = None,
    n_tasks: int | None = None, count_column: str = "n_tasks",
) -> DataFrame:
    """Rows of the bases that have every level: those listed, or as many as the whole table has."""
    kept = df if levels is None else df.filter(F.col(level).isin(*levels))
    if n_tasks is not None:
        kept = kept.filter(F.col(count_column) == n_tasks)
    have = kept.groupBy(*base).agg(F.count_distinct(level).alias("_have"))
    if levels is None:
        need = df.agg(F.count_distinct(level).alias("_need"))
        complete = attach(have, need, []).filter("_have = _need")
    else:
        complete = have.filter(F.col("_have") == len(set(levels)))
    return kept.join(complete.select(*base), list(base), "left_semi")


def paired_scenarios(
    df: DataFrame, keys: Sequence[str], scenario: str, reference: str, alternative: str, metrics: Sequence[str]
) -> DataFrame:
    """One row per key present in both scenarios: both values and ``delta`` = alternative - reference.

    One conditional aggregation over both scenarios, so the table is read and shuffled once.
    """
    wanted = df.filter(F.col(scenario).isin(reference, alternative))
    value = lambda m, s: F.expr(f"max(`{m}`) filter (where `{scenario}` = '{s}')")
    picks = [e for m in metrics for e in (value(m, reference).alias(f"reference_{m}"), value(m, alternative).alias(f"alternative_{m}"))]
    both = wanted.groupBy(*keys).agg(F.expr(f"count(distinct `{scenario}`) as _n"), *picks).filter("_n = 2").drop("_n")
    return both.selectExpr("*", *[f"alternative_{m} - reference_{m} as delta_{m}" for m in metrics])


def paired_regions(df: DataFrame, keys: Sequence[str], first: str, second: str, metrics: Sequence[str]) -> DataFrame:
    """Keys present in both regions, with ``delta`` = second - first."""
    out = paired_scenarios(df, keys, "region", first, second, metrics)
    for m in metrics:
        out = out.withColumnRenamed(f"reference_{m}", f"a_{m}").withColumnRenamed(f"alternative_{m}", f"b_{m}")
    return out


def matched_cross_fleet(
    a: DataFrame, b: DataFrame, keys: Sequence[str], metrics: Sequence[str], suffixes: tuple[str, str],
    expected: int | None = None,
) -> DataFrame:
    """Rows of two fleets with equal design columns, both values and their difference (second - first)."""
    sa, sb = suffixes
    left = a.select(*keys, *[F.col(m).alias(f"{m}_{sa}") for m in metrics])
    right = b.select(*keys, *[F.col(m).alias(f"{m}_{sb}") for m in metrics])
    out = left.join(right, list(keys)).selectExpr("*", *[f"{m}_{sb} - {m}_{sa} as delta_{m}" for m in metrics])
    if expected is not None and out.count() != expected:
        raise ValueError(f"expected {expected} matched rows")
    return out


def attach_baseline(df: DataFrame, baseline: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Left join of the baseline's metrics and ``delta`` = own - baseline. The planner picks the join."""
    side = baseline.select(*keys, *[F.col(m).alias(f"baseline_{m}") for m in metrics])
    return df.join(side, list(keys), "left").selectExpr("*", *[f"{m} - baseline_{m} as delta_{m}" for m in metrics])


def missing_combinations(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, problem): expected but absent, and present but not expected."""
    want, have = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    absent = want.join(have, list(keys), "left_anti").withColumn("problem", F.lit("missing"))
    extra = have.join(want, list(keys), "left_anti").withColumn("problem", F.lit("unexpected"))
    return absent.unionByName(extra)


def useful_recipients(
    opportunities: DataFrame, tasks: DataFrame, keys: Sequence[str] = ("task_id",), first_k: int | None = None
) -> DataFrame:
    """Distinct (task, node) whose first opportunity is not after the deadline, with that time.

    ``first_k`` keeps the k earliest nodes per task; the limit is applied before the shuffle too.
    """
    timely = opportunities.join(tasks.select(*keys, "deadline_sec"), list(keys)).filter("earliest_sec <= deadline_sec")
    best = timely.groupBy(*keys, "node_id").agg(F.min("earliest_sec").alias("earliest_sec"))
    if first_k is None:
        return best
    from tallyfield.operators.topk import top_n_per_group

    return top_n_per_group(best, keys, [F.col("earliest_sec"), F.col("node_id")], first_k)


def useful_arrivals(transfers: DataFrame, recipients: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Transfers that reached a useful recipient in time; ground nodes do not count."""
    timely = transfers.filter(f"not is_ground and end_sec <= deadline_sec + {DEADLINE_SLACK_SEC}")
    return keep_members(timely, recipients, [*keys, "node_id"])


def next_opportunity(receptions: DataFrame, opportunities: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Forward as-of join: per task, the earliest opportunity at a node that already has the task.

    ``receptions`` is unique per (task, node) and carries ``recv_sec`` and ``deadline_sec``, so the
    equi-join emits at most one row per opportunity and the minimum is combined before the shuffle.
    Ties on time go to the smaller node.
    """
    cell = [*keys, "node_id"]
    usable = receptions.filter("recv_sec <= deadline_sec").join(opportunities.select(*cell, "opportunity_sec"), cell)
    usable = usable.filter("opportunity_sec >= recv_sec and opportunity_sec <= deadline_sec")
    return usable.groupBy(*keys).agg(F.min(F.struct("opportunity_sec", "node_id", "recv_sec")).alias("_best")).selectExpr(
        *keys, "_best.opportunity_sec as observation_sec", "_best.node_id as observing_node", "_best.recv_sec as recv_sec"
    )


def interval_subtract(windows: DataFrame, outages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cut the outage of each key out of its windows; capacity is shared pro rata, empty pieces vanish.

    ``outages`` has at most one [out_start, out_end) per key. The parts of a cut window get the
    suffixes ``_pre`` and ``_post``; other windows pass unchanged.
    """
    return cut_out(windows.join(outages.select(*keys, "out_start", "out_end"), list(keys), "left"), windows.columns)


def cut_out(joined: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Windows without [out_start, out_end) of their own row (null: uncut), see :func:`interval_subtract`."""
    hit = "coalesce(start_sec < out_end and end_sec > out_start, false)"
    pieces = joined.selectExpr(
        "*",
        f"""inline(if({hit},
            array(named_struct('s', start_sec, 'e', least(end_sec, out_start), 'suffix', '_pre'),
                  named_struct('s', greatest(start_sec, out_end), 'e', end_sec, 'suffix', '_post')),
            array(named_struct('s', start_sec, 'e', end_sec, 'suffix', ''))))""",
    ).filter("suffix = '' or e > s")
    others = [c for c in columns if c not in {"window_id", "start_sec", "end_sec", "duration_sec", "capacity_mbits"}]
    return pieces.selectExpr(
        "concat(cast(window_id as string), suffix) as window_id", *others, "s as start_sec", "e as end_sec",
        "if(suffix = '', duration_sec, e - s) as duration_sec",
        "if(suffix = '', capacity_mbits, capacity_mbits * (e - s) / greatest(end_sec - start_sec, 1e-12)) as capacity_mbits",
        "suffix <> '' as was_cut",
    )


def drop_failed_endpoints(windows: DataFrame, failed: DataFrame, ends: Sequence[str] = ("node_i", "node_j")) -> DataFrame:
    """Windows (or opportunities, with one end) that touch no failed node."""
    out = windows
    for end in ends:
        out = out.join(failed.select(F.col("node_id").alias(end)), end, "left_anti")
    return out.select(*windows.columns)


def topology_filter(windows: DataFrame, central: DataFrame, topology: str) -> DataFrame:
    """``central_only`` keeps ground links and links with a central end; the other two keep all."""
    if topology in ("peer_only", "hybrid"):
        return windows
    if topology != "central_only":
        raise ValueError(f"unknown topology {topology}")
    flags = lambda end: central.select(F.col("node_id").alias(end), F.lit(True).alias(f"_{end}"))
    marked = windows.join(flags("node_i"), "node_i", "left").join(flags("node_j"), "node_j", "left")
    return marked.filter("is_ground or _node_i or _node_j").select(*windows.columns)


def candidate_pairs(nodes: DataFrame, mode: str, group: str, chunk: int = 1024) -> DataFrame:
    """Node pairs i < j inside each group that may link: none, all, or those with a central end.

    A group without any central node falls back to all pairs. ``central_only`` starts from the
    central nodes, so the many plain-plain pairs are never made. ``all`` is quadratic in the group by its result.

    Each group is dealt into chunks of about ``chunk`` nodes, and every pair of chunks meets under a key of its own: the
    upper triangle of chunks where all pairs are wanted, central chunks against all chunks else. So a
    hot group spreads over as many tasks as it has pairs of chunks.
    """
    if mode not in ("none", "all", "central_only"):
        raise ValueError(f"unknown mode {mode}")
    cells = nodes.selectExpr(group, "node_id", "coalesce(is_central, false) as is_central")
    if mode == "none":
        return cells.filter("false").selectExpr(group, "node_id as node_i", "node_id as node_j")
    central = "bool_or(is_central)" if mode == "central_only" else "false"
    sizes = cells.groupBy(group).agg(F.expr(f"{central} as _has"), F.expr("count_if(is_central) as _nc"), F.expr("count(*) as _n")).selectExpr(
        group, "_has", f"cast(ceil(if(_has, _nc, _n) / {chunk}) as int) as _left", f"cast(ceil(_n / {chunk}) as int) as _right")
    dealt = attach(cells, sizes, [group])
    spot = lambda n: f"cast(pmod(xxhash64(node_id), {n}) as int)"
    starts = dealt.filter("is_central or not _has").selectExpr(group, "node_id", "_has", "_right", f"{spot('_left')} as _i").selectExpr(
        group, "node_id", "_has", "_i", "explode(sequence(if(_has, 0, _i), _right - 1)) as _j")
    others = dealt.selectExpr(group, "node_id as _b", "is_central as _bc", "_has as _h", "_left", f"{spot('_right')} as _j").selectExpr(
        group, "_b", "_bc", "_j", "explode(sequence(0, if(_h, _left - 1, _j))) as _i")
    made = starts.join(others, [group, "_i", "_j"])
    # Each pair is made once: from its smaller end, its only central end, or the chunk that comes first.
    once = made.filter("if(_has, node_id < _b or (not _bc and node_id <> _b), _i < _j or node_id < _b)")
    return once.selectExpr(group, "least(node_id, _b) as node_i", "greatest(node_id, _b) as node_j")
