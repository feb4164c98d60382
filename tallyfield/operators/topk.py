"""Top rows, perfect cases, targeted nodes and shortlists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators.ordered import attach, numbered


def top_n(df: DataFrame, order: Sequence[Column], n: int = 30) -> DataFrame:
    """``order`` ends in a unique column so that the cut is the same on every run."""
    return df.orderBy(*order).limit(n)


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows of each group. The planner limits every map task to n rows per group before the
    shuffle, so a hot group costs n rows per task."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def perfect_cases(df: DataFrame, metrics: Sequence[str], order: Sequence[str], full: float = 100.0) -> DataFrame:
    """Rows with every metric at its full value, cheapest first."""
    test = " and ".join(f"{m} >= {full}" for m in metrics)
    return df.filter(test).orderBy(*order)


def targeted_nodes(windows: DataFrame, nodes: DataFrame, keys: Sequence[str], percent: float) -> DataFrame:
    """The central nodes to fail first: by incident capacity, then degree, then id;
    ceil(percent) of them, at least one above 0 percent, none at 0."""
    ends = windows.selectExpr(
        *keys,
        "inline(array(named_struct('node_id', node_i, 'peer', node_j, 'c', capacity_mbits), "
        "named_struct('node_id', node_j, 'peer', node_i, 'c', capacity_mbits)))",
    )
    scores = ends.groupBy(*keys, "node_id").agg(F.expr("sum(c) as capacity"), F.expr("count(distinct peer) as degree"))
    central = nodes.filter("is_central").select(*keys, "node_id")
    scored = attach(central, scores, [*keys, "node_id"]).selectExpr(
        *keys, "node_id", "round(coalesce(capacity, 0D), 9) as capacity", "coalesce(degree, 0L) as degree"
    )
    sizes = central.groupBy(*keys).agg(F.expr(f"least(count(*), greatest({int(percent > 0)}L, cast(ceil(count(*) * {max(percent, 0)} / 100D) as long))) as k"))
    ranked = numbered(scored, keys, [F.col("capacity").desc(), F.col("degree").desc(), F.col("node_id")], "position")
    return attach(ranked, sizes, keys).filter("position <= k").drop("k")


def shortlist(df: DataFrame, n: int = 5, regions: int = 2) -> DataFrame:
    """Front rows of the best cases: those on the front in all regions if there are any; ordered by
    regions present, worst rank-1 share, mean top-5 share, then case.

    ``df``: region, case_id, is_front, rank1_percent, top5_percent.
    """
    front = df.filter("is_front")
    cases = front.groupBy("case_id").agg(
        F.expr("count(distinct region) as regions_present"), F.expr("min(rank1_percent) as worst_rank1"),
        F.expr("avg(top5_percent) as mean_top5"),
    )
    best = cases.agg(F.expr(f"bool_or(regions_present = {regions}) as _common"))
    pool = attach(cases, best, []).filter(f"not _common or regions_present = {regions}")
    order = [F.col(c).desc() for c in ("regions_present", "worst_rank1", "mean_top5")]
    chosen = top_n(pool, [*order, F.col("case_id")], n).drop("_common")
    return front.join(chosen, "case_id")
