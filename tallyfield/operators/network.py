"""Loads, concentration and adjacency from transfer and contact logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.ordered import attach, value_counts


def node_loads(transfers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sent, received and total volume per node; a node's type comes from either end of a transfer.

    Each transfer is exploded into its two ends; no join, one aggregation.
    """
    ends = transfers.selectExpr(
        *keys,
        """inline(array(named_struct('node', from_node, 'is_central', from_central, 'sent', mbit, 'received', 0D),
                        named_struct('node', to_node, 'is_central', to_central, 'sent', 0D, 'received', mbit)))""",
    )
    return ends.groupBy(*keys, "node").agg(
        F.expr("bool_or(is_central) as is_central"), F.expr("sum(sent) as sent"), F.expr("sum(received) as received"),
        F.expr("sum(sent) + sum(received) as load"),
    )


def gini(df: DataFrame, keys: Sequence[str], value: str, absent: DataFrame | None = None) -> DataFrame:
    """Gini index of non-negative values per group; 0 where they sum to 0.

    ``absent`` (keys, n_total) says how many members a group really has: the missing ones count as
    0. A run of equal values takes the sum of its positions, so frequent values stay one row.
    """
    kept = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(value) >= 0))
    placed = value_counts(kept.withColumn(value, F.col(value).cast("double")), keys, value)
    # Sum of positions first..last of a run of equal values, with positions counted from 1.
    runs = placed.selectExpr(*keys, f"{value} as v", "n_here", "n_here * (2 * n_upto - n_here + 1) / 2D as position_sum")
    sums = runs.groupBy(*keys).agg(
        F.expr("sum(n_here) as n"), F.expr("sum(v * n_here) as total"), F.expr("sum(v * position_sum) as weighted")
    )
    if absent is not None:
        # Zeros take the first places, so every other position moves up by their number.
        sums = attach(absent, sums, keys).selectExpr(
            *keys, "coalesce(n, 0) as n0", "n_total", "coalesce(total, 0D) as total",
            "coalesce(weighted, 0D) + (n_total - coalesce(n, 0)) * coalesce(total, 0D) as weighted",
        ).withColumnRenamed("n_total", "n")
    return sums.selectExpr(*keys, "n", "if(total > 0, 2 * weighted / (n * total) - (n + 1D) / n, 0D) as gini")


def load_concentration(loads: DataFrame, keys: Sequence[str], top_share: float = 0.10) -> DataFrame:
    """Largest load, HHI, share of the top ten percent of nodes (rounded up, at least one), central share.

    The top share reads distinct loads with their running counts, so no group is ranked in one task.
    """
    totals = loads.groupBy(*keys).agg(
        F.expr("count(*) as n_nodes"), F.expr("sum(load) as total"), F.expr("max(load) as max_load"),
        F.expr("sum(load * load) as sum_sq"), F.expr("coalesce(sum(load) filter (where is_central), 0D) as central"),
    )
    placed = attach(value_counts(loads, keys, "load"), totals.select(*keys, "n_nodes"), keys)
    # Counted from the top: how many of this run of equal loads are among the first k.
    top = placed.selectExpr(
        *keys, "load", f"greatest(1L, cast(ceil(n_nodes * {top_share}D) as long)) as k", "n_nodes - n_upto as above", "n_here"
    ).groupBy(*keys).agg(F.expr("sum(load * greatest(0, least(n_here, k - above))) as top_load"))
    return attach(totals, top, keys).selectExpr(
        *keys, "n_nodes", "max_load",
        "if(total > 0, sum_sq / (total * total), 0D) as hhi",
        "if(total > 0, top_load / total, 0D) as top_share",
        "if(total > 0, central / total, 0D) as central_share",
    )


def adjacency(edges: DataFrame, keys: Sequence[str], i: str, j: str, directed: bool, sums: Sequence[str]) -> DataFrame:
    """Edge list with count and sums; an undirected pair is stored once with its smaller node first."""
    a, b = (i, j) if directed else (f"least({i}, {j})", f"greatest({i}, {j})")
    named = edges.selectExpr(*keys, f"{a} as node_a", f"{b} as node_b", *[c for c in sums])
    return named.groupBy(*keys, "node_a", "node_b").agg(
        F.count(F.lit(1)).alias("n_links"), *[F.sum(c).alias(f"sum_{c}") for c in sums]
    )


def upper_sum(adjacent: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sum over pairs of different nodes (an undirected matrix above its diagonal)."""
    return adjacent.filter("node_a <> node_b").groupBy(*keys).agg(*[F.sum(c).alias(f"upper_{c}") for c in columns])


def adjacency_matrix(adjacent: DataFrame, value: str, nodes: Sequence) -> DataFrame:
    """Wide matrix for export, for a node list the caller names."""
    return adjacent.groupBy("node_a").pivot("node_b", list(nodes)).agg(F.sum(value)).na.fill(0)


def network_utilisation(windows: DataFrame, transfers: DataFrame, tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Available against used windows, time and volume, and ratios per task; NULL over a zero."""
    available = windows.groupBy(*keys).agg(
        F.expr("count(*) as available_windows"), F.expr("sum(duration_sec) as available_sec"), F.expr("sum(capacity_mbits) as available_mbits")
    )
    used = transfers.groupBy(*keys).agg(
        F.expr("count(distinct window_id) as used_windows"), F.expr("count(*) as transfer_events"), F.expr("sum(mbit) as used_mbits")
    )
    wanted = tasks.groupBy(*keys).agg(F.expr("count(*) as n_tasks"), F.expr("sum(size_mbits) as task_mbits"))
    joined = attach(attach(available, used, keys), wanted, keys)
    return joined.selectExpr(
        *keys, "available_windows", "available_sec", "available_mbits",
        "coalesce(used_windows, 0) as used_windows", "coalesce(transfer_events, 0) as transfer_events",
        "coalesce(used_mbits, 0D) as used_mbits",
        "try_divide(100 * coalesce(used_mbits, 0D), available_mbits) as utilisation_percent",
        "try_divide(coalesce(used_mbits, 0D), n_tasks) as mbits_per_task",
        "try_divide(cast(coalesce(transfer_events, 0) as double), n_tasks) as events_per_task",
        "try_divide(task_mbits, available_mbits) as task_to_capacity_ratio",
    )
