"""From transfer and opportunity logs to task outcomes, and from tasks to cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.scalars import DEADLINE_SLACK_SEC, failure_class
from tallyfield.operators.ordered import RANGE, attach, into_ranges, quantiles, running

MILESTONES = (10, 25, 50, 75, 90, 95, 100)


def coverage(pairs: DataFrame, keys: Sequence[str], extra: dict[str, str] | None = None) -> DataFrame:
    """Per task: targets, targets reached, coverage and complete-delivery flags.

    ``pairs`` holds one row per (task, node): ``eligible``, ``node_failed``, ``recv_sec`` (NULL if
    never), ``created_sec``, ``deadline_sec``. Everything is counted over all targets and over the
    surviving ones. An empty target set has NULL coverage and is never complete. ``extra`` adds
    aggregates to the same pass. All of them combine partially, so a task with very many nodes
    needs no single task of its own.
    """
    slack = DEADLINE_SLACK_SEC
    out = pairs.groupBy(*keys).agg(
        *[F.expr(f"min({c}) as {c}") for c in ("created_sec", "deadline_sec")],
        *[F.expr(f"{agg} as {name}") for name, agg in (extra or {}).items()],
        F.expr("count_if(eligible) as original_target_count"),
        F.expr("count_if(eligible and not node_failed) as surviving_target_count"),
        F.expr(f"count_if(eligible and recv_sec <= deadline_sec + {slack}) as reached_original_by_deadline"),
        F.expr("count_if(eligible and recv_sec is not null) as reached_original_by_end"),
        F.expr(
            f"count_if(eligible and not node_failed and recv_sec <= deadline_sec + {slack}) as reached_surviving_by_deadline"
        ),
        F.expr("count_if(eligible and not node_failed and recv_sec is not null) as reached_surviving_by_end"),
        F.expr("max(recv_sec) filter (where eligible and not node_failed) as _last_alive"),
    )
    adds = []
    for group in ("original", "surviving"):
        n = f"{group}_target_count"
        for moment in ("deadline", "end"):
            hit = f"reached_{group}_by_{moment}"
            adds.append(f"if({n} > 0, 100D * {hit} / {n}, null) as {group}_coverage_{moment}_percent")
            adds.append(f"{n} > 0 and {hit} = {n} as s100_{group}_by_{moment}")
    return out.selectExpr("*", *adds).selectExpr(
        "*",
        "if(s100_surviving_by_end, (_last_alive - created_sec) / 60, null) as t100_surviving_min",
        "not s100_surviving_by_end as t100_surviving_censored",
    ).drop("_last_alive")


def milestones(
    pairs: DataFrame, keys: Sequence[str], percents: Sequence[int] = MILESTONES
) -> DataFrame:
    """Minutes from creation until ceil(p %) of the targets have the task, one column per percentage.

    Arrivals are counted per distinct time first; the running count spans ranges, so tasks with
    any number of targets are handled.
    """
    targets = pairs.filter("eligible")
    sizes = targets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("target_count"), F.min("created_sec").alias("created_sec")
    )
    times = targets.filter(F.col("recv_sec").isNotNull()).groupBy(*keys, "recv_sec").agg(
        F.count(F.lit(1)).cast("long").alias("n_here")
    )
    reached = running(into_ranges(times, keys, ["recv_sec"]), keys, ["recv_sec"], {"n_upto": F.col("n_here")}).drop(RANGE)
    placed = attach(reached, sizes.select(*keys, "target_count"), keys)
    need = {p: F.ceil(F.col("target_count") * p / 100.0) for p in percents}
    firsts = placed.groupBy(*keys).agg(
        *[F.min(F.when(F.col("n_upto") >= need[p], F.col("recv_sec"))).alias(f"_at_{p}") for p in percents]
    )
    out = attach(sizes, firsts, keys)
    return out.select(
        *keys, "target_count", *[((F.col(f"_at_{p}") - F.col("created_sec")) / 60.0).alias(f"t{p}_min") for p in percents]
    )


def first_reception(transfers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per task: when, where and after how many hops it was first received; node counts by type.

    ``transfers``: ``node_id``, ``is_central``, ``end_sec``, ``hop``, ``created_sec``,
    ``deadline_sec``. Ties on time go to the smaller node, then the smaller hop.
    """
    nodes = transfers.groupBy(*keys, "node_id").agg(
        F.max("is_central").alias("is_central"),
        F.min(F.struct("end_sec", "node_id", "hop")).alias("_first"),
        F.max("hop").alias("_max_hop"),
        F.min("created_sec").alias("created_sec"),
        F.min("deadline_sec").alias("deadline_sec"),
    )
    timely = F.col("_first.end_sec") <= F.col("deadline_sec") + DEADLINE_SLACK_SEC
    return (
        nodes.groupBy(*keys)
        .agg(
            F.min("_first").alias("_first"),
            F.max("_max_hop").alias("max_hops"),
            F.count(F.lit(1)).alias("nodes_reached"),
            F.count_if("is_central").alias("central_nodes_reached"),
            F.count_if(~F.col("is_central")).alias("observers_reached"),
            F.bool_or(timely).alias("received_before_deadline"),
            F.min("created_sec").alias("created_sec"),
        )
        .select(
            *keys,
            F.col("_first.node_id").alias("first_node"),
            F.col("_first.end_sec").alias("first_reception_sec"),
            F.col("_first.hop").alias("first_hop"),
            ((F.col("_first.end_sec") - F.col("created_sec")) / 60.0).alias("first_reception_latency_min"),
            "max_hops", "nodes_reached", "central_nodes_reached", "observers_reached", "received_before_deadline",
        )
    )


def with_failure_class(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn(
        "failure_class",
        failure_class(F.col("original_target_count"), F.col("reached_surviving_by_deadline"), F.col("observed_before_deadline")),
    )


def case_rollup(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Task outcomes to case rows: shares in percent, mean coverage, failure counts, completion counts."""
    pct = lambda flag: f"avg(cast({flag} as double)) * 100"
    aggregates = {
        "n_tasks": "count(*)",
        "mean_original_coverage_deadline_percent": "avg(original_coverage_deadline_percent)",
        "mean_surviving_coverage_deadline_percent": "avg(surviving_coverage_deadline_percent)",
        "s100_original_by_deadline_percent": pct("s100_original_by_deadline"),
        "s100_surviving_by_deadline_percent": pct("s100_surviving_by_deadline"),
        "observation_success_percent": pct("observed_before_deadline"),
        "geometry_failure_count": "count_if(failure_class = 'geometry_failure_no_eligible_receiver')",
        "communication_failure_count": "count_if(failure_class = 'communication_failure_no_target_reached')",
        "routing_or_timing_failure_count": "count_if(failure_class = 'routing_or_timing_failure')",
        "t100_completed_count": "count(t100_surviving_min)",
        "t100_censored_count": "count_if(t100_surviving_censored)",
        "p100_t100_surviving_min": "max(t100_surviving_min)",
        "transferred_mbits": "sum(transferred_mbits)",
        "n_transfer_events": "sum(n_transfers)",
        "max_hops_seen": "max(max_hops)",
    }
    return tasks.groupBy(*keys).agg(*[F.expr(f"{agg} as {name}") for name, agg in aggregates.items()])


def rollup_with_quantiles(tasks: DataFrame, keys: Sequence[str], column: str, probs: dict[str, float]) -> DataFrame:
    """:func:`case_rollup` plus exact quantiles of a time column over the tasks that have it."""
    found = quantiles(tasks, keys, [column], probs).drop("metric")
    return attach(case_rollup(tasks, keys), found, keys)


def outcome_rollup(tasks: DataFrame, keys: Sequence[str], latencies: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Success shares, latencies of completed tasks only (mean and quantiles), censor counts, and
    counts of failure classes by a word they contain."""
    pct = lambda c: F.avg(c.cast("double")) * 100.0
    received = F.coalesce(F.col("reached_original_by_deadline") > 0, F.lit(False))
    says = lambda word: F.count_if(F.lower("failure_class").contains(word))
    counts = tasks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tasks"),
        pct(received).alias("useful_recipient_success_percent"),
        pct(F.col("s100_original_by_deadline")).alias("full_dissemination_success_percent"),
        pct(F.col("observed_before_deadline")).alias("observation_success_percent"),
        pct(received & F.col("observed_before_deadline")).alias("combined_success_percent"),
        *[F.avg(c).alias(f"mean_{c}") for c in latencies],
        *[F.count_if(F.col(c).isNull()).alias(f"censored_{c}") for c in latencies],
        says("geometry").alias("geometry_failures"),
        says("communication").alias("communication_failures"),
        says("routing").alias("routing_failures"),
    )
    found = quantiles(tasks, keys, latencies, probs)
    wide = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == c, F.col(p))).alias(f"{p}_{c}") for c in latencies for p in probs]
    )
    return attach(counts, wide, keys)


def priority_pivot(tasks: DataFrame, keys: Sequence[str], flags: dict[str, str], classes: Sequence[str]) -> DataFrame:
    """One row per case with ``n_tasks_<class>`` and ``<class>_<metric>`` (NULL where a class has no task)."""
    picks = []
    for name in classes:
        mine = F.col("priority_class") == name
        short = name.lower()
        picks.append(F.count_if(mine).alias(f"n_tasks_{short}"))
        picks += [
            (F.avg(F.when(mine, F.col(flag).cast("double"))) * 100.0).alias(f"{short}_{metric}")
            for metric, flag in flags.items()
        ]
    return tasks.groupBy(*keys).agg(*picks)
