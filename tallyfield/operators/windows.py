"""Keep-last, level steps, trends, runs and gaps.

Windows over levels run on tables with one row per (group, level); a design has few levels, so
those groups are small whatever the data size. Everything else goes through :mod:`.ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators.ordered import RANGE, attach, into_ranges, neighbours, numbered, running, value_ranks


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``order``. Limited to one row per key and task before the shuffle."""
    latest = [F.col(c).desc() for c in order]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*latest)))
    return ranked.filter("_rank = 1").drop("_rank")


def first_arrival(transfers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Earliest end per (task, node), then nodes reached and last first-arrival per task."""
    firsts = transfers.groupBy(*keys, "node_id").agg(F.expr("min(end_sec) as first_sec"))
    return firsts.groupBy(*keys).agg(F.expr("count(*) as nodes_reached"), F.expr("max(first_sec) as last_first_arrival_sec"))


def _steps(keys: Sequence[str], level: str) -> Window:
    return Window.partitionBy(*keys).orderBy(level)


def adjacent_deltas(
    df: DataFrame, keys: Sequence[str], level: str, metrics: Sequence[str], case: str = "case_id"
) -> DataFrame:
    """From each level to the next one present: case ids and metric differences. One row per (keys, level) expected."""
    w = _steps(keys, level)
    out = df.select(
        *keys, F.col(level).alias("level_from"), F.lead(level).over(w).alias("level_to"),
        F.col(case).alias("case_id_from"), F.lead(case).over(w).alias("case_id_to"),
        *[(F.lead(m).over(w) - F.col(m)).alias(f"delta_{m}") for m in metrics],
    )
    return out.filter("level_to is not null")


def marginal_gain(df: DataFrame, keys: Sequence[str], level: str, resource: str, metrics: Sequence[str]) -> DataFrame:
    """Change of each metric per added unit of the resource since the level before; NULL if none was added."""
    w = _steps(keys, level)
    step = df.select(
        *keys, level, (F.col(resource) - F.lag(resource).over(w)).alias("added"),
        *[(F.col(m) - F.lag(m).over(w)).alias(f"delta_{m}") for m in metrics],
    )
    return step.selectExpr("*", *[f"delta_{m} / nullif(added, 0) as gain_{m}" for m in metrics])


def trend_class(df: DataFrame, keys: Sequence[str], level: str, metric: str, tolerance: float = 1e-9) -> DataFrame:
    """Shape of a metric over levels, its rank correlation with the level, and the end-to-end change."""
    known = df.filter(F.col(metric).isNotNull()).select(*keys, F.col(level).alias("x"), F.col(metric).alias("y"))
    w = Window.partitionBy(*keys).orderBy("x")
    whole = Window.partitionBy(*keys)
    by_value = Window.partitionBy(*keys).orderBy("y")
    tie = Window.partitionBy(*keys, "y")
    marked = known.select(
        *keys, "x", "y", (F.col("y") - F.lag("y").over(w)).alias("d"), F.row_number().over(w).alias("pos"),
        (F.rank().over(by_value) + (F.count("*").over(tie) - 1) / 2).alias("ry"), F.max("y").over(whole).alias("top"),
    )
    shape = marked.groupBy(*keys).agg(
        F.expr("count(*) as n_levels"),
        F.expr(f"coalesce(bool_and(d >= -{tolerance}) filter (where d is not null), true) as up"),
        F.expr(f"coalesce(bool_and(d <= {tolerance}) filter (where d is not null), true) as down"),
        F.expr("min(pos) filter (where y = top) as peak"),
        F.expr("max_by(y, x) - min_by(y, x) as endpoint_change"),
        F.expr("covar_pop(pos, ry) as c"), F.expr("stddev_pop(pos) * stddev_pop(ry) as s"),
    )
    return shape.selectExpr(
        *keys, "n_levels",
        "case when up then 'monotonic_nondecreasing' when down then 'monotonic_nonincreasing' "
        "when peak > 1 and peak < n_levels then 'interior_peak_or_mixed' else 'mixed' end as trend",
        "if(n_levels >= 3 and s > 1e-12, c / s, null) as spearman", "endpoint_change",
    )


def saturation_level(df: DataFrame, keys: Sequence[str], level: str, metric: str, limit: float = 1.0) -> DataFrame:
    """First level from which every later step stays below ``limit``; NULL if the last step does not."""
    w = _steps(keys, level)
    steps = df.filter(F.col(metric).isNotNull()).select(
        *keys, F.col(level).alias("x"), F.abs(F.lead(metric).over(w) - F.col(metric)).alias("d")
    )
    onward = _steps(keys, "x").rowsBetween(0, Window.unboundedFollowing)
    calm = steps.select(*keys, "x", "d", F.bool_and(F.coalesce(F.col("d") < limit, F.lit(True))).over(onward).alias("calm"))
    return calm.groupBy(*keys).agg(F.expr("min(x) filter (where calm and d is not null) as saturation_level"))


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, time: str, step: float, horizon: float | None,
    payload: str,
) -> DataFrame:
    """Longest runs of true flags: start, end (last time + step, held to the horizon), payload stats.

    ``order`` must be unique within the keys. Runs cross task borders correctly.
    """
    marked = df.withColumn("_on", F.coalesce(flag, F.lit(False)))
    ranged = neighbours(into_ranges(marked, keys, order), keys, order, previous={"_was": "_on"})
    starts = F.expr("cast(_on and not coalesce(_was, false) as long)")
    runs = running(ranged, keys, order, {"run_no": starts}).filter("_on")
    end = f"max({time}) + {step}" if horizon is None else f"least(max({time}) + {step}, {horizon})"
    return runs.groupBy(*keys, "run_no").agg(
        F.expr(f"min({time}) as start_at"), F.expr(f"{end} as end_at"), F.expr("count(*) as n_samples"),
        F.expr(f"min({payload}) as min_payload"), F.expr(f"max({payload}) as max_payload"), F.expr(f"avg({payload}) as mean_payload"),
    ).filter("end_at > start_at")


def value_runs(df: DataFrame, keys: Sequence[str], order: str, value: str, carry: Sequence[str] = ()) -> DataFrame:
    """Runs of the same value along ``order``: first and last position and the number of steps."""
    ranged = neighbours(into_ranges(df, keys, [order]), keys, [order], previous={"_before": value})
    change = F.expr(f"cast(not (_before <=> {value}) as long)")
    runs = running(ranged, keys, [order], {"run_no": change})
    return runs.groupBy(*keys, "run_no", value, *carry).agg(
        F.expr(f"min({order}) as run_start"), F.expr(f"max({order}) as run_end"), F.expr("count(*) as n_steps")
    )


def revisit_stats(df: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: str) -> DataFrame:
    """Hours between successive observations: count, mean, max, min."""
    gaps = neighbours(into_ranges(df, keys, order), keys, order, previous={"_before": seconds}).drop(RANGE)
    hours = f"({seconds} - _before) / 3600D"
    return gaps.groupBy(*keys).agg(
        F.expr("count(*) as n_observations"), F.expr(f"avg({hours}) as mean_revisit_hr"), F.expr(f"max({hours}) as max_revisit_hr"),
        F.expr(f"min({hours}) as min_revisit_hr"),
    )


def retention_auc(df: DataFrame, keys: Sequence[str], level: str, retention: str) -> DataFrame:
    """Area under retention over stress level from the added point (0, 1), divided by the largest level."""
    points = df.filter(F.col(level).isNotNull() & F.col(retention).isNotNull()).select(
        *keys, F.col(level).alias("x"), F.col(retention).alias("y")
    )
    w = Window.partitionBy(*keys).orderBy("x")
    parts = points.select(
        *keys, "x", "y", F.coalesce(F.lag("x").over(w), F.lit(0.0)).alias("x0"), F.coalesce(F.lag("y").over(w), F.lit(1.0)).alias("y0")
    )
    return parts.groupBy(*keys).agg(
        F.expr("count(*) as n_levels"), F.expr("try_divide(sum((x - x0) * (y + y0) / 2), max(x)) as auc_retention")
    )


def rank_min(df: DataFrame, keys: Sequence[str], score: str, name: str = "score_rank") -> DataFrame:
    """Rank by descending score; equal scores share the smallest rank."""
    negated = df.withColumn("_neg", -F.col(score))
    ranks = value_ranks(negated, keys, "_neg").select(*keys, "_neg", F.col("rank_min").alias(name))
    return attach(negated, ranks, [*keys, "_neg"]).drop("_neg")


def dispatch_order(tasks: DataFrame, order: Sequence[Column], package: str) -> DataFrame:
    """Position in the whole queue and within the package. ``order`` ends in a unique column."""
    queued = numbered(tasks, [], order, "dispatch_order")
    return numbered(queued, [package], ["dispatch_order"], "sequence_in_package")


def share_within(df: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """Rows per (keys, part) and their share of the group in percent; the total is taken over the counts."""
    counts = df.groupBy(*keys, part).agg(F.expr("count(*) as n"))
    totals = counts.groupBy(*keys).agg(F.expr("sum(n) as n_group"))
    return attach(counts, totals, keys).selectExpr(*keys, part, "n", "100D * n / n_group as share_percent")


def best_in_group(df: DataFrame, keys: Sequence[str], value: str, name: str = "is_best") -> DataFrame:
    """Flag the rows that hold the smallest value of their group."""
    best = df.groupBy(*keys).agg(F.min(value).alias("_best"))
    return attach(df, best, keys).withColumn(name, F.expr(f"coalesce({value} = _best, false)")).drop("_best")
