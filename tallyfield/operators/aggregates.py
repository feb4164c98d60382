"""Grouped summaries. Quantiles are exact and computed over ranges, see :mod:`.ordered`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.ordered import attach, distribution, melt, widen
from tallyfield.operators.resample import DRAWS, bootstrap_mean

MEDIAN = {"median": 0.5}
TAILS = {"p05": 0.05, "p95": 0.95}
QUARTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75}


def describe_by(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], case: str = "case_id") -> DataFrame:
    """Distinct cases, rows, and n / mean / median / std / p05 / p95 / min / max per metric. Null keys are kept."""
    counts = df.groupBy(*keys).agg(
        F.count_distinct(case).alias("case_count"), F.count(F.lit(1)).alias("scenario_evaluations")
    )
    stats = ["n", "mean", "median", "std", "p05", "p95", "min", "max"]
    wide = widen(distribution(df, keys, metrics, {**MEDIAN, **TAILS}), keys, metrics, stats)
    out = attach(counts, wide, keys)
    return out.withColumns({f"{m}_n": F.coalesce(f"{m}_n", F.lit(0)) for m in metrics})


def level_summary(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str], base: str = "base_id", unit: Sequence[str] = ("case_id",),
    central: str = "n_central_nodes", draws: int = DRAWS, seed: int = 1,
) -> DataFrame:
    """Long form: mean with its bootstrap interval, median, quartiles and count of each metric per group, with the number of bases
    and the median number of central nodes."""
    known = df.dropna(subset=list(keys))
    bases = known.groupBy(*keys).agg(F.count_distinct(base).alias("n_bases"))
    nodes = distribution(known, keys, [central], MEDIAN).select(*keys, F.col("median").alias("median_central_nodes"))
    stats = distribution(known, keys, metrics, QUARTILES).select(*keys, "metric", "n", "mean", *QUARTILES)
    interval = bootstrap_mean(known, keys, metrics, unit, draws, seed).select(*keys, "metric", "low", "high")
    return attach(attach(attach(stats, interval, [*keys, "metric"]), bases, keys), nodes, keys)


def summary(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str], stats: Sequence[str], probs: Mapping[str, float]
) -> DataFrame:
    """Chosen statistics of each metric, long form."""
    return distribution(df, keys, metrics, dict(probs)).select(*keys, "metric", *stats)


def means_by(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def normal_interval(df: DataFrame, keys: Sequence[str], metric: str, z: float = 1.96) -> DataFrame:
    """mean +- z * std / sqrt(n); NULL bounds for a single row."""
    return (
        df.groupBy(*keys)
        .agg(F.expr(f"count({metric}) as n"), F.expr(f"avg({metric}) as mean"), F.expr(f"stddev_samp({metric}) as std"))
        .selectExpr(*keys, "n", "mean", f"mean - {z} * std / sqrt(n) as low", f"mean + {z} * std / sqrt(n) as high")
    )


def threshold_counts(df: DataFrame, keys: Sequence[str], criteria: Mapping[str, str]) -> DataFrame:
    """Rows meeting each criterion (label -> SQL test): one pass, one row per (keys, criterion)."""
    labels = list(criteria)
    columns = [f"c{i}" for i in range(len(labels))]
    counted = df.groupBy(*keys).agg(*[F.expr(f"count_if({criteria[n]}) as {c}") for n, c in zip(labels, columns)])
    rows = ", ".join(f"named_struct('criterion', '{n}', 'n', {c})" for n, c in zip(labels, columns))
    return counted.selectExpr(*keys, f"inline(array({rows}))")


def coverage_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_distinct("scenario_id").alias("scenarios"),
        F.count_distinct("case_id").alias("cases"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def priority_summary(
    df: DataFrame, keys: Sequence[str], classes: Sequence[str], metrics: Sequence[str], case: str = "case_id"
) -> DataFrame:
    """Wide ``<class>_<metric>`` columns to one row per (keys, class, metric): cases, mean, p05, p95."""
    columns = [f"{c}_{m}" for c in classes for m in metrics]
    cases = df.groupBy(*keys).agg(F.count_distinct(case).alias("case_count"))
    found = distribution(df, keys, columns, TAILS).selectExpr(
        *keys,
        "regexp_extract(metric, '^([a-z]+)_', 1) as priority_class",
        "regexp_extract(metric, '^[a-z]+_(.*)$', 1) as metric",
        "n", "mean", "p05", "p95",
    )
    return attach(found, cases, keys)


def task_summary(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Task success shares; latency of observed tasks only; completion share. Missing flags count as false."""
    flags = tasks.selectExpr(
        *keys, "case_id",
        "coalesce(observed_before_deadline, false) as seen",
        "coalesce(s100_surviving_by_deadline, false) as complete",
        "coalesce(t100_surviving_censored, true) as censored",
        "surviving_coverage_deadline_percent as coverage",
        "if(coalesce(observed_before_deadline, false), observation_latency_min, null) as latency",
        "if(coalesce(t100_surviving_censored, true), null, t100_surviving_min) as t100",
    )
    counts = flags.groupBy(*keys).agg(
        F.expr("count(distinct case_id) as case_count"),
        F.expr("count(*) as task_evaluations"),
        F.expr("avg(cast(seen as double)) * 100 as observation_success_percent"),
        F.expr("avg(cast(complete as double)) * 100 as s100_percent"),
        F.expr("avg(coverage) as mean_coverage_percent"),
        F.expr("avg(latency) as latency_mean_min"),
        F.expr("avg(cast(not censored as double)) * 100 as t100_completion_percent"),
    )
    tails = widen(distribution(flags, keys, ["latency", "t100"], {"p90": 0.9}), keys, ["latency", "t100"], ["p90"])
    return attach(counts, tails, keys)


def transfer_summary(transfers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cases, events, volume, duration mean and p95, hops, share that starts on the ground."""
    counts = transfers.groupBy(*keys).agg(
        F.expr("count(distinct case_id) as cases"),
        F.expr("count(*) as transfer_events"),
        F.expr("sum(mbit) as transferred_mbits"),
        F.expr("avg(duration_sec) as mean_duration_sec"),
        F.expr("avg(hop) as mean_hops"),
        F.expr("avg(cast(startswith(from_node, 'GS_') as double)) * 100 as ground_origin_percent"),
    )
    tails = distribution(transfers, keys, ["duration_sec"], {"p95_duration_sec": 0.95}).drop("metric", "n", "mean", "std", "min", "max")
    return attach(counts, tails, keys)


def eta_squared(df: DataFrame, keys: Sequence[str], factors: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Between-level over total sum of squares per (keys, factor, metric); NULL where the total is 0.

    Level means are merged by their counts, so the table is aggregated once.
    """
    long = melt(df, [*keys, *factors], metrics).filter("value is not null")
    rows = ", ".join(f"named_struct('factor', '{f}', 'level', cast({f} as double))" for f in factors)
    long = long.selectExpr(*keys, "metric", "value", f"inline(array({rows}))").filter("level is not null")
    levels = long.groupBy(*keys, "factor", "metric", "level").agg(
        F.expr("count(*) as n"), F.expr("avg(value) as m"), F.expr("var_pop(value) * count(*) as within_ss")
    )
    grand = levels.groupBy(*keys, "factor", "metric").agg(F.expr("sum(n * m) / sum(n) as grand"))
    joined = attach(levels, grand, [*keys, "factor", "metric"])
    return (
        joined.groupBy(*keys, "factor", "metric")
        .agg(
            F.expr("sum(n * (m - grand) * (m - grand)) as between_ss"), F.expr("sum(within_ss) as within_ss"),
            F.expr("count(*) as n_levels"),
        )
        .selectExpr(
            *keys, "factor", "metric", "n_levels",
            "if(between_ss + within_ss > 1e-12, between_ss / (between_ss + within_ss), null) as eta_squared",
        )
    )


def effect_levels(df: DataFrame, keys: Sequence[str], factors: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """The level table behind :func:`eta_squared`: n, mean, std and exact p05 / p95 of each metric per (keys, factor, level).

    Rows are repeated once per factor, then summarised together over ranges, so a level that holds most rows is spread as well.
    Missing levels and missing values are left out; std is NULL for a single value.
    """
    rows = ", ".join(f"named_struct('factor', '{f}', 'level', cast({f} as double))" for f in factors)
    long = df.selectExpr(*keys, *metrics, f"inline(array({rows}))").filter("level is not null")
    found = distribution(long, [*keys, "factor", "level"], metrics, TAILS).filter("n > 0")
    return found.select(*keys, "factor", "level", "metric", "n", "mean", "std", *TAILS)


def factor_levels(df: DataFrame, keys: Sequence[str], factors: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means per level of every single factor: one GROUPING SETS aggregation instead of a loop."""
    view = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in factors], *metrics)
    sets = ", ".join("(" + ", ".join([*keys, f]) + ")" for f in factors)
    names = [*keys, *factors]
    which = " ".join(f"when grouping({f}) = 0 then '{f}'" for f in factors)
    level = " ".join(f"when grouping({f}) = 0 then {f}" for f in factors)
    means = ", ".join(f"avg({m}) as mean_{m}" for m in metrics)
    spark = df.sparkSession
    return spark.sql(
        f"select {', '.join(keys)}, case {which} end as factor, case {level} end as level, count(*) as cases, {means} "
        f"from {{view}} group by grouping sets ({sets}) order by {', '.join(names)}".split(" order by ")[0],
        view=view,
    )


def factor_ranges(levels: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """From :func:`factor_levels`: evaluated range, number of levels, largest difference of level means."""
    long = levels.unpivot([*keys, "factor", "level"], [f"mean_{m}" for m in metrics], "metric", "value").filter("value is not null")
    return long.groupBy(*keys, "factor", "metric").agg(
        F.expr("min(level) as evaluated_min"), F.expr("max(level) as evaluated_max"),
        F.expr("max(level) - min(level) as evaluated_range"), F.expr("count(*) as n_levels"),
        F.expr("max(value) - min(value) as max_minus_min_mean"),
    ).withColumn("metric", F.expr("substr(metric, 6)"))


def macro_average(df: DataFrame, keys: Sequence[str], part: str, metrics: Sequence[str]) -> DataFrame:
    """Equal weight per part: mean within each part, then mean of the parts."""
    inner = df.groupBy(*keys, part).agg(*[F.avg(m).alias(m) for m in metrics])
    return inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_parts"), *[F.avg(m).alias(f"macro_{m}") for m in metrics])


def availability(df: DataFrame, keys: Sequence[str], expected_cases: int, expected_bases: int) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_distinct("case_id").alias("cases"), F.count_distinct("base_id").alias("bases")
    ).selectExpr(
        "*", f"{expected_cases} - cases as missing_cases", f"{expected_bases} - bases as missing_bases",
        f"cases = {expected_cases} and bases = {expected_bases} as balanced",
    )


def cross_fleet_response(matched: DataFrame, keys: Sequence[str], metrics: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """Means of both fleets and of their difference, one row per (level, metric)."""
    a, b = suffixes
    rows = ", ".join(
        f"named_struct('metric', '{m}', 'va', {m}_{a}, 'vb', {m}_{b}, 'd', delta_{m})" for m in metrics
    )
    long = matched.selectExpr(*keys, f"inline(array({rows}))")
    return long.groupBy(*keys, "metric").agg(
        F.expr("count(*) as matched_cases"), F.expr(f"avg(va) as mean_{a}"), F.expr(f"avg(vb) as mean_{b}"),
        F.expr("avg(d) as mean_delta"),
    )


def front_composition(df: DataFrame, keys: Sequence[str], flag: str, level: str) -> DataFrame:
    """How many rows of each group are on the front, and the median / min / max of their level."""
    front = df.filter(F.col(flag))
    return distribution(front, keys, [level], MEDIAN).selectExpr(
        *keys, "n as front_rows", f"median as median_{level}", f"min as min_{level}", f"max as max_{level}"
    )


def unique_task_counts(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tasks.groupBy(*keys).agg(F.count_distinct("task_id").alias("n_tasks"))
