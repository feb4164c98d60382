"""Order-dependent results (running sums, ranks, quantiles, neighbours) without one task per group.

A plain window function sends a whole group to one task. Here rows are range-partitioned by
(keys, order), so a group of any size spans many tasks; each task works on its own range, and only
one summary row per (group, range) is combined across ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.session import pinned

RANGE = "_range"


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on ``keys``; stays an equi-join for the planner."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join columns of ``right`` (unique per key) to ``left``; null keys match each other.

    Without keys ``right`` is the single row of a whole-table aggregate, the one thing broadcast by hand.
    """
    if not keys:
        renamed = F.broadcast(right.withColumn("_one", F.lit(1)))
        return left.withColumn("_one", F.lit(1)).join(renamed, "_one", how).drop("_one")
    marked = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(marked[f"_k_{k}"]) for k in keys])
    return left.join(marked, cond, how).drop(*[f"_k_{k}" for k in keys])


def _sort_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def into_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Range-partition by (keys, order) and tag each row with its range; the result is pinned.

    ``order`` should be (nearly) unique within a group: rows that tie completely share one range,
    so callers first aggregate equal values.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *_sort_columns(order))
    return pinned(ranged.withColumn(RANGE, F.spark_partition_id()))


def running(
    ranged: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column], before: bool = False
) -> DataFrame:
    """Running sums over ``order`` within ``keys`` for a frame made by :func:`into_ranges`.

    With ``before`` the current row is left out (0 on the first row).
    """
    cell = [*keys, RANGE]
    here = Window.partitionBy(*cell).orderBy(*_sort_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*cell).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    offsets = totals.select(
        *cell, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    local = ranged.select("*", *[F.sum(e).over(here).alias(f"_l_{n}") for n, e in sums.items()])
    joined = attach(local, offsets, cell)
    out = joined
    for n, e in sums.items():
        value = F.col(f"_l_{n}") + F.col(f"_o_{n}")
        out = out.withColumn(n, value - e if before else value)
    return out.drop(*[f"_l_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def neighbours(
    ranged: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
) -> DataFrame:
    """Values of the previous / next row in ``order`` within ``keys``, also across range borders.

    ``previous`` and ``following`` map output name -> source column.
    """
    previous, following = previous or {}, following or {}
    cell = [*keys, RANGE]
    sort = _sort_columns(order)
    here = Window.partitionBy(*cell).orderBy(*sort)
    across = Window.partitionBy(*keys).orderBy(RANGE)
    wanted = sorted(set(previous.values()) | set(following.values()))
    position = F.struct(*[F.struct(F.col(c)) for c in wanted])
    local = ranged.select(
        "*",
        F.row_number().over(here).alias("_rn"),
        *[F.lag(c).over(here).alias(f"_p_{n}") for n, c in previous.items()],
        F.lead(F.lit(True)).over(here).isNull().alias("_is_last"),
        *[F.lead(c).over(here).alias(f"_n_{n}") for n, c in following.items()],
    )
    ends = local.filter((F.col("_rn") == 1) | F.col("_is_last")).groupBy(*cell).agg(
        F.max(F.when(F.col("_rn") == 1, position)).alias("_first"),
        F.max(F.when(F.col("_is_last"), position)).alias("_last"),
    )
    at = {c: i for i, c in enumerate(wanted)}
    pick = lambda side, c: F.col(side).getField(f"col{at[c] + 1}").getField(c)
    borders = ends.select(
        *cell,
        *[F.lag(pick("_last", c)).over(across).alias(f"_bp_{n}") for n, c in previous.items()],
        *[F.lead(pick("_first", c)).over(across).alias(f"_bn_{n}") for n, c in following.items()],
    )
    out = attach(local, borders, cell)
    for n in previous:
        out = out.withColumn(n, F.when(F.col("_rn") == 1, F.col(f"_bp_{n}")).otherwise(F.col(f"_p_{n}")))
    for n in following:
        out = out.withColumn(n, F.when(F.col("_is_last"), F.col(f"_bn_{n}")).otherwise(F.col(f"_n_{n}")))
    extra = [f"_p_{n}" for n in previous] + [f"_bp_{n}" for n in previous]
    extra += [f"_n_{n}" for n in following] + [f"_bn_{n}" for n in following]
    return out.drop("_rn", "_is_last", *extra)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "row_no") -> DataFrame:
    """``row_number`` (from 1) by ``order`` within ``keys`` for groups of any size."""
    ranged = into_ranges(df, keys, order)
    return running(ranged, keys, order, {name: F.lit(1).cast("long")}).drop(RANGE)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Distinct non-null values per group with their weight, and the cumulative weight up to each."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("n_here"))
    )
    ranged = into_ranges(counts, keys, [value])
    return running(ranged, keys, [value], {"n_upto": F.col("n_here")}).drop(RANGE)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Ascending ranks of distinct values: ``rank_min`` (ties share the lowest) and ``rank_avg``."""
    return value_counts(df, keys, value, weight).select(
        *keys,
        value,
        "n_here",
        (F.col("n_upto") - F.col("n_here") + 1).alias("rank_min"),
        (F.col("n_upto") - (F.col("n_here") - 1) / 2.0).alias("rank_avg"),
    )


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide to long: (keys, metric, value), values as double with NaN turned to NULL."""
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]
    return df.select(*keys, *clean).unpivot(list(keys), list(columns), "metric", "value")


def distribution(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """One row per (keys, metric): n, mean, std (n-1), min, max and exact linear-interpolated quantiles.

    Works on counts of distinct values, so neither a big group nor a frequent value lands whole in
    one task, and the input is evaluated once.
    """
    group = [*keys, "metric"]
    placed = value_counts(melt(df, keys, columns), group, "value")
    totals = placed.groupBy(*group).agg(
        F.expr("sum(n_here) as n"), F.expr("sum(value * n_here) / sum(n_here) as mean")
    )
    placed = attach(placed, totals, group)
    picks = []
    for name, p in probs.items():
        at = f"((n - 1) * {float(p)}D)"
        for side, index in (("lo", f"floor({at})"), ("hi", f"ceil({at})")):
            holds = f"n_upto > {index} and n_upto - n_here <= {index}"
            picks.append(F.expr(f"max(value) filter (where {holds}) as _{side}_{name}"))
    found = placed.groupBy(*group).agg(
        F.expr("max(n) as n"),
        F.expr("max(mean) as mean"),
        F.expr("if(max(n) > 1, sqrt(sum(n_here * (value - mean) * (value - mean)) / (max(n) - 1)), null) as std"),
        F.expr("min(value) as min"),
        F.expr("max(value) as max"),
        *picks,
    )
    result = []
    for name, p in probs.items():
        at = f"((n - 1) * {float(p)}D)"
        result.append(f"_lo_{name} + (_hi_{name} - _lo_{name}) * ({at} - floor({at})) as {name}")
    return found.selectExpr(*group, "n", "mean", "std", "min", "max", *result)


def quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """(keys, metric) with one column per entry of ``probs``."""
    return distribution(df, keys, columns, probs).select(*keys, "metric", *probs)


def widen(long: DataFrame, keys: Sequence[str], columns: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """(keys, metric, stat..) back to one row per key with ``<metric>_<stat>`` columns."""
    picks = [F.expr(f"max(`{s}`) filter (where metric = '{m}') as `{m}_{s}`") for m in columns for s in stats]
    return long.groupBy(*keys).agg(*picks)
