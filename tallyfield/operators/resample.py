"""Bootstrap intervals and sampling without replacement, from repeatable hashes.

In each draw a unit counts a Poisson(1) number of times, a plain-integer hash of its name and the draw
(:func:`tallyfield.functions.scalars.mixed`). A unit's number needs neither the size of its group nor a place in it, so
nothing is numbered or looked up: every task weighs its own rows, sums combine in place, and only one row per
(group, draw) and task is shuffled. The rule is the same for groups of every size, on every run and after lost executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.scalars import HASH_MODULUS, mixed, mixed_numbers, text_uniform
from tallyfield.operators.ordered import attach, numbered

DRAWS = 1000
#: Units that meet all draws at a time, and numbers a task holds before it gives its sums out.
UNITS_A_BLOCK = 512
HELD = 4_000_000


def poisson_bounds(modulus: int = HASH_MODULUS) -> list[int]:
    """Whole-number bounds b such that count(h >= b) is Poisson(1) for h uniform in [0, modulus)."""
    bounds, term, total = [], math.exp(-1.0), 0.0
    for k in range(1, 100):
        total += term
        term /= k
        if modulus * (1.0 - total) < 1.0:
            break
        bounds.append(int(modulus * total))
    return bounds


def unit_state(unit: Sequence[str], seed: int) -> Column:
    """A repeatable whole number for one unit, from 56 bits of the MD5 of its name."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in unit]))
    part = lambda at: F.conv(F.substring(digest, at, 7), 16, 10).cast("long")
    return mixed(F.lit(seed), part(1), part(8))


def _drawn_sums(units: DataFrame, group: Sequence[str], parts: Sequence[str], draws: int) -> DataFrame:
    """(group, _draw, parts): per task, the sums of ``parts`` times the unit's Poisson count in each draw.

    A block of units meets all draws as one matrix of counts; sums are held per group and given out whenever they reach ``HELD`` numbers.
    """
    bounds = np.array(poisson_bounds(), dtype=np.int64)
    numbers = np.arange(draws, dtype=np.int64)
    kinds = dict(units.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for key, sums in held.items():
                fields = [pa.array(numbers.astype(np.int32)), *[pa.array(np.ascontiguousarray(sums[:, i])) for i in range(len(parts))]]
                rows = pa.ListArray.from_arrays(pa.array([0, draws], pa.int32()), pa.StructArray.from_arrays(fields, ["_draw", *parts]))
                yield pa.RecordBatch.from_pydict({**{k: pa.array([v], type=types[k]) for k, v in zip(group, key)}, "_sums": rows})
            held.clear()

        types: dict[str, pa.DataType] = {}
        for batch in batches:
            types = types or {k: batch.schema.field(k).type for k in group}
            keys = list(zip(*[batch.column(k).to_pylist() for k in group])) if group else [()] * batch.num_rows
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                places.setdefault(key, []).append(i)
            states = batch.column("_u").to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in parts])
            for key, rows in places.items():
                sums = held.setdefault(key, np.zeros((draws, len(parts))))
                for a in range(0, len(rows), UNITS_A_BLOCK):
                    block = rows[a:a + UNITS_A_BLOCK]
                    weights = np.searchsorted(bounds, mixed_numbers(states[block, None], numbers), side="right")
                    sums += weights.T.astype(float) @ values[block]
                if len(held) * draws * len(parts) > HELD:
                    yield from given()
        yield from given()

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in group], f"_sums array<struct<_draw: int, {', '.join(f'{c}: double' for c in parts)}>>"])
    return units.mapInArrow(run, schema).select(*group, F.explode("_sums").alias("_sum")).select(*group, "_sum.*")


def _interval(units: DataFrame, group: Sequence[str], unit: Sequence[str], values: Sequence[str], draws: int, seed: int) -> DataFrame:
    """(group, metric): means and intervals of sum(_s0) / sum(_c0) and so on, one pair of columns per entry of ``values``.

    ``units`` has one row per unit. A unit's weight in a draw is made once, for all metrics.
    """
    at = range(len(values))
    point = units.groupBy(*group).agg(
        *[F.expr(f"count_if(_c{i} > 0) as _n{i}") for i in at], *[F.expr(f"try_divide(sum(_s{i}), sum(_c{i})) as _mean{i}") for i in at]
    )
    if draws > 1:
        parts = [c for i in at for c in (f"_s{i}", f"_c{i}")]
        drawn = _drawn_sums(units.select(*group, unit_state(unit, seed).alias("_u"), *[F.col(c).cast("double").alias(c) for c in parts]), group, parts, draws)
        # A draw in which no unit counts has no mean and is left out by the percentile.
        means = drawn.groupBy(*group, "_draw").agg(*[F.expr(f"try_divide(sum(_s{i}), sum(_c{i})) as _m{i}") for i in at])
        # The number of draws is a parameter, so a native percentile over them stays small.
        point = attach(point, means.groupBy(*group).agg(*[F.expr(f"percentile(_m{i}, array(0.025D, 0.975D)) as _b{i}") for i in at]), group)
    bound = lambda i, side: f"if(_n{i} = 1, _mean{i}, _b{i}[{side}])" if draws > 1 else f"_mean{i}"
    rows = ", ".join(
        f"named_struct('metric', '{v}', 'n_units', _n{i}, 'mean', _mean{i}, 'low', {bound(i, 0)}, 'high', {bound(i, 1)})" for i, v in enumerate(values)
    )
    return point.selectExpr(*group, f"inline(array({rows}))").filter("n_units > 0")


def bootstrap_mean(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], unit: Sequence[str], draws: int = DRAWS, seed: int = 1,
) -> DataFrame:
    """(keys, metric): n_units, mean and 2.5 / 97.5 % of the means of resampled rows; a single row gives its value.

    ``unit`` names the columns that tell the rows of a group apart; rows that agree in them are drawn together. Missing values count for nothing.
    """
    names = list(dict.fromkeys([*keys, *unit]))
    clean = [f"nanvl(cast(`{v}` as double), null)" for v in values]
    units = df.selectExpr(*names, *[f"coalesce({c}, 0D) as _s{i}" for i, c in enumerate(clean)], *[f"cast({c} is not null as int) as _c{i}" for i, c in enumerate(clean)])
    return _interval(units, list(keys), unit, values, draws, seed)


def cluster_bootstrap_mean(
    df: DataFrame, keys: Sequence[str], cluster: str, values: Sequence[str], draws: int = DRAWS, seed: int = 1,
) -> DataFrame:
    """As :func:`bootstrap_mean`, but whole clusters are drawn with all their rows.

    Rows are first reduced to sums and counts per cluster, so each cluster is weighted once.
    """
    clean = [f"nanvl(cast(`{v}` as double), null)" for v in values]
    units = df.groupBy(*keys, cluster).agg(
        *[F.expr(f"coalesce(sum({c}), 0D) as _s{i}") for i, c in enumerate(clean)], *[F.expr(f"count({c}) as _c{i}") for i, c in enumerate(clean)]
    )
    return _interval(units, list(keys), [cluster], values, draws, seed)


def sample_fraction(df: DataFrame, keys: Sequence[str], unit: str, percent: float, seed: str) -> DataFrame:
    """ceil(percent) of the distinct units of each group (at least one above 0 percent, none at 0), without replacement.

    Units are ordered by a hash of (seed, keys, unit); the first k are taken.
    """
    units = df.select(*keys, unit).distinct().withColumn(
        "_u", text_uniform(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col(unit).cast("string")))
    )
    sizes = units.groupBy(*keys).agg(F.expr(f"least(count(*), greatest({int(percent > 0)}L, cast(ceil(count(*) * {max(percent, 0)} / 100D) as long))) as k"))
    ranked = numbered(units, keys, ["_u", unit], "_position")
    return attach(ranked, sizes, keys).filter("_position <= k").select(*keys, unit)
