"""Non-dominated rows (skyline) per group, exact, without sending a group to one task.

1. Equal objective vectors are merged. 2. Every input task drops what its own rows dominate.
3. The rest is cut into blocks of bounded size along a space-filling curve over the objectives, so a
block is a small box. A box that another box dominates as a whole is closed; a box can hold dominators
of another only if its best corner is at least as good as the other's worst corner.
4. The rows of such pairs of blocks are compared, two packed blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.ordered import attach, numbered, same_keys
from tallyfield.session import pinned

BLOCK_ROWS = 4096
FAN = 512  # blocks in a run
CELLS = 128  # quantile cells of an objective, a power of two
NULL_RULES = ("drop", "worst", "false")


def _oriented(df: DataFrame, maximise: Sequence[str], minimise: Sequence[str], null_rule: str) -> DataFrame:
    """Objectives as o0.. (bigger is better); a missing value is NULL or the worst value there is."""
    signs = [(c, 1) for c in maximise] + [(c, -1) for c in minimise]
    adds = []
    for i, (c, sign) in enumerate(signs):
        value = f"nanvl(cast({c} as double), null)"
        value = value if sign > 0 else f"-({value})"
        if null_rule == "worst":
            value = f"coalesce({value}, cast('-Infinity' as double))"
        adds.append(f"{value} as _o{i}")
    return df.selectExpr("*", *adds)


def _dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows of ``points`` some row of ``by`` dominates; works through ``by`` in slices of bounded memory."""
    out = np.zeros(len(points), dtype=bool)
    for start in range(0, len(by), 256):
        part = by[start : start + 256]
        open_rows = np.flatnonzero(~out)
        if not len(open_rows):
            break
        left = points[open_rows][:, None, :]
        at_least = (part[None, :, :] >= left).all(axis=2)
        better = (part[None, :, :] > left).any(axis=2)
        out[open_rows] = (at_least & better).any(axis=1)
    return out


def _local_filter(group: Sequence[str], names: Sequence[str], size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Holds a bounded set of strong rows per group to compare with; it only saves work downstream.
        strong: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby(list(group), dropna=False):
                points = part[list(names)].to_numpy(float)
                held = strong.get(key)
                mine = points[np.argsort(-np.nan_to_num(points, neginf=-1e300).sum(axis=1))[:size]]
                by = mine if held is None else np.vstack([held, mine])
                keep = ~_dominated(points, by)
                strong[key] = by[np.argsort(-np.nan_to_num(by, neginf=-1e300).sum(axis=1))[:size]]
                if keep.any():
                    yield part[keep]

    return run


def skyline(
    df: DataFrame, keys: Sequence[str], maximise: Sequence[str], minimise: Sequence[str], null_rule: str = "drop",
    name: str = "is_front", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Flag the rows of each group that no other row dominates; equal rows share their flag.

    Null rules: ``drop`` the row, treat a missing value as ``worst``, or flag the row ``false``.
    """
    if null_rule not in NULL_RULES:
        raise ValueError(f"unknown null rule {null_rule}")
    if not keys:
        one = df.withColumn("_all", F.lit(1))
        return skyline(one, ["_all"], maximise, minimise, null_rule, name, block_rows).drop("_all")
    names = [f"_o{i}" for i in range(len(maximise) + len(minimise))]
    rows = _oriented(df, maximise, minimise, null_rule)
    complete = " and ".join(f"{n} is not null" for n in names)
    if null_rule == "drop":
        rows = rows.filter(complete)
    vectors = rows.filter(complete).groupBy(*keys, *names).agg(F.lit(1).alias("_one")).drop("_one")
    kept = vectors.mapInPandas(_local_filter(keys, names, 128), vectors.schema)
    blocks = curve_blocks(kept, keys, names, block_rows)
    pairs = pinned(block_pairs(blocks, keys, names))
    packed = blocks.groupBy(*keys, "_block").applyInPandas(
        _pack(keys, names), ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys) + ", _block long, _rows binary")
    of = _with_rows(pairs, packed, keys, "_of")
    both = _with_rows(of, packed, keys, "_by")
    beaten = both.mapInPandas(_beaten_rows(keys, names), vectors.schema).distinct()
    # Equal vectors were merged, so the front is what is left after the beaten ones of the blocks still open.
    open_blocks = pairs.filter("_by = _of").select(*keys, F.col("_of").alias("_block"))
    still = blocks.join(open_blocks, same_keys(blocks, open_blocks, [*keys, "_block"]), "left_semi")
    front = still.join(beaten, same_keys(still, beaten, [*keys, *names]), "left_anti").select(*keys, *names).withColumn("_front", F.lit(True))
    flagged = attach(rows, front, [*keys, *names]).withColumn(name, F.expr("coalesce(_front, false)"))
    return flagged.drop("_front", *names)


def curve_blocks(vectors: DataFrame, keys: Sequence[str], names: Sequence[str], block_rows: int) -> DataFrame:
    """``vectors`` with ``_block``: runs of ``block_rows`` rows along a Z-order curve within each group.

    Every objective is scaled to the cell between quantiles of its group, so a skewed scale spreads as
    well as an even one. The bits of the cells are interleaved; rows of one cell follow their values.
    """
    probs = ", ".join(f"{i / CELLS}D" for i in range(1, CELLS))
    cuts = vectors.groupBy(*keys).agg(*[F.expr(f"percentile_approx({n}, array({probs}), 10000) as _cuts{n}") for n in names])
    cell = lambda n: f"cast(size(filter(_cuts{n}, c -> c < {n})) as long)"
    placed = attach(vectors, cuts, keys).selectExpr(*keys, *names, *[f"{cell(n)} as _cell{n}" for n in names])
    # At most 63 bits: with many objectives each gives its leading bits only.
    bits = min(CELLS.bit_length() - 1, 63 // len(names))
    drop = CELLS.bit_length() - 1 - bits
    parts = [f"shiftleft(shiftright(_cell{n}, {bit + drop}) & 1L, {bit * len(names) + i})" for bit in range(bits) for i, n in enumerate(names)]
    curve = placed.selectExpr(*keys, *names, f"{' | '.join(parts) or '0L'} as _curve")
    numbers = numbered(curve, keys, [F.col("_curve").desc(), *[F.col(n).desc() for n in names]], "_place")
    return pinned(numbers.selectExpr(*keys, *names, f"(_place - 1) div {block_rows} as _block"))


def _corners(df: DataFrame, cell: Sequence[str], names: Sequence[str], low: str, high: str) -> DataFrame:
    return df.groupBy(*cell).agg(*[F.max(high.format(n)).alias(f"hi{n}") for n in names], *[F.min(low.format(n)).alias(f"lo{n}") for n in names])


def _facing(boxes: DataFrame, candidates: DataFrame | None, keys: Sequence[str], names: Sequence[str], label: str) -> DataFrame:
    """Pairs (by, of) of open boxes in which ``by`` may hold a dominator of a row of ``of``.

    A box whose best corner another box's worst corner dominates is closed as a whole. Dominance is
    transitive, so a closed box is not needed as ``by`` either: what beats its rows is in an open box.
    """
    side = lambda to: boxes.select(
        *keys, *([F.col("_super").alias(f"_super{to}")] if candidates is not None else []), F.col(label).alias(to),
        *[F.col(f"{end}{n}").alias(f"{to}{end}{n}") for n in names for end in ("hi", "lo")])
    by, of = side("_by"), side("_of")
    if candidates is None:
        met = by.join(of.withColumnsRenamed({k: f"_k{k}" for k in keys}), [by[k].eqNullSafe(F.col(f"_k{k}")) for k in keys])
    else:
        first = attach_many(by, candidates, keys, "_super_by")
        other = of.withColumnsRenamed({k: f"_k{k}" for k in keys}).withColumnRenamed("_super_of", "_super_to")
        met = first.join(other, [*[first[k].eqNullSafe(F.col(f"_k{k}")) for k in keys], first["_super_of"] == F.col("_super_to")])
    met = met.filter(" and ".join(f"_byhi{n} >= _oflo{n}" for n in names))
    closes = " and ".join(f"_bylo{n} >= _ofhi{n}" for n in names) + " and (" + " or ".join(f"_bylo{n} > _ofhi{n}" for n in names) + ")"
    met = pinned(met.selectExpr(*keys, "_by", "_of", f"({closes}) as _closes"))
    closed = met.filter("_closes").select(*keys, F.col("_of").alias("_closed")).distinct()
    for end in ("_by", "_of"):
        gone = closed.withColumnRenamed("_closed", end)
        met = met.join(gone, same_keys(met, gone, [*keys, end]), "left_anti")
    return met.select(*keys, "_by", "_of")


def attach_many(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str) -> DataFrame:
    """Join all rows of ``right`` with the same (keys, ``on``); null keys match each other."""
    named = right.withColumnsRenamed({c: f"_k{c}" for c in [*keys, on]})
    return left.join(named, [left[c].eqNullSafe(named[f"_k{c}"]) for c in [*keys, on]]).drop(*[f"_k{c}" for c in [*keys, on]])


def block_pairs(blocks: DataFrame, keys: Sequence[str], names: Sequence[str], fan: int = FAN) -> DataFrame:
    """(keys, _by, _of): pairs of open blocks to compare, each open block with itself among them.

    Only corners are joined, in two steps: runs of ``fan`` blocks on the curve first, then the blocks of
    the runs that face each other. So the join has the key (group, run), and a group of 10^9 rows
    compares some hundreds of runs, not 250,000 blocks, with each other.
    """
    boxes = pinned(_corners(blocks, [*keys, "_block"], names, "{}", "{}").withColumn("_super", F.expr(f"_block div {fan}")))
    runs = _corners(boxes, [*keys, "_super"], names, "lo{}", "hi{}")
    facing = _facing(runs, None, keys, names, "_super").withColumnsRenamed({"_by": "_super_by", "_of": "_super_of"})
    return _facing(boxes, facing, keys, names, "_block")


def _pack(keys: Sequence[str], names: Sequence[str]):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        return pd.DataFrame([[*[first[k] for k in keys], int(first["_block"]), np.ascontiguousarray(part[list(names)].to_numpy(float)).tobytes()]],
                            columns=[*keys, "_block", "_rows"])

    return run


def _with_rows(pairs: DataFrame, packed: DataFrame, keys: Sequence[str], end: str) -> DataFrame:
    """The packed rows of one end of every pair (``block_rows`` vectors in one value)."""
    return attach(pairs, packed.withColumnsRenamed({"_block": end, "_rows": f"{end}_rows"}), [*keys, end])


def _beaten_rows(keys: Sequence[str], names: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                cell = dict(zip(batch.columns, row))
                points, by = (np.frombuffer(cell[f"{end}_rows"]).reshape(-1, len(names)) for end in ("_of", "_by"))
                hit = points[_dominated(points, by)]
                if len(hit):
                    out = pd.DataFrame(hit, columns=list(names))
                    for i, k in enumerate(keys):
                        out.insert(i, k, [cell[k]] * len(hit))
                    yield out

    return run


def pairwise_front_counts(
    df: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[tuple[str, bool], tuple[str, bool]]]
) -> DataFrame:
    """Eligible and front rows for each named pair of objectives (column, maximise?)."""
    out = None
    for label, objectives in pairs.items():
        up = [c for c, best_is_high in objectives if best_is_high]
        down = [c for c, best_is_high in objectives if not best_is_high]
        part = two_objective_front(df, keys, up, down).groupBy(*keys).agg(
            F.expr(f"'{label}' as pair"), F.expr("count(*) as eligible_cases"), F.expr("count_if(is_front) as front_cases")
        )
        out = part if out is None else out.unionByName(part)
    return out


def two_objective_front(df: DataFrame, keys: Sequence[str], maximise: Sequence[str], minimise: Sequence[str]) -> DataFrame:
    """Two objectives need no pairs of rows: best second value per first value, then a running maximum.

    A row is on the front if its second value is the best of its first value and above the best of
    all higher first values.
    """
    rows = _oriented(df, maximise, minimise, "drop").filter("_o0 is not null and _o1 is not null")
    best = rows.groupBy(*keys, "_o0").agg(F.max("_o1").alias("_top"))
    flagged = _running_best(best, keys)
    return attach(rows, flagged, [*keys, "_o0"]).withColumn(
        "is_front", F.expr("_o1 = _top and (_above is null or _o1 > _above)")
    ).drop("_o0", "_o1", "_top", "_above")


def _running_best(best: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest ``_top`` among all higher ``_o0``, over ranges: best inside the range, then best of ranges before."""
    from pyspark.sql import Window

    from tallyfield.operators.ordered import RANGE, into_ranges

    order = [F.col("_o0").desc()]
    ranged = into_ranges(best, keys, order)
    cell = [*keys, RANGE]
    inside = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    edges = ranged.groupBy(*cell).agg(F.max("_top").alias("_range_top")).select(
        *cell, F.max("_range_top").over(before).alias("_earlier")
    )
    local = ranged.withColumn("_inside", F.max("_top").over(inside))
    return attach(local, edges, cell).select(*keys, "_o0", "_top", F.greatest("_inside", "_earlier").alias("_above"))
