"""Stress against baseline: retention, areas, scores and declines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.aggregates import summary
from tallyfield.operators.ordered import attach
from tallyfield.operators.resample import DRAWS, bootstrap_mean, cluster_bootstrap_mean
from tallyfield.operators.windows import retention_auc
from tallyfield.session import pinned

TINY_BASE = 1e-12


def robustness_detail(
    df: DataFrame, case_keys: Sequence[str], cell: Sequence[str], metrics: Sequence[str], stressed: str, baseline: str
) -> DataFrame:
    """Per (case, cell): mean over replicates, the case's baseline, delta and retention (NULL over a zero base).

    ``stressed`` and ``baseline`` are SQL tests on ``df``. Cases without a baseline drop out.
    """
    cells = df.filter(stressed).groupBy(*case_keys, *cell).agg(
        F.expr("count(distinct replicate) as replicates"), *[F.avg(m).alias(f"stressed_{m}") for m in metrics]
    )
    base = df.filter(baseline).groupBy(*case_keys).agg(*[F.max(m).alias(f"baseline_{m}") for m in metrics])
    out = cells.join(base, list(case_keys))
    for m in metrics:
        out = out.selectExpr(
            "*", f"stressed_{m} - baseline_{m} as delta_{m}",
            f"if(baseline_{m} > {TINY_BASE}, stressed_{m} / baseline_{m}, null) as retention_{m}",
        )
    return out


def robustness_interval(
    detail: DataFrame, keys: Sequence[str], cluster: str, metrics: Sequence[str], draws: int = DRAWS, seed: int = 1
) -> DataFrame:
    """(keys, quantity): mean with a cluster bootstrap interval, p05, and the number of clusters."""
    columns = [f"{q}_{m}" for m in metrics for q in ("stressed", "delta", "retention")]
    detail = pinned(detail.select(*keys, cluster, *columns))
    interval = cluster_bootstrap_mean(detail, keys, cluster, columns, draws, seed)
    low_tail = summary(detail, keys, columns, ["n", "p05"], {"p05": 0.05})
    return attach(interval, low_tail, [*keys, "metric"])


def robustness_score(cases: DataFrame, detail: DataFrame, keys: Sequence[str], family: str, level: str, metric: str) -> DataFrame:
    """Mean over failure families of the area under retention, joined to the cases (NULL where unknown)."""
    areas = retention_auc(detail, [*keys, family], level, f"retention_{metric}")
    score = areas.groupBy(*keys).agg(F.avg("auc_retention").alias("robustness_auc_retention"))
    return cases.join(score, list(keys), "left")


def paired_effects(
    df: DataFrame, keys: Sequence[str], region: Sequence[str], pairs: Sequence[tuple[str, str]], metrics: Sequence[str],
    draws: int = DRAWS, seed: int = 1,
) -> DataFrame:
    """Scenario contrasts per region: paired cases, mean, median and bootstrap interval of each delta.

    All contrasts go through one pass: a row is exploded into the contrasts its scenario takes part in.
    """
    items = ", ".join(
        f"named_struct('reference', '{a}', 'alternative', '{b}', 'side', case scenario_id when '{a}' then 'r' when '{b}' then 'a' end)"
        for a, b in pairs
    )
    sides = df.selectExpr(*keys, *metrics, f"inline(array({items}))").filter("side is not null")
    contrast = [*keys, "reference", "alternative"]
    both = pinned(sides.groupBy(*contrast).agg(
        F.expr("count(distinct side) as n_sides"),
        *[F.expr(f"max({m}) filter (where side = 'a') - max({m}) filter (where side = 'r') as `{m}`") for m in metrics],
    ).filter("n_sides = 2"))
    group = [*region, "reference", "alternative"]
    interval = bootstrap_mean(both, group, metrics, [k for k in keys if k not in region], draws, seed)
    middle = summary(both, group, metrics, ["median"], {"median": 0.5})
    cases = both.groupBy(*group).agg(F.expr("count(*) as paired_cases"))
    return attach(attach(interval, middle, [*group, "metric"]), cases, group)


def high_level_decline(
    deltas: DataFrame, keys: Sequence[str], outcome: str, explanatory: Sequence[str], threshold: float = 70.0, draws: int = DRAWS,
    seed: int = 1,
) -> DataFrame:
    """Steps that start at or above a level: share that fall, mean change with interval, and rank
    correlation of the change with each explanatory change (NULL below three pairs)."""
    from tallyfield.operators.correlation import correlations

    high = pinned(deltas.filter(F.col("level_from") >= threshold))
    group = [*keys, "level_from", "level_to"]
    counts = high.groupBy(*group).agg(
        F.expr("count(distinct base_id) as bases"),
        F.expr(f"100 * avg(cast({outcome} < 0 as double)) as share_dropping_percent"),
    )
    interval = bootstrap_mean(high, group, [outcome], ["base_id"], draws, seed).drop("metric", "n_units")
    pairs = [(outcome, c) for c in explanatory]
    found = correlations(high, group, pairs, 3)
    wide = found.groupBy(*group).agg(
        *[F.expr(f"max(spearman) filter (where metric_b = '{c}') as spearman_{c}") for c in explanatory]
    )
    return attach(attach(counts, interval, group), wide, group)
