"""Pearson and Spearman correlations, pairwise complete, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.ordered import attach, value_ranks
from tallyfield.session import pinned

MIN_VARIANCE = 1e-12


def pair_rows(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Each row once per pair, with both values known; equal value pairs are counted together."""
    items = ", ".join(
        f"named_struct('metric_a', '{a}', 'metric_b', '{b}', 'x', cast(`{a}` as double), 'y', cast(`{b}` as double))" for a, b in pairs
    )
    long = df.selectExpr(*keys, f"inline(array({items}))").filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    return long.groupBy(*keys, "metric_a", "metric_b", "x", "y").agg(F.expr("count(*) as w"))


def _weighted_corr(df: DataFrame, group: Sequence[str], x: str, y: str, name: str) -> DataFrame:
    """Correlation from weights, centred on the group means first."""
    means = df.groupBy(*group).agg(F.expr(f"sum(w * {x}) / sum(w) as mx"), F.expr(f"sum(w * {y}) / sum(w) as my"))
    centred = attach(df, means, group)
    return centred.groupBy(*group).agg(
        F.expr("sum(w) as n"),
        F.expr(f"sum(w * ({x} - mx) * ({y} - my)) as sxy"),
        F.expr(f"sum(w * ({x} - mx) * ({x} - mx)) as sxx"),
        F.expr(f"sum(w * ({y} - my) * ({y} - my)) as syy"),
    ).selectExpr(*group, "n", f"if(sxx / n > {MIN_VARIANCE} and syy / n > {MIN_VARIANCE}, sxy / sqrt(sxx * syy), null) as {name}")


def correlations(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], min_pairs: int = 2) -> DataFrame:
    """(keys, metric_a, metric_b): n, pearson, spearman. NULL for constants and below ``min_pairs``."""
    group = [*keys, "metric_a", "metric_b"]
    cells = pinned(pair_rows(df, keys, pairs))
    pearson = _weighted_corr(cells, group, "x", "y", "pearson")
    rank = lambda c: value_ranks(cells, group, c, F.col("w")).select(*group, c, F.col("rank_avg").alias(f"r{c}"))
    ranked = attach(attach(cells, rank("x"), [*group, "x"]), rank("y"), [*group, "y"])
    spearman = _weighted_corr(ranked, group, "rx", "ry", "spearman").drop("n")
    return attach(pearson, spearman, group).selectExpr(
        *group, "n", f"if(n >= {min_pairs}, pearson, null) as pearson", f"if(n >= {min_pairs}, spearman, null) as spearman"
    )


def all_pairs(metrics: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(metrics, 2))


def metric_redundancy(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Every pair with its larger absolute coefficient and two flags."""
    found = correlations(df, keys, all_pairs(metrics))
    strongest = "greatest(abs(pearson), abs(spearman))"
    return found.selectExpr(
        "*", f"{strongest} as max_abs",
        f"coalesce({strongest} >= {threshold}, false) as possible_double_counting",
        f"coalesce({strongest} >= 0.98, false) as severe_redundancy",
    )
