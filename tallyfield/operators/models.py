"""Regression by sums: every fit reads its table once and solves a tiny system per group."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.scalars import text_uniform
from tallyfield.operators.ordered import attach
from tallyfield.session import pinned

MIN_SAMPLES = 20
MODELS = {"linear": (1, False), "polynomial_degree_2": (2, False), "polynomial_degree_3": (3, False), "log_linear": (1, True)}


def _monomials(n: int, degree: int) -> list[tuple[int, ...]]:
    return [c for d in range(1, degree + 1) for c in combinations_with_replacement(range(n), d)]


def model_comparison(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, row_id: Sequence[str], folds: int = 5, seed: str = "cv"
) -> DataFrame:
    """k-fold R2, RMSE and MAE of four least-squares models per group; groups below 20 rows drop out.

    Features are standardised per group by one aggregation. Sums of products per (group, model,
    fold) are all a least-squares fit needs, so what reaches a solver is one small matrix per fold.
    """
    fold = F.floor(text_uniform(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in row_id])) * folds).cast("int")
    rows = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("y"),
                     fold.alias("fold")).dropna()
    stats = rows.groupBy(*keys).agg(
        F.expr("count(*) as n_all"), *[F.expr(f"avg({f}) as m_{f}") for f in features],
        *[F.expr(f"stddev_pop({f}) as s_{f}") for f in features],
    ).filter(f"n_all >= {MIN_SAMPLES}")
    scaled = rows.join(stats, list(keys)).selectExpr(
        *keys, "fold", "y", *[f"if(s_{f} > 1e-12, ({f} - m_{f}) / s_{f}, 0D) as {f}" for f in features]
    )
    parts = []
    for name, (degree, log_target) in MODELS.items():
        terms = ["1D", *["*".join(features[i] for i in combo) for combo in _monomials(len(features), degree)]]
        base = scaled.filter("y > 0") if log_target else scaled
        shaped = base.selectExpr(*keys, "fold", "y", f"{'ln(y)' if log_target else 'y'} as t", f"array({', '.join(terms)}) as x")
        parts.append(_cross_validate(shaped, keys, name, len(terms), log_target))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    best = out.groupBy(*keys).agg(F.min("cv_rmse").alias("_best"))
    return attach(out, best, keys).withColumn("is_best", F.expr("cv_rmse = _best")).drop("_best")


def _cross_validate(shaped: DataFrame, keys: Sequence[str], name: str, p: int, log_target: bool) -> DataFrame:
    upper = np.triu_indices(p)
    key_types = ", ".join(f"`{k}` {shaped.schema[k].dataType.simpleString()}" for k in keys)

    def products(batches):
        """Per Arrow batch and (group, fold): upper triangle of X'X, then X't, as one flat array."""
        for pdf in batches:
            out = []
            for cell, part in pdf.groupby([*keys, "fold"], dropna=False):
                x = np.vstack(part["x"].to_numpy())
                flat = np.concatenate([(x.T @ x)[upper], x.T @ part["t"].to_numpy(float)])
                out.append([*cell, flat.tolist()])
            yield pd.DataFrame(out, columns=[*keys, "fold", "v"])

    # Batch results are added up per position, so only one array per fold is ever gathered.
    partial = shaped.select(*keys, "fold", "t", "x").mapInPandas(products, f"{key_types}, fold int, v array<double>")
    summed = partial.selectExpr(*keys, "fold", "posexplode(v) as (pos, val)").groupBy(*keys, "fold", "pos").agg(F.expr("sum(val) as val"))
    m = p * (p + 1) // 2
    sums = summed.groupBy(*keys, "fold").agg(
        F.expr("transform(array_sort(collect_list(struct(pos, val))), e -> e.val) as v")
    ).selectExpr(*keys, "fold", f"slice(v, 1, {m}) as xx", f"slice(v, {m + 1}, {p}) as xt")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        """At most one row per fold comes in: fit each fold on the sums of the others."""
        total_xx = np.sum(np.vstack(pdf["xx"].to_numpy()), axis=0)
        total_xt = np.sum(np.vstack(pdf["xt"].to_numpy()), axis=0)
        out = []
        for row in pdf.itertuples(index=False):
            gram = np.zeros((p, p))
            gram[upper] = total_xx - np.asarray(row.xx)
            gram = gram + np.triu(gram, 1).T
            beta = np.linalg.lstsq(gram, total_xt - np.asarray(row.xt), rcond=None)[0]
            out.append([getattr(row, k) for k in keys] + [row.fold, beta.tolist()])
        return pd.DataFrame(out, columns=[*keys, "fold", "beta"])

    fits = sums.groupBy(*keys).applyInPandas(solve, f"{key_types}, fold int, beta array<double>")
    guess = "aggregate(zip_with(x, beta, (a, b) -> a * b), 0D, (s, v) -> s + v)"
    if log_target:
        guess = f"exp(least(700D, {guess}))"
    tested = shaped.join(fits, [*keys, "fold"]).selectExpr(*keys, "fold", "y", f"{guess} as _g")
    per_fold = tested.groupBy(*keys, "fold").agg(
        F.expr("count(*) as n"), F.expr("sum((y - _g) * (y - _g)) as rss"), F.expr("sum(abs(y - _g)) as ae"),
        F.expr("var_pop(y) * count(*) as tss"),
    )
    return per_fold.groupBy(*keys).agg(
        F.lit(name).alias("model"), F.expr("sum(n) as n_samples"),
        F.expr("avg(if(tss > 1e-12, 1 - rss / tss, null)) as cv_r2"), F.expr("avg(sqrt(rss / n)) as cv_rmse"), F.expr("avg(ae / n) as cv_mae"),
    )


def poly_aic(df: DataFrame, keys: Sequence[str], x: str, y: str, max_degree: int = 3) -> DataFrame:
    """AIC of polynomials up to a degree from power sums, and the degree with the least.

    Sums are taken on x moved to its mean and scaled by its spread, which keeps the systems well
    conditioned; AIC = n ln(max(RSS / n, 1e-12)) + 2 (degree + 1).
    """
    rows = df.filter(f"{x} is not null and {y} is not null").selectExpr(*keys, f"cast({x} as double) as x", f"cast({y} as double) as y")
    centre = rows.groupBy(*keys).agg(F.expr("avg(x) as mx"), F.expr("stddev_pop(x) as sx"), F.expr("avg(y) as my"))
    moved = attach(rows, centre, keys).selectExpr(*keys, "if(sx > 1e-12, (x - mx) / sx, 0D) as u", "y - my as v")
    powers = moved.groupBy(*keys).agg(
        F.expr("count(*) as n"), F.expr("sum(v * v) as vv"), F.expr("count(distinct round(u, 12)) as n_x"),
        *[F.expr(f"sum(pow(u, {k})) as u{k}") for k in range(2 * max_degree + 1)],
        *[F.expr(f"sum(pow(u, {k}) * v) as uv{k}") for k in range(max_degree + 1)],
    )

    def solve(batches):
        """Row by row: one tiny normal system per degree."""
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                for degree in range(1, max_degree + 1):
                    if row["n_x"] <= degree:
                        continue
                    gram = np.array([[row[f"u{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
                    rhs = np.array([row[f"uv{i}"] for i in range(degree + 1)])
                    rss = max(0.0, row["vv"] - float(rhs @ np.linalg.solve(gram, rhs)))
                    aic = row["n"] * np.log(max(rss / row["n"], 1e-12)) + 2 * (degree + 1)
                    out.append([row[k] for k in keys] + [degree, int(row["n"]), rss, float(aic)])
            yield pd.DataFrame(out, columns=[*keys, "degree", "n", "rss", "aic"])

    key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    fitted = powers.mapInPandas(solve, f"{key_types}, degree int, n long, rss double, aic double")
    least = fitted.groupBy(*keys).agg(F.expr("min(struct(aic, degree)) as b"))
    return attach(fitted, least, keys).withColumn("selected", F.expr("degree = b.degree")).drop("b")


def exp_offset_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, rates: Sequence[float]) -> DataFrame:
    """y = a exp(-b x) + c: for each b of a grid the best a and c follow in closed form; least error wins.

    Rows are first reduced to sums per distinct x, so the grid multiplies levels, not rows.
    """
    rows = df.filter(f"{x} is not null and {y} is not null").selectExpr(*keys, f"cast({x} as double) as x", f"cast({y} as double) as y")
    cells = rows.groupBy(*keys, "x").agg(F.expr("count(*) as w"), F.expr("sum(y) as sy"), F.expr("sum(y * y) as syy"))
    grid = ", ".join(f"{float(r)}D" for r in rates)
    tried = cells.selectExpr(*keys, "x", "w", "sy", "syy", f"explode(array({grid})) as b").selectExpr("*", "exp(-b * x) as z")
    sums = tried.groupBy(*keys, "b").agg(
        F.expr("sum(w) as n"), F.expr("sum(w * z) as sz"), F.expr("sum(w * z * z) as szz"), F.expr("sum(sy) as sy"),
        F.expr("sum(z * sy) as szy"), F.expr("sum(syy) as syy"),
    )
    solved = sums.selectExpr(
        *keys, "b", "n", "sz", "szz", "sy", "szy", "syy", "n * szz - sz * sz as det"
    ).filter("det > 1e-9").selectExpr(*keys, "b", "n", "sz", "sy", "szy", "syy", "szz", "(n * szy - sz * sy) / det as a")
    solved = solved.selectExpr("*", "(sy - a * sz) / n as c")
    scored = solved.selectExpr(
        *keys, "b", "a", "c", "n", "greatest(0D, syy - a * szy - c * sy) as sse", "syy - sy * sy / n as tss"
    )
    best = scored.groupBy(*keys).agg(F.expr("min(struct(round(sse, 6) as e, b, a, c, n, sse, tss)) as f"))
    return best.selectExpr(*keys, "f.b as b", "f.a as a", "f.c as c", "f.n as n", "if(f.tss > 1e-12, 1 - f.sse / f.tss, null) as r_squared",
                           "sqrt(f.sse / f.n) as rmse")


def exp_offset_continuous(df: DataFrame, keys: Sequence[str], x: str, y: str, rounds: int = 7) -> DataFrame:
    """y = a exp(-b x) + c with any rate b, or y = p0 + p1 x + p2 x^2 where no rate is best; one row per group.

    For a given rate, a and c follow in closed form from sums per distinct x, and so does the slope of the error
    in the rate. A coarse grid of rates (over the span of x, both signs) brackets the least error; each further
    round cuts the bracket by 16 at the change of sign of the slope. All groups go through a round together, as one aggregation.
    A group whose best rate lies on the edge of the grid (a straight line, a step) or that has fewer than four
    distinct x gets the quadratic. ``loo_rmse`` divides each residual by one minus its hat value (of the fit
    linearised in its three parameters); it is null where a single row fixes a parameter, as are ``r_squared`` of a constant y.
    Rows with a missing x or y are left out.
    """
    rows = df.filter(f"nanvl(cast({x} as double), null) is not null and nanvl(cast({y} as double), null) is not null").selectExpr(
        *keys, f"cast({x} as double) as x", f"cast({y} as double) as y")
    spread = rows.groupBy(*keys).agg(F.expr("min(x) as x0"), F.expr("if(max(x) > min(x), max(x) - min(x), 1D) as span"), F.expr("avg(y) as my"))
    moved = attach(rows, spread, keys).selectExpr(*keys, "x0", "span", "my", "(x - x0) / span as u", "y - my as v")
    cells = pinned(moved.groupBy(*keys, "x0", "span", "my", "u").agg(F.expr("count(*) as w"), F.expr("sum(v) as sv"), F.expr("sum(v * v) as svv")))

    def at_rates(rates: DataFrame, extra: Sequence[str]) -> DataFrame:
        """a, c, the error and half its slope for every (group, rate)."""
        placed = _joined(cells, rates, keys).selectExpr(*keys, *extra, "rate", "u", "w", "sv", "svv", "exp(-rate * u) as z")
        sums = placed.groupBy(*keys, *extra, "rate").agg(*[F.expr(f"sum({e}) as {n}") for n, e in {
            "n": "w", "z1": "w * z", "z2": "w * z * z", "y0": "sv", "y1": "z * sv", "yy": "svv", "uz1": "w * u * z",
            "uz2": "w * u * z * z", "uy": "u * z * sv"}.items()])
        solved = sums.filter("n * z2 - z1 * z1 > 1e-13 * n * z2").selectExpr("*", "(n * y1 - z1 * y0) / (n * z2 - z1 * z1) as a")
        return solved.selectExpr("*", "(y0 - a * z1) / n as c").selectExpr(
            *keys, *extra, "rate", "a", "c", "yy - a * y1 - c * y0 as sse", "a * (uy - a * uz2 - c * uz1) as slope")

    # The coarse grid: rates times the span of x, 0.01 to 100 falling and 0.01 to 20 rising, nothing at 0.
    coarse = sorted([10 ** (-2 + i / 10) for i in range(41)] + [-(10 ** (-2 + i / 10)) for i in range(34)])
    inner = {i for i, r in enumerate(coarse) if abs(r) == min(abs(c) for c in coarse)} | {0, len(coarse) - 1}
    groups = cells.groupBy(*keys).agg(F.expr("count(*) as n_x"))
    grid = "array(" + ", ".join(f"{r!r}D" for r in coarse) + ")"
    first = at_rates(groups.filter("n_x >= 4").selectExpr(*keys, f"posexplode({grid}) as (i, rate)"), ["i"])
    best = first.groupBy(*keys).agg(F.expr("min(struct(sse, i)).i as i"))
    bracket = pinned(best.filter(~F.col("i").isin(sorted(inner))).selectExpr(*keys, f"{grid}[i - 1] as lo", f"{grid}[i + 1] as hi"))
    for _ in range(rounds):
        tried = bracket.selectExpr(*keys, "lo", "hi", "explode(sequence(1, 15)) as k").selectExpr(*keys, "lo", "hi", "lo + (hi - lo) * k / 16 as rate")
        risen = at_rates(tried, ["lo", "hi"]).groupBy(*keys, "lo", "hi").agg(F.expr("coalesce(min(if(slope >= 0, rate, null)), hi) as up"))
        bracket = pinned(risen.selectExpr(*keys, "up - (hi - lo) / 16 as lo", "up as hi"))
    rated = at_rates(bracket.selectExpr(*keys, "(lo + hi) / 2 as rate"), []).select(*keys, "rate", "a", "c")
    basis = attach(cells, rated, keys).selectExpr("*", "if(rate is null, 1D, exp(-rate * u)) as j0").selectExpr(
        "*", "if(rate is null, u, -a * u * j0) as j1", "if(rate is null, u * u, 1D) as j2")
    grams = basis.groupBy(*keys, "x0", "span", "my", "rate", "a", "c").agg(
        *[F.expr(f"sum(w * j{i} * j{k}) as m{i}{k}") for i in range(3) for k in range(i, 3)], *[F.expr(f"sum(j{i} * sv) as r{i}") for i in range(3)])

    def invert(batches):
        """Row by row: one system of three."""
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                gram = np.array([[row[f"m{min(i, k)}{max(i, k)}"] for k in range(3)] for i in range(3)])
                scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
                inverse = np.linalg.pinv(gram / np.outer(scale, scale), rcond=1e-13, hermitian=True) / np.outer(scale, scale)
                out.append([row[k] for k in keys] + [inverse.ravel().tolist(), (inverse @ [row["r0"], row["r1"], row["r2"]]).tolist()])
            yield pd.DataFrame(out, columns=[*keys, "inv", "p"])

    key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    solved = pinned(grams.mapInPandas(invert, f"{key_types}, inv array<double>, p array<double>"))
    guessed = attach(basis, solved, keys).selectExpr(
        "*", "if(rate is null, p[0] + p[1] * u + p[2] * u * u, a * j0 + c) as f",
        "aggregate(sequence(0, 8), 0D, (s, e) -> s + inv[e] * array(j0, j1, j2)[e div 3] * array(j0, j1, j2)[e % 3]) as hat",
    ).selectExpr("*", "greatest(0D, svv - 2 * f * sv + w * f * f) as err")
    scored = guessed.groupBy(*keys, "x0", "span", "my", "rate", "a", "c", "p").agg(
        F.expr("sum(w) as n"), F.expr("sum(err) as sse"), F.expr("sum(svv) as tss"),
        F.expr("if(bool_or(hat > 1 - 1e-9), null, sum(try_divide(err, (1 - hat) * (1 - hat)))) as loo"))
    return scored.selectExpr(
        *keys, "if(rate is null, 'quadratic', 'exponential_offset') as model", "n", "rate / span as b", "a * exp(rate / span * x0) as a", "c + my as c",
        "if(rate is null, p[0] + my - p[1] * x0 / span + p[2] * x0 * x0 / (span * span), null) as p0",
        "if(rate is null, p[1] / span - 2 * p[2] * x0 / (span * span), null) as p1", "if(rate is null, p[2] / (span * span), null) as p2",
        "if(tss > 1e-12, 1 - sse / tss, null) as r_squared", "sqrt(sse / n) as rmse", "sqrt(loo / n) as loo_rmse")


def _joined(cells: DataFrame, rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    named = rates.withColumnsRenamed({k: f"_k{k}" for k in keys})
    return cells.join(named, [cells[k].eqNullSafe(named[f"_k{k}"]) for k in keys]).drop(*[f"_k{k}" for k in keys])


def fitted_curve(fits: DataFrame, keys: Sequence[str], low: float, high: float, points: int = 300) -> DataFrame:
    """The fitted curve on an even grid."""
    step = (high - low) / (points - 1)
    return fits.selectExpr(*keys, "a", "b", "c", f"explode(sequence(0, {points - 1})) as i").selectExpr(
        *keys, f"{low}D + i * {step}D as x", f"a * exp(-b * ({low}D + i * {step}D)) + c as y"
    )
