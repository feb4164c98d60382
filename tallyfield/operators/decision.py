"""Scores, weights, ranks and risk bands.

Weights are drawn from repeatable hashes: a table of draws has as many rows as the parameter says, whatever the data. Only
cases that can win are scored, as small matrices inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.scalars import mixed
from tallyfield.operators.ordered import attach, numbered, value_ranks
from tallyfield.operators.topk import top_n_per_group
from tallyfield.session import pinned

#: Random weightings unless told otherwise.
DRAWS = 10_000

# Rule sets for a component without spread and for a missing value, by name.
MINMAX_RULES = {
    "middle": {"constant": 0.5, "null": "zero"},
    "full": {"constant": 1.0, "null": "worst"},
    "none": {"constant": 0.0, "null": "keep"},
    "middle_keep": {"constant": 0.5, "null": "keep"},
    "censored_zero": {"constant": 0.5, "null": "final_zero"},
}


def settled(value: Column, digits: int = 9) -> Column:
    """Rounded as SQL engines round a double: scaled, then half away from zero.

    Spark's own round goes by the shortest decimal text of the number, which takes a value within a rounding error of the middle the other way.
    """
    scale = F.lit(10.0**digits)
    whole = F.floor(F.abs(value) * scale + 0.5) / scale
    return F.when(F.abs(value) * scale < 2.0**52, F.when(value < 0, -whole).otherwise(whole)).otherwise(value)


def minmax(df: DataFrame, keys: Sequence[str], columns: Mapping[str, tuple], rule: str = "middle") -> DataFrame:
    """Add scaled columns: ``columns`` maps output -> (source, invert) or (source, invert, own rule).

    Bounds of all sources come from one aggregation. Null rules: ``zero`` before inversion (so 1
    after), ``worst`` end of the range, ``final_zero`` after inversion, or ``keep`` NULL.
    """
    sources = sorted({spec[0] for spec in columns.values()})
    clean = {s: f"nanvl(cast({s} as double), null)" for s in sources}
    bounds = df.groupBy(*keys).agg(
        *[F.expr(f"min({clean[s]}) as _lo_{s}") for s in sources], *[F.expr(f"max({clean[s]}) as _hi_{s}") for s in sources]
    )
    joined = attach(df, bounds, keys)
    adds = []
    for name, (s, invert, *own) in columns.items():
        rules = MINMAX_RULES[own[0] if own else rule]
        x = clean[s]
        if rules["null"] == "worst":
            x = f"coalesce({x}, _hi_{s})" if invert else f"coalesce({x}, _lo_{s})"
        scaled = f"if(_hi_{s} > _lo_{s}, ({x} - _lo_{s}) / (_hi_{s} - _lo_{s}), if({x} is null, null, {rules['constant']}D))"
        if rules["null"] == "zero":
            scaled = f"if(_hi_{s} > _lo_{s}, coalesce({scaled}, 0D), {rules['constant']}D)"
        if invert:
            scaled = f"1 - ({scaled})"
        if rules["null"] == "final_zero":
            scaled = f"coalesce({scaled}, 0D)"
        adds.append(f"{scaled} as {name}")
    return joined.selectExpr("*", *adds).drop(*[f"_{e}_{s}" for s in sources for e in ("lo", "hi")])


# Weights of the burden parts, of the performance and resource pillars, and the
# declared shares of performance per profile.
BURDEN_WEIGHTS = {"satellites": 0.40, "central_nodes": 0.20, "data": 0.20, "events": 0.20}
PERFORMANCE_WEIGHTS = {"observation": 0.25, "s100": 0.25, "coverage": 0.25, "timeliness": 0.25}
PROFILES = {
    "resource_only": 0.0, "cost_dominant": 0.25, "balanced": 0.5, "performance_dominant": 0.75, "performance_only": 1.0,
}


def resource_burden(df: DataFrame, keys: Sequence[str], sources: Mapping[str, str]) -> DataFrame:
    """Weighted sum of scaled resource columns; ``sources``: part of the burden -> column."""
    scaled = minmax(df, keys, {f"burden_{p}": (sources[p], False) for p in BURDEN_WEIGHTS}, "full")
    total = " + ".join(f"{w} * burden_{p}" for p, w in BURDEN_WEIGHTS.items())
    return scaled.selectExpr("*", f"{total} as resource_burden")


def _exponential(seed: int, draw: str, index: int) -> Column:
    """-ln(u) of a repeatable uniform for (draw, index), rounded so that engines agree on the last digits."""
    u = (mixed(F.lit(seed), F.col(draw), F.lit(index)) + 0.5) / F.lit(2147483647.0)
    return F.round(-F.log(u), 9)


def with_draws(df: DataFrame, draws: int, shapes: Sequence[int], seed: int, prefix: str = "w") -> DataFrame:
    """Each row under each of ``draws`` weight vectors: Dirichlet with whole-number shapes.

    A gamma of shape k is the sum of k exponentials; dividing by the sum gives the weights. The
    vectors are made once, as one row holding an array whose length is the parameter, and unfolded
    next to every candidate.
    """
    made = df.sparkSession.range(draws).selectExpr("cast(id as int) as draw")
    parts, index = {}, 0
    for i, shape in enumerate(shapes):
        total = _exponential(seed, "draw", index)
        for k in range(1, shape):
            total = total + _exponential(seed, "draw", index + k)
        parts[f"_g{i}"] = total
        index += shape
    whole = " + ".join(parts)
    vectors = made.withColumns(parts).selectExpr("draw", *[f"{g} / ({whole}) as {prefix}{i}" for i, g in enumerate(parts)])
    one = vectors.agg(F.collect_list(F.struct(*vectors.columns)).alias("_draws"))
    return attach(df, one, []).selectExpr(*df.columns, "inline(_draws)")


#: Cases per group that others are held against, for each ordering (every component, and their sum).
GUARDS = 64
#: A case is surely ahead of another if it is better by this in every component: scores are rounded to 9 digits.
MARGIN = 1e-6
#: Draws are unfolded in slices of so many, so that a task holds scores of a bounded matrix.
DRAWS_A_SLICE = 250


def contenders(df: DataFrame, region: str, case: str, components: Sequence[str], top: int, guards: int = GUARDS) -> DataFrame:
    """The cases that can be among the first ``top`` under some weights; a necessary condition, so none that can is lost.

    Weights are positive and sum to 1, so a case is behind another under all of them if it is nowhere better and, to be safe from rounding and ties,
    either worse by ``MARGIN`` everywhere or of the greater name. A case with ``top`` such others is left out. It is held
    against a bounded list of strong cases per group, which travels as one array; the list of the remaining cases is drawn again for a second turn.
    """
    rows = df.select(region, case, *components)
    for turn in range(2):
        orders = [*components, " + ".join(components)]
        strong = None
        for order in orders:
            part = top_n_per_group(rows, [region], [F.expr(order).desc(), F.col(case)], guards * (1 + 3 * turn), "_place").drop("_place")
            strong = part if strong is None else strong.unionByName(part)
        lists = strong.distinct().groupBy(region).agg(F.collect_list(F.struct(F.col(case).alias("name"), *[F.col(c).alias(c) for c in components])).alias("_strong"))
        nowhere = " and ".join(f"g.{c} >= {c}" for c in components)
        ahead = " and ".join(f"g.{c} >= {c} + {MARGIN}D" for c in components)
        sure = f"{nowhere} and (g.name < {case} or ({ahead}))"
        rows = pinned(attach(rows, lists, [region]).filter(f"size(filter(_strong, g -> {sure})) < {top}").drop("_strong"))
    return rows


def weight_vectors(spark, draws: int, shapes: Sequence[int], seed: int) -> np.ndarray:
    """(draw, part): the weights of :func:`with_draws` as a matrix; as many rows as the parameter says."""
    parts, index = [], 0
    for i, shape in enumerate(shapes):
        total = _exponential(seed, "draw", index)
        for k in range(1, shape):
            total = total + _exponential(seed, "draw", index + k)
        parts.append(total.alias(f"g{i}"))
        index += shape
    rows = spark.range(draws).selectExpr("cast(id as int) as draw").select("draw", *parts).orderBy("draw").collect()
    gammas = np.array([[r[f"g{i}"] for i in range(len(shapes))] for r in rows], float).reshape(draws, len(shapes))
    total = gammas[:, 0]
    for i in range(1, len(shapes)):  # in the order of the parts
        total = total + gammas[:, i]
    return gammas / total[:, None]


def _settle(scores: np.ndarray) -> np.ndarray:
    """Rounded half up to 9 digits, as both engines round these positive numbers."""
    return np.floor(scores * 1e9 + 0.5) / 1e9


def leaders(rows: DataFrame, region: str, case: str, columns: Sequence[str], score, draws: int, top: int) -> DataFrame:
    """(region, draw, case, score, place): the first ``top`` cases of every draw, ties to the smaller case.

    ``score(values, from, to)`` gives the scores of a matrix of cases under a slice of the draws, as (draw, case). Each task scores its own rows once and gives out its
    own first ``top`` per draw; those meet by (region, draw).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[object, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for key, part in batch.groupby(region, dropna=False):
                part = part.sort_values(case)
                names, values = part[case].to_numpy(object), part[list(columns)].to_numpy(float)
                held = best.get(key)
                scores, kept = np.empty((draws, 0)), np.empty((draws, 0), object)
                news, named = [], []
                for a in range(0, draws, DRAWS_A_SLICE):
                    made = score(values, a, min(draws, a + DRAWS_A_SLICE))
                    order = np.argsort(-made, axis=1, kind="stable")[:, :top]  # equal scores stay in order of names
                    news.append(np.take_along_axis(made, order, axis=1))
                    named.append(names[order])
                scores, kept = np.vstack(news), np.vstack(named)
                if held is not None:
                    scores, kept = np.hstack([held[0], scores]), np.hstack([held[1], kept])
                    order = np.array([sorted(range(len(s)), key=lambda j, s=s, k=k: (-s[j], k[j]))[:top] for s, k in zip(scores, kept)])
                    scores, kept = np.take_along_axis(scores, order, axis=1), np.take_along_axis(kept, order, axis=1)
                best[key] = scores, kept
        for key, (scores, kept) in best.items():
            n = scores.shape[1]
            named = pd.Series([None if pd.isna(key) else key] * (draws * n), dtype=object)
            yield pd.DataFrame({region: named, "draw": np.repeat(np.arange(draws, dtype=np.int32), n), case: pd.Series(kept.ravel(), dtype=object), "score": scores.ravel()})

    kinds = dict(rows.dtypes)
    found = rows.select(region, case, *columns).mapInPandas(run, f"{region} {kinds[region]}, draw int, {case} {kinds[case]}, score double")
    place = F.row_number().over(Window.partitionBy(region, "draw").orderBy(F.desc("score"), case))
    return found.withColumn("place", place).filter(f"place <= {top}")


def _drawn(df: DataFrame, region: str, case: str, components: Sequence[str], draws: int, seed: int, top: int) -> DataFrame:
    """The first ``top`` cases of every draw of Dirichlet(1) weights over ``components``, from the cases that can get there."""
    weights = weight_vectors(df.sparkSession, draws, [1] * len(components), seed)

    def score(values: np.ndarray, a: int, b: int) -> np.ndarray:
        total = weights[a:b, 0, None] * values[:, 0]
        for i in range(1, values.shape[1]):  # summed in the order of the components
            total = total + weights[a:b, i, None] * values[:, i]
        return _settle(total)

    return leaders(contenders(df, region, case, components, top), region, case, components, score, draws, top)


def _scored(df: DataFrame, region: str, case: str, components: Sequence[str], draws: int, seed: int) -> DataFrame:
    total = " + ".join(f"w{i} * {c}" for i, c in enumerate(components))
    drawn = with_draws(df.select(region, case, *components), draws, [1] * len(components), seed)
    return drawn.select(region, case, "draw", settled(F.expr(total)).alias("score"))


def blend_winners(df: DataFrame, region: str, case: str, first: str, second: str, shares: Sequence[float]) -> DataFrame:
    """(region, draw, winner, score): the best case by share * first + (1 - share) * second for each share, ``draw`` its place in ``shares``.

    Ties go to the smaller case; a case without one of the two has no score. As with drawn weights, only cases that can win are scored, inside tasks.
    """
    part = np.array(list(shares), float)

    def score(values: np.ndarray, a: int, b: int) -> np.ndarray:
        return _settle(part[a:b, None] * values[:, 0] + (1 - part[a:b, None]) * values[:, 1])

    clean = [f"nanvl(cast({c} as double), null) as {n}" for c, n in ((first, "_a"), (second, "_b"))]
    known = df.selectExpr(region, case, *clean).dropna(subset=["_a", "_b"])
    best = leaders(contenders(known, region, case, ["_a", "_b"], 1), region, case, ["_a", "_b"], score, len(part), 1)
    return best.selectExpr(region, "draw", f"{case} as winner", "score")


def rank_acceptability(
    df: DataFrame, region: str, case: str, components: Sequence[str], draws: int = DRAWS, top: int = 5, seed: int = 11
) -> DataFrame:
    """Share of random weightings in which a case is first, and among the first ``top``; and the
    equal-weight score with its rank. Ties go to the smaller case.

    Only cases that can be among the first ``top`` meet the draws, see :func:`contenders`, and no draw is ranked in full.
    """
    df = pinned(df.select(region, case, *components))
    best = _drawn(df, region, case, components, draws, seed, top)
    wins = best.groupBy(region, case).agg(
        F.expr(f"100D * count_if(place = 1) / {draws} as rank1_percent"), F.expr(f"100D * count(*) / {draws} as top{top}_percent")
    )
    equal = df.select(region, case, settled(F.expr(f"({' + '.join(components)}) / {len(components)}")).alias("equal_score"))
    negated = equal.withColumn("_neg", -F.col("equal_score"))
    ranks = value_ranks(negated, [region], "_neg").select(region, "_neg", F.col("rank_min").alias("equal_rank"))
    out = attach(attach(negated, ranks, [region, "_neg"]).drop("_neg"), wins, [region, case])
    return out.na.fill(0.0, ["rank1_percent", f"top{top}_percent"])


def rank_distribution(
    df: DataFrame, region: str, case: str, components: Sequence[str], draws: int = 50, seed: int = 11
) -> DataFrame:
    """Full rank statistics of each case over the draws: mean, median, p05, p95, min, max, and the number of draws.

    Ranking every draw in full needs a sort of draws x cases rows; it is spread over ranges.
    """
    scored = _scored(df, region, case, components, draws, seed)
    placed = numbered(scored, [region, "draw"], [F.col("score").desc(), F.col(case)], "place")
    places = placed.groupBy(region, case).agg(F.expr("array_sort(collect_list(place)) as _p"))  # as many as the parameter says

    def at(p: float) -> str:
        here = f"((size(_p) - 1) * {p}D)"
        low, high = (f"_p[cast({side}({here}) as int)]" for side in ("floor", "ceil"))
        return f"{low} + ({high} - {low}) * ({here} - floor({here}))"

    return places.selectExpr(
        region, case, "aggregate(_p, 0L, (s, v) -> s + v) / size(_p) as mean_rank", f"{at(0.5)} as median_rank", f"{at(0.05)} as p05_rank",
        f"{at(0.95)} as p95_rank", "_p[0] as min_rank", "_p[size(_p) - 1] as max_rank", f"{draws} as draws")


def draw_winners(df: DataFrame, region: str, case: str, components: Sequence[str], draws: int = DRAWS, seed: int = 11) -> DataFrame:
    """(region, draw, winner, score, w0, w1, ..): the best case of every draw beside the weights that chose it. Ties go to the smaller case."""
    best = _drawn(df, region, case, components, draws, seed, 1).selectExpr(region, "draw", f"{case} as winner", "score")
    weights = weight_vectors(df.sparkSession, draws, [1] * len(components), seed)
    names = [f"w{i}" for i in range(len(components))]
    rows = df.sparkSession.createDataFrame(pd.DataFrame({"draw": np.arange(draws, dtype=np.int32), **dict(zip(names, weights.T))}), f"draw int, {', '.join(f'{n} double' for n in names)}")
    return best.join(F.broadcast(rows), "draw").select(region, "draw", "winner", "score", *names)  # as many rows as the parameter says


def weight_sweep(df: DataFrame, region: str, case: str, first: str, second: str, steps: int = 101) -> DataFrame:
    """Winner for each weight of ``first`` on an even grid over [0, 1] (``second`` takes the rest)."""
    best = blend_winners(df, region, case, first, second, [step / (steps - 1) for step in range(steps)])
    return best.selectExpr(region, "draw as step", f"draw / {steps - 1}D as weight", "winner", "score as utility")


def pillars(df: DataFrame, keys: Sequence[str], sources: Mapping[str, str]) -> DataFrame:
    """Performance and resource-efficiency composites; a censored time scores zero."""
    benefits = {f"p_{n}": (sources[n], n == "timeliness", "censored_zero") for n in PERFORMANCE_WEIGHTS}
    savings = {f"r_{n}": (sources[n], True, "middle_keep") for n in BURDEN_WEIGHTS}
    both = minmax(df, keys, {**benefits, **savings})
    p = " + ".join(f"{w} * p_{n}" for n, w in PERFORMANCE_WEIGHTS.items())
    r = " + ".join(f"{w} * r_{n}" for n, w in BURDEN_WEIGHTS.items())
    return both.selectExpr("*", f"{p} as performance", f"{r} as efficiency")


def profile_winners(scored: DataFrame, region: str, case: str) -> DataFrame:
    """Best case of each declared profile by share * performance + (1 - share) * efficiency."""
    names, shares = (", ".join(x) for x in ([f"'{n}'" for n in PROFILES], [f"{v}D" for v in PROFILES.values()]))
    best = blend_winners(scored, region, case, "performance", "efficiency", list(PROFILES.values()))
    return best.selectExpr(region, f"element_at(array({names}), draw + 1) as profile", f"element_at(array({shares}), draw + 1) as share", "winner", "score as utility")


def random_utility(scored: DataFrame, region: str, case: str, draws: int = DRAWS, seed: int = 23) -> DataFrame:
    """Winner shares under uniform lambda, Dirichlet(1,1,1,1) performance and Dirichlet(4,2,2,2) resource weights."""
    p = [f"p_{n}" for n in PERFORMANCE_WEIGHTS]
    r = [f"r_{n}" for n in BURDEN_WEIGHTS]
    spark = scored.sparkSession
    # One Dirichlet of all parts, split and renormalised, is a pair of independent Dirichlets.
    weights = weight_vectors(spark, draws, (1, 1, 1, 1, 4, 2, 2, 2), seed)
    share = (mixed(F.lit(seed + 1), F.col("id")) + 0.5) / F.lit(2147483647.0)
    lam = np.array([x["lam"] for x in spark.range(draws).select("id", share.alias("lam")).orderBy("id").collect()])

    def part(values: np.ndarray, a: int, b: int, at: range) -> np.ndarray:
        total, weight = weights[a:b, at[0], None] * values[:, at[0]], weights[a:b, at[0]]
        for i in at[1:]:
            total, weight = total + weights[a:b, i, None] * values[:, i], weight + weights[a:b, i]
        return total, weight[:, None]

    def score(values: np.ndarray, a: int, b: int) -> np.ndarray:
        (pw, ps), (rw, rs) = part(values, a, b, range(len(p))), part(values, a, b, range(len(p), len(p) + len(r)))
        made = lam[a:b, None] * pw / ps + (1 - lam[a:b, None]) * rw / rs
        return np.where(np.isnan(made), -np.inf, _settle(made))

    known = scored.select(region, case, *p, *r).dropna(subset=[*p, *r])  # a case without a component has no score
    best = leaders(contenders(known, region, case, [*p, *r], 1), region, case, [*p, *r], score, draws, 1)
    return best.groupBy(region, case).agg(F.expr("count(*) as wins"), F.expr(f"100D * count(*) / {draws} as win_percent"))


# The proposed objective families as (family, measure, direction, weight).
OBJECTIVE_FAMILIES = (
    ("Mission success", "s100_surviving_by_deadline_percent", "maximise", 0.25),
    ("Observation", "observation_success_percent", "maximise", 0.20),
    ("Timeliness", "p100_t100_surviving_min", "minimise", 0.20),
    ("Resource efficiency", "composite of n_satellites, n_central_nodes, transferred_mbits", "maximise", 0.20),
    ("Robustness", "mean retention area over failure families", "maximise", 0.15),
)


def weighting_proposal(redundancy: DataFrame) -> DataFrame:
    """The declared families, each flagged if its measure names a metric of a redundant pair.

    All pairs are reduced to one row of flags; the families are exploded onto it.
    """
    named = redundancy.filter("possible_double_counting").selectExpr("explode(array(metric_a, metric_b)) as m").distinct()
    metrics = named.agg(F.expr("collect_set(m) as flagged"))
    items = ", ".join(
        f"named_struct('family', '{f}', 'measure', '{m}', 'direction', '{d}', 'weight', {w}D)" for f, m, d, w in OBJECTIVE_FAMILIES
    )
    return metrics.selectExpr("flagged", f"inline(array({items}))").selectExpr(
        "family", "measure", "direction", "weight", "exists(flagged, m -> contains(measure, m)) as redundancy_flag"
    )


# Lower bounds (percentage points of mean loss) of the consequence scores 2 to 5, and
# the score from which a screening result counts as Moderate or High.
CONSEQUENCE_BOUNDS = (2.0, 5.0, 10.0, 20.0)
CONSEQUENCE_NAMES = ("Negligible", "Minor", "Moderate", "Major", "Severe")
SCREENING_BANDS = ((10, "High"), (5, "Moderate"), (0, "Low"))


def risk_screen(losses: DataFrame, loss: str, likelihood: Mapping[str, int], family: str = "family") -> DataFrame:
    """Consequence band of the mean loss times a declared likelihood per family."""
    score = "1 + " + " + ".join(f"cast({loss} >= {b} as int)" for b in CONSEQUENCE_BOUNDS)
    names = ", ".join(f"'{n}'" for n in CONSEQUENCE_NAMES)
    chance = " ".join(f"when '{f}' then {v}" for f, v in likelihood.items())
    bands = " ".join(f"when screening_score >= {b} then '{n}'" for b, n in SCREENING_BANDS)
    scored = losses.selectExpr("*", f"{score} as consequence_score", f"case {family} {chance} end as likelihood_score")
    return scored.selectExpr(
        "*", f"element_at(array({names}), consequence_score) as consequence", "consequence_score * likelihood_score as screening_score"
    ).selectExpr("*", f"case {bands} end as screening")
