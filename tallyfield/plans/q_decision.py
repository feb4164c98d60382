"""Resampling, scores, fronts, fits and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import aggregates as agg
from tallyfield.operators import contacts, decision, grid, models, resample, robust, skyline, topk, windows
from tallyfield.operators.correlation import all_pairs
from tallyfield.operators.decision import DRAWS as DRAWS_OF_WEIGHTS
from tallyfield.operators.resample import DRAWS
from tallyfield.plans import views as V
from tallyfield.plans.q_aggregates import COV, EVENTS, MBIT, OBS, PRIMARY, S100, STRESS, T100, corr_sql
from tallyfield.plans.draws import _mix, bootstrap_sql, interval_sql
from tallyfield.plans.registry import query
from tallyfield.plans.shape import rounded

UNLIMITED = "scenario_id = 'unlimited_useful_deadline'"
CELL = ["family", "failure_level_percent"]
PAIRS = [("nominal_original", "unlimited_useful_deadline"), ("policy_central", "policy_peer"), ("policy_central", "policy_hybrid")]


@query("M01_bootstrap_mean", f"""
WITH {bootstrap_sql("v_case_metrics", "region, scenario_id, cn_fraction_percent", COV, "case_id", DRAWS, 1, "b", PRIMARY)}
SELECT region, scenario_id, cn_fraction_percent, n_units, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM b""")
def bootstrap_mean(spark, sf_dir):
    primary = V.case_table(spark, sf_dir).filter(PRIMARY)
    out = resample.bootstrap_mean(primary, ["region", "scenario_id", "cn_fraction_percent"], [COV], ["case_id"], DRAWS, 1)
    return rounded(out.drop("metric"))


def cluster_sql(source: str, keys: str, cluster: str, value: str, draws: int, seed: int, name: str, where: str = "true") -> str:
    return f"""{name}_u AS MATERIALIZED (SELECT {keys}, {cluster}, sum({value}) AS s, count(*) AS c FROM {source} WHERE {value} IS NOT NULL AND {where} GROUP BY ALL),
{interval_sql(f"{name}_u", keys, cluster, draws, seed, name)}"""


@query("M02_cluster_bootstrap_mean", f"""
WITH {cluster_sql("v_case_metrics", "region, scenario_id", "base_id", OBS, DRAWS, 3, "b", PRIMARY)}
SELECT region, scenario_id, n_units, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM b""")
def cluster_bootstrap_mean(spark, sf_dir):
    primary = V.case_table(spark, sf_dir).filter(PRIMARY)
    return rounded(resample.cluster_bootstrap_mean(primary, ["region", "scenario_id"], "base_id", [OBS], DRAWS, 3).drop("metric"))


def _minmax_sql(column: str, invert: bool, rule: str) -> str:
    rules = decision.MINMAX_RULES[rule]
    w = "OVER (PARTITION BY region)"
    x = column
    if rules["null"] == "worst":
        x = f"coalesce({column}, {'max' if invert else 'min'}({column}) {w})"
    body = f"CASE WHEN max({column}) {w} > min({column}) {w} THEN ({x} - min({column}) {w}) / (max({column}) {w} - min({column}) {w}) WHEN {x} IS NOT NULL THEN {rules['constant']} END"
    if rules["null"] == "zero":
        body = f"CASE WHEN max({column}) {w} > min({column}) {w} THEN coalesce({body}, 0) ELSE {rules['constant']} END"
    if invert:
        body = f"1 - ({body})"
    if rules["null"] == "final_zero":
        body = f"coalesce({body}, 0)"
    return f"({body})"


_RULES = ["middle", "full", "none", "middle_keep", "censored_zero"]


@query("M03_minmax", "SELECT region, case_id, " + ", ".join(
    f"round({_minmax_sql(T100, False, r)}, 6) AS up_{r}, round({_minmax_sql(T100, True, r)}, 6) AS down_{r}" for r in _RULES
) + f" FROM v_case_metrics WHERE {UNLIMITED}")
def minmax(spark, sf_dir):
    rows = V.case_table(spark, sf_dir).filter(UNLIMITED).select("region", "case_id", T100)
    columns = {f"{way}_{rule}": (T100, way == "down", rule) for rule in _RULES for way in ("up", "down")}
    return rounded(decision.minmax(rows, ["region"], columns).drop(T100))


_UP, _DOWN = [OBS, COV], ["n_satellites", "n_central_nodes", MBIT]


def _front_sql(source: str, up, down, keys: str = "region", ident: str = "case_id") -> str:
    at_least = " AND ".join([f"b.{c} >= a.{c}" for c in up] + [f"b.{c} <= a.{c}" for c in down])
    better = " OR ".join([f"b.{c} > a.{c}" for c in up] + [f"b.{c} < a.{c}" for c in down])
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*up, *down])
    return f"""fv AS (SELECT *, row_number() OVER () AS rid FROM (SELECT {keys}, {ident}, {", ".join(f"round({c}, 6) AS {c}" for c in [*up, *down])} FROM {source}) WHERE {known}),
front AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM fv b WHERE b.{keys} = a.{keys} AND {at_least} AND ({better})) AS is_front FROM fv a)"""


def _unlimited(spark, sf_dir):
    return _settled(V.case_table(spark, sf_dir).filter(UNLIMITED))


def _settled(cases):
    """Objectives rounded, so that both engines see the same ties."""
    return cases.withColumns({c: F.expr(f"round(round({c}, 10), 6)") for c in (OBS, S100, COV, T100, MBIT)})


_UNL_SQL = f"u AS (SELECT * FROM v_case_metrics WHERE {UNLIMITED})"


@query("M04_skyline", f"""
WITH {_UNL_SQL}, {_front_sql("u", _UP, _DOWN)} SELECT region, case_id, is_front FROM front""")
def skyline_query(spark, sf_dir):
    return skyline.skyline(_unlimited(spark, sf_dir), ["region"], _UP, _DOWN).select("region", "case_id", "is_front")


@query("M04_skyline_nulls_worst", f"""
WITH {_UNL_SQL}, w AS (SELECT region, case_id, {OBS}, coalesce(-{T100}, '-Infinity'::DOUBLE) AS fast FROM u), {_front_sql("w", [OBS, "fast"], [])}
SELECT region, case_id, is_front FROM front""")
def skyline_nulls_worst(spark, sf_dir):
    out = skyline.skyline(_unlimited(spark, sf_dir), ["region"], [OBS], [T100], "worst")
    return out.select("region", "case_id", "is_front")


@query("M04_two_objective_front", f"""
WITH {_UNL_SQL}, {_front_sql("u", [S100], [MBIT])} SELECT region, case_id, is_front FROM front""")
def two_objective_front(spark, sf_dir):
    return skyline.two_objective_front(_unlimited(spark, sf_dir), ["region"], [S100], [MBIT]).select("region", "case_id", "is_front")


@query("A31_front_composition", f"""
WITH {_UNL_SQL}, {_front_sql("u", _UP, _DOWN, ident="case_id, cn_fraction_percent")}
SELECT region, count(*) AS front_rows, round(median(cn_fraction_percent), 6) AS median_cn_fraction_percent, min(cn_fraction_percent) AS min_cn_fraction_percent, max(cn_fraction_percent) AS max_cn_fraction_percent
FROM front WHERE is_front GROUP BY region""")
def front_composition(spark, sf_dir):
    flagged = skyline.skyline(_unlimited(spark, sf_dir), ["region"], _UP, _DOWN)
    return rounded(agg.front_composition(flagged, ["region"], "is_front", "cn_fraction_percent"))


_BURDEN = {"satellites": "n_satellites", "central_nodes": "n_central_nodes", "data": MBIT, "events": EVENTS}


@query("M05_resource_burden", f"""
WITH {_UNL_SQL} SELECT region, case_id, round({" + ".join(f"{w} * {_minmax_sql(_BURDEN[p], False, 'full')}" for p, w in decision.BURDEN_WEIGHTS.items())}, 6) AS resource_burden FROM u""")
def resource_burden(spark, sf_dir):
    rows = V.case_table(spark, sf_dir).filter(UNLIMITED)
    return rounded(decision.resource_burden(rows, ["region"], _BURDEN).select("region", "case_id", "resource_burden"))


_PARTS = {"c_success": (S100, False), "c_observation": (OBS, False), "c_time": (T100, True), "c_traffic": (MBIT, True)}
_PART_SQL = ", ".join(f"round({_minmax_sql(s, i, 'middle')}, 9) AS {n}" for n, (s, i) in _PARTS.items())


def _components(spark, sf_dir):
    return _scaled(V.case_table(spark, sf_dir).filter(UNLIMITED))


def _scaled(cases):
    return decision.minmax(cases, ["region"], _PARTS, "middle").select("region", "case_id", *[decision.settled(F.col(c)).alias(c) for c in _PARTS])


def _exp_sql(seed: int, draw: str, index: int) -> str:
    first = ((1 * 48271 + seed * 69621 + 12345) % 2147483647)
    first = (first * first + 16807) % 2147483647
    return (f"round(-ln((list_transform([{_mix(str(first), f'{draw}::BIGINT')}], lambda a: list_transform([{_mix('a', str(index))}], "
            f"lambda b: (b * b + b * 48271 + 7) % 2147483647)[1])[1] + 0.5::DOUBLE) / 2147483647.0::DOUBLE), 9)")


def draws_sql(draws: int, shapes, seed: int, prefix: str = "w", name: str = "wd") -> str:
    cols, index = [], 0
    for i, shape in enumerate(shapes):
        cols.append(" + ".join(_exp_sql(seed, "draw", index + k) for k in range(shape)) + f" AS g{i}")
        index += shape
    total = " + ".join(f"g{i}" for i in range(len(shapes)))
    return f"""{name} AS (SELECT draw, {", ".join(f"g{i} / ({total}) AS {prefix}{i}" for i in range(len(shapes)))} FROM (SELECT draw, {", ".join(cols)} FROM range({draws}) t(draw)))"""


def _score_sql(draws: int) -> str:
    return f"""{_UNL_SQL}, k AS (SELECT region, case_id, {_PART_SQL}, row_number() OVER (ORDER BY case_id DESC, region) AS late FROM u), {draws_sql(draws, [1] * 4, 11)},
s AS (SELECT region, case_id, late, draw, {", ".join(f"w{i}" for i in range(4))}, round({" + ".join(f"w{i} * {c}" for i, c in enumerate(_PARTS))}, 9) AS score FROM k, wd)"""


def _top_sql(top: int, score: str = "score") -> str:
    """SQL: r (region, case_id, draw, place), the first ``top`` of every draw: whole numbers made of score and name are combined in place."""
    return f"""m AS (SELECT region, draw, max(CAST(round({score} * 1e9) AS BIGINT) * 10000000 + late, {top}) AS tops FROM s WHERE {score} IS NOT NULL GROUP BY region, draw),
r AS (SELECT region, draw, place, case_id FROM (SELECT region, draw, unnest(tops) % 10000000 AS late, unnest(range(1, len(tops) + 1)) AS place FROM m) JOIN (SELECT late, case_id FROM k) USING (late))"""


@query("M06_rank_acceptability", f"""
WITH {_score_sql(DRAWS_OF_WEIGHTS)}, {_top_sql(5)}, e AS (SELECT region, case_id, round(({" + ".join(_PARTS)}) / 4, 9) AS equal_score FROM k)
SELECT region, case_id, round(equal_score, 6) AS equal_score, equal_rank, round(coalesce(rank1_percent, 0), 6) AS rank1_percent, round(coalesce(top5_percent, 0), 6) AS top5_percent FROM (
  SELECT *, rank() OVER (PARTITION BY region ORDER BY equal_score DESC) AS equal_rank FROM e)
LEFT JOIN (SELECT region, case_id, 100.0::DOUBLE * count(*) FILTER (place = 1) / {DRAWS_OF_WEIGHTS} AS rank1_percent, 100.0::DOUBLE * count(*) FILTER (place <= 5) / {DRAWS_OF_WEIGHTS} AS top5_percent FROM r GROUP BY ALL) USING (region, case_id)""")
def rank_acceptability(spark, sf_dir):
    out = decision.rank_acceptability(_components(spark, sf_dir), "region", "case_id", list(_PARTS), DRAWS_OF_WEIGHTS, 5, 11)
    return rounded(out.select("region", "case_id", "equal_score", "equal_rank", "rank1_percent", "top5_percent"))


@query("M06_rank_distribution", f"""
WITH {_score_sql(10)}, r AS (SELECT *, row_number() OVER (PARTITION BY region, draw ORDER BY score DESC, case_id) AS place FROM s)
SELECT region, case_id, round(avg(place), 6) AS mean_rank, round(quantile_cont(place::DOUBLE, 0.5), 6) AS median_rank, round(quantile_cont(place::DOUBLE, 0.05), 6) AS p05_rank,
       round(quantile_cont(place::DOUBLE, 0.95), 6) AS p95_rank, min(place) AS min_rank, max(place) AS max_rank, 10 AS draws FROM r GROUP BY ALL""")
def rank_distribution(spark, sf_dir):
    return rounded(decision.rank_distribution(_components(spark, sf_dir), "region", "case_id", list(_PARTS), 10, 11))


@query("M06_draw_winners", f"""
WITH {_score_sql(DRAWS_OF_WEIGHTS)}, {_top_sql(1)} SELECT region, draw::INT AS draw, r.case_id AS winner, round(score, 6) AS score, {", ".join(f"round(w{i}, 6) AS w{i}" for i in range(4))} FROM r JOIN s USING (region, draw, case_id)""")
def draw_winners(spark, sf_dir):
    return rounded(decision.draw_winners(_components(spark, sf_dir), "region", "case_id", list(_PARTS), DRAWS_OF_WEIGHTS, 11))


_SWEEP_SQL = f"""{_UNL_SQL}, k AS (SELECT region, case_id, {_PART_SQL} FROM u),
g AS (SELECT region, case_id, step, round(step / 100.0::DOUBLE * c_success + (1 - step / 100.0::DOUBLE) * c_traffic, 9) AS score FROM k, range(101) t(step)),
w AS (SELECT region, step::INT AS step, case_id AS winner, score FROM g QUALIFY row_number() OVER (PARTITION BY region, step ORDER BY score DESC, case_id) = 1)"""


@query("M07_weight_sweep", f"""
WITH {_SWEEP_SQL} SELECT region, step, round(step / 100.0::DOUBLE, 6) AS weight, winner, round(score, 6) AS utility FROM w""")
def weight_sweep(spark, sf_dir):
    return rounded(decision.weight_sweep(_components(spark, sf_dir), "region", "case_id", "c_success", "c_traffic"))


@query("W17_weight_transitions", f"""
WITH {_SWEEP_SQL}, c AS (SELECT *, coalesce(winner <> lag(winner) OVER (PARTITION BY region ORDER BY step), true) AS ch FROM w),
n AS (SELECT *, sum(ch::INT) OVER (PARTITION BY region ORDER BY step)::BIGINT AS run_no FROM c)
SELECT region, run_no, winner, min(step) AS run_start, max(step) AS run_end, count(*) AS n_steps FROM n GROUP BY ALL""")
def weight_transitions(spark, sf_dir):
    sweep = decision.weight_sweep(_components(spark, sf_dir), "region", "case_id", "c_success", "c_traffic")
    return windows.value_runs(sweep.select("region", "step", "winner"), ["region"], "step", "winner")


_PILLAR_SOURCES = {"observation": OBS, "s100": S100, "coverage": COV, "timeliness": T100, **_BURDEN}
_PILLAR_SQL = f"""{_UNL_SQL}, k0 AS (SELECT region, case_id, {", ".join(f"{_minmax_sql(_PILLAR_SOURCES[n], n == 'timeliness', 'censored_zero')} AS p_{n}" for n in decision.PERFORMANCE_WEIGHTS)},
  {", ".join(f"{_minmax_sql(_PILLAR_SOURCES[n], True, 'middle_keep')} AS r_{n}" for n in decision.BURDEN_WEIGHTS)} FROM u),
k AS (SELECT *, {" + ".join(f"{w} * p_{n}" for n, w in decision.PERFORMANCE_WEIGHTS.items())} AS performance, {" + ".join(f"{w} * r_{n}" for n, w in decision.BURDEN_WEIGHTS.items())} AS efficiency FROM k0)"""


@query("M08_profile_winners", f"""
WITH {_PILLAR_SQL}, p AS (SELECT * FROM k, (VALUES {", ".join(f"('{n}', {s}::DOUBLE)" for n, s in decision.PROFILES.items())}) t(profile, share)),
s AS (SELECT *, round(share * performance + (1 - share) * efficiency, 9) AS ut FROM p)
SELECT region, profile, share, case_id AS winner, round(ut, 6) AS utility FROM s QUALIFY row_number() OVER (PARTITION BY region, profile ORDER BY ut DESC, case_id) = 1""")
def profile_winners(spark, sf_dir):
    scored = decision.pillars(V.case_table(spark, sf_dir).filter(UNLIMITED), ["region"], _PILLAR_SOURCES)
    return rounded(decision.profile_winners(scored, "region", "case_id"))


def _lam_sql(seed: int) -> str:
    first = ((1 * 48271 + seed * 69621 + 12345) % 2147483647)
    first = (first * first + 16807) % 2147483647
    return f"((list_transform([{_mix(str(first), 'draw::BIGINT')}], lambda b: (b * b + b * 48271 + 7) % 2147483647)[1] + 0.5::DOUBLE) / 2147483647.0::DOUBLE)"


_PW = " + ".join(f"v{i} * p_{n}" for i, n in enumerate(decision.PERFORMANCE_WEIGHTS))
_RW = " + ".join(f"v{i + 4} * r_{n}" for i, n in enumerate(decision.BURDEN_WEIGHTS))


@query("M08_random_utility", f"""
WITH {_PILLAR_SQL.replace("k AS (SELECT *,", "k AS (SELECT *, row_number() OVER (ORDER BY case_id DESC, region) AS late,")}, {draws_sql(DRAWS_OF_WEIGHTS, (1, 1, 1, 1, 4, 2, 2, 2), 23, "v")},
s AS (SELECT region, case_id, late, draw, round(lam * ({_PW}) / (v0 + v1 + v2 + v3) + (1 - lam) * ({_RW}) / (v4 + v5 + v6 + v7), 9) AS ut FROM k, (SELECT *, {_lam_sql(24)} AS lam FROM wd)),
{_top_sql(1, "ut")}
SELECT region, case_id, count(*) AS wins, round(100.0 * count(*) / {DRAWS_OF_WEIGHTS}, 6) AS win_percent FROM r GROUP BY ALL""")
def random_utility(spark, sf_dir):
    scored = decision.pillars(V.case_table(spark, sf_dir).filter(UNLIMITED), ["region"], _PILLAR_SOURCES)
    return rounded(decision.random_utility(scored, "region", "case_id", DRAWS_OF_WEIGHTS, 23))


_REDUNDANT = [OBS, S100, COV, MBIT, EVENTS]


@query("M09_weighting_proposal", f"""
WITH {corr_sql("v_case_metrics", "", all_pairs(_REDUNDANT), UNLIMITED)}, f AS (
  SELECT unnest([metric_a, metric_b]) AS m FROM r WHERE greatest(abs(pearson), abs(spearman)) >= 0.7)
SELECT family, measure, direction, weight, EXISTS (SELECT 1 FROM f WHERE contains(measure, m)) AS redundancy_flag
FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in decision.OBJECTIVE_FAMILIES)}) t(family, measure, direction, weight)""")
def weighting_proposal(spark, sf_dir):
    from tallyfield.operators.correlation import metric_redundancy

    return decision.weighting_proposal(metric_redundancy(V.case_table(spark, sf_dir).filter(UNLIMITED), [], _REDUNDANT, 0.7))


@query("M10_model_comparison")
def model_comparison(spark, sf_dir):
    """Rows only: cross-validated fits of four models."""
    rows = V.case_table(spark, sf_dir).filter(PRIMARY)
    features = ["n_satellites", "n_planes", "altitude_km", "inclination_deg", "cn_fraction_percent"]
    return rounded(models.model_comparison(rows, ["region", "scenario_id"], features, MBIT, ["case_id", "region"]))


@query("M11_poly_aic", f"""
WITH d AS (SELECT region, scenario_id, cn_fraction_percent AS x, {MBIT} AS y FROM v_case_metrics WHERE {PRIMARY}),
f AS (SELECT region, scenario_id, count(*) AS n, count(*) * regr_sxx(y, x) AS ok, regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS rss FROM d GROUP BY ALL)
SELECT region, scenario_id, 1 AS degree, n, round(rss, 3) AS rss, round(n * ln(greatest(rss / n, 1e-12)) + 4, 4) AS aic FROM f""")
def poly_aic(spark, sf_dir):
    """The check covers degree 1, whose solution SQL has built in; higher degrees are checked by the tests."""
    rows = V.case_metrics(spark, sf_dir).filter(PRIMARY)
    out = models.poly_aic(rows, ["region", "scenario_id"], "cn_fraction_percent", MBIT)
    return out.filter("degree = 1").selectExpr("region", "scenario_id", "degree", "n", "round(round(rss, 7), 3) as rss", "round(round(aic, 8), 4) as aic")


@query("M11_poly_aic_all_degrees")
def poly_aic_all(spark, sf_dir):
    rows = V.case_metrics(spark, sf_dir).filter(PRIMARY)
    return rounded(models.poly_aic(rows, ["region", "scenario_id"], "cn_fraction_percent", MBIT), 4)


_RATES = [0.01 * i for i in range(1, 21)]


@query("M12_exp_offset_fit", f"""
WITH d AS (SELECT region, cn_fraction_percent AS x, {OBS} AS y FROM v_case_metrics WHERE {PRIMARY}),
g AS (SELECT region, b, y, exp(-b * x) AS z FROM d, (SELECT unnest([{", ".join(f"{r}::DOUBLE" for r in _RATES)}]) AS b)),
f AS (SELECT region, b, count(*) AS n, regr_slope(y, z) AS a, regr_intercept(y, z) AS c, regr_syy(y, z) - regr_sxy(y, z) * regr_sxy(y, z) / regr_sxx(y, z) AS sse, regr_syy(y, z) AS tss FROM g GROUP BY ALL)
SELECT region, b, round(a, 4) AS a, round(c, 4) AS c, n, round(1 - sse / tss, 6) AS r_squared, round(sqrt(sse / n), 4) AS rmse
FROM f QUALIFY row_number() OVER (PARTITION BY region ORDER BY round(sse, 6), b) = 1""")
def exp_offset_fit(spark, sf_dir):
    rows = V.case_metrics(spark, sf_dir).filter(PRIMARY)
    out = models.exp_offset_fit(rows, ["region"], "cn_fraction_percent", OBS, _RATES)
    return out.selectExpr("region", "b", "round(round(a, 8), 4) as a", "round(round(c, 8), 4) as c", "n", "round(round(r_squared, 10), 6) as r_squared", "round(round(rmse, 8), 4) as rmse")


@query("M12_continuous_fit")
def continuous_fit(spark, sf_dir):
    rows = V.case_metrics(spark, sf_dir).filter(PRIMARY)
    return rounded(models.exp_offset_continuous(rows, ["region"], "cn_fraction_percent", OBS), 4)


@query("M12_fitted_curve")
def fitted_curve(spark, sf_dir):
    rows = V.case_metrics(spark, sf_dir).filter(PRIMARY)
    fits = models.exp_offset_fit(rows, ["region"], "cn_fraction_percent", OBS, _RATES)
    return rounded(models.fitted_curve(fits, ["region"], 0.0, 100.0))


@query("M13_sample_fraction", """
WITH d AS (SELECT DISTINCT plane_id, node_id FROM v_nodes),
r AS (SELECT plane_id, node_id, row_number() OVER (PARTITION BY plane_id ORDER BY ('0x' || substr(md5('s1|' || plane_id || '|' || node_id), 1, 15))::BIGINT, node_id) AS i, count(*) OVER (PARTITION BY plane_id) AS n FROM d)
SELECT plane_id, node_id FROM r WHERE i <= greatest(1, ceil(n * 30 / 100.0))""")
def sample_fraction(spark, sf_dir):
    return resample.sample_fraction(V.nodes(spark, sf_dir), ["plane_id"], "node_id", 30.0, "s1")


@query("M14_scale_capacity", """
SELECT window_id, round(coalesce(CASE WHEN k % 9 <> 0 THEN capacity_mbits END, 0) * 0.7, 6) AS capacity_mbits, round(value * 70, 6) AS data_rate_bps FROM v_windows""")
def scale_capacity(spark, sf_dir):
    rows = V.windows(spark, sf_dir).selectExpr("window_id", "if(k % 9 <> 0, capacity_mbits, null) as capacity_mbits", "value * 100 as data_rate_bps")
    return rounded(contacts.scale_capacity(rows, 0.7))


_STEP = ["region", "scenario_id", "base_id"]
_DECLINE_SQL = f"""l AS (SELECT region, scenario_id, base_id, cn_fraction_percent AS x, {OBS} AS o, {MBIT} AS b, {EVENTS} AS e FROM v_case_metrics WHERE scenario_id = 'nominal_original'),
d AS (SELECT region, base_id, x AS level_from, lead(x) OVER w AS level_to, lead(o) OVER w - o AS d_o, lead(b) OVER w - b AS d_b, lead(e) OVER w - e AS d_e FROM l WINDOW w AS (PARTITION BY region, base_id ORDER BY x)),
h AS (SELECT * FROM d WHERE level_to IS NOT NULL AND level_from >= 50)"""


@query("M15_high_level_decline", f"""
WITH {_DECLINE_SQL}, {corr_sql("h", "region, level_from, level_to", [("d_o", "d_b"), ("d_o", "d_e")])}, {bootstrap_sql("h", "region, level_from, level_to", "d_o", "base_id", DRAWS, 1, "bs")},
t AS (SELECT region, level_from, level_to, count(DISTINCT base_id) AS bases, 100 * avg((d_o < 0)::INT) AS sh FROM h GROUP BY ALL)
SELECT region, level_from, level_to, bases, round(sh, 6) AS share_dropping_percent, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high,
       round(max(CASE WHEN n >= 3 THEN spearman END) FILTER (metric_b = 'd_b'), 6) AS spearman_delta_{MBIT}, round(max(CASE WHEN n >= 3 THEN spearman END) FILTER (metric_b = 'd_e'), 6) AS spearman_delta_{EVENTS}
FROM t JOIN bs USING (region, level_from, level_to) LEFT JOIN r USING (region, level_from, level_to) GROUP BY ALL""")
def high_level_decline(spark, sf_dir):
    rows = V.case_metrics(spark, sf_dir).filter("scenario_id = 'nominal_original'")
    steps = windows.adjacent_deltas(rows, ["region", "base_id"], "cn_fraction_percent", [OBS, MBIT, EVENTS])
    return rounded(robust.high_level_decline(steps, ["region"], f"delta_{OBS}", [f"delta_{MBIT}", f"delta_{EVENTS}"], 50.0, DRAWS, 1))


# The six contrasts: policies, task sizes against the plain size, and limits.
CONTRASTS = [
    ("policy_central", "policy_peer"), ("policy_central", "policy_hybrid"), ("task_size_x1p0", "task_size_x0p5"),
    ("task_size_x1p0", "task_size_x2p0"), ("task_size_x1p0", "task_size_x4p0"), ("nominal_original", "unlimited_useful_deadline"),
]
_SIZES_SQL = f"""sc AS (SELECT region, case_id, scenario_id, {OBS}, {MBIT} FROM v_case_metrics UNION ALL
  SELECT region, case_id, 'task_size_x' || replace(task_size_multiplier::VARCHAR, '.', 'p'), avg({OBS}), avg({MBIT}) FROM v_case_metrics WHERE family = 'combined_stress' GROUP BY region, case_id, task_size_multiplier)"""


def _with_sizes(cases):
    """Case rows and, as scenarios of their own, the mean over all stressed runs of a case at each task size."""
    sized = cases.filter("family = 'combined_stress'").groupBy("region", "case_id", "task_size_multiplier").agg(F.avg(OBS).alias(OBS), F.avg(MBIT).alias(MBIT))
    named = sized.selectExpr("region", "case_id", "'task_size_x' || replace(cast(task_size_multiplier as string), '.', 'p') as scenario_id", OBS, MBIT)
    return cases.select("region", "case_id", "scenario_id", OBS, MBIT).unionByName(named)


_PAIR_SQL = " UNION ALL ".join(
    f"SELECT a.region, a.case_id, '{x}' AS reference, '{y}' AS alternative, b.{OBS} - a.{OBS} AS d1, b.{MBIT} - a.{MBIT} AS d2 "
    f"FROM (SELECT * FROM sc WHERE scenario_id = '{x}') a JOIN (SELECT * FROM sc WHERE scenario_id = '{y}') b USING (region, case_id)"
    for x, y in CONTRASTS)


@query("M16_paired_effects", f"""
WITH {_SIZES_SQL}, p AS ({_PAIR_SQL}), q AS (SELECT region, case_id, reference, alternative, '{OBS}' AS metric, d1 AS d FROM p WHERE d1 IS NOT NULL UNION ALL SELECT region, case_id, reference, alternative, '{MBIT}', d2 FROM p WHERE d2 IS NOT NULL),
{bootstrap_sql("q", "region, reference, alternative, metric", "d", "case_id", DRAWS, 1, "bs")}, m AS (SELECT region, reference, alternative, metric, median(d) AS median FROM q GROUP BY ALL),
c AS (SELECT region, reference, alternative, count(*) AS paired_cases FROM p GROUP BY ALL)
SELECT region, reference, alternative, metric, n_units, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(median, 6) AS median, paired_cases
FROM bs JOIN m USING (region, reference, alternative, metric) JOIN c USING (region, reference, alternative)""")
def paired_effects(spark, sf_dir):
    return rounded(robust.paired_effects(_with_sizes(V.case_table(spark, sf_dir)), ["region", "case_id"], ["region"], CONTRASTS, [OBS, MBIT], DRAWS, 1))


_DETAIL_SQL = f"""base AS (SELECT region, case_id, max({COV}) AS b1, max({OBS}) AS b2 FROM v_case_metrics WHERE {UNLIMITED} GROUP BY ALL),
det AS (SELECT s.region, s.case_id, s.base_id, s.family, s.failure_level_percent, s.task_size_multiplier, count(DISTINCT replicate) AS replicates, avg({COV}) AS s1, avg({OBS}) AS s2, max(b1) AS b1, max(b2) AS b2
  FROM v_case_metrics s JOIN base USING (region, case_id) WHERE {STRESS} GROUP BY ALL)"""


def _detail(spark, sf_dir, cell=CELL, metrics=(COV, OBS)):
    return robust.robustness_detail(
        V.case_table(spark, sf_dir), ["region", "case_id"], ["base_id", *cell], list(metrics), STRESS, UNLIMITED)


@query("M17_robustness_detail", f"""
WITH {_DETAIL_SQL.replace("s.task_size_multiplier, ", "")} SELECT region, case_id, base_id, family, failure_level_percent, replicates,
  {", ".join(f"round(s{i}, 6) AS stressed_{m}, round(b{i}, 6) AS baseline_{m}, round(s{i} - b{i}, 6) AS delta_{m}, round(CASE WHEN b{i} > 1e-12 THEN s{i} / b{i} END, 6) AS retention_{m}" for i, m in ((1, COV), (2, OBS)))} FROM det""")
def robustness_detail(spark, sf_dir):
    return rounded(_detail(spark, sf_dir))


def _interval_sql(keys: str, detail: str, draws: int) -> str:
    longer = " UNION ALL ".join(
        f"SELECT {keys}, base_id, '{q}_{m}' AS metric, {e} AS v FROM det"
        for i, m in ((1, COV), (2, OBS))
        for q, e in (("stressed", f"s{i}"), ("delta", f"s{i} - b{i}"), ("retention", f"CASE WHEN b{i} > 1e-12 THEN s{i} / b{i} END")))
    return f"""{detail}, ln AS (SELECT * FROM ({longer}) WHERE v IS NOT NULL), {cluster_sql("ln", f"{keys}, metric", "base_id", "v", draws, 1, "b")},
q AS (SELECT {keys}, metric, count(*) AS n, quantile_cont(v, 0.05) AS p05 FROM ln GROUP BY ALL)
SELECT {keys}, metric, n_units, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, n, round(p05, 6) AS p05 FROM b JOIN q USING ({keys}, metric)"""


@query("M17_robustness_interval", "WITH " + _interval_sql(
    "region, family, failure_level_percent", _DETAIL_SQL.replace("s.task_size_multiplier, ", ""), DRAWS))
def robustness_interval(spark, sf_dir):
    return rounded(robust.robustness_interval(_detail(spark, sf_dir), ["region", *CELL], "base_id", [COV, OBS], DRAWS, 1))


@query("M19_combined_stress", "WITH " + _interval_sql(
    "region, task_size_multiplier, failure_level_percent", _DETAIL_SQL.replace(STRESS, "s.family = 'combined_stress'"), DRAWS))
def combined_stress(spark, sf_dir):
    rows = V.case_table(spark, sf_dir)
    cell = ["task_size_multiplier", "failure_level_percent"]
    detail = robust.robustness_detail(rows, ["region", "case_id"], ["base_id", *cell], [COV, OBS], "family = 'combined_stress'", UNLIMITED)
    return rounded(robust.robustness_interval(detail, ["region", *cell], "base_id", [COV, OBS], DRAWS, 1))


_AUC_SQL = f"""{_DETAIL_SQL.replace("s.task_size_multiplier, ", "")}, pt AS (SELECT region, case_id, family, failure_level_percent AS x, CASE WHEN b1 > 1e-12 THEN s1 / b1 END AS y FROM det),
tr AS (SELECT *, coalesce(lag(x) OVER w, 0) AS x0, coalesce(lag(y) OVER w, 1) AS y0 FROM pt WHERE y IS NOT NULL WINDOW w AS (PARTITION BY region, case_id, family ORDER BY x)),
auc AS (SELECT region, case_id, family, count(*) AS n_levels, sum((x - x0) * (y + y0) / 2) / max(x) AS auc_retention FROM tr GROUP BY ALL)"""


@query("W11_retention_auc", f"""
WITH {_AUC_SQL} SELECT region, case_id, family, n_levels, round(auc_retention, 6) AS auc_retention FROM auc""")
def retention_auc(spark, sf_dir):
    detail = _detail(spark, sf_dir, metrics=[COV])
    return rounded(windows.retention_auc(detail, ["region", "case_id", "family"], "failure_level_percent", f"retention_{COV}"))


@query("M18_robustness_score", f"""
WITH {_AUC_SQL}, sc AS (SELECT region, case_id, avg(auc_retention) AS a FROM auc GROUP BY ALL)
SELECT region, case_id, round({COV}, 6) AS {COV}, round(a, 6) AS robustness_auc_retention FROM v_case_metrics LEFT JOIN sc USING (region, case_id) WHERE {UNLIMITED}""")
def robustness_score(spark, sf_dir):
    facts = V.case_table(spark, sf_dir)
    cases = facts.filter(UNLIMITED).select("region", "case_id", COV)
    detail = robust.robustness_detail(facts, ["region", "case_id"], ["base_id", *CELL], [COV], STRESS, UNLIMITED)
    return rounded(robust.robustness_score(cases, detail, ["region", "case_id"], "family", "failure_level_percent", COV))


_FRONT_PAIRS = {
    "Completion vs traffic": ((S100, True), (MBIT, False)), "Observation vs traffic": ((OBS, True), (MBIT, False)),
    "Completion vs time": ((S100, True), (T100, False)),
}


@query("M20_pairwise_front_counts", f"WITH {_UNL_SQL}, " + ", ".join(
    _front_sql("u", [a], [b]).replace("fv ", f"fv{i} ").replace("front AS", f"front{i} AS") for i, ((a, _), (b, _)) in enumerate(_FRONT_PAIRS.values())
) + " " + " UNION ALL ".join(
    f"SELECT region, '{label}' AS pair, count(*) AS eligible_cases, count(*) FILTER (is_front) AS front_cases FROM front{i} GROUP BY region"
    for i, label in enumerate(_FRONT_PAIRS)))
def pairwise_front_counts(spark, sf_dir):
    return skyline.pairwise_front_counts(_unlimited(spark, sf_dir), ["region"], _FRONT_PAIRS)


_LIKELIHOOD = {"random_satellite_failure": 3, "targeted_cn_failure": 2, "link_window_outage": 4, "combined_stress": 1}


@query("M20_risk_screen", f"""
WITH {_DETAIL_SQL.replace("s.task_size_multiplier, ", "")}, m AS (SELECT region, family, round(avg(b1 - s1), 6) AS mean_loss FROM det WHERE failure_level_percent = 30 AND b1 IS NOT NULL AND s1 IS NOT NULL GROUP BY ALL),
c AS (SELECT *, 1 + (mean_loss >= 2)::INT + (mean_loss >= 5)::INT + (mean_loss >= 10)::INT + (mean_loss >= 20)::INT AS consequence_score, CASE family {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _LIKELIHOOD.items())} END AS likelihood_score FROM m)
SELECT region, family, mean_loss, consequence_score, likelihood_score, (['Negligible', 'Minor', 'Moderate', 'Major', 'Severe'])[consequence_score] AS consequence,
       consequence_score * likelihood_score AS screening_score, CASE WHEN consequence_score * likelihood_score >= 10 THEN 'High' WHEN consequence_score * likelihood_score >= 5 THEN 'Moderate' ELSE 'Low' END AS screening FROM c""")
def risk_screen(spark, sf_dir):
    detail = _detail(spark, sf_dir, metrics=[COV]).filter("failure_level_percent = 30")
    losses = detail.filter(f"delta_{COV} is not null").groupBy("region", "family").agg(F.expr(f"round(avg(-delta_{COV}), 6) as mean_loss"))
    return decision.risk_screen(losses, "mean_loss", _LIKELIHOOD)


@query("T05_shortlist", f"""
WITH {_score_sql(1000)}, {_top_sql(5)}, {_front_sql("u", [S100, OBS], [MBIT])}, acc AS (SELECT region, case_id, 100.0::DOUBLE * count(*) FILTER (place = 1) / 1000 AS rank1_percent, 100.0::DOUBLE * count(*) FILTER (place <= 5) / 1000 AS top5_percent FROM r GROUP BY ALL),
f AS (SELECT region, case_id, coalesce(rank1_percent, 0) AS rank1_percent, coalesce(top5_percent, 0) AS top5_percent FROM front LEFT JOIN acc USING (region, case_id) WHERE is_front),
c AS (SELECT case_id, count(DISTINCT region) AS regions_present, min(rank1_percent) AS worst_rank1, avg(top5_percent) AS mean_top5 FROM f GROUP BY case_id),
p AS (SELECT * FROM c WHERE regions_present = 2 OR NOT EXISTS (SELECT 1 FROM c WHERE regions_present = 2) ORDER BY regions_present DESC, worst_rank1 DESC, mean_top5 DESC, case_id LIMIT 5)
SELECT region, case_id, rank1_percent, top5_percent, regions_present, worst_rank1, mean_top5 FROM f JOIN p USING (case_id)""")
def shortlist(spark, sf_dir):
    cases = V.case_table(spark, sf_dir).filter(UNLIMITED)
    flagged = skyline.skyline(_settled(cases), ["region"], [S100, OBS], [MBIT]).select("region", "case_id", "is_front")
    ranks = decision.rank_acceptability(_scaled(cases), "region", "case_id", list(_PARTS), 1000, 5, 11)
    joined = flagged.join(ranks.select("region", "case_id", "rank1_percent", "top5_percent"), ["region", "case_id"])
    return topk.shortlist(joined).drop("is_front")


_GRID = ["n_satellites", "n_planes", "altitude_km", "inclination_deg", "cn_fraction_percent"]


@query("G01_design_grid", "WITH " + ", ".join(f"l{i} AS (SELECT DISTINCT {f}::DOUBLE AS {f} FROM v_cases)" for i, f in enumerate(_GRID)) + f""",
g AS (SELECT * FROM {", ".join(f"l{i}" for i in range(len(_GRID)))} WHERE n_satellites % n_planes = 0)
SELECT {", ".join(_GRID)}, count(c_custkey) AS n_cases FROM g LEFT JOIN v_cases USING ({", ".join(_GRID)}) GROUP BY ALL""")
def design_grid(spark, sf_dir):
    """The grid spanned by the levels found in the cases, with the cases found in each cell."""
    cases = V.cases(spark, sf_dir)
    cells = grid.design_grid(grid.level_sets(cases, _GRID), _GRID, ("n_satellites", "n_planes"))
    have = cases.select(*[F.col(f).cast("double").alias(f) for f in _GRID]).groupBy(*_GRID).agg(F.expr("count(*) as n_cases"))
    return cells.join(have, _GRID, "left").na.fill(0, ["n_cases"])


_SCENARIO_SQL = """sc AS (
  SELECT n AS scenario_id, f AS family, t AS topology, p AS routing_policy, c AS delivery_cutoff, 1.0::DOUBLE AS task_size_multiplier, 0.0::DOUBLE AS failure_level_percent, 0 AS replicate, 1.0::DOUBLE AS capacity_factor
  FROM (VALUES """ + ", ".join(f"('{n}', '{f}', '{t}', '{p}', '{c}')" for n, f, t, p, _, c in grid.CORE_SCENARIOS) + """) v(n, f, t, p, c)
  UNION ALL SELECT 'task_size_x' || replace(x::VARCHAR, '.', 'p'), 'task_size', 'central_only', 'targeted_central', 'deadline', x, 0, 0, 1 FROM (SELECT unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS x)
  UNION ALL SELECT printf('%s_p%02d_r%02d', f, l, r), f, 'central_only', 'targeted_central', 'deadline', 1, l, r, 1
    FROM (SELECT unnest(['random_satellite_failure', 'random_cn_failure', 'link_window_outage', 'ground_station_outage']) AS f), (SELECT unnest([5, 10, 20, 30]) AS l), range(30) q(r)
  UNION ALL SELECT printf('%s_p%02d', f, l), f, 'central_only', 'targeted_central', 'deadline', 1, l, 0, CASE WHEN f = 'capacity_degradation' THEN 1 - l / 100 ELSE 1 END
    FROM (SELECT unnest(['targeted_cn_failure', 'capacity_degradation']) AS f), (SELECT unnest([5, 10, 20, 30]) AS l)
  UNION ALL SELECT printf('combined_size_x%s_satfail_p%02d_r%02d', replace(x::VARCHAR, '.', 'p'), l, r), 'combined_stress', 'central_only', 'targeted_central', 'deadline', x, l, r, 1
    FROM (SELECT unnest([2.0, 4.0])::DOUBLE AS x), (SELECT unnest([10, 20]) AS l), range(10) q(r))"""


@query("G02_scenario_manifest", f"""
WITH {_SCENARIO_SQL} SELECT node_id, scenario_id, family, topology, routing_policy, delivery_cutoff, task_size_multiplier, failure_level_percent, replicate, round(capacity_factor, 6) AS capacity_factor FROM v_nodes, sc""")
def scenario_manifest(spark, sf_dir):
    """The 539 scenarios of a campaign, for every node as its own campaign."""
    made = grid.scenario_manifest(V.nodes(spark, sf_dir).select("node_id"))
    return rounded(made.drop("receiver_target", "failure_type"))


@query("G02_scenario_details", f"""
WITH {_SCENARIO_SQL} SELECT node_id, scenario_id, CASE WHEN scenario_id = 'nominal_original' THEN 3 ELSE -1 END::BIGINT AS max_forwarding_hops,
  CASE WHEN scenario_id = 'nominal_original' THEN 3 ELSE 0 END::BIGINT AS max_observer_copies, CASE WHEN scenario_id = 'nominal_original' THEN 5 ELSE 0 END::BIGINT AS max_cn_copies,
  family IN ('nominal', 'unlimited', 'policy_ablation', 'task_size') AS retain_task_metrics, scenario_id IN ('nominal_original', 'unlimited_useful_deadline') AS retain_transfers
FROM v_nodes, sc""")
def scenario_details(spark, sf_dir):
    made = grid.scenario_details(grid.scenario_manifest(V.nodes(spark, sf_dir).select("node_id")))
    return made.select("node_id", "scenario_id", "max_forwarding_hops", "max_observer_copies", "max_cn_copies", "retain_task_metrics", "retain_transfers")


@query("G02_repeated_scenarios", f"""
WITH {_SCENARIO_SQL} SELECT plane_id, scenario_id, count(*) AS n FROM v_nodes, sc GROUP BY ALL HAVING count(*) > 1""")
def repeated_scenarios(spark, sf_dir):
    """Nodes are their own campaigns; read by plane, an id comes once per node, so it repeats wherever a plane has several."""
    return grid.repeated_scenarios(grid.scenario_manifest(V.nodes(spark, sf_dir).select("plane_id")), ["plane_id"])


@query("G03_case_manifest", """
WITH b AS (SELECT DISTINCT base_id AS found_base, n_satellites, n_planes, altitude_km, inclination_deg, split_part(case_id, '_F', 2)::BIGINT AS walker_f FROM v_cases)
SELECT region, cn_fraction_percent, printf('T%03d_P%02d_H%04d_I%04d_CN%03d_F%d', n_satellites, n_planes, altitude_km::BIGINT, round_even(inclination_deg * 10, 0)::BIGINT, cn_fraction_percent::BIGINT, walker_f) AS case_id, found_base AS base_id
FROM b, (SELECT unnest(['north', 'south']) AS region), (SELECT unnest([0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100])::DOUBLE AS cn_fraction_percent)""")
def case_manifest(spark, sf_dir):
    bases = V.cases(spark, sf_dir).selectExpr(
        "n_satellites", "n_planes", "altitude_km", "inclination_deg", "cast(regexp_extract(case_id, '_F([0-9]+)$', 1) as long) as walker_f").distinct()
    made = grid.case_manifest(bases, ["north", "south"], [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100])
    return made.select("region", "cn_fraction_percent", "case_id", "base_id")


_PLAN_SQL = f"""{_SCENARIO_SQL}, b AS (SELECT case_id, region, n_satellites, cn_fraction_percent FROM (SELECT DISTINCT case_id, n_satellites, cn_fraction_percent FROM v_cases), (SELECT DISTINCT region FROM v_nodes)),
pl AS (SELECT b.region, case_id, scenario_id, family, family IN ('nominal', 'unlimited', 'policy_ablation', 'task_size', 'targeted_cn_failure', 'capacity_degradation') OR replicate < 1 AS keep_tasks,
  scenario_id IN ('nominal_original', 'unlimited_useful_deadline') AND n_satellites IN (30, 36) AND cn_fraction_percent IN (0, 50, 100) AS keep_transfers FROM b, sc)"""


def _plan(spark, sf_dir):
    """The plan by design: the flags depend on size and level alone, so cases are counted (``n_cases``) before they meet the scenarios."""
    cases = V.cases(spark, sf_dir).select("case_id", "n_satellites", "cn_fraction_percent").distinct()
    bases = cases.groupBy("n_satellites", "cn_fraction_percent").agg(F.expr("count(*) as n_cases"))
    regions = V.nodes(spark, sf_dir).agg(F.expr("array_sort(collect_set(region)) as r"))
    from tallyfield.operators.ordered import attach

    rows = attach(bases, regions, []).selectExpr("n_cases", "n_satellites", "cn_fraction_percent", "explode(r) as region")
    return grid.retention_plan(grid.scenario_manifest(rows), [0, 50, 100], [30, 36])


@query("G04_retention_plan", f"""
WITH {_PLAN_SQL} SELECT region, family, count(*) AS evaluations, count(*) FILTER (keep_tasks) AS with_tasks, count(*) FILTER (keep_transfers) AS with_transfers FROM pl GROUP BY ALL""")
def retention_plan(spark, sf_dir):
    return _plan(spark, sf_dir).groupBy("region", "family").agg(
        F.expr("sum(n_cases) as evaluations"), F.expr("sum(if(keep_tasks, n_cases, 0)) as with_tasks"), F.expr("sum(if(keep_transfers, n_cases, 0)) as with_transfers"))


@query("G05_volume_estimate", f"""
WITH {_PLAN_SQL}, n AS (SELECT region, count(DISTINCT task_id) AS n FROM v_lines GROUP BY region)
SELECT region, count(*) AS evaluations, sum(CASE WHEN keep_tasks THEN n ELSE 0 END)::BIGINT AS task_rows, count(*) FILTER (keep_transfers) AS transfer_evaluations FROM pl JOIN n USING (region) GROUP BY region""")
def volume_estimate(spark, sf_dir):
    counts = V.lines(spark, sf_dir).groupBy("region").agg(F.count_distinct("task_id").alias("n"))
    return grid.volume_estimate(_plan(spark, sf_dir).join(counts, "region"), "n", ["region"], "n_cases")



