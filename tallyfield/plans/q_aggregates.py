"""Grouped summaries over the task and case tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import aggregates as agg
from tallyfield.operators import correlation, network, outcomes
from tallyfield.operators.joins import matched_cross_fleet
from tallyfield.operators.resample import DRAWS
from tallyfield.plans import views as V
from tallyfield.plans.draws import bootstrap_sql
from tallyfield.plans.registry import query
from tallyfield.plans.shape import rounded

OBS, S100, COV, MBIT, EVENTS = V.METRICS
T100 = "p100_t100_surviving_min"
PRIMARY = "scenario_id IN ('nominal_original', 'unlimited_useful_deadline')"
CLASSES = ["Critical", "High", "Medium", "Low"]


def long_sql(view: str, keys: str, metrics, where: str = "true") -> str:
    """SQL: wide to long, without NULLs."""
    return " UNION ALL ".join(
        f"SELECT {keys}, '{m}' AS metric, {m}::DOUBLE AS value FROM {view} WHERE {m} IS NOT NULL AND {where}" for m in metrics
    )


def _stats_sql(metrics) -> str:
    parts = []
    for m in metrics:
        parts.append(
            f"count({m}) AS {m}_n, round(avg({m}), 6) AS {m}_mean, round(median({m}::DOUBLE), 6) AS {m}_median, round(stddev_samp({m}), 6) AS {m}_std, "
            f"round(quantile_cont({m}::DOUBLE, 0.05), 6) AS {m}_p05, round(quantile_cont({m}::DOUBLE, 0.95), 6) AS {m}_p95, "
            f"round(min({m}::DOUBLE), 6) AS {m}_min, round(max({m}::DOUBLE), 6) AS {m}_max"
        )
    return ", ".join(parts)


@query("A01_describe_by", f"""
SELECT region, family, failure_level_percent, count(DISTINCT case_id) AS case_count, count(*) AS scenario_evaluations, {_stats_sql([OBS, T100, MBIT])}
FROM v_case_metrics WHERE status = 'COMPLETED' GROUP BY region, family, failure_level_percent""")
def describe_by(spark, sf_dir):
    done = V.case_table(spark, sf_dir).filter("status = 'COMPLETED'")
    return rounded(agg.describe_by(done, ["region", "family", "failure_level_percent"], [OBS, T100, MBIT]))


_ROLLUP = [*V.CASE_KEYS, "original_coverage_deadline_percent", "surviving_coverage_deadline_percent", "s100_original_by_deadline",
           "s100_surviving_by_deadline", "observed_before_deadline", "failure_class", "t100_surviving_min", "t100_surviving_censored",
           "transferred_mbits", "n_transfers", "max_hops", "reached_original_by_deadline", "observation_latency_min", "priority_class"]


@query("A02_case_rollup", f"""
SELECT region, case_id, scenario_id, n_tasks, geometry_failure_count, communication_failure_count, routing_or_timing_failure_count,
       t100_completed_count, t100_censored_count, n_transfer_events, max_hops_seen, round(transferred_mbits, 4) AS transferred_mbits,
       round({OBS}, 6) AS {OBS}, round({S100}, 6) AS {S100}, round({COV}, 6) AS {COV}, round({T100}, 6) AS {T100},
       round(p50, 6) AS p50, round(p90, 6) AS p90, round(p95, 6) AS p95
FROM v_case_metrics JOIN (
  SELECT region, case_id, scenario_id, quantile_cont(t100_surviving_min, 0.5) AS p50, quantile_cont(t100_surviving_min, 0.9) AS p90,
         quantile_cont(t100_surviving_min, 0.95) AS p95 FROM v_task_metrics GROUP BY ALL) USING (region, case_id, scenario_id)""")
def case_rollup(spark, sf_dir):
    probs = {"p50": 0.5, "p90": 0.9, "p95": 0.95}
    out = outcomes.rollup_with_quantiles(V.task_table(spark, sf_dir, _ROLLUP), V.CASE_KEYS, "t100_surviving_min", probs)
    return rounded(out.selectExpr(
        *V.CASE_KEYS, "n_tasks", "geometry_failure_count", "communication_failure_count", "routing_or_timing_failure_count",
        "t100_completed_count", "t100_censored_count", "n_transfer_events", "max_hops_seen",
        "round(round(transferred_mbits, 8), 4) as transferred_mbits", OBS, S100, COV, T100, *probs,
    ))


_LAT = ["observation_latency_min", "t100_surviving_min"]


@query("A03_outcome_rollup", f"""
SELECT region, scenario_id, count(*) AS n_tasks, round(100 * avg((reached_original_by_deadline > 0)::INT), 6) AS useful_recipient_success_percent,
       round(100 * avg(s100_original_by_deadline::INT), 6) AS full_dissemination_success_percent, round(100 * avg(observed_before_deadline::INT), 6) AS observation_success_percent,
       round(100 * avg((reached_original_by_deadline > 0 AND observed_before_deadline)::INT), 6) AS combined_success_percent,
       {", ".join(f"round(avg({c}), 6) AS mean_{c}, count(*) - count({c}) AS censored_{c}, round(quantile_cont({c}, 0.5), 6) AS p50_{c}, round(quantile_cont({c}, 0.9), 6) AS p90_{c}, round(quantile_cont({c}, 0.95), 6) AS p95_{c}" for c in _LAT)},
       count(*) FILTER (failure_class LIKE '%geometry%') AS geometry_failures, count(*) FILTER (failure_class LIKE '%communication%') AS communication_failures,
       count(*) FILTER (failure_class LIKE '%routing%') AS routing_failures
FROM v_task_metrics GROUP BY region, scenario_id""")
def outcome_rollup(spark, sf_dir):
    return rounded(outcomes.outcome_rollup(
        V.task_table(spark, sf_dir, _ROLLUP), ["region", "scenario_id"], _LAT, {"p50": 0.5, "p90": 0.9, "p95": 0.95}))


_CRITERIA = {
    "observation >= 80": f"{OBS} >= 80", "observation >= 90": f"{OBS} >= 90", "s100 = 100": f"{S100} = 100",
    "coverage >= 95": f"{COV} >= 95", "all = 100": f"{OBS} = 100 and {S100} = 100 and {COV} = 100",
}


@query("A04_threshold_counts", " UNION ALL ".join(
    f"SELECT scenario_id, '{label}' AS criterion, count(*) FILTER ({test}) AS n FROM v_case_metrics WHERE status = 'COMPLETED' AND {PRIMARY} GROUP BY scenario_id"
    for label, test in _CRITERIA.items()))
def threshold_counts(spark, sf_dir):
    done = V.case_metrics(spark, sf_dir).filter(f"status = 'COMPLETED' and {PRIMARY}")
    return agg.threshold_counts(done, ["scenario_id"], _CRITERIA)


@query("A05_coverage_by_family", """
SELECT family, status, count(DISTINCT scenario_id) AS scenarios, count(DISTINCT case_id) AS cases, count(*) AS n_rows
FROM v_case_metrics GROUP BY family, status""")
def coverage_by_family(spark, sf_dir):
    return agg.coverage_by(V.case_metrics(spark, sf_dir), ["family", "status"])


_LEVEL = "region, scenario_id, cn_fraction_percent"


@query("A06_level_summary", f"""
WITH done AS (SELECT * FROM v_case_metrics WHERE status = 'COMPLETED' AND {PRIMARY}), long AS ({long_sql("done", f"{_LEVEL}, case_id", [OBS, S100, COV, T100, MBIT])}),
b AS (SELECT {_LEVEL}, count(DISTINCT base_id) AS n_bases, median(n_central_nodes::DOUBLE) AS middle FROM done GROUP BY ALL),
{bootstrap_sql("long", f"{_LEVEL}, metric", "value", "case_id", DRAWS, 1, "bs")}
SELECT {_LEVEL}, metric, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75,
       max(n_bases) AS n_bases, round(max(low), 6) AS low, round(max(high), 6) AS high, round(max(middle), 6) AS median_central_nodes
FROM long JOIN b USING ({_LEVEL}) JOIN bs USING ({_LEVEL}, metric) GROUP BY {_LEVEL}, metric""")
def level_summary(spark, sf_dir):
    done = V.case_table(spark, sf_dir).filter(f"status = 'COMPLETED' and {PRIMARY}")
    return rounded(agg.level_summary(done, ["region", "scenario_id", "cn_fraction_percent"], [OBS, S100, COV, T100, MBIT]))


@query("A07_absolute_summary", f"""
WITH long AS ({long_sql("v_case_metrics", "region, scenario_id, n_satellites, n_central_nodes", [OBS, MBIT], PRIMARY)})
SELECT region, scenario_id, n_satellites, n_central_nodes, metric, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median
FROM long GROUP BY ALL""")
def absolute_summary(spark, sf_dir):
    primary = V.case_metrics(spark, sf_dir).filter(PRIMARY)
    return rounded(agg.summary(
        primary, ["region", "scenario_id", "n_satellites", "n_central_nodes"], [OBS, MBIT], ["n", "mean", "median"], agg.MEDIAN))


_FLAGS = {"observation_success_percent": "observed_before_deadline", "s100_percent": "s100_surviving_by_deadline"}


@query("A08_priority_summary", f"""
WITH c AS (SELECT scenario_id, region, case_id, lower(priority_class) AS priority_class, 100 * avg(observed_before_deadline::INT) AS observation_success_percent,
                  100 * avg(s100_surviving_by_deadline::INT) AS s100_percent FROM v_task_metrics WHERE {PRIMARY} GROUP BY ALL),
long AS ({long_sql("c", "scenario_id, priority_class", _FLAGS)}),
n AS (SELECT scenario_id, count(DISTINCT case_id) AS case_count FROM v_task_metrics WHERE {PRIMARY} GROUP BY scenario_id)
SELECT scenario_id, priority_class, metric, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.05), 6) AS p05,
       round(quantile_cont(value, 0.95), 6) AS p95, max(case_count) AS case_count FROM long JOIN n USING (scenario_id) GROUP BY ALL""")
def priority_summary(spark, sf_dir):
    wide = outcomes.priority_pivot(V.task_metrics(spark, sf_dir).filter(PRIMARY), V.CASE_KEYS, _FLAGS, CLASSES)
    return rounded(agg.priority_summary(wide, ["scenario_id"], [c.lower() for c in CLASSES], list(_FLAGS)))


@query("A09_task_summary", """
SELECT scenario_id, priority_class, count(DISTINCT case_id) AS case_count, count(*) AS task_evaluations,
       round(100 * avg(observed_before_deadline::INT), 6) AS observation_success_percent, round(100 * avg(s100_surviving_by_deadline::INT), 6) AS s100_percent,
       round(avg(surviving_coverage_deadline_percent), 6) AS mean_coverage_percent, round(avg(observation_latency_min), 6) AS latency_mean_min,
       round(100 * avg((NOT t100_surviving_censored)::INT), 6) AS t100_completion_percent,
       round(quantile_cont(observation_latency_min, 0.9), 6) AS latency_p90, round(quantile_cont(t100_surviving_min, 0.9), 6) AS t100_p90
FROM v_task_metrics GROUP BY scenario_id, priority_class""")
def task_summary(spark, sf_dir):
    return rounded(agg.task_summary(V.task_table(spark, sf_dir, _ROLLUP), ["scenario_id", "priority_class"]))


@query("A10_transfer_summary", """
SELECT scenario_id, cn_fraction_percent, count(DISTINCT case_id) AS cases, count(*) AS transfer_events, round(sum(mbit), 4) AS transferred_mbits,
       round(avg(end_sec - created_sec), 6) AS mean_duration_sec, round(avg(hop), 6) AS mean_hops, round(100 * avg((from_node % 10 = 0)::INT), 6) AS ground_origin_percent,
       round(quantile_cont(end_sec - created_sec, 0.95), 6) AS p95_duration_sec
FROM v_transfers GROUP BY scenario_id, cn_fraction_percent""")
def transfer_summary(spark, sf_dir):
    log = V.transfers(spark, sf_dir).selectExpr(
        "scenario_id", "cn_fraction_percent", "case_id", "mbit", "end_sec - created_sec as duration_sec", "hop",
        "if(from_node % 10 = 0, 'GS_', 'SAT_') || from_node as from_node",
    )
    out = agg.transfer_summary(log, ["scenario_id", "cn_fraction_percent"])
    return rounded(out.withColumn("transferred_mbits", F.expr("round(round(transferred_mbits, 8), 4)")))


STRESS = "family IN ('random_satellite_failure', 'targeted_cn_failure', 'link_window_outage', 'combined_stress')"


@query("A11_robustness_summary", f"""
WITH long AS ({long_sql("v_case_metrics", "region, family, failure_level_percent", [OBS, S100, T100], STRESS)})
SELECT region, family, failure_level_percent, metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95 FROM long GROUP BY ALL""")
def robustness_summary(spark, sf_dir):
    stressed = V.case_metrics(spark, sf_dir).filter(STRESS)
    return rounded(agg.summary(
        stressed, ["region", "family", "failure_level_percent"], [OBS, S100, T100], ["n", "mean", "std", "p05", "p95"], agg.TAILS))


@query("A12_size_summary", f"""
SELECT region, task_size_multiplier, count(*) AS n_rows, round(avg({OBS}), 6) AS mean_{OBS}, round(avg({S100}), 6) AS mean_{S100}, round(avg({MBIT}), 6) AS mean_{MBIT}
FROM v_case_metrics WHERE family = 'combined_stress' GROUP BY region, task_size_multiplier""")
def size_summary(spark, sf_dir):
    sized = V.case_metrics(spark, sf_dir).filter("family = 'combined_stress'")
    return rounded(agg.means_by(sized, ["region", "task_size_multiplier"], [OBS, S100, MBIT]))


@query("A12_policy_summary", f"""
SELECT region, topology, routing_policy, count(*) AS n_rows, round(avg({OBS}), 6) AS mean_{OBS}, round(avg({S100}), 6) AS mean_{S100}, round(avg({MBIT}), 6) AS mean_{MBIT}
FROM v_case_metrics WHERE family = 'policy_ablation' GROUP BY region, topology, routing_policy""")
def policy_summary(spark, sf_dir):
    ablation = V.case_metrics(spark, sf_dir).filter("family = 'policy_ablation'")
    return rounded(agg.means_by(ablation, ["region", "topology", "routing_policy"], [OBS, S100, MBIT]))


_LOADS_SQL = """loads AS (SELECT region, node, bool_or(c) AS is_central, sum(s) AS sent, sum(r) AS received, sum(s) + sum(r) AS load FROM (
  SELECT region, from_node AS node, from_node % 10 < 3 AS c, mbit AS s, 0::DOUBLE AS r FROM v_transfers UNION ALL
  SELECT region, node_id, is_central, 0, mbit FROM v_transfers) GROUP BY region, node)"""


def _loads(spark, sf_dir):
    log = V.transfers(spark, sf_dir).selectExpr(
        "region", "from_node", "from_node % 10 < 3 as from_central", "node_id as to_node", "is_central as to_central", "mbit"
    )
    return network.node_loads(log, ["region"])


@query("A15_node_loads", f"""
WITH {_LOADS_SQL} SELECT region, node, is_central, round(sent, 4) AS sent, round(received, 4) AS received, round(load, 4) AS load FROM loads""")
def node_loads(spark, sf_dir):
    return rounded(_loads(spark, sf_dir), 4)


@query("A13_gini", f"""
WITH {_LOADS_SQL}, r AS (SELECT region, sent, row_number() OVER (PARTITION BY region ORDER BY sent) AS i FROM loads)
SELECT region, count(*) AS n, round(2 * sum(i * sent) / (count(*) * sum(sent)) - (count(*) + 1.0) / count(*), 6) AS gini FROM r GROUP BY region""")
def gini(spark, sf_dir):
    return rounded(network.gini(_loads(spark, sf_dir), ["region"], "sent"))


@query("A13_gini_with_absent", f"""
WITH {_LOADS_SQL}, a AS (SELECT region, sent FROM loads WHERE sent > 0 UNION ALL
    SELECT region, 0 FROM (SELECT region, unnest(range(n)) FROM (SELECT region, 50000 + count(*) - count(*) FILTER (sent > 0) AS n FROM loads GROUP BY region))),
r AS (SELECT region, sent, row_number() OVER (PARTITION BY region ORDER BY sent) AS i FROM a)
SELECT region, count(*) AS n, round(2 * sum(i * sent) / (count(*) * sum(sent)) - (count(*) + 1.0) / count(*), 6) AS gini FROM r GROUP BY region""")
def gini_with_absent(spark, sf_dir):
    """As if each region had 50,000 more nodes than those that appear in the log."""
    loads = _loads(spark, sf_dir)
    members = loads.groupBy("region").agg(F.expr("count(*) + 50000 as n_total"))
    return rounded(network.gini(loads.filter("sent > 0"), ["region"], "sent", members))


@query("A14_load_concentration", f"""
WITH {_LOADS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY load DESC) AS i, count(*) OVER (PARTITION BY region) AS n FROM loads)
SELECT region, count(*) AS n_nodes, round(max(load), 6) AS max_load, round(sum(load * load) / (sum(load) * sum(load)), 9) AS hhi,
       round(sum(load) FILTER (i <= greatest(1, ceil(n * 0.1))) / sum(load), 6) AS top_share,
       round(coalesce(sum(load) FILTER (is_central), 0) / sum(load), 6) AS central_share FROM r GROUP BY region""")
def load_concentration(spark, sf_dir):
    out = network.load_concentration(_loads(spark, sf_dir), ["region"])
    return out.selectExpr("region", "n_nodes", "round(round(max_load, 10), 6) as max_load", "round(hhi, 9) as hhi",
                          "round(round(top_share, 10), 6) as top_share", "round(round(central_share, 10), 6) as central_share")


@query("A16_adjacency", """
SELECT least(node_i, node_j) AS node_a, greatest(node_i, node_j) AS node_b, count(*) AS n_links, round(sum(duration_sec), 4) AS sum_duration_sec,
       round(sum(capacity_mbits), 4) AS sum_capacity_mbits FROM v_windows GROUP BY ALL""")
def adjacency(spark, sf_dir):
    return rounded(network.adjacency(V.windows(spark, sf_dir), [], "node_i", "node_j", False, ["duration_sec", "capacity_mbits"]), 4)


@query("A16_adjacency_directed", """
SELECT region, from_node AS node_a, node_id AS node_b, count(*) AS n_links, round(sum(mbit), 4) AS sum_mbit FROM v_transfers GROUP BY ALL""")
def adjacency_directed(spark, sf_dir):
    return rounded(network.adjacency(V.transfers(spark, sf_dir), ["region"], "from_node", "node_id", True, ["mbit"]), 4)


@query("A16_upper_sum", """
SELECT sum(n)::BIGINT AS upper_n_links, round(sum(c), 3) AS upper_sum_capacity_mbits FROM (
  SELECT least(node_i, node_j) AS a, greatest(node_i, node_j) AS b, count(*) AS n, sum(capacity_mbits) AS c FROM v_windows WHERE node_i <> node_j GROUP BY ALL)""")
def upper_sum(spark, sf_dir):
    pairs = network.adjacency(V.windows(spark, sf_dir), [], "node_i", "node_j", False, ["capacity_mbits"])
    return rounded(network.upper_sum(pairs, [], ["n_links", "sum_capacity_mbits"]), 3)


@query("A17_network_utilisation", """
WITH w AS (SELECT scenario_id, count(*) AS available_windows, sum(hop * 60.0::DOUBLE) AS available_sec, sum(mbit * 1.5) AS available_mbits FROM v_lines GROUP BY ALL),
u AS (SELECT scenario_id, count(DISTINCT task_id || '-' || hop) AS used_windows, count(*) AS transfer_events, sum(mbit) AS used_mbits FROM v_transfers GROUP BY ALL),
t AS (SELECT scenario_id, count(*) AS n_tasks, sum(task_size_multiplier) AS task_mbits FROM v_tasks GROUP BY ALL)
SELECT scenario_id, available_windows, round(available_sec, 4) AS available_sec, round(available_mbits, 4) AS available_mbits, coalesce(used_windows, 0) AS used_windows,
       coalesce(transfer_events, 0) AS transfer_events, round(coalesce(used_mbits, 0), 4) AS used_mbits,
       round(100 * coalesce(used_mbits, 0) / available_mbits, 4) AS utilisation_percent, round(coalesce(used_mbits, 0) / n_tasks, 4) AS mbits_per_task,
       round(coalesce(transfer_events, 0) / n_tasks, 4) AS events_per_task, round(task_mbits / available_mbits, 4) AS task_to_capacity_ratio
FROM w LEFT JOIN u USING (scenario_id) LEFT JOIN t USING (scenario_id)""")
def network_utilisation(spark, sf_dir):
    windows = V.lines(spark, sf_dir).selectExpr("scenario_id", "hop * 60D as duration_sec", "mbit * 1.5D as capacity_mbits")
    used = V.transfers(spark, sf_dir).selectExpr("scenario_id", "concat(task_id, '-', hop) as window_id", "mbit")
    tasks = V.tasks(spark, sf_dir).selectExpr("scenario_id", "task_size_multiplier as size_mbits")
    return rounded(network.network_utilisation(windows, used, tasks, ["scenario_id"]), 4)


@query("A18_milestones", """
WITH t AS (SELECT region, task_id, created_sec, recv_sec, count(*) OVER (PARTITION BY region, task_id) AS n,
                  CASE WHEN recv_sec IS NOT NULL THEN row_number() OVER (PARTITION BY region, task_id ORDER BY recv_sec NULLS LAST) END AS k FROM v_pairs WHERE eligible)
SELECT region, task_id, count(*) AS target_count, """ + ", ".join(
    f"round((min(recv_sec) FILTER (k >= ceil(n * {p} / 100.0)) - min(created_sec)) / 60, 6) AS t{p}_min" for p in outcomes.MILESTONES
) + " FROM t GROUP BY region, task_id")
def milestones(spark, sf_dir):
    return rounded(outcomes.milestones(V.pairs(spark, sf_dir), ["region", "task_id"]))


@query("A20_first_reception", """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY region, task_id ORDER BY end_sec, node_id, hop) AS i FROM v_transfers)
SELECT region, task_id, max(node_id) FILTER (i = 1) AS first_node, min(end_sec) AS first_reception_sec, max(hop) FILTER (i = 1) AS first_hop,
       round((min(end_sec) - min(created_sec)) / 60, 6) AS first_reception_latency_min, max(hop) AS max_hops, count(DISTINCT node_id) AS nodes_reached,
       count(DISTINCT node_id) FILTER (is_central) AS central_nodes_reached, count(DISTINCT node_id) FILTER (NOT is_central) AS observers_reached,
       min(end_sec) <= min(deadline_sec) + 1e-9 AS received_before_deadline
FROM f GROUP BY region, task_id""")
def first_reception(spark, sf_dir):
    return rounded(outcomes.first_reception(V.transfers(spark, sf_dir), ["region", "task_id"]))


_FACTORS = ["n_satellites", "n_planes", "altitude_km", "inclination_deg", "cn_fraction_percent"]


@query("A21_eta_squared", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT scenario_id, '{f}' AS factor, {f}::DOUBLE AS level, '{m}' AS metric, {m}::DOUBLE AS v FROM v_case_metrics WHERE {PRIMARY} AND {m} IS NOT NULL"
    for f in _FACTORS for m in (OBS, COV)) + """),
g AS (SELECT scenario_id, factor, metric, avg(v) AS grand, sum((v - a) * (v - a)) AS total FROM (
        SELECT *, avg(v) OVER (PARTITION BY scenario_id, factor, metric) AS a FROM l) GROUP BY ALL),
m AS (SELECT scenario_id, factor, metric, level, count(*) AS n, avg(v) AS mean FROM l GROUP BY ALL)
SELECT scenario_id, factor, metric, count(*) AS n_levels, round(sum(n * (mean - grand) * (mean - grand)) / max(total), 6) AS eta_squared
FROM m JOIN g USING (scenario_id, factor, metric) GROUP BY scenario_id, factor, metric""")
def eta_squared(spark, sf_dir):
    primary = V.case_metrics(spark, sf_dir).filter(PRIMARY)
    return rounded(agg.eta_squared(primary, ["scenario_id"], _FACTORS, [OBS, COV]))


@query("A21_effect_levels", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT scenario_id, '{f}' AS factor, {f}::DOUBLE AS level, '{m}' AS metric, {m}::DOUBLE AS v FROM v_case_metrics WHERE {PRIMARY} AND {m} IS NOT NULL"
    for f in _FACTORS for m in (OBS, COV)) + """)
SELECT scenario_id, factor, level, metric, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.95), 6) AS p95
FROM l WHERE level IS NOT NULL GROUP BY ALL""")
def effect_levels(spark, sf_dir):
    primary = V.case_metrics(spark, sf_dir).filter(PRIMARY)
    return rounded(agg.effect_levels(primary, ["scenario_id"], _FACTORS, [OBS, COV]))


@query("A22_factor_levels", " UNION ALL ".join(
    f"SELECT region, '{f}' AS factor, {f}::DOUBLE AS level, count(*) AS cases, round(avg({OBS}), 6) AS mean_{OBS}, round(avg({MBIT}), 6) AS mean_{MBIT} FROM v_case_metrics WHERE scenario_id = 'unlimited_useful_deadline' GROUP BY region, {f}"
    for f in _FACTORS))
def factor_levels(spark, sf_dir):
    one = V.case_metrics(spark, sf_dir).filter("scenario_id = 'unlimited_useful_deadline'")
    return rounded(agg.factor_levels(one, ["region"], _FACTORS, [OBS, MBIT]))


@query("A22_factor_ranges", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT region, '{f}' AS factor, {f}::DOUBLE AS level, avg({OBS}) AS o, avg({MBIT}) AS b FROM v_case_metrics WHERE scenario_id = 'unlimited_useful_deadline' GROUP BY region, {f}"
    for f in _FACTORS) + f"), u AS (SELECT region, factor, level, '{OBS}' AS metric, o AS v FROM l UNION ALL SELECT region, factor, level, '{MBIT}', b FROM l)" + """
SELECT region, factor, metric, min(level) AS evaluated_min, max(level) AS evaluated_max, round(max(level) - min(level), 6) AS evaluated_range,
       count(*) AS n_levels, round(max(v) - min(v), 6) AS max_minus_min_mean FROM u WHERE v IS NOT NULL GROUP BY ALL""")
def factor_ranges(spark, sf_dir):
    one = V.case_metrics(spark, sf_dir).filter("scenario_id = 'unlimited_useful_deadline'")
    levels = agg.factor_levels(one, ["region"], _FACTORS, [OBS, MBIT])
    return rounded(agg.factor_ranges(levels, ["region"], [OBS, MBIT]))


def corr_sql(view: str, keys: str, pairs, where: str = "true", extra: str = "") -> str:
    """SQL: pearson and spearman of each pair, pairwise complete, as CTEs p (rows) and r (result)."""
    lead = f"{keys}, " if keys else ""
    rows = " UNION ALL ".join(
        f"SELECT {lead}'{a}' AS metric_a, '{b}' AS metric_b, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM {view} WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {where}"
        for a, b in pairs)
    g = f"{lead}metric_a, metric_b"
    return f"""p AS ({rows}),
k AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY x) + (count(*) OVER (PARTITION BY {g}, x) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY {g} ORDER BY y) + (count(*) OVER (PARTITION BY {g}, y) - 1) / 2.0 AS ry FROM p),
r AS (SELECT {g}, count(*) AS n, CASE WHEN var_pop(x) > 1e-12 AND var_pop(y) > 1e-12 THEN corr(x, y) END AS pearson,
             CASE WHEN var_pop(rx) > 1e-12 AND var_pop(ry) > 1e-12 THEN corr(rx, ry) END AS spearman FROM k GROUP BY {g})"""


_CORR = [OBS, S100, COV, T100, MBIT, EVENTS]


@query("A23_correlation_matrix", f"""
WITH {corr_sql("v_case_metrics", "region", correlation.all_pairs(_CORR), "scenario_id = 'nominal_original'")}
SELECT region, metric_a, metric_b, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM r""")
def correlation_matrix(spark, sf_dir):
    one = V.case_metrics(spark, sf_dir).filter("scenario_id = 'nominal_original'")
    return rounded(correlation.correlations(one, ["region"], correlation.all_pairs(_CORR)))


@query("A24_metric_redundancy", f"""
WITH {corr_sql("v_case_metrics", "", correlation.all_pairs(_CORR), "scenario_id = 'unlimited_useful_deadline'")}
SELECT metric_a, metric_b, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(greatest(abs(pearson), abs(spearman)), 6) AS max_abs,
       greatest(abs(pearson), abs(spearman)) >= 0.95 AS possible_double_counting, greatest(abs(pearson), abs(spearman)) >= 0.98 AS severe_redundancy FROM r""")
def metric_redundancy(spark, sf_dir):
    one = V.case_metrics(spark, sf_dir).filter("scenario_id = 'unlimited_useful_deadline'")
    return rounded(correlation.metric_redundancy(one, [], _CORR))


@query("A25_rank_agreement", f"""
WITH w AS (SELECT case_id, {", ".join(f"max({m}) FILTER (region = 'AFRICA') AS a_{m}, max({m}) FILTER (region = 'ASIA') AS b_{m}" for m in (OBS, COV, MBIT))}
           FROM v_case_metrics WHERE scenario_id = 'unlimited_useful_deadline' GROUP BY case_id),
{corr_sql("w", "", [(f"a_{m}", f"b_{m}") for m in (OBS, COV, MBIT)])}
SELECT substr(metric_a, 3) AS metric, n AS paired_cases, CASE WHEN n >= 3 THEN round(pearson, 6) END AS pearson, CASE WHEN n >= 3 THEN round(spearman, 6) END AS spearman FROM r""")
def rank_agreement(spark, sf_dir):
    from tallyfield.operators.joins import paired_regions

    one = V.case_metrics(spark, sf_dir).filter("scenario_id = 'unlimited_useful_deadline'")
    both = paired_regions(one, ["case_id"], "AFRICA", "ASIA", [OBS, COV, MBIT])
    found = correlation.correlations(both, [], [(f"a_{m}", f"b_{m}") for m in (OBS, COV, MBIT)], 3)
    return rounded(found.selectExpr("substr(metric_a, 3) as metric", "n as paired_cases", "pearson", "spearman"))


@query("A26_macro_average", """
WITH c AS (SELECT region, scenario_id, priority_class, avg(observed_before_deadline::INT) AS o, avg(surviving_coverage_deadline_percent) AS c FROM v_task_metrics GROUP BY ALL)
SELECT region, scenario_id, count(*) AS n_parts, round(avg(o), 6) AS macro_observed, round(avg(c), 6) AS macro_coverage FROM c GROUP BY region, scenario_id""")
def macro_average(spark, sf_dir):
    tasks = V.task_metrics(spark, sf_dir).selectExpr(
        "region", "scenario_id", "priority_class", "cast(observed_before_deadline as double) as observed", "surviving_coverage_deadline_percent as coverage")
    return rounded(agg.macro_average(tasks, ["region", "scenario_id"], "priority_class", ["observed", "coverage"]))


@query("A27_regional_summary", f"""
SELECT region, count(*) AS n_rows, round(avg(n_tasks), 6) AS mean_n_tasks, round(avg({OBS}), 6) AS mean_{OBS}, round(avg({COV}), 6) AS mean_{COV},
       round(avg({MBIT} / n_tasks), 6) AS mean_mbits_per_task, round(avg({EVENTS} / n_tasks), 6) AS mean_events_per_task FROM v_case_metrics GROUP BY region""")
def regional_summary(spark, sf_dir):
    rows = V.case_metrics(spark, sf_dir).selectExpr("*", f"{MBIT} / n_tasks as mbits_per_task", f"{EVENTS} / n_tasks as events_per_task")
    return rounded(agg.means_by(rows, ["region"], ["n_tasks", OBS, COV, "mbits_per_task", "events_per_task"]))


@query("A28_availability", """
SELECT region, cn_fraction_percent, count(DISTINCT case_id) AS cases, count(DISTINCT base_id) AS bases, 300 - count(DISTINCT case_id) AS missing_cases,
       300 - count(DISTINCT base_id) AS missing_bases, count(DISTINCT case_id) = 300 AND count(DISTINCT base_id) = 300 AS balanced
FROM v_case_metrics GROUP BY region, cn_fraction_percent""")
def availability(spark, sf_dir):
    return agg.availability(V.case_metrics(spark, sf_dir), ["region", "cn_fraction_percent"], 300, 300)


@query("A29_normal_ci", f"""
SELECT region, scenario_id, count({OBS}) AS n, round(avg({OBS}), 6) AS mean, round(avg({OBS}) - 1.96 * stddev_samp({OBS}) / sqrt(count({OBS})), 6) AS low,
       round(avg({OBS}) + 1.96 * stddev_samp({OBS}) / sqrt(count({OBS})), 6) AS high FROM v_case_metrics GROUP BY region, scenario_id""")
def normal_ci(spark, sf_dir):
    return rounded(agg.normal_interval(V.case_metrics(spark, sf_dir), ["region", "scenario_id"], OBS))


@query("A30_priority_pivot", "SELECT region, case_id, scenario_id, " + ", ".join(
    f"count(*) FILTER (priority_class = '{c}') AS n_tasks_{c.lower()}, round(100 * avg(observed_before_deadline::INT) FILTER (priority_class = '{c}'), 6) AS {c.lower()}_observation_success_percent, "
    f"round(100 * avg(s100_surviving_by_deadline::INT) FILTER (priority_class = '{c}'), 6) AS {c.lower()}_s100_percent" for c in CLASSES
) + " FROM v_task_metrics GROUP BY ALL")
def priority_pivot(spark, sf_dir):
    return rounded(outcomes.priority_pivot(V.task_metrics(spark, sf_dir), V.CASE_KEYS, _FLAGS, CLASSES))


_FLEET = ["region", "scenario_id", "altitude_km", "inclination_deg", "cn_fraction_percent"]
_FLEET_SQL = f"""f AS (SELECT {", ".join(_FLEET)}, n_planes, round(avg({OBS}), 9) AS {OBS}, round(avg({MBIT}), 9) AS {MBIT} FROM v_case_metrics WHERE n_planes IN (3, 4) GROUP BY ALL)"""


def _fleets(spark, sf_dir):
    rows = V.case_table(spark, sf_dir).filter("n_planes in (3, 4)")
    means = rows.groupBy(*_FLEET, "n_planes").agg(F.expr(f"round(avg({OBS}), 9) as {OBS}"), F.expr(f"round(avg({MBIT}), 9) as {MBIT}"))
    return means.filter("n_planes = 3"), means.filter("n_planes = 4")


@query("A32_cross_fleet_response", f"""
WITH {_FLEET_SQL}, m AS (SELECT a.cn_fraction_percent, a.{OBS} AS oa, b.{OBS} AS ob, a.{MBIT} AS ma, b.{MBIT} AS mb
  FROM f a JOIN f b USING (region, scenario_id, altitude_km, inclination_deg, cn_fraction_percent) WHERE a.n_planes = 3 AND b.n_planes = 4),
u AS (SELECT cn_fraction_percent, '{OBS}' AS metric, oa AS va, ob AS vb FROM m UNION ALL SELECT cn_fraction_percent, '{MBIT}', ma, mb FROM m)
SELECT cn_fraction_percent, metric, count(*) AS matched_cases, round(avg(va), 6) AS mean_three, round(avg(vb), 6) AS mean_four, round(avg(vb - va), 6) AS mean_delta FROM u GROUP BY ALL""")
def cross_fleet_response(spark, sf_dir):
    three, four = _fleets(spark, sf_dir)
    matched = matched_cross_fleet(three, four, _FLEET, [OBS, MBIT], ("three", "four"))
    return rounded(agg.cross_fleet_response(matched, ["cn_fraction_percent"], [OBS, MBIT], ("three", "four")))


@query("J04_matched_cross_fleet", f"""
WITH {_FLEET_SQL} SELECT {", ".join(_FLEET)}, round(a.{OBS}, 6) AS {OBS}_three, round(b.{OBS}, 6) AS {OBS}_four, round(b.{OBS} - a.{OBS}, 6) AS delta_{OBS}
FROM f a JOIN f b USING (region, scenario_id, altitude_km, inclination_deg, cn_fraction_percent) WHERE a.n_planes = 3 AND b.n_planes = 4""")
def matched_fleets(spark, sf_dir):
    three, four = _fleets(spark, sf_dir)
    return rounded(matched_cross_fleet(three, four, _FLEET, [OBS], ("three", "four")))


@query("A33_unique_task_counts", """
SELECT region, case_id, priority_class, count(DISTINCT task_id) AS n_tasks FROM v_task_metrics GROUP BY ALL""")
def unique_task_counts(spark, sf_dir):
    return agg.unique_task_counts(V.task_metrics(spark, sf_dir), ["region", "case_id", "priority_class"])
