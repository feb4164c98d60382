"""Joins, windows, top rows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import joins, survival, topk, windows
from tallyfield.operators.ordered import attach
from tallyfield.operators.resample import DRAWS, bootstrap_mean
from tallyfield.plans import views as V
from tallyfield.plans.draws import bootstrap_sql
from tallyfield.plans.q_aggregates import COV, EVENTS, MBIT, OBS, PRIMARY, S100, T100
from tallyfield.plans.registry import query
from tallyfield.plans.shape import rounded

NOMINAL = "scenario_id = 'nominal_original'"
UNLIMITED = "scenario_id = 'unlimited_useful_deadline'"


@query("J01_join_checked", """
SELECT l_orderkey, l_linenumber, count(*) AS n_lines, max(o_orderpriority) AS priority FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def join_checked(spark, sf_dir):
    right = V.table(spark, sf_dir, "orders").selectExpr("o_orderkey as l_orderkey", "o_orderpriority")
    left = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    joined = joins.join_checked(left, right, ["l_orderkey"], "inner", "many_to_one")
    return joined.groupBy("l_orderkey", "l_linenumber").agg(F.expr("count(*) as n_lines"), F.expr("max(o_orderpriority) as priority"))


@query("J01_join_quarantine", """
WITH once AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) = 1)
SELECT l_orderkey, l_linenumber, l_quantity, o_orderpriority FROM lineitem JOIN once USING (l_orderkey, l_linenumber) JOIN orders ON l_orderkey = o_orderkey""")
def join_quarantine(spark, sf_dir):
    keyed = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    once = joins.join_checked(
        keyed.select("l_orderkey", "l_linenumber"), keyed, ["l_orderkey", "l_linenumber"], "inner", "one_to_one", quarantine=True)
    return joins.join_checked(
        once, V.table(spark, sf_dir, "orders").selectExpr("o_orderkey as l_orderkey", "o_orderpriority"), ["l_orderkey"], "inner")


@query("J02_paired_scenarios", f"""
SELECT region, case_id, {", ".join(f"round(a.{m}, 6) AS reference_{m}, round(b.{m}, 6) AS alternative_{m}, round(b.{m} - a.{m}, 6) AS delta_{m}" for m in (OBS, COV, MBIT))}
FROM (SELECT * FROM v_case_metrics WHERE {NOMINAL}) a JOIN (SELECT * FROM v_case_metrics WHERE {UNLIMITED}) b USING (region, case_id)""")
def paired_scenarios(spark, sf_dir):
    return rounded(joins.paired_scenarios(
        V.case_metrics(spark, sf_dir), ["region", "case_id"], "scenario_id", "nominal_original", "unlimited_useful_deadline", [OBS, COV, MBIT]))


@query("J03_paired_regions", f"""
SELECT case_id, scenario_id, {", ".join(f"round(a.{m}, 6) AS a_{m}, round(b.{m}, 6) AS b_{m}, round(b.{m} - a.{m}, 6) AS delta_{m}" for m in (OBS, MBIT))}
FROM (SELECT * FROM v_case_metrics WHERE region = 'AFRICA') a JOIN (SELECT * FROM v_case_metrics WHERE region = 'ASIA') b USING (case_id, scenario_id)""")
def paired_regions(spark, sf_dir):
    return rounded(joins.paired_regions(V.case_metrics(spark, sf_dir), ["case_id", "scenario_id"], "AFRICA", "ASIA", [OBS, MBIT]))


@query("J05_attach_baseline", f"""
SELECT s.region, s.case_id, s.scenario_id, round(s.{OBS}, 6) AS {OBS}, round(b.{OBS}, 6) AS baseline_{OBS}, round(s.{OBS} - b.{OBS}, 6) AS delta_{OBS}
FROM v_case_metrics s LEFT JOIN (SELECT region, case_id, {OBS} FROM v_case_metrics WHERE {UNLIMITED}) b ON s.region = b.region AND s.case_id = b.case_id
WHERE s.failure_level_percent > 0""")
def attach_baseline(spark, sf_dir):
    facts = V.case_table(spark, sf_dir).select(*V.CASE_KEYS, "failure_level_percent", OBS)
    stressed = facts.filter("failure_level_percent > 0").drop("failure_level_percent")
    return rounded(joins.attach_baseline(stressed, facts.filter(UNLIMITED), ["region", "case_id"], [OBS]))


@query("J06_keep_members", """
SELECT task_id, scenario_id FROM v_tasks WHERE case_id IN (SELECT case_id FROM v_tasks WHERE scenario_id = 'policy_peer')""")
def keep_members(spark, sf_dir):
    tasks = V.tasks(spark, sf_dir).select("task_id", "case_id", "scenario_id")
    return joins.keep_members(tasks, tasks.filter("scenario_id = 'policy_peer'"), ["case_id"]).select("task_id", "scenario_id")


@query("J07_missing_combinations", """
WITH e AS (SELECT DISTINCT case_id, unnest(['nominal_original', 'unlimited_useful_deadline', 'policy_peer']) AS scenario_id FROM v_cases),
a AS (SELECT DISTINCT case_id, scenario_id FROM v_tasks)
SELECT case_id, scenario_id, 'missing' AS problem FROM (SELECT * FROM e EXCEPT SELECT * FROM a)
UNION ALL SELECT case_id, scenario_id, 'unexpected' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)""")
def missing_combinations(spark, sf_dir):
    expected = V.cases(spark, sf_dir).selectExpr(
        "case_id", "explode(array('nominal_original', 'unlimited_useful_deadline', 'policy_peer')) as scenario_id")
    return joins.missing_combinations(expected, V.tasks(spark, sf_dir), ["case_id", "scenario_id"])


_OPP_SQL = "o AS (SELECT region, task_id, node_id, opportunity_sec AS earliest_sec, deadline_sec FROM v_lines WHERE is_opportunity)"


def _opportunities(spark, sf_dir):
    return V.lines(spark, sf_dir).filter("is_opportunity").selectExpr("task_id", "node_id", "opportunity_sec as earliest_sec")


@query("J08_useful_recipients", f"""
WITH {_OPP_SQL} SELECT task_id, node_id, min(earliest_sec) AS earliest_sec FROM o WHERE earliest_sec <= deadline_sec GROUP BY ALL""")
def useful_recipients(spark, sf_dir):
    return joins.useful_recipients(_opportunities(spark, sf_dir), V.tasks(spark, sf_dir))


@query("J08_first_observers", f"""
WITH {_OPP_SQL}, u AS (SELECT task_id, node_id, min(earliest_sec) AS earliest_sec FROM o WHERE earliest_sec <= deadline_sec GROUP BY ALL)
SELECT task_id, node_id, earliest_sec FROM u QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY earliest_sec, node_id) <= 2""")
def first_observers(spark, sf_dir):
    return joins.useful_recipients(_opportunities(spark, sf_dir), V.tasks(spark, sf_dir), first_k=2)


@query("J09_useful_arrivals", f"""
WITH {_OPP_SQL}, u AS (SELECT DISTINCT task_id, node_id FROM o WHERE earliest_sec <= deadline_sec)
SELECT task_id, node_id, hop, end_sec, round(mbit, 6) AS mbit FROM v_transfers SEMI JOIN u USING (task_id, node_id)
WHERE from_node % 10 <> 0 AND end_sec <= deadline_sec + 1e-9""")
def useful_arrivals(spark, sf_dir):
    log = V.transfers(spark, sf_dir).selectExpr("task_id", "node_id", "hop", "end_sec", "deadline_sec", "mbit", "from_node % 10 = 0 as is_ground")
    recipients = joins.useful_recipients(_opportunities(spark, sf_dir), V.tasks(spark, sf_dir))
    return joins.useful_arrivals(log, recipients).select("task_id", "node_id", "hop", "end_sec", "mbit")


@query("J10_next_opportunity", """
WITH r AS (SELECT task_id, node_id, min(end_sec) AS recv_sec, min(deadline_sec) AS deadline_sec FROM v_transfers GROUP BY ALL),
o AS (SELECT task_id, node_id, opportunity_sec FROM v_lines WHERE is_opportunity),
j AS (SELECT task_id, node_id, recv_sec, opportunity_sec FROM r JOIN o USING (task_id, node_id) WHERE recv_sec <= deadline_sec AND opportunity_sec BETWEEN recv_sec AND deadline_sec)
SELECT task_id, opportunity_sec AS observation_sec, node_id AS observing_node, recv_sec FROM j
QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY opportunity_sec, node_id, recv_sec) = 1""")
def next_opportunity(spark, sf_dir):
    received = V.transfers(spark, sf_dir).groupBy("task_id", "node_id").agg(
        F.expr("min(end_sec) as recv_sec"), F.expr("min(deadline_sec) as deadline_sec"))
    opportunities = V.lines(spark, sf_dir).filter("is_opportunity").select("task_id", "node_id", "opportunity_sec")
    return joins.next_opportunity(received, opportunities)


_CUT = "CASE WHEN e.window_id IS NULL THEN FALSE ELSE start_sec < out_end AND end_sec > out_start END"


@query("J12_interval_subtract", """
WITH o AS (SELECT node_i, min(start_sec) + 3600 AS out_start, min(start_sec) + 900000 AS out_end FROM v_windows GROUP BY node_i),
w AS (SELECT window_id, node_i, start_sec AS s, end_sec AS e, duration_sec, capacity_mbits, out_start, out_end, start_sec < out_end AND end_sec > out_start AS hit FROM v_windows JOIN o USING (node_i)),
p AS (SELECT window_id::VARCHAR AS window_id, node_i, s AS start_sec, e AS end_sec, duration_sec, capacity_mbits, FALSE AS was_cut FROM w WHERE NOT hit
 UNION ALL SELECT window_id || '_pre', node_i, s, least(e, out_start), least(e, out_start) - s, capacity_mbits * (least(e, out_start) - s) / (e - s), TRUE FROM w WHERE hit AND least(e, out_start) > s
 UNION ALL SELECT window_id || '_post', node_i, greatest(s, out_end), e, e - greatest(s, out_end), capacity_mbits * (e - greatest(s, out_end)) / (e - s), TRUE FROM w WHERE hit AND e > greatest(s, out_end))
SELECT window_id, node_i, round(start_sec, 4) AS start_sec, round(end_sec, 4) AS end_sec, round(duration_sec, 4) AS duration_sec, round(capacity_mbits, 4) AS capacity_mbits, was_cut FROM p""")
def interval_subtract(spark, sf_dir):
    open_windows = V.windows(spark, sf_dir).select("window_id", "node_i", "start_sec", "end_sec", "duration_sec", "capacity_mbits")
    outages = open_windows.groupBy("node_i").agg(F.expr("min(start_sec) + 3600 as out_start"), F.expr("min(start_sec) + 900000 as out_end"))
    return rounded(joins.interval_subtract(open_windows, outages, ["node_i"]), 4)


@query("J13_drop_failed_endpoints", """
WITH f AS (SELECT user_id AS node_id FROM events GROUP BY user_id HAVING avg(value) > 50)
SELECT window_id, node_i, node_j FROM v_windows WHERE node_i NOT IN (SELECT node_id FROM f) AND node_j NOT IN (SELECT node_id FROM f)""")
def drop_failed_endpoints(spark, sf_dir):
    failed = V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("v")).filter("v > 50").selectExpr("user_id as node_id")
    return joins.drop_failed_endpoints(V.windows(spark, sf_dir).select("window_id", "node_i", "node_j"), failed)


@query("J14_topology_filter", """
SELECT window_id, node_i, node_j, is_ground FROM v_windows
WHERE is_ground OR node_i IN (SELECT user_id FROM events WHERE user_id % 10 < 3) OR node_j IN (SELECT user_id FROM events WHERE user_id % 10 < 3)""")
def topology_filter(spark, sf_dir):
    central = V.table(spark, sf_dir, "events").filter("user_id % 10 < 3").selectExpr("user_id as node_id").distinct()
    return joins.topology_filter(V.windows(spark, sf_dir).select("window_id", "node_i", "node_j", "is_ground"), central, "central_only")


@query("J14_candidate_pairs", """
WITH n AS (SELECT plane_id, node_id, is_central, bool_or(is_central) OVER (PARTITION BY plane_id) AS has FROM v_nodes)
SELECT a.plane_id, a.node_id AS node_i, b.node_id AS node_j FROM n a JOIN n b ON a.plane_id = b.plane_id AND a.node_id < b.node_id
WHERE a.is_central OR b.is_central OR NOT a.has""")
def candidate_pairs(spark, sf_dir):
    return joins.candidate_pairs(V.nodes(spark, sf_dir), "central_only", "plane_id")


_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("W01_keep_last", f"""
SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(c + " DESC" for c in _LINE_ORDER)}) = 1""")
def keep_last(spark, sf_dir):
    return windows.keep_last(V.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE_ORDER)


@query("W02_first_arrival", """
WITH f AS (SELECT task_id, node_id, min(end_sec) AS t FROM v_transfers GROUP BY ALL)
SELECT task_id, count(*) AS nodes_reached, max(t) AS last_first_arrival_sec FROM f GROUP BY task_id""")
def first_arrival(spark, sf_dir):
    return windows.first_arrival(V.transfers(spark, sf_dir), ["task_id"])


_LEVELS = ["region", "scenario_id", "base_id"]
_STEP_SQL = f"""l AS (SELECT region, scenario_id, base_id, cn_fraction_percent AS x, case_id, n_central_nodes, {OBS} AS o, {COV} AS c, {MBIT} AS b, {EVENTS} AS e
  FROM v_case_metrics WHERE {PRIMARY})"""


def _levels(spark, sf_dir):
    return V.case_metrics(spark, sf_dir).filter(PRIMARY).select(
        *_LEVELS, "cn_fraction_percent", "case_id", "n_central_nodes", OBS, COV, MBIT, EVENTS)


@query("W03_adjacent_deltas", f"""
WITH {_STEP_SQL}, d AS (SELECT region, scenario_id, base_id, x AS level_from, lead(x) OVER w AS level_to, case_id AS case_id_from, lead(case_id) OVER w AS case_id_to,
  lead(o) OVER w - o AS d1, lead(c) OVER w - c AS d2, lead(b) OVER w - b AS d3 FROM l WINDOW w AS (PARTITION BY region, scenario_id, base_id ORDER BY x))
SELECT region, scenario_id, base_id, level_from, level_to, case_id_from, case_id_to, round(d1, 6) AS delta_{OBS}, round(d2, 6) AS delta_{COV}, round(d3, 6) AS delta_{MBIT}
FROM d WHERE level_to IS NOT NULL""")
def adjacent_deltas(spark, sf_dir):
    return rounded(windows.adjacent_deltas(_levels(spark, sf_dir), _LEVELS, "cn_fraction_percent", [OBS, COV, MBIT]))


@query("W04_marginal_gain", f"""
WITH {_STEP_SQL}, d AS (SELECT region, scenario_id, base_id, x, n_central_nodes - lag(n_central_nodes) OVER w AS added, o - lag(o) OVER w AS d1
  FROM l WINDOW w AS (PARTITION BY region, scenario_id, base_id ORDER BY x))
SELECT region, scenario_id, base_id, x AS cn_fraction_percent, added, round(d1, 6) AS delta_{OBS}, round(d1 / nullif(added, 0), 6) AS gain_{OBS} FROM d""")
def marginal_gain(spark, sf_dir):
    return rounded(windows.marginal_gain(_levels(spark, sf_dir), _LEVELS, "cn_fraction_percent", "n_central_nodes", [OBS]))


@query("W05_trend_class", f"""
WITH {_STEP_SQL}, k AS (SELECT region, scenario_id, base_id, x, b, b - lag(b) OVER w AS d, row_number() OVER w AS pos,
    rank() OVER (PARTITION BY region, scenario_id, base_id ORDER BY b) + (count(*) OVER (PARTITION BY region, scenario_id, base_id, b) - 1) / 2.0 AS rb,
    max(b) OVER (PARTITION BY region, scenario_id, base_id) AS top FROM l WINDOW w AS (PARTITION BY region, scenario_id, base_id ORDER BY x)),
s AS (SELECT region, scenario_id, base_id, count(*) AS n_levels, coalesce(bool_and(d >= -1e-9), true) AS up, coalesce(bool_and(d <= 1e-9), true) AS down,
    min(pos) FILTER (b = top) AS peak, max_by(b, x) - min_by(b, x) AS ch, CASE WHEN count(*) >= 3 AND var_pop(rb) > 1e-12 THEN corr(pos, rb) END AS rho FROM k GROUP BY ALL)
SELECT region, scenario_id, base_id, n_levels, CASE WHEN up THEN 'monotonic_nondecreasing' WHEN down THEN 'monotonic_nonincreasing'
       WHEN peak > 1 AND peak < n_levels THEN 'interior_peak_or_mixed' ELSE 'mixed' END AS trend, round(rho, 6) AS spearman, round(ch, 6) AS endpoint_change FROM s""")
def trend_class(spark, sf_dir):
    return rounded(windows.trend_class(_levels(spark, sf_dir), _LEVELS, "cn_fraction_percent", MBIT))


@query("W06_saturation_level", f"""
WITH {_STEP_SQL}, d AS (SELECT *, abs(lead(o) OVER (PARTITION BY region, scenario_id, base_id ORDER BY x) - o) AS d FROM l),
c AS (SELECT *, bool_and(coalesce(d < 1, true)) OVER (PARTITION BY region, scenario_id, base_id ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS calm FROM d)
SELECT region, scenario_id, base_id, min(x) FILTER (calm AND d IS NOT NULL) AS saturation_level FROM c GROUP BY ALL""")
def saturation_level(spark, sf_dir):
    return windows.saturation_level(_levels(spark, sf_dir), _LEVELS, "cn_fraction_percent", OBS)


@query("W07_islands", """
WITH f AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value, event_type <> 'error' AS f, event_id, lag(event_type <> 'error') OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum((f AND NOT coalesce(p, false))::INT) OVER (PARTITION BY user_id ORDER BY t, event_id)::BIGINT AS run_no FROM f)
SELECT user_id, run_no, round(min(t), 4) AS start_at, round(least(max(t) + 60, 1706745600), 4) AS end_at, count(*) AS n_samples, round(min(value), 6) AS min_payload, round(max(value), 6) AS max_payload, round(avg(value), 6) AS mean_payload
FROM g WHERE f GROUP BY user_id, run_no HAVING least(max(t) + 60, 1706745600) > min(t)""")
def islands(spark, sf_dir):
    series = V.table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "unix_micros(ts) / 1e6D as t", "value", "event_type")
    out = windows.islands(series, ["user_id"], ["t", "event_id"], F.expr("event_type <> 'error'"), "t", 60.0, 1706745600.0, "value")
    return rounded(out.withColumns({c: F.expr(f"round(round({c}, 8), 4)") for c in ("start_at", "end_at")}))


_EVENTS = {
    "follow_up_observation": ("observed_before_deadline", "observation_latency_min"),
    "full_dissemination_S100": ("s100_surviving_by_deadline", "t100_surviving_min"),
}
_TTE_SQL = """e AS (SELECT region, case_id, base_id, scenario_id, task_id, priority_class, cn_fraction_percent, event_name, coalesce(flag AND t <= cen + 1e-9, false) AS event,
    CASE WHEN coalesce(flag AND t <= cen + 1e-9, false) THEN t ELSE cen END AS duration_min
  FROM (SELECT *, (deadline_sec - created_sec) / 60 AS cen, 'follow_up_observation' AS event_name, observed_before_deadline AS flag, observation_latency_min AS t FROM v_task_metrics
        UNION ALL SELECT *, (deadline_sec - created_sec) / 60, 'full_dissemination_S100', s100_surviving_by_deadline, t100_surviving_min FROM v_task_metrics))"""
_TTE_KEYS = ["region", "case_id", "base_id", "scenario_id", "task_id", "priority_class", "cn_fraction_percent"]


def _tte(spark, sf_dir):
    return survival.time_to_event(V.task_metrics(spark, sf_dir), _TTE_KEYS, _EVENTS)


def km_sql(keys: str, horizon: str | None = None, clip: bool = False, where: str = "true") -> str:
    """SQL: CTEs st (steps) and km (summary) from e."""
    h = horizon or "NULL::DOUBLE"
    time = "least(duration_min, h)" if clip else "duration_min"
    hz = "h" if clip else "least(coalesce(h, longest), longest)"
    return f"""c0 AS (SELECT {keys}, {time} AS t, sum(event::INT) AS d, count(*) - sum(event::INT) AS c, max(h) AS h FROM (SELECT *, {h} AS h FROM e WHERE {where}) WHERE duration_min >= 0 GROUP BY ALL),
c1 AS (SELECT *, sum(d + c) OVER (PARTITION BY {keys}) AS n_total, max(t) OVER (PARTITION BY {keys}) AS longest,
          sum(d + c) OVER (PARTITION BY {keys} ORDER BY t DESC) AS at_risk FROM c0),
c2 AS (SELECT *, {hz} AS horizon FROM c1), c3 AS (SELECT * FROM c2 WHERE t <= horizon),
st AS (SELECT *, product(1 - d / at_risk) OVER (PARTITION BY {keys} ORDER BY t) AS s FROM c3),
st2 AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY {keys} ORDER BY t), 1) * (t - coalesce(lag(t) OVER (PARTITION BY {keys} ORDER BY t), 0)) AS area FROM st),
km AS (SELECT {keys}, max(n_total)::BIGINT AS n, max(horizon) AS horizon, 1 - min(s) AS event_probability, sum(area) + min(s) * greatest(0, max(horizon) - max(t)) AS rmst FROM st2 GROUP BY ALL)"""


@query("W08_km_curve", f"""
WITH {_TTE_SQL}, {km_sql("region, event_name, priority_class")}
SELECT region, event_name, priority_class, round(t, 6) AS time_min, round(s, 6) AS survival, round(1 - s, 6) AS event_probability, at_risk::BIGINT AS at_risk, d::BIGINT AS events, c::BIGINT AS censored, round(horizon, 6) AS horizon FROM st
UNION ALL SELECT DISTINCT region, event_name, priority_class, 0, 1, 0, n_total::BIGINT, 0, 0, round(horizon, 6) FROM c2""")
def km_curve(spark, sf_dir):
    return rounded(survival.km_curve(_tte(spark, sf_dir), ["region", "event_name", "priority_class"]))


@query("W08_rmst", f"""
WITH {_TTE_SQL}, {km_sql("region, scenario_id, event_name")}
SELECT region, scenario_id, event_name, n, round(horizon, 6) AS horizon, round(event_probability, 6) AS event_probability, round(rmst, 4) AS rmst FROM km""")
def rmst(spark, sf_dir):
    out = survival.km_summary(_tte(spark, sf_dir), ["region", "scenario_id", "event_name"])
    return rounded(out.withColumn("rmst", F.expr("round(round(rmst, 8), 4)")))


@query("W09_time_to_event", f"""
WITH {_TTE_SQL} SELECT region, task_id, event_name, event, round(duration_min, 6) AS duration_min FROM e""")
def time_to_event(spark, sf_dir):
    return rounded(_tte(spark, sf_dir).select("region", "task_id", "event_name", "event", "duration_min"))


_HORIZON = {"Critical": 180, "High": 360, "Medium": 1080, "Low": 2160}
_HORIZON_SQL = "CAST(CASE priority_class " + " ".join(f"WHEN '{k}' THEN {v * 1440.0 * 0.75}" for k, v in _HORIZON.items()) + " END AS DOUBLE)"


@query("W10_event_summary", f"""
WITH {_TTE_SQL}, {km_sql("region, scenario_id, event_name, base_id", where=PRIMARY)}, {bootstrap_sql("km", "region, scenario_id, event_name", "event_probability", "base_id", DRAWS, 7, "bp")},
{bootstrap_sql("km", "region, scenario_id, event_name", "rmst", "base_id", DRAWS, 7, "br")}
SELECT region, scenario_id, event_name, bp.n_units AS bases, round(bp.mean, 6) AS mean_probability, round(bp.low, 6) AS low_probability, round(bp.high, 6) AS high_probability,
       round(br.mean, 4) AS mean_rmst, round(br.low, 4) AS low_rmst, round(br.high, 4) AS high_rmst FROM bp JOIN br USING (region, scenario_id, event_name)""")
def event_summary(spark, sf_dir):
    """Per-base curves, then the mean over bases with its interval."""
    group = ["region", "scenario_id", "event_name"]
    bases = survival.km_summary(_tte(spark, sf_dir).filter(PRIMARY), [*group, "base_id"])
    long = bootstrap_mean(bases, group, ["event_probability", "rmst"], ["base_id"], DRAWS, 7)
    pick = lambda c, m, n, d: F.expr(f"round(max({c}) filter (where metric = '{m}'), {d}) as {n}")
    return long.groupBy(*group).agg(
        F.expr("max(n_units) as bases"),
        *[pick(c, "event_probability", f"{c}_probability", 6) for c in ("mean", "low", "high")],
        *[pick(c, "rmst", f"{c}_rmst", 4) for c in ("mean", "low", "high")],
    )


@query("W10_priority_summary", f"""
WITH {_TTE_SQL}, {km_sql("region, event_name, priority_class", _HORIZON_SQL, clip=True)}
SELECT region, event_name, priority_class, n, round(horizon, 6) AS horizon, round(event_probability, 6) AS event_probability, round(rmst, 4) AS rmst, round(1 - rmst / horizon, 6) AS speed FROM km""")
def priority_event_summary(spark, sf_dir):
    """Fixed horizon per class; speed = 1 - restricted mean / horizon."""
    out = survival.km_summary(_tte(spark, sf_dir), ["region", "event_name", "priority_class"], horizon=_HORIZON_SQL, clip=True)
    return rounded(out.selectExpr("*", "1 - rmst / horizon as speed").withColumn("rmst", F.expr("round(round(rmst, 8), 4)")))


@query("W12_rank_min", f"""
SELECT region, case_id, scenario_id, round({MBIT}, 6) AS {MBIT}, rank() OVER (PARTITION BY region ORDER BY {EVENTS} DESC) AS score_rank FROM v_case_metrics""")
def rank_min(spark, sf_dir):
    out = windows.rank_min(V.case_table(spark, sf_dir), ["region"], EVENTS)
    return rounded(out.select(*V.CASE_KEYS, MBIT, "score_rank"))


@query("W13_dispatch_order", """
SELECT task_id, label, row_number() OVER (ORDER BY r, pr, price DESC, task_id) AS dispatch_order, row_number() OVER (PARTITION BY label ORDER BY r, pr, price DESC, task_id) AS sequence_in_package
FROM (SELECT *, CASE WHEN priority_class IN ('Critical', 'High') THEN 'urgent' ELSE 'routine' END AS label, CASE WHEN priority_class IN ('Critical', 'High') THEN 0 ELSE 1 END AS r,
             CASE priority_class WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS pr FROM v_tasks)""")
def dispatch_order(spark, sf_dir):
    from tallyfield.functions.scalars import PRIORITY_RANK, mapped, priority_package

    label, rank = priority_package(F.col("priority_class"), "two_level")
    packed = V.tasks(spark, sf_dir).select(
        "task_id", "price", label.alias("label"), rank.alias("r"), mapped(F.col("priority_class"), PRIORITY_RANK, 9).alias("pr"))
    order = [F.col("r"), F.col("pr"), F.col("price").desc(), F.col("task_id")]
    return windows.dispatch_order(packed, order, "label").select("task_id", "label", "dispatch_order", "sequence_in_package")


@query("W14_share_within_group", """
SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY scenario_id, priority_class), 6) AS share_percent
FROM (SELECT scenario_id, priority_class, failure_class, count(*) AS n FROM v_task_metrics GROUP BY ALL)""")
def share_within_group(spark, sf_dir):
    return rounded(windows.share_within(V.task_metrics(spark, sf_dir), ["scenario_id", "priority_class"], "failure_class"))


@query("W15_best_in_group", """
SELECT s_suppkey, s_nationkey, round(s_acctbal, 6) AS s_acctbal, s_acctbal = min(s_acctbal) OVER (PARTITION BY s_nationkey) AS is_best FROM supplier""")
def best_in_group(spark, sf_dir):
    return rounded(windows.best_in_group(V.table(spark, sf_dir, "supplier").drop("s_name"), ["s_nationkey"], "s_acctbal"))


@query("W16_revisit_stats", """
WITH g AS (SELECT node_id, (end_sec - lag(end_sec) OVER (PARTITION BY node_id ORDER BY end_sec, task_id, hop)) / 3600 AS h FROM v_transfers)
SELECT node_id, count(*) AS n_observations, round(avg(h), 6) AS mean_revisit_hr, round(max(h), 6) AS max_revisit_hr, round(min(h), 6) AS min_revisit_hr FROM g GROUP BY node_id""")
def revisit_stats(spark, sf_dir):
    seen = V.transfers(spark, sf_dir).select("node_id", "end_sec", "task_id", "hop")
    return rounded(windows.revisit_stats(seen, ["node_id"], ["end_sec", "task_id", "hop"], "end_sec"))


@query("T01_top_n", f"""
SELECT region, case_id, scenario_id, round({COV}, 6) AS {COV}, {EVENTS} FROM v_case_metrics ORDER BY {COV} DESC NULLS LAST, {EVENTS}, region, case_id, scenario_id LIMIT 30""")
def top_n(spark, sf_dir):
    facts = V.case_metrics(spark, sf_dir).select(*V.CASE_KEYS, F.expr(f"round({COV}, 6) as {COV}"), EVENTS)
    return topk.top_n(facts, [F.col(COV).desc(), F.col(EVENTS), *[F.col(c) for c in V.CASE_KEYS]], 30)


@query("T02_top_n_per_group", f"""
SELECT region, case_id, scenario_id, {EVENTS} FROM v_case_metrics QUALIFY row_number() OVER (PARTITION BY region ORDER BY {EVENTS} DESC, case_id, scenario_id) <= 10""")
def top_n_per_group(spark, sf_dir):
    facts = V.case_metrics(spark, sf_dir).select(*V.CASE_KEYS, EVENTS)
    return topk.top_n_per_group(facts, ["region"], [F.col(EVENTS).desc(), F.col("case_id"), F.col("scenario_id")], 10)


@query("T03_perfect_cases", f"""
SELECT region, case_id, scenario_id, n_satellites, n_central_nodes FROM v_case_metrics WHERE {OBS} >= 100 AND {S100} >= 100 AND {COV} >= 100""")
def perfect_cases(spark, sf_dir):
    return topk.perfect_cases(
        V.case_metrics(spark, sf_dir), [OBS, S100, COV], ["n_satellites", "n_central_nodes", MBIT, T100, *V.CASE_KEYS]
    ).select(*V.CASE_KEYS, "n_satellites", "n_central_nodes")


@query("T04_targeted_nodes", """
WITH e AS (SELECT node_i AS n, node_j AS p, capacity_mbits AS c FROM v_windows UNION ALL SELECT node_j, node_i, capacity_mbits FROM v_windows),
s AS (SELECT n AS node_id, round(sum(c), 9) AS capacity, count(DISTINCT p) AS degree FROM e GROUP BY n),
c AS (SELECT DISTINCT user_id AS node_id FROM events WHERE user_id % 10 < 3)
SELECT node_id, round(coalesce(capacity, 0), 6) AS capacity, coalesce(degree, 0) AS degree, row_number() OVER (ORDER BY coalesce(capacity, 0) DESC, coalesce(degree, 0) DESC, node_id) AS position
FROM c LEFT JOIN s USING (node_id) QUALIFY position <= greatest(1, ceil((SELECT count(*) FROM c) * 20 / 100.0))""")
def targeted_nodes(spark, sf_dir):
    users = V.table(spark, sf_dir, "events").selectExpr("user_id as node_id", "user_id % 10 < 3 as is_central").distinct()
    return rounded(topk.targeted_nodes(V.windows(spark, sf_dir), users, [], 20.0))


@query("U01_union_promote", """
SELECT task_id, 'main' AS part, priority_class, NULL::DOUBLE AS failure_level_percent FROM v_tasks WHERE NOT stressed
UNION ALL SELECT task_id, 'stress', NULL, failure_level_percent FROM v_tasks WHERE stressed""")
def union_promote(spark, sf_dir):
    from tallyfield.sources.tables import union_promote as promote

    tasks = V.tasks(spark, sf_dir)
    return promote([
        tasks.filter("not stressed").selectExpr("task_id", "'main' as part", "priority_class"),
        tasks.filter("stressed").selectExpr("task_id", "'stress' as part", "failure_level_percent"),
    ]).select("task_id", "part", "priority_class", "failure_level_percent")


@query("U02_id_sets", """
WITH a AS (SELECT DISTINCT case_id FROM v_tasks WHERE scenario_id = 'policy_peer'), b AS (SELECT DISTINCT case_id FROM v_tasks WHERE scenario_id = 'policy_hybrid')
SELECT case_id, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT case_id, 'first_only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT case_id, 'second_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def id_sets(spark, sf_dir):
    from tallyfield.sources.tables import id_sets as sets

    tasks = V.tasks(spark, sf_dir)
    return sets(tasks.filter("scenario_id = 'policy_peer'"), tasks.filter("scenario_id = 'policy_hybrid'"), "case_id")
