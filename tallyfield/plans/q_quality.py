"""Q01-Q16: gates over the case, task and line tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import quality
from tallyfield.plans import views as V
from tallyfield.plans.q_aggregates import EVENTS, OBS
from tallyfield.plans.q_decision import PAIRS
from tallyfield.plans.registry import query
from tallyfield.plans.shape import rounded
from tallyfield.session import scratch_path
from tallyfield.sources import tables

# A case counts as done if its customer's balance is not negative, as failed if it is below -900.
_CASES_SQL = """cs AS (SELECT case_id, base_id, cn_fraction_percent, c_acctbal >= 0 AS success_marker, c_acctbal < -900 AS failed_marker
  FROM v_cases JOIN customer USING (c_custkey))"""


def _cases(spark, sf_dir):
    marks = V.table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal >= 0 as success_marker", "c_acctbal < -900 as failed_marker")
    return V.cases(spark, sf_dir).join(marks, "c_custkey").select("case_id", "base_id", "cn_fraction_percent", "success_marker", "failed_marker")


def _facts(spark, sf_dir):
    """Task-level rows stand in for raw scenario rows: resumed work shows as repeated (case, scenario)."""
    return V.tasks(spark, sf_dir).select("case_id", "scenario_id", "status")


_COUNTS_SQL = f"""{_CASES_SQL}, pc AS (SELECT case_id, count(*) AS raw, count(DISTINCT scenario_id) AS uniq, count(*) FILTER (status = 'FAILED') AS fl FROM v_tasks GROUP BY case_id),
j AS (SELECT cs.*, coalesce(raw, 0) AS raw, coalesce(uniq, 0) AS uniq, coalesce(fl, 0) AS fl FROM cs LEFT JOIN pc USING (case_id)),
bs AS (SELECT base_id, count(DISTINCT cn_fraction_percent) AS have, count(*) AS n FROM j WHERE success_marker GROUP BY base_id),
cf AS (SELECT count(*) AS conflicting_duplicate_keys FROM (SELECT 1 FROM v_tasks GROUP BY case_id, scenario_id HAVING count(DISTINCT status) > 1)),
vf AS (SELECT count(*) AS validation_failures FROM v_tasks WHERE NOT coalesce(price > 50000, false)),
k AS (SELECT count(*) AS case_directories, count(DISTINCT base_id) AS base_architectures, count(*) FILTER (success_marker) AS success_markers, count(*) FILTER (failed_marker) AS failed_markers,
   sum(uniq)::BIGINT AS unique_scenario_rows, sum(fl)::BIGINT AS failed_status_rows, sum(raw - uniq)::BIGINT AS duplicate_rows, count(*) FILTER (uniq = 5) AS complete_cases,
   count(DISTINCT cn_fraction_percent) AS levels_present FROM j),
b AS (SELECT count(*) FILTER (have = 5) AS balanced_bases, coalesce(sum(n) FILTER (have = 5), 0)::BIGINT AS balanced_cases FROM bs)"""
_REQUIRED = {
    "case_directories": 1500, "base_architectures": 300, "success_markers": 1500, "failed_markers": 0, "unique_scenario_rows": 7500,
    "failed_status_rows": 0, "duplicate_rows": 0, "conflicting_duplicate_keys": 0, "validation_failures": 0, "complete_cases": 1500, "levels_present": 5, "balanced_bases": 300, "balanced_cases": 1500,
}


@query("Q01_completion_gate", f"WITH {_COUNTS_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"check\", {c} AS observed, {n}::BIGINT AS required, {c} = {n} AS passed FROM k, b, cf, vf" for c, n in _REQUIRED.items()))
def completion_gate(spark, sf_dir):
    checks = V.tasks(spark, sf_dir).selectExpr("price > 50000 as passed")
    counts = quality.completion_counts(_facts(spark, sf_dir), _cases(spark, sf_dir), [], 5, ["status"], checks)
    return quality.exact_counts(counts, _REQUIRED)


@query("Q02_archive_audit", f"""
WITH {_COUNTS_SQL}, e AS (SELECT uniq AS expected_rows FROM j WHERE success_marker GROUP BY uniq ORDER BY count(*) DESC, uniq LIMIT 1)
SELECT case_id, j.base_id, success_marker, raw AS raw_rows, uniq AS unique_rows, raw - uniq AS duplicate_rows, expected_rows, expected_rows - uniq AS missing_rows,
       coalesce(have = 5, false) AS balanced_base FROM j LEFT JOIN bs USING (base_id), e""")
def archive_audit(spark, sf_dir):
    return quality.archive_audit(_facts(spark, sf_dir), _cases(spark, sf_dir))


@query("Q02_value_histogram", """
SELECT coalesce(CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END, 'MISSING') AS value, count(*) AS n FROM orders GROUP BY ALL""")
def value_histogram(spark, sf_dir):
    rows = V.table(spark, sf_dir, "orders").selectExpr("if(o_orderkey % 10 <> 0, o_orderpriority, null) as fingerprint")
    return quality.value_histogram(rows, "fingerprint")


@query("Q03_conflicting_duplicates", """
SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_shipdate)) AS duplicate_versions FROM lineitem GROUP BY ALL HAVING duplicate_versions > 1""")
def conflicting_duplicates(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem")
    return quality.conflicting_duplicates(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_shipdate"])


@query("Q04_recompute_compare", f"""
WITH s AS (SELECT region, case_id, scenario_id, count(*) AS n_tasks, 100 * avg(observed_before_deadline::INT) AS o, sum(n_transfers) + (max(task_id) % 5 = 0)::INT AS e FROM v_task_metrics GROUP BY ALL),
d AS (SELECT abs(s.n_tasks - m.n_tasks)::DOUBLE AS d1, abs(o - {OBS}) AS d2, abs(e - {EVENTS})::DOUBLE AS d3 FROM s JOIN v_case_metrics m USING (region, case_id, scenario_id)),
u AS (SELECT 'n_tasks' AS metric, d1 AS d FROM d UNION ALL SELECT '{OBS}', d2 FROM d UNION ALL SELECT '{EVENTS}', d3 FROM d)
SELECT metric, count(*) AS compared, count(*) FILTER (d > 1e-6) AS failures, round(max(d), 6) AS max_abs_difference, count(*) FILTER (d > 1e-6) = 0 AS passed FROM u GROUP BY metric""")
def recompute_compare(spark, sf_dir):
    """The reported event count is off by one where the largest task id is a multiple of five."""
    reported = V.task_metrics(spark, sf_dir).groupBy(*V.CASE_KEYS).agg(
        F.expr("count(*) as n_tasks"), F.expr(f"100 * avg(cast(observed_before_deadline as double)) as {OBS}"),
        F.expr(f"sum(n_transfers) + cast(max(task_id) % 5 = 0 as int) as {EVENTS}"))
    return rounded(quality.recompute_compare(reported, V.case_table(spark, sf_dir), V.CASE_KEYS, ["n_tasks", OBS, EVENTS]))


@query("Q05_event_invariants", """
WITH f AS (SELECT region, task_id, min(end_sec) AS first_reception_sec FROM v_lines GROUP BY ALL),
t AS (SELECT m.*, f.first_reception_sec, created_sec + observation_latency_min * 60 AS obs FROM v_task_metrics m JOIN f USING (region, task_id)),
c AS (SELECT priority_class, count(*) FILTER (first_reception_sec + 1e-9 < created_sec) AS a, count(*) FILTER (observed_before_deadline AND obs + 1e-9 < first_reception_sec) AS b,
  count(*) FILTER (observed_before_deadline AND obs > deadline_sec + 1e-9) AS c, count(*) FILTER (reached_original_by_deadline > original_target_count + 1e-9) AS d,
  count(*) FILTER (surviving_target_count <> original_target_count) AS e, count(*) FILTER (reached_surviving_by_end <> reached_original_by_end) AS f FROM t GROUP BY ALL)
""" + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT priority_class, '{n}' AS \"check\", {col} AS violations, {col} = 0 AS passed FROM c"
    for n, col in zip(("first_reception_not_before_creation", "observation_not_before_first_reception", "observation_within_deadline",
                       "reached_not_above_targets", "targets_match_reported", "reached_match_reported"), "abcdef")) + ")")
def event_invariants(spark, sf_dir):
    """First reception is taken from all lines, so lines shipped before their order show as violations."""
    first = V.lines(spark, sf_dir).groupBy("region", "task_id").agg(F.expr("min(end_sec) as first_reception_sec"))
    rows = V.task_metrics(spark, sf_dir).join(first, ["region", "task_id"]).selectExpr(
        "priority_class", "first_reception_sec", "created_sec", "deadline_sec", "observed_before_deadline as observed",
        "created_sec + observation_latency_min * 60 as observation_sec", "reached_original_by_deadline as n_reached",
        "original_target_count as n_targets", "surviving_target_count as derived_targets", "reached_surviving_by_end as derived_reached",
        "reached_original_by_end as n_reached_ever")
    return quality.event_invariants(rows, ["priority_class"])


@query("Q06_config_invariants", " UNION ALL ".join(
    f"SELECT family, '{c}' AS field, count(DISTINCT {c}) AS distinct_values, count(DISTINCT {c}) = 1 AS passed FROM v_tasks GROUP BY family"
    for c in ("topology", "routing_policy", "task_size_multiplier", "failure_level_percent")))
def config_invariants(spark, sf_dir):
    return quality.config_invariants(
        V.tasks(spark, sf_dir), ["family"], ["topology", "routing_policy", "task_size_multiplier", "failure_level_percent"])


@query("Q07_id_vs_manifest", """
WITH c AS (SELECT *, n_satellites + (c_custkey % 50 = 0)::INT AS s1, altitude_km + (c_custkey % 70 = 0)::INT AS a2 FROM v_cases)
SELECT case_id, 'n_satellites' AS field FROM c WHERE c_custkey % 3 <> 0 AND s1 <> n_satellites UNION ALL SELECT case_id, 'altitude_km' FROM c WHERE a2 <> altitude_km""")
def id_vs_manifest(spark, sf_dir):
    """The first manifest lacks every third case and has some wrong sizes; the second some wrong altitudes."""
    cases = V.cases(spark, sf_dir)
    fields = ["n_satellites", "n_planes", "altitude_km"]
    first = cases.filter("c_custkey % 3 <> 0").selectExpr("case_id", "n_satellites + cast(c_custkey % 50 = 0 as int) as n_satellites", "n_planes", "altitude_km")
    second = cases.selectExpr("case_id", "n_satellites", "n_planes", "altitude_km + cast(c_custkey % 70 = 0 as int) as altitude_km")
    return quality.id_vs_manifest(cases, first, second, fields)


@query("Q08_identical_source", """
WITH d AS (SELECT l_returnflag, l_linestatus, sha256(l_partkey || '|' || l_suppkey) AS h FROM lineitem),
f AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(('0x' || substr(h, 1, 13))::BIGINT) AS a, sum(('0x' || substr(h, 14, 13))::BIGINT) AS b FROM d GROUP BY ALL)
SELECT l_returnflag, count(*) AS units, count(DISTINCT (n, a, b)) AS distinct_contents, count(DISTINCT n) AS distinct_row_counts, count(DISTINCT (n, a, b)) = 1 AND count(DISTINCT n) = 1 AS passed FROM f GROUP BY l_returnflag""")
def identical_source(spark, sf_dir):
    return quality.identical_source(V.table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_linestatus"], ["l_partkey", "l_suppkey"])


_INTENDED_SQL = "it AS (SELECT region, median(n_tasks)::BIGINT AS intended_task_count FROM v_case_metrics GROUP BY region)"


def _intended(facts):
    from tallyfield.operators.aggregates import MEDIAN, summary

    return summary(facts, ["region"], ["n_tasks"], ["median"], MEDIAN).selectExpr("region", "cast(round(median) as long) as intended_task_count")


@query("Q09_population_contract", f"""
WITH {_INTENDED_SQL} SELECT m.region, case_id, count(*) AS completed_rows, count(DISTINCT n_tasks) AS distinct_task_counts, min(n_tasks) AS minimum_task_count, max(n_tasks) AS maximum_task_count,
  max(intended_task_count) AS intended_task_count, count(DISTINCT n_tasks) = 1 AND min(n_tasks) = max(intended_task_count) AS uses_intended_count FROM v_case_metrics m JOIN it USING (region) GROUP BY m.region, case_id""")
def population_contract(spark, sf_dir):
    facts = V.case_table(spark, sf_dir).select(*V.CASE_KEYS, "n_tasks")
    return quality.population_contract(facts, ["region", "case_id"], _intended(facts), ["region"])


@query("Q09_pair_contract", f"WITH {_INTENDED_SQL}, p AS (" + " UNION ALL ".join(
    f"SELECT a.region, '{x}' AS reference, '{y}' AS alternative, a.n_tasks AS r, b.n_tasks AS a FROM (SELECT * FROM v_case_metrics WHERE scenario_id = '{x}') a JOIN (SELECT * FROM v_case_metrics WHERE scenario_id = '{y}') b USING (region, case_id)"
    for x, y in PAIRS) + """) SELECT region, reference, alternative, count(*) AS paired_cases, count(*) FILTER (r = a) AS same_task_count_cases,
  count(*) FILTER (r = a AND r = intended_task_count) AS intended_task_count_cases, count(*) FILTER (r <> a) AS mismatched_task_count_cases FROM p JOIN it USING (region) GROUP BY ALL""")
def pair_contract(spark, sf_dir):
    facts = V.case_table(spark, sf_dir).select(*V.CASE_KEYS, "n_tasks")
    return quality.pair_contract(facts, ["region"], PAIRS, _intended(facts))


@query("Q10_scope_gate", """
WITH o AS (SELECT count(*) AS n_rows, count(DISTINCT case_id) AS cases, count(DISTINCT scenario_id) AS scenarios FROM v_tasks)
SELECT 'n_rows' AS "check", n_rows AS observed, 15000::BIGINT AS required, n_rows = 15000 AS passed FROM o UNION ALL
SELECT 'cases', cases, 1500, cases = 1500 FROM o UNION ALL SELECT 'scenarios', scenarios, 80, scenarios = 80 FROM o""")
def scope_gate(spark, sf_dir):
    return quality.scope_gate(V.tasks(spark, sf_dir), 15000, {"cases": 1500, "scenarios": 80})


@query("Q11_task_contract", """
WITH e AS (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders), a AS (
  SELECT o_orderkey + (o_orderkey % 100 = 0)::INT * 1000000000 AS o_orderkey, CASE WHEN o_orderkey % 40 = 1 THEN 'X' ELSE o_orderpriority END AS o_orderpriority, o_totalprice, CASE WHEN o_orderkey % 60 <> 0 THEN 1 END AS lat FROM orders),
j AS (SELECT count(*) FILTER (a.o_orderkey IS NULL) AS p, count(*) FILTER (e.o_orderkey IS NULL) AS q, count(*) FILTER (e.o_orderpriority <> a.o_orderpriority) AS r, count(*) FILTER (a.o_orderkey IS NOT NULL AND lat IS NULL) AS s FROM e FULL JOIN a ON e.o_orderkey = a.o_orderkey)
SELECT 'missing_ids' AS "check", p AS violations, p = 0 AS passed FROM j UNION ALL SELECT 'unexpected_ids', q, q = 0 FROM j
UNION ALL SELECT 'changed_rows', r, r = 0 FROM j UNION ALL SELECT 'coordinates_not_finite', s, s = 0 FROM j""")
def task_contract(spark, sf_dir):
    """The second table has some ids moved away, some changed classes and some missing coordinates."""
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    changed = orders.selectExpr(
        "o_orderkey + if(o_orderkey % 100 = 0, 1000000000L, 0L) as o_orderkey", "if(o_orderkey % 40 = 1, 'X', o_orderpriority) as o_orderpriority",
        "o_totalprice", "if(o_orderkey % 60 <> 0, 1D, null) as latitude", "2D as longitude")
    return quality.task_contract(orders, changed, "o_orderkey", ["o_orderpriority", "o_totalprice"])


@query("Q11_table_contract", """
WITH t AS (SELECT family, task_id, priority_class, scenario_id, length(task_id::VARCHAR) || ':' || task_id AS i FROM v_tasks),
d AS (SELECT *, sha256(i) AS a, sha256(i || length(scenario_id) || ':' || scenario_id || length(priority_class) || ':' || priority_class) AS b FROM t),
s AS (SELECT family, count(*) AS n, count(DISTINCT task_id) AS u, """ + ", ".join(
    f"sum(('0x' || substr({h}, {at}, 13))::BIGINT) AS {h}{at}" for h in "ab" for at in (1, 14, 27)) + """ FROM d GROUP BY family),
l AS (SELECT family, string_agg(priority_class || '=' || n, ';' ORDER BY priority_class) AS label_counts FROM (SELECT family, priority_class, count(*) AS n FROM t GROUP BY ALL) GROUP BY family)
SELECT family, n AS task_count, u AS unique_task_count, """ + ", ".join(
    f"sha256(n || '|' || lpad({h}1::VARCHAR, 38, '0') || '|' || lpad({h}14::VARCHAR, 38, '0') || '|' || lpad({h}27::VARCHAR, 38, '0')) AS {name}"
    for h, name in (("a", "ids_digest"), ("b", "rows_digest"))) + """, label_counts FROM s JOIN l USING (family)""")
def table_contract(spark, sf_dir):
    found = quality.table_contract(V.tasks(spark, sf_dir), "task_id", ["scenario_id", "priority_class"], "priority_class", ["family"])
    return found.withColumn("label_counts", F.expr("array_join(transform(label_counts, x -> concat(x.label, '=', x.n)), ';')"))


_PARTS_SQL = """p AS (SELECT 'part' || o.o_orderkey % 7 AS part, case_id, CASE WHEN o.o_orderkey % 500 = 3 THEN 'other' ELSE case_id END AS part_case, scenario_id,
  CASE WHEN o.o_orderkey % 300 = 5 THEN 'RUNNING' ELSE status END AS status, o.o_orderkey % 4 AS n_tasks FROM v_tasks JOIN orders o ON o_orderkey = task_id)"""


@query("Q12_partition_contract", f"""
WITH {_PARTS_SQL}, s AS (SELECT case_id, scenario_id, part, count(*) AS n FROM p GROUP BY ALL)
SELECT 'wrong_case' AS defect, part AS subject, count(*) AS n FROM p WHERE case_id <> part_case GROUP BY part UNION ALL
SELECT 'unfinished_status', part, count(*) FROM p WHERE status = 'RUNNING' GROUP BY part UNION ALL
SELECT 'duplicate_within_part', part || ':' || scenario_id, n FROM s WHERE n > 1 UNION ALL
SELECT 'duplicate_across_parts', case_id || ':' || scenario_id, count(*) FROM s GROUP BY case_id, scenario_id HAVING count(*) > 1 UNION ALL
SELECT 'task_set_mismatch', case_id || ':' || scenario_id, count(*) FROM p WHERE n_tasks <> 2 GROUP BY case_id, scenario_id""")
def partition_contract(spark, sf_dir):
    parts = V.tasks(spark, sf_dir).selectExpr(
        "concat('part', task_id % 7) as part", "case_id", "if(task_id % 500 = 3, 'other', case_id) as part_case", "scenario_id",
        "if(task_id % 300 = 5, 'RUNNING', status) as status", "task_id % 4 as n_tasks")
    expected = V.cases(spark, sf_dir).selectExpr("case_id", "2L as intended_task_count")
    return quality.partition_contract(parts, expected)


_TASK_PARTS_SQL = """r AS (SELECT 'C' || l_orderkey % 97 AS case_id, 'S' || l_orderkey AS scenario_id, l_linenumber + (l_orderkey % 50 = 0)::INT * 10 AS task_id,
  'C' || CASE WHEN l_orderkey % 211 = 7 THEN 0 ELSE l_orderkey % 97 END AS part_case,
  'p' || l_orderkey % 97 || '_' || CASE WHEN l_orderkey % 31 = 0 THEN l_linenumber % 2 ELSE 0 END AS part FROM lineitem),
et AS (SELECT 'C' || c AS case_id, unnest(range(1, 4 + c % 3)) AS task_id FROM range(0, 97) t(c)),
es AS (SELECT DISTINCT 'C' || o_orderkey % 97 AS case_id, 'S' || (o_orderkey + (o_orderkey % 43 = 0)::INT * 100000000) AS scenario_id FROM orders)"""


@query("Q12_part_states", """
SELECT family, 'ok' AS state, count(*) AS n_rows FROM v_tasks GROUP BY family""")
def part_states(spark, sf_dir):
    """Tasks written as one folder per family: every part is read and none is damaged."""
    root = scratch_path(spark, "parts")
    tables.write_table(V.tasks(spark, sf_dir).select("task_id", "price", "family").repartition("family"), root, "parquet", ["family"])
    found = tables.part_states(spark, root, "task_id long, price double")
    return found.selectExpr("regexp_extract(path, 'family=([^/]*)', 1) as family", "state", "n_rows").groupBy("family", "state").agg(F.expr("sum(n_rows) as n_rows"))


@query("Q12_task_partitions", f"""
WITH {_TASK_PARTS_SQL}, g AS (SELECT case_id, scenario_id, count(*) AS n, count(DISTINCT task_id) AS ids, count(DISTINCT part) AS np FROM r GROUP BY ALL),
w AS (SELECT es.*, (SELECT count(*) FROM et WHERE et.case_id = es.case_id) AS want FROM es),
h AS (SELECT r.case_id, r.scenario_id, count(DISTINCT r.task_id) AS known FROM r JOIN et ON r.case_id = et.case_id AND r.task_id = et.task_id GROUP BY ALL),
j AS (SELECT g.*, w.want, coalesce(h.known, 0) AS known FROM g JOIN w USING (case_id, scenario_id) LEFT JOIN h USING (case_id, scenario_id))
SELECT 'wrong_case' AS defect, part AS subject, count(*) AS n FROM r WHERE case_id <> part_case GROUP BY part
UNION ALL SELECT 'unexpected_scenario', case_id || ':' || scenario_id, 1 FROM g ANTI JOIN es USING (case_id, scenario_id)
UNION ALL SELECT 'missing_scenario', case_id || ':' || scenario_id, 1 FROM es ANTI JOIN g USING (case_id, scenario_id)
UNION ALL SELECT 'several_parts', case_id || ':' || scenario_id, 1 FROM j WHERE np > 1
UNION ALL SELECT 'repeated_tasks', case_id || ':' || scenario_id, n - ids FROM j WHERE n > ids
UNION ALL SELECT 'missing_tasks', case_id || ':' || scenario_id, want - known FROM j WHERE want > known
UNION ALL SELECT 'extra_tasks', case_id || ':' || scenario_id, ids - known FROM j WHERE ids > known""")
def task_partitions(spark, sf_dir):
    """Lines as task rows of their order: cases 0 to 96 expect three to five tasks; some parts, ids and scenarios are wrong."""
    rows = V.table(spark, sf_dir, "lineitem").selectExpr(
        "concat('C', l_orderkey % 97) as case_id", "concat('S', l_orderkey) as scenario_id", "cast(l_linenumber + if(l_orderkey % 50 = 0, 10, 0) as long) as task_id",
        "concat('C', if(l_orderkey % 211 = 7, 0, l_orderkey % 97)) as part_case", "concat('p', l_orderkey % 97, '_', if(l_orderkey % 31 = 0, l_linenumber % 2, 0)) as part")
    tasks = spark.range(97).selectExpr("concat('C', id) as case_id", "explode(sequence(1L, 3 + id % 3)) as task_id")
    scenarios = V.table(spark, sf_dir, "orders").selectExpr(
        "concat('C', o_orderkey % 97) as case_id", "concat('S', o_orderkey + if(o_orderkey % 43 = 0, 100000000, 0)) as scenario_id")
    return quality.task_partition_contract(rows, tasks, scenarios)


@query("Q13_failed_rows", """
SELECT family, task_id, passed FROM (SELECT family, task_id, CASE WHEN task_id % 9 <> 0 THEN price > 50000 END AS passed FROM v_tasks) WHERE NOT coalesce(passed, false)""")
def failed_rows(spark, sf_dir):
    return quality.failed_rows(V.tasks(spark, sf_dir).selectExpr("family", "task_id", "if(task_id % 9 <> 0, price > 50000, null) as passed"))


@query("Q13_check_rollup", """
SELECT family, count(*) AS checks, count(*) FILTER (coalesce(passed, false)) AS passed_checks, count(*) FILTER (NOT coalesce(passed, false)) AS failed_checks
FROM (SELECT family, CASE WHEN task_id % 9 <> 0 THEN price > 50000 END AS passed FROM v_tasks) GROUP BY family""")
def check_rollup(spark, sf_dir):
    return quality.check_rollup(V.tasks(spark, sf_dir).selectExpr("family", "if(task_id % 9 <> 0, price > 50000, null) as passed"), ["family"])


@query("Q14_entity_checks", """
WITH p0 AS (SELECT region, plane_id, count(*) AS n, count(DISTINCT node_id) AS ids, count(*) FILTER (is_central) AS c FROM v_nodes GROUP BY region, plane_id),
p AS (SELECT *, CASE WHEN plane_id % 4 = 0 THEN 1 ELSE c END AS listed FROM p0),
f AS (SELECT region, sum(n)::BIGINT AS nodes, sum(ids)::BIGINT AS ids, sum(c)::BIGINT AS central_nodes, max(c) - min(c) AS imb, count(*) FILTER (listed <> c) AS bad FROM p GROUP BY region)
SELECT region, nodes, central_nodes, 'unique_ids' AS "check", nodes - ids AS observed, nodes = ids AS passed FROM f UNION ALL
SELECT region, nodes, central_nodes, 'plane_imbalance_le_1', imb, imb <= 1 FROM f UNION ALL SELECT region, nodes, central_nodes, 'list_matches_count', bad, bad = 0 FROM f""")
def entity_checks(spark, sf_dir):
    """Index lists are right except in every fourth plane, where one entry stands for all."""
    nodes = V.nodes(spark, sf_dir)
    lists = nodes.groupBy("plane_id").agg(F.expr("count_if(is_central) as c")).selectExpr(
        "plane_id", "if(plane_id % 4 = 0, '1', array_join(transform(slice(sequence(0, cast(c as int)), 2, cast(c as int)), x -> cast(x as string)), ';')) as index_list")
    return quality.entity_checks(nodes.join(lists, "plane_id"), ["region"])


_PLANES_SQL = """g AS (SELECT region, plane_id, count(*) AS plane_size, count(*) FILTER (is_central) AS n_central FROM v_nodes GROUP BY ALL),
p AS (SELECT *, CASE WHEN plane_id % 3 = 0 THEN range(0, n_central) ELSE list_transform(range(0, n_central), lambda i: (i * plane_size) // n_central) END AS xs FROM g),
q AS (SELECT *, CASE WHEN plane_id % 5 = 4 AND n_central > 0 THEN list_append(xs, xs[1]) ELSE xs END AS listed FROM p)"""


@query("Q14_placement_checks", f"""
WITH {_PLANES_SQL}, o AS (SELECT *, list_sort(listed) AS s, len(listed) AS n FROM q),
z AS (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN i < n THEN s[i + 1] - s[i] ELSE s[1] + plane_size - s[i] END) AS gaps FROM o)
SELECT region, plane_id, 'list_matches_count' AS "check", n = n_central AS passed FROM z
UNION ALL SELECT region, plane_id, 'no_repeated_place', n = len(list_distinct(s)) FROM z
UNION ALL SELECT region, plane_id, 'opposite_pairs', len(list_filter(s, lambda x: NOT list_contains(s, (x + plane_size // 2) % plane_size))) = 0 FROM z
  WHERE n_central > 1 AND n_central % 2 = 0 AND n_central < plane_size AND plane_size % 2 = 0
UNION ALL SELECT region, plane_id, 'equal_spacing', coalesce(list_max(gaps) - list_min(gaps) <= 1, true) FROM z
  WHERE n_central > 1 AND n_central % 2 = 1 OR n_central > 1 AND n_central % 2 = 0 AND n_central < plane_size AND plane_size % 2 = 1""")
def placement_checks(spark, sf_dir):
    """Places are spread evenly, but for every third plane, where they are the first ones, and every fifth, which names one twice."""
    planes = V.nodes(spark, sf_dir).groupBy("region", "plane_id").agg(F.expr("count(*) as plane_size"), F.expr("count_if(is_central) as n_central"))
    spread = planes.withColumn("xs", F.expr(
        "if(n_central = 0, array(), transform(sequence(0L, greatest(n_central, 1L) - 1), i -> if(plane_id % 3 = 0, i, i * plane_size div n_central)))"))
    listed = spread.withColumn("xs", F.expr("if(plane_id % 5 = 4 and n_central > 0, array_append(xs, xs[0]), xs)"))
    return quality.placement_checks(listed.withColumn("index_list", F.expr("array_join(xs, ';')")), ["region"])


@query("Q14_expected_counts", """
WITH e AS (SELECT r_name AS region, 200 + r_regionkey AS total, 5 + r_regionkey % 2 AS n_planes, 60::BIGINT AS n_central FROM region),
c AS (SELECT region, count(*) AS nodes, count(*) FILTER (is_central) AS central FROM v_nodes GROUP BY region),
j AS (SELECT e.*, coalesce(nodes, 0) AS nodes, coalesce(central, 0) AS central FROM e LEFT JOIN c USING (region)),
x AS (SELECT region, 'planes_divide_total' AS "check", (total % n_planes)::BIGINT AS observed, 0::BIGINT AS required FROM j
  UNION ALL SELECT region, 'node_count', nodes, total::BIGINT FROM j UNION ALL SELECT region, 'central_count', central, n_central FROM j)
SELECT *, observed = required AS passed FROM x""")
def expected_counts(spark, sf_dir):
    wanted = V.table(spark, sf_dir, "region").selectExpr("r_name as region", "200L + r_regionkey as total", "5L + r_regionkey % 2 as n_planes", "60L as n_central")
    return quality.expected_counts(V.nodes(spark, sf_dir), wanted, ["region"])


@query("Q15_campaign_report", f"""
WITH {_CASES_SQL}, p AS (SELECT count(*) AS present_rows, count(*) FILTER (status = 'COMPLETED') AS completed_rows, count(*) FILTER (status = 'NOT_APPLICABLE') AS not_applicable_rows, count(*) FILTER (status = 'FAILED') AS failed_rows FROM v_tasks),
e AS (SELECT count(*) * 10 AS expected_rows, count(*) FILTER (success_marker) AS success_cases, count(*) FILTER (failed_marker) AS failed_cases FROM cs)
SELECT *, present_rows = expected_rows AND failed_cases = 0 AND failed_rows = 0 AS complete FROM p, e""")
def campaign_report(spark, sf_dir):
    return quality.campaign_report(_facts(spark, sf_dir), _cases(spark, sf_dir), 10)


@query("Q16_role_presence", """
WITH w AS (SELECT case_id, unnest(['nominal_original', 'unlimited_useful_deadline', 'policy_central']) AS role FROM v_cases)
SELECT case_id, role FROM w ANTI JOIN (SELECT DISTINCT case_id, scenario_id AS role FROM v_tasks) USING (case_id, role)""")
def role_presence(spark, sf_dir):
    files = V.tasks(spark, sf_dir).selectExpr("case_id", "scenario_id as role")
    return quality.role_presence(files, V.cases(spark, sf_dir), ["nominal_original", "unlimited_useful_deadline", "policy_central"])


_STATUS_SQL = f"""{_CASES_SQL}, st AS (SELECT case_id, CASE WHEN c_custkey % 90 = 1 THEN 'FAILED' WHEN c_custkey % 7 = 0 THEN 'SKIPPED_COMPLETED' ELSE 'COMPLETED' END AS status, c_custkey FROM v_cases),
s2 AS (SELECT case_id, status FROM st UNION ALL SELECT case_id, status FROM st WHERE c_custkey % 80 = 2), ex AS (SELECT case_id FROM st WHERE c_custkey % 60 <> 4),
mm AS (SELECT case_id FROM st WHERE c_custkey % 7 = 0 AND c_custkey % 2 = 0 OR c_custkey % 77 = 3), ru AS (SELECT DISTINCT case_id FROM s2 WHERE status = 'SKIPPED_COMPLETED')"""


@query("Q16_status_lists", f"""
WITH {_STATUS_SQL} SELECT 'invalid_status' AS list, case_id FROM s2 WHERE status = 'FAILED' UNION ALL SELECT 'duplicate', case_id FROM s2 GROUP BY case_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'exclude', case_id FROM s2 WHERE case_id NOT IN (SELECT case_id FROM ex) UNION ALL SELECT 'reused_but_has_manifest', case_id FROM ru ANTI JOIN mm USING (case_id)
UNION ALL SELECT 'no_manifest_but_not_reused', case_id FROM mm ANTI JOIN ru USING (case_id) UNION ALL SELECT DISTINCT 'authoritative', case_id FROM s2 WHERE status <> 'FAILED' AND case_id IN (SELECT case_id FROM ex)""")
def status_lists(spark, sf_dir):
    cases = V.cases(spark, sf_dir).selectExpr(
        "c_custkey", "case_id", "case when c_custkey % 90 = 1 then 'FAILED' when c_custkey % 7 = 0 then 'SKIPPED_COMPLETED' else 'COMPLETED' end as status")
    status = cases.unionByName(cases.filter("c_custkey % 80 = 2")).select("case_id", "status")
    expected = cases.filter("c_custkey % 60 <> 4").select("case_id")
    missing = cases.filter("c_custkey % 7 = 0 and c_custkey % 2 = 0 or c_custkey % 77 = 3").select("case_id")
    return quality.status_lists(status, expected, missing)


