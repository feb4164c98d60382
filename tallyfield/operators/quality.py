"""Quality gates. Each returns a table of checks or of offending rows; ``enforce`` turns one into an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.ids import case_fields, digest_sum, row_digest
from tallyfield.functions.tables import check_counts
from tallyfield.operators.ordered import attach


class GateFailed(RuntimeError):
    """A gate with failing checks."""


def enforce(checks: DataFrame) -> None:
    """Raise with the names of the failing checks; a check table has few rows by construction."""
    failing = [row["check"] for row in checks.filter("not passed").select("check").distinct().collect()]
    if failing:
        raise GateFailed(f"failed checks: {sorted(failing)}")


def exact_counts(observed: DataFrame, required: Mapping[str, int], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, check, observed, required, passed) from one row of counts per key."""
    items = ", ".join(f"named_struct('check', '{c}', 'observed', cast(`{c}` as long), 'required', {int(n)}L)" for c, n in required.items())
    return observed.selectExpr(*keys, f"inline(array({items}))").withColumn("passed", F.expr("coalesce(observed = required, false)"))


def completion_counts(
    facts: DataFrame, cases: DataFrame, keys: Sequence[str], scenarios_per_case: int, content: Sequence[str] = (), checks: DataFrame | None = None
) -> DataFrame:
    """The counts the completion gate looks at, per key: cases, bases, markers, rows, statuses, conflicts, balance, levels.

    A (case, scenario) that occurs with different ``content`` is a conflicting duplicate. ``checks`` (keys, passed) are stored
    validations; one without an answer counts as failed, and without the table there are no failures.
    Everything is counted per scenario and per case first, so each later count runs over cases.
    """
    digest = row_digest(*[F.col(c) for c in content]) if content else F.lit("")
    per_scenario = facts.withColumn("_d", digest).groupBy(*keys, "case_id", "scenario_id").agg(
        F.expr("count(*) as n"), F.expr("count_if(status = 'FAILED') as n_failed"), F.expr("min(_d) <> max(_d) as differs"),
    )
    per_case = per_scenario.groupBy(*keys, "case_id").agg(
        F.expr("sum(n) as raw_rows"), F.expr("count(scenario_id) as unique_rows"),
        F.expr("sum(n_failed) as failed_rows"), F.expr("count_if(differs) as conflicts"),
    )
    joined = attach(cases, per_case, [*keys, "case_id"]).na.fill(0, ["raw_rows", "unique_rows", "failed_rows", "conflicts"])
    levels = joined.groupBy(*keys).agg(F.expr("count(distinct cn_fraction_percent) as n_levels"))
    bases = attach(
        joined.filter("success_marker").groupBy(*keys, "base_id").agg(
            F.expr("count(distinct cn_fraction_percent) as have"), F.expr("count(*) as base_cases")
        ), levels, keys,
    ).groupBy(*keys).agg(
        F.expr("count_if(have = n_levels) as balanced_bases"),
        F.expr("coalesce(sum(base_cases) filter (where have = n_levels), 0) as balanced_cases"),
    )
    counts = joined.groupBy(*keys).agg(
        F.expr("count(*) as case_directories"), F.expr("count(distinct base_id) as base_architectures"),
        F.expr("count_if(success_marker) as success_markers"), F.expr("count_if(failed_marker) as failed_markers"),
        F.expr("sum(unique_rows) as unique_scenario_rows"), F.expr("sum(failed_rows) as failed_status_rows"),
        F.expr("sum(raw_rows - unique_rows) as duplicate_rows"), F.expr("sum(conflicts) as conflicting_duplicate_keys"),
        F.expr(f"count_if(unique_rows = {scenarios_per_case}) as complete_cases"),
        F.expr("count(distinct cn_fraction_percent) as levels_present"),
    )
    counts = attach(counts, bases, keys)
    if checks is None:
        return counts.withColumn("validation_failures", F.lit(0).cast("long"))
    failures = checks.groupBy(*keys).agg(F.expr("count_if(not coalesce(passed, false)) as validation_failures"))
    return attach(counts, failures, keys).na.fill(0, ["validation_failures"])


def archive_audit(facts: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case: raw, unique, duplicate and missing scenario rows against the most common count among
    successful cases (ties: the smallest), and whether its base has every level."""
    per_case = facts.groupBy("case_id").agg(F.expr("count(*) as raw_rows"), F.expr("count(distinct scenario_id) as unique_rows"))
    audit = attach(cases, per_case, ["case_id"]).na.fill(0, ["raw_rows", "unique_rows"])
    usual = (
        audit.filter("success_marker").groupBy("unique_rows").agg(F.expr("count(*) as n"))
        .agg(F.expr("min(struct(-n as n, unique_rows as u)).u as expected_rows"))
    )
    levels = audit.agg(F.expr("count(distinct cn_fraction_percent) as n_levels"))
    balanced = attach(
        audit.filter("success_marker").groupBy("base_id").agg(F.expr("count(distinct cn_fraction_percent) as have")), levels, []
    ).filter("have = n_levels").select("base_id", F.lit(True).alias("_ok"))
    out = attach(attach(audit, usual, []), balanced, ["base_id"])
    return out.selectExpr(
        "case_id", "base_id", "success_marker", "raw_rows", "unique_rows", "raw_rows - unique_rows as duplicate_rows", "expected_rows",
        "expected_rows - unique_rows as missing_rows", "coalesce(_ok, false) as balanced_base",
    )


def value_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.expr(f"coalesce(cast({column} as string), 'MISSING') as value")).agg(F.expr("count(*) as n"))


def conflicting_duplicates(df: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Keys whose rows differ in their payload, with the number of versions."""
    versions = df.select(*keys, row_digest(*[F.col(c) for c in payload]).alias("_h")).groupBy(*keys).agg(
        F.expr("count(distinct _h) as duplicate_versions")
    )
    return versions.filter("duplicate_versions > 1")


def recompute_compare(
    reported: DataFrame, recomputed: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float = 1e-6
) -> DataFrame:
    """Per metric: compared rows, failures, largest absolute difference. A missing value on either side passes."""
    left = reported.select(*keys, *[F.col(m).cast("double").alias(f"a_{m}") for m in metrics])
    right = recomputed.select(*keys, *[F.col(m).cast("double").alias(f"b_{m}") for m in metrics])
    items = ", ".join(f"named_struct('metric', '{m}', 'd', abs(b_{m} - a_{m}))" for m in metrics)
    return left.join(right, list(keys)).selectExpr(f"inline(array({items}))").groupBy("metric").agg(
        F.expr("count(*) as compared"), F.expr(f"count_if(coalesce(d > {tolerance}, false)) as failures"), F.expr("max(d) as max_abs_difference")
    ).withColumn("passed", F.expr("failures = 0"))


# The invariants of a task outcome row, as tests that hold for a violation.
EVENT_VIOLATIONS = {
    "first_reception_not_before_creation": "first_reception_sec + 1e-9 < created_sec",
    "observation_not_before_first_reception": "observed and observation_sec + 1e-9 < first_reception_sec",
    "observation_within_deadline": "observed and observation_sec > deadline_sec + 1e-9",
    "reached_not_above_targets": "n_reached > n_targets + 1e-9",
    "targets_match_reported": "derived_targets <> n_targets",
    "reached_match_reported": "derived_reached <> n_reached_ever",
}


def event_invariants(outcomes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return check_counts(outcomes, EVENT_VIOLATIONS, keys)


def config_invariants(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each column should hold one distinct known value per key."""
    long = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(list(keys), list(columns), "field", "value")
    return long.groupBy(*keys, "field").agg(F.expr("count(distinct value) as distinct_values")).withColumn(
        "passed", F.expr("distinct_values = 1")
    )


def id_vs_manifest(cases: DataFrame, first: DataFrame, second: DataFrame, fields: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Fields read from the case code against two manifests; the first may lack a case, the second may not."""
    parsed = cases.select("case_id", *[c.alias(f"id_{n}") for n, c in case_fields("case_id").items() if n in fields])
    one = first.select("case_id", *[F.col(f).cast("double").alias(f"m1_{f}") for f in fields])
    two = second.select("case_id", *[F.col(f).cast("double").alias(f"m2_{f}") for f in fields])
    joined = parsed.join(one, "case_id", "left").join(two, "case_id", "left")
    items = ", ".join(
        f"named_struct('field', '{f}', 'bad', coalesce(abs(id_{f} - m1_{f}) > {tolerance}, false) or coalesce(abs(id_{f} - m2_{f}) > {tolerance}, true))"
        for f in fields
    )
    return joined.selectExpr("case_id", f"inline(array({items}))").filter("bad").select("case_id", "field")


def identical_source(rows: DataFrame, group: Sequence[str], unit: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Does every unit of a group hold the same rows? Compared by row count and an order-free fingerprint."""
    prints = rows.select(*group, *unit, row_digest(*[F.col(c) for c in content]).alias("_h")).groupBy(*group, *unit).agg(
        F.expr("count(*) as n_rows"), digest_sum(F.col("_h")).alias("fingerprint")
    )
    return prints.groupBy(*group).agg(
        F.expr("count(*) as units"), F.expr("count(distinct fingerprint) as distinct_contents"), F.expr("count(distinct n_rows) as distinct_row_counts")
    ).withColumn("passed", F.expr("distinct_contents = 1 and distinct_row_counts = 1"))


def population_contract(facts: DataFrame, keys: Sequence[str], intended: DataFrame, intended_keys: Sequence[str]) -> DataFrame:
    """Per case: rows, distinct / least / largest task count, and whether all rows use the intended count."""
    counts = facts.groupBy(*keys).agg(
        F.expr("count(*) as completed_rows"), F.expr("count(distinct n_tasks) as distinct_task_counts"),
        F.expr("min(n_tasks) as minimum_task_count"), F.expr("max(n_tasks) as maximum_task_count"),
    )
    return attach(counts, intended, intended_keys).withColumn(
        "uses_intended_count", F.expr("coalesce(distinct_task_counts = 1 and minimum_task_count = intended_task_count, false)")
    )


def pair_contract(
    facts: DataFrame, region: Sequence[str], pairs: Sequence[tuple[str, str]], intended: DataFrame
) -> DataFrame:
    """Per scenario pair: cases in both, with equal task counts, with the intended count, and with different ones."""
    items = ", ".join(
        f"named_struct('reference', '{a}', 'alternative', '{b}', 'side', case scenario_id when '{a}' then 'r' when '{b}' then 'a' end)"
        for a, b in pairs
    )
    sides = facts.selectExpr(*region, "case_id", "n_tasks", f"inline(array({items}))").filter("side is not null")
    both = sides.groupBy(*region, "case_id", "reference", "alternative").agg(
        F.expr("max(n_tasks) filter (where side = 'r') as r"), F.expr("max(n_tasks) filter (where side = 'a') as a")
    ).filter("r is not null and a is not null")
    return attach(both, intended, region).groupBy(*region, "reference", "alternative").agg(
        F.expr("count(*) as paired_cases"), F.expr("count_if(r = a) as same_task_count_cases"),
        F.expr("count_if(r = a and r = intended_task_count) as intended_task_count_cases"), F.expr("count_if(r <> a) as mismatched_task_count_cases"),
    )


def scope_gate(facts: DataFrame, required_rows: int, reference: Mapping[str, int]) -> DataFrame:
    """Named totals of a table against reference values, and a row count that must fit exactly."""
    observed = facts.agg(
        F.expr("count(*) as n_rows"), F.expr("count(distinct case_id) as cases"), F.expr("count(distinct scenario_id) as scenarios")
    )
    return exact_counts(observed, {"n_rows": required_rows, **reference})


def task_contract(expected: DataFrame, actual: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """Identity of two task tables: ids missing on either side, changed rows, and coordinates that are not finite."""
    left = expected.select(F.col(key), row_digest(*[F.col(c) for c in content]).alias("_a"))
    right = actual.select(F.col(key), row_digest(*[F.col(c) for c in content]).alias("_b"), F.lit(True).alias("_here"), F.expr(
        "coalesce(isnan(latitude) or isnan(longitude) or latitude is null or longitude is null, true) as _bad"
    ))
    joined = left.withColumn("_there", F.lit(True)).join(right, key, "full")
    tests = {
        "missing_ids": "_here is null", "unexpected_ids": "_there is null", "changed_rows": "coalesce(_a <> _b, false)",
        "coordinates_not_finite": "coalesce(_bad, false)",
    }
    return check_counts(joined, tests)


def table_contract(tasks: DataFrame, key: str, content: Sequence[str], label: str, keys: Sequence[str] = ()) -> DataFrame:
    """What pins a task table down, per ``keys``: rows, distinct ids, a fingerprint of the ids, one of the rows, and rows per ``label`` as
    a sorted list of (label, n).

    Both fingerprints are order-free sums, so no table is sorted or gathered; two tables hold the same rows if the rows' fingerprints agree.
    Ids are counted and fingerprinted once each. A NULL label is listed as NULL.
    """
    made = tasks.select(*keys, F.col(key).alias("_id"), F.col(label).alias("_label"), row_digest(F.col(key), *[F.col(c) for c in content]).alias("_row"))
    per_id = made.groupBy(*keys, "_id").agg(F.count(F.lit(1)).alias("_n"))
    ids = per_id.groupBy(*keys).agg(
        F.expr("sum(_n) as task_count"), F.expr("count(*) as unique_task_count"), digest_sum(row_digest(F.col("_id"))).alias("ids_digest"),
    )
    rows = made.groupBy(*keys).agg(digest_sum(F.col("_row")).alias("rows_digest"))
    labels = made.groupBy(*keys, "_label").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.expr("sort_array(collect_list(named_struct('label', _label, 'n', _n))) as label_counts"))
    return attach(attach(ids, rows, keys), labels, keys)


def partition_contract(parts: DataFrame, expected_tasks: DataFrame) -> DataFrame:
    """Defects of checkpoint parts, as (defect, subject, n): a row of the wrong case, a status that is not
    final, a scenario twice in one part or in several, a scenario with another number of tasks than expected.

    ``parts``: part, part_case, case_id, scenario_id, status, n_tasks. ``expected_tasks``: case_id, intended_task_count.
    """
    wrong_case = parts.filter("case_id <> part_case").groupBy("part").agg(F.expr("count(*) as n")).selectExpr("'wrong_case' as defect", "part as subject", "n")
    unfinished = parts.filter("status not in ('COMPLETED', 'NOT_APPLICABLE')").groupBy("part").agg(F.expr("count(*) as n")).selectExpr(
        "'unfinished_status' as defect", "part as subject", "n")
    seen = parts.groupBy("case_id", "scenario_id", "part").agg(F.expr("count(*) as n"))
    within = seen.filter("n > 1").selectExpr("'duplicate_within_part' as defect", "concat(part, ':', scenario_id) as subject", "n")
    across = seen.groupBy("case_id", "scenario_id").agg(F.expr("count(*) as n")).filter("n > 1").selectExpr(
        "'duplicate_across_parts' as defect", "concat(case_id, ':', scenario_id) as subject", "n")
    mismatch = attach(parts, expected_tasks, ["case_id"]).filter("n_tasks <> intended_task_count").groupBy("case_id", "scenario_id").agg(
        F.expr("count(*) as n")).selectExpr("'task_set_mismatch' as defect", "concat(case_id, ':', scenario_id) as subject", "n")
    return wrong_case.unionByName(unfinished).unionByName(within).unionByName(across).unionByName(mismatch)


def task_partition_contract(rows: DataFrame, expected_tasks: DataFrame, expected_scenarios: DataFrame) -> DataFrame:
    """Defects of task parts, as (defect, subject, n): parts with rows of another case, scenarios in several parts, scenarios outside the
    expected ones, expected scenarios without rows, and for each expected scenario repeated task rows, missing tasks and extra tasks.

    ``rows``: part, part_case, case_id, scenario_id, task_id. ``expected_tasks``: case_id, task_id, one row each.
    ``expected_scenarios``: case_id, scenario_id. Each row looks its task up in the expected set of its case; counts of known and unknown
    ids then tell the sets apart, so no set of tasks is ever gathered.
    """
    subject = "concat(case_id, ':', scenario_id)"
    wrong_case = rows.filter("not coalesce(case_id = part_case, false)").groupBy("part").agg(F.expr("count(*) as n")).selectExpr("'wrong_case' as defect", "part as subject", "n")
    known = rows.join(expected_tasks.select("case_id", "task_id", F.lit(True).alias("_known")), ["case_id", "task_id"], "left")
    per_task = known.groupBy("case_id", "scenario_id", "task_id").agg(
        F.expr("count(*) as n"), F.expr("bool_or(coalesce(_known, false)) as known"), F.expr("min(part) as low"), F.expr("max(part) as high"))
    seen = per_task.groupBy("case_id", "scenario_id").agg(
        F.expr("sum(n - 1) as repeated"), F.expr("count_if(known) as n_known"), F.expr("count_if(not known) as n_extra"),
        F.expr("min(low) <> max(high) as spread"))
    wanted = expected_scenarios.select("case_id", "scenario_id").distinct().join(
        expected_tasks.groupBy("case_id").agg(F.expr("count(*) as n_tasks")), "case_id", "left").withColumn("_wanted", F.lit(True))
    joined = seen.withColumn("_seen", F.lit(True)).join(wanted, ["case_id", "scenario_id"], "full")
    items = """filter(array(
        named_struct('defect', 'unexpected_scenario', 'n', if(_wanted is null, 1L, 0L)),
        named_struct('defect', 'missing_scenario', 'n', if(_seen is null, 1L, 0L)),
        named_struct('defect', 'several_parts', 'n', if(_wanted and _seen and spread, 1L, 0L)),
        named_struct('defect', 'repeated_tasks', 'n', if(_wanted and _seen, repeated, 0L)),
        named_struct('defect', 'missing_tasks', 'n', if(_wanted and _seen, coalesce(n_tasks, 0L) - n_known, 0L)),
        named_struct('defect', 'extra_tasks', 'n', if(_wanted and _seen, n_extra, 0L))), x -> x.n > 0)"""
    found = joined.selectExpr(f"{subject} as subject", f"inline({items})").select("defect", "subject", "n")
    return wrong_case.unionByName(found)


def failed_rows(checks: DataFrame) -> DataFrame:
    """The stored checks that did not pass, whole; one without an answer is among them."""
    return checks.filter("not coalesce(passed, false)")


def check_rollup(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals of stored check tables; a check without an answer counts as failed."""
    return checks.groupBy(*keys).agg(
        F.expr("count(*) as checks"), F.expr("count_if(coalesce(passed, false)) as passed_checks"),
        F.expr("count_if(not coalesce(passed, false)) as failed_checks"),
    )


def entity_checks(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per fleet: distinct ids, imbalance of central nodes over planes (at most 1), and agreement of the
    ``;``-joined index list of each plane with its count."""
    planes = nodes.groupBy(*keys, "plane_id").agg(
        F.expr("count(*) as n_nodes"), F.expr("count(distinct node_id) as n_ids"), F.expr("count_if(is_central) as n_central"),
        F.expr("max(index_list) as index_list"),
    )
    sized = planes.withColumn("n_listed", F.expr("if(coalesce(index_list, '') = '', 0, size(split(index_list, ';')))"))
    fleet = sized.groupBy(*keys).agg(
        F.expr("sum(n_nodes) as nodes"), F.expr("sum(n_ids) as ids"), F.expr("sum(n_central) as central_nodes"),
        F.expr("max(n_central) - min(n_central) as plane_imbalance"), F.expr("count_if(n_listed <> n_central) as list_mismatches"),
    )
    items = """array(named_struct('check', 'unique_ids', 'observed', nodes - ids, 'passed', nodes = ids),
        named_struct('check', 'plane_imbalance_le_1', 'observed', plane_imbalance, 'passed', plane_imbalance <= 1),
        named_struct('check', 'list_matches_count', 'observed', list_mismatches, 'passed', list_mismatches = 0))"""
    return fleet.selectExpr(*keys, "nodes", "central_nodes", f"inline({items})")


def placement_checks(planes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, plane_id, check, passed): where the central nodes of a plane sit among its ``plane_size`` places.

    ``planes``: keys, plane_id, plane_size, n_central, index_list (places joined by ``;``, from 0). The list must have ``n_central``
    entries and none twice. An even number of central nodes below the plane size, in a plane of even size, must lie in opposite pairs;
    any other number of two or more must be spread so that the gaps around the plane differ by one at most. One central node, or a plane
    whose nodes are all central and even in number, has no spacing check.
    """
    listed = planes.withColumn("_at", F.expr("array_sort(transform(if(coalesce(index_list, '') = '', array(), split(index_list, ';')), x -> cast(x as int)))"))
    gaps = listed.withColumn("_gaps", F.expr(
        "transform(_at, (x, i) -> if(i + 1 < size(_at), _at[int(i + 1)] - x, int(_at[0] + plane_size - x)))"))
    even = "n_central > 1 and n_central % 2 = 0 and n_central < plane_size"
    items = f"""filter(array(
        named_struct('check', 'list_matches_count', 'passed', size(_at) = n_central),
        named_struct('check', 'no_repeated_place', 'passed', size(_at) = size(array_distinct(_at))),
        if({even} and plane_size % 2 = 0, named_struct('check', 'opposite_pairs', 'passed', forall(_at, x -> array_contains(_at, int((x + plane_size div 2) % plane_size)))), null),
        if({even} and plane_size % 2 = 1 or n_central > 1 and n_central % 2 = 1,
           named_struct('check', 'equal_spacing', 'passed', coalesce(array_max(_gaps) - array_min(_gaps) <= 1, true)), null)), x -> x is not null)"""
    return gaps.selectExpr(*keys, "plane_id", f"inline({items})")


def expected_counts(nodes: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, check, observed, required, passed): nodes and central nodes of a fleet against the design, and whether the nodes divide
    evenly over the planes. ``expected``: keys, total, n_planes, n_central. A fleet without nodes counts as 0."""
    counted = nodes.groupBy(*keys).agg(F.expr("count(*) as nodes"), F.expr("count_if(is_central) as central"))
    joined = expected.join(counted, list(keys), "left").na.fill(0, ["nodes", "central"])
    items = """array(named_struct('check', 'planes_divide_total', 'observed', total % n_planes, 'required', 0L),
        named_struct('check', 'node_count', 'observed', nodes, 'required', total), named_struct('check', 'central_count', 'observed', central, 'required', n_central))"""
    return joined.selectExpr(*keys, f"inline({items})").withColumn("passed", F.expr("coalesce(observed = required, false)"))


def campaign_report(facts: DataFrame, cases: DataFrame, scenarios_per_case: int) -> DataFrame:
    """One row: expected and present rows, rows by status, markers, and whether the campaign is complete."""
    present = facts.agg(
        F.expr("count(*) as present_rows"), F.expr("count_if(status = 'COMPLETED') as completed_rows"),
        F.expr("count_if(status = 'NOT_APPLICABLE') as not_applicable_rows"), F.expr("count_if(status = 'FAILED') as failed_rows"),
    )
    expected = cases.agg(
        F.expr(f"count(*) * {scenarios_per_case} as expected_rows"), F.expr("count_if(success_marker) as success_cases"),
        F.expr("count_if(failed_marker) as failed_cases"),
    )
    return attach(present, expected, []).withColumn("complete", F.expr("present_rows = expected_rows and failed_cases = 0 and failed_rows = 0"))


def role_presence(files: DataFrame, cases: DataFrame, roles: Sequence[str]) -> DataFrame:
    """(case, role) that is required but absent. ``files``: case_id, role."""
    names = ", ".join(f"'{r}'" for r in roles)
    wanted = cases.selectExpr("case_id", f"explode(array({names})) as role")
    return wanted.join(files.select("case_id", "role").distinct(), ["case_id", "role"], "left_anti")


# Statuses a finished campaign may hold.
FINAL_STATUSES = ("COMPLETED", "SKIPPED_COMPLETED")


def status_lists(status: DataFrame, expected: DataFrame, missing_manifest: DataFrame) -> DataFrame:
    """(list, case_id): invalid statuses, repeated ids, ids outside the expected set, reused cases without a
    missing manifest and the other way round, and the authoritative cases."""
    names = ", ".join(f"'{s}'" for s in FINAL_STATUSES)
    reused = status.filter("status = 'SKIPPED_COMPLETED'").select("case_id").distinct()
    parts = {
        "invalid_status": status.filter(f"status not in ({names})").select("case_id"),
        "duplicate": status.groupBy("case_id").agg(F.expr("count(*) as n")).filter("n > 1").select("case_id"),
        "exclude": status.select("case_id").distinct().join(expected, "case_id", "left_anti"),
        "reused_but_has_manifest": reused.join(missing_manifest, "case_id", "left_anti"),
        "no_manifest_but_not_reused": missing_manifest.join(reused, "case_id", "left_anti"),
        "authoritative": status.filter(f"status in ({names})").select("case_id").distinct().join(expected, "case_id", "left_semi"),
    }
    out = None
    for name, part in parts.items():
        row = part.select(F.lit(name).alias("list"), "case_id")
        out = row if out is None else out.unionByName(row)
    return out
