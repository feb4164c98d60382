"""Gates against small tables with one defect of each kind."""

import os
import shutil
import tempfile

from tallyfield.operators import grid, quality
from tallyfield.sources import tables


def test_damaged_and_empty_parts_are_named(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "case_id string, n long"
    for name, rows in (("good", [("a", 1), ("a", None)]), ("bare", []), ("cut", [("b", 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/out/{name}")
        part = next(f for f in os.listdir(f"{root}/out/{name}") if f.endswith(".parquet"))
        os.makedirs(f"{root}/parts/case=x y+z", exist_ok=True)
        shutil.copy(f"{root}/out/{name}/{part}", f"{root}/parts/case=x y+z/{name}.parquet")
    with open(f"{root}/parts/case=x y+z/cut.parquet", "r+b") as f:
        f.truncate(40)
    with open(f"{root}/parts/case=x y+z/text.parquet", "w") as f:
        f.write("not a table")
    got = {r["path"].rsplit("/", 1)[1]: (r["n_rows"], r["state"]) for r in tables.part_states(spark, f"{root}/parts", schema).collect()}
    assert got == {"good.parquet": (2, "ok"), "bare.parquet": (0, "empty"), "cut.parquet": (0, "unreadable"), "text.parquet": (0, "unreadable")}


def test_task_parts(spark):
    rows = spark.createDataFrame([
        ("p1", "c", "c", "s1", 1), ("p1", "c", "c", "s1", 2),
        ("p1", "c", "c", "s2", 1), ("p2", "c", "c", "s2", 2),
        ("p2", "c", "c", "s3", 1), ("p2", "c", "c", "s3", 1), ("p2", "c", "c", "s3", 9),
        ("p2", "c", "c", "odd", 1), ("p3", "d", "c", "s4", 1), ("p3", "d", "c", "s4", 2),
    ], "part string, part_case string, case_id string, scenario_id string, task_id long")
    tasks = spark.createDataFrame([("c", 1), ("c", 2)], "case_id string, task_id long")
    scenarios = spark.createDataFrame([("c", s) for s in ("s1", "s2", "s3", "s4", "s5")], "case_id string, scenario_id string")
    got = {tuple(r) for r in quality.task_partition_contract(rows, tasks, scenarios).collect()}
    assert got == {
        ("wrong_case", "p3", 2), ("several_parts", "c:s2", 1), ("repeated_tasks", "c:s3", 1), ("missing_tasks", "c:s3", 1),
        ("extra_tasks", "c:s3", 1), ("unexpected_scenario", "c:odd", 1), ("missing_scenario", "c:s5", 1),
    }


def test_placement(spark):
    planes = spark.createDataFrame([
        (1, 8, 2, "0;4"), (2, 8, 2, "0;3"), (3, 7, 2, "0;3"), (4, 9, 3, "0;3;6"), (5, 9, 3, "0;1;2"), (6, 8, 1, "5"), (7, 8, 0, ""), (8, 8, 2, "4;4"), (9, 4, 4, "0;1;2;3"),
    ], "plane_id int, plane_size long, n_central long, index_list string")
    failed = {(r["plane_id"], r["check"]) for r in quality.placement_checks(planes, []).collect() if not r["passed"]}
    assert failed == {(2, "opposite_pairs"), (5, "equal_spacing"), (8, "no_repeated_place"), (8, "opposite_pairs")}
    kinds = {(r["plane_id"], r["check"]) for r in quality.placement_checks(planes, []).collect()}
    assert {k for k in kinds if k[1] in ("opposite_pairs", "equal_spacing")} == {
        (1, "opposite_pairs"), (2, "opposite_pairs"), (3, "equal_spacing"), (4, "equal_spacing"), (5, "equal_spacing"), (8, "opposite_pairs")}


def test_table_contract_sees_any_change(spark):
    schema = "task_id long, kind string, lat double"
    base = [(1, "a", 1.5), (2, "b", None), (3, None, 2.0)]
    contract = lambda rows: quality.table_contract(spark.createDataFrame(rows, schema), "task_id", ["kind", "lat"], "kind").first()
    first = contract(base)
    assert (first["task_count"], first["unique_task_count"]) == (3, 3)
    assert {(x["label"], x["n"]) for x in first["label_counts"]} == {("a", 1), ("b", 1), (None, 1)}
    assert contract(base[::-1]) == first
    moved = contract([(1, "a", 1.5), (2, "b", None), (3, None, 2.5)])
    assert moved["ids_digest"] == first["ids_digest"] and moved["rows_digest"] != first["rows_digest"]
    twice = contract(base + base[:1])
    assert (twice["task_count"], twice["unique_task_count"], twice["ids_digest"]) == (4, 3, first["ids_digest"]) and twice["rows_digest"] != first["rows_digest"]


def test_expected_counts_and_conflicts(spark):
    nodes = spark.createDataFrame([("x", True), ("x", False)], "fleet string, is_central boolean")
    wanted = spark.createDataFrame([("x", 2, 2, 1), ("y", 3, 2, 1)], "fleet string, total long, n_planes long, n_central long")
    failed = {(r["fleet"], r["check"]) for r in quality.expected_counts(nodes, wanted, ["fleet"]).collect() if not r["passed"]}
    assert failed == {("y", "planes_divide_total"), ("y", "node_count"), ("y", "central_count")}
    facts = spark.createDataFrame([("c", "s", "COMPLETED"), ("c", "s", "FAILED"), ("c", "t", "COMPLETED"), ("c", "t", "COMPLETED")], "case_id string, scenario_id string, status string")
    cases = spark.createDataFrame([("c", "b", 0, True, False)], "case_id string, base_id string, cn_fraction_percent int, success_marker boolean, failed_marker boolean")
    checks = spark.createDataFrame([(True,), (None,), (False,)], "passed boolean")
    row = quality.completion_counts(facts, cases, [], 2, ["status"], checks).first()
    assert (row["conflicting_duplicate_keys"], row["validation_failures"], row["duplicate_rows"], row["complete_cases"]) == (1, 2, 2, 1)


def test_scenario_ids_are_unique_and_limits_hold(spark):
    made = grid.scenario_manifest(spark.range(2).selectExpr("id as campaign"))
    assert grid.repeated_scenarios(made, ["campaign"]).isEmpty()
    assert grid.repeated_scenarios(made).count() == 539
    rows = {r["scenario_id"]: r for r in grid.scenario_details(made.filter("campaign = 0")).collect()}
    limited = {k for k, r in rows.items() if (r["max_forwarding_hops"], r["max_observer_copies"], r["max_cn_copies"]) == (3, 3, 5)}
    assert limited == {"nominal_original"} and {k for k, r in rows.items() if r["retain_transfers"]} == {"nominal_original", "unlimited_useful_deadline"}
    assert sum(r["retain_task_metrics"] for r in rows.values()) == 11
    none = grid.scenario_details(made, transfer_scenarios=[]).filter("retain_transfers")
    assert none.isEmpty()
