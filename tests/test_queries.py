"""Registered queries against their SQL. All of them with ALL_QUERIES=1, else one or two per family."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "A06_level_summary", "A18_milestones", "A23_correlation_matrix", "F13_normalize_tasks", "G02_scenario_manifest", "J10_next_opportunity",
    "J11_geo_range_join", "M02_cluster_bootstrap_mean", "M04_skyline", "Q02_archive_audit", "R01_earliest_arrival", "S01_read_parts",
    "T04_targeted_nodes", "W07_islands", "W08_rmst", "X01_ingest_parts_stream",
]
# The smallest scale has one supplier per plane, so there is no pair to form.
EMPTY_AT_SMALLEST = {"J14_candidate_pairs"}


# Models, file listings and clusters: compared with plain loops in other tests. Text queries name theirs in their own folder.
WITHOUT_SQL = {
    "F15_csv_row_size", "M10_model_comparison", "M11_poly_aic_all_degrees", "M12_continuous_fit", "M12_fitted_curve", "R05_density_clusters", "R05_cluster_summary",
    "S03_marker_flags", "S04_inventory", "S05_checksum_manifest", "S05_verify_manifest",
}


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
    own = {name for name in queries if not name.startswith("op") and name != "pipeline"}
    assert own - set(oracles) <= WITHOUT_SQL


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in entry.oracle_sql():
        problems = compare(df, con, entry.oracle_sql()[name])
        assert problems == (["no rows"] if name in EMPTY_AT_SMALLEST else [])
    else:
        assert df.count() > 0
