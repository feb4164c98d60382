"""Known answers on tiny tables."""

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import ids, scalars, tables
from tallyfield.operators import decision, grid, joins, outcomes, quality, resample, survival, windows


def test_case_code_round_trip(spark):
    df = spark.createDataFrame([("T060_P03_H0500_I0986_CN030_F1",), ("nonsense",)], "case_id string")
    good, bad = ids.parse_case_id(df).collect()
    assert (good["n_satellites"], good["n_planes"], good["altitude_km"], good["inclination_deg"], good["cn_fraction_percent"], good["walker_f"]) == (
        60, 3, 500.0, 98.6, 30.0, 1)
    assert bad["n_satellites"] is None
    again = ids.format_case_id(*[F.lit(v) for v in (60, 3, 500.4, 98.6, 29.5, 1)])
    assert df.select(again.alias("c"), ids.base_id(F.lit("T060_P03_H0500_I0986_CN030_F1")).alias("b")).first() == (
        "T060_P03_H0500_I0986_CN030_F1", "T060_P03_H0500_I0986_F1")


def test_strict_case_code_raises(spark):
    df = spark.createDataFrame([("nonsense",)], "case_id string")
    with pytest.raises(Exception, match="not a case code"):
        ids.parse_case_id(df, strict=True).collect()


def test_grid_and_scenarios(spark):
    one = spark.range(1).select(
        *[F.array(*[F.lit(float(v)) for v in levels]).alias(name) for name, levels in {
            "n_satellites": (60, 120, 180), "n_planes": (3, 5, 10), "altitude_km": (500, 800, 1000), "inclination_deg": (60, 80, 98.6)}.items()])
    bases = grid.design_grid(one, ["n_satellites", "n_planes", "altitude_km", "inclination_deg"], ("n_satellites", "n_planes"))
    assert bases.count() == 81
    cases = grid.case_manifest(bases.withColumn("walker_f", F.lit(1)), ["a"], range(0, 101, 10))
    assert cases.select("case_id").distinct().count() == 891
    scenarios = grid.scenario_manifest(spark.range(1))
    assert scenarios.count() == scenarios.select("scenario_id").distinct().count() == 539


def test_followup_sizes_are_multiples_of_planes(spark):
    df = spark.createDataFrame([("a", 3)], "case_id string, n_planes long")
    got = {r["target"]: r["n_satellites_planned"] for r in grid.followup_plan(df, (500, 1000)).collect()}
    assert got == {500: 501, 1000: 999}


def test_survival_known_answer(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, False)], "g string, duration_min double, event boolean")
    row = survival.km_summary(df, ["g"], horizon="2").first()
    assert (row["event_probability"], row["rmst"], row["horizon"]) == (0.5, 1.5, 2.0)
    curve = {r["time_min"]: r["survival"] for r in survival.km_curve(df, ["g"], horizon="2").collect()}
    assert curve == {0.0: 1.0, 1.0: 0.5, 2.0: 0.5}


def test_survival_reaches_zero_and_clips(spark):
    rows = [("a", 1.0, True), ("a", 3.0, True), ("a", 9.0, True)]
    df = spark.createDataFrame(rows, "g string, duration_min double, event boolean")
    assert survival.km_summary(df, ["g"]).first()["event_probability"] == 1.0
    clipped = survival.km_summary(df, ["g"], horizon="4", clip=True).first()
    assert clipped["rmst"] == pytest.approx(1 + 2 * 2 / 3 + 1 / 3) and clipped["horizon"] == 4.0


def test_minmax_rules(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 10.0), ("b", 1.0), ("a", None)], "g string, x double")
    got = decision.minmax(df, ["g"], {"up": ("x", False), "down": ("x", True)}).collect()
    assert [(r["up"], r["down"]) for r in got if r["x"] in (0.0, 5.0, 10.0)] == [(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)]
    assert [r["up"] for r in got if r["g"] == "b"] == [0.5]
    assert [(r["up"], r["down"]) for r in got if r["x"] is None] == [(0.0, 1.0)]


PAIRS = "task string, node_id string, eligible boolean, node_failed boolean, recv_sec double, created_sec double, deadline_sec double"


def test_full_delivery_after_the_deadline(spark):
    df = spark.createDataFrame([("t", "a", True, False, 9.0, 0.0, 10.0), ("t", "b", True, False, 21.0, 0.0, 10.0)], PAIRS)
    row = outcomes.coverage(df, ["task"]).first()
    assert row["t100_surviving_min"] == pytest.approx(21 / 60)
    assert not row["s100_surviving_by_deadline"] and row["s100_surviving_by_end"]
    marks = outcomes.milestones(df, ["task"], (50, 100)).first()
    assert (marks["t50_min"], marks["t100_min"]) == (pytest.approx(9 / 60), pytest.approx(21 / 60))


def test_two_denominators_and_empty_targets(spark):
    df = spark.createDataFrame(
        [("t", "a", True, False, 5.0, 0.0, 10.0), ("t", "b", True, True, None, 0.0, 10.0), ("u", "a", False, False, 5.0, 0.0, 10.0)], PAIRS)
    rows = {r["task"]: r for r in outcomes.coverage(df, ["task"]).collect()}
    assert rows["t"]["original_coverage_deadline_percent"] == 50.0 and rows["t"]["surviving_coverage_deadline_percent"] == 100.0
    assert rows["u"]["original_coverage_deadline_percent"] is None and not rows["u"]["s100_original_by_deadline"]


def test_conflicting_duplicates(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 1.0), ("B", 1.0), ("C", None), ("C", None)], "k string, score double")
    assert [r["k"] for r in quality.conflicting_duplicates(df, ["k"], ["score"]).collect()] == ["A"]


def test_checked_join_refuses_and_quarantines(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    right = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "k int, b int")
    with pytest.raises(ValueError, match="not unique"):
        joins.join_checked(left, right, ["k"])
    assert [tuple(r) for r in joins.join_checked(left, right, ["k"], "inner", quarantine=True).collect()] == [(2, "y", 20)]


def test_gate_enforces(spark):
    observed = spark.createDataFrame([(3, 4)], "a long, b long")
    table = quality.exact_counts(observed, {"a": 3, "b": 5})
    with pytest.raises(quality.GateFailed, match="b"):
        quality.enforce(table)
    quality.enforce(table.filter("check = 'a'"))


def test_interval_subtract_shares_capacity(spark):
    windows_df = spark.createDataFrame([(1, "g", 0.0, 100.0, 100.0, 50.0), (2, "g", 200.0, 210.0, 10.0, 5.0), (3, "h", 0.0, 9.0, 9.0, 1.0), (4, "g", 30.0, 40.0, 10.0, 1.0)],
                                       "window_id long, k string, start_sec double, end_sec double, duration_sec double, capacity_mbits double")
    outage = spark.createDataFrame([("g", 20.0, 60.0)], "k string, out_start double, out_end double")
    got = {r["window_id"]: (r["start_sec"], r["end_sec"], r["capacity_mbits"]) for r in joins.interval_subtract(windows_df, outage, ["k"]).collect()}
    assert got == {"1_pre": (0.0, 20.0, 10.0), "1_post": (60.0, 100.0, 20.0), "2": (200.0, 210.0, 5.0), "3": (0.0, 9.0, 1.0)}


def test_next_opportunity_ties_and_limits(spark):
    received = spark.createDataFrame([("t", "a", 5.0, 20.0), ("t", "b", 1.0, 20.0), ("u", "a", 30.0, 20.0)], "task_id string, node_id string, recv_sec double, deadline_sec double")
    seen = spark.createDataFrame([("t", "a", 4.0), ("t", "a", 5.0), ("t", "b", 5.0), ("u", "a", 31.0)], "task_id string, node_id string, opportunity_sec double")
    assert [tuple(r) for r in joins.next_opportunity(received, seen).collect()] == [("t", 5.0, "a", 5.0)]


def test_candidate_pairs_fall_back_without_central(spark):
    nodes = spark.createDataFrame([("p", 1, True), ("p", 2, False), ("p", 3, False), ("q", 4, False), ("q", 5, False)], "g string, node_id long, is_central boolean")
    got = {(r["node_i"], r["node_j"]) for r in joins.candidate_pairs(nodes, "central_only", "g").collect()}
    assert got == {(1, 2), (1, 3), (4, 5)}
    assert joins.candidate_pairs(nodes, "all", "g").count() == 4 and joins.candidate_pairs(nodes, "none", "g").count() == 0


@pytest.mark.parametrize("ys, label", [
    ([1, 2, 2, 3], "monotonic_nondecreasing"), ([3, 2, 2, 1], "monotonic_nonincreasing"), ([1, 5, 2, 0], "interior_peak_or_mixed"), ([5, 1, 2, 0], "mixed")])
def test_trend_labels(spark, ys, label):
    df = spark.createDataFrame([("g", float(i), float(y)) for i, y in enumerate(ys)], "g string, x double, y double")
    assert windows.trend_class(df, ["g"], "x", "y").first()["trend"] == label


def test_saturation(spark):
    df = spark.createDataFrame([("g", float(x), y) for x, y in ((0, 1.0), (10, 5.0), (20, 5.5), (30, 5.2))], "g string, x double, y double")
    assert windows.saturation_level(df, ["g"], "x", "y").first()["saturation_level"] == 10.0


def test_normalise_resolves_aliases_and_fills(spark):
    raw = spark.createDataFrame([("1", "10", "20", " HIGH ", None), ("2", "x", "1", "odd", "2"), ("3", "5", "6", "odd", "2")], "ID string, Lat string, centroid_lon string, Priority string, size_mbits string")
    got = {r["task_id"]: r for r in tables.normalize_tasks(raw).collect()}
    assert set(got) == {"1", "3"}
    assert (got["1"]["priority_class"], got["1"]["task_size_mbits"], got["1"]["required_response_time_min"]) == ("High", 0.5, 60.0)
    assert got["3"]["priority_class"] == "Medium"
    with pytest.raises(ValueError, match="none of"):
        tables.resolve_columns(raw, {"time": ["when"]}, required=["time"])


def test_bootstrap_degenerate_and_bounds(spark):
    df = spark.createDataFrame([("one", 4.0, 0)] + [("many", float(v), v) for v in range(20)] + [("none", None, 0)], "g string, v double, k int")
    got = {r["g"]: r for r in resample.bootstrap_mean(df, ["g"], ["v"], ["k"], 100).collect()}
    assert "none" not in got
    assert (got["one"]["mean"], got["one"]["low"], got["one"]["high"]) == (4.0, 4.0, 4.0)
    assert got["many"]["low"] < 9.5 < got["many"]["high"] and got["many"]["mean"] == 9.5


def test_bootstrap_of_a_large_tied_group(spark):
    df = spark.range(0, 20000, 1, 8).selectExpr("'g' as g", "id", "id % 2 + 0.0 as v")
    row = resample.bootstrap_mean(df, ["g"], ["v"], ["id"], 200).first()
    spread = 0.5 / 20000**0.5
    assert (row["n_units"], row["mean"]) == (20000, 0.5)
    assert row["high"] - row["low"] == pytest.approx(2 * 1.96 * spread, rel=0.25)
    assert row["low"] < 0.5 < row["high"]


def test_bootstrap_does_not_depend_on_the_layout_and_shuffles_no_draws(spark):
    df = spark.range(0, 3000, 1, 8).selectExpr("id % 3 as g", "id", "pmod(xxhash64(id), 100) + 0.0 as v")
    rows = lambda d: sorted((r["g"], r["n_units"], round(r["low"], 9), round(r["high"], 9)) for r in resample.bootstrap_mean(d, ["g"], ["v"], ["id"], 300).collect())
    assert rows(df) == rows(df.orderBy(F.desc("v")).repartition(3))
    plan = resample.bootstrap_mean(df, ["g"], ["v"], ["id"], 300)._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Generate explode"):]
    assert "Exchange" not in before and "partial_sum" in plan


def test_bootstrap_weights_are_poisson():
    bounds, modulus = resample.poisson_bounds(), 2147483647
    shares = [b / modulus for b in bounds]
    assert shares[0] == pytest.approx(0.36787944, abs=1e-8) and shares == sorted(shares)
    assert sum(1 - s for s in shares) == pytest.approx(1.0, abs=1e-8)  # the mean of the weights
    interval = [k * (1 - (shares[k - 1] if k else 0)) for k in range(len(shares))]
    assert all(0 <= x < 1 for x in interval)


def test_clusters_are_drawn_whole(spark):
    df = spark.createDataFrame([("g", c, float(v)) for c, v in [(0, 1), (0, 3), (1, 10), (2, 4), (2, 4), (2, 4)]], "g string, c int, v double")
    row = resample.cluster_bootstrap_mean(df, ["g"], "c", ["v"], 400).first()
    assert row["n_units"] == 3 and row["mean"] == pytest.approx(26 / 6)
    rows = df.selectExpr("g", "c", "v", "c as again")
    assert {(round(r["low"], 9), round(r["high"], 9)) for r in [row, resample.cluster_bootstrap_mean(rows, ["g"], "again", ["v"], 400).first()]} == {(round(row["low"], 9), round(row["high"], 9))}
    assert 2.0 <= row["low"] < row["mean"] < row["high"] <= 10.0


def test_sample_is_exact_in_size_and_repeatable(spark):
    df = spark.range(101).selectExpr("id", "id % 2 as g")
    first = resample.sample_fraction(df, ["g"], "id", 10.0, "s").collect()
    assert sorted(first) == sorted(resample.sample_fraction(df.repartition(7), ["g"], "id", 10.0, "s").collect())
    assert sorted(r["g"] for r in first) == [0] * 6 + [1] * 5


def test_window_capacity_preference(spark):
    made = scalars.window_capacity(F.col("d"), F.lit(2.0), F.col("t"), F.col("r"), F.col("g"), 100.0, 1000.0)
    df = spark.createDataFrame([(10.0, 5.0, 7.0, True), (10.0, None, 7e6, True), (10.0, None, None, True), (10.0, 0.0, None, False)], "d double, t double, r double, g boolean")
    got = [tuple(r) for r in df.select(made["capacity_mbits"], made["capacity_source"]).collect()]
    assert got == [(5.0, "existing_total_data_mbits"), (70.0, "existing_mean_data_rate"), (0.01, "assigned_sat_gs_band_rate"), (0.001, "assigned_band_rate_fallback")]


def test_cost_needs_every_price(spark):
    df = spark.createDataFrame([(1, 2, 3, 4.0)], "n_satellites long, n_planes long, n_central_nodes long, transferred_mbits double")
    with pytest.raises(ValueError, match="no price"):
        scalars.cost_vector(df, df.columns, {"n_satellites": 1.0})
    assert scalars.cost_vector(df, df.columns).first()["monetary_cost"] is None
