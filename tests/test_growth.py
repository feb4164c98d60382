"""Steps whose cost must not grow faster than the input: their plans, and their results on small data."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.functions.scalars import mixed, mixed_numbers
from tallyfield.operators import contacts, decision, grid, resample, spatial
from tallyfield.plans import load
from tallyfield.plans import views as V
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_geo_range_join_gathers_no_side_in_the_driver(spark):
    """The copies of the tasks are many times the tasks; the planner's guess for them does not know that."""
    samples = spark.range(1000).selectExpr("id as i", "id % 180 - 90D as slat", "id % 360 - 180D as slon")
    tasks = spark.range(1000).selectExpr("id as j", "id % 180 - 90D as lat", "id % 360 - 180D as lon")
    joined = spatial.geo_range_join(samples, tasks, 50.0, ("slat", "slon"), ("lat", "lon"), "i >= j")
    assert "Broadcast" not in _plan(joined)
    assert joined.filter("i < j").isEmpty() and not joined.filter("i = j").isEmpty()


@pytest.mark.parametrize("name", ["G04_retention_plan", "G05_volume_estimate"])
def test_plan_counts_cases_before_the_scenarios(spark, monkeypatch, name):
    """Rows that meet the scenarios are designs, not cases; repeated customers are one case, as in the SQL."""
    met = []
    made = grid.scenario_manifest
    monkeypatch.setattr(grid, "scenario_manifest", lambda rows, *rest: met.append(rows) or made(rows, *rest))
    table = V.table
    monkeypatch.setattr(V, "table", lambda s, d, n: table(s, d, n).unionByName(table(s, d, n)) if n == "customer" and name[:3] == "G04" else table(s, d, n))
    got = load.registered()[0][name](spark, SF)
    assert met[0].count() <= 140 * 5
    assert compare(got, duck(SF), load.registered()[1][name]) == []


def test_equal_scores_round_as_the_sql_does(spark):
    """Means of four components of nine digits lie in the middle of two roundings; the ranks depend on which way they go."""
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.integers(0, 10**9, (4000, 4)) / 1e9, columns=list("abcd")).assign(region="r", name=[f"c{i:04d}" for i in range(4000)])
    mean = "(a + b + c + d) / 4"
    want = duckdb.sql(f"SELECT name, round({mean}, 9) AS s FROM frame").df().set_index("name")["s"]
    got = spark.createDataFrame(frame).select("name", decision.settled(F.expr(mean)).alias("s")).toPandas().set_index("name")["s"]
    assert (got.sort_index() == want.sort_index()).all()
    assert spark.sql("select -0.25D as x").select(decision.settled(F.col("x"), 1)).first()[0] == -0.3


def test_weight_sweep_scores_no_case_per_step(spark, monkeypatch):
    """Winners of every step against a plain loop; only cases that can win are scored, and no row is unfolded per step."""
    rng = np.random.default_rng(5)
    rows = [("r" if i % 3 else None, f"c{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 20, (300, 2)) / 20)]
    df = spark.createDataFrame([*rows, ("r", "z", None, 9.0)], "region string, name string, x double, y double")
    kept = []
    leaders = decision.leaders
    monkeypatch.setattr(decision, "leaders", lambda some, *rest: kept.append(some) or leaders(some, *rest))
    got = {(r["region"], r["step"]): (r["winner"], r["utility"]) for r in decision.weight_sweep(df, "region", "name", "x", "y", 11).collect()}
    for region in ("r", None):
        for step in range(11):
            scored = [(-round(step / 10 * x + (1 - step / 10) * y, 9), name) for g, name, x, y in rows if g == region]
            best = min(scored)
            assert got[region, step] == (best[1], pytest.approx(-best[0]))
    assert kept and kept[0].count() < len(rows) / 3


def test_bootstrap_weighs_units_inside_tasks(spark, monkeypatch):
    """The same draws as the plain rule gives row by row, with small blocks and sums given out early, and no row unfolded per draw."""
    monkeypatch.setattr(resample, "UNITS_A_BLOCK", 7)
    monkeypatch.setattr(resample, "HELD", 50)
    rows = [("a" if i % 3 else None, float(i % 2), i * 7919 % 2147483647, float(i % 13), i % 5 > 0) for i in range(200)]
    units = spark.createDataFrame(rows, "g string, x double, _u long, _s0 double, _c0 boolean").withColumn("_c0", F.col("_c0").cast("double"))
    made = resample._drawn_sums(units, ["g", "x"], ["_s0", "_c0"], 20)
    plan = _plan(made)
    assert "MapInArrow" in plan[plan.index("Generate explode"):] and plan.count("Generate") == 1
    got = made.groupBy("g", "x", "_draw").agg(F.sum("_s0"), F.sum("_c0")).collect()
    times = sum(((F.col("h") >= b).cast("int") for b in resample.poisson_bounds()), F.lit(0))
    plain = units.crossJoin(spark.range(20).selectExpr("cast(id as int) as _draw")).withColumn("h", mixed(F.col("_u"), F.col("_draw"))).withColumn("w", times)
    want = plain.groupBy("g", "x", "_draw").agg(F.expr("sum(w * _s0)"), F.expr("sum(w * _c0)")).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
    big = np.array([0, 1, 2**31 - 2, 2**31 - 1, 2**31, 2**45], dtype=np.int64)
    frame = spark.createDataFrame([(int(v),) for v in big], "v long").select("v", mixed(F.lit(3), F.col("v")).alias("m")).collect()
    assert [r["m"] for r in frame] == mixed_numbers(np.int64(3), big).tolist()


def test_large_tables_are_dealt_out_by_rows(spark, monkeypatch):
    """Rows of a task do not grow with the table, whatever the files' compressed size; small tables are left alone."""
    assert V.spread(spark, SF, "lineitem", "l_orderkey").rdd.getNumPartitions() < 16
    monkeypatch.setattr(V, "LARGE", 1000)
    monkeypatch.setattr(V, "ROWS_A_TASK", 1000)
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_custkey")):
        table = V.table(spark, SF, name)
        made = V.spread(spark, SF, name, key)
        sizes = made.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
        assert sizes[0] < 1500 and sizes[1] == table.count()
    query, sql = load.registered()
    assert compare(query["A33_unique_task_counts"](spark, SF), duck(SF), sql["A33_unique_task_counts"]) == []


def test_scenarios_are_named_once(spark):
    """One file of nodes is not one task, and no text is put together per node and scenario."""
    nodes = spark.range(0, 100, 1, 1).withColumnRenamed("id", "node")
    made = grid.scenario_manifest(nodes)
    assert made.select(F.spark_partition_id()).distinct().count() > 1
    assert made.count() == 100 * made.select("scenario_id").distinct().count() == 100 * 539
    per_row = _plan(made).split("BroadcastExchange")[0]
    assert "format_string" not in per_row


def test_rank_distribution_holds_places_per_case(spark):
    """Places of a case are as many as the draws: no ranges are drawn over all of them a second time."""
    df = spark.createDataFrame([("r", f"c{i:02d}", i / 40, (i * 7 % 40) / 40) for i in range(40)], "region string, name string, x double, y double")
    made = decision.rank_distribution(df, "region", "name", ["x", "y"], 9)
    assert _plan(made).count("Window") <= 3
    scored = decision._scored(df, "region", "name", ["x", "y"], 9, 11).toPandas().sort_values(["draw", "score", "name"], ascending=[True, False, True])
    scored["place"] = scored.groupby("draw").cumcount() + 1.0
    want = scored.groupby("name")["place"].agg(["mean", "median", lambda p: p.quantile(0.05), lambda p: p.quantile(0.95), "min", "max"])
    got = made.drop("region", "draws").toPandas().set_index("name").sort_index()
    assert np.allclose(got.to_numpy(float), want.sort_index().to_numpy())


def test_cases_of_a_small_file_are_dealt_out(spark, monkeypatch):
    """Customers come as one file, so one task; each case becomes several expected rows."""
    monkeypatch.setattr(V, "ROWS_A_TASK", 100)
    assert V.cases(spark, SF).select(F.spark_partition_id()).distinct().count() > 1
    query, sql = load.registered()
    assert compare(query["J07_missing_combinations"](spark, SF), duck(SF), sql["J07_missing_combinations"]) == []


def test_points_are_copied_no_higher_than_the_longest_interval(spark, monkeypatch):
    """Contacts of one leaf need one copy of each waiting row, not one a level."""
    made = []
    cells = contacts._point_cells
    monkeypatch.setattr(contacts, "_point_cells", lambda at, top=contacts.LEVELS: made.append(top) or cells(at, top))
    left = spark.range(200).selectExpr("0L as k", "id * 50D as a0", "id * 50D + id % 9 * 400 as a1", "id as i")
    right = spark.range(200).selectExpr("0L as k", "id * 37D as b0", "id * 37D + 20 as b1", "id as j")
    met = contacts.overlaps(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), 100.0).filter("a0 <= b1 and b0 <= a1").select("i", "j").collect()
    assert min(made) <= 1
    want = {(i, j) for i in range(200) for j in range(200) if i * 50 <= j * 37 + 20 and j * 37 <= i * 50 + i % 9 * 400}
    assert len(met) == len(set(met)) and {tuple(r) for r in met} == want
