"""Ranges against pandas, with one group holding a third of the rows and spread over several ranges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import ordered, windows
from tallyfield.operators.correlation import correlations
from tallyfield.operators.network import gini


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Keep small partitions apart, so that groups really span ranges."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 6000
    key = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 40, n).astype(str))
    value = np.round(rng.gamma(2.0, 10.0, n), 1)
    value[rng.random(n) < 0.05] = np.nan
    value[rng.random(n) < 0.2] = 7.0
    return pd.DataFrame({"key": key, "id": np.arange(n), "value": value, "other": np.round(value * 0.5 + rng.normal(0, 5, n), 1)})


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).repartition(8).cache()


def test_hot_group_spans_ranges(df):
    ranged = ordered.into_ranges(df.filter("not isnan(value)"), ["key"], ["value", "id"])
    assert ranged.filter("key = 'hot'").select(ordered.RANGE).distinct().count() > 1


def test_distribution(df, frame):
    got = ordered.distribution(df, ["key"], ["value"], {"p05": 0.05, "median": 0.5, "p95": 0.95}).toPandas().set_index("key").sort_index()
    want = frame.groupby("key")["value"]
    for name, series in {
        "n": want.count(), "mean": want.mean(), "std": want.std(), "min": want.min(), "max": want.max(),
        "p05": want.quantile(0.05), "median": want.median(), "p95": want.quantile(0.95),
    }.items():
        np.testing.assert_allclose(got[name].astype(float), series.sort_index().astype(float), rtol=1e-9, err_msg=name)


def test_ranks(df, frame):
    known = df.filter("not isnan(value)")
    got = ordered.value_ranks(known, ["key"], "value").toPandas()
    want = frame.dropna(subset=["value"]).assign(
        rank_min=lambda d: d.groupby("key")["value"].rank(method="min"), rank_avg=lambda d: d.groupby("key")["value"].rank()
    )[["key", "value", "rank_min", "rank_avg"]].drop_duplicates()
    merged = got.merge(want, on=["key", "value"], suffixes=("", "_want"))
    assert len(merged) == len(got) == len(want)
    assert (merged["rank_min"] == merged["rank_min_want"]).all() and (merged["rank_avg"] == merged["rank_avg_want"]).all()


def test_running_and_neighbours(df, frame):
    known = df.filter("not isnan(value)")
    ranged = ordered.into_ranges(known, ["key"], ["value", "id"])
    run = ordered.running(ranged, ["key"], ["value", "id"], {"total": F.col("id")})
    both = ordered.neighbours(run, ["key"], ["value", "id"], {"before": "id"}, {"after": "id"}).toPandas().sort_values(["key", "value", "id"])
    want = frame.dropna(subset=["value"]).sort_values(["key", "value", "id"])
    groups = want.groupby("key")["id"]
    assert (both["total"].to_numpy() == groups.cumsum().to_numpy()).all()
    for name, shift in (("before", 1), ("after", -1)):
        np.testing.assert_array_equal(both[name].to_numpy(float), groups.shift(shift).to_numpy(float))


def test_numbered_without_keys(df, frame):
    got = ordered.numbered(df.select("id"), [], [F.col("id").desc()]).toPandas().sort_values("id")
    assert (got["row_no"].to_numpy() == len(frame) - np.arange(len(frame))).all()


def test_correlations(df, frame):
    got = correlations(df, ["key"], [("value", "other")]).toPandas().set_index("key")
    for key, part in frame.dropna().groupby("key"):
        ranks = part[["value", "other"]].rank()
        assert got.loc[key, "spearman"] == pytest.approx(ranks["value"].corr(ranks["other"]), abs=1e-9)
        assert got.loc[key, "pearson"] == pytest.approx(part["value"].corr(part["other"]), abs=1e-9)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "a double, b double")
    row = correlations(df, [], [("a", "b")]).first()
    assert row["n"] == 3 and row["pearson"] is None and row["spearman"] is None


def test_islands_across_ranges(df, frame):
    got = windows.islands(df, ["key"], ["id"], F.expr("not isnan(value) and value <> 7.0"), "id", 1.0, None, "value").toPandas()
    rows = []
    for key, part in frame.sort_values("id").groupby("key"):
        on = (part["value"].notna() & (part["value"] != 7.0)).to_numpy()
        start = None
        for i, flag in enumerate(on):
            if flag and start is None:
                start = i
            if start is not None and (not flag or i == len(on) - 1):
                last = i if flag else i - 1
                rows.append((key, part["id"].iloc[start], part["id"].iloc[last] + 1.0, last - start + 1))
                start = None
    have = set(map(tuple, got[["key", "start_at", "end_at", "n_samples"]].itertuples(index=False)))
    assert have == set(rows)


@pytest.mark.parametrize("values, low, high", [([0.0, 0.0, 0.0], 0.0, 0.0), ([0.0, 0.0, 3.0], 0.6, 0.7)])
def test_gini_bounds(spark, values, low, high):
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    assert low <= gini(df, ["g"], "v").first()["gini"] <= high


def test_gini_counts_absent_members_as_zero(spark):
    df = spark.createDataFrame([("a", 3.0)], "g string, v double")
    members = spark.createDataFrame([("a", 3)], "g string, n_total long")
    assert gini(df, ["g"], "v", members).first()["gini"] == pytest.approx(2 / 3)
