"""Row digests without collisions, samples of nothing, deep folders, and every failing check named."""

import pytest
from pyspark.sql import functions as F

from tallyfield.functions.ids import row_digest
from tallyfield.operators.quality import GateFailed, enforce
from tallyfield.operators.resample import sample_fraction
from tallyfield.sources.files import folder_counts


def test_row_digest(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x"), ("N", "x")], "x string, y string")
    assert rows.select(row_digest(F.col("x"), F.col("y"))).distinct().count() == 5


def test_zero_percent(spark):
    units = spark.createDataFrame([("g", i) for i in range(50)], "g string, u long")
    assert [sample_fraction(units, ["g"], "u", p, "s").count() for p in (0.0, 0.1, 10.0, 100.0)] == [0, 1, 5, 50]


def test_deep_folders(spark):
    assert folder_counts(spark.createDataFrame([("/".join("abcdefghijklm"),)], "path string")).count() == 12


def test_all_failures_named(spark):
    checks = spark.createDataFrame([(f"check{i:02d}", False) for i in range(60)], "check string, passed boolean")
    with pytest.raises(GateFailed) as raised:
        enforce(checks)
    assert all(f"check{i:02d}" in str(raised.value) for i in range(60))
