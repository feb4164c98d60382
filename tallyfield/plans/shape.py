"""Rounding of results: engines add doubles in different orders.

A finer rounding comes first, so that a value exactly between two roundings goes the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.selectExpr(*[f"round(round(`{c}`, {digits + 4}), {digits}) as `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes])
