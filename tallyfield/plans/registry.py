"""Where named queries and their check SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfield.plans.views import with_views



def settle_ties(sql: str) -> str:
    """``round(x, n)`` -> ``round(round(x, n + 4), n)`` for n up to 6, as :func:`tallyfield.plans.shape.rounded` does.

    Sums of doubles differ in their last bits between engines; a value that lies exactly between two
    roundings would go either way. The finer rounding first puts it back on the tie.
    """
    out, at = [], 0
    while True:
        start = sql.find("round(", at)
        if start < 0:
            return "".join(out) + sql[at:]
        if start and (sql[start - 1].isalnum() or sql[start - 1] == "_"):
            out.append(sql[at : start + 6])
            at = start + 6
            continue
        depth, end, comma = 1, start + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            end += 1
        digits = sql[comma + 1 : end - 1].strip() if comma > 0 else ""
        inner = settle_ties(sql[start + 6 : comma]) if comma > 0 else settle_ties(sql[start + 6 : end - 1])
        out.append(sql[at:start])
        if digits.isdigit() and int(digits) <= 6:
            out.append(f"round(round({inner}, {int(digits) + 4}), {digits})")
        else:
            out.append(f"round({inner}{', ' + digits if digits else ''})")
        at = end


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name the views of :mod:`tallyfield.plans.views` freely."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(settle_ties(sql))
        return fn

    return add
