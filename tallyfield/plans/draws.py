"""SQL twins of the hashed draws: the same plain-integer arithmetic as :func:`tallyfield.functions.scalars.mixed`."""

from __future__ import annotations

from tallyfield.operators.resample import poisson_bounds


def _mix(state: str, number: str) -> str:
    step = f"((({state})::BIGINT * 48271 + (({number})::BIGINT % 2147483647) * 69621 + 12345) % 2147483647)"
    return f"(({step} * {step} + 16807) % 2147483647)"


def _advanced(inner: str, kept: str, number: str) -> str:
    """``inner`` (kept, state) with its state led on by one number."""
    step = f"SELECT {kept}, (state * 48271 + ({number}) % 2147483647 * 69621 + 12345) % 2147483647 AS half FROM {inner}"
    return f"(SELECT {kept}, (half * half + 16807) % 2147483647 AS state FROM ({step}))"


def _settled(inner: str, kept: str, name: str) -> str:
    return f"(SELECT {kept}, (state * state + state * 48271 + 7) % 2147483647 AS {name} FROM {inner})"


def weights_sql(source: str, keys: str, unit: str, draws: int, seed: int) -> str:
    """SQL: ``source`` (keys, unit, s, c) under every draw with its Poisson(1) weight w."""
    named = f"{keys}, s, c, digest"
    inner = f"(SELECT {keys}, s, c, md5({unit}) AS digest, 1::BIGINT AS state FROM {source})"
    for number in (str(seed), "('0x' || substr(digest, 1, 7))::BIGINT", "('0x' || substr(digest, 8, 7))::BIGINT"):
        inner = _advanced(inner, named, number)
    drawn = f"{keys}, s, c, draw, u"
    inner = f"(SELECT {keys}, s, c, u, draw, 1::BIGINT AS state FROM {_settled(inner, f'{keys}, s, c', 'u')}, range({draws}) t(draw))"
    for number in ("u", "draw"):
        inner = _advanced(inner, drawn, number)
    return f"(SELECT {keys}, s, c, draw, {' + '.join(f'(h >= {b})::INT' for b in poisson_bounds())} AS w FROM {_settled(inner, drawn, 'h')})"


def interval_sql(units: str, keys: str, unit: str, draws: int, seed: int, name: str) -> str:
    """SQL: CTE ``name`` (keys, n_units, mean, low, high) from a table of units (keys, unit, s, c)."""
    return f"""{name}_d AS (SELECT {keys}, draw, sum(w * s) / sum(w * c) AS m FROM {weights_sql(units, keys, unit, draws, seed)} WHERE w > 0 GROUP BY {keys}, draw),
{name} AS (SELECT {keys}, u.n AS n_units, u.mean, CASE WHEN u.n = 1 THEN u.mean ELSE low END AS low, CASE WHEN u.n = 1 THEN u.mean ELSE high END AS high
  FROM (SELECT {keys}, count(*) AS n, sum(s) / sum(c) AS mean FROM {units} GROUP BY ALL) u
  JOIN (SELECT {keys}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM {name}_d GROUP BY ALL) USING ({keys}))"""


def bootstrap_sql(source: str, keys: str, value: str, unit: str, draws: int, seed: int, name: str, where: str = "true") -> str:
    """SQL: CTE ``name`` for resampled rows of ``source``."""
    return f"""{name}_u AS MATERIALIZED (SELECT {keys}, {unit}, ({value})::DOUBLE AS s, 1 AS c FROM {source} WHERE {value} IS NOT NULL AND {where}),
{interval_sql(f"{name}_u", keys, unit, draws, seed, name)}"""
