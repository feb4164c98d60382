"""Time to event with censoring: product-limit curves and restricted mean time, over ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.scalars import DEADLINE_SLACK_SEC
from tallyfield.operators.ordered import RANGE, attach, into_ranges, neighbours, running


def time_to_event(tasks: DataFrame, keys: Sequence[str], events: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row per task and event: whether it came in time, and the time to it or to the deadline (minutes).

    ``events``: name -> (flag column, time column). A row needs ``created_sec`` and ``deadline_sec``.
    """
    rows = ", ".join(
        f"named_struct('event_name', '{name}', 'flag', {flag}, 't', cast({time} as double))" for name, (flag, time) in events.items()
    )
    long = tasks.selectExpr(*keys, "(deadline_sec - created_sec) / 60 as censor_min", f"inline(array({rows}))")
    happened = f"coalesce(flag and t is not null and t <= censor_min + {DEADLINE_SLACK_SEC}, false)"
    return long.selectExpr(
        *keys, "event_name", f"{happened} as event", f"if({happened}, t, censor_min) as duration_min"
    )


def survival_steps(
    df: DataFrame, keys: Sequence[str], duration: str = "duration_min", event: str = "event", horizon: str | None = None,
    clip: bool = False,
) -> DataFrame:
    """One row per (keys, time) with at-risk counts, events, censored and the survival after that time.

    ``horizon`` is a column or number. Without ``clip`` it is cut to the longest duration and later
    times are dropped; with ``clip`` durations are cut to the horizon and keep their event flag.
    Counts per time are summed first; at-risk counts and the running product go over ranges, with a
    factor of zero tracked on its own because its logarithm has no value.
    """
    known = df.filter(f"{duration} is not null and not isnan({duration}) and {duration} >= 0 and {event} is not null")
    limit = f"cast({horizon} as double)" if horizon is not None else "cast(null as double)"
    rows = known.selectExpr(*keys, f"{duration} as t", f"cast({event} as long) as e", f"{limit} as h")
    if clip:
        rows = rows.withColumn("t", F.expr("least(t, h)"))
    counts = rows.groupBy(*keys, "t").agg(
        F.expr("sum(e) as events"), F.expr("count(*) - sum(e) as censored"), F.expr("max(h) as h")
    )
    ranged = into_ranges(counts, keys, ["t"])
    totals = ranged.groupBy(*keys).agg(F.expr("sum(events + censored) as n_total"), F.expr("max(t) as longest"), F.expr("max(h) as horizon"))
    left = running(ranged, keys, ["t"], {"gone_before": F.expr("events + censored")}, before=True)
    placed = attach(left, totals, keys).selectExpr(
        *keys, RANGE, "t", "events", "censored", "n_total - gone_before as at_risk", "n_total",
        f"{'horizon' if clip else 'least(coalesce(horizon, longest), longest)'} as horizon",
    ).filter("t <= horizon")
    factored = placed.selectExpr(
        "*", "cast(events = at_risk as long) as _dead", "if(events = at_risk, 0D, ln(1 - events / at_risk)) as _log"
    )
    product = running(factored, keys, ["t"], {"_dead_upto": F.col("_dead"), "_log_upto": F.col("_log")})
    steps = product.selectExpr(
        *keys, RANGE, "t", "at_risk", "events", "censored", "n_total", "horizon", "if(_dead_upto > 0, 0D, exp(_log_upto)) as survival"
    )
    return neighbours(steps, keys, ["t"], previous={"_t0": "t", "_s0": "survival"}).selectExpr(
        *keys, "t as time_min", "survival", "1 - survival as event_probability", "at_risk", "events", "censored", "horizon",
        "coalesce(_s0, 1D) * (t - coalesce(_t0, 0D)) as area_before", "n_total",
    )


def km_curve(df: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """The step curve with its starting point (time 0, survival 1)."""
    steps = survival_steps(df, keys, **options)
    columns = [*keys, "time_min", "survival", "event_probability", "at_risk", "events", "censored", "horizon"]
    if options.get("clip"):
        shown = steps.filter("events > 0")
    else:
        shown = steps
    start = steps.groupBy(*keys).agg(F.expr("max(n_total) as n"), F.expr("max(horizon) as horizon")).selectExpr(
        *keys, "0D as time_min", "1D as survival", "0D as event_probability", "n as at_risk", "0L as events", "0L as censored", "horizon"
    )
    return shown.select(*columns).unionByName(start.select(*columns))


def km_summary(df: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Event probability at the horizon and restricted mean time (area under survival up to the horizon)."""
    steps = survival_steps(df, keys, **options)
    return steps.groupBy(*keys).agg(
        F.expr("max(n_total) as n"), F.expr("max(horizon) as horizon"), F.expr("1 - min(survival) as event_probability"),
        F.expr("sum(area_before) as _area"), F.expr("max(time_min) as _last"), F.expr("min(survival) as _s"),
    ).selectExpr(*keys, "n", "horizon", "event_probability", "_area + _s * greatest(0D, horizon - _last) as rmst")
