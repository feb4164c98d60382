"""Whole-table steps on task tables: column aliases, normalisation, time shifts and horizon checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.scalars import DEFAULT_SIZE_MBIT, PRIORITY_RESPONSE_MIN, priority_class, to_number
from tallyfield.operators.ordered import numbered

# The names under which each task column may arrive, best first.
TASK_ALIASES = {
    "task_id": ("task_id", "id", "event_id"),
    "latitude": ("latitude", "lat", "centroid_lat"),
    "longitude": ("longitude", "lon", "centroid_lon"),
    "priority_class": ("priority_class", "priority"),
    "task_size_mbits": ("task_size_mbits", "size_mbits"),
    "required_response_time_min": ("required_response_time_min", "response_time_min"),
    "timestamp_utc": ("timestamp_utc", "timestamp", "acq_datetime"),
}


def resolve_columns(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], ignore_case: bool = True, required: Sequence[str] = ()
) -> DataFrame:
    """Rename the first alias present for each wanted column; a column found nowhere becomes NULL."""
    fold = (lambda n: n.lower()) if ignore_case else (lambda n: n)
    have = {fold(c): c for c in reversed(df.columns)}
    picks = []
    for wanted, names in aliases.items():
        found = next((have[fold(n)] for n in names if fold(n) in have), None)
        if found is None and wanted in required:
            raise ValueError(f"none of {list(names)} among {df.columns}")
        picks.append(F.col(f"`{found}`").alias(wanted) if found else F.lit(None).alias(wanted))
    return df.select(*picks)


def normalize_tasks(df: DataFrame, aliases: Mapping[str, Sequence[str]] = TASK_ALIASES, first_n: int | None = None) -> DataFrame:
    """Uniform task rows: numbers parsed, classes capitalised (unknown -> Medium), size and response
    time filled in, rows without coordinates dropped."""
    raw = resolve_columns(df, aliases, required=("task_id", "latitude", "longitude"))
    numbers = {c: to_number(F.col(c)) for c in ("latitude", "longitude", "task_size_mbits", "required_response_time_min")}
    out = raw.withColumns({**numbers, "priority_class": priority_class(F.coalesce("priority_class", F.lit("Medium")))})
    out = out.filter("latitude is not null and longitude is not null")
    out = out.withColumns(
        {
            "task_size_mbits": F.coalesce("task_size_mbits", F.lit(DEFAULT_SIZE_MBIT)),
            "required_response_time_min": F.coalesce("required_response_time_min", response_minutes("priority_class")),
        }
    )
    return out.orderBy("task_id").limit(first_n) if first_n else out


def response_minutes(priority: str) -> Column:
    cases = " ".join(f"when '{name}' then {minutes}D" for name, minutes in PRIORITY_RESPONSE_MIN.items())
    return F.expr(f"case {priority} {cases} end")


def task_assertions(tasks: DataFrame) -> DataFrame:
    """(check, violations, passed) on normalised tasks."""
    tests = {
        "deadline_after_creation": "not coalesce(deadline_sec > created_sec, false)",
        "positive_size": "not coalesce(task_size_mbits > 0, false)",
        "known_priority": "priority_class not in ('Critical', 'High', 'Medium', 'Low')",
        "coordinates_in_range": "abs(latitude) > 90 or abs(longitude) > 180",
    }
    return check_counts(tasks, tests)


def check_counts(df: DataFrame, violations: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """One aggregation for all tests, then one row per (keys, check)."""
    names = list(violations)
    counted = df.groupBy(*keys).agg(*[F.expr(f"count_if({test}) as `{name}`") for name, test in violations.items()])
    return counted.unpivot(list(keys), names, "check", "violations").withColumn("passed", F.expr("violations = 0"))


# The floors a campaign start may be rounded down to.
EPOCH_FLOORS = ("none", "minute", "hour", "day")


def infer_epoch(
    tasks: DataFrame, ts: str, deadline: str, keys: Sequence[str] = (), floor: str = "none",
    min_hours: float = 0.0, buffer_hours: float = 0.0,
) -> DataFrame:
    """Start = earliest valid time, rounded down; horizon in hours = last deadline + buffer, at least ``min_hours``."""
    if floor not in EPOCH_FLOORS:
        raise ValueError(f"floor must be one of {EPOCH_FLOORS}")
    found = tasks.groupBy(*keys).agg(F.min(ts).alias("epoch"), F.max(deadline).alias("_last"))
    if floor != "none":
        found = found.withColumn("epoch", F.date_trunc(floor, "epoch"))
    return found.withColumn(
        "horizon_hours",
        F.expr(f"greatest({float(min_hours)}D, (unix_micros(_last) - unix_micros(epoch)) / 3.6e9D + {float(buffer_hours)}D)"),
    ).drop("_last")


def remap_times(tasks: DataFrame, ts: str, tie: str, epoch: str, spacing_min: float) -> DataFrame:
    """Place tasks at equal steps from ``epoch`` in order of their time (missing last), then of ``tie``.

    The global order is numbered over ranges, not in one task.
    """
    step = int(spacing_min * 60_000_000)
    placed = numbered(tasks.withColumn("_late", F.col(ts).isNull()), [], ["_late", ts, tie], "position")
    return placed.withColumn(
        "remapped_ts", F.expr(f"timestamp_micros(unix_micros(timestamp'{epoch}') + (position - 1) * {step}L)")
    ).drop("_late")


def horizon_check(tasks: DataFrame, hours: float, keys: Sequence[str] = ()) -> DataFrame:
    """Does any creation or deadline (seconds) lie beyond the end?"""
    end = float(hours) * 3600.0
    return tasks.groupBy(*keys).agg(
        F.expr("max(created_sec) as latest_created_sec"), F.expr("max(deadline_sec) as latest_deadline_sec")
    ).withColumn("passed", F.expr(f"latest_created_sec <= {end}D and latest_deadline_sec <= {end}D"))


def csv_row_size(tasks: DataFrame, columns: Sequence[str], factor: float, name: str = "task_size_mbits") -> DataFrame:
    """Size of the row as UTF-8 JSON times an overhead factor, in Mbit."""
    return tasks.withColumn(name, F.octet_length(F.to_json(F.struct(*columns))) * F.lit(8.0 * factor / 1e6))
