"""Column expressions on tasks, times, links and costs. All of them are plain built-in functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Priority classes with their response time (minutes), rank and default size (Mbit),
# the earth radius (km), and the slack allowed when comparing an arrival with a deadline (seconds).
PRIORITY_RESPONSE_MIN = {"Critical": 30, "High": 60, "Medium": 180, "Low": 360}
PRIORITY_RANK = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}
UNKNOWN_PACKAGE_RANK = 9
DEFAULT_SIZE_MBIT = 0.5
EARTH_RADIUS_KM = 6378.137
DEADLINE_SLACK_SEC = 1e-9


def mapped(column: Column, table: Mapping[str, object], default: object = None) -> Column:
    """CASE over a small fixed table."""
    out = F.lit(default)
    for key, value in reversed(list(table.items())):
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def to_number(column: Column) -> Column:
    """Double, with unreadable text and NaN as NULL."""
    number = column.try_cast("double")
    return F.when(~F.isnan(number), number)


def to_bool(column: Column) -> Column:
    """True only for the text ``true`` in any case, with blanks around it ignored."""
    return F.coalesce(F.lower(F.trim(column.cast("string"))) == "true", F.lit(False))


def ratio(top: Column, bottom: Column) -> Column:
    """NULL instead of an error on a zero denominator."""
    return F.try_divide(top.cast("double"), F.nullif(bottom.cast("double"), F.lit(0.0)))


def epoch_seconds(ts: Column, epoch: Column) -> Column:
    """Seconds from ``epoch`` to ``ts`` with microseconds kept; text that is no timestamp gives NULL."""
    parse = lambda c: F.try_to_timestamp(c.cast("string"))
    return (F.unix_micros(parse(ts)) - F.unix_micros(parse(epoch))) / F.lit(1e6)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def derive_deadline(
    created: Column, response_min: Column | None, given: Column | None, priority: Column, unit_sec: int = 60
) -> Column:
    """Timestamp of the deadline: own response time, else a given deadline, else the priority's response time."""
    shift = lambda n: F.timestamp_micros(
        F.unix_micros(created) + (n.cast("double") * unit_sec * 1_000_000).cast("long")
    )
    fallback = mapped(priority, PRIORITY_RESPONSE_MIN, PRIORITY_RESPONSE_MIN["Medium"])
    choices = []
    if response_min is not None:
        choices.append(shift(response_min))
    if given is not None:
        choices.append(given)
    return F.coalesce(*choices, shift(fallback))


def priority_class(raw: Column) -> Column:
    """Capitalised class name; anything unknown counts as Medium."""
    name = F.initcap(F.trim(raw))
    return F.when(name.isin(*PRIORITY_RANK), name).otherwise(F.lit("Medium"))


def task_size(mode: str, declared: Column | None = None, priority: Column | None = None, fixed: float = DEFAULT_SIZE_MBIT,
              sizes: Mapping[str, float] | None = None, row: Sequence[str] = (), factor: float = 1.0) -> Column:
    """Size in Mbit by one of four rules; a size that is missing or not positive becomes the default."""
    if mode == "fixed":
        size = F.lit(float(fixed))
    elif mode == "priority":
        size = mapped(priority, sizes or {}, float(fixed))
    elif mode == "declared":
        size = to_number(declared)
    elif mode == "row_json":
        size = F.octet_length(F.to_json(F.struct(*row))) * F.lit(8.0 * factor / 1e6)
    else:
        raise ValueError(f"unknown size rule {mode}")
    return F.when(size > 0, size).otherwise(F.lit(float(fixed)))


# Default sizes (Mbit) by class, and the package each class travels in, per mode.
PRIORITY_SIZE_MBIT = {"Critical": 2.0, "High": 1.5, "Medium": 1.0, "Low": 0.5}
PACKAGES = {
    "two_level": {"Critical": ("urgent", 0), "High": ("urgent", 0), "Medium": ("routine", 1), "Low": ("routine", 1)},
    "four_level": {"Critical": ("critical", 0), "High": ("high", 1), "Medium": ("medium", 2), "Low": ("low", 3)},
}


def priority_package(priority: Column, mode: str) -> tuple[Column, Column]:
    """(label, rank) of the package a task travels in; an unknown class ranks last."""
    if mode == "none":
        return F.lit("unpackaged"), F.lit(0)
    if mode not in PACKAGES:
        raise ValueError(f"unknown package mode {mode}")
    table = PACKAGES[mode]
    labels = {name: label for name, (label, _) in table.items()}
    ranks = {name: rank for name, (_, rank) in table.items()}
    return mapped(priority, labels, "unknown"), mapped(priority, ranks, UNKNOWN_PACKAGE_RANK)


def window_capacity(
    duration: Column, utilisation: Column, total_mbit: Column, mean_rate: Column, is_ground: Column,
    band_rate: float, ground_rate: float | None = None,
) -> dict[str, Column]:
    """Rate (bps), capacity (Mbit) and their origin. Preference: a volume given, a rate given, the
    rate of a ground link, the rate of the band. The utilisation limit is held to [0, 1]."""
    seconds = F.greatest(F.coalesce(duration, F.lit(0.0)), F.lit(0.0))
    limit = F.greatest(F.least(utilisation, F.lit(1.0)), F.lit(0.0))
    has_volume = F.coalesce(total_mbit > 0, F.lit(False))
    has_rate = F.coalesce(mean_rate > 0, F.lit(False))
    assigned = F.when(is_ground, F.lit(float(ground_rate or band_rate))).otherwise(F.lit(float(band_rate)))
    rate = (
        F.when(has_rate, mean_rate)
        .when(has_volume, total_mbit * 1e6 / F.greatest(seconds, F.lit(1.0)))
        .otherwise(assigned)
    )
    volume = F.when(has_volume, total_mbit).otherwise(rate * seconds / 1e6)
    source = (
        F.when(has_volume, "existing_total_data_mbits")
        .when(has_rate, "existing_mean_data_rate")
        .when(is_ground, "assigned_sat_gs_band_rate")
        .otherwise("assigned_band_rate_fallback")
    )
    return {
        "data_rate_bps": rate,
        "capacity_mbits": F.greatest(volume * limit, F.lit(0.0)),
        "capacity_source": source,
    }


# Link names by (first end is central, second end is central).
LINK_TYPES = {(True, True): "cn_to_cn", (True, False): "cn_to_obs", (False, True): "obs_to_cn", (False, False): "obs_to_obs"}


def link_type(i_central: Column, j_central: Column) -> Column:
    out = F.lit(None).cast("string")
    for (i, j), name in LINK_TYPES.items():
        out = F.when((i_central == F.lit(i)) & (j_central == F.lit(j)), name).otherwise(out)
    return out


# Readable names of failure families, and of routing by the word a policy name holds.
FAILURE_LABELS = {
    "random_satellite_failure": "Random satellite loss",
    "random_cn_failure": "Random Central Node loss",
    "targeted_cn_failure": "Targeted Central Node loss",
    "link_window_outage": "Link-window outage",
    "capacity_degradation": "Capacity degradation",
    "ground_station_outage": "Ground-station outage",
    "combined_stress": "Combined stress",
}
POLICY_LABELS = {"central": "Central Node routing", "peer": "Peer routing", "hybrid": "Hybrid routing"}


def failure_label(family: Column) -> Column:
    """Readable failure name; an unlisted family is spelled out in title case."""
    spelled = F.initcap(F.translate(family, "_", " "))
    return F.coalesce(mapped(family, FAILURE_LABELS), spelled)


def policy_label(policy: Column) -> Column:
    out = F.lit("Nominal routing")
    for word, label in reversed(list(POLICY_LABELS.items())):
        out = F.when(F.lower(policy).contains(word), label).otherwise(out)
    return out


def failure_class(n_targets: Column, n_reached: Column, observed: Column) -> Column:
    """First reason that applies: no target, no target reached, reached but not observed; else success."""
    return (
        F.when(F.coalesce(n_targets, F.lit(0)) == 0, "geometry_failure_no_eligible_receiver")
        .when(F.coalesce(n_reached, F.lit(0)) == 0, "communication_failure_no_target_reached")
        .when(~F.coalesce(observed, F.lit(False)), "routing_or_timing_failure")
        .otherwise("success")
    )


def cost_vector(df: DataFrame, keep: Sequence[str], coefficients: Mapping[str, float] | None = None) -> DataFrame:
    """Resource columns, plus one money column if a price is given for every priced column."""
    priced = {"n_satellites", "n_planes", "n_central_nodes", "transferred_mbits"}
    out = df.select(*keep)
    if coefficients is None:
        return out.withColumn("monetary_cost", F.lit(None).cast("double"))
    missing = priced - set(coefficients)
    if missing:
        raise ValueError(f"no price for {sorted(missing)}")
    total = reduce(lambda a, b: a + b, [F.col(c).cast("double") * float(coefficients[c]) for c in sorted(priced)])
    return out.withColumn("monetary_cost", total)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((b - a) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = half_lat * half_lat + F.cos(a) * F.cos(b) * half_lon * half_lon
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def scenario_filter(df: DataFrame, names: Sequence[str] = (), family_pattern: str | None = None) -> DataFrame:
    """Rows whose scenario is one of ``names`` (any case) or whose family matches the pattern."""
    test = F.lower("scenario_id").isin(*[n.lower() for n in names]) if names else F.lit(False)
    if family_pattern:
        test = test | F.lower("family").rlike(family_pattern)
    return df.filter(test)


def multiplier_from_id(scenario_id: Column) -> Column:
    """The number after ``_x`` in a scenario name, with ``p`` as its point; NULL if there is none."""
    text = F.regexp_extract(scenario_id, r"_x(\d+(?:p\d+)?)", 1)
    return F.translate(text, "p", ".").try_cast("double")


# Modulus and multipliers of the arithmetic hash below.
HASH_MODULUS = 2147483647
HASH_MULTIPLIERS = (48271, 69621, 16807)


def mixed(*numbers: Column) -> Column:
    """A repeatable integer in [0, 2^31-1) from whole numbers, by plain arithmetic any SQL engine repeats."""
    state = F.lit(1).cast("long")
    for number in numbers:
        state = (state * HASH_MULTIPLIERS[0] + (number.cast("long") % HASH_MODULUS) * HASH_MULTIPLIERS[1] + 12345) % HASH_MODULUS
        state = (state * state + HASH_MULTIPLIERS[2]) % HASH_MODULUS
    return (state * state + state * HASH_MULTIPLIERS[0] + 7) % HASH_MODULUS


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x in [0, 2^62]: adding the high to the low 31 bits keeps the remainder."""
    x = (x & HASH_MODULUS) + (x >> 31)
    x = (x & HASH_MODULUS) + (x >> 31)
    return np.where(x == HASH_MODULUS, 0, x)


def mixed_numbers(*numbers: np.ndarray) -> np.ndarray:
    """:func:`mixed` of arrays of whole numbers from 0 on, which broadcast against each other."""
    state: np.ndarray | int = 1
    for number in numbers:
        number = np.asarray(number, dtype=np.int64) % HASH_MODULUS * HASH_MULTIPLIERS[1] + 12345
        state = _folded(state * HASH_MULTIPLIERS[0] + number)
        state = _folded(state * state + HASH_MULTIPLIERS[2])
    return _folded(state * state + state * HASH_MULTIPLIERS[0] + 7)


def uniform(*numbers: Column) -> Column:
    """A repeatable number strictly between 0 and 1."""
    return (mixed(*numbers) + 0.5) / F.lit(float(HASH_MODULUS))


def text_uniform(text: Column) -> Column:
    """As :func:`uniform`, from text, by MD5."""
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("double") + 0.5) / F.lit(float(16**15))
