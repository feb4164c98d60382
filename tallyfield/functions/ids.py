"""Case codes, slugs, fingerprints and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The text form of a case code, and the name and type of each of its fields.
CASE_PATTERN = r"^T(\d{3,4})_P(\d{2})_H(\d{4})_I(\d{4})_CN(\d{3})_F(\d+)$"
CASE_FORMAT = "T%03d_P%02d_H%04d_I%04d_CN%03d_F%d"
CASE_FIELDS = (
    ("n_satellites", "long", 1.0),
    ("n_planes", "long", 1.0),
    ("altitude_km", "double", 1.0),
    ("inclination_deg", "double", 10.0),
    ("cn_fraction_percent", "double", 1.0),
    ("walker_f", "long", 1.0),
)


def case_fields(case_id: str | Column, strict: bool = False) -> dict[str, Column]:
    """Columns parsed out of a case code; NULL for a code that does not fit, or an error if ``strict``."""
    text = F.col(case_id) if isinstance(case_id, str) else case_id
    fits = text.rlike(CASE_PATTERN)
    if strict:
        text = F.when(fits, text).otherwise(F.raise_error(F.concat(F.lit("not a case code: "), text)))
    fields = {}
    for index, (name, kind, scale) in enumerate(CASE_FIELDS, start=1):
        number = F.regexp_extract(text, CASE_PATTERN, index).cast("long")
        value = number if scale == 1.0 else number / F.lit(scale)
        # Under strict the error sits in ``text`` and must be reached, so nothing may skip the value.
        fields[name] = value.cast(kind) if strict else F.when(fits, value.cast(kind))
    return fields


def parse_case_id(df: DataFrame, column: str = "case_id", strict: bool = False) -> DataFrame:
    return df.withColumns(case_fields(column, strict))


def base_id(case_id: str | Column) -> Column:
    """The case code without its level part."""
    return F.regexp_replace(case_id, r"_CN\d{3}(?=_F\d+$)", "")


def format_case_id(
    satellites: Column, planes: Column, altitude: Column, inclination: Column, level: Column, walker: Column
) -> Column:
    """Zero-padded code; fractional inputs round half to even, inclination is kept in tenths."""
    whole = lambda c: F.bround(c.cast("double"), 0).cast("long")
    return F.format_string(
        CASE_FORMAT,
        whole(satellites),
        whole(planes),
        whole(altitude),
        whole(inclination.cast("double") * 10),
        whole(level),
        walker.cast("long"),
    )


def slug(text: Column, default: str = "region") -> Column:
    """Runs of characters outside letters, digits, ``_`` and ``-`` become one ``_``; ends are trimmed."""
    cleaned = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_-]+", "_"), r"^_+|_+$", "")
    return F.when(cleaned == "", F.lit(default)).otherwise(cleaned)


def number_slug(number: Column) -> Column:
    """``0.5`` -> ``0p5``."""
    return F.translate(number.cast("string"), ".", "p")


def seed_hex(*parts: Column) -> Column:
    """The first eight bytes, in hex, of the SHA-256 of the parts joined by a pipe."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16)


def row_digest(*parts: Column) -> Column:
    """SHA-256 of one row. Every field is led by its length, NULL is the letter N, so different rows never spell the same text."""
    fields = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.char_length(f).cast("string"), F.lit(":"), f), F.lit("N")) for f in fields]), 256)


def digest_sum(digest: Column) -> Column:
    """Order-free fingerprint of a set of digests for ``agg``: sums of the leading 52-bit parts.

    Adding fixed-width numbers keeps the state at a few bytes per group, where collecting and
    sorting all digests of a group would not.
    """
    parts = [F.conv(F.substring(digest, start, 13), 16, 10).cast("decimal(38,0)") for start in (1, 14, 27)]
    sums = [F.lpad(F.sum(p).cast("string"), 38, "0") for p in parts]
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256)
