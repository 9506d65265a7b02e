"""Scalar listing functions: digits, lenient numbers, floors, units, scores, money, errors.

All are compositions of built-in expressions (``translate``, ``rlike``, ``try_cast``,
``CASE``), so they stay inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from abode.config import ASCII_DIGITS, PERSIAN_DIGITS, ROOM_COUNT_MAP

__all__ = [
    "NUMERIC_PATTERN", "col_of", "persian_to_ascii", "to_number", "map_rooms_count",
    "luxury_label", "flag_sum", "tri_state_bool", "bool_code", "clean_floor_text",
    "clean_unit_per_floor", "clamp_negative", "total_credit", "building_age_years",
    "format_money", "percent_error", "coerce_number",
]

# Strings pandas' lenient parser accepts as numbers (no '1d', '1_0', '30+', 'nan').
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def persian_to_ascii(c) -> Column:
    """Persian digits -> ASCII digits, other characters unchanged, null stays null."""
    return F.translate(col_of(c), PERSIAN_DIGITS, ASCII_DIGITS)


def to_number(c) -> Column:
    """Lenient string -> double; anything that is not a plain decimal number -> null."""
    s = col_of(c).cast("string")
    return F.when(s.rlike(NUMERIC_PATTERN), F.trim(s).try_cast("double")).otherwise(F.lit(None).cast("double"))


def map_rooms_count(c) -> Column:
    """Persian room label -> code; anything else or null -> 'unselect'."""
    x = col_of(c)
    out = None
    for label, code in ROOM_COUNT_MAP.items():
        out = (F.when(x == label, F.lit(code)) if out is None else out.when(x == label, F.lit(code)))
    return out.otherwise(F.lit("unselect"))


def luxury_label(n) -> Column:
    """D3: count -> null 'unselect', 0 'none', <=2 'low', <=4 'medium', else 'high'."""
    x = col_of(n)
    return (
        F.when(x.isNull(), "unselect")
        .when(x == 0, "none")
        .when(x <= 2, "low")
        .when(x <= 4, "medium")
        .otherwise("high")
    )


def flag_sum(cols: Iterable) -> Column:
    """Row-wise sum of flags (booleans or their text); null and other text count as 0."""
    total = None
    for c in cols:
        term = F.coalesce(col_of(c).try_cast("boolean").cast("int"), F.lit(0))
        total = term if total is None else total + term
    return total.cast("long")


def tri_state_bool(c) -> Column:
    """D5: 'true' -> true, 'false'/'unselect' -> false, null stays null; booleans pass."""
    x = col_of(c).cast("string")
    return (
        F.when(x == "true", F.lit(True))
        .when(x.isin("false", "unselect"), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def bool_code(c) -> Column:
    """Boolean or its text -> 1/0; missing or unrecognised -> -1."""
    return F.coalesce(col_of(c).try_cast("boolean").cast("int"), F.lit(-1))


def clean_floor_text(c) -> Column:
    """null/'unselect' -> null; trim; trailing '+' removed ('30+' -> 30.0); else number or null."""
    s = F.trim(col_of(c).cast("string"))
    stripped = F.when(s.endswith("+"), F.regexp_replace(s, r"\+", "")).otherwise(s)
    return F.when(s.isNull() | (s == "unselect"), F.lit(None).cast("double")).otherwise(to_number(stripped))


def clean_unit_per_floor(c) -> Column:
    """null/'unselect' -> null; 'more_than_8' -> 9.0; else number or null."""
    s = F.trim(col_of(c).cast("string"))
    return (
        F.when(s.isNull() | (s == "unselect"), F.lit(None).cast("double"))
        .when(s == "more_than_8", F.lit(9.0))
        .otherwise(to_number(s))
    )


def clamp_negative(c) -> Column:
    """Negatives -> 0, null stays null (unlike greatest, which would turn null into 0)."""
    x = col_of(c)
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def total_credit(rent, deposit) -> Column:
    """(deposit + rent*100/3) * 6; either negative -> 0.0."""
    r, c = col_of(rent), col_of(deposit)
    return F.when((r < 0) | (c < 0), F.lit(0.0)).otherwise((c + (r * 100) / 3) * 6)


def building_age_years(construction_year, reference_year: int = 1404, pre_1370_labels=()) -> Column:
    """Reference year minus the construction year after digit normalisation.

    ``pre_1370_labels`` lists texts meaning "before 1370" (after digit normalisation) that
    count as 1370. The default (empty) keeps such text unparsed -> null.
    """
    y = persian_to_ascii(construction_year)
    if pre_1370_labels:
        y = F.when(y.isin(*pre_1370_labels), F.lit("1370")).otherwise(y)
    return F.lit(float(reference_year)) - to_number(y)


def format_money(c, suffix: str = " IRR") -> Column:
    """>=1e12 'T', >=1e9 'B' (2 decimals), >=1e6 'M' (1 decimal), else 0 decimals."""
    v = col_of(c)
    return (
        F.when(v >= 1e12, F.concat(F.format_number(v / 1e12, 2), F.lit("T" + suffix)))
        .when(v >= 1e9, F.concat(F.format_number(v / 1e9, 2), F.lit("B" + suffix)))
        .when(v >= 1e6, F.concat(F.format_number(v / 1e6, 1), F.lit("M" + suffix)))
        .otherwise(F.concat(F.format_number(v, 0), F.lit(suffix)))
    )


def percent_error(pred, actual) -> Column:
    """100*(pred-actual)/actual; 0 when actual is 0; null when actual is null."""
    p, a = col_of(pred), col_of(actual)
    return F.when(a.isNull(), F.lit(None).cast("double")).when(a == 0, F.lit(0.0)).otherwise(100.0 * (p - a) / a)


def coerce_number(c, default: float = 0.0) -> Column:
    """Lenient number with a default for null or unparsable values."""
    return F.coalesce(to_number(c), F.lit(float(default)))
