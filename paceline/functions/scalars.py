"""Scalar expressions: text cleaning, dates and seasons, bands, ratios, intervals, keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, where body uses it so often that its code would be inlined many times."""
    return F.transform(F.array(value), body)[0]


def norm(c: Column) -> Column:
    """Trimmed text; nulls and the words none and nan are empty."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin("none", "nan"), "").otherwise(t)


def first_filled(*columns: Column) -> Column:
    """The first of several physical columns that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def parse_seconds(c: Column) -> Column:
    """Seconds of s, m:s or h:m:s; null if any part is not a number."""
    parts = F.split(F.trim(c), ":")
    last = F.try_element_at(parts, F.lit(-1)).try_cast("double")
    minute, hour = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-3))
    whole = lambda x: x.try_cast("int").cast("double")
    return (
        F.when(F.size(parts) == 1, last)
        .when(F.size(parts) == 2, whole(minute) * 60 + last)
        .when(F.size(parts) == 3, whole(hour) * 3600 + whole(minute) * 60 + last)
    )


def first_int(c: Column) -> Column:
    """The first run of digits, or null."""
    return F.nullif(F.regexp_extract(c, "([0-9]+)", 1), F.lit("")).cast("long")


def season_start(date: Column, first_month: int = 7) -> Column:
    """The year in which the season of a date began."""
    return (F.year(date) - (F.month(date) < first_month).cast("int")).cast("long")


def school_grade(season: Column, birth_year: Column) -> Column:
    return season - birth_year - 6


def stage_of_grade(grade: Column) -> Column:
    return (
        F.when(grade.isNull(), "unknown").when(grade <= 0, "excluded").when(grade <= 6, "elementary")
        .when(grade <= 9, "middle").when(grade <= 12, "high").otherwise("college")
    )


def ratio_pct(part: Column, whole: Column, otherwise: float | None = None) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(F.lit(otherwise).cast("double"))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval of a share, in percent with two places; null without cases."""
    p = successes / n
    centre = p + z * z / (2 * n)
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bottom = 1 + z * z / n
    low, high = (centre - margin) / bottom, (centre + margin) / bottom
    inside = lambda x: F.when(n > 0, F.round(100 * F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 2))
    return inside(low), inside(high)


def performance_band(percentile: Column) -> Column:
    return F.when(percentile >= 90, "top10").when(percentile >= 70, "next20").when(percentile >= 50, "next20b").otherwise("lower50")


def anon_key(c: Column, salt: str) -> Column:
    """Twelve hex digits of a salted SHA-256; values that are such keys already pass."""
    text = c.cast("string")
    hashed = F.left(F.sha2(F.concat(text, F.lit(salt)), 256), F.lit(12))
    return F.when(text.rlike("^[0-9a-f]{12}$"), text).otherwise(hashed)


def slug(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(c)), "[^\\p{L}\\p{N}]+", "-")
    return F.regexp_replace(t, "^-+|-+$", "")


def clamp_probability(p: Column, edge: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def elapsed_periods(before: Column, after: Column, by_meet: bool = False) -> Column:
    """Months between two dates; counted by meets, a later meet is at least one period on."""
    months = month_index(after) - month_index(before)
    return F.when(after > before, F.greatest(months, F.lit(1))).otherwise(0) if by_meet else F.greatest(months, F.lit(0))


def normalised_status(code: Column) -> Column:
    """FIN, DNF, PEN, ADV, DNS by tokens, tested in a fixed order; UNKNOWN otherwise."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return (
        F.when(c.contains("ADV"), "ADV").when(c.isin("PEN", "R", "DQ"), "PEN").when(c.isin("DNS",), "DNS")
        .when(c.isin("DNF", "N"), "DNF").when(c.isin("FIN", "A", ""), "FIN").otherwise("UNKNOWN")
    )


def round_class(text: Column) -> Column:
    """The class of a round; quarterfinal is tested before semifinal and final B before final."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.contains("score"), "score").when(t.contains("quarter"), "quarterfinal").when(t.contains("semi"), "semifinal")
        .when(t.rlike("final[ _-]?b"), "final_b").when(t.contains("final"), "final").when(t.contains("heat"), "heat")
        .otherwise("other")
    )


def padded(n: Column) -> Column:
    """At least four digits, sortable as text up to 9,999; larger numbers keep all their digits."""
    text = F.when(n > 0, n.cast("string")).otherwise("0")
    return F.call_function("lpad", text, F.greatest(F.lit(4), F.length(text)), F.lit("0"))
