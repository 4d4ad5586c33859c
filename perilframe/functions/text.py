"""Parsing and classification of third-party text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import finite_or_null

# Stop words, ordered coverage and construction patterns, storm-name pattern.
NAME_STOP_WORDS = r"\b(resort|club|villas?|inn|hotel|the|at|by|llc|inc|assn|association|hoa)\b"
COVERAGE_PATTERNS = [
    ("hurricane", r"named\s*storm|hurricane|wind|tropical|cyclone|hail"),
    ("bi", r"business\s*int|time\s*element|\bbi\b|extra\s*expense|rental\s*income|loss\s*of\s*income"),
    ("flood", r"flood|surge|water\s*damage|storm\s*water"),
    ("general", r"fire|wildfire|smoke"),
    ("general", r"property|all\s*risk|apd|building|equipment\s*breakdown"),
]
CONSTRUCTION_PATTERNS = [
    ("engineered", r"fire\s*resist|reinforced|concrete|steel|superior|modified\s*fr"),
    ("masonry", r"masonry|joisted|jm\b|cb\b|block|brick|non.?combustible"),
    ("frame", r"frame|wood|timber"),
]
TIMESHARE_PATTERN = r"timeshare|vacation\s*ownership|fractional|interval"
STORM_PATTERN = r"(?i)\b(?:hurricane|tropical\s+storm|ts\.?|typhoon)\s+([a-z]+)"
PROVENANCE_PATTERNS = [
    ("sov", r"actual|on file"),
    ("estimated", r"interim|default|approximation|fallback|pending"),
    ("modeled", r"event|pack"),
]


def number_of(x: Column) -> Column:
    """Number after stripping currency, percent, thousands separators and spaces."""
    return finite_or_null(F.regexp_replace(x.cast("string"), r"[$,%\s]", "").try_cast("double"))


def money_of(x: Column) -> Column:
    """Accounting money: parentheses mean negative."""
    t = F.regexp_replace(x.cast("string"), r"[$,)\s]", "")
    return finite_or_null(F.regexp_replace(t, r"\(", "-").try_cast("double"))


def sov_money_of(x: Column) -> Column:
    """Schedule money: negatives are unusable."""
    m = money_of(x)
    return F.when(m >= 0.0, m)


def date_of(x: Column) -> Column:
    """ISO or month/day/year text to a date; two-digit years are 20yy."""
    t = F.trim(x.cast("string"))
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    us = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})"
    part = lambda pat, i: F.regexp_extract(t, pat, i).try_cast("int")
    y = part(us, 3)
    text = (F.when(t.rlike(iso), F.format_string("%d-%02d-%02d", part(iso, 1), part(iso, 2), part(iso, 3)))
            .when(t.rlike(us), F.format_string("%d-%02d-%02d", F.when(y < 100, y + 2000).otherwise(y),
                                               part(us, 1), part(us, 2))))
    return text.try_cast("date")


def first_pattern(text: Column, patterns: list[tuple[str, str]], default: Column | None = None) -> Column:
    """Label of the first pattern found in lower-cased text."""
    low = F.lower(text)
    out = F
    for label, pattern in patterns:
        out = out.when(low.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(None).cast("string") if default is None else default)


def coverage_class(coverage: Column) -> Column:
    return first_pattern(coverage, COVERAGE_PATTERNS)


def coverage_kind(cls: Column) -> Column:
    return F.when(cls == "bi", "bi").when(cls.isNotNull(), "property")


def construction_class(text: Column) -> Column:
    return first_pattern(text, CONSTRUCTION_PATTERNS)


def is_timeshare(occupancy: Column) -> Column:
    return F.coalesce(F.lower(occupancy).rlike(TIMESHARE_PATTERN), F.lit(False))


def normal_name(x: Column) -> Column:
    """Comparable name: stop words and punctuation removed; null when nothing is left."""
    low = F.regexp_replace(F.lower(x.cast("string")), NAME_STOP_WORDS, " ")
    t = F.trim(F.regexp_replace(low, r"[^a-z0-9]+", " "))
    return F.when(t != "", t)


def storm_key(description: Column, year: Column) -> Column:
    """Named-storm occurrence key, null when no storm is named."""
    name = F.lower(F.regexp_extract(F.coalesce(description, F.lit("")), STORM_PATTERN, 1))
    return F.when(name != "", F.concat(F.lit("storm:"), name, F.lit(":"), year.cast("string")))


def provenance(basis: Column, calibrated: Column | None = None) -> Column:
    """Where an exported figure stands: on file, modelled, calibrated, or estimated."""
    label = first_pattern(F.coalesce(basis, F.lit("")), PROVENANCE_PATTERNS, F.lit("estimated"))
    if calibrated is None:
        return label
    return F.when((label == "modeled") & F.coalesce(calibrated, F.lit(False)), "calibrated").otherwise(label)
