"""Date parsing and time arithmetic on columns. Bad input gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted years of compact dates.
FIRST_YEAR, LAST_YEAR = 1900, 2030


def compact_date(value: Column) -> Column:
    """YYYYMMDD held as text or number (`20230115`, `20230115.0`) to a date.

    Cut apart and cast rather than parsed by a pattern: a failed pattern costs an exception per row.
    """
    whole = F.trim(value.cast("string")).try_cast("double").try_cast("bigint").cast("string")
    iso = F.regexp_replace(whole, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    year = F.substring(iso, 1, 4).try_cast("int")
    return F.when((F.length(iso) == 10) & year.between(FIRST_YEAR, LAST_YEAR), iso.try_cast("date"))


def portal_date(value: Column) -> Column:
    """`1/15/2023`, `2023-01-15` or `1/15/23` to a date.

    Two-digit years 69-99 belong to the 1900s.
    """
    iso = F.regexp_replace(value, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2")
    iso = F.regexp_replace(iso, r"^(\d{1,2})/(\d{1,2})/(69|[7-9]\d)$", "19$3-$1-$2")
    iso = F.regexp_replace(iso, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", "20$3-$1-$2")
    return F.when(iso.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), iso.try_cast("date"))


def decay_weight(when: Column, base: Column) -> Column:
    """Weight of an edge by its age after `base`: 1 / (1 + days / 365)."""
    return F.lit(1.0) / (F.lit(1.0) + F.datediff(when, base) / F.lit(365.0))


def micros(ts: Column) -> Column:
    """Timestamp or date as microseconds, for RANGE frames."""
    return F.unix_micros(ts.cast("timestamp"))


MICROS_PER_DAY = 86_400_000_000
