"""Years from volume ids, dates and free text, and their corrections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column, kind: str = "bigint") -> Column:
    """A number, null where c isn't one."""
    return c.try_cast(kind)


def volume_year(volume: Column, century: int = 1800) -> Column:
    """1821 from 'berlin_21'."""
    return F.lit(century) + number(F.nullif(F.regexp_extract(volume, r"(\d{2})", 1), F.lit("")))


def year_in(text: Column) -> Column:
    """The first four digits in a row."""
    return number(F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit("")))


def lenient_year(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """The year of a date, null where there is none."""
    return F.year(F.try_to_date(text, pattern))


def era(year: Column, first: int = 1800, span: int = 10) -> Column:
    """1 for the first ``span`` years from ``first``."""
    return F.floor((year - first) / span).cast("int") + 1


def step_year(year: Column, layers: list[int], beyond: bool = True) -> Column:
    """The largest layer at most year; before the first one the first; beyond: also after the last."""
    out = F.lit(layers[0])
    for y in layers[1:]:
        out = F.when(year >= y, y).otherwise(out)
    return F.when(year.isNull(), None).otherwise(out) if beyond else F.when(year <= layers[-1] + 2, out)


def period(school: Column, year: Column, moved: str, at: int) -> Column:
    """school, in two periods where it moved: the name gets '_early' before the year ``at``."""
    return F.when((school == moved) & (year < at), F.concat(school, F.lit("_early"))).otherwise(school)


def corrected_year(year: Column, page_year: Column, strict: Column, slack: int = 1) -> Column:
    """The read year if it is near that of the page, else the page's; strict: the page's wherever it is known."""
    far = F.abs(year - page_year) > slack
    return F.when(strict & page_year.isNotNull(), page_year).when(year.isNull() | far, F.coalesce(page_year, year)).otherwise(year)


def checked_year(year: Column, helper: Column, slack: int = 2, exceptions: Column | None = None) -> Column:
    """year where it is within ``slack`` of helper or on an exception, else null (to be filled)."""
    ok = F.abs(year - helper) <= slack
    return F.when(ok if exceptions is None else ok | exceptions, year)
