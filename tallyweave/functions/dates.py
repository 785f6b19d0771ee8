"""Dates as banks write them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trim

INVALID = "InvalidDateError"
#: Two-digit years from this on belong to the last century.
PIVOT = 70


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date of three strings of digits, or null if the calendar has none in years 1000 to 9999."""
    y = year.try_cast("int")
    made = F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.when(y.between(1000, 9999), made)


def parse_bank_date(raw: Column, locale: str = "EU") -> Column:
    """``struct(date, error)``; ``locale`` US reads ambiguous slashes month first."""
    found = let(trim(F.coalesce(raw.cast("string"), F.lit(""))), lambda text: _read(text, locale))
    return let(found, lambda d: F.struct(d.alias("date"), F.when(d.isNull(), INVALID).alias("error")))


def _read(text: Column, locale: str) -> Column:
    pick = lambda pattern, group: F.regexp_extract(text, pattern, group)
    full = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    short, iso = r"^(\d{2})(\d{2})(\d{2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    dotted, year_first = r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})", r"^(\d{4})/(\d{1,2})/(\d{1,2})"
    slashed = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})"
    century = F.when(pick(short, 1).try_cast("int") >= PIVOT, "19").otherwise("20")
    one, two = pick(slashed, 1), pick(slashed, 2)
    month_first = F.when(one.try_cast("int") > 12, False).when(two.try_cast("int") > 12, True).otherwise(locale == "US")
    by_slash = F.when(month_first, _date(full(pick(slashed, 3)), one, two)).otherwise(_date(full(pick(slashed, 3)), two, one))
    spelled = F.coalesce(*[F.try_to_date(text, p) for p in ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")])
    return (
        F.when(text.rlike(short), _date(F.concat(century, pick(short, 1)), pick(short, 2), pick(short, 3)))
        .when(text.rlike(iso), _date(pick(iso, 1), pick(iso, 2), pick(iso, 3)))
        .when(text.rlike(dotted), _date(full(pick(dotted, 3)), pick(dotted, 2), pick(dotted, 1)))
        .when(text.rlike(year_first), _date(pick(year_first, 1), pick(year_first, 2), pick(year_first, 3)))
        .when(text.rlike(slashed), by_slash)
        .otherwise(spelled)
    )


def day_difference(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def nearest_days(booking: Column, issue: Column, due: Column) -> Column:
    """Days between a booking and the nearer of an invoice's dates."""
    return F.least(day_difference(booking, issue), day_difference(booking, due))


def window_bucket(day: Column, reach: int) -> Column:
    """A stretch of days as long as the window on both sides of a date."""
    return F.floor(F.unix_date(day) / F.lit(2 * reach + 1))


def window_buckets(reach: int, *days: Column) -> Column:
    """The stretches that hold a date within ``reach`` of one of ``days``, each once."""
    width = F.lit(2 * reach + 1)
    spans = [F.sequence(F.floor((F.unix_date(d) - reach) / width), F.floor((F.unix_date(d) + reach) / width)) for d in days]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*spans))))
