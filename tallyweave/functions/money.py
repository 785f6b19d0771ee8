"""Amounts in minor units, as Column expressions in exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trim

INVALID, AMBIGUOUS, TOO_LARGE = "InvalidAmountError", "AmbiguousAmountError", "AmountOutOfRangeError"
LARGEST = 2**53 - 1


def parse_amount(raw: Column, direction: str | None = None, thousands_separator: str | None = None) -> Column:
    """``struct(amount_cents, direction, error)`` of a bank's way to write an amount.

    The last of two kinds of separator is the decimal one; a single comma is decimal before one or two digits; several
    dots part thousands; one dot before exactly three digits is ambiguous unless ``thousands_separator`` is a dot.
    More than two decimals round half up on the third."""
    text = trim(F.coalesce(raw.cast("string"), F.lit("")))
    dotted = thousands_separator == "."
    with_number = lambda t, body: let(_number(body, dotted), lambda number: _amount(t, body, number, direction, dotted))
    return let(text, lambda t: let(F.regexp_replace(t, "[^0-9.,]", ""), lambda body: with_number(t, body)))


def _number(body: Column, dotted: bool) -> Column:
    """Digits with a dot before the decimals."""
    dots, commas = F.length(F.regexp_replace(body, "[^.]", "")), F.length(F.regexp_replace(body, "[^,]", ""))
    last_dot, last_comma = F.length(body) - F.instr(F.reverse(body), "."), F.length(body) - F.instr(F.reverse(body), ",")
    after = F.substring_index(body, ",", -1)
    lone = F.substring_index(body, ".", -1)
    both = (dots > 0) & (commas > 0)
    drop = lambda *marks: F.regexp_replace(body, "[" + "".join(marks) + "]", "")
    return (
        F.when(both & (last_comma > last_dot), F.replace(F.regexp_replace(body, "[.]|,(?=.*,)", ""), F.lit(","), F.lit(".")))
        .when(both, F.regexp_replace(body, ",|[.](?=.*[.])", ""))
        .when((commas == 1) & (F.length(after) <= 2), F.regexp_replace(body, ",", "."))
        .when(commas > 0, drop(","))
        .when((dots > 1) | ((dots == 1) & F.lit(dotted) & (F.length(lone) == 3)), drop("."))
        .otherwise(body)
    )


def _amount(text: Column, body: Column, number: Column, direction: str | None, dotted: bool) -> Column:
    negative = text.rlike(r"^\(.*\)$") | F.contains(text, F.lit("-"))
    ambiguous = F.lit(False) if dotted else body.rlike(r"^\d*\.\d{3}$")
    whole = F.regexp_extract(number, r"^(\d*)", 1)
    part = F.rpad(F.regexp_extract(number, r"^\d*\.(\d*)", 1), 3, "0")
    as_int = lambda c: F.coalesce(F.when(F.length(c) <= 30, c).try_cast("decimal(38,0)"), F.lit(0))
    way = F.lit(direction) if direction else F.when(negative, "OUTGOING").otherwise("INCOMING")

    def checked(whole: Column, cents: Column) -> Column:
        error = F.when(~body.rlike(r"\d"), INVALID).when(ambiguous, AMBIGUOUS).when((F.length(whole) > 30) | (cents > LARGEST), TOO_LARGE)
        return let(error, lambda e: F.struct(F.when(e.isNull(), cents.try_cast("bigint")).alias("amount_cents"), F.when(e.isNull(), way).alias("direction"), e.alias("error")))

    cents = lambda w, p: as_int(w) * 100 + as_int(F.substring(p, 1, 2)) + F.when(F.substring(p, 3, 1) >= "5", 1).otherwise(0)
    return let(whole, lambda w: let(part, lambda p: let(cents(w, p), lambda c: checked(w, c))))


def signed_cents(parsed: Column) -> Column:
    """The amount with its sign: outgoing is negative."""
    return F.when(parsed["direction"] == "OUTGOING", -parsed["amount_cents"]).otherwise(parsed["amount_cents"])


def format_cents(cents: Column, currency: Column) -> Column:
    """``1,250.50 EUR``, from integers alone."""
    size = F.abs(cents)
    sign = F.when(cents < 0, "-").otherwise("")
    return F.concat(sign, F.format_number((size - size % 100) / 100, 0), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"), F.lit(" "), F.upper(currency))
