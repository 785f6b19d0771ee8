"""Ids that follow from a transaction's content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim


def fingerprint(iban: Column, booking_date: Column, amount_cents: Column, currency: Column, bank_ref: Column, end_to_end: Column, direction: Column) -> Column:
    """SHA-256 of the fields between bars; missing ones are empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    fields = [F.upper(trim(text(iban))), text(booking_date), text(amount_cents), F.upper(trim(text(currency))), trim(text(bank_ref)), trim(text(end_to_end)), text(direction)]
    return F.sha2(F.concat_ws("|", *fields), 256)
