"""Canonical rows and the options of a reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

TRANSACTION = (
    "id string, booking_date date, value_date date, amount_cents bigint, currency string, direction string,"
    " counterparty_name string, counterparty_iban string, counterparty_bic string, reference string,"
    " bank_transaction_id string, source_format string, is_reversal boolean, raw string"
)
INVOICE = (
    "id string, invoice_number string, amount_cents bigint, currency string, issue_date date, due_date date,"
    " status string, customer_name string, customer_email string, customer_iban string,"
    " metadata map<string,string>, remaining_cents bigint, reason string"
)
INVOICE_STATUSES = ("DRAFT", "OPEN", "PAID", "VOID", "UNCOLLECTIBLE")


@dataclass(frozen=True)
class MatcherOptions:
    """``None`` means not given; what follows from that is in the properties."""

    date_tolerance_days: int | None = None
    fee_tolerance_cents: int | None = None
    fee_tolerance_percentage: float | None = None
    fee_tolerance_percent: float | None = None

    @property
    def days(self) -> int:
        return 2 if self.date_tolerance_days is None else self.date_tolerance_days

    @property
    def fee_cents(self) -> int:
        if self.fee_tolerance_cents is not None:
            return self.fee_tolerance_cents
        return 2500 if self.fee_tolerance_percentage is None else 0

    @property
    def fee_percent(self) -> float:
        given = (self.fee_tolerance_percentage, self.fee_tolerance_percent, 0.02)
        return float(next(x for x in given if x is not None))
