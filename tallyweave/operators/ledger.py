"""Double-entry postings from matches, and their balance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Accounts:
    bank: str = "assets:bank"
    receivable: str = "assets:accounts_receivable"
    fees: str = "expenses:bank_fees"
    suspense: str = "assets:suspense"


def _line(account: str, direction: str, cents: Column, currency: Column) -> Column:
    return F.struct(F.lit(account).alias("account_id"), F.lit(direction).alias("direction"), cents.cast("bigint").alias("amount_cents"), currency.alias("currency"))


def _posted(matches: DataFrame) -> DataFrame:
    """Rows that post: all with an invoice that are not unmatched."""
    return matches.where("status <> 'UNMATCHED' and invoice is not null")


def _fee() -> Column:
    return F.coalesce("fee_cents", F.lit(0))


def _exploded(rows: DataFrame, lines: Column, *keep: str) -> DataFrame:
    spread = rows.select(*keep, F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("line_no", "line"))
    return spread.select(*keep, "line_no", "line.*")


def match_postings(matches: DataFrame, accounts: Accounts = Accounts()) -> DataFrame:
    """``(match_no, tx_id, line_no, account_id, direction, amount_cents, currency)``: bank net and fee against receivable."""
    net, currency = F.col("transaction.amount_cents"), F.col("transaction.currency")
    rows = _posted(matches).where(net + _fee() > 0).withColumn("tx_id", F.col("transaction.id"))
    lines = F.array(
        _line(accounts.bank, "DEBIT", net, currency),
        F.when(_fee() > 0, _line(accounts.fees, "DEBIT", _fee(), currency)),
        _line(accounts.receivable, "CREDIT", net + _fee(), currency),
    )
    return _exploded(rows, lines, "match_no", "tx_id")


def suspense_postings(matches: DataFrame, accounts: Accounts = Accounts()) -> DataFrame:
    """Two events a match, over a suspense account: the bank clears, the invoice settles."""
    bank, due, currency = F.col("transaction.amount_cents"), F.col("invoice.amount_cents"), F.col("transaction.currency")
    rows = _posted(matches).withColumn("posted_at", F.coalesce("transaction.booking_date", "invoice.issue_date", F.current_date()))
    clearing = F.array(_line(accounts.bank, "DEBIT", bank, currency), _line(accounts.suspense, "CREDIT", bank, currency))
    settlement = F.array(
        _line(accounts.suspense, "DEBIT", due - _fee(), currency),
        F.when(_fee() > 0, _line(accounts.fees, "DEBIT", _fee(), currency)),
        _line(accounts.receivable, "CREDIT", due, currency),
    )
    event = lambda name, lines: F.struct(F.concat(F.col("transaction.id"), F.lit(f"-{name}")).alias("event_id"), lines.alias("lines"))
    events = rows.select("match_no", "posted_at", F.explode(F.array(event("clearing", clearing), event("settlement", settlement))).alias("e"))
    return _exploded(events.select("match_no", "posted_at", "e.event_id", "e.lines"), F.col("lines"), "match_no", "posted_at", "event_id")


def imbalance(postings: DataFrame, *by: str) -> DataFrame:
    """Debits less credits by currency (and ``by``), where they differ."""
    signed = F.when(F.col("direction") == "DEBIT", F.col("amount_cents")).otherwise(-F.col("amount_cents"))
    return postings.groupBy(*by, "currency").agg(F.sum(signed).alias("off_cents")).where("off_cents <> 0")


def is_balanced(postings: DataFrame, *by: str) -> bool:
    return imbalance(postings, *by).isEmpty()
