"""What the command line and the HTTP service share: texts and files in, plain reports out."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MatcherOptions
from ..sources.statements import FORMAT_NAMES, FORMATS, detect_format, parse_statements, ParseOptions, Statement
from .reconcile import Report, numbered, reconcile

CAMEL = {"amount_cents": "amountCents", "booking_date": "bookingDate", "value_date": "valueDate", "counterparty_name": "counterpartyName", "counterparty_iban": "counterpartyIban", "counterparty_bic": "counterpartyBic", "bank_transaction_id": "bankTransactionId", "source_format": "sourceFormat", "is_reversal": "isReversal", "invoice_number": "invoiceNumber", "issue_date": "issueDate", "due_date": "dueDate", "customer_name": "customerName", "customer_email": "customerEmail", "customer_iban": "customerIban", "remaining_cents": "remainingCents", "matched_cents": "matchedCents", "requires_force": "requiresForce"}


def parse_mapping(text: str | None) -> dict[str, str]:
    """``a=b,c=d`` to a mapping."""
    pairs = (p.split("=", 1) for p in (text or "").split(",") if "=" in p)
    return {k.strip(): v.strip() for k, v in pairs}


def from_text(spark: SparkSession, content: str, name: str = "input") -> DataFrame:
    return spark.createDataFrame([(name, content)], "file string, content string")


def parse_text(spark: SparkSession, content: str, options: ParseOptions = ParseOptions()) -> tuple[str, Statement]:
    """The format of one statement and its rows."""
    files = from_text(spark, content)
    chosen = options.format or files.select(detect_format(F.col("content"))).first()[0]
    if not chosen:
        raise ValueError(f"No parser detects this statement; known: {', '.join(FORMATS)}")
    given = ParseOptions(chosen, options.column_mapping, options.default_currency)
    return chosen, parse_statements(files, given)


def plain(row: object) -> object:
    """A row as JSON with the names of the interchange format; missing fields are left out."""
    if hasattr(row, "asDict"):
        row = row.asDict()
    if isinstance(row, dict):
        return {CAMEL.get(k, k): plain(v) for k, v in row.items() if v is not None and k not in ("file", "position", "tx_ord", "inv_ord")}
    if isinstance(row, (list, tuple)):
        return [plain(x) for x in row]
    return row.isoformat() if hasattr(row, "isoformat") else row


def parsed_report(name: str, statement: Statement, with_rejected: bool) -> dict:
    rows = [plain(r) for r in statement.transactions.orderBy("position").toLocalIterator()]
    out = {"parserId": name, "parserName": FORMAT_NAMES[name], "count": len(rows), "transactions": rows}
    if with_rejected:
        out["rejectedRows"] = [plain(r) for r in statement.rejected.orderBy("file", "index").toLocalIterator()]
    return out


def inflow_outflow(transactions: DataFrame) -> DataFrame:
    cents, way = F.col("amount_cents"), F.col("direction")
    total = lambda w: F.coalesce(F.sum(F.when(way == w, cents)), F.lit(0))
    return transactions.agg(total("INCOMING").alias("inflow_cents"), total("OUTGOING").alias("outflow_cents"))


def match_statement(statement: Statement, invoices: DataFrame, options: MatcherOptions) -> Report:
    """Reconcile a parsed statement; the order of its files and rows is the order of payments."""
    return reconcile(numbered(statement.transactions.drop("file"), "position").drop("position"), invoices, options)


def full_report(report: Report, name: str = "unknown-statement") -> dict:
    """The report as one JSON value, for batches that fit a reply."""
    rename = {"confidence": "confidenceScore", "fee_cents": "feeDeductionCents"}

    def match(row) -> dict:
        out = plain({rename.get(k, k): v for k, v in row.asDict().items() if k != "match_no"})
        if "feeDeductionCents" in out:
            out["inferredFeeCents"] = out["feeDeductionCents"]
        return out

    counts = report.summary().first().asDict()
    names = {"matched_count": "matchedCount", "review_needed_count": "reviewNeededCount", "unmatched_count": "unmatchedCount", "total_transactions": "totalTransactions", "total_invoices": "totalInvoices"}
    totals = {r["currency"]: {"matchedAmountCents": r["matched_cents"], "unmatchedAmountCents": r["unmatched_cents"], "feeDeductionCents": r["fee_cents"]} for r in report.totals_by_currency().collect()}
    return {
        "reconciliationId": str(uuid.uuid4()), "createdAt": datetime.now(timezone.utc).isoformat(), "statementFile": name, **{names[k]: v for k, v in counts.items()}, "totalsByCurrency": totals,
        "matches": [match(r) for r in report.matches.orderBy("match_no").toLocalIterator()],
        "unmatchedInvoices": [plain(r) for r in report.unmatched_invoices.orderBy("inv_ord").toLocalIterator()], "skippedInvoices": [plain(r) for r in report.skipped_invoices.orderBy("inv_ord").toLocalIterator()],
    }


def dumps(value: object, pretty: bool = False) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2 if pretty else None)
