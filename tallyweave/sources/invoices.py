"""Invoice lists from JSON or CSV text."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_bank_date
from ..functions.money import parse_amount
from ..functions.text import filled
from ..schemas import INVOICE, INVOICE_STATUSES
from .csv import cell, parse_csv, resolve_header

# Names by which an invoice list's columns are known.
SYNONYMS = {
    "id": ("id", "invoice_id", "invoice id", "uuid"),
    "invoice_number": ("invoice number", "number", "invoicenumber", "invoice_number", "invoice_no", "ref", "inv"),
    "amount": ("amount", "amountcents", "amount_cents", "total", "sum", "gross", "value"),
    "currency": ("currency", "ccy", "curr"),
    "issue_date": ("issue date", "issue_date", "date", "created", "created date", "invoice date", "invoicedate"),
    "due_date": ("due date", "due_date", "due", "duedate"),
    "status": ("status", "state"),
    "customer_name": ("customer name", "customer_name", "customer", "company", "client", "bill to", "name"),
    "customer_email": ("customer email", "customer_email", "email", "contact"),
    "customer_iban": ("customer iban", "customer_iban", "iban", "account"),
}
JSON_NAMES = {"id": "id", "invoiceNumber": "invoice_number", "amountCents": "amount_cents", "currency": "currency", "issueDate": "issue_date", "dueDate": "due_date", "status": "status", "customerName": "customer_name", "customerEmail": "customer_email", "customerIban": "customer_iban", "metadata": "metadata", "remainingCents": "remaining_cents", "reason": "reason"}


class InvalidInvoiceDataError(ValueError):
    def __init__(self, message: str, details: object = None):
        super().__init__(message)
        self.details = details


def _faults(row: object) -> list[str]:
    """What is wrong with one invoice of a JSON list."""
    if not isinstance(row, dict):
        return ["not an object"]
    text = lambda k, least=1: isinstance(row.get(k), str) and len(row[k]) >= least
    cents = lambda k: isinstance(row.get(k), int) and not isinstance(row[k], bool) and row[k] >= 0
    date = lambda k: isinstance(row.get(k), str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", row[k])
    out = [k for k in ("id", "invoiceNumber") if not text(k)]
    out += [k for k in ("amountCents",) if not cents(k)] + [k for k in ("remainingCents",) if k in row and not cents(k)]
    out += [k for k in ("issueDate",) if not date(k)] + [k for k in ("dueDate",) if row.get(k) is not None and not date(k)]
    out += ["currency"] if not (text("currency") and len(row["currency"]) == 3) else []
    out += ["customerName"] if not text("customerName", 0) else []
    out += ["status"] if row.get("status", "OPEN") not in INVOICE_STATUSES else []
    out += ["customerEmail"] if row.get("customerEmail") is not None and not re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", str(row["customerEmail"])) else []
    return out


def parse_invoices(spark: SparkSession, content: str) -> DataFrame:
    """Invoices of a list given as text, with ``inv_ord``: a strict JSON array, or else CSV.

    The list is one driver-side text, as it comes with a request; tables of invoices enter as DataFrames."""
    try:
        listed = json.loads(content)
    except ValueError:
        return _from_csv(spark, content)
    if not isinstance(listed, list) or any(map(_faults, listed)):
        details = {i: f for i, r in enumerate(listed) if (f := _faults(r))} if isinstance(listed, list) else "not a list"
        raise InvalidInvoiceDataError(f"Invalid invoice data: {details}", details)
    rows = [{JSON_NAMES[k]: v for k, v in r.items() if k in JSON_NAMES} | {"status": r.get("status", "OPEN"), "currency": r["currency"].upper(), "inv_ord": i} for i, r in enumerate(listed)]
    text = INVOICE.replace(" date", " string")
    names = [c.split()[0] for c in re.split(r", (?!string>)", re.sub(r"<[^>]*>", "", text))]
    df = spark.createDataFrame([tuple(r.get(n) for n in (*names, "inv_ord")) for r in rows], f"{text}, inv_ord bigint")
    return df.withColumns({d: F.to_date(d) for d in ("issue_date", "due_date")})


def _from_csv(spark: SparkSession, content: str) -> DataFrame:
    headers, rows = parse_csv(content.strip())
    if not rows:
        raise ValueError("No invoice records found in input.")
    df = spark.createDataFrame([(i, headers, r) for i, r in enumerate(rows)], "inv_ord bigint, headers array<string>, row map<string,string>")
    get = lambda k: filled(cell(F.col("row"), resolve_header(F.col("headers"), SYNONYMS[k])))
    has_amount = resolve_header(F.col("headers"), SYNONYMS["amount"]).isNotNull()
    amount = parse_amount(F.when(has_amount, F.coalesce(get("amount"), F.lit(""))).otherwise("0"))
    issue, due = parse_bank_date(get("issue_date")), parse_bank_date(get("due_date"))
    status = F.upper(F.coalesce(get("status"), F.lit("OPEN")))
    n = (F.col("inv_ord") + 1).cast("string")
    strict = lambda value, error, what: F.when(error.isNotNull(), F.raise_error(F.concat(F.lit(f"{what}: "), error)).cast("string")).otherwise(value.cast("string"))
    return df.select(
        F.coalesce(get("id"), F.concat(F.lit("inv-"), n)).alias("id"), F.coalesce(get("invoice_number"), F.concat(F.lit("INV-"), n)).alias("invoice_number"),
        strict(amount["amount_cents"], amount["error"], "amount").cast("bigint").alias("amount_cents"), F.upper(F.coalesce(get("currency"), F.lit("EUR"))).alias("currency"),
        strict(issue["date"], issue["error"], "issue date").cast("date").alias("issue_date"), F.when(get("due_date").isNotNull(), strict(due["date"], due["error"], "due date")).cast("date").alias("due_date"),
        F.when(status.isin(*INVOICE_STATUSES), status).otherwise("OPEN").alias("status"), F.coalesce(get("customer_name"), F.lit("Unknown Customer")).alias("customer_name"),
        F.when(F.contains(get("customer_email"), F.lit("@")), get("customer_email")).alias("customer_email"), get("customer_iban").alias("customer_iban"),
        F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(None).cast("bigint").alias("remaining_cents"), F.lit(None).cast("string").alias("reason"), "inv_ord",
    )


def load_invoices(spark: SparkSession, path: str) -> DataFrame:
    """Invoices of a file that Spark can read."""
    return parse_invoices(spark, spark.read.text(path, wholetext=True).first()[0])
