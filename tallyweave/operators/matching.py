"""Stages that propose matches between transactions and invoices.

Every stage is an equi-join on derived keys with native residual predicates; text similarity runs only on pairs that
passed all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy, text
from ..functions.dates import nearest_days, window_bucket, window_buckets
from ..functions.money import format_cents
from ..schemas import MatcherOptions

TX = ("tx_ord", "tx_id", "tx_amount", "tx_currency", "booking_date", "reference", "bank_transaction_id", "counterparty_name", "counterparty_iban", "source_format")
INV = ("inv_ord", "invoice_id", "invoice_number", "invoice_amount", "invoice_currency", "issue_date", "due_date", "customer_name", "customer_iban", "open_cents")
RISKY = "Risky counterparty mismatch: counterparty similarity < 0.40 and differing IBAN (requires explicit --force)"
COMPANY_ONLY = "Missing invoice reference in remittance: matched solely on company name"
TEXTS = "array<string>"


def incoming(transactions: DataFrame) -> DataFrame:
    """Incoming transactions, the first of each id."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("tx_ord"))
    return transactions.where("direction = 'INCOMING'").withColumn("_n", first).where("_n = 1").drop("_n")


def transaction_side(transactions: DataFrame) -> DataFrame:
    return incoming(transactions).select("tx_ord", F.col("id").alias("tx_id"), F.col("amount_cents").alias("tx_amount"), F.col("currency").alias("tx_currency"), *TX[4:])


def invoice_side(invoices: DataFrame) -> DataFrame:
    """Open invoices."""
    rest = F.coalesce("remaining_cents", "amount_cents").alias("open_cents")
    return invoices.where("status = 'OPEN'").select("inv_ord", F.col("id").alias("invoice_id"), "invoice_number", F.col("amount_cents").alias("invoice_amount"), F.col("currency").alias("invoice_currency"), *INV[5:-1], rest)


def reference_index(open_invoices: DataFrame) -> DataFrame:
    """``(key, n_ids, invoice)`` of all open invoices; keys of several ids are ambiguous."""
    keys = F.array_distinct(F.concat(text.invoice_keys(F.col("invoice_number")), text.invoice_keys(F.col("invoice_id"))))
    spread = open_invoices.select(F.explode(keys).alias("key"), F.struct(*INV).alias("invoice"))
    return spread.groupBy("key").agg(F.countDistinct("invoice.invoice_id").alias("n_ids"), F.min("invoice").alias("invoice"))


def keyed_pairs(txs: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs that share an unambiguous key and the currency, with the place of the first such key."""
    keys = txs.select("*", F.posexplode(text.reference_keys(F.col("bank_transaction_id"), F.col("reference"))).alias("key_ord", "key"))
    pairs = keys.join(index.where("n_ids = 1").select("key", "invoice.*"), "key").where("tx_currency = invoice_currency").drop("key")
    first = F.row_number().over(Window.partitionBy("tx_ord", "invoice_id").orderBy("key_ord"))
    return pairs.withColumn("_n", first).where("_n = 1").drop("_n").withColumn("days", nearest_days(F.col("booking_date"), F.col("issue_date"), F.col("due_date")))


def within_fee(amount: Column, base: Column, options: MatcherOptions) -> Column:
    """Is what lacks on ``base`` within the tolerance in cents or in percent?"""
    by_cents = (base - amount <= options.fee_cents) if options.fee_cents > 0 else F.lit(False)
    if options.fee_percent <= 0:
        return by_cents
    return by_cents | (amount >= F.floor(base.cast("double") * F.lit(1.0 - options.fee_percent)))


def exact_edges(pairs: DataFrame, options: MatcherOptions) -> DataFrame:
    return pairs.where((F.col("tx_amount") == F.col("invoice_amount")) & (F.col("days") <= options.days))


def partial_edges(pairs: DataFrame, options: MatcherOptions) -> DataFrame:
    gateway = (F.coalesce("source_format", F.lit("")) == "stripe") & ~F.coalesce("reference", F.lit("")).rlike("(?i)partial")
    short = (F.col("tx_amount") < F.col("open_cents")) & ~within_fee(F.col("tx_amount"), F.col("open_cents"), options)
    return pairs.where(short & ~gateway & (F.col("days") <= options.days + 3))


def _with_checks(pairs: DataFrame) -> DataFrame:
    """Overlap of tokens, equality of IBANs and names, exact references."""
    c = F.col
    party, customer = text.clean_company(F.coalesce(c("counterparty_name"), F.lit(""))), text.clean_company(F.coalesce(c("customer_name"), F.lit("")))
    same = (F.length(party) >= 3) & (F.length(customer) >= 3) & (F.contains(party, customer) | F.contains(customer, party))
    iban = F.coalesce((text.filled(c("counterparty_iban")).isNotNull()) & (text.filled(c("customer_iban")).isNotNull()) & (text.plain_iban(c("counterparty_iban")) == text.plain_iban(c("customer_iban"))), F.lit(False))
    return pairs.withColumns({"same_iban": iban, "same_name": same, "named": text.has_exact_reference(c("reference"), c("bank_transaction_id"), c("invoice_number"), c("invoice_id"))})


def _scored(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs that score ``least`` or more, by the texts that ``with_tokens`` prepares once for each payment and invoice."""
    if "tx_text" not in pairs.columns:
        pairs = pairs.withColumn("tx_text", _tx_text()).withColumn("inv_text", _inv_text())
    out = fuzzy.scored_rows(pairs.drop("tx_tokens", "inv_tokens", "bank_transaction_id", "customer_iban", "counterparty_iban"), least)
    risky = (F.col("s.company") < F.lit(0.40)) & ~F.col("same_iban") & ~text.has_exact_number(F.col("reference"), F.col("invoice_number"))
    return out.withColumn("risky", risky)


def _edge(df: DataFrame, score: Column, level: str, status: Column, notes: Column, fee: Column | None = None, force: Column | None = None, rank: Column | None = None) -> DataFrame:
    return df.select(
        "tx_ord", "tx_id", "tx_amount", "tx_currency", "inv_ord", "invoice_id", "invoice_number", "invoice_amount", "invoice_currency",
        score.cast("double").alias("confidence"), F.lit(level).alias("level"), status.alias("status"), notes.cast(TEXTS).alias("discrepancies"),
        (F.lit(None) if fee is None else fee).cast("bigint").alias("fee_cents"), (F.lit(None) if force is None else F.when(force, True)).cast("boolean").alias("requires_force"),
        (F.struct(F.lit(0).alias("kind"), F.col("inv_ord").alias("a"), F.lit(0).cast("bigint").alias("b")) if rank is None else rank).alias("pool_ord"),
    )


def _dated(txs: DataFrame, invoices: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a stretch of days to join on: a pair whose dates are within ``reach`` meets in exactly one.  An
    amount that very many share is then no product of all its payments and invoices."""
    spans = F.explode(window_buckets(reach, F.col("issue_date"), F.col("due_date")))
    return txs.withColumn("tx_span", window_bucket(F.col("booking_date"), reach)), invoices.withColumn("inv_span", spans)


def bucket_edges(txs: DataFrame, invoices: DataFrame, options: MatcherOptions) -> DataFrame:
    """Pairs of equal currency and amount: exact reference, then equal IBAN or name, then similar text."""
    txs, invoices = _dated(txs, invoices, options.days + 3)
    same = (txs["tx_currency"] == invoices["invoice_currency"]) & (txs["tx_amount"] == invoices["invoice_amount"]) & (txs["tx_span"] == invoices["inv_span"])
    pairs = txs.join(invoices, same).drop("tx_span", "inv_span").withColumn("days", nearest_days(F.col("booking_date"), F.col("issue_date"), F.col("due_date")))
    pairs = _with_checks(pairs.where(F.col("days") <= options.days + 3))
    near = F.col("days") <= options.days
    named, metric = near & F.col("named"), near & ~F.col("named") & (F.col("same_iban") | F.col("same_name"))
    how = F.when(F.col("same_iban"), "Matched via counterparty IBAN and exact amount").otherwise("Matched via counterparty name and exact amount")
    exact = _edge(pairs.where(named), F.lit(1.0), "EXACT_REFERENCE", F.lit("MATCHED"), F.array())
    metrics = _edge(pairs.where(metric), F.lit(0.98), "EXACT_METRICS", F.lit("MATCHED"), F.array(how))
    rest = pairs.where(~(near & (F.col("named") | F.col("same_iban") | F.col("same_name"))) & F.arrays_overlap("tx_tokens", "inv_tokens"))
    rest = _scored(rest, 0.70)
    score, sure = F.col("s.score"), F.col("s.has_invoice_reference")
    status = F.when(sure & ~F.col("risky") & (score >= F.lit(0.95)), "MATCHED").otherwise("REVIEW_NEEDED")
    notes = F.array_compact(F.array(F.coalesce("s.reason", F.lit("High textual similarity on remittance")), F.when(~sure, COMPANY_ONLY), F.when(F.col("risky"), RISKY)))
    confidence = F.when(sure, fuzzy.round_cents(score)).otherwise(F.least(F.lit(0.70), score))
    return exact.unionByName(metrics).unionByName(_edge(rest, confidence, "FUZZY_REFERENCE", status, notes, force=F.col("risky")))


def _fee_edges(pairs: DataFrame, options: MatcherOptions, rank: Column) -> DataFrame:
    lacking = F.col("invoice_amount") - F.col("tx_amount")
    ok = (lacking > 0) & within_fee(F.col("tx_amount"), F.col("invoice_amount"), options) & (F.col("days") <= options.days + 2)
    scored = _scored(_with_checks(pairs.where(ok)), 0.65)
    note = F.concat(F.lit("Amount discrepancy of "), format_cents(lacking, F.col("tx_currency")), F.lit(" within fee tolerance ("), F.coalesce("s.reason", F.lit("reference matched")), F.lit(")"))
    notes = F.array_compact(F.array(note, F.when(F.col("risky"), RISKY)))
    return _edge(scored, fuzzy.round_cents(F.col("s.score") * F.lit(0.9)), "FEE_TOLERANCE", F.lit("REVIEW_NEEDED"), notes, lacking, F.col("risky"), rank)


def direct_fee_edges(pairs: DataFrame, options: MatcherOptions) -> DataFrame:
    """Short payments that name their invoice."""
    rank = F.struct(F.lit(1).alias("kind"), F.col("key_ord").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    return _fee_edges(pairs, options, rank)


def amount_range_pairs(txs: DataFrame, invoices: DataFrame, options: MatcherOptions) -> DataFrame:
    """Pairs whose invoice exceeds the payment by no more than the tolerance, in one currency and within the window.

    Amounts fall into bins as wide as the tolerance at their size: steps of the cents tolerance below the point where
    the percentage takes over, and a geometric scale above.  A payment looks into the few bins its range spans, so the
    range becomes an equi-join with a residual."""
    percent, cents = options.fee_percent, max(options.fee_cents, 1)
    growth = math.log(1 / (1 - percent)) if 0 < percent < 1 else 0.0
    turn = int(cents / (1 / (1 - percent) - 1)) if growth else 0
    flat_bins = turn // cents + 1

    def bin_of(amount: Column) -> Column:
        flat = F.floor(amount / F.lit(cents))
        if not growth:
            return flat
        return F.when(amount < turn, F.least(flat, F.lit(flat_bins))).otherwise(F.lit(flat_bins) + F.floor(F.ln(F.greatest(amount, F.lit(1)) / F.lit(float(max(turn, 1)))) / F.lit(growth)))

    amount = F.col("tx_amount")
    by_percent = F.ceil(amount.cast("double") / F.lit(1.0 - percent)) - amount if growth else F.lit(options.fee_cents)
    top = amount + F.greatest(F.lit(options.fee_cents), by_percent)
    # One bin more on either side makes up for rounding of logarithms.
    reach = F.sequence(bin_of(amount) - 1, bin_of(top) + 1)
    txs, invoices = _dated(txs, invoices, options.days + 2)
    spread = txs.withColumn("top", top).withColumn("bin", F.explode(reach))
    placed = invoices.withColumn("bin", bin_of(F.col("invoice_amount")))
    pairs = spread.join(placed, (spread["tx_currency"] == placed["invoice_currency"]) & (spread["bin"] == placed["bin"]) & (spread["tx_span"] == placed["inv_span"]))
    pairs = pairs.where("invoice_amount > tx_amount and invoice_amount <= top").drop("bin", "top", "tx_span", "inv_span")
    pairs = pairs.withColumn("days", nearest_days(F.col("booking_date"), F.col("issue_date"), F.col("due_date")))
    return pairs.where(F.col("days") <= options.days + 2)


def range_fee_edges(txs: DataFrame, invoices: DataFrame, options: MatcherOptions) -> DataFrame:
    """Short payments that share a token with an invoice in range."""
    pairs = amount_range_pairs(txs, invoices, options).where(F.arrays_overlap("tx_tokens", "inv_tokens"))
    rank = F.struct(F.lit(1).alias("kind"), F.col("invoice_amount").alias("a"), F.col("inv_ord").alias("b"))
    return _fee_edges(pairs, options, rank)


def _tx_text() -> Column:
    return fuzzy.payment_text(F.col("reference"), F.col("counterparty_name"))


def _inv_text() -> Column:
    return fuzzy.invoice_text(F.col("invoice_number"), F.col("customer_name"))


def with_tokens(txs: DataFrame, invoices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with their tokens and with what a score needs of their texts."""
    c = F.col
    return (
        txs.withColumns({"tx_tokens": text.transaction_tokens(c("reference"), c("counterparty_name"), c("bank_transaction_id")), "tx_text": _tx_text()}),
        invoices.withColumns({"inv_tokens": text.invoice_tokens(c("invoice_number"), c("invoice_id"), c("customer_name")), "inv_text": _inv_text()}),
    )


def prune(pool: DataFrame) -> DataFrame:
    """Candidates of a transaction within 0.05 of its best."""
    best = F.max("confidence").over(Window.partitionBy("tx_ord"))
    return pool.withColumn("_best", best).where(F.col("confidence") >= F.col("_best") - F.lit(0.05)).drop("_best")
