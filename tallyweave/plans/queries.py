"""Queries over the star schema, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, fingerprint, fuzzy, money, text
from ..operators import ledger
from ..operators import matching as m
from ..operators.assign import first_come
from ..schemas import MatcherOptions
from ..sources import invoices as invoice_lists
from ..sources import statements, synthetic
from . import views
from .reconcile import Report, annotated, reconcile

OPTIONS = MatcherOptions()
#: No tolerance for fees: what matches then, SQL can say.
STRICT = MatcherOptions(fee_tolerance_cents=0, fee_tolerance_percentage=0.0)
_reports: dict[tuple[str, str], Report] = {}


def report(spark: SparkSession, sf_dir: str) -> Report:
    """The reconciliation of the derived views; one session computes it once for a folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _reports:
        _reports.clear()
        _reports[key] = reconcile(views.transactions(spark, sf_dir), views.invoices(spark, sf_dir), OPTIONS)
    return _reports[key]


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return m.transaction_side(views.transactions(spark, sf_dir)), m.invoice_side(views.invoices(spark, sf_dir))


def normalize_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, part = (cents - cents % 100) / 100, F.lpad((cents % 100).cast("string"), 2, "0")
    us, k = F.format_number(whole, 0), F.col("o_orderkey") % 5
    eu = F.translate(us, ",", ".")
    raw = F.when(k == 0, F.concat(us, F.lit("."), part)).when(k == 1, F.concat(eu, F.lit(","), part)).when(k == 2, F.concat(F.lit("-"), us, F.lit("."), part)).when(k == 3, F.concat(F.lit("("), eu, F.lit(","), part, F.lit(")"))).otherwise(F.concat(F.lit("EUR "), eu, F.lit(","), part))
    return orders.select("o_orderkey", money.parse_amount(raw).alias("p")).select("o_orderkey", "p.amount_cents", "p.direction", money.signed_cents(F.col("p")).alias("signed_cents"), money.format_cents(F.col("p.amount_cents"), F.lit("eur")).alias("shown"))


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    form = lambda p: F.date_format(d, p)
    raw = F.when(k == 0, form("yyyy-MM-dd'T'HH:mm")).when(k == 1, form("dd.MM.yyyy")).when(k == 2, form("yyMMdd")).when(k == 3, form("dd/MM/yyyy")).otherwise(form("yyyy/MM/dd"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", dates.parse_bank_date(raw)["date"].cast("string").alias("parsed"))


def fingerprint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    print_ = fingerprint.fingerprint(F.lit(" de89370400440532013000 "), c("booking_date"), c("amount_cents"), c("currency"), c("reference"), F.lit(None), c("direction"))
    return views.transactions(spark, sf_dir).select("tx_ord", print_.alias("fingerprint"))


def dedupe_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.incoming(views.transactions(spark, sf_dir)).select("id", "tx_ord", "amount_cents")


def open_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.invoice_side(views.invoices(spark, sf_dir)).select("invoice_id", "invoice_amount", "invoice_currency")


def skipped_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = annotated(views.invoices(spark, sf_dir).where("status <> 'OPEN'"))
    return closed.select("id", "status", "reason", F.col("metadata")["reason"].alias("metadata_reason"))


def reference_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = m.reference_index(_sides(spark, sf_dir)[1])
    return index.select("key", "n_ids", F.col("invoice.invoice_id").alias("first_invoice"))


def exact_reference_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    txs, invoices = _sides(spark, sf_dir)
    return first_come(m.exact_edges(m.keyed_pairs(txs, m.reference_index(invoices)), OPTIONS)).select("tx_id", "invoice_id", "tx_amount")


def partial_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    txs, invoices = _sides(spark, sf_dir)
    pairs = m.keyed_pairs(txs, m.reference_index(invoices))
    return first_come(m.partial_edges(pairs, OPTIONS)).select("tx_id", "invoice_id", (F.col("open_cents") - F.col("tx_amount")).alias("remaining_cents"))


def amount_bucket_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal amounts after coarsening to 10,000 cents, so that buckets hold several invoices."""
    txs, invoices = _sides(spark, sf_dir)
    coarse = lambda c: F.expr(f"{c} div 10000")
    same = (coarse("tx_amount") == coarse("invoice_amount")) & (F.col("tx_currency") == F.col("invoice_currency"))
    pairs = txs.join(invoices, same).withColumn("days", dates.nearest_days(F.col("booking_date"), F.col("issue_date"), F.col("due_date")))
    return pairs.where(F.col("days") <= OPTIONS.days + 3).select("tx_ord", "invoice_id", "days")


def exact_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal amount, currency and customer name within the window, where the payment does not name the invoice."""
    found = m.bucket_edges(*m.with_tokens(*_sides(spark, sf_dir)), OPTIONS)
    return found.where("level = 'EXACT_METRICS'").select("tx_id", "invoice_id", "confidence")


def fee_range_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = m.amount_range_pairs(*_sides(spark, sf_dir), OPTIONS)
    ok = m.within_fee(F.col("tx_amount"), F.col("invoice_amount"), OPTIONS) & (F.col("days") <= OPTIONS.days + 2)
    return pairs.where(ok).select("tx_ord", "invoice_id", (F.col("invoice_amount") - F.col("tx_amount")).alias("fee_cents"))


def levenshtein_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    other = c.select((F.col("c_custkey") + 7).alias("c_custkey"), F.col("c_name").alias("other"))
    return c.join(other, "c_custkey").select("c_custkey", fuzzy.levenshtein_similarity_udf("c_name", "other").alias("similarity"))


def company_name_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.element_at(F.array(*[F.lit(x) for x in (" GmbH", ", Inc.", " Sp. z o.o.", " & Co. Ltd", "AG")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", text.clean_company(F.concat("c_name", forms)).alias("cleaned"))


def normalized_remittance(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = views.transactions(spark, sf_dir)
    return tx.select("tx_ord", text.normalize_remittance(F.concat(F.lit("SVWZ+Zahlung /EREF/ ?20"), "reference", F.lit(" Muster GmbH"))).alias("normalized"))


def invoice_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = views.transactions(spark, sf_dir)
    return tx.select("tx_ord", F.explode(text.invoice_candidates(F.col("reference"))).alias("candidate"))


def remittance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, inv = views.transactions(spark, sf_dir), views.invoices(spark, sf_dir)
    pairs = tx.join(inv.select("inv_ord", "invoice_number", "customer_name"), F.col("inv_ord") == F.col("tx_ord") + 1)
    s = fuzzy.remittance_score(F.col("reference"), F.col("counterparty_name"), F.col("invoice_number"), F.col("customer_name"))
    return pairs.select("tx_ord", s.alias("s")).select("tx_ord", "s.*")


def jaro_winkler_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/customer.parquet")
    other = p.select((F.col("c_custkey") + 3).alias("c_custkey"), F.col("c_name").alias("other"))
    return p.join(other, "c_custkey").select("c_custkey", fuzzy.jaro_winkler_udf("c_name", "other").alias("similarity"))


def reconcile_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["status", "level", "confidence", "fee_cents", "matched_cents", "remaining_cents", "requires_force"]
    return report(spark, sf_dir).matches.select(F.col("transaction.id").alias("tx_id"), F.col("invoice.id").alias("invoice_id"), *cols, F.array_join("discrepancies", " | ").alias("discrepancies"))


def unmatched_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report(spark, sf_dir).matches.where("status = 'UNMATCHED'")
    return rows.select(F.col("transaction.id").alias("tx_id"), "transaction.direction", "transaction.amount_cents")


def unmatched_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).unmatched_invoices.select("id", "status", "reason")


def totals_by_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).totals_by_currency()


def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).summary()


def confirmed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).confirmed().totals_by_currency()


def _exact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by reference alone, in the shape that postings take."""
    tx, inv = views.transactions(spark, sf_dir), views.invoices(spark, sf_dir)
    found = exact_reference_matches(spark, sf_dir)
    tx_rows = m.incoming(tx).select(F.col("id").alias("tx_id"), F.struct(*tx.columns).alias("transaction"))
    inv_rows = inv.select(F.col("id").alias("invoice_id"), F.struct(*inv.columns).alias("invoice"))
    return found.join(tx_rows, "tx_id").join(inv_rows, "invoice_id").select(F.col("transaction.tx_ord").alias("match_no"), F.lit("MATCHED").alias("status"), F.lit(None).cast("bigint").alias("fee_cents"), "transaction", "invoice")


def ledger_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.match_postings(_exact_report(spark, sf_dir)).select("tx_id", "line_no", "account_id", "direction", "amount_cents", "currency")


def suspense_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.suspense_postings(_exact_report(spark, sf_dir)).select("event_id", F.col("posted_at").cast("string").alias("posted_at"), "line_no", "account_id", "direction", "amount_cents", "currency")


def unbalanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose debits and credits differ: none, of either kind of posting."""
    found = _keyed_report(spark, sf_dir)
    one, two = ledger.match_postings(found), ledger.suspense_postings(found)
    return ledger.imbalance(one, "tx_id").withColumnRenamed("tx_id", "event_id").unionByName(ledger.imbalance(two, "event_id"))


def suspense_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each account holds after all events; partial payments leave a rest in suspense."""
    signed = F.when(F.col("direction") == "DEBIT", F.col("amount_cents")).otherwise(-F.col("amount_cents"))
    return ledger.suspense_postings(_keyed_report(spark, sf_dir)).groupBy("account_id", "currency").agg(F.sum(signed).alias("held_cents"))


def _keyed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full and partial payments by reference, in the shape that postings take."""
    tx, inv = views.transactions(spark, sf_dir), views.invoices(spark, sf_dir)
    full, part = exact_reference_matches(spark, sf_dir).select("tx_id", "invoice_id", F.lit("MATCHED").alias("status")), partial_payments(spark, sf_dir).select("tx_id", "invoice_id", F.lit("PARTIAL_MATCH").alias("status"))
    tx_rows = m.incoming(tx).select(F.col("id").alias("tx_id"), F.struct(*tx.columns).alias("transaction"))
    inv_rows = inv.select(F.col("id").alias("invoice_id"), F.struct(*inv.columns).alias("invoice"))
    # Exact payments match first and take their invoice.
    found = full.union(part.join(full.select("invoice_id"), "invoice_id", "left_anti").select("tx_id", "invoice_id", "status"))
    return found.join(tx_rows, "tx_id").join(inv_rows, "invoice_id").select(F.col("transaction.tx_ord").alias("match_no"), "status", F.lit(None).cast("bigint").alias("fee_cents"), "transaction", "invoice")


def _strict(spark: SparkSession, sf_dir: str) -> Report:
    return reconcile(views.transactions(spark, sf_dir), views.invoices(spark, sf_dir), STRICT)


def strict_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _strict(spark, sf_dir).matches.where("invoice is not null")
    return found.select(F.col("transaction.id").alias("tx_id"), F.col("invoice.id").alias("invoice_id"), "status", "level", "confidence", "matched_cents", "remaining_cents")


def strict_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments and invoices without a match."""
    r = _strict(spark, sf_dir)
    lost = r.matches.where("status = 'UNMATCHED'").select(F.col("transaction.id").alias("id"), F.col("transaction.direction").alias("what"))
    return lost.union(r.unmatched_invoices.select("id", F.coalesce("reason", F.lit("OPEN"))))


def strict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strict(spark, sf_dir).totals_by_currency()


def strict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strict(spark, sf_dir).summary()


#: Orders of one statement file.
FILE_ROWS = 500


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = views.transactions(spark, sf_dir)
    return tx.select(F.col("tx_ord").alias("i"), F.col("counterparty_name").alias("company"), F.lit("DE89370400440532013000").alias("iban"), "reference", F.lit("EUR").alias("currency"), "direction", "amount_cents", "booking_date")


def _files(lines: DataFrame, head: str, tail: str) -> DataFrame:
    """``(i, value)`` as files of a bounded number of rows."""
    body = lines.groupBy(F.floor(F.col("i") / FILE_ROWS).cast("string").alias("file")).agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("rows"))
    return body.select("file", F.concat(F.lit(head), F.array_join("rows.value", "\n"), F.lit(tail)).alias("content"))


def _statement_files(spark: SparkSession, sf_dir: str, format: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    if format == "stripe":
        plain = F.concat(F.floor(F.col("amount_cents") / 100).cast("string"), F.lit("."), F.lpad((F.col("amount_cents") % 100).cast("string"), 2, "0"))
        signed = F.concat(F.when(F.col("direction") == "OUTGOING", "-").otherwise(""), plain)
        line = F.concat_ws(",", F.concat(F.lit("txn_"), F.col("i").cast("string")), signed, F.lit("0.30"), signed, F.lit("eur"), F.concat(F.col("booking_date").cast("string"), F.lit(" 08:30")), F.concat(F.lit('"'), "reference", F.lit('"')), "company")
        return _files(rows.select("i", line.alias("value")), "id,Gross,Fee,Net,Currency,Created (UTC),Description,Customer Name\n", "\n")
    return _files(synthetic.render(rows, format), *synthetic.frame(format))


def _parsed(files: DataFrame) -> DataFrame:
    found = statements.parse_statements(files).transactions
    return found.select("id", F.col("booking_date").cast("string").alias("booking_date"), "amount_cents", "currency", "direction", "counterparty_name", "reference", "source_format")


def parsed_mt940(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(_statement_files(spark, sf_dir, "mt940"))


def parsed_camt053(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(_statement_files(spark, sf_dir, "camt053"))


def parsed_revolut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(_statement_files(spark, sf_dir, "revolut"))


def parsed_stripe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(_statement_files(spark, sf_dir, "stripe"))


def parsed_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(_statement_files(spark, sf_dir, "generic"))


FORMS = ("mt940", "camt053", "revolut", "stripe", "generic")


def detected_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file in one of the five formats, by its number."""
    of = lambda k, f: _statement_files(spark, sf_dir, f).where(F.col("file").cast("bigint") % len(FORMS) == k)
    every = reduce(DataFrame.unionByName, [of(k, f) for k, f in enumerate(FORMS)])
    return every.select("file", statements.detect_format(F.col("content")).alias("format"))


def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic rows with a date, an amount or a currency that cannot be read."""
    rows = _lines(spark, sf_dir)
    k = F.col("i") % 10
    day, money = F.when(k == 5, "soon").otherwise(F.col("booking_date").cast("string")), F.when(k == 3, "free").otherwise(F.concat(F.col("amount_cents").cast("string"), F.lit(",00")))
    line = F.concat_ws(";", day, "company", "reference", money, F.when(k == 7, "EURO").otherwise("EUR"))
    files = _files(rows.select("i", line.alias("value")), "Date;Counterparty;Reference;Amount;Currency\n", "")
    bad = statements.parse_statements(files).rejected
    return bad.select("file", "index", F.substring_index("error", ":", 1).alias("field"))


def invoice_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices of a CSV list of the first file's worth of orders, which one driver-side text holds."""
    inv = views.invoices(spark, sf_dir).where(F.col("inv_ord") < FILE_ROWS)
    line = F.concat_ws(",", "invoice_number", F.concat(F.floor(F.col("amount_cents") / 100).cast("string"), F.lit("."), F.lpad((F.col("amount_cents") % 100).cast("string"), 2, "0")), "currency", F.col("issue_date").cast("string"), F.lower("status"), "customer_name")
    text_ = _files(inv.select(F.col("inv_ord").alias("i"), line.alias("value")), "Invoice Number,Amount,Currency,Issue Date,Status,Customer Name\n", "").first()["content"]
    return invoice_lists.parse_invoices(spark, text_).select("invoice_number", "amount_cents", "currency", F.col("issue_date").cast("string").alias("issue_date"), "status", "customer_name")


def synthetic_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.generate(spark, 1000, noise=0.0).select("i", "company", "invoice_number", "amount_cents", "direction", F.col("booking_date").cast("string").alias("booking_date"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        normalize_amounts, parse_dates, fingerprint_ids, dedupe_incoming, open_invoices, skipped_invoices, reference_index, exact_reference_matches, partial_payments, amount_bucket_candidates,
        exact_metrics, fee_range_candidates, levenshtein_similarity, company_name_clean, normalized_remittance, invoice_candidates, remittance_scores, jaro_winkler_pairs, reconcile_matches,
        unmatched_transactions, unmatched_invoices, totals_by_currency, match_summary, confirmed_totals, ledger_postings, suspense_postings, unbalanced_postings, suspense_left,
        strict_matches, strict_unmatched, strict_totals, strict_summary, parsed_mt940, parsed_camt053, parsed_revolut, parsed_stripe, parsed_generic, detected_formats, quarantined_rows, invoice_list, synthetic_transactions,
    )
}

I, T = views.invoice_sql(), views.transaction_sql()
VIEWS = f"WITH i AS ({I}), t AS ({T}), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tx_ord) AS rn FROM t WHERE direction = 'INCOMING') WHERE rn = 1), o AS (SELECT * FROM i WHERE status = 'OPEN')"
DAYS = "least(abs(date_diff('day', d.booking_date, o.issue_date)), abs(date_diff('day', d.booking_date, o.due_date)))"
# A payment names an invoice by its number, however it is spaced; the strict report's phases follow from the rules.
EXACT = f"""{VIEWS}, n AS (SELECT d.*, o.id AS invoice_id, o.amount_cents AS due_cents, {DAYS} AS days FROM d JOIN o ON o.invoice_number = 'INV-2024-' || regexp_extract(d.reference, 'INV[- ]2024[- ]([0-9]{{7}})', 1) AND o.currency = d.currency),
    x AS (SELECT * FROM n WHERE amount_cents = due_cents AND days <= 2)"""
PART = "p AS (SELECT * FROM n WHERE amount_cents < due_cents AND days <= 5 AND id NOT IN (SELECT id FROM x) AND invoice_id NOT IN (SELECT invoice_id FROM x){0})"
NOT_FEE = " AND due_cents - amount_cents > 2500 AND amount_cents < floor(CAST(due_cents AS DOUBLE) * CAST(0.98 AS DOUBLE))"
BARE = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
NAMED = f"(contains({BARE.format('d.reference')}, {BARE.format('o.invoice_number')}) OR contains(lower(d.reference), o.id))"
STRICT_SQL = f"""{EXACT}, {PART.format('')},
    m AS (SELECT d.id, o.id AS invoice_id, d.amount_cents, o.amount_cents AS due_cents, d.currency, {NAMED} AS named, {DAYS} AS days FROM d JOIN o ON d.currency = o.currency AND d.amount_cents = o.amount_cents
          WHERE {DAYS} <= 2 AND d.id NOT IN (SELECT id FROM x UNION ALL SELECT id FROM p) AND o.id NOT IN (SELECT invoice_id FROM x UNION ALL SELECT invoice_id FROM p) AND ({NAMED} OR d.counterparty_name = o.customer_name)),
    f AS (SELECT id AS tx_id, invoice_id, 'MATCHED' AS status, 'EXACT_REFERENCE' AS level, CAST(1 AS DOUBLE) AS confidence, amount_cents AS matched_cents, CAST(0 AS BIGINT) AS remaining_cents, due_cents, currency FROM x
          UNION ALL SELECT id, invoice_id, 'PARTIAL_MATCH', 'PARTIAL_MATCH', CAST(0.95 AS DOUBLE), amount_cents, due_cents - amount_cents, due_cents, currency FROM p
          UNION ALL SELECT id, invoice_id, 'MATCHED', CASE WHEN named THEN 'EXACT_REFERENCE' ELSE 'EXACT_METRICS' END, CASE WHEN named THEN CAST(1 AS DOUBLE) ELSE CAST(0.98 AS DOUBLE) END, amount_cents, 0, due_cents, currency FROM m),
    u AS (SELECT id, direction, amount_cents, currency FROM d WHERE id NOT IN (SELECT tx_id FROM f) UNION ALL SELECT id, direction, amount_cents, currency FROM t WHERE direction = 'OUTGOING')"""
FILED = "row_number() OVER (PARTITION BY tx_ord // 500 ORDER BY tx_ord)"


def _rows_sql(id_: str, party: str, reference: str, format: str) -> str:
    """The rows that files of one format must give."""
    return f"""{VIEWS} SELECT {id_} AS id, CAST(booking_date AS VARCHAR) AS booking_date, amount_cents, 'EUR' AS currency, direction, {party} AS counterparty_name, {reference} AS reference, '{format}' AS source_format FROM t"""


SIGN = "CASE WHEN o_orderkey % 5 IN (2, 3) THEN -1 ELSE 1 END"

ORACLES = {
    "normalize_amounts": f"""SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents, CASE WHEN {SIGN} < 0 THEN 'OUTGOING' ELSE 'INCOMING' END AS direction,
        {SIGN} * CAST(round(o_totalprice * 100) AS BIGINT) AS signed_cents, format('{{:,}}', CAST(round(o_totalprice * 100) AS BIGINT) // 100) || '.' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') || ' EUR' AS shown FROM orders""",
    "parse_dates": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS parsed FROM orders",
    "fingerprint_ids": f"{VIEWS} SELECT tx_ord, sha256('DE89370400440532013000|' || CAST(booking_date AS VARCHAR) || '|' || amount_cents || '|' || currency || '|' || reference || '||' || direction) AS fingerprint FROM t",
    "dedupe_incoming": f"{VIEWS} SELECT id, tx_ord, amount_cents FROM d",
    "open_invoices": f"{VIEWS} SELECT id AS invoice_id, amount_cents AS invoice_amount, currency AS invoice_currency FROM o",
    "skipped_invoices": f"{VIEWS} SELECT id, status, 'INVOICE_NOT_OPEN' AS reason, 'INVOICE_NOT_OPEN' AS metadata_reason FROM i WHERE status <> 'OPEN'",
    "reference_index": f"""{VIEWS}, k AS (SELECT unnest([lower(invoice_number), replace(lower(invoice_number), '-', ''), lpad(CAST(inv_ord AS VARCHAR), 7, '0'), id, replace(id, '_', '')]) AS key, id, inv_ord FROM o)
        SELECT key, count(DISTINCT id) AS n_ids, arg_min(id, inv_ord) AS first_invoice FROM k GROUP BY key""",
    "exact_reference_matches": f"{EXACT} SELECT id AS tx_id, invoice_id, amount_cents AS tx_amount FROM x",
    "partial_payments": f"{EXACT}, {PART.format(NOT_FEE)} SELECT id AS tx_id, invoice_id, due_cents - amount_cents AS remaining_cents FROM p",
    "amount_bucket_candidates": f"{VIEWS} SELECT d.tx_ord, o.id AS invoice_id, {DAYS} AS days FROM d JOIN o ON d.currency = o.currency AND d.amount_cents // 10000 = o.amount_cents // 10000 WHERE {DAYS} <= 5",
    "exact_metrics": f"{VIEWS} SELECT d.id AS tx_id, o.id AS invoice_id, CAST(0.98 AS DOUBLE) AS confidence FROM d JOIN o ON d.currency = o.currency AND d.amount_cents = o.amount_cents AND d.counterparty_name = o.customer_name WHERE NOT {NAMED} AND {DAYS} <= 2",
    "fee_range_candidates": f"""{VIEWS} SELECT d.tx_ord, o.id AS invoice_id, o.amount_cents - d.amount_cents AS fee_cents FROM d JOIN o ON d.currency = o.currency AND o.amount_cents > d.amount_cents
        AND (o.amount_cents - d.amount_cents <= 2500 OR d.amount_cents >= floor(CAST(o.amount_cents AS DOUBLE) * CAST(0.98 AS DOUBLE))) WHERE {DAYS} <= 4""",
    "levenshtein_similarity": "SELECT a.c_custkey, 1 - CAST(levenshtein(a.c_name, b.c_name) AS DOUBLE) / greatest(length(a.c_name), length(b.c_name)) AS similarity FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey + 7",
    "company_name_clean": """SELECT c_custkey, trim(regexp_replace(lower(replace(c_name, '#', ' ')) || CASE c_custkey % 5 WHEN 2 THEN ' sp z o o' WHEN 3 THEN ' &' WHEN 4 THEN 'ag' ELSE '' END, '( sp z o o| &)$', '')) AS cleaned FROM customer""",
    "normalized_remittance": f"{VIEWS} SELECT tx_ord, trim(regexp_replace(CASE WHEN reference = 'monthly transfer' THEN 'monthly' ELSE regexp_replace(replace(replace(lower(reference), '#', ' '), '-', ' '), '\\b(payment|inv)\\b', ' ', 'g') END || ' muster', ' +', ' ', 'g')) AS normalized FROM t",
    "ledger_postings": f"""{EXACT} SELECT id AS tx_id, CAST(n AS INTEGER) AS line_no, CASE n WHEN 0 THEN 'assets:bank' ELSE 'assets:accounts_receivable' END AS account_id, CASE n WHEN 0 THEN 'DEBIT' ELSE 'CREDIT' END AS direction,
        amount_cents, currency FROM x, (VALUES (0), (1)) AS l(n)""",
    "suspense_postings": f"""{EXACT} SELECT id || CASE WHEN n < 2 THEN '-clearing' ELSE '-settlement' END AS event_id, CAST(booking_date AS VARCHAR) AS posted_at, CAST(n % 2 AS INTEGER) AS line_no,
        CASE n WHEN 0 THEN 'assets:bank' WHEN 3 THEN 'assets:accounts_receivable' ELSE 'assets:suspense' END AS account_id, CASE WHEN n % 2 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS direction,
        CASE WHEN n < 2 THEN amount_cents ELSE due_cents END AS amount_cents, currency FROM x, (VALUES (0), (1), (2), (3)) AS l(n)""",
    "unbalanced_postings": "SELECT CAST('' AS VARCHAR) AS event_id, CAST('' AS VARCHAR) AS currency, CAST(0 AS BIGINT) AS off_cents WHERE false",
    "suspense_left": f"""{EXACT}, {PART.format(NOT_FEE)}, b AS (SELECT currency, amount_cents, due_cents FROM x UNION ALL SELECT currency, amount_cents, due_cents FROM p)
        SELECT a AS account_id, currency, CAST(sum(CASE a WHEN 'assets:bank' THEN amount_cents WHEN 'assets:suspense' THEN due_cents - amount_cents ELSE -due_cents END) AS BIGINT) AS held_cents
        FROM b, (VALUES ('assets:bank'), ('assets:suspense'), ('assets:accounts_receivable')) AS l(a) GROUP BY ALL""",
    "strict_matches": f"{STRICT_SQL} SELECT tx_id, invoice_id, status, level, confidence, matched_cents, remaining_cents FROM f",
    "strict_unmatched": f"{STRICT_SQL} SELECT id, direction AS what FROM u UNION ALL SELECT id, CASE WHEN status = 'OPEN' THEN 'OPEN' ELSE 'INVOICE_NOT_OPEN' END FROM i WHERE id NOT IN (SELECT invoice_id FROM f)",
    "strict_totals": f"""{STRICT_SQL}, c AS (SELECT currency FROM t UNION SELECT currency FROM i)
        SELECT currency, CAST(coalesce((SELECT sum(CASE WHEN status = 'MATCHED' THEN due_cents ELSE matched_cents END) FROM f WHERE f.currency = c.currency), 0) AS BIGINT) AS matched_cents,
               CAST(coalesce((SELECT sum(amount_cents) FROM u WHERE u.currency = c.currency), 0) AS BIGINT) AS unmatched_cents, CAST(0 AS BIGINT) AS fee_cents FROM c""",
    "strict_summary": f"""{STRICT_SQL} SELECT (SELECT count(*) FROM f) AS matched_count, CAST(0 AS BIGINT) AS review_needed_count, (SELECT count(*) FROM u) AS unmatched_count,
        (SELECT count(*) FROM d) + (SELECT count(*) FROM t WHERE direction = 'OUTGOING') AS total_transactions, (SELECT count(*) FROM i) AS total_invoices""",
    "parsed_mt940": _rows_sql("'SYNTH-REF-' || (tx_ord + 1)", "counterparty_name", "reference", "mt940"),
    "parsed_camt053": _rows_sql("'SYNTH-E2E-' || (tx_ord + 1)", "counterparty_name", "reference", "camt053"),
    "parsed_revolut": _rows_sql(
        f"'revolut-' || CAST(booking_date AS VARCHAR) || '-' || amount_cents || '-' || {FILED}", "counterparty_name || ' ' || reference", "CASE direction WHEN 'INCOMING' THEN 'From ' ELSE 'To ' END || counterparty_name || ' ' || reference", "revolut-csv"
    ),
    "parsed_stripe": _rows_sql("'txn_' || tx_ord", "counterparty_name", "reference", "stripe-csv"),
    "parsed_generic": _rows_sql("sha256('|' || CAST(booking_date AS VARCHAR) || '|' || amount_cents || '|EUR|' || reference || '||' || direction)", "counterparty_name", "reference", "generic-csv"),
    "detected_formats": f"{VIEWS} SELECT CAST(tx_ord // 500 AS VARCHAR) AS file, ['mt940', 'camt053', 'revolut-csv', 'stripe-csv', 'generic-csv'][CAST(tx_ord // 500 % 5 + 1 AS INTEGER)] AS format FROM t GROUP BY ALL",
    "quarantined_rows": f"""{VIEWS}, r AS (SELECT tx_ord, {FILED} - 1 AS index FROM t) SELECT CAST(tx_ord // 500 AS VARCHAR) AS file, CAST(index AS INTEGER) AS index,
        CASE tx_ord % 10 WHEN 5 THEN 'booking_date' WHEN 3 THEN 'amount_cents' ELSE 'currency' END AS field FROM r WHERE tx_ord % 10 IN (3, 5, 7)""",
    "invoice_list": f"{VIEWS} SELECT invoice_number, amount_cents, currency, CAST(issue_date AS VARCHAR) AS issue_date, status, customer_name FROM i WHERE inv_ord < 500",
    "invoice_candidates": f"""{VIEWS}, r AS (SELECT tx_ord, reference, regexp_extract(reference, 'INV([- ])2024([- ])([0-9]{{7}})', 3) AS number FROM t),
        c AS (SELECT tx_ord, unnest(CASE WHEN number = '' THEN [] WHEN contains(reference, 'INV 2024') THEN ['2024', 'INV-2024'] ELSE ['2024-' || number, 'INV-2024-' || number, number] END) AS candidate FROM r) SELECT tx_ord, candidate FROM c""",
    "jaro_winkler_pairs": "SELECT a.c_custkey, jaro_winkler_similarity(a.c_name, b.c_name) AS similarity FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey + 3",
    "synthetic_transactions": """WITH g AS (SELECT range AS i FROM range(1000)) SELECT i, ['Acme Corp GmbH', 'Siemens Digital AG', 'Delta Logistics BV', 'Airbus Operations SAS', 'Nexus Dynamics LLC', 'Spotify AB', 'Zalando Payments GmbH', 'BioNTech SE', 'SAP Enterprise SE', 'Datadog Europe SAS'][CAST(i % 10 + 1 AS INTEGER)] AS company,
        'INV-2024-' || (1000 + i) AS invoice_number, (250 + i * 370 % 8000) * 100 AS amount_cents, CASE WHEN i % 5 = 4 THEN 'OUTGOING' ELSE 'INCOMING' END AS direction, CAST(DATE '2024-09-01' + CAST(i // 2 AS INTEGER) AS VARCHAR) AS booking_date FROM g""",
}
