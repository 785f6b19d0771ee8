"""Invoices and transactions derived from the star schema, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The two statements hold for both engines: integer, text and date arithmetic only.
INVOICES = """
SELECT concat('ord_', CAST(o_orderkey AS STRING)) AS id,
       concat('INV-2024-', lpad(CAST(o_orderkey AS STRING), 7, '0')) AS invoice_number,
       CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents,
       CASE c_nationkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'GBP' END AS currency,
       CAST(o_orderdate AS DATE) AS issue_date,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 14 DAY AS DATE) AS due_date,
       CASE WHEN o_orderstatus = 'F' THEN 'PAID' WHEN o_orderstatus = 'P' AND o_orderkey % 11 = 0 THEN 'VOID' ELSE 'OPEN' END AS status,
       c_name AS customer_name, o_orderkey AS inv_ord
FROM orders JOIN customer ON o_custkey = c_custkey"""
TRANSACTIONS = f"""
SELECT concat('tx_', CAST(CASE WHEN k = 8 THEN inv_ord - 8 ELSE inv_ord END AS STRING)) AS id,
       CAST(CASE WHEN k = 5 THEN due_date + INTERVAL 9 DAY ELSE issue_date + INTERVAL 1 DAY END AS DATE) AS booking_date,
       CASE WHEN k = 3 THEN greatest(amount_cents - 1500, 0) WHEN k = 4 THEN amount_cents * 6 DIV10 ELSE amount_cents END AS amount_cents,
       CASE WHEN k <> 7 THEN currency WHEN currency = 'EUR' THEN 'USD' ELSE 'EUR' END AS currency,
       CASE WHEN k = 9 THEN 'OUTGOING' ELSE 'INCOMING' END AS direction,
       customer_name AS counterparty_name,
       CASE k WHEN 1 THEN concat('Payment ', replace(invoice_number, '-', ' ')) WHEN 2 THEN concat('#', invoice_number)
              WHEN 6 THEN 'monthly transfer' ELSE concat('Payment ', invoice_number) END AS reference,
       'sepa' AS source_format, inv_ord AS tx_ord
FROM (SELECT *, inv_ord % 10 AS k FROM ({INVOICES}) AS i) AS s"""
#: Whole tenths: the division that both engines do on integers.
DIVISION = {"spark": "DIV 10", "duckdb": "// 10"}


def _sql(statement: str, engine: str) -> str:
    text = statement.replace("DIV10", DIVISION[engine])
    return text if engine == "spark" else text.replace("AS STRING", "AS VARCHAR")


def invoice_sql(engine: str = "duckdb") -> str:
    return _sql(INVOICES, engine)


def transaction_sql(engine: str = "duckdb") -> str:
    return _sql(TRANSACTIONS, engine)


def _with(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    for table in ("orders", "customer"):
        statement = statement.replace(f" {table} ", f" {{{table}}} ")
    return spark.sql(statement, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an invoice."""
    missing = {"customer_email": "string", "customer_iban": "string", "metadata": "map<string,string>", "remaining_cents": "bigint", "reason": "string"}
    from pyspark.sql import functions as F

    return _with(spark, sf_dir, invoice_sql("spark")).withColumns({k: F.lit(None).cast(v) for k, v in missing.items()})


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payment for every order: exact, respaced, hashed, short by a fee, partial, late, unnamed, in another currency,
    with an id seen before, or outgoing, by the last digit of the order."""
    missing = {"value_date": "date", "counterparty_iban": "string", "counterparty_bic": "string", "bank_transaction_id": "string", "is_reversal": "boolean", "raw": "string"}
    from pyspark.sql import functions as F

    return _with(spark, sf_dir, transaction_sql("spark")).withColumns({k: F.lit(None).cast(v) for k, v in missing.items()})
