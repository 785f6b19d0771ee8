"""Synthetic statements: rows from ``spark.range`` and writers of four formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Companies and their accounts.
COMPANIES = (
    ("Acme Corp GmbH", "DE89370400440532013000"), ("Siemens Digital AG", "DE44500105175407324911"), ("Delta Logistics BV", "NL91INGB0001234567"), ("Airbus Operations SAS", "FR7630006000011234567890189"), ("Nexus Dynamics LLC", "US123456789012345"),
    ("Spotify AB", "SE4550000000058398257466"), ("Zalando Payments GmbH", "DE99100100101234567890"), ("BioNTech SE", "DE21500500000987654321"), ("SAP Enterprise SE", "DE60672500200001234567"), ("Datadog Europe SAS", "FR1420041010050500013M02606"),
)
ALIASES = {"revolut-csv": "revolut", "xml": "camt053", "swift": "mt940", "generic-csv": "generic", "csv": "generic"}


def generate(spark: SparkSession, count: int = 10, noise: float = 0.1, currency: str = "EUR", base_date: str = "2024-09-01", seed: int = 42) -> DataFrame:
    """``count`` rows; a share of them pays short, spells the reference otherwise or books two days late."""
    i, rate = F.col("i"), max(0.0, min(1.0, noise))
    pick = lambda at: F.element_at(F.array(*[F.lit(c[at]) for c in COMPANIES]), (i % len(COMPANIES) + 1).cast("int"))
    dice = lambda salt, n: F.pmod(F.xxhash64(i, F.lit(seed), F.lit(salt)), F.lit(n))
    rows = spark.range(count).withColumnRenamed("id", "i")
    noisy = dice(1, 1_000_000) < F.lit(int(rate * 1_000_000))
    kind, fee = dice(2, 3), dice(3, 15) + 10
    base = 250 + (i * 370) % 8000
    number = F.concat(F.lit("INV-2024-"), F.lpad((i + 1000).cast("string"), F.greatest(F.length((i + 1000).cast("string")), F.lit(4)), F.lit("0")))
    full = F.concat(number, F.lit(" "), pick(0))
    return rows.select(
        "i", pick(0).alias("company"), pick(1).alias("iban"), number.alias("invoice_number"), F.lit(currency).alias("currency"), F.when(i % 5 == 4, "OUTGOING").otherwise("INCOMING").alias("direction"),
        (F.when(noisy & (kind == 0), F.greatest(F.lit(10), base - fee)).otherwise(base) * 100).cast("bigint").alias("amount_cents"),
        F.when(noisy & (kind == 1), F.regexp_replace(full, "^([^-]*)-", "$1 ")).otherwise(full).alias("reference"),
        F.date_add(F.lit(base_date).cast("date"), (F.floor(i / 2) + F.when(noisy & (kind == 2), 2).otherwise(0)).cast("int")).alias("booking_date"),
        F.when(noisy, F.when(kind == 0, F.concat(F.lit("wire_fee_"), fee.cast("string"))).when(kind == 1, "ref_typo").otherwise("date_drift")).alias("noise_type"),
    )


def render(rows: DataFrame, format: str) -> DataFrame:
    """``(i, value)``: the lines of a statement body in order; ``frame`` has what stands around them."""
    kind = ALIASES.get(format.strip().lower(), format.strip().lower())
    cents = F.col("amount_cents")
    plain = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    comma, incoming = F.replace(plain, F.lit("."), F.lit(",")), F.col("direction") == "INCOMING"
    signed = lambda x: F.concat(F.when(incoming, "").otherwise("-"), x)
    day, n = F.col("booking_date").cast("string"), (F.col("i") + 1).cast("string")
    if kind == "revolut":
        said = F.concat(F.when(incoming, "From ").otherwise("To "), "company", F.lit(" "), "reference")
        line = F.concat_ws(",", F.when(incoming, "TOPUP").otherwise("TRANSFER"), F.lit("Current"), F.concat(day, F.lit(" 10:00:00")), F.concat(day, F.lit(" 10:05:00")), F.concat(F.lit('"'), F.replace(said, F.lit('"'), F.lit('""')), F.lit('"')), signed(plain), F.lit("0.00"), "currency", F.lit("COMPLETED"), F.lit("0.00"))
    elif kind == "generic":
        line = F.concat_ws(";", F.date_format("booking_date", "dd.MM.yyyy"), "company", "reference", signed(comma), "currency")
    elif kind == "mt940":
        line = F.concat(F.lit(":61:"), F.date_format("booking_date", "yyMMdd"), F.lit("0901"), F.when(incoming, "CR").otherwise("DR"), comma, F.lit("NTRFNONREF//SYNTH-REF-"), n, F.lit("\n:86:?00160?20"), "reference", F.lit("?32"), "company")
    elif kind == "camt053":
        side = F.when(incoming, "Dbtr").otherwise("Cdtr")
        tag = lambda name, *inner: F.concat(F.lit("<"), name, F.lit(">"), *inner, F.lit("</"), name, F.lit(">"))
        t = lambda name, *inner: tag(F.lit(name), *inner)
        line = t("Ntry", F.lit('<Amt Ccy="'), F.col("currency"), F.lit('">'), plain, F.lit("</Amt>"), t("CdtDbtInd", F.when(incoming, "CRDT").otherwise("DBIT")), t("BookgDt", t("Dt", day)), t("ValDt", t("Dt", day)), t("NtryDtls", t("TxDtls", t("Refs", t("EndToEndId", F.lit("SYNTH-E2E-"), n)), t("RltdPties", tag(side, t("Nm", F.col("company"))), tag(F.concat(side, F.lit("Acct")), t("Id", t("IBAN", F.col("iban"))))), t("RmtInf", t("Ustrd", F.col("reference"))))))
    else:
        raise ValueError(f"Unknown format {format!r}")
    return rows.select("i", line.alias("value"))


def frame(format: str, currency: str = "EUR") -> tuple[str, str]:
    kind = ALIASES.get(format.strip().lower(), format.strip().lower())
    account = "DE89370400440532013000"
    return {
        "revolut": ("Type,Product,Started Date,Completed Date,Description,Amount,Fee,Currency,State,Balance\n", ""),
        "generic": ("Date;Counterparty;Reference;Amount;Currency\n", ""),
        "mt940": (f":20:SYNTH940\n:25:{account}\n:28C:00001/001\n:60F:C240901{currency}50000,00\n", f"\n:62F:C240930{currency}75000,00\n-"),
        "camt053": (f'<?xml version="1.0" encoding="UTF-8"?>\n<Document xmlns="urn:iso:std:iso:20022:tech:xsd:camt.053.001.02"><BkToCstmrStmt><Stmt><Id>SYNTH-STMT-001</Id><Acct><Id><IBAN>{account}</IBAN></Id></Acct>\n', "\n</Stmt></BkToCstmrStmt></Document>"),
    }[kind]


def statement(rows: DataFrame, format: str, currency: str = "EUR") -> str:
    """A whole statement as one text, for files of the size of a statement; larger ones go out by ``render``."""
    head, tail = frame(format, currency)
    lines = [r["value"] for r in render(rows, format).orderBy("i").toLocalIterator()]
    return head + "\n".join(lines) + tail
