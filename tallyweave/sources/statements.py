"""Bank statements of five formats to canonical transactions, with quarantine of bad rows.

A file is one row of text.  Structure is read file by file; dates, amounts, ids and checks are Column expressions.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dates import parse_bank_date
from ..functions.fingerprint import fingerprint
from ..functions.money import parse_amount
from ..storage import materialize
from .csv import cell, csv_file, first_cell, resolve_header

FORMATS = ("camt053", "mt940", "stripe-csv", "revolut-csv", "generic-csv")
# What replies call each format.
FORMAT_NAMES = {"camt053": "CAMT.053 (ISO 20022 XML)", "mt940": "SWIFT MT940", "stripe-csv": "Stripe Export CSV", "revolut-csv": "Revolut Business CSV", "generic-csv": "Generic CSV"}
# Names by which a generic statement's columns are known.
GENERIC = {
    "date": ("date", "booking date", "buchungstag", "datum", "transaction date", "tx date", "value date"),
    "amount": ("amount", "betrag", "sum", "total", "value", "gross", "net", "umsatz"),
    "reference": ("reference", "label", "description", "details", "text", "verwendungszweck", "remittance", "memo", "narrative", "payment reference", "buchungstext"),
    "counterparty": ("counterparty", "payer", "payee", "partner", "empfaenger", "absender", "auftraggeber", "name", "customer"),
    "currency": ("currency", "waehrung", "ccy"),
    "iban": ("iban", "account", "konto", "account number", "kontonummer", "kontoverbindung"),
    "id": ("id", "txid", "transaction id", "transaktions-id", "payment id", "bank id", "ref id"),
}


class UnknownFormatError(ValueError):
    pass


@dataclass(frozen=True)
class ParseOptions:
    format: str | None = None
    column_mapping: dict[str, str] = field(default_factory=dict)
    default_currency: str | None = None


@dataclass(frozen=True)
class Statement:
    """``transactions`` are canonical rows with ``file`` and ``tx_ord``; ``rejected``: file, index, raw, error."""

    transactions: DataFrame
    rejected: DataFrame


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, content)``, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def parser_id(name: str) -> str | None:
    """The format of a name, with or without its dashes."""
    wanted = name.strip().lower()
    return next((f for f in FORMATS if wanted in (f, f.replace("-", ""))), None)


def detect_format(content: Column) -> Column:
    """The first format whose marks the text has, or null."""
    head, low = F.substring(content, 1, 2000), F.lower(F.substring(content, 1, 2000))
    camt = (F.contains(low, F.lit("camt.053")) | F.contains(low, F.lit("bktocstmrstmt"))) & low.rlike(r"<(ns:)?(document|bktocstmrstmt)\b|<\w+:(document|bktocstmrstmt)\b")
    at = F.instr(F.substring(content, 1, 3000), "{4:")
    region = F.substr(content, F.greatest(at, F.lit(1)), F.lit(3000))
    has = lambda *marks: F.greatest(*[F.instr(region, m) for m in marks]) > 0 if len(marks) > 1 else F.instr(region, marks[0]) > 0
    mt940 = has(":20:", ":25:") & has(":60F:", ":60M:") & has(":61:")
    clean = F.regexp_replace(content, "^\\x{FEFF}", "")
    line = F.get(F.filter(F.split(clean, r"\r?\n"), lambda x: F.length(text.trim(x)) > 0), F.lit(0))
    n = lambda d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
    delimiter = F.when((n(";") > n(",")) & (n(";") > n("\t")), ";").when((n("\t") > n(",")) & (n("\t") > n(";")), "\t").otherwise(",")
    bare = F.transform(F.split(line, delimiter), lambda h: text.trim(F.regexp_replace(text.trim(h), "^[\"']|[\"']$", "")))
    names = F.transform(F.filter(bare, lambda h: h != ""), lambda h: F.regexp_replace(F.regexp_replace(F.lower(h), r"[\s\-_()]+", "_"), "^_+|_+$", ""))
    all_of = lambda *xs: F.size(F.array_intersect(names, F.array(*map(F.lit, xs)))) == len(xs)
    any_of = lambda *xs: F.size(F.array_intersect(names, F.array(*map(F.lit, xs)))) > 0
    stripe = (
        any_of("balance_transaction_id", "balance_transaction_id_utc", "reporting_category", "customer_facing_amount", "customer_facing_currency")
        | all_of("gross", "fee", "net")
        | (any_of("arrival_date_utc", "arrival_date") & any_of("created_utc", "created"))
        | (any_of("available_on_utc", "available_on") & all_of("fee", "net"))
    )
    stripe = ~text.trim(content).rlike(r"^(<|\{1:|:20:)") & (F.size(names) >= 2) & stripe
    top = F.substring(head, 1, 1000)
    within = lambda *marks: F.greatest(*[F.instr(top, m) for m in (*marks, *marks)]) > 0
    revolut = within("Completed Date", "Date completed") & within("Description") & within("Amount") & within("Balance", "State", "Fee")
    generic = F.substring_index(content, "\n", 1).rlike("[,;\t]")
    return F.when(camt, FORMATS[0]).when(mt940, FORMATS[1]).when(stripe, FORMATS[2]).when(revolut, FORMATS[3]).when(generic, FORMATS[4])


RAW = (
    "row_no int, booking string, valued string, amount string, way string, currency string, party string, party_iban string,"
    " reference string, bank_id string, own_id string, account string, bank_ref string, end_to_end string, reversal boolean, raw string"
)
NAMES = [c.split()[0] for c in RAW.split(", ")]


def _null(*names: str) -> dict[str, Column]:
    return {n: F.lit(None).cast("string") for n in names}


def _csv(files: DataFrame) -> DataFrame:
    parsed = files.withColumn("parsed", csv_file("content"))
    return parsed.select("file", F.col("parsed.headers").alias("headers"), F.posexplode("parsed.rows").alias("row_no", "row"))


def generic(files: DataFrame, options: ParseOptions) -> DataFrame:
    rows, row = _csv(files), F.col("row")
    at = {k: resolve_header(F.col("headers"), v, options.column_mapping.get(k)) for k, v in GENERIC.items()}
    get = lambda k: text.filled(text.trim(cell(row, at[k])))
    amount = F.when(at["amount"].isNull(), "0").otherwise(cell(row, at["amount"]))
    currency = F.upper(F.coalesce(text.filled(cell(row, at["currency"])), F.lit(options.default_currency or "EUR")))
    cols = {"booking": cell(row, at["date"]), "amount": amount, "currency": currency, "party": get("counterparty"), "reference": get("reference"), "bank_id": get("id"), "own_id": get("id"), "account": get("iban"), "bank_ref": get("reference")}
    return _rows(rows, cols)


def revolut(files: DataFrame, options: ParseOptions) -> DataFrame:
    rows, row = _csv(files), F.col("row")
    get = lambda *n: first_cell(row, *n)
    rows = rows.where(~F.upper(F.coalesce(get("State", "Status"), F.lit("COMPLETED"))).isin("REVERTED", "DECLINED", "FAILED"))
    said = F.coalesce(text.trim(get("Description")), F.lit(""))
    booking = F.coalesce(get("Completed Date", "Date completed", "Started Date", "Date started", "Date"), F.lit(""))
    # Written out: the optimizer would copy the long expressions to each place of their use, until the code for a row
    # no longer compiles.
    rows = materialize(rows.select(
        "file", "row_no", "row", F.coalesce(get("Amount"), F.lit("0")).alias("amount"), said.alias("said"), booking.alias("booking"), F.upper(F.coalesce(get("Currency"), F.lit("EUR"))).alias("currency"),
        text.filled(text.trim(get("Payer"))).alias("payer"), text.filled(text.trim(get("Beneficiary"))).alias("payee"), text.filled(text.trim(get("Reference", "Payment reference"))).alias("named"), get("Transaction ID", "ID").alias("given"),
    ))
    rows = materialize(rows.withColumns({"a": parse_amount(F.col("amount")), "day": parse_bank_date(F.col("booking"))["date"]}))
    incoming = F.coalesce("a.direction", F.lit("INCOMING")) == "INCOMING"
    after = lambda word: F.when(F.startswith(F.lower("said"), F.lit(word)), text.trim(F.substr("said", F.lit(len(word) + 1)))).otherwise(F.col("said"))
    party = F.when(incoming, F.coalesce("payer", after("from "))).otherwise(F.coalesce("payee", after("to ")))
    made = F.concat_ws("-", F.lit("revolut"), F.coalesce(F.col("day").cast("string"), "booking"), F.coalesce("a.amount_cents", F.lit(-1)).cast("string"), (F.col("row_no") + 1).cast("string"))
    cols = {"booking": F.col("booking"), "amount": F.col("amount"), "currency": F.col("currency"), "party": text.filled(party), "reference": F.coalesce("named", text.filled(F.col("said"))), "own_id": F.coalesce("given", made)}
    return _rows(rows, cols)


def stripe(files: DataFrame, options: ParseOptions) -> DataFrame:
    rows, row = _csv(files), F.col("row")
    get = lambda *n: first_cell(row, *n)
    id_ = F.coalesce(get("Balance transaction ID", "id", "Transaction ID"), F.concat(F.lit("stripe-tx-"), (F.col("row_no") + 1).cast("string")))
    kind = get("Type", "Reporting category")
    reference = F.coalesce(get("Description", "description", "Invoice Number", "Customer Facing Description"), F.concat(F.lit("Stripe "), kind))
    cols = {
        "booking": get("Created (UTC)", "Created", "Available on (UTC)", "Date"), "amount": F.coalesce(get("Gross", "Amount", "amount"), F.lit("0")), "currency": F.upper(F.coalesce(get("Currency", "currency"), F.lit("USD"))),
        "party": get("Customer Name", "customer_name", "Customer Email"), "reference": reference, "bank_id": id_, "own_id": id_,
    }
    return _rows(rows, cols)


def _rows(rows: DataFrame, cols: dict[str, Column]) -> DataFrame:
    given = _null(*NAMES) | cols | {"row_no": F.col("row_no"), "raw": F.to_json("row"), "reversal": F.lit(None).cast("boolean")}
    return materialize(rows.select("file", *[given[n].alias(n) for n in NAMES]))


ENTRY = re.compile(r"^(\d{6})(\d{4})?(C|D|RC|RD)([A-Za-z])?([0-9]+(?:[.,][0-9]{1,2})?)(.*)$")


def _one_line(s: str) -> str:
    return re.sub(r"[\r\n]+", " ", s).strip()


def info_fields(info: str) -> tuple[str | None, str | None, str | None]:
    """Reference, name and IBAN of an information field: numbered subfields, slash tags or plain text."""
    parts = re.split(r"\?(\d{2})", info)
    if len(parts) > 1:
        sub: dict[str, str] = {}
        for code, value in zip(parts[1::2], parts[2::2]):
            sub[code] = f"{sub[code]} {_one_line(value)}" if sub.get(code) else _one_line(value)
        joined = lambda codes: " ".join(sub[c] for c in codes if sub.get(c)).strip()
        reference = joined([str(c) for c in (*range(20, 30), *range(60, 64))])
        return reference or parts[0].strip() or _one_line(info), joined(("32", "33")) or None, re.sub(r"\s", "", sub.get("38", "")) or None
    if "/" in info:
        tag = lambda names: (m := re.search(rf"/(?:{names})/([^/]+)", info)) and m[1].strip()
        named = lambda n: None if (v := tag(n)) == "NONREF" else v
        purpose = tag("SVWZ") and _one_line(tag("SVWZ"))
        ends = named("EREF")
        reference = " ".join(x for x in (ends, purpose) if x) or named("KREF")
        party, iban = tag("BENM|ABWE|ABWA"), tag("IBAN")
        return reference or _one_line(info), party and _one_line(party), iban and re.sub(r"\s", "", iban)
    return _one_line(info) or None, None, None


def mt940_rows(content: str, default_currency: str = "EUR") -> list[tuple]:
    """Entries of a SWIFT statement; currency and account are the last ones the file names."""
    block = re.search(r"\{4:\r?\n([\s\S]*?)(?:\r?\n-\})", content)
    lines = re.sub(r"\r\n?", "\n", block[1] if block else content).split("\n")
    fields: list[list] = []
    open_ = False
    for line in lines:
        m = re.match(r"^:([0-9]{2}[A-Z]?):(.*)$", line)
        if m:
            fields.append([m[1], [m[2]]])
            open_ = True
        elif line.strip() in ("-", "-}"):
            open_ = False
        elif open_:
            fields[-1][1].append(line)
    entries: list[list[str]] = []
    currency, account, attached = default_currency, None, False
    for tag, value in ((t, "\n".join(v).strip()) for t, v in fields):
        if tag in ("25", "25P"):
            account = re.sub(r"\s", "", value)
        elif tag in ("60F", "60M"):
            currency = (m := re.search(r"[CD]\d{6}([A-Z]{3})", value)) and m[1] or currency
        elif tag == "61":
            entries.append([value, ""])
            attached = True
        elif tag == "86" and attached:
            entries[-1][1] = value
        elif tag in ("62F", "62M"):
            attached = False
    out = []
    for n, (line, info) in enumerate(entries):
        m = ENTRY.match(line)
        if not m or "\n" in line:
            continue
        refs = m[6].split("//")
        bank_ref = refs[1].strip() if len(refs) > 1 else None
        reference, party, iban = info_fields(info) if info else (None, None, None)
        own = bank_ref if bank_ref and bank_ref != "NONREF" else None
        out.append((n, m[1], None, m[5], "INCOMING" if m[3] in ("C", "RC") else "OUTGOING", currency, party, iban, reference, bank_ref or None, own, account, reference, None, None, line))
    return out


def _node(node: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        node = None if node is None else next((x for x in node if x.tag == name), None)
    return node


def _text(node: ET.Element | None, *path: str) -> str | None:
    found = _node(node, *path)
    return (found.text or "").strip() or None if found is not None else None


def _all(node: ET.Element | None, *path: str) -> list[ET.Element]:
    nodes = [] if node is None else [node]
    for name in path:
        nodes = [x for n in nodes for x in n if x.tag == name]
    return nodes


def _amount(node: ET.Element) -> tuple[str, str | None] | None:
    for path in (("Amt",), ("AmtDtls", "TxAmt", "Amt"), ("AmtDtls", "InstdAmt", "Amt"), ("AmtDtls", "Amt")):
        found = _node(node, *path)
        if found is not None:
            currency = next((found.attrib[k] for k in ("Ccy", "ccy", "Currency") if found.attrib.get(k)), None)
            return ((found.text or "").strip(), currency and currency.upper()) if (found.text or "").strip() else None
    return None


def _reference(tx: ET.Element, entry: ET.Element | None = None) -> str | None:
    info = _node(tx, "RmtInf")
    info = info if info is not None else _node(entry, "RmtInf")
    lines = [x.text or "" for x in _all(info, "Ustrd")]
    for way in (" ".join(lines), _text(info, "Strd", "CdtrRefInf", "Ref") if len(_all(info, "Strd")) == 1 else None, _text(tx, "AddtlTxInf"), _text(entry, "AddtlNtryInf")):
        if way:
            return way.strip() or None
    return None


def _party(tx: ET.Element | None, entry: ET.Element, incoming: bool) -> tuple[str | None, str | None]:
    parties = _node(tx, "RltdPties")
    parties = parties if parties is not None else _node(entry, "RltdPties")
    order = ("Dbtr", "Cdtr") if incoming else ("Cdtr", "Dbtr")
    first = lambda *found: next((x for x in found if x), None)
    return first(*[_text(parties, p, "Nm") for p in order]), first(*[_text(parties, f"{p}Acct", "Id", "IBAN") for p in order])


def camt_rows(content: str) -> list[tuple]:
    """Entries of an ISO 20022 statement.  Details with amounts of their own are rows, others collapse to their entry."""
    root = ET.fromstring(content.strip().encode())
    for x in root.iter():
        x.tag = x.tag.rpartition("}")[2].rpartition(":")[2]
    body = root if root.tag == "BkToCstmrStmt" else _node(root, "BkToCstmrStmt")
    if body is None:
        low = content.lower()
        if "<bal" in low and "<ntry" not in low:
            return []  # balances without a statement
        raise ValueError("Invalid CAMT.053 XML: missing BkToCstmrStmt")
    yes = lambda node: (_text(node, "RvslInd") or "").lower() in ("true", "1")
    when = lambda node, kind: _text(node, kind, "Dt") or _text(node, kind, "DtTm")
    credit = lambda mark: "CRDT" in (mark or "CRDT").upper()
    out: list[tuple] = []
    for statement in _all(body, "Stmt"):
        account = _text(statement, "Acct", "Id", "IBAN")
        for entry in _all(statement, "Ntry"):
            valued = when(entry, "ValDt")
            booked = when(entry, "BookgDt") or valued
            amount, currency = _amount(entry) or ("0", None)
            reversed_, mark = yes(entry), _text(entry, "CdtDbtInd")
            details = _all(entry, "NtryDtls", "TxDtls")
            service = _text(entry, "AcctSvcrRef")
            service = None if service == "NOTPROVIDED" else service

            def add(tx, amount, currency, incoming, reversal, booked, valued, reference, party):
                ends = _text(tx, "Refs", "EndToEndId")
                ends = None if ends == "NOTPROVIDED" else ends
                bank_id = ends or _text(tx, "Refs", "InstrId") or service
                raw = ET.tostring(tx if tx is not None else entry, encoding="unicode")
                out.append((len(out), booked, valued, amount, "INCOMING" if incoming else "OUTGOING", currency or "EUR", *party, reference, bank_id, bank_id, account, service or reference, ends, reversal or None, raw))  # noqa: B023

            if len(details) > 1 and not all(_amount(d) for d in details):
                incoming = credit(mark) != reversed_
                refs = dict.fromkeys(x for x in (*map(_reference, details), _text(entry, "AddtlNtryInf")) if x)
                found = [_party(d, entry, incoming) for d in details]
                party = tuple(next((f[i] for f in found if f[i]), None) for i in (0, 1))
                add(details[0], amount, currency, incoming, reversed_, booked, valued, " / ".join(refs) or None, party)
            elif details:
                for d in details:
                    own, own_currency = _amount(d) or (amount, currency)
                    reversal = reversed_ or yes(d)
                    incoming = credit(_text(d, "CdtDbtInd") or mark) != reversal
                    add(d, own, own_currency or currency, incoming, reversal, when(d, "BookgDt") or booked, when(d, "ValDt") or valued, _reference(d, entry), _party(d, entry, incoming))
            else:
                incoming = credit(mark) != reversed_
                add(None, amount, currency, incoming, reversed_, booked, valued, _text(entry, "AddtlNtryInf"), _party(None, entry, incoming))
    return out


#: Texts of one part of a table: Spark reads a part's rows up to 4,096 at once, so many long texts would stand in memory.
TEXTS = 64
#: Rows that go back to Spark at once.
STRETCH = 4096


def _entries(files: DataFrame, read) -> DataFrame:
    """The rows of each file, one file after the other: a task holds the entries of one text only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                file, rows = file.as_py(), read(content.as_py())
                for i in range(0, len(rows), STRETCH):
                    part = rows[i : i + STRETCH]
                    columns = [pa.array(c, pa.int32() if n == "row_no" else pa.bool_() if n == "reversal" else pa.string()) for n, c in zip(NAMES, zip(*part))]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part), pa.string()), *columns], ["file", *NAMES])

    return files.select("file", "content").mapInArrow(run, f"file string, {RAW}")


def camt053(files: DataFrame, options: ParseOptions) -> DataFrame:
    return _entries(files, camt_rows)


def mt940(files: DataFrame, options: ParseOptions) -> DataFrame:
    currency = options.default_currency or "EUR"
    return _entries(files, lambda c: mt940_rows(c, currency))


PARSERS = dict(zip(FORMATS, (camt053, mt940, stripe, revolut, generic)))


def typed(rows: DataFrame, source: str) -> DataFrame:
    """Canonical columns plus ``errors``, the list of what is wrong with a row."""
    amount, date, valued = parse_amount(F.col("amount")), parse_bank_date(F.col("booking")), parse_bank_date(F.col("valued"))
    # Written out, as in ``revolut``.
    rows = materialize(rows.withColumns({"a": amount, "d": date, "v": valued}))
    way, booked = F.coalesce("way", "a.direction", F.lit("INCOMING")), F.coalesce(F.col("d.date").cast("string"), F.coalesce("booking", F.lit("")))
    made = fingerprint(F.col("account"), booked, F.coalesce("a.amount_cents", F.lit(-1)), F.col("currency"), F.col("bank_ref"), F.col("end_to_end"), way)
    wrong = F.array_compact(F.array(F.when(F.col("d.date").isNull(), F.concat(F.lit("booking_date: "), F.col("d.error"))), F.when(F.col("a.error").isNotNull(), F.concat(F.lit("amount_cents: "), F.col("a.error"))), F.when(F.length("currency") != 3, "currency: not three letters")))
    return rows.select(
        "file", "row_no", F.coalesce(text.filled(F.col("own_id")), made).alias("id"), F.col("d.date").alias("booking_date"), F.col("v.date").alias("value_date"), F.col("a.amount_cents").alias("amount_cents"), F.upper("currency").alias("currency"),
        way.alias("direction"), F.col("party").alias("counterparty_name"), F.col("party_iban").alias("counterparty_iban"), F.lit(None).cast("string").alias("counterparty_bic"), "reference", F.col("bank_id").alias("bank_transaction_id"),
        F.lit(source).alias("source_format"), F.col("reversal").alias("is_reversal"), "raw", wrong.alias("errors"),
    )


def parse_statements(files: DataFrame, options: ParseOptions = ParseOptions()) -> Statement:
    """Parse ``files(file, content)``; files of one call may differ in format."""
    if options.format:
        chosen = parser_id(options.format)
        if not chosen:
            raise UnknownFormatError(f"Unknown format {options.format!r}; known: {', '.join(FORMATS)}")
        parts = [typed(PARSERS[chosen](files, options), chosen)]
    else:
        # Texts are read and tried once; only formats that occur are parsed.
        known = files.withColumn("format", F.coalesce(detect_format(F.col("content")), F.raise_error(F.concat(F.lit("No parser detects "), "file")).cast("string")))
        known = materialize(known, most=TEXTS)
        present = {r["format"] for r in known.select("format").distinct().collect()} or {FORMATS[0]}
        parts = [typed(PARSERS[f](known.where(F.col("format") == f).drop("format"), options), f) for f in FORMATS if f in present]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    good = F.size("errors") == 0
    position = F.struct("file", "row_no")
    rejected = rows.where(~good).select("file", F.col("row_no").alias("index"), "raw", F.array_join("errors", "; ").alias("error"))
    return Statement(rows.where(good).withColumn("position", position).drop("errors", "row_no"), rejected)
