import pytest

from tallyweave.plans import service
from tallyweave.sources import statements, synthetic
from tallyweave.sources.csv import parse_csv
from tallyweave.sources.invoices import InvalidInvoiceDataError, parse_invoices
from tallyweave.sources.statements import ParseOptions, camt_rows, mt940_rows, parser_id

REVOLUT = """Type,Product,Started Date,Completed Date,Description,Amount,Fee,Currency,State,Balance
TOPUP,Current,2024-09-01 10:00:00,2024-09-01 10:05:00,From Acme Corp,1500.00,0.00,EUR,COMPLETED,1
CARD,Current,2024-09-01 10:00:00,2024-09-02 10:05:00,To Shop, -85.50,0.00,EUR,COMPLETED,1
CARD,Current,2024-09-01 10:00:00,2024-09-02 10:05:00,Gone,5.00,0.00,EUR,REVERTED,1"""
STRIPE = """id,Type,Gross,Fee,Net,Currency,Created (UTC),Description
txn_1,charge,100.00,3,97,usd,2024-09-01 10:00,INV-1
txn_2,refund,-20.00,0,-20,usd,2024-09-02 10:00,"""
GENERIC = "Buchungstag;Auftraggeber;Verwendungszweck;Betrag\n01.09.2024;Acme;RE 1;3.450,00\nbad;Foo;RE 2;1,00\n02.09.2024;Bar;RE 3;nix"
MT940 = """:20:X
:25:DE12 3456
:60F:C240901EUR1,00
:61:2409010901CR1500,50NTRFNONREF//BANK-1
:86:?00160?20INV-1?21more?32Acme?33GmbH?38DE 99
:61:240902D20,NTRFNONREF
:86:/EREF/E-1/SVWZ/Rent
may/BENM/Landlord/IBAN/DE77
:62F:C240930EUR1,00
-"""
CAMT = """<?xml version="1.0"?><ns2:Document xmlns:ns2="urn:iso:std:iso:20022:tech:xsd:camt.053.001.02"><ns2:BkToCstmrStmt><ns2:Stmt><ns2:Acct><ns2:Id><ns2:IBAN>DE1</ns2:IBAN></ns2:Id></ns2:Acct>
<ns2:Ntry><ns2:Amt Ccy="EUR">800.00</ns2:Amt><ns2:CdtDbtInd>CRDT</ns2:CdtDbtInd><ns2:BookgDt><ns2:Dt>2024-09-01</ns2:Dt></ns2:BookgDt><ns2:NtryDtls><ns2:TxDtls><ns2:RmtInf><ns2:Ustrd>A</ns2:Ustrd></ns2:RmtInf></ns2:TxDtls><ns2:TxDtls><ns2:RmtInf><ns2:Ustrd>B</ns2:Ustrd></ns2:RmtInf></ns2:TxDtls></ns2:NtryDtls></ns2:Ntry>
<ns2:Ntry><ns2:Amt Ccy="EUR">1000.00</ns2:Amt><ns2:CdtDbtInd>CRDT</ns2:CdtDbtInd><ns2:BookgDt><ns2:Dt>2024-09-01</ns2:Dt></ns2:BookgDt><ns2:NtryDtls><ns2:TxDtls><ns2:Amt Ccy="EUR">400.00</ns2:Amt><ns2:Refs><ns2:EndToEndId>E1</ns2:EndToEndId></ns2:Refs></ns2:TxDtls><ns2:TxDtls><ns2:Amt Ccy="EUR">600.00</ns2:Amt><ns2:RltdPties><ns2:Dbtr><ns2:Nm>Acme</ns2:Nm></ns2:Dbtr></ns2:RltdPties></ns2:TxDtls></ns2:NtryDtls></ns2:Ntry>
<ns2:Ntry><ns2:Amt Ccy="EUR">50.00</ns2:Amt><ns2:CdtDbtInd>CRDT</ns2:CdtDbtInd><ns2:RvslInd>true</ns2:RvslInd><ns2:BookgDt><ns2:DtTm>2024-09-03T10:00:00</ns2:DtTm></ns2:BookgDt></ns2:Ntry>
</ns2:Stmt></ns2:BkToCstmrStmt></ns2:Document>"""


def rows(spark, content, **options):
    name, found = service.parse_text(spark, content, ParseOptions(**options))
    return name, found.transactions.orderBy("position").collect(), found.rejected.orderBy("index").collect()


def test_csv_dialect():
    assert parse_csv('a;b\n"x ""y"";z";1\n\n;\n"p\nq"') == (["a", "b"], [{"a": 'x "y";z', "b": "1"}, {"a": "p\nq", "b": ""}])
    assert parse_csv("") == ([], [])
    assert parse_csv("a,a\n1,2,3")[1] == [{"a": "2"}]
    assert parse_csv('a\nx"y,z"w')[1] == [{"a": "xy,zw"}]


def test_revolut(spark):
    name, good, bad = rows(spark, REVOLUT)
    assert name == "revolut-csv" and not bad
    assert [(r.amount_cents, r.direction, r.counterparty_name, str(r.booking_date)) for r in good] == [(150000, "INCOMING", "Acme Corp", "2024-09-01"), (8550, "OUTGOING", "Shop", "2024-09-02")]
    assert good[0].id == "revolut-2024-09-01-150000-1"


def test_stripe(spark):
    name, good, _ = rows(spark, STRIPE)
    assert name == "stripe-csv"
    assert [(r.id, r.amount_cents, r.currency, r.direction, r.reference) for r in good] == [("txn_1", 10000, "USD", "INCOMING", "INV-1"), ("txn_2", 2000, "USD", "OUTGOING", "Stripe refund")]


def test_generic_quarantine(spark):
    name, good, bad = rows(spark, GENERIC)
    assert name == "generic-csv" and [r.amount_cents for r in good] == [345000] and good[0].counterparty_name == "Acme" and len(good[0].id) == 64
    assert [r["index"] for r in bad] == [1, 2] and "InvalidDateError" in bad[0].error
    _, good, _ = rows(spark, "w,v\n2024-01-02,5.00", format="generic-csv", column_mapping={"date": "w", "amount": "v"}, default_currency="chf")
    assert (good[0].amount_cents, good[0].currency) == (500, "CHF")


def test_mt940(spark):
    name, good, _ = rows(spark, MT940)
    assert name == "mt940"
    assert (good[0].id, good[0].amount_cents, good[0].reference, good[0].counterparty_name, good[0].counterparty_iban) == ("BANK-1", 150050, "INV-1 more", "Acme GmbH", "DE99")
    assert (good[1].direction, good[1].reference, good[1].counterparty_name, good[1].counterparty_iban) == ("OUTGOING", "E-1 Rent may", "Landlord", "DE77")
    assert mt940_rows("{1:x}{4:\n" + MT940 + "\n-}") and not mt940_rows("")


def test_camt(spark):
    name, good, _ = rows(spark, CAMT)
    assert name == "camt053"
    assert [(r.amount_cents, r.direction, r.reference, r.is_reversal) for r in good] == [(80000, "INCOMING", "A / B", None), (40000, "INCOMING", None, None), (60000, "INCOMING", None, None), (5000, "OUTGOING", None, True)]
    assert good[1].id == "E1" and good[2].counterparty_name == "Acme"
    with pytest.raises(ValueError):
        camt_rows("<a/>")


def test_formats(spark):
    assert parser_id(" MT940 ") == "mt940" and parser_id("revolutcsv") == "revolut-csv" and parser_id("x") is None
    with pytest.raises(ValueError):
        service.parse_text(spark, "nothing here")
    with pytest.raises(ValueError):
        service.parse_text(spark, "a,b", ParseOptions("x"))


def test_invoices(spark):
    ok = '[{"id":"i1","invoiceNumber":"INV-1","amountCents":100,"currency":"eur","issueDate":"2024-09-01","customerName":""}]'
    row = parse_invoices(spark, ok).first()
    assert (row.currency, row.status, row.amount_cents, row.inv_ord) == ("EUR", "OPEN", 100, 0)
    for wrong in ("1500.5", '"150000"', "-1"):
        with pytest.raises(InvalidInvoiceDataError):
            parse_invoices(spark, ok.replace(":100", f":{wrong}"))
    got = parse_invoices(spark, "Invoice Number,Customer Name,Amount,Issue Date,Status,Customer Email\nINV-9,Acme,12.50,2024-09-01,odd,nomail").first()
    assert (got.id, got.invoice_number, got.amount_cents, got.status, got.customer_email) == ("inv-1", "INV-9", 1250, "OPEN", None)
    with pytest.raises(ValueError):
        parse_invoices(spark, "")
    with pytest.raises(Exception, match="InvalidAmountError"):
        parse_invoices(spark, "Number,Amount,Date\nA,x,2024-09-01").collect()


@pytest.mark.parametrize("form", ["revolut", "mt940", "camt053", "generic"])
def test_generated_statements_read_back(spark, form):
    made = synthetic.generate(spark, 12, 0.3)
    _, good, bad = rows(spark, synthetic.statement(made, form))
    assert not bad
    want = [(r.amount_cents, r.direction, r.booking_date) for r in made.orderBy("i").collect()]
    assert [(r.amount_cents, r.direction, r.booking_date) for r in good] == want


def test_statement_texts_are_read_a_few_at_a_time(spark):
    """Parts of the written table hold a bounded number of texts, and a task holds the rows of one text."""
    text = ":20:A\n:25:DE1\n:60F:C240901EUR1,00\n:61:2409010901C{0},00NTRF//R{0}\n:86:Payment {0}\n:62F:C240901EUR2,00\n-"
    n = 2 * statements.TEXTS + 3
    files = spark.createDataFrame([(f"f{i:03d}", text.format(i + 1)) for i in range(n)], "file string, content string").coalesce(1)
    written = []
    keep = statements.materialize
    try:
        statements.materialize = lambda df, *a, **k: (written.append((df, keep(df, *a, **k))), written[-1][1])[1]
        found = statements.parse_statements(files).transactions
    finally:
        statements.materialize = keep
    assert sorted((r.file, r.amount_cents, r.id) for r in found.collect()) == sorted((f"f{i:03d}", 100 * (i + 1), f"R{i + 1}") for i in range(n))
    known, rows = written[0][1], written[1][0]
    assert len(known.inputFiles()) == 3 and max(r["count"] for r in known.groupBy("_metadata.file_path").count().collect()) == statements.TEXTS
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
