import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import assign, ledger
from tallyweave.plans import service
from tallyweave.plans.reconcile import confirm_by_user, reconcile
from tallyweave.schemas import INVOICE, TRANSACTION, MatcherOptions
from tallyweave.server import answer


def tx(i, cents, reference=None, day="2024-09-02", currency="EUR", direction="INCOMING", name=None, iban=None, bank=None, source="x"):
    return dict(id=i, booking_date=day, amount_cents=cents, currency=currency, direction=direction, counterparty_name=name, counterparty_iban=iban, reference=reference, bank_transaction_id=bank, source_format=source)


def inv(i, number, cents, customer="Acme", day="2024-09-01", due=None, currency="EUR", status="OPEN", iban=None):
    return dict(id=i, invoice_number=number, amount_cents=cents, currency=currency, issue_date=day, due_date=due, status=status, customer_name=customer, customer_iban=iban)


def frame(spark, rows, schema, order):
    text = schema.replace(" date", " string") + f", {order} bigint"
    names = [c.strip().split()[0] for c in text.replace("map<string,string>", "map").split(",")]
    df = spark.createDataFrame([tuple(r.get(n) if n != order else i for n in names) for i, r in enumerate(rows)], text)
    return df.withColumns({c: F.to_date(c) for c in names if c.endswith("_date")})


def run(spark, txs, invs, **options):
    report = reconcile(frame(spark, txs, TRANSACTION, "tx_ord"), frame(spark, invs, INVOICE, "inv_ord"), MatcherOptions(**options))
    return report, [(r.transaction.id, r.invoice.id if r.invoice else None, r.status, r.level, r.confidence, r.fee_cents) for r in report.matches.orderBy("match_no").collect()]


def test_defaults():
    assert (MatcherOptions().fee_cents, MatcherOptions().fee_percent) == (2500, 0.02)
    assert (MatcherOptions(fee_tolerance_percentage=0.03).fee_cents, MatcherOptions(fee_tolerance_percentage=0.03).fee_percent) == (0, 0.03)


def test_phases_and_report(spark):
    txs = [
        tx("a", 350000, "INV-2024-8802"), tx("b", 98500, "INV-2024-8801"), tx("c", 60000, "Partial INV-2024-1"), tx("d", 777, "nothing"), tx("e", 5, direction="OUTGOING"), tx("a", 350000, "INV-2024-8802"),
        tx("f", 4200, "thanks", name="Metrics Ltd"), tx("g", 4300, "hello", iban="de 12", name="q"), tx("h", 100, "INV-VOID-1"), tx("e", 5, direction="OUTGOING"),
    ]
    invs = [
        inv("i1", "INV-2024-8801", 100000), inv("i2", "INV-2024-8802", 350000), inv("i3", "INV-2024-1", 100000), inv("i4", "ZZ-77", 4200, "Metrics GmbH"), inv("i5", "QQ-55", 4300, "Other", iban="DE12"), inv("i6", "INV-VOID-1", 100, status="VOID"),
    ]
    report, got = run(spark, txs, invs)
    assert got == [
        ("a", "i2", "MATCHED", "EXACT_REFERENCE", 1.0, None), ("c", "i3", "PARTIAL_MATCH", "PARTIAL_MATCH", 0.95, None),
        ("f", "i4", "MATCHED", "EXACT_METRICS", 0.98, None), ("g", "i5", "MATCHED", "EXACT_METRICS", 0.98, None), ("b", "i1", "REVIEW_NEEDED", "FEE_TOLERANCE", 0.9, 1500),
        ("d", None, "UNMATCHED", "NONE", 0.0, None), ("h", None, "UNMATCHED", "NONE", 0.0, None), ("e", None, "UNMATCHED", "NONE", 0.0, None), ("e", None, "UNMATCHED", "NONE", 0.0, None),
    ]
    totals = report.totals_by_currency().collect()
    assert [tuple(r) for r in totals] == [("EUR", 350000 + 60000 + 4200 + 4300, 777 + 100 + 10, 1500)]
    assert report.summary().first().asDict() == {"matched_count": 4, "review_needed_count": 1, "unmatched_count": 4, "total_transactions": 9, "total_invoices": 6}
    assert [(r.id, r.reason, r.metadata["reason"]) for r in report.unmatched_invoices.collect()] == [("i6", "INVOICE_NOT_OPEN", "INVOICE_NOT_OPEN")]
    sure = report.confirmed()
    assert [tuple(r)[1:] for r in sure.totals_by_currency().collect()] == [(518500, 887, 1500)]
    for posted in (ledger.match_postings(sure.matches), ledger.suspense_postings(sure.matches)):
        assert ledger.is_balanced(posted, "match_no")
    assert not ledger.is_balanced(ledger.match_postings(sure.matches).where("direction = 'DEBIT'"))
    lines = ledger.match_postings(sure.matches).where("tx_id = 'b'").orderBy("line_no").collect()
    assert [(r.direction, r.amount_cents) for r in lines] == [("DEBIT", 98500), ("DEBIT", 1500), ("CREDIT", 100000)]
    chosen = spark.createDataFrame([("b",)], "tx_id string")
    assert confirm_by_user(report.matches, chosen).where("status = 'REVIEW_NEEDED'").isEmpty()


def test_conflicts(spark):
    two_payers = [tx("a", 5000, "rent", name="Acme One"), tx("b", 5000, "rent", name="Acme One")]
    _, got = run(spark, two_payers, [inv("i", "N-1", 5000, "Acme One")])
    assert [(g[0], g[1], g[2]) for g in got] == [("a", "i", "REVIEW_NEEDED"), ("b", "i", "REVIEW_NEEDED")]
    two_bills = [inv("i", "INV-2024-51", 10000, "Acme"), inv("j", "INV-2024-52", 10000, "Acme")]
    _, got = run(spark, [tx("a", 8500, "invoice for Acme", name="Acme")], two_bills)
    assert got == [("a", "i", "REVIEW_NEEDED", "FEE_TOLERANCE", 0.65, 1500)]
    report, got = run(spark, [tx("a", 8500, "INV-2024-51 INV-2024-52", name="Acme")], two_bills)
    assert got == [("a", "i", "REVIEW_NEEDED", "FEE_TOLERANCE", 0.65, 1500)]
    notes = report.matches.first().discrepancies
    assert notes == ["Ambiguous match: multiple invoices qualify within fee tolerance window", "Conflicting candidates: INV-2024-51 (100.00 EUR), INV-2024-52 (100.00 EUR)", "Suggested candidate: INV-2024-51 with fee deduction of 15.00 EUR"]
    assert not report.confirmed(True).matches.where("status = 'REVIEW_NEEDED'").isEmpty()


def test_tolerances(spark):
    bill = [inv("i", "INV-2024-7", 10000, "Acme")]
    assert run(spark, [tx("a", 9710, "INV-2024-7")], bill, fee_tolerance_percentage=0.03)[1][0][2:] == ("REVIEW_NEEDED", "FEE_TOLERANCE", 0.9, 290)
    assert run(spark, [tx("a", 9600, "INV-2024-7", source="stripe")], bill, fee_tolerance_percentage=0.03)[1][0][2] == "UNMATCHED"
    assert run(spark, [tx("a", 10000, "INV-2024-7", day="2024-12-24")], bill)[1][0][2] == "UNMATCHED"
    assert run(spark, [], bill)[0].totals_by_currency().first().matched_cents == 0
    assert [r.currency for r in run(spark, [], [])[0].totals_by_currency().collect()] == ["EUR"]


def test_first_come_equals_the_serial_choice(spark):
    rng = random.Random(3)
    wishes = {t: rng.sample(range(25), rng.randint(1, 4)) for t in range(40)}
    free, want = set(range(25)), {}
    for t in sorted(wishes):
        for i in wishes[t]:
            if i in free:
                free.remove(i)
                want[t] = i
                break
    edges = [(t, k, str(i)) for t, w in wishes.items() for k, i in enumerate(w)]
    rng.shuffle(edges)
    got = assign.first_come(spark.createDataFrame(edges, "tx_ord long, key_ord int, invoice_id string")).collect()
    assert {r.tx_ord: int(r.invoice_id) for r in got} == want


def test_components(spark):
    chain = [(i, str(i)) for i in range(30)] + [(i + 1, str(i)) for i in range(29)] + [(100, "x")]
    got = assign.bipartite_components(spark.createDataFrame(chain, "tx_ord long, invoice_id string")).select("tx_ord", "component").distinct().collect()
    assert {r.component for r in got if r.tx_ord < 30} == {0} and {r.component for r in got if r.tx_ord == 100} == {100}


def test_http(spark):
    import json

    assert answer(spark, "GET", "/health") == (200, {"status": "ok"})
    assert answer(spark, "POST", "/v1/parse", b"{}")[0] == 400 and answer(spark, "GET", "/x")[0] == 404
    csv = "date,amount,currency,counterparty,reference\n2024-09-02,10.00,EUR,Acme,INV-2024-77\nbad,1.00,EUR,x,y"
    status, reply = answer(spark, "POST", "/v1/parse", json.dumps({"content": csv}).encode())
    assert (status, reply["count"], len(reply["rejectedRows"])) == (200, 1, 1)
    bills = [{"id": "i1", "invoiceNumber": "INV-2024-77", "amountCents": 1000, "currency": "EUR", "issueDate": "2024-09-01", "customerName": "Acme"}]
    status, reply = answer(spark, "POST", "/v1/match?format=generic-csv", json.dumps({"statementContent": csv, "invoices": bills}).encode())
    assert status == 200 and reply["matchedCount"] == 1 and reply["matches"][0]["invoice"]["invoiceNumber"] == "INV-2024-77"
    assert reply["totalsByCurrency"]["EUR"]["matchedAmountCents"] == 1000


def test_mapping():
    assert service.parse_mapping("date=when, amount=val") == {"date": "when", "amount": "val"}


def test_stream(spark, tmp_path):
    from tallyweave.streaming.batches import read_transactions, reconcile_stream

    bills = frame(spark, [inv("i", "INV-2024-7", 10000)], INVOICE, "inv_ord")
    frame(spark, [tx("a", 10000, "INV-2024-7"), tx("a", 10000, "INV-2024-7")], TRANSACTION, "tx_ord").drop("tx_ord").write.parquet(str(tmp_path / "in"))
    seen = []
    query = reconcile_stream(read_transactions(spark, str(tmp_path / "in")), bills, lambda r, n: seen.append(r.summary().first().matched_count), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert seen == [1]


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    rng = random.Random(5)
    txs = [tx(f"t{i}", rng.choice([1000, 2000]), f"INV-2024-{rng.randint(100, 110)}", name=f"Firm {rng.randint(1, 3)}") for i in range(30)]
    invs = [inv(f"i{i}", f"INV-2024-{100 + i}", rng.choice([1000, 2000]), f"Firm {i % 3 + 1}") for i in range(11)]
    a, b = frame(spark, txs, TRANSACTION, "tx_ord").repartition(parts), frame(spark, invs, INVOICE, "inv_ord").repartition(parts)
    got = [(r.transaction.id, r.invoice and r.invoice.id, r.status) for r in reconcile(a, b).matches.orderBy("match_no").collect()]
    assert got == [g[:3] for g in run(spark, txs, invs)[1]]


def serial_choice(rows):
    """The candidates one after the other: (payment, invoice, status, confidence, place, first note) of what is settled."""
    from tallyweave.operators.resolve import CLOSE, LEVELS

    rows = sorted(rows, key=lambda r: (-r["confidence"], -LEVELS[r["level"]], r["tx_ord"], r["pool_ord"]))
    paid, taken, out = set(), set(), []
    for lead in rows:
        if lead["tx_id"] in paid or lead["invoice_id"] in taken:
            continue
        close = [r for r in rows if abs(lead["confidence"] - r["confidence"]) <= CLOSE]
        payers = [r for r in close if r["invoice_id"] == lead["invoice_id"] and r["tx_id"] != lead["tx_id"] and r["tx_id"] not in paid]
        bills = [r for r in close if r["tx_id"] == lead["tx_id"] and r["invoice_id"] != lead["invoice_id"] and r["invoice_id"] not in taken]
        taken.add(lead["invoice_id"])
        claim = f"Ambiguous match: multiple transactions claim invoice {lead['invoice_number']} with close confidence scores"
        status, confidence, notes = "REVIEW_NEEDED" if payers or bills else lead["status"], lead["confidence"], lead["discrepancies"]
        if payers:
            notes = [f"{claim} ({lead['tx_id']}, {', '.join(f'{r["tx_id"]} (score: {r["confidence"]:.2f})' for r in payers)})", *notes]
        elif bills and lead["level"] == "FEE_TOLERANCE":
            named = ", ".join(f"{r['invoice_number']} ({r['invoice_amount'] / 100:.2f} EUR)" for r in (lead, *bills))
            confidence, notes = 0.65, ["Ambiguous match: multiple invoices qualify within fee tolerance window", f"Conflicting candidates: {named}", f"Suggested candidate: {lead['invoice_number']} with fee deduction of {lead['fee_cents'] / 100:.2f} EUR"]
        elif bills:
            notes = ["Ambiguous match: payment matches multiple invoices with close confidence scores", *notes]
        out.append((lead["tx_id"], lead["invoice_id"], status, confidence, 0, tuple(notes)))
        out += [(r["tx_id"], r["invoice_id"], "REVIEW_NEEDED", r["confidence"], n, (f"{claim} ({r['tx_id']}, {lead['tx_id']})", *r["discrepancies"])) for n, r in enumerate(payers, 1)]
        paid |= {lead["tx_id"], *(r["tx_id"] for r in payers)}
    return out


def test_resolve_equals_the_serial_choice_in_no_single_task(spark, monkeypatch):
    """One component of many candidates is settled as by the serial choice, in few rounds, not group by group."""
    from tallyweave.operators import resolve as r

    rng, rows = random.Random(2), {}
    for t, i in [(n, n) for n in range(120)] + [(n + 1, n) for n in range(119)] + [(rng.randrange(120), rng.randrange(120)) for _ in range(150)]:
        fee = rng.choice([None, 150])
        rows[t, i] = dict(
            tx_ord=t, tx_id=f"t{t}", tx_amount=1000 + t, tx_currency="EUR", inv_ord=i, invoice_id=f"i{i}", invoice_number=f"N-{i}", invoice_amount=2000 + i, invoice_currency="EUR", confidence=rng.choice([0.63, 0.65, 0.7, 0.86, 0.9]),
            level="FEE_TOLERANCE" if fee else rng.choice(["EXACT_METRICS", "FUZZY_REFERENCE"]), status="MATCHED", discrepancies=[f"n{t}"], fee_cents=fee, requires_force=None, pool_ord=(1 if fee else 0, i, 0),
        )
    schema = "tx_ord long, tx_id string, tx_amount long, tx_currency string, inv_ord long, invoice_id string, invoice_number string, invoice_amount long, invoice_currency string, confidence double, level string, status string, discrepancies array<string>, fee_cents long, requires_force boolean, pool_ord struct<kind: int, a: long, b: long>"
    plans, keep = [], r.materialize
    monkeypatch.setattr(r, "materialize", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    found = r.resolve(spark.createDataFrame([tuple(x.values()) for x in rows.values()], schema))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    got = [(x.tx_id, x.invoice_id, x.status, x.confidence, x.place, tuple(x.discrepancies)) for x in found.collect()]
    assert sorted(got) == sorted(serial_choice(rows.values()))
    assert len(plans) < 30 and not any("FlatMapGroups" in p for p in plans)


@pytest.mark.parametrize("few", [0, 100, 1 << 21])
def test_resolve_in_rounds_of_narrow_rows_or_at_once(spark, monkeypatch, few):
    """Rounds compare numbers, without texts, and the last few candidates need no rounds: with the serial result."""
    from tallyweave.operators import resolve as r

    rng, rows = random.Random(2), {}
    for t, i in [(n, n) for n in range(120)] + [(n + 1, n) for n in range(119)] + [(rng.randrange(120), rng.randrange(120)) for _ in range(150)]:
        fee = rng.choice([None, 150])
        rows[t, i] = dict(
            tx_ord=t, tx_id=f"t{t}", tx_amount=1000 + t, tx_currency="EUR", inv_ord=i, invoice_id=f"i{i}", invoice_number=f"N-{i}", invoice_amount=2000 + i, invoice_currency="EUR", confidence=rng.choice([0.63, 0.65, 0.7, 0.86, 0.9]),
            level="FEE_TOLERANCE" if fee else rng.choice(["EXACT_METRICS", "FUZZY_REFERENCE"]), status="MATCHED", discrepancies=[f"n{t}"], fee_cents=fee, requires_force=None, pool_ord=(1 if fee else 0, i, 0),
        )
    schema = "tx_ord long, tx_id string, tx_amount long, tx_currency string, inv_ord long, invoice_id string, invoice_number string, invoice_amount long, invoice_currency string, confidence double, level string, status string, discrepancies array<string>, fee_cents long, requires_force boolean, pool_ord struct<kind: int, a: long, b: long>"
    seen, one = [], r._round
    monkeypatch.setattr(r, "FEW", few)
    monkeypatch.setattr(r, "_round", lambda left: (seen.append(left.columns), one(left))[1])
    found = r.resolve(spark.createDataFrame([tuple(x.values()) for x in rows.values()], schema))
    got = [(x.tx_id, x.invoice_id, x.status, x.confidence, x.place, tuple(x.discrepancies)) for x in found.collect()]
    assert sorted(got) == sorted(serial_choice(rows.values()))
    assert bool(seen) == (few < len(rows)) and all(c == ["no", "tx_ord", "bill", "confidence"] for c in seen)
