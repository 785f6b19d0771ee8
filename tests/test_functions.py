import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import dates, fingerprint, fuzzy, money, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "a string").select(column(F.col("a")).alias("x")).first()["x"]


AMOUNTS = [
    ("1.234,56", 123456, "INCOMING"), ("1,234.56", 123456, "INCOMING"), ("(100.00)", 10000, "OUTGOING"), (" -85.50 ", 8550, "OUTGOING"), ("€ 12", 1200, "INCOMING"), ("1,5", 150, "INCOMING"),
    ("1,234", 123400, "INCOMING"), ("12.345.678", 1234567800, "INCOMING"), ("0.995", None, None), ("10.005,999", 1000600, "INCOMING"), ("", None, None), ("abc", None, None), (None, None, None), ("99999999999999999999", None, None),
]


def test_amounts(spark):
    rows = spark.createDataFrame([(a,) for a, _, _ in AMOUNTS], "a string").select("a", money.parse_amount(F.col("a")).alias("p")).collect()
    got = {r["a"]: (r["p"]["amount_cents"], r["p"]["direction"]) for r in rows}
    assert got == {a: (c, d) for a, c, d in AMOUNTS}
    assert one(spark, "1.234", lambda c: money.parse_amount(c)["error"]) == money.AMBIGUOUS
    assert one(spark, "1.234", lambda c: money.parse_amount(c, thousands_separator=".")["amount_cents"]) == 123400
    assert one(spark, "-5", lambda c: money.parse_amount(c, "INCOMING")["direction"]) == "INCOMING"
    assert one(spark, "-5", lambda c: money.signed_cents(money.parse_amount(c))) == -500
    assert one(spark, "eur", lambda c: money.format_cents(F.lit(125050), c)) == "1,250.50 EUR"


@pytest.mark.parametrize(
    "raw, want",
    [("991231", "1999-12-31"), ("240901", "2024-09-01"), ("2024-02-29T10:00", "2024-02-29"), ("31.12.2024", "2024-12-31"), ("1/2/2024", "2024-02-01"), ("2/13/2024", "2024-02-13"), ("2024/1/5", "2024-01-05"), ("Sep 3, 2024", "2024-09-03"), ("2024-02-30", None), ("x", None), ("", None)],
)
def test_dates(spark, raw, want):
    assert one(spark, raw, lambda c: dates.parse_bank_date(c)["date"].cast("string")) == want


def test_date_locale(spark):
    assert one(spark, "1/2/2024", lambda c: dates.parse_bank_date(c, "US")["date"].cast("string")) == "2024-01-02"


def test_names_and_references(spark):
    assert one(spark, "Acme Corp. GmbH & Co", text.clean_company) == "acme"
    assert one(spark, "Foo Sp. z o.o.", text.clean_company) == "foo"
    assert one(spark, "INV-2024-8801", text.strip_invoice_prefix) == "8801"
    assert one(spark, "invoice7", text.strip_invoice_prefix) == "oice7"
    assert one(spark, "SVWZ+Zahlung Rechnung 42 GmbH", text.normalize_remittance) == "42"
    assert one(spark, "pay INV-2024-001 now", text.invoice_candidates) == ["2024-001", "INV-2024-001", "001"]
    assert one(spark, "#A-99 and 2024/0012", text.invoice_candidates) == ["A-99", "2024-0012", "0012"]
    assert one(spark, "Payment INV 12", lambda c: text.reference_keys(F.lit("Bank-1"), c)) == ["bank-1", "bank1", "payment inv 12", "paymentinv12", "payment", "inv", "inv 12", "inv12"]
    assert one(spark, "INV-2024-0007", text.invoice_keys) == ["inv-2024-0007", "inv20240007", "0007"]
    assert one(spark, "x 001 y", lambda c: text.has_exact_number(c, F.lit("INV-2024-001"))) is True
    assert one(spark, "x 0019 y", lambda c: text.has_exact_number(c, F.lit("INV-2024-001"))) is False


def test_similarity():
    assert fuzzy.jaro("martha", "marhta") == pytest.approx(0.9444, abs=1e-4)
    assert fuzzy.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert fuzzy.jaro("aac21ac", "221c") == pytest.approx(0.560, abs=1e-3)
    assert fuzzy.jaro("", "") == 1.0 and fuzzy.jaro("a", "") == 0.0
    assert fuzzy.levenshtein_similarity("kitten", "sitting") == pytest.approx(1 - 3 / 7)
    assert fuzzy.levenshtein_similarity("ab", "abcdefgh", 2) == pytest.approx(0.25)
    assert fuzzy.company_similarity("acme", "acme trading") == 1.0
    assert fuzzy.company_similarity("ab", "qqqqqqqq") == 0.0


def test_remittance_ladder(spark):
    def score(reference, party, number, customer):
        df = spark.createDataFrame([(reference, party, number, customer)], "r string, p string, n string, c string")
        return df.select(fuzzy.remittance_score(F.col("r"), F.col("p"), F.col("n"), F.col("c")).alias("s")).first()["s"]

    assert score("Rent INV-2024-001", "x", "INV-2024-001", "y")["score"] == 1.0
    assert score("INV 2024 001", "x", "INV-2024-001", "y")["score"] == 0.98
    assert score("thanks", "Acme GmbH", "INV-2024-001", "Acme")["score"] == 0.70
    assert score(None, None, "INV-2024-001", "Acme")["score"] == 0.0


def test_fingerprint(spark):
    f = fingerprint.fingerprint(F.lit("de89370400440532013000 "), F.lit("2024-09-01"), F.lit(150000), F.lit("eur"), F.lit("INV-2024-001"), F.lit("E2E-9999"), F.lit("INCOMING"))
    want = hashlib.sha256(b"DE89370400440532013000|2024-09-01|150000|EUR|INV-2024-001|E2E-9999|INCOMING").hexdigest()
    assert spark.range(1).select(f.alias("f")).first()["f"] == want


def test_rounding(spark):
    assert one(spark, "0.285", lambda c: fuzzy.round_cents(c.cast("double"))) == 0.28


def test_tables_of_strings_score_as_pairs_do(monkeypatch):
    """Many pairs at once, in blocks, to the last bit, longer strings than a table takes included."""
    rng = random.Random(4)
    monkeypatch.setattr(fuzzy, "BLOCK", 37)
    monkeypatch.setattr(fuzzy, "TOKENS", 50)
    word = lambda n=12: "".join(rng.choice("ab12\x00é€𝒳 ") for _ in range(rng.randint(0, n)))
    a, b = [word() for _ in range(600)] + ["x" * 70, "customer 000000012"], [word() for _ in range(600)] + ["x" * 69 + "y", "customer 000100210"]
    assert fuzzy.jaro_winklers(a, b).tolist() == [fuzzy.jaro_winkler(x, y) for x, y in zip(a, b)]
    assert fuzzy.company_similarities(a, b).tolist() == [fuzzy.company_similarity(x, y) for x, y in zip(a, b)]
    pays, bills = [], []
    for _ in range(40):
        tokens = [rng.choice(["inv-2024-77", "2024", "0000077", "99x", "c1 x", word(6)]) for _ in range(rng.randint(0, 4))]
        pays.append(dict(counterparty="Acme", remittance="", remittance_bare="", party_clean="acme", tokens=tokens, tokens_lower=tokens, tokens_isolated=[rng.choice(["", x[-4:]]) for x in tokens]))
        number = rng.choice(["inv-2024-78", "2025", "0000078", "98x", word(6)])
        bills.append(dict(shown=number, customer=rng.choice(["", "Acmf"]), number=number, number_bare="", number_isolated=number[-4:], customer_clean="acmf"))
    pairs = [(p, i) for p in range(40) for i in range(40)]
    got = list(fuzzy.score_pairs(pays, bills, *(np.array(x) for x in zip(*pairs))))
    assert len(got) == len(pairs)
    for (p, i), found in zip(pairs, got):
        pay, bill = pays[p], bills[i]
        best = max((fuzzy.token_similarity(t, s, bill["number"], bill["number_isolated"]) for t, s in zip(pay["tokens_lower"], pay["tokens_isolated"])), default=0.0)
        near = fuzzy.company_similarity("acme", "acmf") if bill["customer"] else 0.0
        assert found[0] == (best if best >= 0.85 else 0.70 if near >= 0.80 else max(best, near * 0.6)) and found[4] == near
