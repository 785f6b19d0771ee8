"""Names, references and tokens as Column expressions.

Patterns spell out ASCII word edges and the wide notion of white space that the formats use, since Java's ``\\b`` and
``\\s`` differ from both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms dropped from company names.
LEGAL_FORMS = (
    "gmbh", "ug", "ag", "llc", "ltd", "limited", "inc", "corp", "corporation", "sas", "sarl", "bv", "nv", "sp z o o",
    "spzoo", "sa", "plc", "co", "cie",
)
# Words that say nothing about an invoice.
STOP_WORDS = (
    "eref", "svwz", "kref", "mref", "iban", "bic", "inv", "rech", "rechnung", "rechnungsnr", "rechnungsnummer",
    "rechnung-nr", "invoice", "bill", "payment", "zahlung", "ueberweisung", "überweisung", "sepa", "sepa-ueberweisung",
    "credit", "transfer", "wire", "ref", "reference", "kdnr", "kundennummer", "from", "to", "fuer", "für",
)

SPACE = r"\s\x0b\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WORD = "A-Za-z0-9_"


def _edge(first: str) -> str:
    """An ASCII word edge before ``first``: a letter outside ASCII starts a word only after a word character."""
    return f"(?<![{WORD}])" if first.isascii() else f"(?<=[{WORD}])"


def _words(words: tuple[str, ...]) -> str:
    plain = [w.replace(" ", f"[{SPACE}]+") for w in words if w[0].isascii()]
    odd = [w for w in words if not w[0].isascii()]
    ways = [f"{_edge('a')}(?:{'|'.join(plain)})", *(f"{_edge(w[0])}{w}" for w in odd)]
    return f"(?i)(?:{'|'.join(ways)})(?![{WORD}])"


def filled(c: Column) -> Column:
    """Empty strings count as missing."""
    return F.nullif(c, F.lit(""))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def alphanumeric(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z0-9]", "")


def clean_company(c: Column) -> Column:
    """Lower case without punctuation and legal forms."""
    bare = F.regexp_replace(F.lower(c), r"[.,/#!$%^&*;:{}=\-_`~()]", " ")
    return squeeze(F.regexp_replace(bare, _words(LEGAL_FORMS), " "))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value as a variable.  Written in place, an expression that uses another one several
    times, which does the same, grows with each step until planning and compiling it take longer than the data."""
    return F.transform(F.array(value), then)[0]


def strip_invoice_prefix(c: Column) -> Column:
    """An invoice number without its prefix and year."""
    gap = rf"[-_/#{SPACE}]*"
    kinds = "inv|rech|rechnung|re|bill|po|order|invnr"
    out = F.regexp_replace(c, "^#+", "")
    out = F.regexp_replace(out, f"^(?i:{kinds}){gap}(?:202[0-9]{gap})?", "")
    out = F.regexp_replace(out, f"^202[0-9]{gap}", "")
    return trim(F.regexp_replace(out, rf"^[-_/#{SPACE}]+", ""))


def normalize_remittance(c: Column) -> Column:
    """Remittance text without bank tags, punctuation, stop words and legal forms."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)(?<![{WORD}])(eref|svwz|kref|mref|pref|cred|debt)\+", " ")
    out = F.regexp_replace(out, "(?i)/(eref|svwz|kref|mref|benm|iban|bic)/", " ")
    out = F.lower(F.regexp_replace(out, r"\?[0-9]{2}", " "))
    out = F.regexp_replace(out, r"[.,/#!$%^&*;:{}=\-_`~()\\+?<>]", " ")
    return squeeze(F.regexp_replace(F.regexp_replace(out, _words(STOP_WORDS), " "), _words(LEGAL_FORMS), " "))


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def invoice_candidates(c: Column) -> Column:
    """Strings in a text that look like invoice references, upper-cased, in order of first sight."""
    c = F.coalesce(c, F.lit(""))
    dashed = lambda x: F.upper(F.regexp_replace(x, f"[{SPACE}/]", "-"))
    isolated = lambda x: F.upper(strip_invoice_prefix(x))
    keep = lambda x: F.length(x) >= 2
    prefix = rf"(?<![{WORD}])(?i:inv|re|rech|bill|po|order|invnr)[-_/#{SPACE}]*"
    prefixed = prefix + rf"([A-Za-z0-9\-_/]{{3,30}})(?![{WORD}])(?<=[{WORD}])"
    one = F.zip_with(_found(c, prefixed, 1), _found(c, prefixed), lambda a, m: F.concat(F.array(dashed(a), dashed(m)), F.filter(F.array(isolated(m)), keep)))
    both = lambda x, y: F.concat(F.array(x), F.filter(F.array(y), keep))
    two = F.transform(_found(c, r"#([A-Za-z0-9\-_]{3,25})", 1), lambda x: both(F.upper(x), isolated(x)))
    numbers = rf"(?<![{WORD}])(202[0-9][-/_][0-9]{{3,8}})(?![{WORD}])"
    three = F.transform(_found(c, numbers, 1), lambda x: both(F.regexp_replace(x, "[/_]", "-"), isolated(x)))
    return F.array_distinct(F.flatten(F.concat(one, two, three)))


def _keyed(c: Column) -> Column:
    """A key and its alphanumeric form, in order; too short ones are dropped."""
    none = F.array().cast("array<string>")
    both = lambda clean, bare: F.concat(F.array(clean), F.when((F.length(bare) >= 3) & (bare != clean), F.array(bare)).otherwise(none))
    return let(F.lower(trim(c)), lambda clean: F.when(F.length(clean) >= 3, let(alphanumeric(clean), lambda bare: both(clean, bare))).otherwise(none))


def reference_keys(bank_id: Column, reference: Column) -> Column:
    """Keys of a transaction, the strongest first: its bank id, its reference, the parts of it, code-like stretches."""
    ref = F.coalesce(reference, F.lit(""))
    # Fixed pattern: letters, then digits in groups.
    codes = _found(ref, rf"(?i)[a-z]{{2,}}[{SPACE}_\-]*\d+(?:[{SPACE}_\-]*\d+)*")
    sources = F.concat(F.array(F.coalesce(bank_id, F.lit("")), ref), F.split(ref, rf"[{SPACE},;/:|()]+"), codes)
    return F.array_distinct(F.flatten(F.transform(sources, _keyed)))


def invoice_keys(number: Column) -> Column:
    """Keys under which an invoice number or id is registered."""
    none = F.array().cast("array<string>")
    one = lambda ok, key: F.when(ok, F.array(key)).otherwise(none)
    more = lambda clean, bare: let(alphanumeric(strip_invoice_prefix(clean)), lambda isolated: F.concat(F.array(clean), one((F.length(bare) >= 3) & (bare != clean), bare), one((F.length(isolated) >= 4) & (isolated != bare), isolated)))
    return let(F.lower(trim(number)), lambda clean: F.when(F.length(clean) >= 3, F.array_distinct(let(alphanumeric(clean), lambda bare: more(clean, bare)))).otherwise(none))


def is_token(c: Column) -> Column:
    return (F.length(c) >= 2) & ~c.rlike(r"^\d{4}$") & ~F.lower(c).isin(*STOP_WORDS)


def _tokens(c: Column) -> Column:
    parts = lambda whole: F.concat(F.array(whole, alphanumeric(whole)), F.split(whole, "[^a-z0-9]+"))
    return let(F.lower(trim(c)), lambda whole: F.when(is_token(whole), F.filter(parts(whole), is_token)).otherwise(F.array().cast("array<string>")))


def _company_tokens(c: Column) -> Column:
    return let(clean_company(F.coalesce(c, F.lit(""))), lambda name: F.concat(_tokens(name), F.filter(F.split(name, " "), is_token)))


def invoice_tokens(number: Column, id_: Column, customer: Column) -> Column:
    return F.array_distinct(F.concat(_tokens(number), _tokens(strip_invoice_prefix(number)), _tokens(id_), _company_tokens(customer)))


def transaction_tokens(reference: Column, counterparty: Column, bank_id: Column) -> Column:
    ref = F.coalesce(reference, F.lit(""))
    found = F.transform(invoice_candidates(ref), lambda x: F.concat(_tokens(x), _tokens(strip_invoice_prefix(x))))
    return F.array_distinct(F.concat(F.flatten(found), _tokens(ref), _tokens(normalize_remittance(ref)), _company_tokens(counterparty), _tokens(F.coalesce(bank_id, F.lit("")))))


def has_exact_number(reference: Column, number: Column) -> Column:
    """Does the reference hold the invoice number, its alphanumeric form, or its isolated part as a word?"""
    ref, inv = F.lower(F.coalesce(reference, F.lit(""))), F.lower(trim(number))
    isolated = F.lower(strip_invoice_prefix(inv))
    padded = F.concat(F.lit(" "), ref, F.lit(" "))
    quoted = F.concat(F.lit(r"[^a-z0-9]\Q"), F.replace(isolated, F.lit(r"\E"), F.lit("")), F.lit(r"\E[^a-z0-9]"))
    as_word = (F.length(isolated) >= 3) & F.rlike(padded, quoted)
    bare = alphanumeric(inv)
    return (ref != "") & (number != "") & (F.contains(ref, inv) | ((F.length(bare) >= 4) & F.contains(alphanumeric(ref), bare)) | as_word)


def has_exact_reference(reference: Column, bank_id: Column, number: Column, id_: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(reference, F.lit("")), F.lit(" "), F.coalesce(bank_id, F.lit(""))))
    number, id_ = F.lower(number), F.lower(id_)
    bare = alphanumeric(number)
    return ((F.length(number) >= 3) & F.contains(text, number)) | ((F.length(id_) >= 3) & F.contains(text, id_)) | ((F.length(bare) >= 4) & F.contains(alphanumeric(text), bare))


def plain_iban(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, f"[{SPACE}]", ""))
