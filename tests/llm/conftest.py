import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, taken string"


def corpus():
    """Null, empty, blank and very long texts, copies, near copies, shared passages, repeated rows, ties, odd bytes."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(400)] + ["über", "日本語", "naïve"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = said(120), said(20)
    texts = {0: None, 1: "", 2: " \t\n\x0b\x0c\r", 3: "one", 4: base, 5: base, 6: base + " end", 7: said(60) + " " + passage + " " + said(60), 8: passage + said(30), 9: said(20_000), 10: "x y z " * 60, 11: "line one here\n" * 9 + "tail\n\nline one here", 12: "#" * 30 + " a b", 13: "-" * 300, 14: "nul\0byte " + "é" * 70, 15: "é" * 70 + " nul"}
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, 7, "clash") for i, t in texts.items()]
    rows += [(4, base, "en", "s1", None, 7, "clash"), (None, base, None, "s2", None, None, None), (None, None, None, None, None, None, None)]
    return rows + [(100 + i, said(rng.randint(1, 90)), "de", f"s{i % 4}", 1, 1, "") for i in range(20)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
