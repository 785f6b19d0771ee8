"""Operators on documents against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tallyweave.llm import common, quality, simhash, suffixes

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_quality_rules(docs, rows, nothing):
    want = []
    for i, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        threes = Counter(zip(words, words[1:], words[2:]))
        inside = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if threes[w] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed))
    got = [tuple(r) for r in quality.quality_rules(docs).collect()]
    assert sorted(map(repr, (g[:7] for g in got))) == sorted(map(repr, want))
    assert all(not g[7] for g in got if g[6]) and {g[0]: g[7] for g in got}[4] and not {g[0]: g[7] for g in got}[10]
    assert quality.quality_rules(nothing).collect() == []
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(g[7] for g in got)


def brute_fingerprint(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, linked):
    """Least member of each item's component, by trying all pairs."""
    label = {x: x for x in items}
    changed = True
    while changed:
        changed = False
        for a in items:
            for b in items:
                if linked(a, b) and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_simhash(docs, rows, nothing):
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    distinct = sorted({p for _, p in prints})
    label = groups(distinct, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    got = [(r[0], r[1] % 2**64, r[2]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, p, least.get(label[p]))) for i, p in prints)
    assert simhash.near_duplicates(nothing).collect() == []


def test_crowded_variants_lose_no_link(spark):
    """Many distinct fingerprints around one value: with any bound on pairs the components stay the same."""
    rng = np.random.default_rng(3)
    center = 0x0123456789ABCDEF
    near = {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))} | {int(x) for x in rng.integers(0, 2**63, 20)}
    prints = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in near], "fp long")
    want = groups(sorted(near), lambda a, b: (a ^ b).bit_count() <= 2)
    for crowd in (1, 1000):
        pairs = {(r.a % 2**64, r.b % 2**64) for r in simhash.links(prints, crowd).collect()}
        assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
        assert groups(sorted(near), lambda a, b: (a, b) in pairs or (b, a) in pairs) == want


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 300, 1500):
        for symbols in (1, 2, 257):
            text = rng.integers(0, symbols, n).astype(np.uint16)
            found = suffixes.suffix_array(text)
            keys = [tuple(text[i : i + 50]) for i in found]
            assert sorted(found) == list(range(n)) and all(a <= b for a, b in zip(keys, keys[1:]))


def brute_repeats(rows):
    first = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        if i is not None:
            for p in range(len(raw) - 49):
                first[raw[p : p + 50]] = min(i, first.get(raw[p : p + 50], i))
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if i is not None and first[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield i, len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()


@pytest.mark.parametrize("crowd", [4096, 1])
def test_repeated_passages(docs, rows, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    got = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in suffixes.remove_repeats(docs).collect()]
    want = list(brute_repeats(rows))
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(w[2] for w in want) > 1000


def test_texts_without_repeats(docs, nothing):
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.doc_id: r.text for r in out.collect()}[5] == ""
    assert suffixes.without_repeats(nothing).collect() == []


def test_adjacent_common_prefixes():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 3, 900).astype(np.uint16)
    text[400:520] = text[100:220]
    ranked = suffixes.suffix_array(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(70, np.uint64)])
    packed = sum(padded[j : j + 963] << np.uint64(9 * (6 - j)) for j in range(7))
    want = []
    for a, b in zip(ranked, ranked[1:]):
        x, y = padded[a : a + 56].tolist(), padded[b : b + 56].tolist()
        want.append(next((i for i in range(56) if x[i] != y[i]), 56))
    assert suffixes.common_prefixes(packed, ranked).tolist() == want


def test_simhash_sends_no_table_to_the_driver(docs, monkeypatch):
    """Joins of tables that grow with the documents are no broadcasts, which the driver would hold."""
    from tallyweave.llm import graph

    plans = []

    def watched(df, *options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.materialize(df, *options)

    for module in (simhash, graph):
        monkeypatch.setattr(module, "materialize", watched)
    plans.append(simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
