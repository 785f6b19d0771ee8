"""Quality rules by repetition coverage.

Words, lines and word windows of a batch of documents are hashed at once with rolling hashes; sorting the hashes
shows which windows and lines occur again inside their document, and running sums turn them into covered characters.

Defined results: a null or empty text has no words, so ``base_failed`` is true and ``kept`` false; rows that repeat
give the same row again; other columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SEPARATOR, RollingHash, flat, mix, prefix, slices, tidy

SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, text_chars long, dup_line_chars long, dup5_chars long, dup7_chars long,"
    " dup10_chars long"
)


@dataclass(frozen=True)
class QualityRules:
    """Limits of the verdict; each is a share of the text's characters in words (lines: of all its characters)."""

    min_words: int = 50
    max_repeat_word_percent: int = 50
    ngrams: tuple[int, ...] = (5, 7, 10)
    max_ngram_share: tuple[float, ...] = (0.50, 0.45, 0.40)
    max_line_share: float = 0.50
    max_symbol_share: float = 0.10


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more, and is it not the first."""
    n = len(key)
    many, later = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        later[order[1:]] = same
        many[order[1:]] = same
        many[order[:-1]] |= same
    return many, later


class Measure:
    """Counts for the documents of one slice of a batch."""

    def __init__(self, rules: QualityRules):
        self.rules, self.hash = rules, RollingHash()
        self.symbol = np.zeros(256, bool)
        self.symbol[list(SYMBOLS)] = True

    def covered(self, words: np.ndarray, doc: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
        """Marks the words inside windows of n words that their document holds twice or more."""
        count = len(words)
        mark = np.zeros(count + 1, np.int64)
        if count >= n:
            rolled = words[: count - n + 1].copy()
            for j in range(1, n):
                rolled *= np.uint64(RollingHash.BASE)
                rolled += words[j : count - n + 1 + j]
            start = np.flatnonzero(np.arange(n - 1, count) < last[: count - n + 1])
            many, _ = _again(mix(rolled[start] ^ mix(doc[start].astype(np.uint64) + np.uint64(n))))
            hit = start[many]
            mark = np.bincount(hit, minlength=count + 1) - np.bincount(hit + n, minlength=count + 1)
        return np.cumsum(mark[:-1]) > 0

    def __call__(self, at: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
        """``at``: offsets from 0 of the documents in ``data``."""
        n_docs, size = len(at) - 1, len(data)
        inside = ~SEPARATOR[data]
        edge = np.zeros(size + 1, bool)
        edge[at] = True
        before = np.concatenate([[False], inside[:-1]]) if size else np.zeros(0, bool)
        after = np.concatenate([inside[1:], [False]]) if size else np.zeros(0, bool)
        first = np.flatnonzero(inside & (~before | edge[:-1])) if size else np.zeros(0, np.int64)
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1 if size else np.zeros(0, np.int64)
        per_doc = np.searchsorted(first, at)
        n_words = np.diff(per_doc)
        doc = np.repeat(np.arange(n_docs), n_words)
        last = per_doc[1:][doc]
        points = prefix((data & 0xC0) != 0x80)
        word_points = points[end] - points[first]
        symbols = np.diff(prefix(self.symbol[data])[at])
        sums = self.hash.sums(data)
        words = mix(self.hash.ranges(sums, first, end) ^ (end - first).astype(np.uint64))

        breaks = np.flatnonzero(data == 10)
        line_start, line_end = np.sort(np.concatenate([at[:-1], breaks + 1])), np.sort(np.concatenate([breaks, at[1:]]))
        line_doc = np.repeat(np.arange(n_docs), np.diff(np.searchsorted(breaks, at)) + 1)
        full = np.searchsorted(first, line_end) > np.searchsorted(first, line_start)
        line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
        key = mix(self.hash.ranges(sums, line_start, line_end) ^ mix((line_end - line_start).astype(np.uint64)))
        _, later = _again(mix(key ^ mix(line_doc.astype(np.uint64))))
        dup_lines = np.bincount(line_doc[later], minlength=n_docs)
        dup_line_chars = np.bincount(line_doc[later], (points[line_end] - points[line_start])[later], n_docs).astype(np.int64)

        def per(mask: np.ndarray, value: np.ndarray | None = None) -> np.ndarray:
            return np.diff(prefix(mask if value is None else np.where(mask, value, 0))[per_doc])

        repeat = per(self.covered(words, doc, last, 3))
        word_chars = np.diff(prefix(word_points)[per_doc])
        dups = [per(self.covered(words, doc, last, n), word_points) for n in self.rules.ngrams]
        chars = np.diff(points[at])
        r = self.rules
        failed = (n_words < r.min_words) | (100 * repeat > r.max_repeat_word_percent * n_words)
        bad = (dup_line_chars > r.max_line_share * chars) | (symbols > r.max_symbol_share * word_chars)
        for share, dup in zip(r.max_ngram_share, dups):
            bad |= dup > share * word_chars
        return [n_words, word_chars, symbols, dup_lines, repeat, failed, ~failed & ~bad, chars, dup_line_chars, *dups]


def _measured(rules: QualityRules):
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(rules)
        for batch in batches:
            at, data = flat(batch.column(1))
            for i, j in slices(at):
                found = measure(at[i : j + 1] - at[i], data[at[i] : at[j]])
                columns = [pa.array(x, pa.bool_() if x.dtype == bool else pa.int64()) for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names)

    return run


def _passing(rules: QualityRules, at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(rules)
        for batch in batches:
            at, data = flat(batch.column(at_text))
            for i, j in slices(at):
                kept = measure(at[i : j + 1] - at[i], data[at[i] : at[j]])[6]
                yield batch.slice(i, j - i).filter(pa.array(kept, pa.bool_()))

    return run


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows whose text the rules keep, all columns as they are."""
    return docs.mapInArrow(tidy(_passing(rules, docs.columns.index("text"))), docs.schema)


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Counts and verdict of each document (``doc_id``, ``text``)."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(_measured(rules)), SCHEMA)
