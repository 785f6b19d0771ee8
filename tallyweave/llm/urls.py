"""URL filters by a sorted digest array.

Rules are ``host + path`` strings.  Their 64-bit xxhash keys stand sorted in an array, in a file that Python workers
map into memory; for each url the strings that a rule could have (ends of its host at a dot and starts of its path, of
the lengths that rules have) are hashed, probed with one vectorised binary search, and every hit is confirmed on the
stored string, so collisions never decide.

One array goes to executors as a broadcast only up to ``MAX_RULE_BYTES``.  More rules make more arrays, one for each
prefix of the keys, and each distinct string goes to the array of its prefix; a url takes the best of its hits.

Defined results: a null url or one without ``://`` has empty host and path, no rule and the default verdict; repeated
pages give repeated rows; of equal rules with different actions ``block`` wins; a rule without host fits nothing; other
columns are ignored; no pages, no rows; no rules, all default.  The work for a url grows with its length and the number
of lengths that rules have, however many dots and slashes it holds.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, tidy, tidy_groups

MAX_RULE_BYTES, SHARD_BYTES = 64 << 20, 16 << 20
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
#: (host, path, action), as stated for the pages of the synthetic tables.
PAGE_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def lowered(host: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as the contract cuts them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return lowered(host), rest[:cut]


def named(host: str, path: str) -> bytes:
    """A rule's string.  A NUL parts host from path: "ab/" as host "ab" differs from host "a" with another path."""
    return lowered(host).encode("utf-8", "surrogatepass") + b"\0" + path.encode("utf-8", "surrogatepass")


class Shapes:
    """The lengths in bytes that rules have: for each length of host those of its paths."""

    def __init__(self, pairs):
        self.of: dict[int, list[int]] = {}
        for host, path in sorted(set(pairs)):
            if host:
                self.of.setdefault(host, []).append(path)

    def strings(self, host: str, path: str) -> list[bytes]:
        """The strings of all rules that could fit."""
        h, p, out = host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass"), []
        for n, lengths in self.of.items():
            if n == len(h) or n < len(h) and h[-n - 1] == 46:
                out += [h[-n:] + b"\0" + p[:m] for m in lengths if m <= len(p)]
        return out


class DigestArray:
    """Sorted xxhash keys with the strings and actions they stand for."""

    def __init__(self, keys: np.ndarray, offsets: np.ndarray, text: bytes, block: np.ndarray):
        self.keys, self.offsets, self.text, self.block = keys, offsets, text, block

    @classmethod
    def build(cls, rules) -> DigestArray:
        """From pairs of a rule's string and whether it blocks."""
        actions: dict[bytes, bool] = {}
        for name, block in rules:
            actions[name] = actions.get(name, False) or block
        names = sorted(actions, key=lambda s: (xxhash.xxh64_intdigest(s), s))
        keys = np.array([xxhash.xxh64_intdigest(s) for s in names], np.uint64)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in names])]).astype(np.int64)
        return cls(keys, offsets, b"".join(names), np.array([actions[s] for s in names], bool))

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.offsets.nbytes + len(self.text) + self.block.nbytes

    def mapped(self) -> DigestArray:
        """The same with keys mapped from a file of this worker, unlinked at once: it goes with the mapping."""
        if not len(self.keys):
            return self
        fd, path = tempfile.mkstemp(suffix=".keys")
        with os.fdopen(fd, "wb") as out:
            out.write(self.keys.tobytes())
        keys = np.memmap(path, np.uint64, "r")
        os.unlink(path)
        return DigestArray(keys, self.offsets, self.text, self.block)

    def find(self, names: list[bytes]) -> np.ndarray:
        """For each string the index of its rule, or -1."""
        digests = np.array([xxhash.xxh64_intdigest(s) for s in names], np.uint64)
        left = np.searchsorted(self.keys, digests, "left")
        right = np.searchsorted(self.keys, digests, "right")
        out = np.full(len(names), -1, np.int64)
        for i in np.flatnonzero(right > left):
            for k in range(left[i], right[i]):
                if self.text[self.offsets[k] : self.offsets[k + 1]] == names[i]:
                    out[i] = k
        return out


def _best(hits) -> tuple[str | None, bool]:
    """Of pairs of a rule's string and whether it blocks: the longest as text, and its action."""
    name, block = max(hits, key=lambda h: (len(h[0].decode("utf-8", "surrogatepass")), h[0]))
    return name.replace(b"\0", b"", 1).decode("utf-8", "surrogatepass"), block


def _judged(rules, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, shapes = rules.value
        index = index.mapped()
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            strings = [shapes.strings(*x) for x in parts]
            flat = [s for x in strings for s in x]
            found = index.find(flat)
            owner = np.repeat(np.arange(len(parts)), [len(x) for x in strings])
            hits: dict[int, list[tuple[bytes, bool]]] = {}
            for j in np.flatnonzero(found >= 0):
                hits.setdefault(int(owner[j]), []).append((flat[j], bool(index.block[found[j]])))
            best = [_best(hits[i]) if i in hits else (None, None) for i in range(len(parts))]
            host, path = zip(*parts) if parts else ((), ())
            verdict = [default if block is None else "block" if block else "allow" for _, block in best]
            columns = [pa.array(x, pa.string()) for x in (host, path, [r for r, _ in best], verdict)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", "host", "path", "rule", "verdict"])

    return tidy(run)


def _prefixes(names: list[bytes], bits: int) -> pa.Array:
    keys = np.array([xxhash.xxh64_intdigest(s) for s in names], np.uint64)
    return pa.array((keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [split_url(u) for u in batch.column("url").to_pylist()]
        host, path = zip(*parts) if parts else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("row"), pa.array(host, pa.string()), pa.array(path, pa.string())], ["page_id", "row", "host", "path"])


def _probes(shapes, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = [shapes.value.strings(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            rows, flat = np.repeat(batch.column("row").to_numpy(), [len(x) for x in strings]), [s for x in strings for s in x]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), _prefixes(flat, bits), pa.array(flat, pa.binary())], ["row", "shard", "name"])

    return tidy(run)


def _named_rules(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [named(h or "", p or "") for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([_prefixes(names, bits), pa.array(names, pa.binary()), pa.array([a == "block" for a in batch.column(2).to_pylist()], pa.bool_())], ["shard", "name", "block"])

    return run


def _found(rules: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    index = DigestArray.build(zip(map(bytes, rules["name"]), rules["block"])).mapped()
    names = list(map(bytes, probes["name"]))
    at = index.find(names)
    return pd.DataFrame({"name": [n for n, k in zip(names, at) if k >= 0], "block": [bool(index.block[k]) for k in at if k >= 0]})


def _chosen(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [_best([(bytes(h["name"]), h["block"]) for h in hits]) if hits else (None, None) for hits in batch.column("hits").to_pylist()]
            verdict = [default if block is None else "block" if block else "allow" for _, block in best]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array([r for r, _ in best], pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def _sharded(pages: DataFrame, rules: DataFrame, size: int, default: str) -> DataFrame:
    """One digest array for each prefix of the keys; distinct strings are probed once, wherever they came from."""
    spark, bits = pages.sparkSession, max(1, (size // SHARD_BYTES).bit_length())
    lengths = rules.select(F.octet_length("host"), F.octet_length("path")).distinct().toLocalIterator()
    shapes = spark.sparkContext.broadcast(Shapes((h or 0, p or 0) for h, p in lengths))
    cut = materialize(pages.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_split, "page_id long, row long, host string, path string"))
    probes = materialize(cut.mapInArrow(_probes(shapes, bits), "row long, shard long, name binary"))
    known = rules.select("host", "path", "action").mapInArrow(_named_rules(bits), "shard long, name binary, block boolean")
    hits = known.groupBy("shard").cogroup(probes.select("shard", "name").distinct().groupBy("shard")).applyInPandas(tidy_groups(_found), "name binary, block boolean")
    # A url has as many hits at most as rules have lengths.
    of_row = probes.join(hits, "name").groupBy("row").agg(F.collect_list(F.struct("name", "block")).alias("hits"))
    return cut.join(of_row, "row", "left").mapInArrow(_chosen(default), SCHEMA)


def filter_urls(pages: DataFrame, rules=PAGE_RULES, default: str = "allow", max_rule_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """Judge each page's ``url`` by the longest rule that fits.  ``rules``: triples, or a DataFrame (host, path, action)."""
    spark: SparkSession = pages.sparkSession
    pages = pages.selectExpr("cast(page_id as long) page_id", "url")
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, action string") if sum(len(h) + len(p) for h, p, _ in rules) > max_rule_bytes else tuple(rules)
    if isinstance(rules, DataFrame):
        size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 18), F.lit(0))).first()[0]
        if size > max_rule_bytes:
            return _sharded(pages, rules, size, default)
        rules = [tuple(r) for r in rules.select("host", "path", "action").toLocalIterator()]
    names = [(named(h or "", p or ""), a == "block") for h, p, a in rules]
    shapes = Shapes((n.index(b"\0"), len(n) - n.index(b"\0") - 1) for n, _ in names)
    return pages.mapInArrow(_judged(spark.sparkContext.broadcast((DigestArray.build(names), shapes)), default), SCHEMA)
