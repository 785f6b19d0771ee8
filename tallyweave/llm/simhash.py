"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

A fingerprint has 64 bits.  Cut into two segments of 32 bits, two fingerprints within two bits have a segment that
differs by one bit at most, so they share a variant of that segment with one position blanked out.  Variants are
indexed, equal variants are joined, and every candidate is verified on all 64 bits.  Variants that many distinct
fingerprints share would make all pairs of a group; there the fingerprints are linked through the 65 values within
one bit of each, which two fingerprints share exactly if they lie within two bits, so no group is ever paired out.
Equal fingerprints are one entry throughout.

Defined results: a null or empty text has fingerprint zero and links like any other; rows that repeat get the same
row again; a null doc_id gets its group's component; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, materialize, tidy
from .graph import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: Distinct fingerprints that share a variant beyond which they are linked by neighbours instead of pairs.
CROWD = 24


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of a UTF-8 text (fewer words than ``width``: one shingle; none: zero)."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        count += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = flat(batch.column(1))
            raw = data.tobytes() if len(batch) else b""
            found = np.array([fingerprint(raw[i:j], width) for i, j in zip(at, at[1:])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(_fingerprints(width)), "doc_id long, fp long")


def _variants(prints: DataFrame) -> DataFrame:
    """``(fp, key)``: segment and blanked position in the key's upper half, the segment's other bits below."""
    # A few small partitions would make all 64 variants of each fingerprint in as few tasks.
    spread = prints.repartition("fp").select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("w"))
    segment = F.when(F.col("w") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    blank = F.expr("~shiftleft(1L, w % 32)")
    return spread.select("fp", F.expr("shiftleft(cast(w as long), 32)").bitwiseOR(segment.bitwiseAND(blank)).alias("key"))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of distinct fingerprints within two bits."""
    index = _variants(prints)
    shared = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Sort-merge joins at every size, here and in ``graph``: the tables grow with the documents, and a broadcast is held by the driver.
    sized = materialize(index.join(shared.hint("merge"), "key"))
    few = sized.where(F.col("n") <= crowd).select("key", "fp")
    left, right = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
    pairs = left.join(right.hint("merge"), "key").where("a < b and bit_count(a ^ b) <= 2").select("a", "b")
    crowded = sized.where(F.col("n") > crowd).select("fp").distinct()
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    near = crowded.select("fp", F.explode(flips).alias("middle"))
    hubs = near.groupBy("middle").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("middle", "b")
    around = near.join(hubs.hint("merge"), "middle").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(around)


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row; component_id is the smallest doc_id reachable over links."""
    rows = materialize(fingerprints(docs, width))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    roots = components(links(prints.select("fp"))).withColumnsRenamed({"node": "fp"})
    rooted = prints.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    of_print = rooted.join(least.hint("merge"), "root").select("fp", "component_id")
    return rows.join(of_print.hint("merge"), "fp").select("doc_id", "fp", "component_id")
