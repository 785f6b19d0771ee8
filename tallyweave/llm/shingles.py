"""Near-duplicates by SimHash fingerprints and by exact Jaccard similarity of word shingles.

Texts whose fingerprints lie within two bits are linked as ``simhash`` links them: equal fingerprints are one, variants
with one position blanked are joined and verified on all bits.  Texts of a Jaccard similarity of 0.8 or more, whose
fingerprints may lie further apart, are linked too, with candidates from bands of minimum hashes; groups are those of
both kinds of links together.

Two texts of similarity 0.8 share a given band of 5 minimum hashes with probability 0.33, so all 32 bands miss them
with probability 3e-6, and closer texts more rarely.  Bands that many texts share would make all pairs of a group;
there each text first meets one hub of its band, and what that leaves outside the band's largest group meets the member
with the most links.  Texts that are still apart meet by the rarest fifth of their shingles, of which similar sets share
one.  That skips no pair that could join two groups.  Every link is verified on the whole sets of shingles.

Defined results: words are parted and lowered as for the SimHash fingerprints; fewer words than a shingle make one
shingle; texts without words are equal to each other; a null doc_id links its group, but is never its least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import flat, materialize, mix, slices, tidy
from .graph import components
from .simhash import LOWER, SEED

WIDTH, BANDS, ROWS = 5, 32, 5
#: Texts that share a band beyond which they meet a hub before they meet each other.
CROWD = 24
FACTORS = np.random.default_rng(11).integers(1, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SCHEMA = "doc_id long, mark long, entry long, size int, bands array<long>, fp long"


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = text.translate(LOWER).split()
    if len(words) <= width:
        found = [b" ".join(words)] if words else []
    else:
        found = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in found], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One hash for each band of minimum hashes; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1 << 10):
        np.minimum(least, (FACTORS * hashes[i : i + (1 << 10)]).min(1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out


def mark() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.col("text"), F.lit(17))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _entries(sets: list[np.ndarray]) -> np.ndarray:
    """The hash of each set; texts of equal sets are one entry."""
    return np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, data = flat(batch.column(2))
        for i, j in slices(at):
            raw = data[at[i] : at[j]].tobytes()
            texts = [raw[a:b] for a, b in zip(at[i:j] - at[i], at[i + 1 : j + 1] - at[i])]
            sets = [shingles(t) for t in texts]
            prints = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
            entry = _entries(sets)
            size = np.array([len(s) for s in sets], np.int32)
            columns = [*(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array(entry), pa.array(size), _lists(list(map(bands, sets))), pa.array(prints)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "entry", "size", "bands", "fp"])


def _bits(wanted: DataFrame) -> np.ndarray:
    """A table of bits with the low bits of each wanted entry set.  It is kept under 16 MB: with more entries it lets
    more others pass, which the join drops."""
    reach = min(27, max(12, (64 * wanted.count()).bit_length()))
    bits = wanted.selectExpr(f"shiftright(entry & {(1 << reach) - 1}L, 3) byte", "shiftleft(1, cast(entry & 7 as int)) bit")
    found = bits.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (reach - 3), np.uint8)
    table[found["byte"].to_numpy()] = found["bits"].to_numpy()
    return table


def _sets(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = flat(batch.column(0))
            for i, j in slices(at):
                raw = data[at[i] : at[j]].tobytes()
                sets = [shingles(raw[a:b]) for a, b in zip(at[i:j] - at[i], at[i + 1 : j + 1] - at[i])]
                entry = _entries(sets)
                low = entry & (8 * len(table) - 1)
                keep = np.flatnonzero(table[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                yield pa.RecordBatch.from_arrays([pa.array(entry[keep]), _lists([sets[k] for k in keep])], ["entry", "shingles"])

    return run


def _sets_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``(entry, shingles)`` for each wanted entry, made again from the texts."""
    found = docs.select("text").mapInArrow(tidy(_sets(_bits(wanted))), "entry long, shingles array<long>")
    return materialize(found.join(wanted.hint("merge"), "entry", "left_semi").dropDuplicates(["entry"]))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of entries whose sets of shingles have a Jaccard similarity of 0.8 or more."""
    left, right = (sets.withColumnsRenamed({"entry": c, "shingles": f"of_{c}"}) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return materialize(both.where("9 * size(array_intersect(of_a, of_b)) >= 4 * (size(of_a) + size(of_b))").select("a", "b"))


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    pairs = materialize(pairs.where("5 * least(m, n) >= 4 * greatest(m, n)").select("a", "b").distinct())
    wanted = materialize(pairs.select(F.col("a").alias("entry")).union(pairs.select("b")).distinct())
    return _similar(pairs, _sets_of(wanted, docs))


def _rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with the root of each entry; one without an edge is its own."""
    found = rows.join(components(edges).withColumnRenamed("node", "entry"), "entry", "left")
    return materialize(found.withColumn("root", F.coalesce("root", "entry")))


def _outside(rooted: DataFrame) -> DataFrame:
    """The rows outside the largest group of their band: of two members in different groups one at least is there."""
    main = rooted.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    return rooted.join(main, "band").where("root <> main").drop("main")


def _rarest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members(entry, size, root)`` with each shingle of the rarest fifth of its set, and its place ``at`` in the set
    in the order of rarity.  A shingle of one member alone has a place, but no row, as nothing can meet it."""
    spread = sets.join(members, "entry").select("entry", "size", "root", F.explode("shingles").alias("shingle"))
    often = spread.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    order = Window.partitionBy("entry").orderBy("n", "shingle")
    many = F.count("*").over(Window.partitionBy("entry"))
    placed = spread.join(often, "shingle").withColumn("at", F.col("size") - many + F.row_number().over(order) - 1)
    return materialize(placed.where("5 * at <= size").select("entry", "size", "root", "shingle", "at"))


def _rare_pairs(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` in different groups, one outside its band's largest, that may be similar.

    Where k shingles must be shared, the rarest shared one has at least k - 1 behind it in either set (prefix filter).
    So an entry with many shingles of its own meets nothing, however many share its bands."""
    members = rooted.select("entry", "size", "root").distinct()
    rare = _rarest(members, sets)
    stray = rare.join(_outside(rooted).select("entry").distinct(), "entry", "left_semi").selectExpr("shingle", "entry a", "size m", "root r", "at i")
    other = rare.selectExpr("shingle", "entry b", "size n", "root s", "at j")
    fits = "r <> s and 9 * (m - i) >= 4 * (m + n) and 9 * (n - j) >= 4 * (m + n)"
    found = stray.join(other, "shingle").where(fits).selectExpr("least(a, b) a", "greatest(a, b) b")
    return materialize(found.distinct())


def links(rows: DataFrame, docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of entries that share a band and are similar.

    The sets of ``docs`` are made again for the entries that are paired: all of them would be more than the texts."""
    index = rows.select("entry", "size", "bands").dropDuplicates(["entry"]).select("entry", "size", F.explode("bands").alias("band"))
    index = index.repartition("band")
    shared = index.groupBy("band").agg(F.count("*").alias("many"), F.min(F.struct(F.xxhash64("entry", "band"), "entry", "size")).alias("hub")).where("many > 1")
    sized = materialize(index.join(shared, "band"))
    few, crowded = sized.where(F.col("many") <= crowd), sized.where(F.col("many") > crowd)
    left = few.select("band", F.col("entry").alias("a"), F.col("size").alias("m"))
    right = few.select("band", F.col("entry").alias("b"), F.col("size").alias("n"))
    around = crowded.selectExpr("hub.entry a", "entry b", "hub.size m", "size n").where("a <> b")
    found = _verified(left.join(right, "band").where("a < b").select("a", "b", "m", "n").union(around), docs)
    if crowded.isEmpty():
        return found
    rooted = _rooted(crowded.select("band", "entry", "size"), found)
    open_bands = materialize(_outside(rooted).select("band").distinct())
    if open_bands.isEmpty():
        return found
    rooted = materialize(rooted.join(open_bands, "band", "left_semi"))
    sets = _sets_of(materialize(rooted.select("entry").distinct()), docs)
    # The member with the most links so far stands in the middle of its band: who is outside meets it next.
    ends = found.select(F.col("a").alias("entry")).union(found.select("b")).groupBy("entry").agg(F.count("*").alias("links"))
    middle = rooted.join(ends, "entry").groupBy("band").agg(F.max(F.struct("links", "entry", "size", "root")).alias("mid"))
    meet = _outside(rooted).join(middle, "band").where("root <> mid.root and 5 * least(size, mid.size) >= 4 * greatest(size, mid.size)")
    found = found.union(_similar(materialize(meet.selectExpr("entry a", "mid.entry b").distinct()), sets))
    return found.union(_similar(_rare_pairs(_rooted(rooted.drop("root"), found), sets), sets))


def print_links(rows: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` of entries whose fingerprints are equal or, by ``simhash.links``, within two bits."""
    # Each fingerprint stands for itself as its least entry.
    owners = rows.select("fp", "entry").distinct()
    prints = materialize(owners.groupBy("fp").agg(F.min("entry").alias("least")))
    equal = owners.join(prints.hint("merge"), "fp").where("entry <> least").selectExpr("entry a", "least b")
    left, right = prints.selectExpr("fp a", "least of_a"), prints.selectExpr("fp b", "least of_b")
    near = simhash.links(prints.select("fp")).join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return equal.union(near.where("of_a <> of_b").selectExpr("of_a a", "of_b b"))


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``(doc_id, mark, root, component_id)`` for each row; groups differ by root, component_id is their smallest doc_id."""
    rows = materialize(docs.select(F.col("doc_id").cast("long"), mark().alias("mark"), "text").mapInArrow(tidy(_sketched), SCHEMA))
    entries = rows.groupBy("entry").agg(F.min("doc_id").alias("doc"))
    edges = print_links(rows).union(links(rows, docs, crowd))
    rooted = entries.join(components(edges).withColumnRenamed("node", "entry"), "entry", "left").withColumn("root", F.coalesce("root", "entry"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    of_entry = rooted.join(least, "root").select("entry", "root", "component_id")
    return rows.select("doc_id", "mark", "entry").join(of_entry, "entry").drop("entry")
