"""Sharding by extendible hashing, in DataFrame functions only.

The directory is indexed by the leading bits of a row's hash.  A bucket over the byte limit splits on the next bit
until each fits.  The bytes of all prefixes of one stretch of bits come from one aggregate, so a round of splitting
settles many bits at once; the next round looks only at the buckets that are still too large.

The first 32 bits hash doc_id and text; the rest also hash the row's position, so that rows equal in both can part.

Defined results: a null or empty text has 0 bytes, a null doc_id hashes like a value; a single row over the limit gets
a shard of its own with ``oversized`` true; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BITS = 62
ROUND = 10


def shard_documents(docs: DataFrame, byte_limit: int = 8 << 20) -> DataFrame:
    """``(doc_id, n_bytes, shard, depth, shard_bytes, shard_rows, oversized)`` for each row; ``shard`` is the prefix in
    binary (the whole table: an empty string), unique among shards and prefix-free."""
    high = F.xxhash64(F.lit(11), F.col("doc_id"), F.col("text")).bitwiseAND(F.lit(0xFFFFFFFF))
    low = F.xxhash64(F.lit(13), F.col("doc_id"), F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 30) - 1))
    rows = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.shiftleft(high, 30).bitwiseOR(low).alias("h"))
    )
    found, left, start = [], rows, 0
    while True:
        stop = min(start + ROUND, BITS)
        cells = left.groupBy(F.shiftright("h", BITS - stop).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        levels = cells.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(start), F.lit(stop))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {stop} - depth)"))
        totals = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("cell").alias("one"))
        fits = (F.col("bytes") <= byte_limit) | (F.col("rows") == 1) | (F.col("depth") == BITS)
        # Bytes fall with depth, so the bucket that stays is the first on the way down that fits.
        of_cell = levels.select("cell", "depth", "prefix").join(totals.where(fits).select("depth", "prefix", F.col("bytes").alias("all_bytes"), F.col("rows").alias("all_rows")), ["depth", "prefix"])
        settled = of_cell.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "all_bytes", "all_rows")).alias("s")).select("cell", "s.*")
        directory = materialize(settled)
        at = F.shiftright("h", BITS - stop)
        found.append(left.join(directory, at == directory["cell"]).select("doc_id", "n_bytes", "depth", "prefix", F.col("all_bytes").alias("shard_bytes"), F.col("all_rows").alias("shard_rows")))
        over = cells.where(F.col("bytes") > byte_limit).join(directory, "cell", "left_anti").select("cell")
        if stop == BITS or over.isEmpty():
            break
        left = materialize(left.join(over, at == over["cell"], "left_semi"))
        start = stop
    out = reduce(DataFrame.unionByName, found)
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return out.select("doc_id", "n_bytes", name.alias("shard"), "depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > byte_limit).alias("oversized"))
