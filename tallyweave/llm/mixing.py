"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents, shuffled by a hash, form a stream of words that may repeat up to three times and is cut into
blocks of equally many words.  Slot n of the schedule maps the van der Corput point of n through the cumulative
targets to a source; its rank among that source's slots names the block it takes.  A document takes the words of it
that lie in taken blocks.

Sizes, shares and ranks come from partial sums: positions inside a source and ranks inside a source are running sums
over small cells plus running sums of the cells, so that no task needs all rows of one source.

Defined results: null or empty texts have size 0 and take 0; null is a source of its own, last in order; equal rows
and ties are ordered by hash, doc_id and a hash of the text, and which of several identical rows takes words does not
change the table; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class MixOptions:
    """``weights`` repeat over the sources in order.  ``block_words`` is the size of a block."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.0
    most_epochs: int = 3
    block_words: int = 64


WORDS = r"regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def targets(sizes: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """``sizes(source, source_size)``, one row a source, to ``(source, source_no, source_size, target)``.

    Targets fill in proportion to weight up to ``most_epochs`` times the size; what exceeds that goes to the others by
    weight.  In the order of limit over weight the capped sources come first, so two running sums settle it."""
    k = len(options.weights)
    weights = F.array(*[F.lit(float(w)) for w in options.weights])
    named = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    named = named.withColumn("weight", F.element_at(weights, ((F.col("source_no") - 1) % k + 1).cast("int")))
    named = named.withColumn("cap", (F.col("source_size") * options.most_epochs).cast("double"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    filled = named.select(
        "source", "source_no", "source_size", "weight", "cap",
        (F.sum("source_size").over(every) * F.lit(options.share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("rest"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    # The level at which a source would stand if all before it are capped; the first that stays below its cap sets it.
    level = F.min(F.when(F.col("rest") * F.col("weight") / F.col("open") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "source_no", (F.col("rest") / F.col("open")).alias("level")))).over(every)
    return filled.withColumn("level", level["level"]).select(
        "source", "source_no", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target")
    )


def _bits_reversed(n: str) -> str:
    """SQL: the van der Corput point of n in base 2, times 2**60 (n below 2**32)."""
    x = f"({n})"
    for shift in (1, 2, 4, 8, 16):
        low = _lower(shift)
        x = f"(shiftright({x}, {shift}) & {low}L | shiftleft({x} & {low}L, {shift}))"
    return f"shiftleft({x}, 28)"


def _lower(shift: int) -> int:
    """A 32-bit mask of alternating runs of ``shift`` low bits."""
    return sum(((1 << shift) - 1) << i for i in range(0, 32, 2 * shift))


POINTS = 1 << 60


def _side(rows: int) -> int:
    """Cells of about as many rows as there are cells: both running sums stay at the square root of the table."""
    return max(1, math.isqrt(rows))


def schedule(spark, goal: DataFrame, n_slots: int, options: MixOptions = MixOptions()) -> DataFrame:
    """``(source_no, rank)`` for each slot: its source by the cumulative targets and its rank among that source's."""
    up = Window.orderBy("source_no")
    total = F.sum("target").over(Window.partitionBy())
    ends = goal.where("target > 0").select("source_no", (F.sum("target").over(up) / total).alias("end"))
    ends = ends.select("source_no", "end", F.coalesce(F.lag("end").over(up), F.lit(0.0)).alias("start"), (F.lead("end").over(up).isNull()).alias("final"))
    wide = 1 << 10
    point = lambda c: (F.col(c) * F.lit(float(POINTS))).cast("long")
    spans = ends.select("source_no", point("start").alias("lo"), F.when(F.col("final"), F.lit(POINTS)).otherwise(point("end")).alias("hi")).where("lo < hi")
    step = POINTS // wide
    spans = spans.withColumn("bin", F.explode(F.expr(f"sequence(lo div {step}L, (hi - 1) div {step}L)")))
    # Beyond 2**32 slots the points repeat in order, so the schedule only runs through the same fair round again.
    slots = spark.range(n_slots).select(F.col("id").alias("n"), F.expr(_bits_reversed("id % 4294967296L")).alias("x"))
    slots = slots.withColumn("bin", F.expr(f"x div {step}L"))
    placed = slots.join(spans, "bin").where("x >= lo and x < hi").select("n", "source_no", F.expr(f"n div {_side(n_slots)}L").alias("cell"))
    cells = placed.groupBy("source_no", "cell").agg(F.count("*").alias("rows"))
    ahead = Window.partitionBy("source_no").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source_no", "cell", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "cell").orderBy("n")
    ranked = placed.withColumn("row", F.row_number().over(inside))
    return ranked.join(cells, ["source_no", "cell"]).select("source_no", (F.col("base") + F.col("row") - 1).alias("rank"))


def mix_sources(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for each row."""
    spark = docs.sparkSession
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.expr(WORDS).cast("long").alias("size"), F.xxhash64(F.col("text"), F.lit(17)).alias("mark")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goal = targets(sizes.select("source", "source_size"), options)
    counted = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    goal = materialize(goal)
    n_slots = -(-int(counted["words"] * options.share) // options.block_words)
    block = options.block_words

    slots = materialize(schedule(spark, goal, n_slots, options))
    quota = slots.groupBy("source_no").agg((F.count("*") * block).alias("quota"))
    plan = goal.join(quota, "source_no", "left").select("source", "source_no", "source_size", "target", F.coalesce("quota", F.lit(0)).alias("quota"))

    n_cells = _side(counted["n"])
    shuffled = sized.withColumn("h", F.xxhash64(F.lit(31), "doc_id", "mark"))
    shuffled = shuffled.withColumn("cell", F.expr(f"pmod(shiftrightunsigned(h, 20), {n_cells}L)"))
    cells = shuffled.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "cell", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "cell").orderBy("h", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = shuffled.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = placed["source"].eqNullSafe(cells["source"]) & (placed["cell"] == cells["cell"])
    placed = placed.join(cells, same).select("doc_id", placed["source"].alias("source"), "size", "mark", (F.col("at") + F.col("base")).alias("at"))
    placed = placed.withColumn("row", F.monotonically_increasing_id())
    placed = materialize(placed.join(plan.withColumnRenamed("source", "its"), placed["source"].eqNullSafe(F.col("its"))).drop("its"))

    # A block is taken if a slot has its number; only blocks below the quota can be, so others are not spelled out.
    spread = placed.where("size > 0 and at < quota").withColumn("epoch", F.explode(F.expr(f"sequence(0, least({options.most_epochs - 1}L, (quota - 1 - at) div source_size))")))
    spread = spread.withColumn("start", F.expr("epoch * source_size + at"))
    spread = spread.withColumn("rank", F.explode(F.expr(f"sequence(start div {block}L, (start + size - 1) div {block}L)")))
    spread = spread.withColumn("words", F.expr(f"least(start + size, (rank + 1) * {block}L) - greatest(start, rank * {block}L)"))
    taken = spread.join(slots, ["source_no", "rank"]).groupBy("row").agg(F.sum("words").alias("words"))
    return placed.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "mark")
