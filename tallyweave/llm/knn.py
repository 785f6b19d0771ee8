"""Exact top-k search by inner product with one KD-tree per shard.

A tree over a bounded sample of rows splits space at medians of the widest dimension; every row goes to the region it
lies in, and regions of many rows are dealt to several shards by hash.  A shard's own tree splits further and keeps
tight bounding boxes; equal vectors are one point with its smallest ids.  A query walks a tree best-first by the largest
inner product its box allows, and stops where no box can reach the kth score known so far.  That score is propagated:
each query first searches the shard it lies in, and then only the regions whose box can reach the score found there.

Products are exact: in floating point where every sum stays below 2**53, in 64-bit integers below 2**63, and in unbounded
integers beyond; bounds of boxes are rounded outwards.

Defined results: vectors null, empty, or with null or non-finite components take no part, as query or candidate; null
ids neither; only vectors of equal length meet; every row stands for itself, so rows that repeat an id or a vector are
candidates for each other, and each query row has its ranks; a score outside 64 bits counts as the nearest 64-bit
number; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy, tidy_group, tidy_groups

FOUND = "query_row long, query_id long, vec_id long, score long"
LEAST, MOST = -(2**63), 2**63 - 1
#: Bytes of a component that 64 bits do not hold.
WIDE = 136


@dataclass(frozen=True)
class SearchOptions:
    """``sample_rows`` bounds the rows that place the regions, ``regions`` their number; every row is indexed."""

    k: int = 5
    scale: int = 256
    shard_rows: int = 8192
    block_queries: int = 512
    blocks_together: int = 32
    leaf: int = 64
    sample_rows: int = 16_384
    regions: int = 1024


def quantized(v: list, scale: int) -> bytes | None:
    """floor(scale * x) for each component, packed; None if a component is null or not finite."""
    x = np.array(v, np.float64)
    if not np.isfinite(x).all():
        return None
    if np.abs(x).max() < 2**52 / scale:
        return np.floor(x * scale).astype(np.int64).tobytes()
    # Beyond 2**52 a double is whole, and the product may leave its range.
    return packed([int(c) * scale if abs(c) >= 2**52 else int(np.floor(c * scale)) for c in x.tolist()])


def packed(v: list[int]) -> bytes:
    if max(v) <= MOST and min(v) >= LEAST:
        return np.array(v, np.int64).tobytes()
    return b"".join(c.to_bytes(WIDE, "little", signed=True) for c in v)


def matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """Rows of integers: int64, or Python's own where one needs more bits."""
    if all(len(v) == 8 * dim for v in vectors):
        return np.frombuffer(b"".join(vectors), np.int64).reshape(len(vectors), dim)
    out = np.empty((len(vectors), dim), object)
    for i, v in enumerate(vectors):
        out[i] = np.frombuffer(v, np.int64).tolist() if len(v) == 8 * dim else [int.from_bytes(v[j : j + WIDE], "little", signed=True) for j in range(0, len(v), WIDE)]
    return out


def floats(x: np.ndarray) -> np.ndarray:
    if x.dtype != object:
        return x.astype(np.float64)
    limit = 2**1023
    return np.array([float(c) if -limit < c < limit else np.inf if c > 0 else -np.inf for c in x.ravel()], np.float64).reshape(x.shape)


def upper_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and box no less than the largest inner product; all are floats."""
    with np.errstate(all="ignore"):
        reach = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        slack = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T * ((queries.shape[1] + 8) * 2.0**-52)
        return np.nan_to_num(reach + slack, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max())))


def products(points: np.ndarray, near: np.ndarray, q: np.ndarray, near_q: np.ndarray, top: int) -> list[int]:
    """Inner products in 64 bits; ``near`` are the points as floats, ``top`` bounds the products' absolute sums."""
    if top < 2**53:
        return (near @ near_q).astype(np.int64).tolist()
    if top < 2**63:
        return (points.astype(np.int64) @ q.astype(np.int64)).tolist()
    return [min(max(sum(map(int.__mul__, map(int, p), map(int, q))), LEAST), MOST) for p in points]


class Tree:
    """Median splits with tight boxes over distinct vectors; ``ids`` lists of each point's smallest (id, row), ascending."""

    def __init__(self, points: np.ndarray, ids: list[list[tuple[int, int]]], leaf: int):
        self.points, self.ids = points, ids
        self.low, self.high, self.kids, self.rows = [], [], [], []
        self._grow(np.arange(len(points)), leaf)
        self.low, self.high = np.stack(self.low), np.stack(self.high)
        self.leaves = [None if r is None else (points[r], floats(points[r]), largest(points[r])) for r in self.rows]

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        here, mine = len(self.rows), self.points[rows]
        low, high = floats(mine.min(0)), floats(mine.max(0))
        self.low.append(low), self.high.append(high), self.kids.append(None), self.rows.append(None)
        if len(rows) <= leaf:
            self.rows[here] = rows
            return here
        with np.errstate(all="ignore"):
            order = np.argsort(mine[:, np.argmax(np.nan_to_num(high - low, nan=np.inf))], kind="stable")
        half = len(rows) // 2
        self.kids[here] = (self._grow(rows[order[:half]], leaf), self._grow(rows[order[half:]], leaf))
        return here

    def search(self, queries: np.ndarray, own: list[int], floor: list[int], k: int) -> list[list[tuple[int, int]]]:
        """For each query the (-score, id) of its best, sorted; scores under its ``floor`` may be missing."""
        near = floats(queries)
        reach, out = upper_bounds(near, self.low, self.high), []
        for q, near_q, me, least, bound in zip(queries, near, own, floor, reach.tolist()):
            best: list[tuple[int, int]] = []
            heap, size = [(-bound[0], 0)], largest(q) * len(q)
            while heap and -heap[0][0] >= least:
                node = heapq.heappop(heap)[1]
                if self.kids[node] is not None:
                    for child in self.kids[node]:
                        if bound[child] >= least:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                rows = self.rows[node]
                exact, rounded, top = self.leaves[node]
                for i, score in zip(rows.tolist(), products(exact, rounded, q, near_q, size * top)):
                    if score >= least:
                        best += [(-score, x) for x, row in self.ids[i] if row != me][:k]
                if len(best) >= k:
                    best = sorted(best)[:k]
                    least = max(least, -best[-1][0])
            out.append(sorted(best)[:k])
        return out


def tree_of(rows: pd.DataFrame, options: SearchOptions) -> Tree:
    points: dict[bytes, list[tuple[int, int]]] = {}
    for x in zip(map(bytes, rows["v"]), zip(rows["vec_id"].tolist(), rows["row"].tolist())):
        points.setdefault(x[0], []).append(x[1])
    return Tree(matrix(list(points), int(rows["dim"].iloc[0])), [sorted(x)[: options.k + 1] for x in points.values()], options.leaf)


def _quantized(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is not None and v and (held := quantized(v, scale)) is not None:
                    out.append((i, len(v), held))
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], ["vec_id", "dim", "v"])

    return tidy(run)


class Regions:
    """Median splits of space, placed on a sample; for each dimension of vectors a list of nodes (axis, cut, left, right),
    where an axis under 0 marks region -1 - axis."""

    def __init__(self, sample: list[tuple[int, bytes]], rows: int, options: SearchOptions):
        self.nodes: dict[int, list[tuple]] = {}
        self.count = 0
        wanted = min(options.regions, -(-rows // options.shard_rows))
        for dim in sorted({d for d, _ in sample}):
            points = floats(matrix([v for d, v in sample if d == dim], dim))
            self.nodes[dim] = nodes = []
            self._grow(points, max(16, -(-len(sample) // max(1, wanted))), nodes)

    def _grow(self, points: np.ndarray, most: int, nodes: list) -> int:
        here = len(nodes)
        nodes.append(None)
        with np.errstate(all="ignore"):
            axis = int(np.argmax(np.nan_to_num(points.max(0) - points.min(0), nan=0)))
        cut = float(np.partition(points[:, axis], (len(points) - 1) // 2)[(len(points) - 1) // 2])
        left = points[:, axis] <= cut
        if len(points) <= most or left.all():
            nodes[here] = (-1 - self.count, 0.0, 0, 0)
            self.count += 1
        else:
            nodes[here] = (axis, cut, self._grow(points[left], most, nodes), self._grow(points[~left], most, nodes))
        return here

    def place(self, points: np.ndarray, dim: int) -> np.ndarray:
        """The region of each row; lengths that the sample lacks share a last one each."""
        nodes, out = self.nodes.get(dim), np.full(len(points), self.count, np.int64)
        todo = [(0, np.arange(len(points)))] if nodes else []
        while todo:
            at, rows = todo.pop()
            axis, cut, left, right = nodes[at]
            if axis < 0:
                out[rows] = -1 - axis
            else:
                low = points[rows, axis] <= cut
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


def _placed(regions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = batch.column("dim").to_numpy(), batch.column("v").to_pylist()
            region = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                region[rows] = regions.value.place(floats(matrix([vectors[i] for i in rows], dim)), dim)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "dim", "v")), pa.array(region)], ["row", "vec_id", "dim", "v", "region"])

    return tidy(run)


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The box of each region in a task."""
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        of: dict[tuple[int, int], list[bytes]] = {}
        for d, r, v in zip(*(batch.column(c).to_pylist() for c in ("dim", "region", "v"))):
            of.setdefault((d, r), []).append(v)
        for key, vectors in of.items():
            x = floats(matrix(vectors, key[0]))
            low, high = held.get(key, (x[0], x[0]))
            held[key] = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
    rows = [(d, r, low.tobytes(), high.tobytes()) for (d, r), (low, high) in held.items()]
    columns = zip(*rows) if rows else ((), (), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["dim", "region", "low", "high"])


def _united(rows: pd.DataFrame) -> pd.DataFrame:
    both = [np.stack([np.frombuffer(b, np.float64) for b in rows[c]]) for c in ("low", "high")]
    return pd.DataFrame({"dim": rows["dim"].iloc[:1], "region": rows["region"].iloc[:1], "low": [both[0].min(0).tobytes()], "high": [both[1].max(0).tobytes()]})


def _at_home(options: SearchOptions):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The best of each query inside its own shard."""
        asked, found = rows[rows["asked"]], []
        if len(asked):
            queries = matrix(list(map(bytes, asked["v"])), int(rows["dim"].iloc[0]))
            best = tree_of(rows, options).search(queries, asked["row"].tolist(), [LEAST] * len(asked), options.k)
            found = [(r, q, i, -s) for r, q, b in zip(asked["row"].tolist(), asked["vec_id"].tolist(), best) for s, i in b]
        return pd.DataFrame(found, columns=["query_row", "query_id", "vec_id", "score"]).astype("int64")

    return run


def _reaching(boxes, options: SearchOptions):
    """Queries to blocks of those that a region's box can serve, for each of the region's shards but the query's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            dims = np.array(column["dim"])
            for dim in np.unique(dims).tolist():
                if dim not in boxes.value:
                    continue
                regions, parts, low, high = boxes.value[dim]
                mine = np.flatnonzero(dims == dim)
                for i in range(0, len(mine), options.block_queries):
                    rows = mine[i : i + options.block_queries]
                    bound = upper_bounds(floats(matrix([column["v"][r] for r in rows], dim)), low, high)
                    floor = [column["floor"][r] for r in rows]
                    out = []
                    for region, part, reach in zip(regions, parts, bound.T.tolist()):
                        serves = [r for r, b, f in zip(rows.tolist(), reach, floor) if f is None or b >= f]
                        for p in range(part):
                            go = [r for r in serves if (column["region"][r], column["part"][r]) != (region, p)]
                            if go:
                                pick = lambda c: np.array([LEAST if column[c][r] is None else column[c][r] for r in go], np.int64).tobytes()  # noqa: E731, B023
                                out.append((dim, region, p, pick("row"), pick("vec_id"), pick("floor"), [column["v"][r] for r in go]))
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
                    columns = zip(*out) if out else ((),) * len(kinds)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["dim", "region", "part", "rows", "ids", "floors", "vectors"])

    return tidy(run)


def _searched(options: SearchOptions):
    def run(shard: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(shard) and len(blocks):
            tree = tree_of(shard, options)
            for rows, ids, floors, vectors in zip(*(blocks[c] for c in ("rows", "ids", "floors", "vectors"))):
                rows, ids, floors = (np.frombuffer(x, np.int64).tolist() for x in (rows, ids, floors))
                best = tree.search(matrix(list(map(bytes, vectors)), int(shard["dim"].iloc[0])), rows, floors, options.k)
                found += [(r, q, i, -s) for r, q, b in zip(rows, ids, best) for s, i in b]
        return pd.DataFrame(found, columns=["query_row", "query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: str = "vec_id % 50 = 0", options: SearchOptions = SearchOptions()) -> DataFrame:
    """``vectors(vec_id, embedding)`` to ``(query_id, rank, vec_id, score)``; ``queries`` is a predicate on vec_id."""
    context = vectors.sparkSession.sparkContext
    valid = vectors.selectExpr("cast(vec_id as long) vec_id", "embedding").mapInArrow(_quantized(options.scale), "vec_id long, dim int, v binary")
    valid = materialize(valid.withColumn("row", F.monotonically_increasing_id()))
    count = valid.count()
    sample = valid.select("dim", "v", F.xxhash64("v", "row").alias("h")).orderBy("h").limit(options.sample_rows).select("dim", "v")
    regions = context.broadcast(Regions([(r["dim"], bytes(r["v"])) for r in sample.collect()], count, options))
    valid = materialize(valid.mapInArrow(_placed(regions), "row long, vec_id long, dim int, v binary, region long"))
    boxes = valid.mapInArrow(tidy(_boxes), "dim int, region long, low binary, high binary").groupBy("dim", "region").applyInPandas(_united, "dim int, region long, low binary, high binary")
    sizes = valid.groupBy("dim", "region").agg(F.ceil(F.count("*") / F.lit(options.shard_rows)).cast("long").alias("parts"))
    # As many rows as there are regions, plus the lengths of vectors that the sample lacks.
    table = materialize(boxes.join(sizes, ["dim", "region"]))
    valid = valid.join(table.select("dim", "region", "parts"), ["dim", "region"]).withColumn("part", F.expr("pmod(xxhash64(row, 5), parts)")).withColumn("asked", F.expr(queries))
    begun = materialize(valid.groupBy("dim", "region", "part").applyInPandas(tidy_group(_at_home(options)), FOUND))
    known = begun.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == options.k)
    bounded = valid.where("asked").join(known.select(F.col("query_row").alias("row"), "floor"), "row", "left")
    of: dict[int, tuple] = {}
    for r in table.orderBy("dim", "region").collect():
        names, parts, low, high = of.setdefault(r["dim"], ([], [], [], []))
        names.append(r["region"]), parts.append(r["parts"]), low.append(np.frombuffer(r["low"])), high.append(np.frombuffer(r["high"]))
    of = {d: (n, p, np.stack(low), np.stack(high)) for d, (n, p, low, high) in of.items()}
    blocks = bounded.select("row", "vec_id", "dim", "v", "region", "part", "floor").mapInArrow(_reaching(context.broadcast(of), options), "dim int, region long, part long, rows binary, ids binary, floors binary, vectors array<binary>")
    blocks = materialize(blocks.withColumn("block", F.monotonically_increasing_id()))
    # A shard that very many blocks ask for is searched in several tasks, each with some of the blocks.
    key = ["dim", "region", "part"]
    load = materialize(blocks.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(options.blocks_together)).cast("long").alias("times")))
    left = valid.select(*key, "row", "vec_id", "v").join(load, key).withColumn("turn", F.explode(F.expr("sequence(0L, times - 1)"))).drop("times")
    right = blocks.join(load, key).withColumn("turn", F.expr("pmod(xxhash64(block), times)")).drop("times")
    rest = left.groupBy(*key, "turn").cogroup(right.groupBy(*key, "turn")).applyInPandas(tidy_groups(_searched(options)), FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    best = begun.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.k)
    return best.select("query_id", "rank", "vec_id", "score")
