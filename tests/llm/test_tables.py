"""Mixing, sharding, components, the registered queries and the pipeline."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from tallyweave.llm import graph, mixing, queries, sharding


def targets(sizes):
    """Fill by weight, stop at the cap, share the rest out again."""
    named = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(named)}
    done, rest, open_ = {}, float(sum(sizes.values())), set(named)
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return done | share
        for s in over:
            done[s] = 3.0 * sizes[s]
            rest -= done[s]
            open_.remove(s)
    return done


def test_mixing(docs, rows, nothing):
    got = [r.asDict() for r in mixing.mix_sources(docs).collect()]
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want, taken = targets(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 64 * 6 for s in want), (taken, want)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    key = lambda r: repr((r["doc_id"], r["source"], r["size"], r["taken"]))
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mix_sources(nothing).collect() == []


def test_points_are_fair(spark):
    x = spark.sql(f"SELECT id, {mixing._bits_reversed('id')} AS x FROM range(1024)").collect()
    assert sorted(r.x for r in x) == [i << 50 for i in range(1024)]


def test_sharding(docs, rows, nothing):
    limit = 3000
    got = sharding.shard_documents(docs, limit).collect()
    size, names = defaultdict(int), set()
    for r in got:
        size[r.shard] += r.n_bytes
        names.add(r.shard)
        assert r.depth == len(r.shard) and r.oversized == (r.shard_bytes > limit)
    assert len(got) == len(rows) and all(size[r.shard] == r.shard_bytes and (r.shard_bytes <= limit or r.shard_rows == 1) for r in got)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.shard_documents(nothing).collect() == [] and {r.shard for r in sharding.shard_documents(docs, 10**9).collect()} == {""}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for e in edges for a in e if all(set(x) == {a} for x in edges if a in x)}
    assert got == {x: root(x) for e in edges for x in e if x not in alone}


def test_stages(spark, docs, nothing):
    """Each stage keeps the columns of documents and takes nulls, empty tables and columns with clashing names."""
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.materialize(stage(spark, kept, ""))
        if name != "token encoding":
            assert kept.columns == list(corpus_pipeline.COLUMNS), name
    assert kept.count() > 5 and kept.where("n_tokens <> size(token_ids)").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").collect() == []
    one = corpus_pipeline.near_dedup_stage(spark, docs, "")
    ids = [r.doc_id for r in one.collect()]
    assert ids.count(4) == 1 and 5 not in ids and ids.count(None) == 2


def test_registered():
    import __spark_entry__ as e

    names = {n.split("_")[0] for n in e.queries()}
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= names
    assert set(queries.ORACLES) <= set(queries.QUERIES) and set(e.oracle_sql()) <= set(e.queries())
