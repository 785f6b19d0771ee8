"""The pipeline's stages against plain Python."""

import random

import corpus_pipeline
from tallyweave.llm import shingles


def sets_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def groups(texts):
    """For each text the index of its group's first, by all pairs."""
    sets, root = [sets_of(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and similar(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def near_copies():
    """Texts with copies at similarities from 0.6 to 1, and a large group of them."""
    rng = random.Random(3)
    said = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for n, copies in ((100, 8), (160, 8), (90, 8), (200, 60)):
        base = said(n)
        texts.append(" ".join(base))
        for _ in range(copies):
            other = list(base)
            for _ in range(rng.randint(1, n // 25)):
                other[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(other))
    return texts + [" ".join(said(60)) for _ in range(20)]


def test_near_dedup_reaches_similar_texts(spark):
    texts = near_copies()
    root = groups(texts)
    want = {i for i, r in enumerate(root) if i == r}
    assert len(want) < len(texts) - 30
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == sorted(want)
    for crowd in (2, 1000):
        got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs, crowd).collect()}
        assert got == dict(enumerate(root)), crowd


def repeated_ids():
    """Ids of two texts: both least of their groups, one of them, in one group, and repeated rows among them."""
    rng = random.Random(5)
    said = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    a, b, c, d, e = (said(80) for _ in range(5))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b + ["end"]), (0, c), (4, c + ["end"]), (4, d), (5, d), (6, e), (6, e + ["end"]), (7, e)]
    return [(i, " ".join(t)) for i, t in rows] + [(None, " ".join(a)), (None, " ".join(said(60))), (8, ""), (9, None)]


def survivors(rows):
    """The ids and texts that the near-dedup may keep, group by group; rows without id apart."""
    least = {}
    for (i, t), r in zip(rows, groups([t for _, t in rows])):
        if i is not None:
            least.setdefault(r, set()).add((i, t))
    return [{(i, t) for i, t in group if i == min(group, key=lambda x: x[0])[0]} for group in least.values()], [x for x in rows if x[0] is None]


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rows = repeated_ids()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()]
    least, unnamed = survivors(rows)
    assert sorted(x[1] for x in got if x[0] is None) == sorted(x[1] for x in unnamed)
    named = [x for x in got if x[0] is not None]
    assert len(named) == len(least) and all(sum(x in group for x in named) == 1 for group in least)


def test_run_gives_the_least_of_each_group(spark, tmp_path):
    """No passages shared across groups: each group's least passes whole, as often as the mix takes it."""
    from tokenizers import Tokenizer

    rng = random.Random(9)
    said = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    a, b, c = said(100), said(120), said(90)
    rows = [(i, " ".join(t)) for i, t in [(1, a), (1, b), (2, a[:-1]), (3, ["x", *b]), (0, c), (4, c), (5, said(80)), (5, said(70)), (6, said(20))]]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    root = groups([t for _, t in rows])
    tokenizer = Tokenizer.from_file(corpus_pipeline.queries.tokenizer_path())
    least = [min(x for x, at in zip(rows, root) if at == r) for r in {r for (_, t), r in zip(rows, root) if len(t.split()) >= 50}]
    left = spark.createDataFrame([(i, t, "s") for i, t in least], "doc_id long, text string, source string")
    times = {(r.doc_id, r["size"]): int(r.taken / r["size"] + 0.5) for r in corpus_pipeline.mixing.mix_sources(left).collect()}
    want = []
    for i, t in least:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want += [(i, len(ids), ids)] * times[i, len(t.split())]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)


def test_mixing_stage_repeats_documents(spark):
    """Each id and text as often as its share is taken, to the nearest whole time."""
    from collections import Counter, defaultdict

    rng = random.Random(4)
    rows = [(i // 2, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(5, 90))), "en", f"s{i % 3}", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    share = defaultdict(list)
    text = {(i, len(t.split()), s): t for i, t, _, s, _ in rows}
    assert len(text) == len(rows)
    for r in corpus_pipeline.mixing.mix_sources(docs).collect():
        share[r.doc_id, text[r.doc_id, r["size"], r["source"]]].append(r.taken / r["size"])
    want = Counter({k: int(sum(v) / len(v) + 0.5) for k, v in share.items()})
    assert +want == Counter((r.doc_id, r.text) for r in corpus_pipeline.mixing_stage(spark, docs, "").collect()) and len(set(want.values())) > 1


def test_near_dedup_links_by_fingerprints(spark):
    """Texts whose fingerprints lie within two bits are one group, though their sets of five words are further apart."""
    from tallyweave.llm import simhash

    rng = random.Random(8)
    said = [f"w{i}" for i in range(61)]
    long = said * 30
    # Twice the same words, once with many stray ones behind: the repeats decide every bit of the fingerprint.
    texts = [" ".join(long), " ".join(long + [f"x{i}" for i in range(24)]), " ".join(f"y{rng.randrange(5000)}" for _ in range(80))]
    a, b, c = (simhash.fingerprint(t.encode()) for t in texts)
    assert (a ^ b).bit_count() <= 2 < (a ^ c).bit_count() and not similar(*map(sets_of, texts[:2]))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [0, 2]
