"""Tokens, toxicity, chat, urls, search."""

import random
import time

import numpy as np
import pytest

from tallyweave.llm import chat, knn, tokens, toxicity, urls
from tallyweave.llm.queries import tokenizer_path

ODD = ["", "  ", " a", "x\x0by z\x0c q", "a\xa0b c", "İstanbul ΣΑΣ", "it's they're <|startoftext|>abc <|endoftext|>", "é ́x", "z" * 5000, "ab\x1cc", "日本語テキスト", "\n\nx\ty\r\nz", "word " * 3000, "THE The the, the. <|ENDOFTEXT|>"]


def test_tokens_round_trip(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = [(i, t) for i, t, *_ in rows] + [(1000 + i, t) for i, t in enumerate(ODD)]
    got = tokens.encode_documents(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), tokenizer_path()).collect()
    ids = [x.ids for x in tokenizer.encode_batch([t or "" for _, t in texts], add_special_tokens=False)]
    want = [(i, x, tokenizer.decode(x, skip_special_tokens=False)) for (i, _), x in zip(texts, ids)]
    assert sorted(map(repr, (tuple(g) for g in got))) == sorted(map(repr, want))
    assert tokens.encode_documents(nothing, tokenizer_path()).collect() == []


def test_letters_that_normalize_to_marks():
    """NFC or lower case ends these words of letters in a combining mark, which takes the full stop or comma along."""
    from tokenizers import Tokenizer

    words = ["\u09b9\u09df", "\u09a1\u09dc", "\u0915\u095c", "\ufb2a", "A\u0130", "word"]
    texts = [f"so {w}{m} and {w} {w}{m} end" for w in words for m in ".,"]
    coder = tokens.ChunkCoder(Tokenizer.from_file(tokenizer_path()))
    got = coder.encode([t.encode() for t in texts], [[0]] * len(texts))
    assert got == coder.direct([t.encode() for t in texts])


def test_lean_steps_give_the_ids_of_the_tokenizer():
    """Every two characters below U+0300, quotes and their endings, and the texts that are left out."""
    from tokenizers import Tokenizer

    rng = random.Random(8)
    coder = tokens.ChunkCoder(Tokenizer.from_file(tokenizer_path()))
    known = [chr(c) for c in range(coder.lean.LIMIT) if coder.lean.kind[c] != tokens.ODD]
    assert len(known) > 750
    some = ["'", "'", "s", "t", "re", "ve", "m", "ll", "l", "d", "S", "RE", "v", "a", "7", "\xb2", "!", ".", " ", "\n", "\xa0", "\x1c", "\xad", "\xc9", "\xdf", "\u017f"]
    texts = ["".join(x + y for y in known) for x in known] + ["".join(rng.choices(some, k=rng.randint(0, 14))) for _ in range(4000)]
    raw = [t.encode() for t in texts]
    assert None not in coder.lean.spaced(raw)
    # Many texts at once, one alone, and texts left out among others.
    assert coder.whole(raw) == coder.direct(raw)
    assert [coder.whole([r])[0] for r in raw[-300:]] == coder.direct(raw[-300:])
    mixed = [t.encode() for t in [*ODD, *texts[-20:], "e\u0301 E\u0301", "\u03a3\u03b1\u03a3", "x<|endoftext|>y's", "X<|ENDOFTEXT|>Y"]]
    rng.shuffle(mixed)
    assert coder.whole(mixed) == coder.direct(mixed) and any(coder.lean.spaced(mixed)) and None in coder.lean.spaced(mixed)


def test_lean_steps_only_for_their_kind():
    import public_tokenizers
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    assert tokens.Lean.of(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))) is None
    assert tokens.Lean.of(across_spaces()) is None
    for change in (dict(normalizer=normalizers.Lowercase()), dict(pre_tokenizer=pre_tokenizers.WhitespaceSplit())):
        other = Tokenizer.from_file(tokenizer_path())
        for k, v in change.items():
            setattr(other, k, v)
        assert tokens.Lean.of(other) is None
        text = "It's 12 O'Clock,  \xc9t\xc9!".encode()
        assert tokens.ChunkCoder(other).whole([text]) == tokens.ChunkCoder(other).direct([text])


def test_only_joins_take_the_slow_steps():
    """Of plain texts, only the words around joins pass the tokenizer's own normalizer and splits, and each chunk goes
    whole through the model."""
    from tokenizers import Tokenizer

    class Counting(tokens.ChunkCoder):
        slow, calls = 0, []

        def found(self, tokenizer, texts):
            if tokenizer is self.tokenizer:
                self.slow += sum(len(t.encode()) for t in texts)
            else:
                self.calls += texts
            return super().found(tokenizer, texts)

    coder = Counting(Tokenizer.from_file(tokenizer_path()))
    rng = random.Random(3)
    raw = [" ".join(rng.choice(["The", "caf\xe9's", "n\xb0", "12,5", "stories.", "it'll"]) + str(rng.randrange(99)) for _ in range(3000)).encode() for _ in range(5)]
    begins = [[0, *(i for i in range(1500, len(r), 1500) if r[i] & 0xC0 != 0x80)] for r in raw]
    got = coder.encode(raw, begins)
    assert coder.slow < 0.15 * sum(map(len, raw)) and len(coder.calls) == len(coder.chunks)
    assert got == tokens.ChunkCoder(Tokenizer.from_file(tokenizer_path())).direct(raw)


def across_spaces():
    """A tokenizer that parts nothing: its tokens hold white space, inside chunks and across joins."""
    from tokenizers import Tokenizer, models

    merges = [("b", " "), ("b ", "a"), ("a", "a"), ("b a", " ")]
    vocab = {t: i for i, t in enumerate(["a", "b", "c", " ", *("".join(m) for m in merges)])}
    return Tokenizer(models.BPE(vocab, merges))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", None])
def test_chunks_join_exactly(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(5)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name)) if name else across_spaces()
    texts = ODD + ["".join(rng.choice("ab c") for _ in range(400)) for _ in range(6)] if name else ["".join(rng.choice("ab c") for _ in range(400)) for _ in range(40)]
    texts += ["the unbelievable story, isn't it?! 1234 done... " * 8] if name else ["ab " * 90]
    raw = [t.encode() for t in texts]
    coder = tokens.ChunkCoder(tokenizer, room=1 << 14)
    want = coder.direct(raw)
    for every in (3, 17, 90):
        begins = []
        for r in raw:
            at = sorted(rng.sample(range(len(r) + 1), min(len(r), len(r) // every)))
            begins.append(sorted({0, *(i for i in at if i < len(r) and r[i] & 0xC0 != 0x80)}))
        assert coder.encode(raw, begins) == want
    own = np.cumsum([0, *map(len, raw)])
    cuts = coder.cuts(np.frombuffer(b"".join(raw), np.uint8), own)
    assert set(own[:-1]) <= set(cuts.tolist())


def test_equal_passages_are_cut_alike_and_encoded_once():
    from tokenizers import Tokenizer

    rng = random.Random(6)
    coder = tokens.ChunkCoder(Tokenizer.from_file(tokenizer_path()))
    said = lambda n: " ".join(rng.choice(["one", "two", "three", "fifteen"]) for _ in range(n))
    passage = said(6000)
    texts = [t.encode() for t in (said(300) + " " + passage, said(700) + " " + passage + " " + said(50))]
    data, own = np.frombuffer(b"".join(texts), np.uint8), np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])])
    cuts = coder.cuts(data, own)
    begins = [(cuts[(cuts >= a) & (cuts < b)] - a).tolist() for a, b in zip(own, own[1:])]
    assert coder.encode(texts, begins) == coder.direct(texts)
    assert sum(map(len, begins)) - len(coder.chunks) > 0.6 * len(begins[0])


def test_disagreeing_joins_are_repaired():
    """A tokenizer that merges across white space: every join disagrees until the stretch is the whole text."""

    class Pairs:
        decoder = object()

        def get_vocab_size(self, **_):
            return 2000

        def id_to_token(self, i):
            return "a"

        def get_added_tokens_decoder(self):
            return {}

        def encode_batch_fast(self, texts, add_special_tokens):
            return [type("E", (), {"ids": [len(t.split())] * (len(t.split()) % 3) + [ord(c) for c in t if c != " "]}) for t in texts]

        def decode(self, ids, **_):
            return ""

    coder = tokens.ChunkCoder(Pairs())
    text = " ".join("abcdefg"[i % 7] for i in range(200)).encode()
    got = coder.encode([text], [[0, 101, 250]])[0]
    assert np.frombuffer(got, np.int32).tolist() == Pairs().encode_batch_fast([text.decode()], False)[0].ids


def test_gradients():
    o = toxicity.ToxicityOptions(words=5, grams=7, size=3, hidden=2, window=6)
    net, rng = toxicity.Network(o), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) + 0.1 for k, v in net.p.items()}
    features = toxicity.Features(np.array([0, 1, 2, 0]), np.array([1, 2, 3, 3, 4]), np.array([0, 0, 2, 3, 5]))
    index, labels = np.array([[1, 2, 3, 1, 0, 0], [3, 3, 1, 2, 2, 1]]), np.array([1.0, 0.0])
    grads = net.gradients(features, index, labels)

    def loss():
        p = 1 / (1 + np.exp(-net.forward(net.embed(features), index)))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for k, g in grads.items():
        for at in [tuple(rng.integers(0, s) for s in net.p[k].shape) for _ in range(4)]:
            keep = net.p[k][at]
            net.p[k][at] = keep + 1e-2
            up = loss()
            net.p[k][at] = keep - 1e-2
            down = loss()
            net.p[k][at] = keep
            assert g[at] == pytest.approx((up - down) / 2e-2, abs=2e-3), k


def test_toxicity(spark, nothing):
    rng = random.Random(2)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    docs, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        words = [rng.choice(clean) for _ in range(rng.randint(30, 150))]
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), "zorgu" + rng.choice(clean)[:3])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs += [(900, None), (901, ""), (0, docs[0][1])]
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int")
    options = toxicity.ToxicityOptions(least_steps=120)
    out = toxicity.toxicity_scores(frame, known, options).collect()
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert len(out) == 243 and len(held) > 40 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) >= 0.95
    assert {r.score for r in toxicity.toxicity_scores(frame, known.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity_scores(nothing, known, options).collect() == []


def test_windows_cover_every_word():
    o = toxicity.ToxicityOptions()
    for n in (0, 1, 64, 65, 112, 113, 1000):
        cut = toxicity.windows(list(range(1, n + 1)), o)
        assert set(cut.ravel()) - {0} == set(range(1, n + 1)) and len(cut) >= 1


HARD = [r"\### Assistant: </turn> ok", "", "\n", "\\", "a\n</turn>\n### user:\nb", "###", "\\\\###</turn>", "x\n"]


def test_chat_template_reads_back():
    turns = [(r, t) for r in ("user", "assistant", "", "a:\nb", "\\c") for t in HARD]
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[i:j]) for i, j in spans] == [t for r, t in turns if r == "assistant"]


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, None, None), (2, 5, "assistant", HARD[0]), (None, None, "user", "x"), (1, 2, None, None), (3, 0, "user", "y" * 20_000)]
    rows += [(9, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(70)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(chat.linear_messages(df))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 4, 2: 1, None: 1, 3: 1, 9: 70}
    import hashlib

    loss = "".join(f"t{t}" for t in range(1, 70, 2))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[9].loss_chars, got[9].loss_sha256) == (len(loss), sha(loss))
    for k, r in got.items():
        order = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
        turns = [(a or "", b or "") for *_, a, b in sorted((x for x in rows if x[0] == k), key=order)]
        said = "".join(t for a, t in turns if a == "assistant")
        whole = chat.render(turns)[0]
        assert (r.turns_sha256, r.loss_sha256, r.loss_chars, r.formatted_chars) == (sha("".join(f"{a}\n{t}\n" for a, t in turns)), sha(said), len(said), len(whole))
    assert chat.digests(chat.format_conversations(chat.linear_messages(df.limit(0)))).collect() == []


def test_reply_trees(spark):
    tree = [(1, 1, None, "u", "q", 0.0), (1, 2, 1, "a", "bad", 0.1), (1, 3, 1, "a", "good", 0.9), (1, 4, 3, "u", "more", 0.0), (1, 5, 3, "u", "tie", 0.0), (2, 6, 99, "u", "orphan", 1.0)]
    df = spark.createDataFrame(tree, "conv long, node long, parent long, role string, text string, score double")
    got = [(r.conv, r.branch, [t for _, t in chat.parse(r.formatted)]) for r in chat.format_conversations(df, 2).orderBy("conv", "branch").collect()]
    assert got == [(1, 1, ["q", "good", "more"]), (1, 2, ["q", "good", "tie"]), (2, 1, ["orphan"])]


def brute_branches(tree, most):
    """Leaves whose way up ends, by score, with the texts from root to leaf."""
    of = {n: (c, p, t, s or 0.0) for c, n, p, _, t, s in tree}
    above = lambda n: of[n][1] if of[n][1] in of and of[of[n][1]][0] == of[n][0] else None
    found = {}
    for n in set(of) - {above(n) for n in of}:
        way = [n]
        while above(way[-1]) is not None and len(way) <= len(of):
            way.append(above(way[-1]))
        if len(way) <= len(of):
            found.setdefault(of[n][0], []).append((-sum(of[x][3] for x in way), n, [of[x][2] for x in reversed(way)]))
    return sorted((c, i, way) for c, x in found.items() for i, (_, _, way) in enumerate(sorted(x)[:most], 1))


def test_reply_cycles_are_left_out(spark):
    rng = random.Random(8)
    tree = [(1, 1, 2, "u", "a", 1.0), (1, 2, 3, "u", "b", 1.0), (1, 3, 1, "u", "c", 1.0), (1, 4, 2, "u", "below a cycle", 9.0), (1, 5, None, "u", "sound", None), (1, 6, 6, "u", "own parent", 1.0), (2, 7, 5, "u", "elsewhere", 0.5)]
    tree += [(3, 100 + i, None if i == 0 else 100 + rng.randrange(max(0, i - 4), i), "u", f"t{i}", rng.randint(0, 3) / 2) for i in range(80)]
    df = spark.createDataFrame(tree, "conv long, node long, parent long, role string, text string, score double")
    got = [(r.conv, r.branch, [t for _, t in chat.parse(r.formatted)]) for r in chat.format_conversations(df, 3).orderBy("conv", "branch").collect()]
    assert got == brute_branches(tree, 3) and len(got) == 5
    assert chat.format_conversations(df.where("conv = 1 and node < 5")).collect() == []


URLS = [None, "", "no scheme", "http://A.Example.COM/en/7?x", "https://example.com/en/8#f", "http://com/en/", "http://xcom/en/", "ftp://example.net/de/81", "http://example.net/de/7", "http://b.org", "http://a.org/es/x://y", "://example.com/en/7", "http://a.com?/en/"]


def test_urls(spark):
    want = []
    for i, u in enumerate(URLS):
        host, path = urls.split_url(u)
        fits = [(d + p, a) for d, p, a in urls.PAGE_RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        want.append((i, host, path, rule, verdict))
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for bound in (urls.MAX_RULE_BYTES, 0):
        assert [tuple(r) for r in urls.filter_urls(pages, max_rule_bytes=bound).orderBy("page_id").collect()] == want
    frame = spark.createDataFrame([*urls.PAGE_RULES, (None, "/en/", "block"), ("org", "/es/", "allow")], "host string, path string, action string")
    assert [tuple(r) for r in urls.filter_urls(pages, frame).orderBy("page_id").collect()] == want
    assert urls.filter_urls(pages, rules=()).where("verdict <> 'allow'").count() == 0
    assert urls.filter_urls(pages.limit(0)).collect() == []


def test_very_long_urls(spark):
    """Neither dots nor slashes make the work grow faster than the url."""
    long = [("a." * 150_000 + "com", "/en/"), ("com", "/en/" + "x/" * 150_000), ("a." * 150_000, "/" * 150_000)]
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(long)], "page_id long, url string")
    began = time.time()
    for bound in (urls.MAX_RULE_BYTES, 0):
        got = [(r.host, r.path, r.rule) for r in urls.filter_urls(pages, max_rule_bytes=bound).orderBy("page_id").collect()]
        assert got == [(*long[0], "com/en/"), (*long[1], "com/en/"), (*long[2], None)]
    assert time.time() - began < 60
    assert len(urls.Shapes([(3, 4), (11, 5)]).strings(*long[0])) == 1


def test_digest_collisions_are_confirmed():
    index = urls.DigestArray.build([(urls.named(h, p), a == "block") for h, p, a in urls.PAGE_RULES])
    index.keys = np.zeros(len(index.keys), np.uint64)
    names = [b"com\0/en/", b"org\0/es/"]
    index.find(names)
    import xxhash

    index.keys = np.full(len(index.keys), xxhash.xxh64_intdigest(names[0]), np.uint64)
    k = index.find(names)
    assert index.text[index.offsets[k[0]] : index.offsets[k[0] + 1]] == names[0] and k[1] == -1


def brute_top_k(rows, every, k=5):
    """Each query row against every other row, in Python's integers."""
    from fractions import Fraction

    held = [(i, [int(Fraction(x) * 256 // 1) for x in map(float, v)]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(held):
        if i % every == 0:
            scores = [(-min(max(sum(x * y for x, y in zip(q, v)), -(2**63)), 2**63 - 1), j) for b, (j, v) in enumerate(held) if b != a and len(v) == len(q)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [64, 8192])
def test_top_k(spark, shard_rows):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 0.2, (300, 8)).astype(np.float32)
    vectors[40:140] = vectors[40]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (950, [1.0, None]), (951, [float("nan")] * 8), (None, [0.1] * 8), (1000, [0.5, 0.5]), (3, vectors[3].tolist()), (10, vectors[11].tolist()), (20, vectors[20].tolist()), (2000, [])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, score int")
    options = knn.SearchOptions(shard_rows=shard_rows, block_queries=7, blocks_together=2, leaf=8)
    got = sorted(tuple(r) for r in knn.top_k(df, "vec_id % 10 = 0", options).collect())
    assert got == brute_top_k(rows, 10) and len(got) == 32 * 5
    assert knn.top_k(df.limit(0)).collect() == []


def test_top_k_is_exact_for_large_components(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.integers(-9, 9, 4) * 10.0 ** rng.integers(0, [3, 8, 12, 300][i % 4])).tolist()) for i in range(60)]
    rows += [(60, [9e6, 1.0, 0.0, 1.0]), (61, [9e6, 1.0, 0.0, 1.00390625]), (62, [1.7e308, 0.0, 0.0, 0.0]), (63, [-1.7e308, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in knn.top_k(df, "vec_id % 3 = 0", knn.SearchOptions(shard_rows=16, leaf=4)).collect())
    assert got == brute_top_k(rows, 3)


def test_bounds_are_no_less_than_products():
    rng = np.random.default_rng(10)
    for top in (2**20, 2**40, 2**62):
        points, queries = rng.integers(-top, top, (200, 16)), rng.integers(-top, top, (50, 16))
        bound = knn.upper_bounds(knn.floats(queries), knn.floats(points.min(0))[None], knn.floats(points.max(0))[None])[:, 0]
        for q, b in zip(queries.tolist(), bound.tolist()):
            assert b >= max(sum(x * y for x, y in zip(p, q)) for p in points.tolist())
