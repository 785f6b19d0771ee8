"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters by an embedding of its own, if it is frequent, and by the mean embedding of its character n-grams, so
that inflected and unseen forms keep the sense of their stem.  Two gated recurrent layers read a window of words from
both ends, attention pools their states, and a logistic unit scores the window.  Every text is cut into overlapping
windows over its whole length; its score is the largest of theirs.

The network is trained on a bounded sample of labelled rows (``ToxicityOptions``: rows for each label and bytes in
all, in the order of a hash of doc_id); labels, language, source and doc_id are never inputs of a score.

Defined results: null and empty texts have one empty window and get its score; if the sample lacks one of the labels,
all scores are 0; labels that are null are no labels; a doc_id labelled both ways counts as toxic; repeated rows get
the same score again; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, flat, mix, slices

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Stripped from both ends of a word.
MARKS = b".,;:!?()[]{}<>|*#$%&+=~/\\\"'"


@dataclass(frozen=True)
class ToxicityOptions:
    toxic_rows: int = 1500
    clean_rows: int = 2500
    train_bytes: int = 9 << 20
    window: int = 64
    stride: int = 48
    words: int = 8192
    grams: int = 1 << 15
    gram_sizes: tuple[int, ...] = (3, 4, 5)
    least_share: float = 0.004
    size: int = 8
    hidden: int = 12
    epochs: int = 3
    least_steps: int = 350
    batch: int = 256
    rate: float = 0.01
    decay: float = 0.2
    drop: float = 0.3
    seed: int = 5
    threshold: float = 0.7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Features:
    """Words as a number each (0: not frequent) and their known n-grams: those of word i at ``grams[ends[i]:ends[i+1]]``."""

    def __init__(self, word: np.ndarray, grams: np.ndarray, ends: np.ndarray):
        self.word, self.grams, self.ends = word, grams, ends

    def take(self, some: np.ndarray) -> Features:
        count = (self.ends[1:] - self.ends[:-1])[some]
        ends = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(ends[-1]) + np.repeat(self.ends[some] - ends[:-1], count)
        return Features(self.word[some], self.grams[at], ends)


class Inputs:
    """The vocabularies: frequent words, and n-grams by their hash in a table with one entry a slot."""

    SLOTS = 1 << 20

    def __init__(self, options: ToxicityOptions, words: dict[bytes, int], grams: np.ndarray):
        self.options, self.words, self.gram_hashes, self.hash = options, words, grams, RollingHash(23)
        self.slot_hash, self.slot_id = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        slot = (grams & np.uint64(self.SLOTS - 1)).astype(np.int64)
        # Of n-grams that share a slot the most frequent stays: it is written last.
        self.slot_hash[slot[::-1]], self.slot_id[slot[::-1]] = grams[::-1], np.arange(len(grams), 0, -1)

    @classmethod
    def fit(cls, texts: list[bytes], options: ToxicityOptions) -> Inputs:
        """Words and n-grams by the number of texts that have them; ties by value."""
        words, tool = Counter(), cls(options, {}, np.zeros(0, np.uint64))
        seen, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for i in range(0, len(texts), 200):
            found = [seen]
            for text in texts[i : i + 200]:
                mine = sorted(set(split(text)))
                words.update({w.strip(MARKS) for w in mine})
                found.append(np.unique(tool.gram_list(mine)[0]))
            weight = np.concatenate([times, np.ones(sum(map(len, found[1:])), np.int64)])
            seen, back = np.unique(np.concatenate(found), return_inverse=True)
            times = np.bincount(back, weight, len(seen)).astype(np.int64)
        least = max(3, round(options.least_share * len(texts)))
        often = np.flatnonzero(times >= least)
        often = often[np.argsort(-times[often], kind="stable")][: options.grams]
        top = sorted((w for w, n in words.items() if n >= least), key=lambda w: (-words[w], w))[: options.words]
        return cls(options, {w: i + 1 for i, w in enumerate(top)}, seen[often])

    def gram_list(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams of the words between marks of start and end, and each one's word."""
        data = np.frombuffer(b"".join([b"^%b$" % w.strip(MARKS) for w in words]), np.uint8)
        sizes = np.array([len(w.strip(MARKS)) + 2 for w in words], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
        sums, hashes, of = self.hash.sums(data), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for n in self.options.gram_sizes:
            at = np.flatnonzero(left >= n)
            hashes.append(mix(self.hash.ranges(sums, at, at + n) + np.uint64(n)))
            of.append(owner[at])
        return np.concatenate(hashes), np.concatenate(of)

    def features(self, words: list[bytes]) -> Features:
        """Features of words, after a first row for padding."""
        hashes, of = self.gram_list(words)
        slot = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        hit = self.slot_hash[slot] == hashes
        ids, of = self.slot_id[slot[hit]], of[hit] + 1
        order = np.argsort(of, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words) + 1))])
        number = np.array([0, *(self.words.get(w.strip(MARKS), 0) for w in words)], np.int64)
        return Features(number, ids[order], ends)


def split(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().split()


def windows(numbers: list[int], options: ToxicityOptions) -> np.ndarray:
    """Overlapping windows over all words of a text, padded with 0; a text without words has one empty window."""
    n = len(numbers)
    starts = range(0, max(1, n - options.window + options.stride), options.stride) if n > options.window else (0,)
    out = np.zeros((len(starts), options.window), np.int64)
    for row, s in zip(out, starts):
        part = numbers[s : s + options.window]
        row[: len(part)] = part
    return out


class Network:
    def __init__(self, options: ToxicityOptions):
        o, rng = options, np.random.default_rng(options.seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[0] if len(shape) > 1 and shape[0] < 100 else 1)).astype(np.float32)
        self.options = o
        self.p = {"word": 0.1 * draw(o.words + 1, o.size), "gram": 0.1 * draw(o.grams + 1, o.size), "attend": draw(2 * o.hidden), "out": draw(2 * o.hidden), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": draw(2 * o.size, 3 * o.hidden), f"c{way}": np.zeros(3 * o.hidden, np.float32), f"h{way}": draw(o.hidden, 3 * o.hidden)}

    def embed(self, f: Features) -> np.ndarray:
        """Input vectors of words: the frequent word's own, and the mean of its known n-grams'."""
        count = f.ends[1:] - f.ends[:-1]
        mean = np.zeros((len(count), self.options.size), np.float32)
        some = count > 0
        if some.any():
            mean[some] = np.add.reduceat(self.p["gram"][f.grams], f.ends[:-1][some]) / count[some, None]
        return np.concatenate([self.p["word"][f.word] * (f.word > 0)[:, None], mean], 1).astype(np.float32)

    def read(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """One recurrent layer over (time, batch, 3 hidden) inputs; ``keep`` gets what the way back needs."""
        n = self.options.hidden
        state, u = np.zeros((x.shape[1], n), np.float32), self.p[f"h{way}"]
        out = np.empty((x.shape[0], x.shape[1], n), np.float32)
        for t in range(x.shape[0]) if way == "f" else range(x.shape[0] - 1, -1, -1):
            hu = state @ u
            gates = _sigmoid(x[t, :, : 2 * n] + hu[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(x[t, :, 2 * n :] + r * hu[:, 2 * n :])
            m = mask[t][:, None]
            after = state + m * ((1 - z) * (new - state))
            if keep is not None:
                keep.append((t, state, z, r, new, hu[:, 2 * n :], m))
            out[t] = state = after
        return out

    def forward(self, vectors: np.ndarray, index: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``index`` (batch, time) points into ``vectors``, 0 is padding."""
        at, steps = np.ascontiguousarray(index.T), {"f": [], "b": []}
        mask = (at > 0).astype(np.float32)
        states = np.concatenate([self.read((vectors @ self.p[f"x{w}"] + self.p[f"c{w}"])[at], mask, w, steps[w] if keep is not None else None) for w in "fb"], 2)
        attention = states @ self.p["attend"] + (mask - 1) * 1e4
        attention = np.exp(attention - attention.max(0))
        attention /= attention.sum(0)
        pooled = np.einsum("tb,tbh->bh", attention, states)
        if keep is not None:
            keep.update(at=at, steps=steps, states=states, attention=attention, pooled=pooled)
        return pooled @ self.p["out"] + self.p["bias"]

    def gradients(self, rows: Features, index: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        o, keep, p = self.options, {}, self.p
        vectors = self.embed(rows)
        error = ((_sigmoid(self.forward(vectors, index, keep)) - labels) / len(labels)).astype(np.float32)
        g = {"out": keep["pooled"].T @ error, "bias": np.array([error.sum()], np.float32)}
        d_pooled = error[:, None] * p["out"]
        a, states = keep["attention"], keep["states"]
        through = np.einsum("bh,tbh->tb", d_pooled, states)
        d_score = a * (through - (a * through).sum(0))
        g["attend"] = np.einsum("tb,tbh->h", d_score, states)
        d_states = a[:, :, None] * d_pooled + d_score[:, :, None] * p["attend"]
        d_vectors, n = np.zeros_like(vectors), o.hidden
        flat_at = keep["at"].ravel()
        for i, way in enumerate("fb"):
            d_own, u = d_states[:, :, i * n : (i + 1) * n], p[f"h{way}"]
            d_x = np.zeros((*d_own.shape[:2], 3 * n), np.float32)
            d_u, back = np.zeros_like(u), np.zeros(d_own.shape[1:], np.float32)
            for t, before, z, r, new, hu, m in reversed(keep["steps"][way]):
                d = (d_own[t] + back) * m
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (before - new) * z * (1 - z)
                d_r = d_new * hu * r * (1 - r)
                d_x[t] = np.concatenate([d_z, d_r, d_new], 1)
                d_hu = np.concatenate([d_z, d_r, d_new * r], 1)
                back = d * z + (d_own[t] + back) * (1 - m) + d_hu @ u.T
                d_u += before.T @ d_hu
            d_x = d_x.reshape(-1, 3 * n)
            summed = np.stack([np.bincount(flat_at, d_x[:, k], len(vectors)) for k in range(3 * n)], 1).astype(np.float32)
            summed[0] = 0
            g |= {f"h{way}": d_u, f"x{way}": vectors.T @ summed, f"c{way}": summed.sum(0)}
            d_vectors += summed @ p[f"x{way}"].T
        count = rows.ends[1:] - rows.ends[:-1]
        spread = np.repeat(d_vectors[:, o.size :] / np.maximum(count, 1)[:, None], count, 0)
        add = lambda at, d, n: np.stack([np.bincount(at, d[:, k], n) for k in range(o.size)], 1).astype(np.float32)
        g["word"], g["gram"] = add(rows.word, d_vectors, o.words + 1), add(rows.grams, spread, o.grams + 1)
        return g

    def train(self, rows: Features, index: np.ndarray, labels: np.ndarray, doc: np.ndarray) -> None:
        """Adam over windows.  After the first round a toxic text counts by the windows that look so, and its best."""
        o, rng = self.options, np.random.default_rng(self.options.seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, epochs = 0, max(o.epochs, -(-o.least_steps * o.batch // len(index)))
        for epoch in range(epochs):
            use = np.arange(len(index))
            if epoch:
                score = self.logits(rows, index)
                best = np.full(doc.max() + 1, -np.inf)
                np.maximum.at(best, doc, score)
                use = np.flatnonzero((labels == 0) | (score > 0) | (score == best[doc]))
            for at in np.array_split(rng.permutation(use), max(1, len(use) // o.batch)):
                some, inverse = np.unique(np.append(index[at].ravel(), 0), return_inverse=True)
                mine = rows.take(some)
                # Own embeddings go missing at random, so that words are also known by their n-grams.
                mine.word = np.where(rng.random(len(some)) < o.drop, 0, mine.word)
                g = self.gradients(mine, inverse[:-1].reshape(len(at), -1), labels[at])
                step += 1
                for k, d in g.items():
                    first[k] += 0.1 * (d - first[k])
                    second[k] += 0.01 * (d * d - second[k])
                    move = o.rate * (1 - 0.75 * epoch / epochs) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    self.p[k] -= (move * (first[k] / (np.sqrt(second[k]) + 1e-7) + o.decay * self.p[k])).astype(np.float32)

    def logits(self, rows: Features, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index))
        for i in range(0, len(index), 2048):
            some, inverse = np.unique(np.append(index[i : i + 2048].ravel(), 0), return_inverse=True)
            out[i : i + 2048] = self.forward(self.embed(rows.take(some)), inverse[:-1].reshape(len(index[i : i + 2048]), -1))
        return out


def _with_held_out(df: DataFrame) -> DataFrame:
    return df.withColumn("held_out", F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)"))


def training_sample(docs: DataFrame, labels: DataFrame, options: ToxicityOptions) -> list[tuple[bytes, int]]:
    """Texts and labels outside the held-out third: at most so many rows a label, then so many bytes, in hash order."""
    known = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic is not null")
    known = _with_held_out(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))).where("not held_out").withColumn("h", F.xxhash64("doc_id", F.lit(3)))
    picked = known.where("toxic = 1").orderBy("h").limit(options.toxic_rows).union(known.where("toxic = 0").orderBy("h").limit(options.clean_rows))
    # At most toxic_rows + clean_rows ids, so the broadcast is bounded.
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(picked.select("doc_id", "toxic", "h")), "doc_id")
    room, keep = options.train_bytes, []
    for r in rows.select("h", "toxic", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), "doc_id").orderBy("h", "n").toLocalIterator():
        if r["n"] <= room:
            room -= r["n"]
            keep.append(r["doc_id"])
    if not keep:
        return []
    chosen = docs.sparkSession.createDataFrame([(i,) for i in sorted(set(keep))], "doc_id long")
    texts = rows.join(F.broadcast(chosen), "doc_id").select("h", "toxic", "text").where(f"coalesce(octet_length(text), 0) <= {options.train_bytes}").dropDuplicates().orderBy("h", "text")
    return [((r["text"] or "").encode("utf-8", "replace"), r["toxic"]) for r in texts.toLocalIterator()]


def fit(sample: list[tuple[bytes, int]], options: ToxicityOptions) -> tuple[dict, dict, np.ndarray] | None:
    """Parameters and vocabularies; None if the sample lacks a label."""
    if len({t for _, t in sample}) < 2:
        return None
    inputs = Inputs.fit([t for t, _ in sample], options)
    known: dict[bytes, int] = {}
    cut = [windows([known.setdefault(w, len(known) + 1) for w in split(text)], options) for text, _ in sample]
    index, doc = np.concatenate(cut), np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    network, label = Network(options), np.array([t for _, t in sample], np.float32)
    features = inputs.features(list(known))
    # Every fifth text of each label is kept from training, to place the threshold.
    aside = np.zeros(len(sample), bool)
    for t in (0, 1):
        aside[np.flatnonzero(label == t)[4::5]] = True
    use = ~aside[doc]
    network.train(features, index[use], label[doc[use]], np.unique(doc[use], return_inverse=True)[1])
    if len(set(label[aside].tolist())) == 2:
        best = np.full(len(sample), -np.inf)
        np.maximum.at(best, doc[~use], network.logits(features, index[~use]))
        network.p["bias"] -= np.float32(cut_point(best[aside], label[aside]) - np.log(options.threshold / (1 - options.threshold)))
    return network.p, inputs.words, inputs.gram_hashes


def cut_point(logits: np.ndarray, labels: np.ndarray) -> float:
    """Where texts part best: the middle of the gap with the least share of wrong toxic plus wrong clean texts."""
    x = np.sort(logits)
    between = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    toxic, clean = np.sort(logits[labels == 1]), np.sort(logits[labels == 0])
    wrong = np.searchsorted(toxic, between) / len(toxic) + 1 - np.searchsorted(clean, between) / len(clean)
    best = between[wrong <= wrong.min() + 1e-9]
    return float((best[0] + best[-1]) / 2)


def _scored(model, options: ToxicityOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = None
        if model.value:
            network = Network(options)
            network.p, words, grams = model.value
            inputs = Inputs(options, words, grams)
        for batch in batches:
            at, data = flat(batch.column(1))
            for i, j in slices(at, 1 << 20):
                score = np.zeros(j - i)
                if network:
                    raw, own = data[at[i] : at[j]].tobytes(), at[i : j + 1] - at[i]
                    known: dict[bytes, int] = {}
                    cut = [windows([known.setdefault(w, len(known) + 1) for w in split(raw[a:b])], options) for a, b in zip(own, own[1:])]
                    vectors = network.embed(inputs.features(list(known)))
                    index = np.concatenate(cut)
                    logit = np.concatenate([network.forward(vectors, index[k : k + 2048]) for k in range(0, len(index), 2048)])
                    score = _sigmoid(np.maximum.reduceat(logit, np.cumsum([0, *map(len, cut)])[:-1])).astype(float)
                columns = [pa.array(score), pa.array((score >= options.threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), *columns], ["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row, by a network trained on the other two thirds' labels."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels, options), options))
    return _with_held_out(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(_scored(model, options), SCHEMA)
