"""Removing passages that stand in an earlier document, by suffix arrays.

A byte goes if a string of ``WIDTH`` bytes covers it that also starts in a document with a smaller id.  Equal strings
must meet to be compared, so each string is dealt by its minimizer, the least hash of the ``GRAM``-byte strings inside
it: runs of neighbouring strings with one minimizer travel as one segment.  First only the minimizers travel, to find
those that stand in two documents or more; then the segments of these do, and each shard of them is one text whose
suffixes are sorted in two stages: suffixes smaller than their successors directly, the rest induced by bucket scans.
Adjacent suffixes with a common prefix of ``WIDTH`` bytes are equal strings, and the least document of such a run
decides for all of it.

Documents are packed into chunks of a few MB.  Each distinct segment of a chunk travels once, with all its places
there, so a passage of a third of all documents makes one entry a chunk.
Segments of minimizers in very many documents are dealt string by string instead.

Defined results: a null text is an empty text; a document without id neither loses nor claims bytes; rows that repeat
an id never claim bytes from each other; a text under ``WIDTH`` bytes keeps all; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, flat, materialize, mix, slices, tidy, tidy_group, tidy_groups

WIDTH, GRAM = 50, 25
CHUNK_BYTES = 4 << 20
#: Text bytes for each shard of minimizers, and of segments; suffixes sorted at once.
KEY_SHARD, SEGMENT_SHARD, SORT_BATCH = 48 << 20, 2 << 20, 1 << 20
#: Documents with one minimizer beyond which its strings are dealt one by one.
CROWD = 4096
CHUNK_SCHEMA = "chunk long, ids binary, at binary, blob binary, n_bytes long, rest binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents to rows of chunks."""
    squeeze, n = zstandard.ZstdCompressor(3), TaskContext.get().partitionId() << 32
    for batch in batches:
        at, data = flat(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in slices(at, CHUNK_BYTES):
            own = at[i : j + 1] - at[i]
            rest = pa.BufferOutputStream()
            with pa.ipc.new_stream(rest, batch.schema.empty_table().select(batch.schema.names[2:]).schema) as out:
                out.write_batch(batch.slice(i, j - i).select(batch.schema.names[2:]))
            row = [[n], [ids[i:j].tobytes()], [own.tobytes()], [squeeze.compress(data[at[i] : at[j]].tobytes())], [int(own[-1])], [squeeze.compress(rest.getvalue())]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()))], ["chunk", "ids", "at", "blob", "n_bytes", "rest"])
            n += 1


def _unpack(ids: bytes, at: bytes, blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    return np.frombuffer(ids, np.int64), np.frombuffer(at, np.int64), zstandard.ZstdDecompressor().decompress(blob)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - size :]) if width > size else out


class Minimizers:
    def __init__(self):
        self.hash = RollingHash(11)

    def segments(self, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, first and last (exclusive) byte of each run of WIDTH-byte strings with one minimizer."""
        found = []
        for i, j in slices(at, 1 << 19):
            for a in range(int(at[i]), int(at[j]), 1 << 19) if j == i + 1 else (int(at[i]),):
                # A long text is taken in stretches that share WIDTH - 1 bytes, so each string is in exactly one.
                b = min(int(at[j]), a + (1 << 19) + WIDTH - 1) if j == i + 1 else int(at[j])
                found.append(self._stretch(a, data[a:b], np.clip(at[i : j + 1], a, b) - a))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2

    def _stretch(self, base: int, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data) - WIDTH + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums = self.hash.sums(data)
        begin = np.arange(len(data) - GRAM + 1)
        least = _sliding_min(mix((sums[GRAM:] - sums[:-GRAM]) * self.hash.inverse[: len(begin)]), WIDTH - GRAM + 1)
        steps = np.zeros(len(data) + 1, np.int32)
        lengths = np.diff(at)
        full = lengths >= WIDTH
        np.add.at(steps, at[:-1][full], 1)
        np.add.at(steps, at[1:][full] - WIDTH + 1, -1)
        valid = np.cumsum(steps)[:n] > 0
        other = least[1:] != least[:-1]
        first = valid.copy()
        first[1:] &= ~valid[:-1] | other
        last = valid.copy()
        last[:-1] &= ~valid[1:] | other
        start = np.flatnonzero(first)
        return least[start], start + base, np.flatnonzero(last) + WIDTH + base


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _by_bucket(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Bucket, first and last (exclusive) index of sorted keys."""
    if not len(keys):
        return []
    bucket = _bucket(keys, bits)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    return [(int(bucket[i]), int(i), int(j)) for i, j in zip(edges, edges[1:])]


def _distinct_keys(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and in how many documents of the chunk each stands."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    fresh = new.copy()
    fresh[1:] |= d[1:] != d[:-1]
    start = np.flatnonzero(new)
    return k[start], np.add.reduceat(fresh.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)


def _keys_out(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, tool = zstandard.ZstdCompressor(1), Minimizers()
        for batch in batches:
            for chunk, ids, at, blob in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "at", "blob"))):
                ids, at, raw = _unpack(ids, at, blob)
                keys, start, _ = tool.segments(at, np.frombuffer(raw, np.uint8))
                keys, count = _distinct_keys(keys, ids[np.searchsorted(at, start, "right") - 1])
                low = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                rows = [(b, chunk, low[i:j].tobytes(), squeeze.compress(np.minimum(count[i:j], 255).astype(np.uint8).tobytes())) for b, i, j in _by_bucket(keys, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "chunk", "keys", "counts"])

    return run


def _codes(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's minimizers of one bucket: 0 if in one document only, 1 if in more, 2 if in very many."""
    keys = [np.frombuffer(k, np.uint32) for k in rows["keys"]]
    loose = zstandard.ZstdDecompressor()
    counts = np.concatenate([np.frombuffer(loose.decompress(c), np.uint8) for c in rows["counts"]])
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, counts)
    code = np.where(total > CROWD, 2, np.where(total > 1, 1, 0)).astype(np.uint8)[back]
    squeeze, ends = zstandard.ZstdCompressor(1), np.cumsum([0, *map(len, keys)])
    packed = [squeeze.compress(code[i:j].tobytes()) for i, j in zip(ends, ends[1:])]
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "codes": packed})


def _segments_out(bits: int):
    """A chunk and the codes of its minimizers to the segments to compare, each distinct one once with all its spots."""

    def run(chunks: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        if not len(chunks):
            return pd.DataFrame({"bucket": [], "chunk": [], "payload": []})
        chunk, ids, at, blob = (chunks[c].iloc[0] for c in ("chunk", "ids", "at", "blob"))
        ids, at, raw = _unpack(ids, at, blob)
        tool, loose = Minimizers(), zstandard.ZstdDecompressor()
        data = np.frombuffer(raw, np.uint8)
        keys, start, end = tool.segments(at, data)
        distinct, back = np.unique(keys, return_inverse=True)
        code = [np.frombuffer(loose.decompress(c), np.uint8) for c in codes.sort_values("bucket")["codes"]]
        code = (np.concatenate(code) if code else np.zeros(0, np.uint8))[back] if len(keys) else np.zeros(0, np.uint8)
        one, many = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        windows = (end - start)[many] - WIDTH + 1
        each = np.repeat(start[many], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        own = tool.hash.ranges(tool.hash.sums(data), each, each + WIDTH) if len(each) else np.zeros(0, np.uint64)
        keys, start, end = np.concatenate([keys[one], mix(own)]), np.concatenate([start[one], each]), np.concatenate([end[one], each + WIDTH])
        docs = ids[np.searchsorted(at, start, "right") - 1]
        entries: dict[bytes, int] = {}
        which = np.array([entries.setdefault(raw[s:e], len(entries)) for s, e in zip(start.tolist(), end.tolist())], np.int64)
        texts = list(entries)
        key = np.empty(len(texts), np.uint64)
        key[which] = keys
        # Spots by bucket, then by entry: each bucket's part is one stretch.
        rank = np.argsort(key, kind="stable")
        place = np.empty(len(texts), np.int64)
        place[rank] = np.arange(len(texts))
        order = np.argsort(place[which], kind="stable")
        start, docs, spots = start[order], docs[order], np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(texts))[rank])])
        squeeze, out = zstandard.ZstdCompressor(3), []
        for b, i, j in _by_bucket(key[rank], bits):
            mine, here = rank[i:j].tolist(), slice(spots[i], spots[j])
            names, owner = np.unique(docs[here], return_inverse=True)
            packed = (key[rank[i:j]], np.array([len(texts[m]) for m in mine], np.int32), b"".join([texts[m] for m in mine]), np.diff(spots[i : j + 1]).astype(np.int32), start[here].astype(np.int32), names, owner.astype(np.int32))
            out.append((b, chunk, squeeze.compress(pickle.dumps(packed, 5))))
        return pd.DataFrame(out, columns=["bucket", "chunk", "payload"])

    return run


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end) sorted, with touching ones joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[new, 0], reach[last]], axis=1)


def suffix_array(text: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Suffixes of ``text`` (symbols 0 to 256), sorted by their first ``depth`` symbols or more.

    Two stages: suffixes smaller than their successors are sorted directly; each other suffix follows from its
    successor's place, as the buckets of first symbols are scanned upwards."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.full(n, -1, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    known = np.where(step != 0, np.arange(n), n - 1)
    rising = step[np.minimum.accumulate(known[::-1])[::-1]] > 0

    padded = np.zeros(n + depth + 14, np.uint64)
    padded[:n] = text
    word = np.zeros(n + depth + 7, np.uint64)
    for j in range(7):
        word = (word << np.uint64(9)) | padded[j : j + len(word)]
    direct = np.flatnonzero(rising)
    direct = direct[np.argsort(word[direct], kind="stable")]
    tied = np.arange(len(direct))
    group = np.zeros(len(direct), np.int64)
    if len(direct):
        group[1:] = np.cumsum(word[direct[1:]] != word[direct[:-1]])
    for at in range(7, depth, 7):
        same = np.zeros(len(tied), bool)
        if len(tied) > 1:
            equal = group[1:] == group[:-1]
            same[1:] |= equal
            same[:-1] |= equal
        tied, group = tied[same], group[same]
        if not len(tied):
            break
        mine = direct[tied]
        value = word[mine + at]
        order = np.lexsort((value, group))
        direct[tied] = mine[order]
        group, value = group[order], value[order]
        group = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]) | (value[1:] != value[:-1]))])

    symbols = np.unique(text)
    first = text[direct]
    low, high = np.searchsorted(first, symbols, "left"), np.searchsorted(first, symbols, "right")
    queues: dict[int, list[np.ndarray]] = {int(c): [] for c in symbols}
    queues[int(text[-1])].append(np.array([n - 1]))
    out = []
    for c, i, j in zip(symbols.tolist(), low, high):
        falling = queues.pop(c)
        now = np.concatenate(falling) if falling else np.zeros(0, np.int64)
        falling = [now]
        while len(now):
            now = now[now > 0] - 1
            now = now[text[now] == c]
            falling.append(now)
        bucket = np.concatenate([*falling, direct[i:j]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        symbol = text[before]
        before, symbol = before[symbol > c], symbol[symbol > c]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        edges = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1], [True]])) if len(symbol) else []
        for a, b in zip(edges, edges[1:]):
            queues[int(symbol[a])].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(packed: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """How many symbols each suffix of ``ranked`` shares with the one before it, counted up to 56; ``packed`` holds at
    each place the next seven symbols, nine bits each."""
    shared = np.full(max(0, len(ranked) - 1), 56, np.int64)
    live = np.arange(len(shared))
    for at in range(0, 56, 7):
        apart = packed[ranked[live] + at] ^ packed[ranked[live + 1] + at]
        ended = apart != 0
        apart = apart[ended]
        shared[live[ended]] = at + sum((apart >> np.uint64(9 * k) == 0).astype(np.int64) for k in range(1, 7))
        live = live[~ended]
    return shared


def least_documents(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each WIDTH-byte string of the texts, the least document that has it; and where each text's strings begin."""
    sizes = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.uint16) + 1
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined[begin[1:] - 1] = 0
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    ranked = suffix_array(joined)
    ranked = ranked[ranked + WIDTH < begin[owner[ranked] + 1]]
    words = np.concatenate([joined.astype(np.uint64), np.zeros(64, np.uint64)])
    packed = np.zeros(len(words) - 7, np.uint64)
    for j in range(7):
        packed = (packed << np.uint64(9)) | words[j : j + len(packed)]
    equal = common_prefixes(packed, ranked) >= WIDTH
    run = np.concatenate([[0], np.cumsum(~equal)])
    least = np.minimum.reduceat(docs[owner[ranked]], np.flatnonzero(np.concatenate([[True], ~equal])))[run]
    windows = np.concatenate([[0], np.cumsum(sizes - WIDTH + 1)])
    out = np.empty(windows[-1], np.int64)
    out[windows[owner[ranked]] + ranked - begin[owner[ranked]]] = least
    return out, windows


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's segments to the bytes that go, by chunk."""
    loose = zstandard.ZstdDecompressor()
    # A segment of several chunks is sorted once, with the least of its documents.
    index: dict[bytes, int] = {}
    key_parts, size_parts, which, least, entries = [], [], [], [], []
    for chunk, payload in zip(rows["chunk"], rows["payload"]):
        key, size, text, n_spots, spots, names, owner = pickle.loads(loose.decompress(payload))
        docs = names[owner]
        ends = np.cumsum(size).tolist()
        mine = np.array([index.setdefault(text[i:j], len(index)) for i, j in zip([0, *ends], ends)], np.int64)
        key_parts.append(key), size_parts.append(size), which.append(mine)
        least.append(np.minimum.reduceat(docs, np.cumsum(n_spots) - n_spots))
        entries.append((chunk, np.repeat(mine, n_spots), docs, spots))
    texts = list(index)
    which, found = np.concatenate(which), np.concatenate(least)
    keys, sizes, least = (np.empty(len(texts), kind) for kind in (np.uint64, np.int64, np.int64))
    least[:] = np.iinfo(np.int64).max
    keys[which], sizes[which] = np.concatenate(key_parts), np.concatenate(size_parts)
    np.minimum.at(least, which, found)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    group_start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))
    reach = np.concatenate([[0], np.cumsum(sizes[order] + 1)])[group_start]
    width = sizes - WIDTH + 1
    base = np.cumsum(width) - width
    best = np.empty(width.sum(), np.int64)
    i = 0
    while i < len(group_start) - 1:
        j = min(len(reach) - 1, max(i + 1, int(np.searchsorted(reach, reach[i] + SORT_BATCH, "right")) - 1))
        batch = order[group_start[i] : group_start[j]]
        found, begin = least_documents([texts[b] for b in batch], least[batch])
        best[np.repeat(base[batch] - begin[:-1], width[batch]) + np.arange(len(found))] = found
        i = j
    out = []
    for chunk, which, docs, spots in entries:
        count = width[which]
        ends = np.cumsum(count)
        inner = np.arange(ends[-1]) - np.repeat(ends - count, count)
        gone = best[np.repeat(base[which], count) + inner] < np.repeat(docs, count)
        start = (np.repeat(spots.astype(np.int64), count) + inner)[gone]
        if len(start):
            out.append((chunk, _merged(np.stack([start, start + WIDTH], axis=1)).tobytes()))
    return pd.DataFrame(out, columns=["chunk", "spans"])


def _cut(carried: tuple[str, ...], as_text: bool):
    def run(chunks: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        """A chunk's documents without the bytes that go."""
        names = [c.split()[0] for c in RESULT.split(", ")]
        if not len(chunks):
            return pd.DataFrame({c: [] for c in (*names, *carried)})
        ids, at, raw = _unpack(*(chunks[c].iloc[0] for c in ("ids", "at", "blob")))
        gone = _merged(np.concatenate([np.frombuffer(s, np.int64).reshape(-1, 2) for s in spans["spans"]])) if len(spans) else np.zeros((0, 2), np.int64)
        rows = []
        # Spans lie inside documents, but two can touch where documents do.
        first, last = np.searchsorted(gone[:, 1], at[:-1], "right"), np.searchsorted(gone[:, 0], at[1:], "left")
        for d, a, b, i, j in zip(ids.tolist(), at[:-1].tolist(), at[1:].tolist(), first, last):
            mine = np.clip(gone[i:j], a, b)
            kept, here = [], a
            for s, e in mine.tolist():
                kept.append(raw[here:s])
                here = e
            kept = b"".join([*kept, raw[here:b]])
            rows.append((d, b - a, int((mine[:, 1] - mine[:, 0]).sum()), len(mine), kept.decode("utf-8", "ignore") if as_text else kept, (mine - a).tobytes()))
        out = pd.DataFrame(rows, columns=names)
        if carried:
            rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(chunks["rest"].iloc[0])).read_all()
            for c in carried:
                out[c] = rest.column(c).to_pandas(types_mapper=pd.ArrowDtype).astype(object).where(lambda v: v.notna(), None)
        return out

    return run


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, spans)`` for each row; ``kept``: the remaining bytes, or as a
    string without the characters that a span cuts in two; ``spans``: start and end of each removed run, int64 pairs.
    Columns named in ``carry`` come along."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    result = ", ".join([RESULT.replace("kept binary", "kept string") if as_text else RESULT, *(f"`{c}` {kinds[c]}" for c in carry)])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carry)
    chunks = materialize(docs.where("doc_id is not null").mapInArrow(tidy(_packed), CHUNK_SCHEMA), "uncompressed")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = lambda share: max(6, (total // share).bit_length())
    keys = chunks.drop("rest").mapInArrow(tidy(_keys_out(bits(KEY_SHARD))), "bucket int, chunk long, keys binary, counts binary")
    codes = keys.groupBy("bucket").applyInPandas(tidy_group(_codes), "chunk long, bucket int, codes binary")
    # Both cogroups read the same columns, so that one exchange of the chunks serves them.
    segments = chunks.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInPandas(tidy_groups(_segments_out(bits(SEGMENT_SHARD))), "bucket long, chunk long, payload binary")
    gone = segments.groupBy("bucket").applyInPandas(tidy_group(_compared), "chunk long, spans binary")
    out = chunks.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInPandas(tidy_groups(_cut(carry, as_text)), result)
    bare = docs.where("doc_id is null").select(
        F.lit(None).cast("long").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.col("text").cast("string" if as_text else "binary").alias("kept"), F.lit(b"").cast("binary").alias("spans"), *carry,
    )
    return out.unionByName(bare)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their remaining text, all columns as they were; characters cut in two by a span go whole."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    return remove_repeats(docs, carry, True).select("doc_id", F.col("kept").alias("text"), *carry).select(*docs.columns)
