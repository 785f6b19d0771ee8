"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut at the first white space behind each place where a rolling hash of the last bytes meets a condition, so
equal passages of different documents are cut alike.  Each distinct chunk of a task is encoded once, as a whole.  Every
join of two chunks is then checked: the last words of the left and the first of the right are encoded apart and
together.  Where both agree with the chunks' own ids the join is exact; where they do not, the words around the join
are taken from the common encoding, as soon as the ids further out agree on both sides; if no stretch of the two chunks
agrees, the whole text is encoded anew.

Where the tokenizer is of the kind that ``Lean`` knows by its definition, a chunk goes whole through the same model with
the steps before it done for many chunks at once; its ends are still held against the tokenizer itself at every join.

Sharing is within a task: one shared by all tasks would send every text through a shuffle, and the ids back.

Defined results: a null text is an empty text with no ids; repeated rows give repeated rows; an empty table gives an
empty table; other columns are ignored.  Strings of special tokens inside a text become those tokens, as the tokenizer
does it.  A text without white space is one chunk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import SEPARATOR, RollingHash, flat, slices, tidy

SCHEMA = "doc_id long, token_ids array<int>, decoded string"
#: Bytes under the rolling hash; a chunk ends where ``BITS`` bits of it are zero, about every 2 KB.
WINDOW, BITS = 32, 11
#: Bytes whose hashes are made at once.
STRETCH = 1 << 18
BLANKS = bytes(32 if SEPARATOR[c] else c for c in range(256))


#: What ``Lean`` stands for: steps before the model, as their definitions give them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLITS = [
    {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
BLANK, LETTER, DIGIT, SYMBOL, ODD = range(5)


class Lean:
    """The steps before the model of a tokenizer with ``NORMALIZERS`` and ``SPLITS``, for many texts at once: what is
    left to the library is the model on pieces that stand between blanks.

    It holds for characters below U+0300, where NFC changes nothing and lower case is that of each character alone; what
    such a character becomes, its class and its bytes' letters are asked of the tokenizer.  Texts with others, or with an
    added token, are left out.
    """

    LIMIT = 0x300

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        self.added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer = Tokenizer(tokenizer.model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        pieces = lambda t: [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(t)]
        self.lower = np.full(self.LIMIT + 1, 32, np.uint16)
        self.kind = np.full(self.LIMIT + 1, ODD, np.uint8)
        self.first, self.second = np.full(self.LIMIT + 1, 32, np.uint16), np.zeros(self.LIMIT + 1, np.uint16)
        for c in range(self.LIMIT):
            x = tokenizer.normalizer.normalize_str(chr(c))
            if len(x) != 1 or ord(x) >= self.LIMIT:
                continue
            names = pieces(x)
            if not names:
                self.kind[c] = BLANK
            elif len(names) == 1 and len(names[0]) <= 2:
                alike = [k for k, t in ((LETTER, f"a{x}a"), (SYMBOL, f"!{x}!")) if len(pieces(t)) == 1]
                self.kind[c] = alike[0] if alike else DIGIT if len(pieces(x + x)) == 2 else ODD
                self.lower[c], self.first[c] = ord(x), ord(names[0][0])
                self.second[c] = ord(names[0][1]) if len(names[0]) == 2 else 0

    @classmethod
    def of(cls, tokenizer) -> Lean | None:
        """None if the tokenizer is of another kind."""
        state = lambda x: json.loads(x.__getstate__()) if x is not None else {}
        before, split = (state(getattr(tokenizer, k, None)) for k in ("normalizer", "pre_tokenizer"))
        if (before.get("normalizers"), split.get("pretokenizers")) != (NORMALIZERS, SPLITS):
            return None
        if any(x is not None for x in (tokenizer.post_processor, tokenizer.truncation, tokenizer.padding)):
            return None
        return cls(tokenizer) if all(not t.normalized for t in tokenizer.get_added_tokens_decoder().values()) else None

    def spaced(self, texts: list[bytes]) -> list[str | None]:
        """Each text as the model gets it, a blank between any two pieces; None for a text left out."""
        raw = b" ".join([*texts, b"   "])
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(size + 1) - 1
        start, code = end - size, np.frombuffer(raw, np.uint8)
        if not raw.isascii():
            count = np.zeros(len(raw) + 1, np.int32)
            np.cumsum((code & 0xC0) != 0x80, out=count[1:])
            start, end = count[start], count[end]
            code = np.minimum(np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32), self.LIMIT).astype(np.uint16)
        kind = self.kind[code]
        begins = kind == DIGIT
        begins[1:] |= kind[1:] != kind[:-1]
        begins[0] = True
        # A quote that begins a piece takes one of the endings s t m d re ve ll along, and only that.
        quote = np.flatnonzero((code == 39) & begins)
        one, two = self.lower[code[quote + 1]], self.lower[code[quote + 2]]
        short = quote[np.isin(one, [*b"stmd"])]
        long = quote[((two == 101) & np.isin(one, [*b"rv"])) | ((one == 108) & (two == 108))]
        begins[short + 1] = begins[long + 1] = False
        begins[short + 2] = begins[long + 3] = True
        # Only a piece right behind another needs a blank.
        filled = kind != BLANK
        begins[0] = False
        begins[1:] &= filled[1:] & filled[:-1]
        double = np.flatnonzero(self.second[code])
        wide = 1 + begins.view(np.int8)
        wide[double] += 1
        at = np.zeros(len(code) + 1, np.int32)
        np.cumsum(wide, out=at[1:])
        out = np.full(at[-1], 32, "<u2")
        out[at[:-1] + begins] = self.first[code]
        out[at[double] + begins[double] + 1] = self.second[code[double]]
        line = out.tobytes().decode("utf-16-le")
        odd = np.zeros(len(code) + 1, np.int32)
        np.cumsum(kind == ODD, out=odd[1:])
        whole = (odd[start] == odd[end]).tolist()
        for t in self.added:
            if t in raw:
                whole = [ok and t not in x for ok, x in zip(whole, texts)]
        return [line[a:b] if ok else None for ok, a, b in zip(whole, at[start].tolist(), at[end].tolist())]


class ChunkCoder:
    """Encodes texts by shared chunks.  ``room`` bounds the bytes of remembered chunks and joins; beyond, both start
    anew."""

    def __init__(self, tokenizer, room: int = 32 << 20):
        self.tokenizer, self.room, self.held = tokenizer, room, 0
        self.chunks: dict[bytes, bytes] = {}
        self.joins: dict[tuple[bytes, bytes], tuple[bytes, bytes, bytes]] = {}
        self.hash = RollingHash()
        self.lean = Lean.of(tokenizer)
        self.names = pa.array([tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))])
        self.plain = tokenizer.decoder is None  # decoding then joins the tokens' names with spaces
        added = [str(t.content).encode() for t in tokenizer.get_added_tokens_decoder().values()]
        # A special token that holds white space must fit between the ends that are compared.
        self.reach = max((2 * len(t) for t in added if len(t.split()) > 1), default=0)

    def direct(self, texts: list[bytes]) -> list[bytes]:
        """The ids (int32) of texts, each encoded as it stands."""
        return self.found(self.tokenizer, [t.decode("utf-8") for t in texts])

    def found(self, tokenizer, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 256):
            out += [np.array(x.ids, np.int32).tobytes() for x in tokenizer.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
        return out

    def whole(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of chunks, each encoded whole: by the lean steps, or as it stands where they do not hold."""
        if not self.lean or not chunks:
            return self.direct(chunks)
        order = sorted(range(len(chunks)), key=lambda i: chunks[i].isascii())
        out = [b""] * len(chunks)
        for k in range(0, len(order), 256):
            part = order[k : k + 256]
            spaced = self.lean.spaced([chunks[i] for i in part])
            lean, rest = ([i for i, t in zip(part, spaced) if (t is None) == left] for left in (False, True))
            for i, ids in zip(lean, self.found(self.lean.tokenizer, [t for t in spaced if t is not None])):
                out[i] = ids
            for i, ids in zip(rest, self.direct([chunks[i] for i in rest])):
                out[i] = ids
        return out

    def cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Positions of ``data`` where chunks begin: the starts of texts (offsets ``at``), and the first white space at
        or behind each window inside a text whose hash meets the condition."""
        hits = []
        for i in range(0, len(data) - WINDOW, STRETCH):
            part = data[i : i + STRETCH + WINDOW]
            sums = self.hash.sums(part)
            n = min(STRETCH, len(part) - WINDOW)
            hits.append(np.flatnonzero(self.hash.ranges(sums, slice(n), slice(WINDOW, n + WINDOW)) >> np.uint64(64 - BITS) == 0) + i)
        if not hits:
            return at[:-1]
        hit, blank = np.concatenate(hits), np.flatnonzero(SEPARATOR[data])
        after = np.searchsorted(blank, hit + WINDOW)
        hit, after = hit[after < len(blank)], after[after < len(blank)]
        spot = blank[after]
        return np.union1d(at[:-1], spot[np.searchsorted(at, hit, "right") == np.searchsorted(at, spot, "right")])

    def tail(self, chunk: bytes, words: int) -> int:
        """Where the last ``words`` words of a chunk begin, with the white space before them."""
        at, text = len(chunk), chunk.translate(BLANKS)
        for _ in range(words):
            at = text.rfind(b" ", 0, len(text[:at].rstrip(b" ")))
            if at < 0:
                return 0
        at = len(text[:at].rstrip(b" "))
        return at if len(chunk) - at >= self.reach else self.tail(chunk, 2 * words)

    def head(self, chunk: bytes, words: int) -> int:
        """Where the first ``words`` words of a chunk end."""
        at, text = 0, chunk.translate(BLANKS)
        for _ in range(words):
            at = text.find(b" ", len(text) - len(text[at:].lstrip(b" ")))
            if at < 0:
                return len(chunk)
        return at if at >= self.reach else self.head(chunk, 2 * words)

    def ends(self, left: bytes, right: bytes, words: int) -> tuple[bytes, bytes]:
        return left[self.tail(left, words) :], right[: self.head(right, words)]

    def learn(self, pairs: set[tuple[bytes, bytes]]) -> None:
        """Remember for each tail and head their ids: of the tail, of both together, of the head."""
        new = [p for p in pairs if p not in self.joins]
        if not new:
            return
        apart = {t for p in new for t in p}
        of = dict(zip(apart, self.direct(list(apart))))
        for (a, b), both in zip(new, self.direct([a + b for a, b in new])):
            self.joins[a, b] = of[a], both, of[b]
            self.held += 2 * (len(a) + len(b)) + 3 * len(both) + 400

    def repair(self, left: bytes, right: bytes) -> tuple[int, bytes, int] | None:
        """How two neighbouring chunks join: bytes of ids to drop from the left's end, ids to put there, and bytes to
        drop from the right's start.  None if no stretch of the two agrees."""
        words = 2
        while True:
            a, b = self.ends(left, right, words)
            self.learn({(a, b)})
            of_a, both, of_b = self.joins[a, b]
            if self.chunks[left].endswith(of_a) and self.chunks[right].startswith(of_b):
                if both == of_a + of_b:
                    return 0, b"", 0
                # The outer halves must come out alike alone, beside their own neighbours and across the join.
                far_a, far_b = a[: self.tail(a, words // 2)], b[self.head(b, words // 2) :]
                if far_a and far_b:
                    out_a, out_b = self.direct([far_a, far_b])
                    if out_a and out_b and all((of_a.startswith(out_a), both.startswith(out_a), of_b.endswith(out_b), both.endswith(out_b), len(both) >= len(out_a) + len(out_b))):
                        return len(of_a), both, len(of_b)
            if len(a) == len(left) and len(b) == len(right):
                return None
            words *= 2

    def joined(self, text: bytes, chunks: list[bytes]) -> bytes:
        """The ids of a text from those of its chunks."""
        parts, drop = [], 0
        for left, right in zip(chunks, chunks[1:]):
            cut, between, skip = self.repair(left, right) or (-1, b"", 0)
            mine = self.chunks[left]
            if cut < 0 or drop + cut > len(mine):
                return self.direct([text])[0]
            parts += mine[drop : len(mine) - cut], between
            drop = skip
        return b"".join([*parts, self.chunks[chunks[-1]][drop:]])

    def encode(self, texts: list[bytes], cuts: list[list[int]]) -> list[bytes]:
        """The ids (int32) of each text; ``cuts``: where its chunks begin."""
        if self.held > self.room:
            self.chunks, self.joins, self.held = {}, {}, 0
        split = [[text[i:j] for i, j in zip(cut, [*cut[1:], len(text)])] for text, cut in zip(texts, cuts)]
        fresh = list({c for mine in split for c in mine if c not in self.chunks})
        for chunk, ids in zip(fresh, self.whole(fresh)):
            self.chunks[chunk] = ids
            self.held += len(chunk) + len(ids) + 200
        self.learn({self.ends(a, b, 2) for mine in split for a, b in zip(mine, mine[1:])})
        return [self.joined(text, mine) for text, mine in zip(texts, split)]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The decoded form of each text's ids."""
        if self.plain:
            return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values)), " ")
        return pa.array(self.tokenizer.decode_batch(ids.to_pylist(), skip_special_tokens=False), pa.string())


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        coder = ChunkCoder(tokenizer)
        for batch in batches:
            at, data = flat(batch.column(1))
            for i, j in slices(at):
                own = at[i : j + 1] - at[i]
                part = data[at[i] : at[j]]
                cuts = coder.cuts(part, own)
                raw = part.tobytes()
                bounds = np.searchsorted(cuts, own)
                texts = [raw[a:b] for a, b in zip(own, own[1:])]
                # Empty texts begin where the next one does.
                begins = [(cuts[a:b] - o).tolist() or [0] for a, b, o in zip(bounds, bounds[1:], own)]
                got = coder.encode(texts, begins)
                ids = pa.array(np.frombuffer(b"".join(got), np.int32))
                ends = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, coder.decode(lists)], ["doc_id", "token_ids", "decoded"])

    return tidy(run)


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(doc_id, token_ids, decoded)`` for each row; the path must be readable where the tasks run."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_coded(tokenizer_path), SCHEMA)
