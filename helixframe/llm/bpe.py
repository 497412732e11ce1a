"""Problem 6: encoding with a public byte-level BPE vocabulary.

Method: backtracking encoder. An Aho-Corasick automaton gives the longest token that starts at each byte of a piece. Tokens
are taken greedily; a token may follow another only if the pair is compatible, that is if merging the two tokens' bytes
yields just these two. If nothing fits, the last token is given up for its next shorter prefix. A position at which this
failed is never entered again, so time is linear in the piece. Compatible neighbours make the whole sequence the one that
merging in rank order gives, so the ids are exact.

Decoding copies slices of one byte string through an offset table."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how the vocabulary's pieces are split before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 200_000  # remembered pieces and pairs per worker; they only save time
_BUILT: dict[str, Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable Latin-1 bytes stand for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, spec: bytes):
        import ahocorasick
        import regex

        model = json.loads(spec)["model"]
        byte = _byte_letters()
        latin = lambda w: "".join(chr(byte[x]) for x in w)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # tokens are numbered by rank: the bytes, then each merge's result
        names = [chr(b) for b in range(256)] + [latin(a) + latin(b) for a, b in merges]
        self.rank = {w: i for i, w in enumerate(names)}
        letter = {b: x for x, b in byte.items()}
        self.id = [model["vocab"]["".join(letter[ord(x)] for x in w)] for w in names]
        self.size = [len(w) for w in names]
        self.names = names
        self.left, self.right, self.pair = list(range(256)), list(range(256)), {}
        for i, (a, b) in enumerate(merges):
            x, y = self.rank[latin(a)], self.rank[latin(b)]
            self.left.append(x)
            self.right.append(y)
            self.pair.setdefault(x << 20 | y, 256 + i)
        self.auto = ahocorasick.Automaton()
        for i, w in enumerate(names):
            self.auto.add_word(w, i)
        self.auto.make_automaton()
        self.find = regex.compile(PIECES).findall
        self.short: dict[int, int] = {}
        self.fit: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        # offset table: the bytes of id i are blob[offset[i] : offset[i + 1]]
        words = [b""] * (max(self.id) + 1)
        for i, w in zip(self.id, names):
            words[i] = w.encode("latin-1")
        self.blob = b"".join(words)
        self.offset = np.concatenate([[0], np.cumsum([len(w) for w in words])])

    def shorter(self, t: int) -> int:
        """The longest token that is a proper prefix of t, or -1."""
        s = self.short.get(t)
        if s is None:
            w = self.names[t]
            s = self.short[t] = next((self.rank[w[:n]] for n in range(len(w) - 1, 0, -1) if w[:n] in self.rank), -1)
        return s

    def compatible(self, a: int, b: int) -> bool:
        """Does encoding the bytes of a and b together give a, b? Merges are undone from the latest on; the tokens at the
        seam must have no merge that would have come before the ones that made their neighbours."""
        key = a << 20 | b
        known = self.fit.get(key)
        if known is not None:
            return known
        pair, left, right = self.pair, self.left, self.right
        bound, good = 1 << 40, None
        while good is None:
            m = pair.get(a << 20 | b)
            if m is not None and m < bound:
                good = False
            elif a >= 256 and (a > b or b < 256):
                bound, a = a, right[a]
            elif b >= 256:
                bound, b = b + 1, left[b]
            else:
                good = True
        if len(self.fit) > 5 * MEMO:
            self.fit.clear()
        self.fit[key] = good
        return good

    def piece(self, text: str) -> tuple[int, ...]:
        s = text.encode("utf-8").decode("latin-1")
        whole = self.rank.get(s)
        if whole is not None:
            return (self.id[whole],)
        size, n = self.size, len(s)
        longest = [0] * n
        for end, t in self.auto.iter(s):  # of the tokens from one start, the longest ends last
            longest[end - size[t] + 1] = t
        closed = bytearray(n + 1)
        taken: list[int] = []
        pos, t = 0, longest[0]
        while pos < n:
            last = taken[-1] if taken else -1
            while t >= 0 and (closed[pos + size[t]] or (last >= 0 and not self.compatible(last, t))):
                t = self.shorter(t)
            if t >= 0:
                taken.append(t)
                pos += size[t]
                t = longest[pos] if pos < n else -1
            else:
                closed[pos] = 1
                t = taken.pop()
                pos -= size[t]
        return tuple(self.id[x] for x in taken)

    def encode_to(self, text: str, out: array) -> None:
        memo = self.memo
        for w in self.find(text):
            ids = memo.get(w)
            if ids is None:
                ids = self.piece(w)
                if len(w) <= 64:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[w] = ids
            out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_to(text, out)
        return out.tolist()

    def decode(self, ids) -> str:
        o, blob = self.offset, self.blob
        return b"".join(blob[o[i] : o[i + 1]] for i in ids).decode("utf-8", "replace")


def encoder(spec: bytes) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _BUILT:
        _BUILT[key] = Encoder(spec)
    return _BUILT[key]


def _spec(df: DataFrame, path: str):
    """The vocabulary file, read by the driver and broadcast: a fixed file of under 2 MB, whatever the corpus."""
    with open(path, "rb") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError("a vocabulary of more than 64 MB isn't broadcast")
    ship(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(spec)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """id_col and ids (array of int): the text's ids without special tokens, whose strings are ordinary text.

    Null and empty texts give an empty array, never null. One row per input row, repeated rows and null ids included; an
    empty table gives none. Texts are encoded whole, whatever their length. Other columns aren't read. No shuffle."""
    spec = _spec(docs, path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in it:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                flat, ends = array("i"), [0]
                for t in part.column(1):
                    t = t.as_py()
                    if t:
                        enc.encode_to(t, flat)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """id_col and text: the inverse of encode, except that what was null comes back as the empty text."""
    spec = _spec(encoded, path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in it:
            texts = [enc.decode(x.as_py() or ()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def roundtrip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """id_col, n_ids and same: how many ids each text has and whether they decode to it again (null counts as empty). One row
    per input row, repeated rows and null ids included; each text is encoded once, nothing is shuffled or joined."""
    spec = _spec(docs, path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in it:
            texts = [x.as_py() or "" for x in batch.column(1)]
            ids = [enc.encode(t) for t in texts]
            same = [enc.decode(x) == t for x, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array(same, pa.bool_())], names=[id_col, "n_ids", "same"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_ids int, same boolean")
