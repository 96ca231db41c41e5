"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece exactly one token can end its encoding. Storing that token for every byte of a piece
(`Prefixes`) gives the encoding of any prefix by walking back, makes appending bytes exact without starting again,
and lets an edit keep all that stands before it. A token may follow another exactly if encoding the two together
would not have merged across their border; that test walks down the merges of both and is remembered per pair.

Texts are split by the tokenizer's pattern and each match is encoded separately, as the tokenizer's own library
does; a match that is itself a token is that token. `TextEncoder` keeps the pieces of a text, so that an edit
re-encodes only the pieces around it.

Null texts count as empty: no tokens, and the empty string decoded. Lone surrogates can't occur in Spark's strings.
Repeated rows are encoded each for itself; other columns are ignored. A worker remembers two
generations of at most `MEMORY` chunks of up to 64 characters each, so its memory is bounded.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import Recent, arrow_map, id_and_text, table

VOCABULARY = "byte_bpe_50k.tiktoken"
MEMORY = 150_000


class Vocabulary:
    """Ranks of byte strings, their merges, and which tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {r: t for t, r in self.rank.items()}
        self.size = {r: len(t) for t, r in self.rank.items()}
        # the tokens by their bytes from the last to the first: (node, byte) to node, and the token at a node or -1
        self.back, self.at = {}, [-1]
        for t, r in self.rank.items():
            node = 0
            for b in reversed(t):
                if (after := self.back.get(node << 8 | b)) is None:
                    after = self.back[node << 8 | b] = len(self.at)
                    self.at.append(-1)
                node = after
            self.at[node] = r
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.pairs: dict[int, bool] = {}
        # shorter ranks come first: when a token is looked at, the tokens that it can be made of are known
        for r in sorted(self.bytes):
            t = self.bytes[r]
            if len(t) > 1 and (parts := self._two_parts(t, r)):
                self.parts[r] = parts
                self.made[parts] = r

    def _two_parts(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`: its encoding with the ranks below its own."""
        x = [bytes((b,)) for b in token]
        while len(x) > 2:
            best = min(range(len(x) - 1), key=lambda i: self.rank.get(x[i] + x[i + 1], rank))
            if self.rank.get(x[best] + x[best + 1], rank) >= rank:
                return None
            x[best : best + 2] = [x[best] + x[best + 1]]
        return (self.rank[x[0]], self.rank[x[1]]) if len(x) == 2 and all(y in self.rank for y in x) else None

    def after(self, data: bytes, end: int, last: Callable[[int], int]) -> int:
        """The token that ends the encoding of data[:end], given the last token of each shorter prefix."""
        token, back, node, start, found = self.at, self.back, 0, end, []
        while start and (node := back.get(node << 8 | data[start - 1])) is not None:
            start -= 1
            if token[node] >= 0:
                found.append((start, token[node]))
        while found:
            start, t = found.pop()
            if not start or self.fits(last(start), t):
                return t
        raise ValueError(f"no token can end at byte {end}")

    def fits(self, left: int, right: int) -> bool:
        """Whether `right` can follow `left` in an encoding."""
        key = left << 32 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            known = self.pairs[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Undo the merges inside both tokens, latest first. A pair at the border that could have merged earlier
        # than the merge just undone would have done so, and the two tokens would never have come about.
        limit = 1 << 62
        while True:
            if self.made.get((left, right), limit) < limit:
                return False
            inner_left, inner_right = self.parts.get(left), self.parts.get(right)
            if inner_left is None and inner_right is None:
                return True
            if inner_right is None or (inner_left is not None and left > right):
                limit, left = left, inner_left[1]
            else:
                # merges of one rank go from left to right: the border's comes before that of the right token
                limit, right = right + 1, inner_right[0]


class PrefixTree:
    """The unique last token of every prefix of many byte strings; prefixes that strings share are worked out once.

    A node stands for a prefix. The tree is dropped when it has `most` nodes.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 250_000):
        self.v, self.most = vocabulary, most
        self.child: dict[int, int] = {}
        self.last = [-1]

    def tokens(self, data: bytes) -> list[int]:
        """The encoding of `data`."""
        if len(self.last) + len(data) > self.most:
            self.child, self.last = {}, [-1]
        child, last, node, path = self.child, self.last, 0, [0]
        for b in data:
            if (node := child.get(node << 8 | b)) is None:
                break
            path.append(node)
        if node is None:
            v = self.v
            token, back, pairs = v.at, v.back.get, v.pairs.get
            for end in range(len(path), len(data) + 1):
                # as Vocabulary.after, written out here, where nearly all of the time goes
                node, start, found = 0, end, []
                while start and (node := back(node << 8 | data[start - 1])) is not None:
                    start -= 1
                    if (t := token[node]) >= 0:
                        found.append((start, t))
                for start, t in reversed(found):
                    if not start:
                        break
                    left = last[path[start]]
                    if (fits := pairs(left << 32 | t)) is None:
                        fits = v.fits(left, t)
                    if fits:
                        break
                else:
                    raise ValueError(f"no token can end at byte {end}")
                child[path[-1] << 8 | data[end - 1]] = len(last)
                path.append(len(last))
                last.append(t)
        at, out, size = len(data), [], self.v.size
        while at:
            t = last[path[at]]
            out.append(t)
            at -= size[t]
        out.reverse()
        return out


class Prefixes:
    """The unique last token of every prefix of one byte string, for appending to it and editing it."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def append(self, more: bytes) -> None:
        at = len(self.data)
        self.data += more
        data, last = bytes(self.data), self.last
        for end in range(at + 1, len(data) + 1):
            last.append(self.v.after(data, end, lambda k: last[k - 1]))

    def replace(self, start: int, end: int, by: bytes) -> None:
        """An edit: what is known of the bytes before `start` stays."""
        rest = bytes(self.data[end:])
        del self.data[start:], self.last[start:]
        self.append(by + rest)

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first `end` bytes, all by default."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.v.bytes[out[-1]])
        return out[::-1]


class Encoder:
    """Texts to tokens and back, with a bounded memory of pieces.

    No match of the pattern goes across a space that stands between two characters that are not white space, but may
    begin with it; a line break between two such characters is a match of its own. So texts whose white space is
    single spaces and line breaks are cut there without the pattern; all other texts are split by the pattern itself.
    """

    _PAIRS = ("  ", " \n", "\n ", "\n\n")
    _OTHER = tuple("\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0")
    _WIDE = re.compile("[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.v = Vocabulary(path)
        self.split, self.tree = regex.compile(pattern), PrefixTree(self.v)
        self.chunks = Recent(self.chunk, MEMORY)
        most = max(self.v.bytes) + 1
        self.sizes = np.array([len(self.v.bytes.get(r, b"")) for r in range(most)], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.flat = np.frombuffer(b"".join(self.v.bytes.get(r, b"") for r in range(most)), np.uint8)

    def piece(self, piece: str) -> bytes:
        """The tokens of one match of the pattern, as little-endian unsigned 32-bit integers."""
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.v.rank.get(raw)
        return array("I", [whole] if whole is not None else self.tree.tokens(raw)).tobytes()

    def matches(self, text: str) -> bytes:
        """The tokens of a text, by the pattern."""
        return b"".join(map(self.piece, self.split.findall(text)))

    def chunk(self, chunk: str) -> bytes:
        """The tokens of a chunk that follows a space, or is a line break and what follows it."""
        if chunk.isalpha():
            return self.piece(" " + chunk)
        if chunk[:-1].isalpha() and chunk[-1] in ".,":
            return self.piece(" " + chunk[:-1]) + self.piece(chunk[-1])
        return self.matches(chunk if chunk[:1] == "\n" else " " + chunk)

    def encode(self, text: str) -> bytes:
        """The tokens of a text, as piece() gives them."""
        if any(x in text for x in self._PAIRS) or any(x in text for x in self._OTHER) or (not text.isascii() and self._WIDE.search(text)):
            # a space before anything but white space may still begin a chunk
            first, *rest = re.split(r" (?=\S)", text)
            return self.matches(first) + b"".join([self.chunks[x] if "\n" not in x else self.matches(" " + x) for x in rest])
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.matches(first) + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered at once."""
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.flat[at].tobytes()


class TextEncoder:
    """A text that is edited: pieces before and after an edit that the split leaves alone keep their tokens."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.e, self.text = encoder, text
        self.ends = [m.end() for m in encoder.split.finditer(text)]
        self.ids = [encoder.piece(m[0]) for m in encoder.split.finditer(text)]

    def replace(self, start: int, end: int, by: str) -> None:
        """A match looks at two characters beyond its end at most, and at none before its start."""
        text, shift = self.text[:start] + by + self.text[end:], len(by) - (end - start)
        keep = next((k for k, e in enumerate(self.ends) if e > start - 3), len(self.ends))
        later = {e + shift: k for k, e in enumerate(self.ends) if e >= end}
        at = self.ends[keep - 1] if keep else 0
        ends, ids, rest = self.ends[:keep], self.ids[:keep], []
        while at < len(text):
            if at >= start + len(by) and at in later:
                k = later[at] + 1
                rest = [(e + shift, x) for e, x in zip(self.ends[k:], self.ids[k:], strict=True)]
                break
            m = self.e.split.match(text, at)
            ends.append(m.end())
            ids.append(self.e.piece(m[0]))
            at = m.end()
        self.text, self.ends, self.ids = text, ends + [e for e, _ in rest], ids + [x for _, x in rest]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def tokens(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.ids), "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (the tokens as little-endian unsigned 32-bit integers)."""
    path = path or public_tokenizers.path(VOCABULARY)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.encode(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return arrow_map(id_and_text(docs), each, "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded (bytes): the inverse of encode."""
    path = path or public_tokenizers.path(VOCABULARY)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([e.decode(np.frombuffer(x, "<u4")) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids", "decoded"])

    return arrow_map(tokens, each, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: encode() and decode() of it in one pass, with one set of workers and one memory of pieces."""
    path = path or public_tokenizers.path(VOCABULARY)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        ids = [e.encode(t) for t in batch.column(1).to_pylist()]
        back = [e.decode(np.frombuffer(x, "<u4")) for x in ids]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=["doc_id", "ids", "decoded"])

    return arrow_map(id_and_text(docs), each, "doc_id long, ids binary, decoded binary")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; number and digests of both."""
    return round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
