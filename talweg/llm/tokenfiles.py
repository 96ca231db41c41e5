"""Token-ID output: flat files of unsigned integers, 64-bit document offsets, memory-mapped reading.

Documents are range-partitioned and sorted by doc_id (null ids first; equal ids by a hash of the text, equal ones of
both in any order), so the files in order of partition hold all documents in order, and no id's rows need to be in one task. Each task writes three files under a name of its own attempt:
`.bin` (token ids, 16 bits each if the vocabulary allows, else 32, little-endian, each document's end id included),
`.off` (64-bit: where each document ends, in ids, from the start of the file) and `.doc` (64-bit doc_id and a 0/1
null mark, per document). The manifest names the files of the attempts that succeeded, so files of lost or repeated
attempts are never read; the base of each file, the ids in all files before it, is a prefix sum over the manifest,
which has one row per file.

Tokens are those of the tokenizers library. Its splitting drops white space, so what stands between two spaces or
line breaks is encoded by itself, and remembered within bounds. Null and empty texts hold the end id alone; an empty
table gives no files and no rows; repeated rows are all written; other columns are ignored. A very long text is encoded
whole, in the memory of its task. Files on a local file system are memory-mapped when read; on any other, ranges of at
most about `RANGE` bytes (one document at least) are read.
"""

from __future__ import annotations

import json
import mmap
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import id_and_text, table, work_dir, written

VOCABULARY, END_ID, MEMORY, RANGE = "word_bpe_49k.json", 1, 400_000, 16 << 20

#: The split for which texts may be cut at spaces and words be encoded by themselves.
_BY_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters that keep their number as small letters and have no other normal form (U+0130 has one), and what may stand after them.
_LATIN = re.compile("([A-Za-zªµºÀ-ÖØ-öø-įı-ſ]+)([.,]?)")


class WordEncoder:
    """Texts to flat bytes of `dtype`, with a bounded memory of words.

    New words of Latin letters, perhaps with a full stop or comma after them, go to the tokenizer's model as its normaliser
    and split would hand them over: small letters, as bytes. Other words of letters alone are encoded many at a time,
    parted by spaces, and told apart by the tokens that end a word; a word with one full stop or comma after it is two matches of the tokenizer's split, so two entries together,
    if it is of letters alone once normalised too (a combining mark at its end, as of U+0130 in small letters, would join
    the stop); all else is encoded by itself. All this holds for tokenizers that normalise and split as `_BY_WORDS` does;
    with any other, texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.known, self.old = {}, {}
        self.marks = {x: ids.tobytes() for x, ids in zip(".,", self._ids([".", ","]), strict=True)}
        told = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        last = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])[-1]
        as_bytes = last.get("type") == "ByteLevel" and not last["add_prefix_space"] and not last["use_regex"]
        self.by_words = kinds == ["NFC", "Replace", "Lowercase"] and split == [_BY_WORDS, None] and bool(suffix) and as_bytes
        self.bytes_of = [np.array([i], self.dtype).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.latin = {ord(c): "".join(x for x, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)) for c in map(chr, range(0x180)) if c.isalpha() and c == c.lower()}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_letters(self, word: str) -> bool:
        return word.isalpha() and (word.isascii() or self.tokenizer.normalizer.normalize_str(word).isalpha())

    def _learn(self, new: list[str]) -> None:
        known, old = self.known, self.old
        words, stops, others = set(), [], []
        latin, model, bytes_of, table = _LATIN.fullmatch, self.tokenizer.model.tokenize, self.bytes_of, self.latin
        for x in new:
            if x in old:
                known[x] = old[x]
            elif m := latin(x):
                word, stop = m.groups()
                ids = known.get(word) or old.get(word)
                if ids is None:
                    plain = word.lower()
                    ids = known[word] = b"".join([bytes_of[t.id] for t in model(plain if plain.isascii() else plain.translate(table))])
                if stop:
                    known[x] = ids + self.marks[stop]
            elif x.isalpha():
                words.add(x)
            elif x[-1:] in (".", ",") and self._of_letters(x[:-1]):
                stops.append(x)
                if x[:-1] not in known:
                    words.add(x[:-1])
            else:
                others.append(x)
        others += [mark for mark in {x[-1] for x in stops} if mark not in known]
        todo = list(words)
        for at in range(0, len(todo), 128):
            some = todo[at : at + 128]
            ids = self._ids([" ".join(some)])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw, w = ids.tobytes(), self.dtype.itemsize
                known |= {x: raw[a * w : b * w] for x, a, b in zip(some, [0, *cuts.tolist()], cuts.tolist(), strict=False)}
            else:
                others += some
        known |= {x: ids.tobytes() for x, ids in zip(others, self._ids(others), strict=True)}
        for x in stops:
            known[x] = known[x[:-1]] + known[x[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Small letters save entries, but special tokens are found in the text as it is, so such texts stay as they are."""
        if not self.by_words:
            return [ids.tobytes() for ids in self._ids(texts)]
        out = []
        for at in range(0, len(texts), 256):
            if len(self.known) > MEMORY:
                self.old, self.known = self.known, {}
            split = [(t.lower() if t.isascii() and "<|" not in t else t).replace("\n", " ").split(" ") for t in texts[at : at + 256]]
            known = self.known
            if new := [x for x in set().union(*split) if x not in known]:
                self._learn(new)
            get = self.known.__getitem__
            out += [b"".join(map(get, words)) for words in split]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, out_dir: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files under `out_dir`, a URI that all executors reach; the manifest: part, name, itemsize, n_docs, n_ids."""
    path = path or public_tokenizers.path(VOCABULARY)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(out_dir)
        fs.create_dir(root, recursive=True)
        e, part = encoder(path), TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}"
        end = np.array([end_id], e.dtype).tobytes()
        at = n_docs = 0
        with fs.open_output_stream(f"{root}/{name}.bin") as ids, fs.open_output_stream(f"{root}/{name}.off") as off, fs.open_output_stream(f"{root}/{name}.doc") as doc:
            for batch in batches:
                sizes = []
                for k in range(0, batch.num_rows, 1024):
                    for x in e.encode(batch.column(1).slice(k, 1024).to_pylist()):
                        sizes.append(len(x) // e.dtype.itemsize + 1)
                        ids.write(x + end)
                ends = at + np.cumsum(np.array(sizes, np.int64))
                at, n_docs = int(ends[-1]) if len(ends) else at, n_docs + len(ends)
                off.write(ends.astype("<i8").tobytes())
                keys = batch.column(0)
                doc.write(np.column_stack([keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False)]).astype("<i8").tobytes())
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([e.dtype.itemsize], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([at], pa.int64())], names=["part", "name", "itemsize", "n_docs", "n_ids"])

    key = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("i")]
    rows = id_and_text(docs).select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("i")).repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text")
    return written(rows.mapInArrow(over, "part int, name string, itemsize int, n_docs long, n_ids long"), f"{out_dir}/manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest, a row per file, with the number of ids in all files before each one."""
    files = manifest.orderBy("part").collect()
    bases = accumulate((f.n_ids for f in files), initial=0)
    rows = [(f.name, f.itemsize, f.n_docs, base) for f, base in zip(files, bases, strict=False)]
    out = manifest.sparkSession.createDataFrame(rows, "name string, itemsize int, n_docs long, base long")
    return out.repartition(max(1, len(rows)), "base") if rows else out


def _file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI (s3a as s3) and the path on it."""
    return pa.fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


class _File:
    """Numbers of a file: mapped if it is local, else read by ranges."""

    def __init__(self, uri: str, dtype: str):
        self.dtype = np.dtype(dtype)
        fs, path = _file_system(uri)
        if isinstance(fs, pa.fs.LocalFileSystem):
            with open(path, "rb") as f:
                self.mapped = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.path.getsize(path) else b"", self.dtype)
        else:
            self.mapped, self.file = None, fs.open_input_file(path)

    def part(self, a: int, b: int) -> np.ndarray:
        """The numbers from a to b."""
        if self.mapped is not None:
            return self.mapped[a:b]
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((b - a) * w, a * w), self.dtype)


def read_token_files(files: DataFrame, out_dir: str, step: int = 4096) -> DataFrame:
    """doc_id, start (in the whole corpus), n_tokens, ids_crc32, a row per document of the files of with_bases()."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                ids, offsets, docs = _File(f"{out_dir}/{f['name']}.bin", f"<u{f['itemsize']}"), _File(f"{out_dir}/{f['name']}.off", "<i8"), _File(f"{out_dir}/{f['name']}.doc", "<i8")
                before = 0
                for k in range(0, f["n_docs"], step):
                    to = min(k + step, f["n_docs"])
                    ends, keys = offsets.part(k, to), docs.part(2 * k, 2 * to).reshape(-1, 2)
                    starts = np.concatenate(([before], ends[:-1]))
                    crc: list[int] = []
                    while len(crc) < len(ends):
                        i = len(crc)
                        j = max(i + 1, int(np.searchsorted(ends, starts[i] + RANGE // f["itemsize"], "right")))
                        held = ids.part(int(starts[i]), int(ends[j - 1])).astype("<u4")
                        cuts = (ends[i:j] - starts[i]).tolist()
                        crc += [zlib.crc32(held[a:b].tobytes()) for a, b in zip([0, *cuts], cuts, strict=False)]
                    key = pa.array(keys[:, 0], pa.int64(), mask=keys[:, 1].astype(bool))
                    yield pa.RecordBatch.from_arrays([key, pa.array(starts + f["base"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    before = int(ends[-1])

    return files.mapInArrow(over, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token files, and what the files hold of each."""
    out_dir = work_dir(spark, "tokens")
    return read_token_files(with_bases(write_token_files(table(spark, sf_dir, "documents"), out_dir)), out_dir)
