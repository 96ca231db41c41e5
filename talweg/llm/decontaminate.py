"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, against every word of every document.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A window is 13
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. The words of the
benchmark get numbers (its vocabulary is small), document words become those numbers or 0, and only where as many
known words stand in a row as a window has can a window occur: those places are hashed, looked up in the set, and
each hit is verified on the word numbers themselves. Hits give word spans, items and the verdict; the spans or the
whole documents can then be removed.

The benchmark is the one broadcast side. It is read in blocks of at most about `block_words` words (one item at least),
and each block is one more pass over the documents, whose result is written before the next block is made: one block is
held at a time, by the driver and by the executors, at any size of benchmark. With one block (any ordinary benchmark)
there is one pass and nothing is written between.

Defined results: null or wordless texts have n_words 0 and are clean; null and wordless items have no window; items
with equal texts are all reported; an item without an id counts as the item of the empty id, and rows that repeat an
item_id are one item; repeated documents, and those without an id, are judged each for itself; very long texts are scanned
whole; an empty benchmark finds nothing, an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import arrow_map, id_and_text, table, work_dir, written

WINDOW = 13
BLOCK_WORDS = 500_000
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class WindowSet:
    """The windows of a block of benchmark items, by length: arrays of sorted hashes, with the place and the item of each window.

    Words are numbered, so that a window is a stretch of one array of numbers, by which what has an equal hash is verified. A
    block takes about 24 bytes a word, and 200 more for each distinct word.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        found: dict[int, list[np.ndarray]] = {}
        held, size = [np.empty(0, np.int32)], 0
        for k, (_, text) in enumerate(items):
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text or "")], np.int32)
            if n := min(window, len(ids)):
                at = np.arange(size, size + len(ids) - n + 1, dtype=np.int32)
                found.setdefault(n, []).append(np.stack([at, np.full(len(at), k, np.int32)]))
            held.append(ids)
            size += len(ids)
        self.ids = np.concatenate(held)
        self.windows = {n: self._sorted(np.concatenate(x, axis=1), n) for n, x in found.items()}

    def _sorted(self, both: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Of windows (place, item): the distinct hashes, where each one's windows begin, and places and items in their order; an item's repeated windows once."""
        at, owner = both
        h = self._hash(self.ids, n, at)
        order = np.lexsort((at, owner, h))
        h, at, owner = h[order], at[order], owner[order]
        again = np.zeros(len(at), bool)
        near = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
        for part in np.array_split(near, len(near) // 100_000 + 1):
            again[part + 1] = (self.ids[at[part][:, None] + np.arange(n)] == self.ids[at[part + 1][:, None] + np.arange(n)]).all(axis=1)
        h, at, owner = h[~again], at[~again], owner[~again]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[first], np.append(first, len(h)).astype(np.int32), at, owner

    @staticmethod
    def _hash(ids: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = (h ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def scan(self, doc_words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items that occur."""
        ids = np.fromiter(map(self.number.get, doc_words, [0] * len(doc_words)), np.int32, len(doc_words))
        hit, items = np.zeros(len(ids), bool), set()
        known = np.concatenate(([0], np.cumsum(ids > 0, dtype=np.int64)))
        for n, (hashes, first, places, owner) in self.windows.items():
            at = np.flatnonzero(known[n:] - known[:-n] == n) if len(ids) >= n else np.empty(0, np.int64)
            if not len(at):
                continue
            h = self._hash(ids, n, at)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[k] == h
            verified: dict[int, tuple[bytes, list[str]]] = {}
            for i, u in zip(at[same].tolist(), k[same].tolist(), strict=True):
                own = ids[i : i + n].tobytes()
                if u not in verified or verified[u][0] != own:
                    of = [j for j in range(first[u], first[u + 1]) if self.ids[places[j] : places[j] + n].tobytes() == own]
                    verified[u] = (own, [self.names[owner[j]] for j in of])
                    items.update(verified[u][1])
                if verified[u][1]:
                    hit[i : i + n] = True
        return hit, items


def _spans(hit: np.ndarray) -> list[int]:
    """The runs of true values, as start, end, start, end ..."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()


def window_sets(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[tuple[WindowSet, bool]]:
    """The benchmark's windows, one block after the other, each with whether it is the last."""
    text = benchmark[text_col].cast("string")
    items = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("item"), text.alias("text")).where("text is not null")
    size = items.agg(F.sum(F.regexp_count("text", F.lit(_WORD_ANY_CASE)))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_words))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield WindowSet([(r.item, r.text) for r in block.toLocalIterator()], window), b == blocks - 1


def _scanned(packed: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """`packed` (row, text) with n_words, spans (word starts and ends of what is hit) and items (sorted ids that occur)."""
    found = packed.select("row", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema, work, k = found.schema, None, 0
    for windows, last in window_sets(benchmark, window=window, block_words=block_words):
        held = packed.sparkSession.sparkContext.broadcast(windows)
        del windows

        def each(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            n_words, spans, items = [], [], []
            for text, old, had in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)), strict=True):
                w = words(text)
                hit, of = held.value.scan(w)
                for a, b in zip(old[::2], old[1::2], strict=True):
                    hit[a:b] = True
                n_words.append(len(w))
                spans.append(_spans(hit))
                items.append(sorted(of.union(had)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["row", "text", "n_words", "spans", "items"])

        found = arrow_map(found, each, schema)
        if not last:
            work, k = work or work_dir(packed.sparkSession, "decontaminate"), k + 1
            found = written(found, f"{work}/block-{k}")
            held.destroy()
    return found


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, n_words, spans (array of word starts and ends of what is hit), items (sorted ids that occur)."""
    packed = id_and_text(docs).select(F.struct("doc_id").alias("row"), "text")
    return _scanned(packed, benchmark, window, block_words).select("row.doc_id", "text", "n_words", "spans", "items")


def n_hit(spans="spans"):
    """How many words the spans cover."""
    ends = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(hit, n_words):
    return (hit > 0) & (20 * hit >= n_words)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return decontamination_digest(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def decontamination_digest(found: DataFrame) -> DataFrame:
    return found.withColumn("n_hit", n_hit()).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs`, whole, without the contaminated ones."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    found = _scanned(packed, benchmark, window, block_words)
    return found.where(~contaminated(n_hit(), F.col("n_words"))).select("row.*")


def cut_spans(text: str, spans: list[int]) -> str:
    """`text` without its words of the given word spans (and what stands between them)."""
    at = [m.span() for m in re.finditer(_WORD_ANY_CASE, text)]
    out, done = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return "".join(out) + text[done:]


def oracle() -> str:
    """The contract of op6 in SQL: windows as joined words, looked up at each place of each document."""
    upper = "".join(map(chr, range(65, 91)))
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH docs AS (SELECT doc_id, {split} AS w FROM documents),
    items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, CAST(least({WINDOW}, len(w)) AS INT) AS n FROM (SELECT item_id, {split} AS w FROM benchmark) WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
    lengths AS (SELECT DISTINCT n FROM windows),
    places AS (SELECT doc_id, p, list(x) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS l FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM docs)),
    hits AS (SELECT doc_id, p, n, item FROM (SELECT doc_id, p, n, array_to_string(l[1:n], ' ') AS t FROM places, lengths WHERE len(l) >= n) JOIN windows USING (n, t)),
    found AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1),
    covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS p FROM hits) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN found f USING (doc_id) LEFT JOIN covered c USING (doc_id)"""
