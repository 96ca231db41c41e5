"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, of its pairs of neighbouring words, of its pairs with one
word between, and of the stems that several of its words share, 2^20 each, A-Z lower-cased; a word and a stem count 1
and a pair less. A stem is the first 3 to 7 code points of a longer word, together with 2, 3 or 4 if that many distinct
words of the text begin with it: in languages that inflect and compound, an insult has more endings than the labelled
texts show, and a single word that begins so says little. Learning takes at most `MAX_ROWS` labelled documents, in
order of a hash of their doc_id (a bounded sample, the same on every run, also where ids are repeated), passes over them
`EPOCHS` times with one learning rate per coordinate, a toxic one (they are few) with `WEIGHT` times the gradient, and ends with few weights that are not zero, since L1 keeps the others at zero. At most
4 * 2^20 weights, a few thousand in practice, are broadcast; each text's score is the logistic of the sum of its own.

The score never uses labels, lang, source or doc_id. Null and empty texts have no feature and score by the intercept
alone; equal texts have equal scores. Labels of null rows, or other than 0 and 1, are not learned from; with none to
learn from, every score is 0.5. Very long texts are whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import arrow_map, crc_mod, id_and_text, table

BITS, MAX_ROWS, EPOCHS, THRESHOLD, FOLDS, HELD_OUT = 20, 12_000, 8, 0.3, 4, 2
ALPHA, BETA, L1, L2, PAIR_VALUE, WEIGHT = 1.0, 1.0, 6.0, 0.0, 0.3, 2.0
STEMS, SHARED_BY = range(3, 8), (2, 3, 4)
SIZE = (4 << BITS) + 1
_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 or c == 0x27 else 32 for c in range(256))


def stems(words: set[bytes]) -> list[bytes]:
    """The beginnings that several of these distinct words share, each with every number of SHARED_BY that it reaches."""
    read = [w.decode("utf-8", "surrogatepass") for w in words]
    shared = Counter(w[:k] for w in read for k in STEMS if len(w) > k)
    return [f"{s} {m}".encode("utf-8", "surrogatepass") for s, n in shared.items() if n >= SHARED_BY[0] for m in SHARED_BY if n >= m]


def features(text: str) -> np.ndarray:
    """The distinct feature numbers of a text, sorted."""
    words = text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
    shared = stems(set(words))
    h, s = (np.fromiter(map(xxhash.xxh3_64_intdigest, x), np.uint64, len(x)) for x in (words, shared))

    def pairs(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        x = (a ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) + b
        return (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)

    down = np.uint64(64 - BITS)
    kinds = (h, pairs(h[:-1], h[1:], 0x51), pairs(h[:-2], h[2:], 0xA7), s)
    return np.unique(np.concatenate([(x >> down) + np.uint64(k << BITS) for k, x in enumerate(kinds)]).astype(np.int32))


def values(at: np.ndarray) -> np.ndarray:
    """What a feature counts: a word or stem 1, a pair less."""
    return np.where((at < 1 << BITS) | (at >= 3 << BITS), 1.0, PAIR_VALUE)


class Ftrl:
    """Follow the regularised leader, proximal, one rate per coordinate; the last coordinate is the intercept, free of L1."""

    def __init__(self):
        self.z, self.n = np.zeros(SIZE), np.zeros(SIZE)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        rate = (BETA + np.sqrt(self.n[at])) / ALPHA
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / (rate + L2))

    def intercept(self) -> float:
        return float(-self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA))

    def learn(self, at: np.ndarray, y: int) -> None:
        w, b, v = self.weights(at), self.intercept(), values(at)
        error = (1 / (1 + np.exp(-np.clip((w * v).sum() + b, -35, 35))) - y) * (WEIGHT if y else 1.0)
        g, n = error * v, self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        n = self.n[-1]
        self.z[-1] += error - (np.sqrt(n + error * error) - np.sqrt(n)) / ALPHA * b
        self.n[-1] = n + error * error

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        """The coordinates with a weight, the intercept last, and the weights times the values of their features."""
        at = np.flatnonzero(np.abs(self.z[:-1]) > L1)
        return np.append(at, SIZE - 1), np.append(self.weights(at) * values(at), self.intercept())


def learning_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """h (the order), y, x (the features): the documents of the first MAX_ROWS labels."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    sample = known.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "y").limit(MAX_ROWS)

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["h", "y", "x"])

    return arrow_map(id_and_text(docs).join(F.broadcast(sample), "doc_id").select("h", "y", "text"), vectors, "h long, y int, x array<int>")


def _most(rows: DataFrame) -> DataFrame:
    """The first MAX_ROWS of them: ids that documents repeat have more."""
    return rows.orderBy("h", "y", "x").limit(MAX_ROWS)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Learns in one task, from the bounded sample."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            y, x = b.column(1).to_pylist(), b.column(2)
            rows += [(x[i].values.to_numpy(), y[i]) for i in range(len(y))]
        model = Ftrl()
        for _ in range(EPOCHS if rows else 0):
            for x, y in rows:
                model.learn(x, y)
        at, w = model.sparse()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w)], names=["i", "w"])

    found = _most(learning_rows(docs, labels, label)).repartition(1).sortWithinPartitions("h", "y", "x").mapInArrow(learn, "i int, w double").orderBy("i").collect()
    return np.array([r.i for r in found], np.int64), np.array([r.w for r in found])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    dense: list[np.ndarray] = []

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not dense:
            dense.append(np.zeros(SIZE))
            dense[0][held.value[0]] = held.value[1]
        w = dense[0]
        total = np.array([w[features(t)].sum() + w[-1] for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))], names=["doc_id", "score"])

    return arrow_map(id_and_text(docs), each, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labelled documents that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels.where(crc_mod("doc_id", FOLDS) != HELD_OUT)))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
