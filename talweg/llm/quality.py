"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text becomes a vector of statistics (shares of character classes, word and line shape, repetition), transformed
by logarithms so that classes look nearer to normal. The moments of each class are summed in a distributed
aggregation, whose result has a few hundred numbers; each class covariance is shrunk towards the pooled one and both
towards a scaled identity. A score is the logistic of the difference of the two log densities (Mahalanobis distances
by the cached Cholesky factors) and of the log priors.

The statistics of a text never use labels, lang, source or doc_id. Null and empty texts have the statistics of an
empty text and get a score like any other; equal texts get equal scores. Rows of the labels whose document or label
is null are not learned from; a document with several label rows, or an id with several texts, counts once for each.
With fewer than two rows of one class to learn from, every score is the share of class 1 among them (0.5 without any
rows). Very long texts are whole, repeated rows are scored each for itself, an empty table gives no rows, and other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import arrow_map, crc_mod, id_and_text, keep_rows, table, work_dir, written

FOLDS, THRESHOLD = 5, 0.3
SHRINK_POOLED, SHRINK_IDENTITY = 0.1, 0.02
NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "space", "line_breaks", "comma_stop", "bars", "symbols", "other_punctuation", "beyond_ascii",
    "distinct_words", "top_word", "repeats_next", "distinct_lines", "symbol_words", "line_words",
)
_CLASSES = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b",.", b"|", b"#$%&*!@^~<>{}[]\\", b"\"'()-/:;?_+=`")):
    _CLASSES[list(_chars)] = _k + 1
_CLASSES[0x80:] = 9


def _logit(share: float) -> float:
    return float(np.log((share + 1e-3) / (1 - share + 1e-3)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    by = np.bincount(_CLASSES, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=10) if n else np.zeros(10)
    words, lines = raw.split(), raw.split(b"\n")
    w = max(1, len(words))
    counts = Counter(words)
    top = max(counts.values(), default=0)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(not x[-1:].isalnum() and x[-1] < 0x80 and x[-1:] not in b",." for x in words)
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        float(np.log1p((n - len(words)) / w)),
        *(_logit(x / max(1, n)) for x in by[1:]),
        _logit(len(counts) / w),
        _logit(top / w),
        _logit(repeats / w),
        _logit(len(set(lines)) / len(lines)),
        _logit(marked / w),
        float(np.log1p(len(words) / len(lines))),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x (the vector of statistics)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return arrow_map(id_and_text(docs), each, "doc_id long, x array<double>")


class Model:
    """Two normal densities with shrunk covariances; `factors` are the inverses of their Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        d = len(NAMES)
        self.share = [moments.get(k, (0,))[0] for k in (0, 1)]
        self.fitted = all(n > 1 for n in self.share)
        if not self.fitted:
            return
        means, covariances = {}, {}
        for k, (n, s, ss) in moments.items():
            means[k] = s / n
            covariances[k] = ss / n - np.outer(means[k], means[k])
        pooled = sum(self.share[k] * covariances[k] for k in (0, 1)) / sum(self.share)
        pooled = (1 - SHRINK_IDENTITY) * pooled + SHRINK_IDENTITY * max(np.trace(pooled) / d, 1e-6) * np.eye(d)
        self.means, self.factors, self.constants = [], [], []
        for k in (0, 1):
            lower = np.linalg.cholesky((1 - SHRINK_POOLED) * covariances[k] + SHRINK_POOLED * pooled)
            self.means.append(means[k])
            self.factors.append(np.linalg.inv(lower).T)
            self.constants.append(float(np.log(self.share[k]) - np.log(np.diag(lower)).sum()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            n = sum(self.share)
            return np.full(len(x), self.share[1] / n if n else 0.5)
        density = [c - 0.5 * (((x - m) @ f) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def known(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y: the label rows to learn from."""
    return labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))


def fit_texts(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model of the labelled rows of `docs`; no other text is analysed."""
    own = id_and_text(docs).join(known(labels, label), "doc_id")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([statistics(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    return _fit(arrow_map(own.select("text", "y"), each, "y int, x array<double>"))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model of the labelled rows of `stats`."""
    return _fit(stats.join(known(labels, label), "doc_id").select("y", "x"))


def _fit(rows: DataFrame) -> Model:
    """From all rows (y, x): sums of the statistics and of their products, by class."""
    d = len(NAMES)

    def sums(batches):
        total: dict[int, list] = {}
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                if len(own):
                    n, s, ss = total.setdefault(k, [0.0, np.zeros(d), np.zeros((d, d))])
                    total[k] = [n + len(own), s + own.sum(axis=0), ss + own.T @ own]
        for k, (n, s, ss) in total.items():
            flat = np.concatenate(([n], s, ss.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), k), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["y", "i", "v"])

    parts = rows.mapInArrow(sums, "y int, i int, v double")
    flat: dict[int, np.ndarray] = {}
    for r in parts.groupBy("y", "i").agg(F.sum("v").alias("v")).collect():  # two classes of 1 + d + d * d numbers
        flat.setdefault(r.y, np.zeros(1 + d + d * d))[r.i] = r.v
    return Model({k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in flat.items()})


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(x))], names=["doc_id", "score"])

    return arrow_map(stats, each, "doc_id long, score double")


def learned_from(labels: DataFrame) -> DataFrame:
    """The label rows that are not held out."""
    return labels.where(crc_mod("doc_id", FOLDS) != 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; the statistics are made once and written, then learned from and scored."""
    stats = written(with_statistics(table(spark, sf_dir, "documents")), work_dir(spark, "quality"))
    model = fit(stats, learned_from(table(spark, sf_dir, "labels")))
    out = score(stats, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, whole, that the classifier doesn't reject."""
    held = docs.sparkSession.sparkContext.broadcast(fit_texts(docs, learned_from(labels)))
    return keep_rows(docs, lambda texts: (held.value.scores(np.array([statistics(t) for t in texts])) >= THRESHOLD).tolist())
