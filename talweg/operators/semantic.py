"""Nearest rows by cosine similarity: exact, in parts and blocks, or by an inverted file that holds every row; and the similarities of all pairs.

A vector is usable if it is neither null nor empty, has no null, NaN or infinite element and isn't all zero; others, and rows
without an id, are near nothing. Vectors of different length never meet. Rows that repeat an id are each a neighbour;
queries that repeat an id share one list. Similarities are rounded half up to six places; ties go by id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a part and queries of a block that one task holds; rows of one matrix product.
PART, BLOCK, CHUNK = 32_768, 512, 4096
#: The same where every pair is given back, and rows of one product.
MET, ASKED, AT_ONCE = 512, 1000, 64
#: Rows that an index is fitted on, and numbers in them (fewer rows if they are long); lists of one length of vectors; rounds of fitting.
SAMPLE, SAMPLE_NUMBERS, LISTS, ROUNDS = 65_536, 1 << 22, 4096, 8
#: Share of the neighbours within the sample that the lists probed must hold, for how many of its rows, and how many neighbours.
TARGET, TRIED, NEIGHBOURS = 0.95, 256, 10


def finite(v: Column) -> Column:
    """Whether an array of doubles is there, not empty, and has numbers alone: others are like nothing."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (of length 1) and dim of the rows that can be compared."""
    v = F.col("v")
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    kept = rows.where(F.col("id").isNotNull() & finite(v)).withColumn("_norm", norm).where("_norm > 0")
    return kept.select("id", F.transform(v, lambda x: x / F.col("_norm")).alias("v"), F.size(v).alias("dim"))


def _leading(k: int, chunk: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def best(_key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The k nearest rows of this part for each query of this block."""
        at, near, value = np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)
        if len(rows) and len(queries):
            asked, ids = np.stack(queries["v"].to_list()).T, rows["id"].to_numpy("int64")
            for start in range(0, len(rows), chunk):
                product = np.stack(rows["v"].iloc[start : start + chunk].to_list()) @ asked
                product = np.floor(product * 1e6 + 0.5) / 1e6
                least = np.partition(product, max(0, len(product) - k), axis=0)[max(0, len(product) - k)]
                row, query = np.nonzero(product >= least)
                at, near, value = np.concatenate([at, query]), np.concatenate([near, ids[start + row]]), np.concatenate([value, product[row, query]])
                order = np.lexsort((near, -value, at))
                at, near, value = at[order], near[order], value[order]
                first = np.arange(len(at)) - np.searchsorted(at, at) < k
                at, near, value = at[first], near[first], value[first]
        return pd.DataFrame({"query": queries["id"].to_numpy("int64")[at] if len(at) else at, "near": near, "similarity": value})

    return best


def _cut(rows: DataFrame, queries: DataFrame, on: list[str], part: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Both with _part and _block: among those of equal `on`, rows are cut into parts and queries into blocks, by count, and each part is there for each block."""
    sizes = rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts"))
    sizes = sizes.join(queries.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")), on)
    spread = lambda df, own, n, other, m: (
        df.withColumn("_n", F.monotonically_increasing_id()).join(sizes, on)
        .select(*df.columns, F.pmod("_n", F.col(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other))
    )
    return spread(rows, "_part", "_parts", "_block", "_blocks"), spread(queries, "_block", "_blocks", "_part", "_parts")


def _met(rows: DataFrame, queries: DataFrame, on: list[str], k: int) -> DataFrame:
    """The k nearest rows for each query among those of equal `on`, whatever the sizes of the groups."""
    left, right = _cut(rows.select(*on, "id", "v"), queries.select(*on, "id", "v"), on, PART, BLOCK)
    keys = [*on, "_part", "_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_leading(k, CHUNK), "query long, near long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "near")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10) -> DataFrame:
    """query, near, similarity and place (1 to k): the nearest of all rows for a stated set of queries, exactly."""
    own = usable(queries, id_col, vector_col).dropDuplicates(["id", "v"])
    return _met(usable(rows, id_col, vector_col), own, ["dim"], k)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As scores.cosine() of each of `a` with each of `b`, NaN for null: added up in the same order, so that a value doesn't hang on how rows are cut."""
    left, right = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    out, squares = np.zeros((len(a), len(b))), [np.zeros(len(a)), np.zeros(len(b))]
    with np.errstate(all="ignore"):
        for own, m in zip(squares, (left, right), strict=True):
            for x in m:
                own += x * x
        for start in range(0, len(a), AT_ONCE):
            part = out[start : start + AT_ONCE]
            product = np.empty_like(part)
            for x, y in zip(left[:, start : start + AT_ONCE], right, strict=True):
                part += np.multiply.outer(x, y, out=product)
            norms = np.sqrt(np.multiply.outer(squares[0][start : start + AT_ONCE], squares[1]))
            norms[norms == 0] = np.nan
            part /= norms
    return out


def _vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors that have it, and those as a matrix; nulls in them are NaN."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    places = {int(n): np.nonzero(sizes == n)[0] for n in np.unique(sizes) if n}
    return {n: (at, flat[(ends[at] - n)[:, None] + np.arange(n)]) for n, at in places.items()}


def similarities(rows: DataFrame, own: str, queries: DataFrame, asked: str, key: str, on: str) -> DataFrame:
    """Each of `rows` with each of `queries` of equal `on`: the columns of `rows` but `own`, the `key` of the query, and
    similarity, which is scores.cosine() of `own` and `asked`, arrays of doubles (null for NaN).

    Rows in parts and queries in blocks meet in matrices, so that no pair is an expression over arrays of its own or is moved.
    """
    columns = [c for c in rows.columns if c != own]
    left, right = _cut(rows, queries.select(on, key, asked), [on], MET, ASKED)
    kind = T.ArrayType(T.StructType([T.StructField(key, queries.schema[key].dataType), T.StructField("similarity", T.DoubleType())]))

    def met(some: pa.Table, block: pa.Table) -> pa.Table:
        n, m = len(some), len(block)
        found, theirs = np.full((n, m), np.nan), _vectors(block[asked])
        for size, (at, a) in _vectors(some[own]).items():
            if size in theirs:
                found[np.ix_(at, theirs[size][0])] = _cosines(a, theirs[size][1])
        keys = block[key].combine_chunks().take(pa.array(np.tile(np.arange(m), n)))
        pairs = pa.StructArray.from_arrays([keys, pa.array(found.ravel(), from_pandas=True)], [key, "similarity"])
        return some.select(columns).append_column("_pairs", pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pairs))

    keys = [on, "_part", "_block"]
    schema = T.StructType([rows.schema[c] for c in columns]).add("_pairs", kind)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, schema).select(*columns, F.inline("_pairs"))


class Index:
    """An inverted file: centroids fitted on a bounded sample, the lists of every row by its nearest centroid.

    The sample is the rows of the smallest hash of id and vector (of the 16 commonest lengths), SAMPLE at most; the number of lists is the square root of the
    number of rows of a length, LISTS at most. A length that the sample lacks has one list. How many lists a query probes is
    measured on the sample: what its rows are like decides, few for rows in clusters and most of them for rows without any.
    """

    def __init__(self, rows: DataFrame, id_col: str, vector_col: str):
        self.columns = id_col, vector_col
        good = usable(rows, id_col, vector_col)
        counts = {r.dim: r["count"] for r in good.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(16).collect()}
        taken = good.where(F.col("dim").isin(*counts)) if counts else good
        sample = taken.orderBy(F.xxhash64("id", "v"), "id").limit(min(SAMPLE, SAMPLE_NUMBERS // max(counts, default=1))).select("v", "dim").toPandas()
        self.centroids = {dim: _fitted(np.stack(g["v"].to_list()), max(1, min(LISTS, int(counts[dim] ** 0.5)))) for dim, g in sample.groupby("dim")}
        self.probes = {dim: _needed(np.stack(g["v"].to_list()), self.centroids[dim]) for dim, g in sample.groupby("dim")}
        self.rows = good.withColumn("list", F.get(self._lists(dict.fromkeys(self.centroids, 1))(F.col("v")), 0))

    def _lists(self, probes: dict[int, int]) -> Callable[[Column], Column]:
        centroids = self.centroids

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def lists(v: pd.Series) -> pd.Series:
            out = pd.Series([[0]] * len(v), index=v.index, dtype=object)
            for dim, places in v.groupby(v.map(len)).groups.items():
                if dim in centroids:
                    for start in range(0, len(places), CHUNK):
                        some = places[start : start + CHUNK]
                        order = np.argsort(-(np.stack(v.loc[some].to_list()) @ centroids[dim].T), axis=1, kind="stable")[:, : probes[dim]]
                        out.loc[some] = pd.Series(order.tolist(), index=some, dtype=object)
            return out

        return lists

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """As nearest(), among the rows of the `probes` lists nearest to each query (those measured, if not given)."""
        tried = self.probes if probes is None else dict.fromkeys(self.centroids, probes)
        own = usable(queries, *self.columns).dropDuplicates(["id", "v"])
        return _met(self.rows, own.withColumn("list", F.explode(self._lists(tried)(F.col("v")))), ["dim", "list"], k)


def _fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of length 1 by rounds of nearest centroid and mean, begun with rows spread over the sample; one that loses its rows stays."""
    lists = min(lists, len(sample))
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([np.argmax(sample[a : a + CHUNK] @ centres.T, axis=1) for a in range(0, len(sample), CHUNK)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def _needed(sample: np.ndarray, centres: np.ndarray) -> int:
    """How many lists, from the nearest, hold TARGET of the NEIGHBOURS that rows of the sample have in it."""
    own = np.concatenate([np.argmax(sample[a : a + CHUNK] @ centres.T, axis=1) for a in range(0, len(sample), CHUNK)])
    tried = sample[:TRIED]
    product = tried @ sample.T
    product[np.arange(len(tried)), np.arange(len(tried))] = -np.inf  # a row finds itself at once
    near = np.argsort(-product, axis=1, kind="stable")[:, :NEIGHBOURS]
    place = np.argsort(np.argsort(-(tried @ centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(place, own[near], axis=1), axis=None)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))) - 1)]) + 1 if len(ranks) else 1
