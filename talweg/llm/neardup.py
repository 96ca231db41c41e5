"""MinHash near-duplicates: tensored banding for candidate pairs, exact verification on whole shingle sets, components.

A document's set holds the hashes of its distinct shingles (runs of `n` words, A-Z lower-cased; a shorter text is one
shingle). Two documents are linked if 100 * intersection >= 80 * union of their sets; the classes are the connected
components.

1. One pass makes, for each row, the size of its set, a 128-bit fingerprint of it, 12 collections of two MinHash
   values each, and a parity bitmap of 1024 bits. Rows of equal fingerprints are one node from here on.
2. Tensored banding: a table key is a pair of collections, so 24 MinHash values make 66 tables of four values each.
   At a similarity of 0.8 two collections of twelve fail to agree with a probability of about 1e-4. Nodes of equal
   keys are a group.
3. Each group pairs its members with its first node (the pivot). A pair passes if sizes and bitmaps admit it: the bits in
   which two bitmaps differ are at most as many as the tokens in which the sets differ, so no link is lost. Of each
   node the pair with most keys in common is verified on whole sets, and the components so far are known.
4. What else nodes with a table key in common may be linked with is found by tokens: those of each set are put in one
   order (frequent ones last), and two sets that are similar enough share a token among the first fifth of each, at
   positions that leave room for the overlap. Tokens whose nodes are of one component are done. Nodes of different
   components that share a token of at most `SMALL` nodes are paired; of a more frequent one all are first paired with the
   one for which it comes first, and then, where components still differ, with those of other components. All pairs are
   admitted by sizes and bitmaps and then verified on whole sets. So no group is expanded into all its pairs, and no link
   is lost. The list of frequent tokens that is broadcast holds at most `HOT` entries; any list gives the same links,
   since any order does: it only bounds the work, which grows where many unrelated documents share unlisted tokens.
5. Components: smallest reachable label by rounds of propagation and shortcut, each round written.

But for that list nothing is broadcast except by Spark's own check of sizes. Groups, tokens and pivots of
more than `MOST` rows are salted in the joins that meet them.

Null and wordless texts have an empty set and are linked with nothing. Repeated rows are equal sets, linked; rows that
repeat an id with another text are documents of their own. Rows with a null doc_id are nodes like any other but can't
name a component: theirs has the smallest doc_id of the others, or null, and op1 never marks them as kept. Very long
texts are whole sets like others, of 8 bytes a token in one row. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import arrow_map, table, work_dir, written

COLLECTIONS, EACH, LONGS, SMALL, MOST, HOT, LEAST_HOT = 12, 2, 16, 32, 20_000, 1 << 18, 16
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_RNG = np.random.default_rng(20)
_XOR, _ODD = (_RNG.integers(0, 1 << 63, COLLECTIONS * EACH, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(text: str, n: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = (s ^ h[k : len(h) - n + 1 + k]) * _PRIMES[k % 4]
        s ^= s >> np.uint64(29)
    return np.unique(s)


def collections(s: np.ndarray) -> np.ndarray:
    """COLLECTIONS numbers, each of EACH MinHash values of a set."""
    low = np.full(len(_ODD), np.iinfo(np.uint64).max)
    for at in range(0, len(s), 4096):
        np.minimum(low, ((s[at : at + 4096, None] ^ _XOR) * _ODD).min(axis=0), out=low)
    two = low.reshape(COLLECTIONS, EACH)
    return (two[:, 0] * _PRIMES[0] ^ two[:, 1]).view(np.int64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """LONGS numbers: bit k says whether an odd number of the set's tokens hash to k."""
    odd = np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and two hashes of the text (null is not empty here) that tell rows of one id apart."""
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, d1 and d2 (of the text), n_shingles, h1 and h2 (of the set), u (the collections), bits."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, prints, u, bits = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, n)
            sizes.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()))
            u.append(collections(s))
            bits.append(bitmap(s))
        h = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(x)), k).cast(pa.list_(pa.int64())) for x, k in ((u, COLLECTIONS), (bits, LONGS))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), *lists], names=["doc_id", "d1", "d2", "n_shingles", "h1", "h2", "u", "bits"])

    return arrow_map(_rows_of(docs), each, "doc_id long, d1 long, d2 long, n_shingles long, h1 long, h2 long, u array<long>, bits array<long>")


def table_keys() -> Column:
    """The tensored keys of the collections `u`: one for each pair."""
    return F.expr(f"array({', '.join(f'xxhash64({i * COLLECTIONS + j}, u[{i}], u[{j}])' for i in range(COLLECTIONS) for j in range(i))})")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt: list[str], counts: DataFrame) -> DataFrame:
    """left joined to right, of one row a key; `counts` (the keys, c) has the keys of many rows in left.

    Those are cut into parts of about MOST rows by a hash of the columns `salt`, and their row of right is repeated for each.
    """
    hot = counts.where(F.col("c") > MOST).select(*keys, F.ceil(F.col("c") / MOST).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    many = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*salt), parts).cast("int")).drop("_parts")
    one = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return many.join(one, [*keys, "_part"]).drop("_part")


def groups(nodes: DataFrame) -> DataFrame:
    """key, node, c (nodes of this key), pivot (the first of them), for keys of more than one node."""
    keys = nodes.select("node", F.explode(table_keys()).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("pivot")).where("c > 1")
    return salted_join(keys, shared, ["key"], ["node"], shared.select("key", "c"))


def admitted(pairs: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """The pairs (a, b, ...; written at `path`) that sizes and bitmaps admit: 9 * difference <= sum of the sizes wherever they are linked."""
    pairs = written(pairs, path)
    own = nodes.select("node", F.col("n_shingles").alias("n"), "bits")
    side = lambda x: own.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    per = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    both = salted_join(pairs.join(side("b"), "b"), side("a"), ["a"], ["b"], per)
    differ = F.expr(" + ".join(f"bit_count(bitsa[{k}] ^ bitsb[{k}])" for k in range(LONGS)))
    return both.where((5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (9 * differ <= F.col("na") + F.col("nb"))).select(*pairs.columns)


def sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node, n, s (the set as bytes) of the given nodes (node, id, d1, d2): each made from one row of those its node names."""
    rows, wanted = _rows_of(docs), nodes.select("node", "id", F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    own = rows.join(wanted, (rows["d1"] == wanted["e1"]) & (rows["d2"] == wanted["e2"]) & rows["doc_id"].eqNullSafe(wanted["id"]))
    once = own.groupBy("doc_id", "d1", "d2").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, n) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int32()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "n", "s"])

    return arrow_map(once, each, "node long, n int, s binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(s) > len(t):
                s, t = t, s
            i = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
            keep.append(100 * i >= 80 * (len(s) + len(t) - i))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}"))
    both = salted_join(pairs.join(side("b"), "b"), side("a"), ["a"], ["b"], pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")))
    return arrow_map(both.select("a", "b", "sa", "sb"), each, "a long, b long")


def components(edges: DataFrame, work: str) -> DataFrame:
    """node, label (the smallest node reachable), for all nodes with an edge.

    Each round gives a node the smallest label around it and then the label of that label; each is written.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{work}/edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), f"{work}/labels-0")
    degrees = both.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    for k in range(1, 1000):
        around = salted_join(both, labels.withColumnRenamed("node", "b"), ["b"], ["a"], degrees).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(around, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = written(near.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "old"), f"{work}/labels-{k}")
        labels = new.select("node", "label")
        if new.where("label < old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def hot_tokens(sets: DataFrame) -> np.ndarray:
    """The most frequent tokens, at most HOT, the most frequent first. Tasks leave out what they see less than three times."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = np.empty(0, np.uint64), np.empty(0, np.int64)
        held: list[np.ndarray] = []

        def merged():
            t, inverse = np.unique(np.concatenate([tokens, *held]), return_inverse=True)
            return t, np.bincount(inverse, np.concatenate([seen, *[np.ones(len(x), np.int64) for x in held]])).astype(np.int64)

        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(np.frombuffer(x, np.uint64))
            if sum(map(len, held)) > 2_000_000:
                tokens, seen = merged()
                held = []
                if len(tokens) > 4_000_000:
                    tokens, seen = tokens[seen > 1], seen[seen > 1]
        tokens, seen = merged()
        often = seen >= 3
        yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(seen[often])], names=["t", "c"])

    found = sets.select("s").mapInArrow(counts, "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= LEAST_HOT)
    rows = found.orderBy(F.desc("c"), "t").limit(HOT).select("t").toArrow()
    return rows.column("t").to_numpy().view(np.uint64)


def prefix_of(n: int) -> int:
    """How many tokens of a set of n hold at least one of any 0.8 of them."""
    return n - (4 * n + 4) // 5 + 1


def postings(sets: DataFrame, hot: np.ndarray) -> DataFrame:
    """t, p (position in the order of its set), node, n: the tokens of each set's prefix."""
    by_value = np.argsort(hot)
    held = sets.sparkSession.sparkContext.broadcast((hot[by_value], len(hot) - by_value))  # rarer ones first

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, ranks = held.value
        toks, places, counts = [], [], []
        for x in batch.column(2).to_pylist():
            s = np.frombuffer(x, np.uint64)
            k = prefix_of(len(s))
            rank = np.zeros(len(s), np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                rank = np.where(values[at] == s, ranks[at], 0)
            toks.append(s[np.argsort(rank, kind="stable")[:k]])
            places.append(np.arange(k, dtype=np.int32))
            counts.append(k)
        rep = np.repeat(np.arange(batch.num_rows), counts)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.concatenate(places)), batch.column(0).take(pa.array(rep)), batch.column(1).take(pa.array(rep))], names=["t", "p", "node", "n"])

    return arrow_map(sets, each, "t long, p int, node long, n int")


def _room(a: str, b: str) -> Column:
    """Whether two sets that first share this token can still be similar enough."""
    left = lambda x: F.col(f"{x}.n") - F.col(f"{x}.p")
    return 9 * F.least(left(a), left(b)) >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def by_token(posted: DataFrame, labels: DataFrame, work: str) -> DataFrame:
    """t, p, node, n, label, c and first (the one of smallest p) of the tokens that nodes of different components share."""
    named = written(posted.join(labels, "node", "left").select("t", "p", "node", "n", F.coalesce("label", "node").alias("label")), f"{work}/named")
    tokens = named.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("p", "node", "n", "label")).alias("first"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").drop("lo", "hi")
    return written(salted_join(named, tokens, ["t"], ["node"], tokens.select("t", "c")), f"{work}/shared")


def links(nodes: DataFrame, docs: DataFrame, n: int, work: str) -> DataFrame:
    """The components of the nodes: node, label; nodes without a link are left out."""
    rows = written(groups(nodes), f"{work}/groups")
    sets = written(sets_of(docs, nodes.join(rows.select("node").distinct(), "node", "left_semi"), n), f"{work}/sets")
    star = rows.where("node != pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    best = admitted(star, nodes, f"{work}/star").groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a")).select("a", "b")
    seen = written(best, f"{work}/pairs")
    edges = written(verified(seen, sets), f"{work}/verified")
    labels = components(edges, f"{work}/first")

    shared = by_token(written(postings(sets, hot_tokens(sets)), f"{work}/postings"), labels, f"{work}/second")
    rare, often = shared.where(F.col("c") <= SMALL), shared.where(F.col("c") > SMALL)
    differ = F.col("a.label") != F.col("b.label")
    near = _ordered(rare.alias("a").join(rare.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.node") < F.col("b.node")) & differ & _room("a", "b")))
    stars = _ordered(often.select(F.col("first").alias("a"), F.struct("p", "node", "n", "label").alias("b")).where(differ & _room("a", "b")))
    pairs = written(admitted(near.union(stars).distinct().join(seen, ["a", "b"], "left_anti"), nodes, f"{work}/met"), f"{work}/more-pairs")
    edges = written(edges.union(verified(pairs, sets)), f"{work}/more")
    labels = components(edges, f"{work}/third")
    if often.isEmpty():
        return labels

    left = by_token(often.select("t", "p", "node", "n"), labels, f"{work}/fourth")
    main = left.groupBy("t", "label").count().groupBy("t").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    apart = left.join(main, "t")
    a, b = apart.where("label != main").alias("a"), apart.alias("b")
    once = (F.col("b.label") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    rest = _ordered(a.join(b, (F.col("a.t") == F.col("b.t")) & differ & once & _room("a", "b"))).join(seen.union(pairs), ["a", "b"], "left_anti")
    last = written(verified(written(admitted(rest, nodes, f"{work}/apart"), f"{work}/rest"), sets), f"{work}/last")
    return labels if last.isEmpty() else components(edges.union(last), f"{work}/components")


def classes(docs: DataFrame, n: int, work: str) -> DataFrame:
    """doc_id, d1, d2, n_shingles, class: rows of equal class are linked, directly or through others; null for empty sets."""
    rows = written(signatures(docs, n), f"{work}/signatures")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), "d1", "d2")).alias("first")
    found = rows.where("n_shingles > 0").groupBy("h1", "h2").agg(first, F.first("u").alias("u"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("c"))
    nodes = written(found.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "first.id", "first.d1", "first.d2", "u", "bits", "n_shingles", "c"), f"{work}/nodes")
    labels = links(nodes, docs, n, work)
    named = nodes.select("h1", "h2", "node").join(labels, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("class"))
    out = salted_join(rows.where("n_shingles > 0"), named, ["h1", "h2"], ["doc_id", "d1"], nodes.select("h1", "h2", "c"))
    empty = rows.where("n_shingles = 0").withColumn("class", F.lit(None).cast("long"))
    names = ("doc_id", "d1", "d2", "n_shingles", "class")
    return written(out.select(*names).unionByName(empty.select(*names)), f"{work}/classes")


def near_duplicates(docs: DataFrame, n: int = 5, work: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of `docs`."""
    rows = classes(docs, n, work or work_dir(docs.sparkSession, "neardup"))
    names = rows.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("least")).where("c > 1")
    hot = salted_join(rows.where("class is not null"), names, ["class"], ["doc_id", "d1"], names.select("class", "c"))
    alone = rows.join(names.select("class"), "class", "left_anti").withColumn("least", F.col("doc_id"))
    out = hot.select("doc_id", "n_shingles", "least").unionByName(alone.select("doc_id", "n_shingles", "least"))
    return out.select("doc_id", "n_shingles", F.col("least").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("least"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5) -> DataFrame:
    """One row, whole, of each class: that of the smallest doc_id, those without one last.

    Rows of one class and id that differ in their texts are told apart by a hash of the text, the smallest first; those that
    repeat id and text are one document, and of them the row stays whose other columns have the smallest hash. Rows without
    words are each a class of their own, once for each id and text.
    """
    rows = classes(docs, n, work_dir(docs.sparkSession, "neardup"))
    same = rows.groupBy("class", "doc_id", "d1", "d2").agg(F.count(F.lit(1)).alias("c"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d1", "d2", "c")).alias("first")
    linked = same.where("class is not null").groupBy("class").agg(first).select("first.*").drop("none")
    kept = linked.unionByName(same.where("class is null").drop("class"))
    kept = written(kept.select(F.col("doc_id").alias("id"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), "c"), work_dir(docs.sparkSession, "kept"))
    text, others = docs["text"].cast("string"), [c for c in docs.columns if c != "text" and not any(k in docs.schema[c].dataType.simpleString() for k in ("map<", "variant"))]
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("_id"), F.xxhash64(text).alias("_d1"), F.xxhash64(F.lit(1), text).alias("_d2"), F.xxhash64(F.lit(0), *[docs[c] for c in others]).alias("_rest"))
    of = lambda some: packed.join(some, (F.col("_d1") == F.col("e1")) & (F.col("_d2") == F.col("e2")) & F.col("_id").eqNullSafe(F.col("id")), "left_semi")
    repeated = of(kept.where("c > 1")).groupBy("_id", "_d1", "_d2").agg(F.min_by("row", "_rest").alias("row"))
    return of(kept.where("c = 1")).select("row").union(repeated.select("row")).select("row.*")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of all documents, on shingles of four words."""
    return near_duplicates(table(spark, sf_dir, "documents"), 4)
