"""Nearest rows and relevance against plain versions that share no code with them."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions import scores
from talweg.operators import matching, semantic
from talweg.plans import catalogue, scoring
from talweg.sources.tables import table


def cosine(a, b):
    return math.floor(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) * 1e6 + 0.5) / 1e6


def plain(rows, queries, k):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q in {i for i, _ in queries}:
        asked = {tuple(v) for i, v in queries if i == q and (i, v) in good}
        found = sorted((-cosine(v, w), i) for v in asked for i, w in good if len(w) == len(v))[:k]
        out |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(found)}
    return out


def seen(df):
    rows = [(r["query"], r["near"], r["similarity"], r["place"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_nearest_in_parts_and_blocks(spark, monkeypatch):
    """Ties, repeated rows, lengths that differ, vectors that can't be compared; parts, blocks and products of a few rows."""
    for name, value in (("PART", 7), ("BLOCK", 3), ("CHUNK", 4)):
        monkeypatch.setattr(semantic, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)] + [(i, [float(i), 1.0]) for i in range(70, 75)]
    rows += [(5, None), (None, [1.0, 0.0, 0.0, 0.0]), (80, []), (81, [0.0] * 4), (82, [1.0, None, 0.0, 0.0]), (83, [math.nan, 1.0, 0.0, 0.0]), (84, [math.inf, 1.0, 0.0, 0.0])]
    rows += [(90, [1.0, 1.0, 0.0, 0.0])] * 30
    queries = [r for r in rows[:60] if r[0] % 5 == 0] + rows[60:] + [(90, [0.0, 0.0, 2.0, 1.0])]
    df = lambda r: spark.createDataFrame(r, "id long, vec array<double>").repartition(3)
    good_queries = [q for q in queries if q in rows] + [(90, [0.0, 0.0, 2.0, 1.0])]
    got = semantic.nearest(df(rows + [(90, [0.0, 0.0, 2.0, 1.0])]), df(queries), "id", "vec", 6)
    # a repeated row is a neighbour as often as it stands there: places tell such rows apart
    assert seen(got) == plain(rows + [(90, [0.0, 0.0, 2.0, 1.0])], good_queries, 6)
    assert semantic.nearest(df(rows).where("false"), df(queries), "id", "vec").count() == 0
    assert semantic.nearest(df(rows), df(queries).where("false"), "id", "vec").count() == 0


def test_index_finds_nine_of_ten(spark, sf_dir):
    """Every row has a list; what the lists miss is measured against the exact form."""
    df = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "embeddings")
    queries = df.where("vec_id % 50 = 0")
    index = semantic.Index(df, "vec_id", "embedding")
    assert index.rows.count() == df.count()
    exact, found = seen(semantic.nearest(df, queries, "vec_id", "embedding")), seen(index.search(queries))
    pairs = lambda rows: {r[:2] for r in rows}
    assert len(pairs(exact) & pairs(found)) >= 0.9 * len(pairs(exact))
    assert seen(index.search(queries, probes=10**6)) == exact
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    grouped = [(i, [float(x) for x in centres[i % 20] + 0.05 * rng.normal(size=16)]) for i in range(2000)]
    near = spark.createDataFrame(grouped, "id long, vec array<double>")
    index, asked = semantic.Index(near, "id", "vec"), near.where("id % 50 = 0")
    exact, found = seen(semantic.nearest(near, asked, "id", "vec")), seen(index.search(asked))
    assert len(pairs(exact) & pairs(found)) >= 0.9 * len(pairs(exact)) and index.probes[16] < len(index.centroids[16]) / 2
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0])], "id long, vec array<double>")
    assert seen(semantic.Index(odd, "id", "vec").search(odd)) == {(1, 1, 1.0, 1)}
    assert semantic.Index(odd.where("false"), "id", "vec").search(odd).count() == 0


def test_relevance(spark):
    """Similarity first, then the reranker, then local points; held between 0 and 1."""
    rows = [(0, 0.5, 0.9), (1, None, 0.4567), (2, None, None), (3, -0.2, None), (4, 1.7, 0.1), (5, math.nan, 2.0)]
    df = spark.createDataFrame([(*r, *([3.0] * 6)) for r in rows], "id int, sim double, re double, " + ", ".join(f"{p}_points double" for p in matching.PARTS))
    got = {r.id: (r.source, r.relevance, r.title_points, r.missions_points, r.total) for r in matching.by_relevance(df, df.sim, df.re).collect()}
    assert got == {
        0: ("semantic", 0.5, 10.0, 5.0, 27.0), 1: ("rerank", 0.457, 9.13, 4.57, 25.7), 2: ("local", None, 3.0, 3.0, 18.0),
        3: ("semantic", 0.0, 0.0, 0.0, 12.0), 4: ("semantic", 1.0, 20.0, 10.0, 42.0), 5: ("rerank", 1.0, 20.0, 10.0, 42.0),
    }
    pairs = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] and round(r[0], 6) for r in pairs.select(scores.cosine(pairs.a, pairs.b)).collect()] == [0.707107, None, None, None, None]


ODD = [None, [], [0.0, 0.0], [1.0], [-2.0], [1.0, None], [math.nan, 1.0], [math.inf, 1.0], [1e200, 1.0], [1e-200, 0.0], [1.0, -0.0], [3.0, 4.0], [0.1, 0.7], [3.0, 4.0]]


def test_similarities_of_all_pairs(spark, monkeypatch):
    """In parts and blocks as pair by pair, to the last bit; nothing is moved or worked out for a pair alone."""
    for name, value in (("MET", 3), ("ASKED", 2)):
        monkeypatch.setattr(semantic, name, value)
    rng = np.random.default_rng(7)
    long = [[float(x) for x in rng.normal(size=33)] for _ in range(9)]
    rows = spark.createDataFrame([(i % 2, i % 5 and i, f"r{i}", v) for i, v in enumerate(ODD + long + long[:2])], "g int, r int, name string, own array<double>")
    queries = spark.createDataFrame([(i % 3, i % 4 or None, v) for i, v in enumerate(ODD + long[:4])], "g int, q int, asked array<double>")
    got = semantic.similarities(rows, "own", queries, "asked", "q", "g")
    assert got.columns == ["g", "r", "name", "q", "similarity"]
    want = rows.join(queries, "g").select("g", "r", "name", "q", scores.cosine(rows.own, queries.asked).alias("similarity")).collect()
    told = lambda r: tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r)
    assert Counter(map(told, got.collect())) == Counter(map(told, want))
    assert sum(told(r)[4] is not None for r in want) == 20
    assert semantic.similarities(rows.where("false"), "own", queries, "asked", "q", "g").count() == 0
    assert semantic.similarities(rows, "own", queries.where("false"), "asked", "q", "g").count() == 0


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """A folder of suppliers that are asked for, parts and vectors: some ids have no vector, one that is like nothing, or two."""
    d = str(tmp_path_factory.mktemp("odd"))
    names = ["small ring", "red ring", "small red ring", "hot bolt", "cold widget", "small red bolt"]
    vectors = [(i * 50 if k else i, v) for k in (0, 1) for i, v in enumerate(ODD)] + [(i * 50, [float(i), 20.0]) for i in range(14, 60)] + [(150, [1.0, 2.0]), (150, None), (2, [4.0, 3.0]), (None, [1.0, 1.0])]
    for name, rows, schema in (
        ("supplier", [(i * 25, i % 5) for i in range(122)] + [(550, 1), (100, 0)], "s_suppkey long, s_nationkey int"),
        ("part", [(i, names[i % 6], i % 13, ("PROMO", "ECONOMY")[i % 2], 900.0 + 20 * i, f"Brand#{i % 2 + 1}") for i in range(18)], "p_partkey long, p_name string, p_size int, p_type string, p_retailprice double, p_brand string"),
        ("embeddings", vectors, "vec_id long, embedding array<double>"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def with_vectors(spark, d, name, key):
    """The rows of a table, once for each vector of their id, and once for those without any."""
    return spark.read.parquet(f"{d}/{name}.parquet").join(spark.read.parquet(f"{d}/embeddings.parquet").withColumnRenamed("vec_id", key), key, "left")


def test_relevance_of_odd_vectors(spark, odd_tables):
    query = catalogue.QUERIES["sco_09_relevance"](spark, odd_tables)
    assert "aggregate(" not in query._jdf.queryExecution().toString()  # an expression over arrays for each pair took too long
    needs = with_vectors(spark, odd_tables, "supplier", "s_suppkey").where("s_suppkey % 50 = 0").collect()
    want = Counter()
    for p in with_vectors(spark, odd_tables, "part", "p_partkey").collect():
        for n in needs:
            a, b = n.embedding, p.embedding
            x = math.nan
            if a and b and len(a) == len(b) and None not in (*a, *b):
                dot = lambda v, w: sum(i * j for i, j in zip(v, w, strict=True))
                x = dot(a, b) / (math.sqrt(dot(a, a) * dot(b, b)) or math.nan)
            held = [] if math.isnan(x) else [math.floor(max(0.0, min(1.0, x)) * 1000 + 0.5) / 1000]
            points = [math.floor(max(0.0, min(1.0, x)) * k * 100 + 0.5) / 100 for k in (20, 10)] if held else [1.0, 1.0]
            want[n.s_suppkey, p.p_partkey, "semantic" if held else "local", held[0] if held else None, *points] += 1
    assert Counter(map(tuple, query.collect())) == want and len({w[2:4] for w in want}) > 5


def test_semantic_mode_of_odd_vectors(spark, odd_tables, monkeypatch):
    """As every pair scored for itself; the local rules are met once for needs that ask the same, whatever their vectors."""
    need, part = scoring._engine(spark, odd_tables)
    embeddings = lambda key, name: spark.read.parquet(f"{odd_tables}/embeddings.parquet").toDF(key, name)
    need, part = need.join(embeddings("s_suppkey", "asked"), "s_suppkey", "left"), part.join(embeddings("p_partkey", "own"), "p_partkey", "left")
    pairs = matching.scored(part.crossJoin(need))
    rows = matching.by_relevance(pairs, scores.cosine(F.col("asked"), F.col("own"))).withColumn("band", scores.band_a(F.col("total"))).collect()
    scored, counted = matching.scored, []
    monkeypatch.setattr(matching, "scored", lambda pairs: counted.append(pairs.count()) or scored(pairs))
    query = catalogue.QUERIES["sco_09_semantic_mode"](spark, odd_tables)
    assert sum(counted) < len(rows) / 4
    shown = [c for c in query.columns if c != "rank"]
    got = query.collect()
    assert Counter(tuple(r[c] for c in shown) for r in got) == Counter(tuple(r[c] for c in shown) for r in rows)
    for key in {r.s_suppkey for r in rows}:
        best = sorted((-r.total, r.p_partkey) for r in rows if r.s_suppkey == key and r.total >= 80)
        assert sorted((r["rank"], -r.total, r.p_partkey) for r in got if r.s_suppkey == key and r["rank"]) == [(i + 1, *x) for i, x in enumerate(best)]
    assert {r.source for r in got if r["rank"]} == {r.source for r in got} == {"local", "semantic"}
