"""Nulls, ties, repeated rows and empty tables of the library's operators."""

import datetime as dt
import math

from pyspark.sql import functions as F

from talweg.functions import labels
from talweg.functions.text import fold
from talweg.operators import blocks, intervals, store
from talweg.operators.blocks import queries_in_blocks
from talweg.plans import catalogue
from talweg.sources.tables import table


def test_upsert_with_null_keys_and_empty_tables(spark):
    schema = "k long, made string, v string"
    old = spark.createDataFrame([(1, "a", "x"), (None, "b", "y")], schema)
    new = spark.createDataFrame([(1, "c", None), (2, "d", "z")], schema)
    got = {tuple(r) for r in store.upsert(old, new, "k", "made").collect()}
    assert got == {(1, "a", None), (None, "b", "y"), (2, "d", "z")}
    empty = spark.createDataFrame([], schema)
    assert store.upsert(empty, empty, "k", "made").count() == 0
    assert store.insert_absent(empty, new, "k").count() == 2


def test_soft_delete_keeps_unknown(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    kept, gone = store.soft_delete(df, F.col("s") == "a", "t", F.lit(dt.date(2020, 1, 1)))
    assert [r.k for r in kept.collect()] == [2]
    assert {tuple(r) for r in store.restore(kept, gone, "t").collect()} == {(1, "a"), (2, None)}


def test_restored_times_are_whole_and_contents_apart(spark):
    at = dt.datetime(2020, 1, 2, 3, 4, 5, 123456)
    df = spark.createDataFrame([(1, at, at), (2, None, None)], "k long, a timestamp, b timestamp_ntz")
    assert {tuple(r) for r in store.restore(*store.soft_delete(df, F.lit(True), "t", F.lit(dt.date(2020, 1, 1))), "t").collect()} == {tuple(r) for r in df.collect()}
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), ("a", ""), ("a", None)]
    assert store.with_content_id(spark.createDataFrame(rows, "x string, y string"), ["x", "y"]).count() == 4


def test_queries_in_blocks(spark):
    rows, queries = spark.range(7).withColumnRenamed("id", "r"), spark.range(5).withColumnRenamed("id", "q")
    got = {tuple(r) for r in queries_in_blocks(rows, queries, "q", 2).collect()}
    assert got == {(r, q) for r in range(7) for q in range(5)}
    assert queries_in_blocks(rows, queries.where("false"), "q").count() == 0


def test_language_levels(spark):
    cases = {"niveau scolaire solide": "B1", "professionnel complet": "C1", "bon niveau": "B2", "langue maternelle": "C2", "scolaire": "A2", "notions": "A1", "TOEIC 790": "B2", "": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.level for r in df.select("v", labels.language_level(F.col("v")).alias("level")).collect()} == cases


def test_entry_without_a_library_of_the_extra_operators(monkeypatch):
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("talweg.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    assert not any(k.startswith("op1_") or k == "pipeline" for k in __spark_entry__.queries()) and __spark_entry__.oracle_sql() == catalogue.ORACLES


def test_interval_union(spark):
    rows = [("a", 1, 12), ("a", 13, 14), ("a", 5, 6), ("b", 1, 1), ("b", 3, 3), ("c", None, 4), ("c", 9, 2), ("a", 1, 12)]
    df = spark.createDataFrame(rows, "k string, s int, e int")
    assert {tuple(r) for r in intervals.covered_months(df, "k", "s", "e").collect()} == {("a", 14, 1), ("b", 2, 0), ("c", 24, 2)}
    assert intervals.covered_months(df.where("false"), "k", "s", "e").count() == 0


def test_fold_keeps_positions(spark):
    r = spark.createDataFrame([("Àéîõü ß œ",), (None,)], "s string").select(fold(F.col("s")).alias("x")).collect()
    assert r[0].x == "Aeiou ß œ" and r[1].x is None


def test_pushdown(spark, sf_dir):
    """A point lookup reaches the scan."""
    plan = store.point_lookup(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", 5).select("o_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,5)" in plan and "o_totalprice" not in plan


def test_either_key_attaches_all_requests(spark, tmp_path):
    """Requests of any order key, against brute force."""
    lines, orders = [(k, k % 3, k % 7) for k in (1, 2, 399, 400, 5000, 9000)], [(400, 2), (5000, 90), (9001, 5), (7, 5), (1, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["joi_06_either_key"](spark, str(tmp_path)).collect()}
    found = {(k, n): [o for o, c in orders if o == k or c == s] for k, n, s in lines}
    assert got == {(*key, min(x)) for key, x in found.items() if x}


def test_either_key_deals_even_shares(spark, sf_dir, monkeypatch):
    """More requests make more shares, not larger ones; no side of the joins is sorted, and repeated contracts repeat no request."""
    monkeypatch.setattr(blocks, "SHARE", 500)
    df = catalogue.QUERIES["joi_06_either_key"](spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").count()
    assert df.rdd.getNumPartitions() == math.ceil(2 * lines / 500)
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    sizes = df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 1000


def test_differences_over_whole_tables(spark, tmp_path):
    """Words of the last rows count, and the verdict is there when nothing differs."""

    def run(name, a, b):
        d = f"{tmp_path}/{name}"
        for t, texts in (("documents", a), ("benchmark", b)):
            spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, text string").write.parquet(f"{d}/{t}.parquet")
        return {tuple(r) for r in catalogue.QUERIES["set_01_all_differences"](spark, d).collect()}

    assert run("a", ["x y"] * 60 + ["last", None], ["y", "z"]) == {("left", "x"), ("left", "last"), ("right", "z"), ("verdict", "disagree")}
    assert run("b", ["y x"], ["x y"]) == {("verdict", "agree")}
    assert run("c", [], []) == {("verdict", "both_empty")}
    assert run("d", [], ["x"]) == {("right", "x"), ("verdict", "right_only")}
