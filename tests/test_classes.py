"""Queries that are alike are met once, and numbers within a group don't depend on how it is cut."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from talweg.operators.blocks import by_class, classes, numbered, queries_in_blocks


def test_alike_queries_are_met_once(spark):
    queries = spark.createDataFrame([(1, 3, ["a"]), (2, 3, ["a"]), (3, 4, ["a"]), (4, None, None), (None, 4, ["a"]), (5, None, None), (6, 3, ["a"]), (6, 4, ["a"])], "q long, x int, y array<string>")
    rows = spark.range(5).withColumnRenamed("id", "r")
    made = lambda pairs: pairs.select("q", "r", (F.coalesce("x", F.lit(0)) * 10 + F.col("r")).alias("v"), "y")
    met = []
    got = by_class(rows, queries, "q", lambda pairs: met.append(pairs.count()) or made(pairs))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, made(queries_in_blocks(rows, queries, "q")).collect()))
    assert met == [5 * 5]  # classes: 1 and 2, 3 and null, 4 and 5, and 6 with its two rows
    assert got.columns == ["q", "r", "v", "y"]
    assert by_class(rows, queries.where("false"), "q", made).count() == 0
    one, members = classes(queries.select("q"), "q")
    assert sorted(members.select(F.explode("_keys")).toPandas()["col"].dropna()) == [1, 2, 3, 4, 5, 6] and one.select("q").distinct().count() == 2


def test_numbers_in_large_groups(spark):
    rows = spark.range(5000).select((F.col("id") % 7 % 3).alias("g"), F.col("id"), (F.col("id") * 7919 % 11).alias("v")).withColumn("g", F.when(F.col("g") < 2, F.col("g")))
    got = numbered(rows, "g", [F.desc("v"), F.col("id")], "k")
    want = rows.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), "id")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert numbered(rows.where("false"), "g", [F.col("id")], "k").count() == 0
