"""Listings, names and counts; JSON and line-wise sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talweg.plans.registry import query
from talweg.sources.tables import table

C = F.col


@query("sco_22_chips", "SELECT p_type, list(p_name ORDER BY k) AS chips FROM (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY sum(p_size) DESC, p_name) AS k FROM part GROUP BY 1, 2) WHERE k <= 4 GROUP BY 1")
def _(spark, d):
    """The four heaviest names of each kind."""
    w = Window.partitionBy("p_type").orderBy(F.desc("weight"), "p_name")
    top = table(spark, d, "part").groupBy("p_type", "p_name").agg(F.sum("p_size").alias("weight")).withColumn("k", F.row_number().over(w)).where("k <= 4")
    return top.groupBy("p_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p_name"))), lambda x: x["p_name"]).alias("chips"))


@query("sup_03_stored_results", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_custkey = 7")
def _(spark, d):
    """Detail view: results with their candidate and its place."""
    who, where = table(spark, d, "customer"), table(spark, d, "nation")
    return table(spark, d, "orders").where("o_custkey = 7").join(who, C("o_custkey") == C("c_custkey"), "left").join(where, C("c_nationkey") == C("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("sup_10_changed_count", "SELECT count(*) FILTER (trim(p_name) <> replace(p_name, 'red', 'RED')) AS changed FROM part")
def _(spark, d):
    """How many rows a clean-up changes."""
    return table(spark, d, "part").agg(F.count_if(F.trim("p_name") != F.replace(C("p_name"), F.lit("red"), F.lit("RED"))).alias("changed"))


@query("sup_36_unique_names", "SELECT p_partkey, p_name || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS file FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def _(spark, d):
    k = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_name", k.alias("k")).select("p_partkey", F.concat("p_name", F.when(C("k") > 1, F.concat(F.lit("_"), C("k"))).otherwise("")).alias("file"))


@query("snk_13_progress_lines", "SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS line FROM events")
def _(spark, d):
    """A line of JSON per event."""
    return table(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("line"))


@query("src_08_json_with_default", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INT), 0) AS k FROM events")
def _(spark, d):
    """JSON text, with a default where it can't be read."""
    r = F.from_json("props", "k int", {"mode": "PERMISSIVE"})
    return table(spark, d, "events").select("event_id", F.coalesce(r["k"], F.lit(0)).alias("k"))


@query("win_08_cumulative_budget", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) <= 60 AS fits FROM lineitem")
def _(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", (F.sum("l_quantity").over(w) <= 60).alias("fits"))
