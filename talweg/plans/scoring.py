"""The two matching engines over parts (candidates) and suppliers (needs), and the other scores."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions import scores
from talweg.operators import matching, semantic
from talweg.operators.blocks import by_class, classes, numbered, queries_in_blocks, spread, to_members
from talweg.plans.registry import query
from talweg.sources.tables import stored, table

C = F.col

_NEEDS = "(SELECT s_suppkey, s_nationkey % 4 * 3 AS least, ['red', 'ring'] AS required FROM supplier WHERE s_suppkey % 50 = 0)"


def _needs(spark, d):
    """The stated needs: suppliers whose id is divisible by 50."""
    return table(spark, d, "supplier").where("s_suppkey % 50 = 0").select("s_suppkey", (C("s_nationkey") % 4 * 3).alias("least"), F.array(F.lit("red"), F.lit("ring")).alias("required"))


def _candidates(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", F.split("p_name", " ").alias("has"))


_SKILLS = "floor((2 - len(list_filter(required, lambda r: NOT list_bool_or(list_transform(string_split(p_name, ' '), lambda s: contains(s, r) OR contains(r, s)))))) / 2.0 * 35 * 100 + 0.5) / 100"
_SENIOR = "floor((CASE WHEN least = 0 THEN 0.6 WHEN p_size >= least THEN 0.5 WHEN p_size >= least * 0.8 THEN 0.3 ELSE 0 END) * 15 * 100 + 0.5) / 100"


@query("sco_01_skills", f"SELECT s_suppkey, p_partkey, {_SKILLS} AS points FROM part, {_NEEDS}")
def _(spark, d):
    """The points of every part for the stated needs, made once for those that require the same."""
    made = lambda pairs: pairs.select("s_suppkey", "p_partkey", scores.skills_score(C("required"), C("has"))["points"].alias("points"))
    return by_class(_candidates(spark, d).drop("p_size"), _needs(spark, d).drop("least"), "s_suppkey", made)


def _totals(pairs):
    senior = scores.seniority_score(F.lit(""), C("least"), C("p_size"))
    return pairs.select("s_suppkey", "p_partkey", F.least(F.lit(100.0), scores.skills_score(C("required"), C("has"))["points"] + senior + 5 + 4).alias("total"))


_TOTAL = f"least(100.0, {_SKILLS} + {_SENIOR} + 5 + 4)"


@query("sco_07_total", f"SELECT s_suppkey, p_partkey, total, CASE WHEN total >= 75 THEN 'strong' WHEN total >= 55 THEN 'good' WHEN total >= 35 THEN 'partial' ELSE 'weak' END AS band, row_number() OVER (PARTITION BY s_suppkey ORDER BY total DESC, p_partkey) AS rank FROM (SELECT s_suppkey, p_partkey, {_TOTAL} AS total FROM part, {_NEEDS})")
def _(spark, d):
    """Totals and ranks, made once for needs that ask the same."""

    def made(pairs):
        ranked = numbered(_totals(pairs), "s_suppkey", [F.desc("total"), C("p_partkey")], "rank")
        return ranked.select("s_suppkey", "p_partkey", "total", scores.band_a(C("total")).alias("band"), "rank")

    return by_class(_candidates(spark, d), _needs(spark, d), "s_suppkey", made)


@query("sco_23_retained", f"SELECT s_suppkey, p_partkey, CASE WHEN total >= 50 THEN row_number() OVER (PARTITION BY s_suppkey, total >= 50 ORDER BY total DESC, p_partkey) END AS rank FROM (SELECT s_suppkey, p_partkey, {_TOTAL} AS total FROM part, {_NEEDS})")
def _(spark, d):
    """Only what reaches the threshold has a rank; made once for needs that ask the same."""
    made = lambda pairs: matching.ranked(_totals(pairs), "s_suppkey", "p_partkey", 50.0).select("s_suppkey", "p_partkey", "rank")
    return by_class(_candidates(spark, d), _needs(spark, d), "s_suppkey", made)


def _engine(spark, d):
    """Needs and candidates of the whole engine: the stated suppliers and every part, out of names, sizes, types and prices."""
    need = table(spark, d, "supplier").where("s_suppkey % 50 = 0").select(
        "s_suppkey", F.lit("small red ring").alias("need_title"), F.array(F.lit("red"), F.lit("ring")).alias("required"), (C("s_nationkey") % 4 * 3).alias("least"),
        F.element_at(F.array(*map(F.lit, ("", "junior", "senior", "expert"))), (C("s_nationkey") % 4 + 1).cast("int")).alias("level"), F.lit("").alias("client"), F.lit("economy").alias("sector"),
        F.lit(None).cast("string").alias("context"), F.array(F.lit("small")).alias("languages"), F.lit("Brand#1").alias("place"), F.lit("remote").alias("remote"), F.lit("promo").alias("contract"),
    )
    part = table(spark, d, "part").select(
        "p_partkey", C("p_name").alias("title"), F.split("p_name", " ").alias("skills"), C("p_size").alias("years"), F.lit("1 mois").alias("status"), F.concat_ws(" ", "p_name", "p_type").alias("text"),
        C("p_name").alias("done"), C("p_name").alias("spoken"), (C("p_retailprice") >= 1000).cast("int").alias("certificates"), C("p_brand").alias("home"),
    )
    return need, part


@query("sco_07_whole_engine")
def _(spark, d):
    """All six parts and the rank over the threshold of 80, of the stated needs and every part: names are titles and skills, sizes years, types what was done, prices of 1000 and more a certificate. Matching blocks have no SQL."""
    need, part = _engine(spark, d)
    kept = ["s_suppkey", "p_partkey", *(f"{p}_points" for p in matching.PARTS), "missing", "total"]
    made = lambda pairs: matching.ranked(matching.scored(pairs).select(*kept), "s_suppkey", "p_partkey").select(*kept, "band", "rank")
    return by_class(part, need, "s_suppkey", made)


def _with_vectors(spark, d):
    """Needs and candidates of the engine with the vector of their id; many have none, and one that is like nothing is none."""
    need, part = _engine(spark, d)
    own = C("embedding").cast("array<double>")
    vectors = lambda k, v: table(spark, d, "embeddings").select(C("vec_id").alias(k), F.when(semantic.finite(own), own).alias(v))
    return need.join(vectors("s_suppkey", "asked_vector"), "s_suppkey", "left"), part.join(vectors("p_partkey", "own_vector"), "p_partkey", "left")


@query("sco_09_semantic_mode")
def _(spark, d):
    """The whole engine, title and missions by similarity of vectors where both sides have one, else by the local rules.

    The local rules are met once for needs that ask the same, whatever their vectors. Pairs without a vector are only copied to each need; of
    pairs by vectors only those retained are moved, for their rank."""
    need, part = _with_vectors(spark, d)
    part = stored(part, "candidates")
    own, asked, kept = C("own_vector").isNotNull(), C("asked_vector").isNotNull(), matching.reaches()
    points = ["p_partkey", *(f"{p}_points" for p in matching.PARTS)]
    shown = ["s_suppkey", *points, "source", "relevance", "total"]

    def local(part, need):
        """Rows of those that are met without vectors, once for needs that ask the same, and the members that they are for."""
        contents, members = classes(need.drop("asked_vector"), "s_suppkey")
        pairs = matching.scored(queries_in_blocks(spread(part.drop("own_vector")), contents, "s_suppkey"))
        return stored(matching.by_relevance(pairs, F.lit(None).cast("double")).select(*shown), "local"), members

    # candidates without a vector are local to every need, the others to needs without one
    alone = [local(part.where(~own), need), local(part.where(own), need.where(~asked))]
    need = need.where(asked)
    asks = stored(need.drop("s_suppkey", "asked_vector").distinct().withColumn("_ask", F.monotonically_increasing_id()), "asks")
    need = need.join(asks, reduce(and_, [need[c].eqNullSafe(asks[c]) for c in asks.columns if c != "_ask"])).select("_ask", "s_suppkey", "asked_vector")
    met = stored(matching.scored(queries_in_blocks(spread(part.where(own)), asks, "_ask")).select("_ask", *points, "own_vector"), "met")
    both = matching.by_relevance(semantic.similarities(met, "own_vector", need, "asked_vector", "s_suppkey", "_ask"), C("similarity")).select(*shown)

    of = lambda which: reduce(DataFrame.unionByName, [*(to_members(rows.where(which), members, "s_suppkey") for rows, members in alone), both.where(which)])
    return matching.placed(stored(of(kept), "retained"), of(~kept), "s_suppkey", "p_partkey").select(*shown, "band", "rank")


@query(
    "sco_09_relevance",
    """SELECT s_suppkey, p_partkey, CASE WHEN x IS NULL THEN 'local' ELSE 'semantic' END AS source, floor(x * 1000 + 0.5) / 1000 AS relevance, coalesce(floor(x * 20 * 100 + 0.5) / 100, 1.0) AS title_points, coalesce(floor(x * 10 * 100 + 0.5) / 100, 1.0) AS missions_points
    FROM (SELECT s_suppkey, p_partkey, CASE WHEN c IS NOT NULL THEN greatest(0.0, least(1.0, c)) END AS x FROM (SELECT s_suppkey, p_partkey, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM (SELECT * FROM supplier LEFT JOIN embeddings ON vec_id = s_suppkey WHERE s_suppkey % 50 = 0) a, (SELECT * FROM part LEFT JOIN embeddings ON vec_id = p_partkey) b))""",
)
def _(spark, d):
    """The relevance of every candidate for the stated needs, and its points over local ones of 1 each."""
    need, part = _with_vectors(spark, d)
    need, part = need.select("s_suppkey", "asked_vector"), stored(part.select("p_partkey", "own_vector"), "candidates")

    def made(pairs, similarity):
        points = {f"{p}_points": F.lit(1.0) for p in matching.PARTS}
        return matching.by_relevance(pairs.withColumns(points), similarity).select("s_suppkey", "p_partkey", "source", "relevance", "title_points", "missions_points")

    # candidates without a vector are local to every need, the others to needs without one
    local = lambda part, need: by_class(part.drop("own_vector"), need.drop("asked_vector"), "s_suppkey", lambda pairs: made(pairs, F.lit(None).cast("double")))
    own, asked = C("own_vector").isNotNull(), C("asked_vector").isNotNull()
    both = semantic.similarities(part.where(own).withColumn("_ask", F.lit(0)), "own_vector", need.where(asked).withColumn("_ask", F.lit(0)), "asked_vector", "s_suppkey", "_ask")
    return local(part.where(~own), need).unionByName(local(part.where(own), need.where(~asked))).unionByName(made(both, C("similarity")))


@query(
    "vec_02_nearest",
    """SELECT query, near, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, near) AS place FROM (SELECT a.vec_id AS query, b.vec_id AS near,
    floor(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 1000000 + 0.5) / 1000000 AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND len(a.embedding) = len(b.embedding))) WHERE place <= 10""",
)
def _(spark, d):
    """The ten nearest of all vectors for those whose id is divisible by 50, exactly."""
    rows = table(spark, d, "embeddings")
    return semantic.nearest(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding").select("query", "near", "similarity", C("place").cast("long"))


@query("vec_02_nearest_index")
def _(spark, d):
    """As vec_02_nearest, through the inverted file; tests measure what it finds against the exact form."""
    rows = table(spark, d, "embeddings")
    return semantic.Index(rows, "vec_id", "embedding").search(rows.where("vec_id % 50 = 0")).select("query", "near", "similarity", C("place").cast("long"))


@query("sco_02_title")
def _(spark, d):
    """Titles compared by matching blocks, which SQL lacks; each distinct pair once."""
    names = table(spark, d, "part").select("p_name").distinct()
    same = scores.ratio(F.lit("small red ring"), C("p_name"))
    return names.select("p_name", scores.title_score(same, scores.keyword_overlap(F.lit("small red ring"), C("p_name"))).alias("points"))


@query(
    "sco_16_profile_total",
    """SELECT o_custkey, CAST(floor(40 * CASE WHEN n = 0 THEN 0.5 ELSE pow(least(1.0, r / n), 0.8) END + 20 * pow(u / n, 0.8) + 15 * CASE WHEN n >= 10 THEN CASE WHEN n - 10 <= 5 THEN 1.0 ELSE greatest(0.5, 1 - (n - 15) * 0.05) END ELSE pow(n / 10, 1.4) END + 15 * 0.5 + 10 * 0.1 + 0.5) AS BIGINT) AS total
    FROM (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS r, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) AS u FROM orders GROUP BY 1)""",
)
def _(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(C("o_orderstatus") == "F").cast("double").alias("r"), F.count_if(C("o_orderpriority") == "1-URGENT").cast("double").alias("u"))
    total = scores.profile_total(scores.technology_axis(C("r"), C("n")), scores.set_axis(C("u"), C("n")), scores.seniority_axis(C("n"), F.lit(10)), F.lit(0.5), F.lit(0.1))
    return n.select("o_custkey", total.cast("long").alias("total"))


@query(
    "sco_17_experience",
    """SELECT o_orderkey, floor((0.35 * greatest(0.05, exp(-y / 6.0)) + 0.2 * CASE WHEN m = 0 THEN 0.4 WHEN m < 4 THEN 0.25 ELSE least(1.0, 0.35 + log10(m) * 0.55) END + 0.2 * 0.5 + 0.15 * 0.15 + 0.1 * 0.35) * 1000 + 0.5) / 1000 AS score
    FROM (SELECT o_orderkey, 2002 - year(o_orderdate) AS y, o_orderkey % 40 AS m FROM orders)""",
)
def _(spark, d):
    y, m = 2002 - F.year("o_orderdate"), C("o_orderkey") % 40
    score = scores.experience_score(scores.experience_recency(y, F.lit(False)), scores.duration_score(m), F.lit(0.5), F.lit(0.15), F.lit(0.35))
    return table(spark, d, "orders").select("o_orderkey", score.alias("score"))


@query("sco_19_greedy_distinct")
def _(spark, d):
    """Of each conversation's turns, longest first, those whose words of four letters overlap none kept by over 0.62 of the smaller set: order matters, so a group is one task's, and its turns are few."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[set] = []
        rows = []
        for r in sorted(pdf.itertuples(index=False), key=lambda r: (-len(r.text), r.turn)):
            words = set(re.findall(r"[a-z]{4,}", r.text.lower()))
            if not any(words and k and len(words & k) / min(len(words), len(k)) > 0.62 for k in kept):
                kept.append(words)
                rows.append((r.conv_id, r.turn))
        return pd.DataFrame(rows, columns=["conv_id", "turn"])

    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).groupBy("conv_id").applyInPandas(keep, "conv_id long, turn long")


@query("sco_20_reduced", "SELECT o_custkey, o_orderkey, CASE WHEN k > 4 THEN 'capped' ELSE 'kept' END AS outcome FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC, o_totalprice DESC, o_orderkey) AS k FROM orders)")
def _(spark, d):
    """Forced ones first, then by score, four at most; the others with a reason."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc(C("o_orderpriority") == "1-URGENT"), F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.row_number().over(w) > 4, "capped").otherwise("kept").alias("outcome"))


@query("sco_21_budget_packing")
def _(spark, d):
    """Items kept whole, in order, while they fit a budget; one that doesn't fit is passed over."""
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("kept"))
    step = lambda a, x: F.when(a["used"] + x["l_quantity"] <= 60, F.struct((a["used"] + x["l_quantity"]).alias("used"), F.array_append(a["kept"], x["l_linenumber"]).alias("kept"))).otherwise(a)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(items.alias("items")).select("l_orderkey", F.aggregate("items", start, step, lambda a: a["kept"]).alias("kept"))


@query("sco_24_end_alerts", "SELECT o_orderkey, days, CASE WHEN o_orderstatus = 'F' THEN 'none' WHEN days <= 7 THEN 'red' WHEN days <= 30 THEN 'orange' ELSE 'none' END AS alert FROM (SELECT *, date_diff('day', date '2001-06-01', CAST(o_orderdate AS DATE)) AS days FROM orders)")
def _(spark, d):
    days = F.datediff(F.to_date("o_orderdate"), F.lit("2001-06-01").cast("date")).cast("long")
    return table(spark, d, "orders").select("o_orderkey", days.alias("days"), F.when(C("o_orderstatus") == "F", "none").when(days <= 7, "red").when(days <= 30, "orange").otherwise("none").alias("alert"))


@query("sco_25_validity", "SELECT o_orderkey, CASE WHEN d < 0 THEN 'expired' WHEN d <= 30 THEN 'soon' ELSE 'valid' END AS state FROM (SELECT o_orderkey, date_diff('day', date '2001-06-01', CAST(CAST(o_orderdate AS DATE) + INTERVAL 6 MONTH AS DATE)) AS d FROM orders)")
def _(spark, d):
    """Six months from the day of issue; the end of a shorter month is its last day."""
    days = F.datediff(F.add_months(F.to_date("o_orderdate"), 6), F.lit("2001-06-01").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", F.when(days < 0, "expired").when(days <= 30, "soon").otherwise("valid").alias("state"))
