"""Offers against profiles, both read from texts by dictionary search: what an offer asks for and how much, when a profile
last used it, and the five axes of the second scoring engine.

Null and empty texts ask for nothing; axes that nothing is asked of are neutral (0.5). Texts are read whole. Nothing is
collected: demands and skills meet in equi-joins on names, grouped by offer and profile with map-side sums, or, for all pairs,
in blocks (`shared_sums`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg.functions import scores
from talweg.functions.text import fold
from talweg.operators.blocks import bounded_batches, spread
from talweg.operators.search import find_terms
from talweg.sources.tables import stored

# Phrases that make what stands in their sentence a must, and those that make it a plus; sentences; years asked for.
MUST = r"imperati(?:f|ve)|indispensable|obligatoire|\bexige|\brequis|incontournable|maitrise\s+(?:parfaite|solide|imperative|approfondie)|solide\s+(?:experience|maitrise)|expertise\s+(?:confirmee|avancee)"
PLUS = r"(?:est|serai?t?|constitue)\s+un\s+(?:plus|atout)|un\s+atout|appreci|idealement|\bbonus\b|nice\s+to\s+have|optionnel|de\s+preference|serait\s+appreciee?"
SENTENCE_END = r"[\n\r]+|[.;]\s+"
_YEARS = r"\s*(?:ans?|annees?|years?|jahren?|anos)"
YEARS_FIRM = (
    rf"(\d{{1,2}})\s*\+?{_YEARS}\s*(?:minimum|min\.?|au\s+moins)?\s*(?:d[e']\s*|of\s+)?exp",
    rf"(?:minimum|min\.?|au\s+moins|a\s+minima|plus\s+de|at\s+least)\s*(\d{{1,2}}){_YEARS}",
    rf"(\d{{1,2}})\s*\+{_YEARS}",
    rf"(\d{{1,2}}){_YEARS}\s*\+",
    rf"(\d{{1,2}})\s*(?:a|-|/)\s*\d{{1,2}}{_YEARS}",
)
YEARS_NAMED = rf"\b(\d{{1,2}}){_YEARS}\b"
MUST_FACTOR, PLUS_FACTOR, VERSION_FACTOR, NO_WEIGHT = 1.5, 0.6, 0.85, 2.0
#: Blocks of rows and of queries that meet in a task, and pairs in a batch that leaves it.
ROWS, QUERIES, OUT = 250, 1000, 1 << 15


def sentences(offers: DataFrame, keys: list[str], text: str = "text", must: str = MUST, plus: str = PLUS) -> DataFrame:
    """keys, sentence (its text) and factor: 1.5 where it makes a must, else 0.6 where it makes a plus, else 1."""
    each = offers.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), SENTENCE_END, -1)).alias("sentence")).where("trim(sentence) != ''")
    flat = F.lower(fold(F.col("sentence")))
    return each.withColumn("factor", F.when(flat.rlike(must), MUST_FACTOR).when(flat.rlike(plus), PLUS_FACTOR).otherwise(1.0))


def demands(offers: DataFrame, keys: list[str], terms: DataFrame, text: str = "text", must: str = MUST, plus: str = PLUS) -> DataFrame:
    """keys, name, category, weight: what offers ask for.

    A name weighs what its term does, times the largest factor of the sentences that it stands in, rounded to one place where
    that isn't 1. Names that are found only across the end of a sentence keep their weight.
    """
    whole = find_terms(offers, keys, text, terms).groupBy(*keys, "name").agg(F.min("category").alias("category"), F.max("weight").alias("weight"))
    said = sentences(offers, keys, text, must, plus)
    factors = find_terms(said, [*keys, "factor"], "sentence", terms).groupBy(*keys, "name").agg(F.max("factor").alias("factor"))
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"f.{k}")) for k in (*keys, "name")]
    factor = F.coalesce("f.factor", F.lit(1.0))
    weighed = F.when(factor == 1.0, F.col("w.weight")).otherwise(F.floor(F.col("w.weight") * factor * 10 + 0.5) / 10)
    return whole.alias("w").join(factors.alias("f"), same, "left").select(*[f"w.{k}" for k in keys], "w.name", "w.category", weighed.alias("weight"))


def skills(hits: DataFrame, profile: str, year: str) -> DataFrame:
    """profile, name, category, year: what profiles have, with the last year of the missions whose texts name it (null: unknown)."""
    return hits.groupBy(profile, "name").agg(F.min("category").alias("category"), F.max(year).alias("year"))


def versions(names: DataFrame) -> DataFrame:
    """name, other: pairs of names of which one is the other and a version number (`v4`, `11`), both ways round.

    Each name's possible beginnings before a version meet the names they equal, so names aren't paired with all others.
    """
    starts = names.select(F.col("name").alias("long"), F.explode(F.expr("filter(transform(sequence(1, greatest(length(name) - 1, 1)), k -> if(trim(substring(name, k + 1)) rlike '^[vV]?[0-9]', lower(substring(name, 1, k)), null)), x -> x is not null)")).alias("start"))
    pairs = starts.join(names.select(F.col("name").alias("short"), F.lower("name").alias("start")), "start").where("long != short").select("short", "long").distinct()
    return pairs.select(F.col("short").alias("name"), F.col("long").alias("other")).union(pairs.select("long", "short"))


def credits(names: DataFrame, skills: DataFrame, profile: str, now: int) -> DataFrame:
    """profile, name, credit: what profiles obtain of each of `names` that they have, by the skill's recency, times 0.85 where
    only another version is there (the freshest counts)."""
    known = names.select("name").union(skills.select("name")).distinct()
    ways = known.select("name", F.col("name").alias("other"), F.lit(1.0).alias("share")).union(versions(known).withColumn("share", F.lit(VERSION_FACTOR)))
    asked = ways.join(names.select("name").distinct(), "name")
    met = asked.join(skills.select(profile, F.col("name").alias("other"), "year"), "other")
    credit = F.struct((F.col("share") == 1.0).alias("exact"), (F.col("share") * scores.recency(F.lit(now) - F.col("year"))).alias("credit"))
    return met.groupBy(profile, "name").agg(F.max(credit)["credit"].alias("credit"))


def full_weight(weight: Column) -> Column:
    """A demand without a weight has one."""
    return F.when(F.coalesce(weight, F.lit(0.0)) == 0, NO_WEIGHT).otherwise(weight)


def technology_matches(demands: DataFrame, skills: DataFrame, offer: str, profile: str, now: int) -> DataFrame:
    """offer, profile, obtained, matched for the pairs that share a technology or a version of one; all others obtain nothing.

    A demand brings its weight times the credit of the profile's skill.
    """
    asked = demands.groupBy(offer, "name").agg(F.first(full_weight(F.col("weight"))).alias("weight"))
    met = asked.join(credits(asked, skills, profile, now), "name")
    return met.groupBy(offer, profile).agg(F.sum(F.col("weight") * F.col("credit")).alias("obtained"), F.count(F.lit(1)).alias("matched"))


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """`rows` in arrays of about `size`, as column `name`."""
    n = max(1, -(-rows.count() // size))
    return rows.groupBy(F.pmod(F.monotonically_increasing_id(), F.lit(n)).alias("_block")).agg(F.collect_list(F.struct(*rows.columns)).alias(name)).select(name)


def shared_sums(rows: DataFrame, queries: DataFrame, sums: list[str]) -> DataFrame:
    """Each of `rows` with each of `queries`, their columns but `has` and `asks`, and for each of `sums` the values of the names
    that both have, multiplied and added (0.0 without any).

    `has` and `asks` are array<struct<sum int, name string, value double>>, sum being a place in `sums`; a name stands once for a
    sum, null arrays are empty. Blocks of rows meet blocks of queries, so pairs are neither joined nor shuffled; what a task
    holds is ROWS times QUERIES pairs. Products are added in the names' order.
    """
    bounded_batches(rows.sparkSession)
    left, right = spread(_blocks(stored(rows, "rows"), ROWS, "rows")), _blocks(stored(queries, "queries"), QUERIES, "queries")
    own, theirs = ([c for c in df.columns if c != x] for df, x in ((rows, "has"), (queries, "asks")))
    schema = T.StructType([*(rows.schema[c] for c in own), *(queries.schema[c] for c in theirs), *(T.StructField(c, T.DoubleType()) for c in sums)])

    def entries(array: pa.StructArray, name: str) -> tuple:
        """(row, sum, name, value) of all entries."""
        lists = array.field(name)
        flat = lists.flatten()
        of = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        return of, flat.field("sum").to_numpy(zero_copy_only=False), flat.field("name"), flat.field("value").to_numpy(zero_copy_only=False)

    def places(keys: np.ndarray) -> dict:
        """Where each key stands."""
        order = np.argsort(keys, kind="stable")
        found, begins = np.unique(keys[order], return_index=True)
        return dict(zip(found.tolist(), np.split(order, begins[1:]), strict=True))

    def met(a: pa.StructArray, b: pa.StructArray) -> np.ndarray:
        out = np.zeros((len(sums), len(a), len(b)))
        (row, row_sum, row_name, value), (query, query_sum, query_name, weight) = entries(a, "has"), entries(b, "asks")
        names = pc.unique(query_name)
        names = names.take(pc.sort_indices(names))
        code = lambda x, of: np.asarray(pc.fill_null(pc.index_in(x, value_set=names), -1)).astype(np.int64) * len(sums) + of
        asked = places(code(query_name, query_sum))
        for key, at in places(code(row_name, row_sum)).items():
            if key >= 0 and key in asked:
                by = asked[key]
                out[key % len(sums)][np.ix_(row[at], query[by])] += value[at][:, None] * weight[by][None, :]
        return out

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values for c in (0, 1))
                found, each = met(a, b), max(1, OUT // len(b))
                for i in range(0, len(a), each):
                    n = len(a[i : i + each])
                    of_a, of_b = np.repeat(np.arange(i, i + n), len(b)), np.tile(np.arange(len(b)), n)
                    columns = [*(a.field(c).take(pa.array(of_a)) for c in own), *(b.field(c).take(pa.array(of_b)) for c in theirs)]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x[i : i + n].ravel()) for x in found)], names=schema.names)

    return left.join(right.hint("shuffle_replicate_nl")).mapInArrow(over, schema)


def shared_names(demands: DataFrame, skills: DataFrame, offer: str, profile: str, name: str) -> DataFrame:
    """offer, profile and, as `name`, how many names they have in common."""
    met = demands.select(offer, "name").join(skills.select(profile, "name").distinct(), "name")
    return met.groupBy(offer, profile).agg(F.count(F.lit(1)).alias(name))


def years_asked(text: Column) -> Column:
    """The years of experience that a text asks for, from 1 to 30: the most that stands with `experience`, a least or a plus, else the most
    named at all; null without any."""
    flat = F.lower(fold(F.coalesce(text, F.lit(""))))
    numbers = lambda x: F.array_max(F.filter(F.transform(x, lambda v: v.cast("int")), lambda v: v.between(1, 30)))
    firm = F.concat(*[F.regexp_extract_all(flat, F.lit(w), F.lit(1)) for w in YEARS_FIRM])
    return F.coalesce(numbers(firm), numbers(F.regexp_extract_all(flat, F.lit(YEARS_NAMED), F.lit(1))))
