"""Blocks of bounded size: a stated set of queries against all rows, once for those that are alike, numbers within groups of any size, and batches of rows for Python."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.sources.tables import stored

BLOCK, TASKS, SHARE = 1000, 4, 500_000


def queries_in_blocks(rows: DataFrame, queries: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Each of `rows` with each of `queries`. The queries are counted and broadcast in blocks of about `block` rows, each of
    which is one pass over `rows`; nothing is shuffled. Queries with a null key are a block's like others; without queries
    there are no rows.
    """
    n = max(1, math.ceil(queries.count() / block))
    own = lambda b: F.broadcast(queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == b))
    return reduce(DataFrame.unionAll, [rows.join(own(b), F.lit(True)) for b in range(n)])


def classes(queries: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(contents, members): queries that are alike in all columns but `key` are one class, called by its least key.

    `contents` has the columns of `queries`, `key` the class; `members` has _class and _keys, arrays of at most BLOCK of the
    class's keys. A key of several rows is alike another that has all of them. Null is a key like others.
    """
    alike = F.struct(*[queries[c] for c in queries.columns if c != key] or [F.lit(0).alias("_none")])
    each = queries.groupBy(queries[key].alias("_key")).agg(F.sort_array(F.collect_list(alike)).alias("_same"))
    keys = F.concat(F.collect_list("_key"), F.array_repeat(F.lit(None).cast(queries.schema[key].dataType), F.count_if(F.col("_key").isNull()).cast("int")))
    known = stored(each.groupBy("_same").agg(F.min("_key").alias("_class"), keys.alias("_keys")), "classes")
    contents = known.select(F.col("_class").alias(key), F.inline("_same")).select(*queries.columns)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("_keys") - 1) / BLOCK).cast("int")), lambda k: F.slice("_keys", k * BLOCK + 1, F.lit(BLOCK)))
    return contents, known.select("_class", F.explode(cut).alias("_keys"))


def spread(rows: DataFrame) -> DataFrame:
    """`rows` over all cores: a small table is read by few tasks, but what is made of it may be large."""
    return rows.repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """`rows`, of which there are `most` at the most, dealt by `keys` in shares of about SHARE, fewer where cores would rest."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(most / SHARE)), *keys)


def to_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """`rows` of each class (`key`) for each key of its members: what is made once for a class is only copied here."""
    rows = spread(rows)
    own = rows.join(F.broadcast(members), rows[key].eqNullSafe(members["_class"]))
    return own.select(F.explode("_keys").alias("_key"), *[rows[c] for c in rows.columns if c != key]).withColumnRenamed("_key", key).select(*rows.columns)


def by_class(rows: DataFrame, queries: DataFrame, key: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """made(queries_in_blocks(rows, queries, key)), which keeps `key` and looks at no key for itself, made once for queries that are alike."""
    contents, members = classes(queries, key)
    return to_members(made(queries_in_blocks(spread(rows), contents, key)), members, key)


def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """`rows` with their number from 1 within `group` by `order`, as column `name`. A group of any size is cut into ranges,
    which are numbered each and moved by the sizes of those before; there are at most as many ranges as partitions and groups."""
    cut = stored(rows.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_size"))
    ahead = F.coalesce(F.sum("_size").over(Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_group", "_of", ahead.alias("_ahead"))
    placed = cut.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)))
    placed = placed.join(F.broadcast(sizes), placed[group].eqNullSafe(sizes["_group"]) & (placed["_range"] == sizes["_of"]))
    return placed.select(*rows.columns, (F.col("_place") + F.col("_ahead")).cast("int").alias(name))


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to 1024 rows and 16 MB, and keeps settings that are smaller."""
    for name, most in (("maxRecordsPerBatch", 1024), ("maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not now or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
