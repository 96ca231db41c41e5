"""Keyed stores as DataFrame transformations: lookups, upserts, mirrors, soft deletes.

Nulls: a null key is never found and never updated; it is kept by deletes, which remove only rows whose key matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; the comparison reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def lookup_ignoring_case(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.lower(key) == value.lower())


def exists(df: DataFrame, condition: Column) -> DataFrame:
    """One row: whether any row meets the condition."""
    return df.where(condition).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def latest_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.row_number().over(w).alias("rank")).where("rank = 1").select("row.*")


def newest(df: DataFrame, order: Sequence[Column], limit: int | None = None, leave_out: Sequence[str] = ()) -> DataFrame:
    """A listing, newest first, without some columns."""
    out = df.drop(*leave_out).orderBy(*order)
    return out if limit is None else out.limit(limit)


def matching(df: DataFrame, **given) -> DataFrame:
    """Rows equal in all columns for which a value is given; None asks for nothing."""
    conditions = [F.col(k) == F.lit(v) for k, v in given.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def upsert(old: DataFrame, new: DataFrame, key: str, created: str) -> DataFrame:
    """`new` replaces rows of `old` of the same key, whose creation time stays."""
    o, n = old.alias("o"), new.alias("n")
    is_new = F.col(f"n.{key}").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in (key, created) else F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*[pick(c).alias(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old`, and the rows of `new` with keys that `old` lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def mirror_plan(old: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """What makes `old` equal to `wanted`: key and action (delete, insert, update, keep)."""
    whole = lambda df: df.select(F.col(key), F.struct(*sorted(df.columns)).alias("h"))
    o, w = whole(old).alias("o"), whole(wanted).alias("w")
    action = F.when(F.col(f"w.{key}").isNull(), "delete").when(F.col(f"o.{key}").isNull(), "insert").when(~F.col("o.h").eqNullSafe(F.col("w.h")), "update").otherwise("keep")
    return o.join(w, F.col(f"o.{key}") == F.col(f"w.{key}"), "full").select(F.coalesce(f"o.{key}", f"w.{key}").alias(key), action.alias("action"))


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in `new` go, the rows of `new` come."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def patch(df: DataFrame, which: Column, changes: dict[str, Column], allowed: Sequence[str]) -> DataFrame:
    """Changes to allowed columns alone, cast to their types."""
    kept = {c: v for c, v in changes.items() if c in allowed and c in df.columns}
    return df.withColumns({c: F.when(which, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in kept.items()})


#: Times in payloads with all their digits.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def soft_delete(df: DataFrame, which: Column, kind: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and the bin's rows: kind, payload (the whole row as JSON), deleted_at."""
    gone = F.coalesce(which, F.lit(False))
    payload = F.to_json(F.struct(*df.columns), _EXACT)
    return df.where(~gone), df.where(gone).select(F.lit(kind).alias("kind"), payload.alias("payload"), at.alias("deleted_at"))


def restore(kept: DataFrame, binned: DataFrame, kind: str) -> DataFrame:
    """`kept` and the rows of this kind out of the bin."""
    back = binned.where(F.col("kind") == kind).select(F.from_json("payload", kept.schema, _EXACT).alias("row")).select("row.*")
    return kept.unionByName(back)


def with_content_id(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows once each, with an id made of their content: loading twice changes nothing. Each value goes in with its length, a
    null as a mark, so that no two contents run into one another."""
    text = lambda c: F.col(c).cast("string")
    own = lambda c: F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-"))
    key = F.sha2(F.concat(*map(own, sorted(columns))), 256)
    return df.withColumn("content_id", key).dropDuplicates(["content_id"])


def delete(df: DataFrame, which: Column) -> DataFrame:
    return df.where(~F.coalesce(which, F.lit(False)))


def reconcile(**counted: DataFrame) -> DataFrame:
    """name and number of rows of each table, in one row per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name, df in counted.items()]
    return reduce(DataFrame.unionByName, parts)
