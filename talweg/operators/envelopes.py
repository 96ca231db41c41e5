"""Nested records whose leaves are envelopes {value, confidence, evidence_ids}: their plain values, their confidences and
evidence by dotted path, and paths that follow the rows of a reordered list.

Records are variants of any depth. Each round opens one level of all records at once with variant_explode, until nothing
is left to open, so the number of jobs is the greatest depth and no record is held whole by Python. What a round leaves is
a table written in the shared folder. Paths are `contact.email`, `experience[0].title`.

An object is an envelope if it has `value` and one of MARKERS. Null records and text that isn't JSON have no rows; a JSON
null is a value, and so are an empty object and an empty list. Envelopes within an envelope of the same path count last. A
confidence counts if it is a number, evidence if it is a list, of which texts that aren't empty stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.sources.tables import stored

#: What makes an object with `value` an envelope.
MARKERS = ("confidence", "evidence_ids", "model_confidence", "model_logprob")
_NUMBER = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _opened(nodes: DataFrame) -> DataFrame:
    """The nodes with kind: envelope, object, list or value."""
    has = lambda name: F.try_variant_get("v", f"$.{name}", "variant").isNotNull()
    envelope = has("value") & reduce(lambda a, b: a | b, map(has, MARKERS))
    shape = F.col("shape")
    empty = shape.isin("OBJECT<>", "ARRAY<VOID>") & F.to_json("v").isin("{}", "[]")
    nodes = nodes.withColumn("shape", F.schema_of_variant("v"))
    return nodes.withColumn("kind", F.when(empty, "value").when(shape.startswith("OBJECT"), F.when(envelope, "envelope").otherwise("object")).when(shape.startswith("ARRAY"), "list").otherwise("value")).drop("shape")


def flattened(records: DataFrame, key: str, record: Column) -> tuple[DataFrame, DataFrame]:
    """(values, marks): key, path, value (as text; null for a JSON null), and key, path, confidence, evidence."""
    name = F.col(key).alias("k")
    level = stored(_opened(records.select(name, F.lit("").alias("path"), F.lit(0).alias("depth"), record.alias("v")).where("v is not null")), "level-0")
    values, marks, depth = [], [], 0
    while not level.isEmpty():
        values.append(level.where("kind = 'value'").select("k", "path", F.to_json("v").alias("json"), F.col("v").cast("string").alias("value")))
        marks.append(level.where("kind = 'envelope'").select("k", "path", "depth", *(F.try_variant_get("v", f"$.{m}", "variant").alias(m) for m in MARKERS[:2])))
        depth += 1
        inner = level.where("kind = 'envelope'").select("k", "path", F.lit(depth).alias("depth"), F.try_variant_get("v", "$.value", "variant").alias("v"))
        inner = inner.withColumn("v", F.coalesce("v", F.parse_json(F.lit("null"))))
        outer = level.where("kind in ('object', 'list')")
        children = outer.lateralJoin(outer.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "child"))
        path = F.when(F.col("kind") == "list", F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        children = children.select("k", path.alias("path"), F.lit(depth).alias("depth"), F.col("child").alias("v"))
        level = stored(_opened(inner.unionByName(children)), f"level-{depth}")
    none = level.select("k", "path", F.lit("").alias("json"), F.lit("").alias("value")).where("false")
    all_values, all_marks = none, level.select("k", "path", "depth", *(F.col("v").alias(m) for m in MARKERS[:2])).where("false")
    for one in values:
        all_values = all_values.unionByName(one)
    for one in marks:
        all_marks = all_marks.unionByName(one)
    plain = F.when(F.col("json") == "null", None).otherwise(F.coalesce("value", "json"))
    sure = F.when(F.schema_of_variant("confidence").rlike(_NUMBER), F.col("confidence").cast("double"))
    listed = F.filter(F.try_variant_get("evidence_ids", "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    texts = F.filter(F.transform(listed, lambda x: x.cast("string")), lambda x: x != "")
    told = all_marks.where("path != ''").select("k", "path", "depth", sure.alias("confidence"), F.when(F.size(texts) > 0, texts).alias("evidence"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c)
    told = told.groupBy("k", "path").agg(last("confidence"), last("evidence")).where("confidence is not null or evidence is not null")
    return all_values.select(F.col("k").alias(key), "path", plain.alias("value")), told.withColumnRenamed("k", key)


def positions(items: DataFrame, key: str, list_path: str, old: str, order: list[Column]) -> DataFrame:
    """key, list, old, new: where each item of a record's list stands after the list was put in `order` (then as before)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(*order, F.col(old))) - 1
    return items.select(F.col(key), F.lit(list_path).alias("list"), F.col(old).cast("int").alias("old"), place.alias("new"))


def moved(paths: DataFrame, key: str, path: str, moves: DataFrame) -> DataFrame:
    """`paths` (row: all its columns) with to, the path after `moves` (key, list, old, new): every index of a path is looked up.

    A list that `moves` doesn't have for that record keeps its indices; one that it has, but not the index, makes the path
    fall away (no row). Lists within lists are named by their path before the move (`experience[0].items`).
    """
    every = F.regexp_extract_all(F.col(path), F.lit(r"([^\[]*)\[(\d+)\]"), F.lit(0))
    rows = paths.select(F.struct(*[paths[c] for c in paths.columns]).alias("row"), F.col(key).alias("k"), every.alias("steps"), F.regexp_extract(path, r"([^\]]*)$", 1).alias("rest"))
    plain = rows.where(F.size("steps") == 0).select("row", F.col(f"row.{path}").alias("to"))
    steps = rows.where(F.size("steps") > 0).withColumn("id", F.xxhash64("k", f"row.{path}")).select("row", "k", "rest", "steps", F.posexplode("steps").alias("n", "step"))
    before = F.array_join(F.slice("steps", F.lit(1), F.col("n")), "")
    steps = steps.select("row", "k", "rest", "n", F.regexp_extract("step", r"^([^\[]*)\[", 1).alias("name"), F.regexp_extract("step", r"\[(\d+)\]$", 1).cast("int").alias("old"), before.alias("before"))
    lists = moves.select(F.col(key).alias("k"), "list").distinct().withColumn("known", F.lit(True))
    looked = steps.withColumn("list", F.concat("before", "name")).join(lists, ["k", "list"], "left").join(moves.select(F.col(key).alias("k"), "list", "old", "new"), ["k", "list", "old"], "left")
    new = F.when(F.col("known"), F.col("new")).otherwise(F.col("old"))
    parts = looked.groupBy("row", "rest").agg(F.sort_array(F.collect_set(F.struct("n", F.concat("name", F.lit("["), new.cast("string"), F.lit("]")).alias("part")))).alias("parts"))
    whole = parts.where(~F.exists("parts", lambda p: p["part"].isNull()))
    return plain.union(whole.select("row", F.concat(F.array_join(F.transform("parts", lambda p: p["part"]), ""), F.col("rest"))))
