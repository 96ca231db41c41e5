"""Personal data in the parts of one whole: paragraphs of a document, turns of a conversation.

What each part shows by itself is found as `talweg.operators.pii` finds it, with the rule of the header line in the parts
numbered below `header`, and with a table of first names of any size. The words of its identities and e-mail names are
then known to the whole: they are looked for in the same part and in all parts of the same or a higher number. A part
without a whole or a number keeps its words to itself.

Nothing of a whole is gathered in one place. Known words are rows (whole, word, first part), aggregated before their
shuffle; each part's own words meet them, and the first names, in equi-joins whose keys hold the word and a salt, so that
a whole with a third of all parts is met word by word in `SALTS` places each. Only parts of wholes that know a word take
part. A part gets the words that it holds, no others, so its set is bounded by its text. What was found, what is known and
what is held are tables written in the shared folder, and read again.

Null and empty texts have no detection and stay as they are; rows that repeat have their detections repeated; an empty
table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg.operators import pii
from talweg.operators.blocks import bounded_batches
from talweg.sources.tables import stored

SALTS, AROUND, HEADER = 8, 28, 4
_SPANS = "array<struct<type: string, start: int, end: int>>"
_PLACE = [("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
_SALT = f"pmod(h, {SALTS}) AS salt"


def _folded(c: Column) -> Column:
    """`pii.plain` in the JVM."""
    return F.translate(F.lower(c), pii.MARKED, pii.BARE)


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _sets(own: DataFrame, name: str) -> DataFrame:
    """The set of the words that `own` (g, p, h, w) has for each row."""
    return own.groupBy(*(F.col(c).alias(f"{c}_") for c in "gph")).agg(F.collect_set("w").alias(name))


def _with_words(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """`rows` with their set, null without any."""
    same = [rows[c].eqNullSafe(sets[f"{c}_"]) for c in "gph"]
    return rows.join(sets, same, "left").drop("g_", "p_", "h_")


def _named(rows: DataFrame, first_names: DataFrame) -> DataFrame:
    """`rows` with `names`, the first names among each one's capitalised words."""
    called = _salted(first_names.select(_folded(first_names[first_names.columns[0]].cast("string")).alias("w")).where("w <> ''").distinct())
    words = F.split(_folded(F.array_join(F.regexp_extract_all("t", F.lit(pii.CAPITALISED), F.lit(0)), "-")), "-")
    return _with_words(rows, _sets(rows.select("g", "p", "h", F.expr(_SALT), F.explode(F.array_distinct(words)).alias("w")).join(called, ["w", "salt"]), "names"))


def _shown(rows: DataFrame, header: int) -> DataFrame:
    """`rows` with spans, what shows by itself, and known, the words by which the persons in them may be named elsewhere."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, known = [], []
            for part, text, names in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4)), strict=True):
                found = pii.shown(text, frozenset(names or ()), part is not None and part < header).spans if text else []
                spans.append([{"type": k, "start": a, "end": b} for k, a, b in found])
                known.append(sorted(pii.known_words(text, found)) if found else [])
            kept = [batch.column(i) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, pa.list_(pa.struct(_PLACE))), pa.array(known, pa.list_(pa.string()))], names=["g", "p", "t", "h", "spans", "known"])

    own = rows.select("g", "p", "t", "h", "names")
    return own.mapInArrow(over, T.StructType([*own.schema.fields[:4], *T.StructType.fromDDL(f"spans {_SPANS}, known array<string>").fields]))


def _told(found: DataFrame) -> DataFrame:
    """`found` with `words`, those that its whole knows by then and the text holds. What is known and what is held are tables of
    their own: where they are small, Spark knows it beforehand, and the texts aren't shuffled to meet them."""
    known = found.where("g IS NOT NULL AND p IS NOT NULL").select("g", "p", F.explode("known").alias("w")).groupBy("g", "w").agg(F.min("p").alias("since"))
    known = stored(known.withColumn("k", F.regexp_extract("w", "^[a-z]+(?:['’-][a-z]+)?", 0)), "known")
    low = _folded(F.col("t"))
    runs = F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w.rlike("^[a-z]+$"))
    twos = F.regexp_extract_all(low, F.lit("(?<![a-z0-9])(?=([a-z]+['’-][a-z]+))"), F.lit(1))
    held = found.join(known.select("g").distinct(), "g", "left_semi").select("g", "p", "h", F.expr(_SALT), F.explode(F.array_distinct(F.concat(runs, twos))).alias("k"))
    return _with_words(found, stored(_sets(held.join(_salted(known), ["g", "k", "salt"]).where("since <= p").select("g", "p", "h", "w"), "words"), "held"))


def detected(parts: DataFrame, group: str, part: str, text: str, first_names: DataFrame | None = None, header: int = HEADER) -> DataFrame:
    """group, part, detections (type, start, end, and the stretch with `AROUND` characters on either side), masked: a row per row of `parts`.

    The first column of `first_names` has names in any case; without it the rule of first names rests."""
    bounded_batches(parts.sparkSession)
    rows = parts.select(parts[group].alias("g"), parts[part].cast("long").alias("p"), parts[text].cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    named = rows.withColumn("names", F.lit(None).cast("array<string>")) if first_names is None else _named(rows, first_names)
    told = _told(stored(_shown(named, header), "parts"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, masked = [], []
            for t, spans, known, words in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                taken = pii.Taken()
                for s in spans:
                    taken.put(s["type"], s["start"], s["end"])
                for a, b in pii.elsewhere(t, {*known, *(words or ())}) if t else ():
                    taken.put("identite", a, b)
                near = lambda a, b: f"…{t[max(0, a - AROUND) : a]}❰{t[a:b]}❱{t[b : b + AROUND]}…"  # noqa: B023, E731
                out.append([{"type": k, "start": a, "end": b, "context": near(a, b)} for k, a, b in taken.spans])
                masked.append(pii.mask(t, taken.spans) if taken.spans else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([*_PLACE, ("context", pa.string())]))), pa.array(masked, pa.string())], names=[group, part, "detections", "masked"])

    # Only texts with something in them go to Python.
    own, plain = told.select("g", "p", "t", "spans", "known", "words"), F.expr("words IS NULL AND size(spans) = 0")
    fields = [T.StructField(n, own.schema[c].dataType) for n, c in ((group, "g"), (part, "p"))]
    more = T.StructType.fromDDL("detections array<struct<type: string, start: int, end: int, context: string>>, masked string").fields
    rest = own.where(plain).select(F.col("g").alias(group), F.col("p").alias(part), F.array().cast(more[0].dataType).alias("detections"), F.col("t").alias("masked"))
    return own.where(~plain).mapInArrow(over, T.StructType([*fields, *more])).unionAll(rest)
