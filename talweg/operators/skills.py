"""Lists of skills out of free items: slashes that part and slashes that belong to a name, then one canonical name each.

An item is cut at commas and semicolons. A slash parts unless both sides touch it, and then by the two words that do:
a dictionary that knows them joined by the slash keeps it; one that knows each of them cuts; two acronyms (one to five
characters, no small letter, a letter or digit) keep it; else it parts. What was kept joined is one word for the next
slash. Of the pieces those of two characters or more stay; each takes the name that the dictionary has for its spelling
(case and white space aside), and of names that are alike but for case and accents the first stays.

The dictionary (alias, name; a name is an alias of itself) may have any size: words meet it in joins. Each distinct
segment with a slash is looked at once, however often it stands in the table, and no word longer than the longest alias
is asked for. Rows of equal items share one result; a list is bounded by its row.

Null items and empty ones give nothing, a null or empty list an empty one; rows that repeat stay; of an alias with several
names the smallest counts. An empty table gives no rows, an empty dictionary knows nothing.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.labels import canonical, compact_key, label_key
from talweg.functions.text import fold
from talweg.operators.blocks import bounded_batches
from talweg.sources.tables import stored

ACRONYM, SALTS = 5, 8


def spelling(c: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def acronym(word: str) -> bool:
    return 0 < len(word) <= ACRONYM and not any(c.islower() for c in word) and any(c.isalnum() for c in word)


def asked_words(segment: str, longest: int) -> set[str]:
    """All words, joined or not, that the cutting of this segment may ask a dictionary about."""
    out: set[str] = set()
    for chain in segment.split():
        parts = chain.split("/")
        for i in range(len(parts) if len(parts) > 1 else 0):
            joined = parts[i]
            for j in range(i + 1, len(parts) + 1):
                if not joined or len(joined) > longest:
                    break
                out.add(joined)
                joined = joined + "/" + parts[j] if j < len(parts) and parts[j] else ""
    return out


def cut(segment: str, known: Collection[str]) -> list[str]:
    """The pieces of a segment."""
    done: list[str] = []
    run: list[str] = []  # what is kept together so far, joined when it ends
    word = ""  # the word that touches the next slash
    for right in segment.split("/"):
        first = right.split(maxsplit=1)[0] if right and not right[0].isspace() else ""
        if run and word and first and (f"{word}/{first}" in known or (not (word in known and first in known) and acronym(word) and acronym(first))):
            run.append(right)
            word = f"{word}/{first}" if right == first else _last(right)
        else:
            if run:
                done.append("/".join(run))
            run, word = [right], _last(right)
    return [*done, "/".join(run)]


def _last(text: str) -> str:
    return text.rsplit(maxsplit=1)[-1] if text and not text[-1].isspace() else ""


def _keys(c: Column) -> Column:
    """The spellings under which a word is looked up, each with its kind."""
    compact = compact_key(c)
    named = lambda kind, key: F.concat(F.lit(kind), key)
    return F.array_compact(F.array(named("s", spelling(c)), named("l", label_key(c)), F.when(F.length(compact) >= 3, named("c", compact))))


def _in_arrow(df: DataFrame, each, column: str) -> DataFrame:
    """segment and `column`, the list that `each` gives for a row."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([each(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.list_(pa.string()))], names=["segment", column])

    return df.mapInArrow(over, f"segment string, {column} array<string>")


def _pieces(segments: DataFrame, names: DataFrame) -> DataFrame:
    """segment, pieces of each distinct segment with a slash."""
    longest = names.agg(F.max(F.length("alias"))).first()[0] or 0
    asked = _in_arrow(segments, lambda s: sorted(asked_words(s, longest)), "words").select("segment", F.explode("words").alias("word"))
    keys = names.select(F.explode(_keys(F.col("alias"))).alias("key")).distinct()
    found = asked.select("segment", "word", F.explode(_keys(F.col("word"))).alias("key")).join(keys, "key", "left_semi")
    known = found.groupBy("segment").agg(F.collect_set("word").alias("known"))
    return _in_arrow(segments.join(known, "segment", "left"), lambda s, k: cut(s, frozenset(k or ())), "pieces")


def flat_skills(df: DataFrame, items: str, dictionary: DataFrame) -> DataFrame:
    """The columns of `df` and, after them, skills: the list made of `items` (array of strings)."""
    bounded_batches(df.sparkSession)
    given = dictionary.select(F.trim(dictionary["alias"].cast("string")).alias("alias"), F.trim(dictionary["name"].cast("string")).alias("name"))
    names = given.unionAll(given.select(F.col("name").alias("alias"), "name")).where("alias <> '' AND name <> ''")
    named = names.groupBy(spelling(F.col("alias")).alias("spelt")).agg(F.min("name").alias("name"))
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[items].cast("array<string>").alias("items"))
    lists = packed.select("items").where("size(items) > 0").distinct()
    cells = F.flatten(F.transform(F.filter("items", lambda x: x.isNotNull()), lambda x: F.split(x, "[,;]")))
    segments = stored(lists.select("items", F.posexplode(cells).alias("at", "segment")), "skills")
    cuts = _pieces(segments.where("contains(segment, '/')").select("segment").distinct(), names)
    salted = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    parted = segments.withColumn("salt", F.expr(f"pmod(xxhash64(items), {SALTS})")).join(salted, ["segment", "salt"], "left")
    pieces = parted.select("items", "at", F.posexplode(F.coalesce("pieces", F.array("segment"))).alias("nth", "piece"))
    pieces = pieces.select("items", "at", "nth", F.regexp_replace("piece", r"(?U)^\s+|\s+\z", "").alias("piece")).where("length(piece) > 1")
    told = pieces.withColumn("spelt", spelling(F.col("piece"))).join(named, "spelt", "left").select("items", "at", "nth", F.coalesce("name", "piece").alias("skill"))
    first = told.groupBy("items", F.lower(fold(F.col("skill"))).alias("alike")).agg(F.min(F.struct("at", "nth", "skill")).alias("one"))
    made = first.groupBy("items").agg(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["skill"]).alias("skills"))
    done = packed.join(made, packed["items"].eqNullSafe(made["items"]), "left")
    return done.select(*[F.col("row")[c].alias(c) for c in df.columns if c != "skills"], F.coalesce("skills", F.expr("array()").cast("array<string>")).alias("skills"))


def by_category(terms: DataFrame, key: str, at: str, term: str, dictionary: DataFrame, order: list[str], rest: str) -> DataFrame:
    """key and groups: for each key its terms under the categories of their names, array of (category, items).

    Terms are looked up as `functions.labels.canonical` does in `dictionary` (alias, name, category); categories stand in
    `order` and have their names once each, by the smallest `at`; terms without a name, or of a category that is not in
    `order`, end in `rest`, once each but for case. Categories without items are left out; null and blank terms are none,
    and a key with nothing else has no row. Each distinct term is looked up once, however many rows have it.
    """
    shown = F.trim(F.regexp_replace(terms[term].cast("string"), r"(?U)\s+", " "))
    own = terms.select(terms[key].alias("key"), terms[at].alias("at"), shown.alias("term")).where("term <> ''").groupBy("key", "term").agg(F.min("at").alias("at"))
    known = dictionary.where(F.col("category").isin(order)).select("alias", F.struct("name", "category").alias("entry"))
    looked = canonical(own.select("term").distinct(), "term", known, "alias", "entry").select("term", F.col("canonical.name").alias("name"), F.col("canonical.category").alias("category"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("category")), F.lit(len(order) + 1)).cast("int")
    named = own.join(looked, "term").select("key", "at", rank.alias("rank"), F.coalesce("name", "term").alias("item"), F.coalesce("name", F.lower("term")).alias("alike"))
    once = named.groupBy("key", "rank", "alike").agg(F.min(F.struct("at", "item")).alias("one"))
    groups = once.groupBy("key", "rank").agg(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["item"]).alias("items"))
    sorted_ = F.array_sort(F.collect_list(F.struct("rank", "items")))
    label = F.array(*map(F.lit, [*order, rest]))
    return groups.groupBy("key").agg(F.transform(sorted_, lambda g: F.struct(F.element_at(label, g["rank"]).alias("category"), g["items"].alias("items"))).alias("groups")).withColumnRenamed("key", key)
