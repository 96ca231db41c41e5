"""Line deduplication: levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without white space at both ends, A-Z lower-cased; keys of at least `LEAST` code points count.
Batches of documents come one after the other. The first batch that has a key, and in it the smallest doc_id, holds the
key; every other document loses all its lines of that key. With batches in ascending order of doc_id, as `in_batches`
makes them, the holder is the smallest doc_id of all.

`LineRuns` keeps the keys so far (two 64-bit hashes and the holder) as runs: tables bucketed and sorted by the hashes.
A batch's keys, grouped with map-side sums, are merge-joined with every run. What has no partner is new and makes up the
batch's own run, on level 0; what has one is held already. Two runs of one level are merged into one of the next before
the next batch comes, so n batches leave at most log n runs and each key is rewritten log n times. As all runs have the
same buckets, neither kind of merge join moves a run: a batch moves its own keys only. Runs are tables written under the
shared folder; a lost executor costs a stage, and a batch that comes again (same doc_ids) gives the same lines.

Keys that more than `MOST` lines of a batch have are salted before they meet the lines; nothing is broadcast but by
Spark's own check of sizes. Which lines go is an array of places for each (doc_id, text), so texts are moved once, at the
end, and long texts are cut in one pass.

Null and empty texts have one empty line, and lose nothing. Rows without a doc_id are one document, after all others.
Rows that repeat an id are one document: they lose the same keys, and none to each other. Texts of any length are split
whole. Other columns, whatever their names, stay in `row`. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import LOWER, UPPER, WHITE, table, work_dir, written
from talweg.llm.neardup import MOST, salted_join

LEAST, BATCHES = 10, 4


def lower_ascii(x: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of ASCII alone take the short way."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def occurrences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, d1 (of the text), pos (from 0), h1 and h2 (of the key) of every line that counts."""
    lines = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(_text(docs)).alias("d1"), F.posexplode(F.split(_text(docs), "\n", -1)).alias("pos", "line"))
    bare = lines.select("doc_id", "d1", "pos", F.btrim("line", F.lit(WHITE)).alias("bare")).where(F.length("bare") >= least)
    keyed = bare.select("doc_id", "d1", "pos", lower_ascii(F.col("bare")).alias("key"))
    return keyed.select("doc_id", "d1", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """The keys of all batches so far, as sorted runs under `path`; `runs` is a list of (level, table), the newest last."""

    def __init__(self, spark: SparkSession, path: str, least: int = LEAST, buckets: int | None = None):
        self.spark, self.path, self.least = spark, path, least
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix, self.made, self.runs, self.drops = f"lines_{uuid.uuid4().hex[:12]}", 0, [], []

    def _stored(self, df: DataFrame, level: int) -> str:
        """The name of `df` as a table in buckets, sorted by the hashes."""
        self.made += 1
        name = f"{self.prefix}_{self.made}"
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/run-{self.made}").saveAsTable(name)
        self.runs.append((level, name))
        return name

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name).where("fresh").select("h1", "h2", "holder")

    def compact(self) -> None:
        """Merges two runs of one level into one of the next, from the lowest level up. A key is in one run only."""
        level = 0
        while level <= max((x for x, _ in self.runs), default=-1):
            two = [name for x, name in self.runs if x == level]
            if len(two) == 2:
                merged = self.run(two[0]).join(self.run(two[1]).withColumnRenamed("holder", "other"), ["h1", "h2"], "full")
                self.runs = [r for r in self.runs if r[0] != level]
                self._stored(merged.select("h1", "h2", F.coalesce("holder", "other").alias("holder"), F.lit(True).alias("fresh")), level + 1)
            level += 1

    def add(self, docs: DataFrame) -> DataFrame:
        """doc_id, d1, dropped (the places of lines that go, ascending) of this batch's texts that lose a line."""
        self.compact()
        lines = occurrences(docs, self.least)
        met = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("nameless"), F.count(F.lit(1)).alias("c"))
        for k, (_, name) in enumerate(self.runs):
            met = met.join(self.run(name).select("h1", "h2", F.struct("holder").alias(f"held{k}")), ["h1", "h2"], "left")
        held = F.coalesce(*[F.col(f"held{k}") for k in range(len(self.runs))]) if self.runs else F.lit(None).cast("struct<holder: bigint>")
        met = met.select("h1", "h2", "first", "last", "nameless", "c", held.isNull().alias("fresh"), F.when(held.isNull(), F.col("first")).otherwise(held["holder"]).alias("holder"))
        holder = F.col("holder")
        shared = ~F.col("first").eqNullSafe(holder) | ~F.col("last").eqNullSafe(holder) | (F.col("nameless") & holder.isNotNull())
        own = self.spark.table(self._stored(met.select("h1", "h2", "holder", "c", "fresh", shared.alias("shared")), 0)).where("shared")
        hot = written(own.where(F.col("c") > MOST).select("h1", "h2", "c"), f"{self.path}/hot-{self.made}")
        found = salted_join(lines, own.select("h1", "h2", "holder"), ["h1", "h2"], ["doc_id", "d1", "pos"], hot)
        drops = found.where(~F.col("doc_id").eqNullSafe(holder)).groupBy("doc_id", "d1").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
        self.drops.append(written(drops, f"{self.path}/drops-{self.made}"))
        return self.drops[-1]

    def close(self) -> None:
        """Takes the tables' names out of the session's catalogue; their files stay."""
        for k in range(1, self.made + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{k}")


def in_batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """`docs` in n or fewer batches of ascending doc_ids, about equal; rows without one come last."""
    of = docs["doc_id"].cast("long")
    cuts = sorted({int(x) for x in docs.select(of.alias("doc_id")).approxQuantile("doc_id", [k / n for k in range(1, n)], 0.01)}) if n > 1 else []
    parts = [(of >= F.lit(a) if a is not None else F.lit(True)) & (of < F.lit(b) if b is not None else F.lit(True)) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]
    parts[-1] = parts[-1] | of.isNull()
    return [docs.where(p) for p in parts]


def without_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """row (all columns of `docs`), n_lines, n_dropped, kept (the text that stays) for every row of `docs`."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), _text(docs).alias("text"), F.xxhash64(_text(docs)).alias("d1"))
    gone = drops.select(F.col("doc_id").alias("id"), F.col("d1").alias("e1"), "dropped")
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("d1") == F.col("e1")), "left")
    split = both.select("row", "text", F.split("text", "\n", -1).alias("lines"), "dropped")
    cuts = split.select("row", "text", "lines", "dropped", F.expr("concat(array(-1), dropped, array(size(lines)))").alias("cuts"))
    kept = F.expr("flatten(transform(sequence(1, size(cuts) - 1), k -> slice(lines, cuts[k - 1] + 2, cuts[k] - cuts[k - 1] - 1)))")
    return cuts.select("row", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"))


def dedup_lines(docs: DataFrame, batches: int = BATCHES, work: str | None = None) -> DataFrame:
    """row, n_lines, n_dropped, kept: `docs` without the lines that a smaller doc_id holds."""
    runs = LineRuns(docs.sparkSession, work or work_dir(docs.sparkSession, "lines"))
    for batch in in_batches(docs, batches):
        runs.add(batch)
    runs.close()
    drops = runs.drops[0]
    for more in runs.drops[1:]:
        drops = drops.unionByName(more)
    return without_lines(docs, drops)


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that another document of a smaller id holds."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    """The same rows in DuckDB's SQL."""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    each AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
    keyed AS (SELECT *, translate(trim(line, {white}), '{UPPER}', '{LOWER}') AS key FROM each),
    held AS (SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -1)) > 1),
    marked AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id IS DISTINCT FROM h.holder AS gone FROM keyed k LEFT JOIN held h ON k.key = h.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY rid, doc_id"""
