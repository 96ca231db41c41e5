"""Merkle manifest of a dataset: ordered blocks of leaves, collapsed by higher-order SQL functions, then their roots.

A row's leaf is the hash (lowercase hex SHA-256) of its fields, each `-` if null, else its length in bytes, `:` and its
value. Leaves of one lang stand in the order of doc_id (null first), equal ids in that of their leaves. While a level has
more than one node, each `RUN` consecutive ones become the hash of their concatenation; the last run may be shorter, even
one. What remains is the subroot of the lang; subroots in the order of lang (null first, bytewise) make the root alike.

Places in the order come from a range partitioning, written with each row's place in its partition, and prefix sums over
the partitions, so no group is sorted or numbered in one task. `BLOCK` = RUN^3 consecutive nodes are one array: `transform`
over a `sequence` of runs, with `slice` for the run, collapses three levels at once without moving a row. The blocks'
roots are the next round's nodes, until one is left; a table of n rows takes log n / log 512 rounds, of which each is
smaller by 512. The way down joins each block with the path above it (at most seven siblings a level), and the last step
makes proofs and folds them in generated rows, beside the block that they come from. Texts are hashed where they are read
and never moved. Only the one root comes to the driver; all else is written, so that a lost executor costs a stage.

Null fields are `-`, empty texts `0:`; rows that repeat an id or are equal are leaves of their own, one beside the other;
a lang of one row has its leaf as subroot, and a table of one lang its subroot as root. Proofs without siblings are the
hash of nothing. Texts of any length are hashed whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talweg.llm.common import LOWER, UPPER, table, work_dir, written
from talweg.llm.linededup import lower_ascii

RUN, LEVELS = 8, 3
BLOCK = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<l: string, r: string>>"


def leaf_of(values: list[Column]) -> Column:
    """The hash of the values in their order."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def group_of(c: Column) -> Column:
    """A value as the name of its group; names sort as the values do, null first."""
    return F.when(c.isNull(), "0").otherwise(F.concat(F.lit("1"), c))


def placed(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """`rows` (with g) and pos, their place in the order within g from 0, and total, how many g has."""
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    dealt = written(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), f"{path}/dealt")
    parts = dealt.groupBy("g", "part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("lo"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.select("g", "part", "lo", before.alias("before"), F.sum("c").over(W.partitionBy("g")).alias("total")), f"{path}/parts")
    return dealt.join(parts, ["g", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("lo")).drop("part", "at", "lo", "before")


def blocks_of(nodes: DataFrame, payload: list[str], path: str) -> DataFrame:
    """g, block, more (whether g has other blocks), nodes: arrays of BLOCK consecutive nodes (pos, node, payload)."""
    grouped = nodes.groupBy("g", (F.floor(F.col("pos") / BLOCK)).cast("long").alias("block"), (F.col("total") > BLOCK).alias("more"), F.ceil(F.col("total") / BLOCK).alias("blocks"))
    return written(grouped.agg(F.sort_array(F.collect_list(F.struct("pos", "node", *payload))).alias("nodes")), path)


def levels(blocks: DataFrame) -> DataFrame:
    """`blocks` and l0 to l3, its levels of nodes; a level of one node stays as it is if it is the whole group's."""
    out = blocks.withColumn("l0", F.expr("transform(nodes, x -> x.node)"))
    for k in range(LEVELS):
        runs = f"transform(sequence(0, (size(l{k}) - 1) div {RUN}), j -> sha2(array_join(slice(l{k}, j * {RUN} + 1, {RUN}), ''), 256))"
        out = out.withColumn(f"l{k + 1}", F.expr(f"if(more or size(l{k}) > 1, {runs}, l{k})"))
    return out


def path_in_block(i: str) -> str:
    """The siblings of the node at place i (from 0) of its block: left and right of it, for each level that is collapsed."""
    steps = []
    for k in range(LEVELS):
        own = f"cast({i} div {RUN**k} as int)"
        left = f"array_join(slice(l{k}, ({own} div {RUN}) * {RUN} + 1, {own} % {RUN}), '')"
        right = f"array_join(slice(l{k}, {own} + 2, {RUN - 1} - {own} % {RUN}), '')"
        steps.append(f"if(more or size(l{k}) > 1, struct({left} as l, {right} as r), null)")
    return f"array_compact(array({', '.join(steps)}))"


def collapsed(nodes: DataFrame, payload: list[str], work: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, the lowest first, and g, node: the last node of each group."""
    rounds = []
    while True:
        rounds.append(blocks_of(nodes, payload if not rounds else [], f"{work}/round-{len(rounds)}"))
        roots = levels(rounds[-1]).select("g", F.col("block").alias("pos"), F.col("blocks").alias("total"), F.expr(f"l{LEVELS}[0]").alias("node"))
        if rounds[-1].where("more").isEmpty():
            return rounds, roots.select("g", "node")
        nodes = written(roots, f"{work}/roots-{len(rounds)}")


def paths(rounds: list[DataFrame], above: DataFrame, work: str) -> DataFrame:
    """The blocks of the lowest round with their levels and `up`, the path of the block's root; `above` has g and up of each group's."""
    ways = above.select("g", F.lit(0).cast("long").alias("block"), "up")
    for k in range(len(rounds) - 1, 0, -1):
        both = levels(rounds[k].join(ways, ["g", "block"]))
        one = both.select("g", "more", "up", *[f"l{j}" for j in range(LEVELS)], F.posexplode("nodes").alias("i", "x"))
        ways = written(one.select("g", F.col("x.pos").alias("block"), F.expr(f"concat({path_in_block('i')}, up)").alias("up")), f"{work}/ways-{k}")
    return levels(rounds[0].join(ways, ["g", "block"]))


def folded(leaf: str, path: str) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.expr(f"aggregate({path}, {leaf}, (own, x) -> sha2(concat(x.l, own, x.r), 256))")


def manifest(rows: DataFrame, work: str | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for rows of g, doc_id, leaf and claimed.

    `claimed` is the leaf that is to be verified against the tree: folded_root is the root that it gives with the siblings
    of `leaf`. proof_sha256 is the hash of the siblings, level by level, each from left to right.
    """
    work = work or work_dir(rows.sparkSession, "merkle")
    placed_rows = placed(rows.select("g", "doc_id", "leaf", "claimed"), ["doc_id", "leaf"], f"{work}/leaves").withColumnRenamed("leaf", "node")
    rounds, subroots = collapsed(placed_rows, ["doc_id", "claimed"], f"{work}/tree")
    subroots = written(subroots, f"{work}/subroots")
    tops = placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "node"), ["name"], f"{work}/names")
    top_rounds, top = collapsed(tops, ["name"], f"{work}/top")
    found = top.head()
    root = F.lit(found.node if found else None).cast("string")
    above = paths(top_rounds, rows.sparkSession.createDataFrame([("", [])], f"g string, up {_PATH}"), f"{work}/top-down")
    named = above.select("more", "up", *[f"l{j}" for j in range(LEVELS)], F.posexplode("nodes").alias("i", "x"))
    named = written(named.select(F.col("x.name").alias("g"), F.col("x.node").alias("subroot"), F.expr(f"concat({path_in_block('i')}, up)").alias("up")), f"{work}/above")
    low = paths(rounds, named.select("g", "up"), f"{work}/down").join(named.select("g", "subroot"), "g")
    each = low.select("subroot", "more", "up", *[f"l{j}" for j in range(LEVELS)], F.posexplode("nodes").alias("i", "x"))
    each = each.select("subroot", F.col("x.doc_id").alias("doc_id"), F.col("x.node").alias("leaf"), F.col("x.claimed").alias("claimed"), F.expr(f"concat({path_in_block('i')}, up)").alias("path"))
    proof = F.expr("sha2(array_join(transform(path, x -> concat(x.l, x.r)), ''), 256)")
    out = each.select("doc_id", "leaf", "subroot", root.alias("root"), proof.alias("proof_sha256"), folded("claimed", "path").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """g (of the lang), doc_id, leaf, claimed: the leaf of each row, and of its text in lower case (A-Z) where `tampered` says so."""
    fields = [docs[c] for c in FIELDS]
    leaf = leaf_of(fields)
    other = leaf_of([*fields[:-1], lower_ascii(docs["text"].cast("string"))])
    claimed = leaf if tampered is None else F.when(tampered, other).otherwise(leaf)
    return docs.select(group_of(docs["lang"].cast("string")).alias("g"), docs["doc_id"].cast("long").alias("doc_id"), leaf.alias("leaf"), claimed.alias("claimed"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, verified after every third one (by the crc32 of its id) was tampered with."""
    docs = table(spark, sf_dir, "documents")
    return manifest(leaves(docs, F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0, F.lit(False))))


def oracle(deep: int = 8, wide: int = 3) -> str:
    """The same rows in DuckDB's SQL, for up to 8^deep documents of a lang and 8^wide langs: one level after the other."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in (*FIELDS[:-1], text)) + ")"
    bits = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {bits}))"
    parts = [
        f"docs AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS f FROM documents)",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs)",
        "n0 AS (SELECT g, pos, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
    ]

    def tree(name: str, depth: int) -> None:
        for k in range(depth):
            side = lambda rows: f"coalesce(string_agg(node, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN {rows}), '')"
            parts.append(f"{name}s{k} AS (SELECT g, pos, n, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT g, pos // 8 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node, (n + 7) // 8 AS n FROM {name}{k} GROUP BY g, pos // 8, n)")

    tree("n", deep)
    parts.append(f"t0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, node, count(*) OVER () AS n, g AS name FROM n{deep})")
    tree("t", wide)
    step = lambda k, name, key, was: f"f{name}{k} AS (SELECT f.* EXCLUDE (f, proof), CASE WHEN s.n > 1 THEN sha256(s.l || f.f || s.r) ELSE f.f END AS f, f.proof || s.l || s.r AS proof FROM {was} f JOIN {name}s{k} s ON {key} AND s.pos = f.pos // {8**k})"
    was = "f0"
    parts.append("f0 AS (SELECT *, '' AS proof FROM leaves)")
    for k in range(deep):
        parts.append(step(k, "n", "s.g = f.g", was))
        was = f"fn{k}"
    parts.append(f"ft AS (SELECT f.* EXCLUDE (pos), t0.pos, t0.node AS subroot FROM {was} f JOIN t0 ON t0.name = f.g)")
    was = "ft"
    for k in range(wide):
        parts.append(step(k, "t", "true", was))
        was = f"ft{k}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, t.node AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.node AS verified FROM {was}, t{wide} t"
