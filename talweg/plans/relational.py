"""Filters, projections, joins, aggregates, windows, orders and set operations over the supplied tables.

Moments that the original takes from the clock are parameters here: NOW.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from talweg.operators import intervals, store
from talweg.operators.blocks import by_class, dealt
from talweg.plans.registry import query
from talweg.sources.tables import table

_C = F.col
NOW = "2001-08-01"

# --- filters -----------------------------------------------------------------------------------------------------


@query(
    "flt_01_record_search",
    "SELECT p_partkey FROM part WHERE (contains(lower(p_name), 're') OR contains(lower(p_brand), 're')) AND list_bool_and(list_transform(['r', 'e'], lambda t: contains(lower(p_name), t))) AND contains(lower(p_type), 'o') AND p_size >= 3 AND p_size BETWEEN 6 AND 9",
)
def _(spark, d):
    """Conjunction of optional filters: text, all terms, place, minimum and band (senior: 6 to 9)."""
    q, terms, place, least, band = "re", ["r", "e"], "O", 3, (6, 9)
    text = F.lower("p_name").contains(q) | F.lower("p_brand").contains(q)
    every = F.forall(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower("p_name"), t))
    return table(spark, d, "part").where(text & every & F.lower("p_type").contains(place.lower()) & (_C("p_size") >= least) & _C("p_size").between(*band)).select("p_partkey")


@query("flt_02_optional_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey = 7")
def _(spark, d):
    return store.matching(table(spark, d, "orders"), o_orderstatus="P", o_custkey=7, o_orderpriority=None).select("o_orderkey")


@query("flt_03_free_text", "SELECT conv_id, turn FROM conversations WHERE contains(lower(role || ' ' || text), 'ation')")
def _(spark, d):
    """Text search over a whole record; fewer than three characters find everything."""
    q = "ation"
    found = F.contains(F.lower(F.concat_ws(" ", "role", "text")), F.lit(q)) if len(q) >= 3 else F.lit(True)
    return table(spark, d, "conversations").where(found).select("conv_id", "turn")


@query("flt_03b_free_text_short", "SELECT conv_id, turn FROM conversations")
def _(spark, d):
    q = "at"
    found = F.contains(F.lower("text"), F.lit(q)) if len(q) >= 3 else F.lit(True)
    return table(spark, d, "conversations").where(found).select("conv_id", "turn")


@query("flt_04_selection", "SELECT doc_id, source FROM documents WHERE doc_id IN (3, 5, 8, 13, 21, 999999)")
def _(spark, d):
    return table(spark, d, "documents").where(_C("doc_id").isin(3, 5, 8, 13, 21, 999999)).select("doc_id", "source")


@query("flt_05_group_if_any", "SELECT c_custkey FROM customer c WHERE contains(lower(c_name), '42') OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND (contains(o_orderkey::VARCHAR, '421') OR contains(lower(o_orderpriority), 'zzz')))")
def _(spark, d):
    """A group stays if it or any member holds the text in one of several columns."""
    q = "421"
    members = table(spark, d, "orders").where(_C("o_orderkey").cast("string").contains(q) | F.lower("o_orderpriority").contains("zzz")).select(_C("o_custkey").alias("c_custkey"))
    groups = table(spark, d, "customer")
    named = groups.where(F.lower("c_name").contains("42")).select("c_custkey")
    return named.union(groups.join(members, "c_custkey", "left_semi").select("c_custkey")).distinct()


@query("flt_06_registry", "SELECT doc_id FROM documents WHERE contains(lang, 'fr') OR contains(source, 'fr') OR contains(doc_id::VARCHAR, 'fr') ORDER BY doc_id LIMIT 300")
def _(spark, d):
    """By substring over three columns, the first 300."""
    q = "fr"
    return table(spark, d, "documents").where(_C("lang").contains(q) | _C("source").contains(q) | _C("doc_id").cast("string").contains(q)).select("doc_id").orderBy("doc_id").limit(300)


@query("flt_07_folded_name", "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(strip_accents(n_name)), lower(strip_accents('ÀN')))")
def _(spark, d):
    from talweg.functions.text import fold

    return table(spark, d, "nation").where(F.contains(F.lower(fold(_C("n_name"))), F.lower(fold(F.lit("ÀN"))))).select("n_nationkey", "n_name")


@query("flt_08_optional_blocks", "SELECT o_orderkey, list_filter(['head', 'clause', 'annex'], lambda b: b = 'head' OR (b = 'clause' AND o_orderstatus = 'F') OR (b = 'annex' AND o_orderkey % 2 = 0)) AS blocks FROM orders")
def _(spark, d):
    """Blocks stay that name no option or an option that is set."""
    block = lambda name, opt: F.struct(F.lit(name).alias("name"), F.lit(opt).cast("string").alias("opt"))
    opts = F.create_map(F.lit("a"), _C("o_orderstatus") == "F", F.lit("b"), _C("o_orderkey") % 2 == 0)
    blocks = F.filter(F.array(block("head", None), block("clause", "a"), block("annex", "b")), lambda b: b["opt"].isNull() | F.element_at(opts, b["opt"]))
    return table(spark, d, "orders").select("o_orderkey", F.transform(blocks, lambda b: b["name"]).alias("blocks"))


@query("flt_09_missing_fields", "SELECT p_partkey, list_filter([CASE WHEN trim(p_name) = '' THEN 'name' END, CASE WHEN p_size < 10 THEN 'size' END, CASE WHEN p_retailprice < 950 THEN 'price' END], lambda x: x IS NOT NULL) AS missing FROM part")
def _(spark, d):
    unfilled = {"name": F.trim("p_name") == "", "size": _C("p_size") < 10, "price": _C("p_retailprice") < 950}
    return table(spark, d, "part").select("p_partkey", F.array_compact(F.array(*[F.when(c, name) for name, c in unfilled.items()])).alias("missing"))


@query("flt_10_typed_whitelist", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k, try_cast(event_type AS INT) AS wrong FROM events")
def _(spark, d):
    """Known fields alone, cast; malformed values become null."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), _C("event_type").try_cast("int").alias("wrong"))


@query("flt_11_size_caps", "SELECT doc_id, CASE WHEN length(text) <= 2000 AND len(string_split(text, ' ')) <= 300 THEN 'accepted' ELSE 'quarantine' END AS outcome FROM documents")
def _(spark, d):
    fits = (F.length("text") <= 2000) & (F.size(F.split("text", " ")) <= 300)
    return table(spark, d, "documents").select("doc_id", F.when(fits, "accepted").otherwise("quarantine").alias("outcome"))


@query(
    "flt_12_low_confidence",
    """SELECT l_orderkey, l_linenumber, field, confidence FROM (SELECT l_orderkey, l_linenumber, 'discount' AS field, l_discount * 10 AS confidence, l_returnflag AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax * 10, l_linestatus FROM lineitem) WHERE confidence <= 0.5 AND value <> ''""",
)
def _(spark, d):
    """Filled fields whose confidence is a number of at most 0.5."""
    fields = F.create_map(F.lit("discount"), F.struct((_C("l_discount") * 10).alias("confidence"), _C("l_returnflag").alias("value")), F.lit("tax"), F.struct((_C("l_tax") * 10).alias("confidence"), _C("l_linestatus").alias("value")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(fields).alias("field", "x"))
    return rows.select("l_orderkey", "l_linenumber", "field", "x.*").where("not isnan(confidence) and confidence <= 0.5 and value <> ''").drop("value")


@query("flt_14_token_validity", "SELECT event_id FROM events WHERE event_type <> 'error' AND ts + INTERVAL 7 DAY > timestamp '2024-01-20 00:00:00'")
def _(spark, d):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "events").where((_C("event_type") != "error") & (_C("ts") + F.expr("INTERVAL 7 DAYS") > now)).select("event_id")


@query("flt_15_expired_requests", f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) + 30 < date '{NOW}'")
def _(spark, d):
    """Sent, and the end of the deadline's day is past."""
    return table(spark, d, "orders").where((_C("o_orderstatus") == "O") & (F.date_add(F.to_date("o_orderdate"), 30) < F.lit(NOW).cast("date"))).select("o_orderkey")


# --- projections -------------------------------------------------------------------------------------------------


@query("prj_01_summary", "SELECT doc_id, source, coalesce(nullif(lang, 'es'), 'unknown') AS lang, len(string_split(text, ' ')) AS n_words FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.coalesce(F.nullif("lang", F.lit("es")), F.lit("unknown")).alias("lang"), F.size(F.split("text", " ")).cast("long").alias("n_words"))


@query("prj_02_renamed", "SELECT c_custkey AS id, c_name AS nom, coalesce(c_mktsegment, '') AS segment FROM customer")
def _(spark, d):
    return table(spark, d, "customer").withColumnsRenamed({"c_custkey": "id", "c_name": "nom"}).select("id", "nom", F.coalesce("c_mktsegment", F.lit("")).alias("segment"))


@query("prj_03_coalesced_columns", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), nullif(o_orderpriority, '5-LOW'), 'none') AS label, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey // 4 END AS parent FROM orders")
def _(spark, d):
    blank = lambda c, v: F.nullif(c, F.lit(v))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(blank("o_orderstatus", "P"), blank("o_orderpriority", "5-LOW"), F.lit("none")).alias("label"), F.when(_C("o_orderkey") % 4 == 0, F.expr("o_orderkey div 4")).alias("parent"))


@query("prj_04_signer_lookup", "SELECT l_orderkey, arg_min(l_suppkey, l_linenumber * 1000000 + l_suppkey) FILTER (l_returnflag = 'R') AS first_signer FROM lineitem GROUP BY 1")
def _(spark, d):
    """Per request, the external id of the first signer of a kind."""
    signers = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_suppkey")))
    one = F.get(F.filter("signers", lambda s: s["l_returnflag"] == "R"), 0)["l_suppkey"]
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(signers.alias("signers")).select("l_orderkey", one.alias("first_signer"))


@query("prj_05_search_corpus", "SELECT p_partkey, lower(concat_ws(' ', nullif(p_name, ''), nullif(p_brand, ''), nullif(p_type, ''))) AS corpus FROM part")
def _(spark, d):
    parts = F.filter(F.array("p_name", "p_brand", "p_type"), lambda x: x != "")
    return table(spark, d, "part").select("p_partkey", F.lower(F.array_join(parts, " ")).alias("corpus"))


@query("prj_08_defaults", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INT), 0) AS k, 'fr' AS lang, 3 AS pages FROM events")
def _(spark, d):
    """A partial record with every field filled by its default."""
    r = F.from_json("props", "k int, lang string, pages int")
    return table(spark, d, "events").select("event_id", r.alias("r")).select("event_id", *[F.coalesce(f"r.{c}", F.lit(v)).alias(c) for c, v in (("k", 0), ("lang", "fr"), ("pages", 3))])


# --- joins -------------------------------------------------------------------------------------------------------


@query("joi_01_needs_by_candidates", "SELECT s_suppkey, p_partkey, CASE WHEN s_nationkey % 5 = p_size % 5 THEN 1 ELSE 0 END AS score FROM (SELECT * FROM supplier WHERE s_suppkey % 50 = 0), part")
def _(spark, d):
    """The stated needs (ids divisible by 50) against every candidate, once for those that ask the same."""
    needs = table(spark, d, "supplier").where("s_suppkey % 50 = 0").select("s_suppkey", (_C("s_nationkey") % 5).alias("asked"))
    made = lambda pairs: pairs.select("s_suppkey", "p_partkey", F.when(_C("asked") == _C("p_size") % 5, 1).otherwise(0).alias("score"))
    return by_class(table(spark, d, "part").select("p_partkey", "p_size"), needs, "s_suppkey", made)


@query("joi_03_results_with_candidate", "SELECT o_orderkey, coalesce(c_name, '') AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def _(spark, d):
    who = table(spark, d, "customer").where("c_custkey % 3 <> 0")
    return table(spark, d, "orders").join(who, _C("o_custkey") == _C("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("c_name"))


@query("joi_04_results_with_metadata", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 20")
def _(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part").where("p_size < 20"), _C("l_partkey") == _C("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


_TREE = "WITH parent AS (SELECT o_custkey, min(o_orderkey) AS parent FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"


@query("joi_05_amendments_to_parent", f"{_TREE} SELECT o_orderkey, parent, parent IS NULL AS orphan FROM orders LEFT JOIN parent USING (o_custkey) WHERE o_orderstatus <> 'F'")
def _(spark, d):
    """Each amendment to the first contract of its number; orphans stay as roots."""
    df = table(spark, d, "orders")
    first = store.latest_by(df.where("o_orderstatus = 'F'").select("o_custkey", _C("o_orderkey").alias("parent")), ["o_custkey"], [_C("parent")])
    return df.where("o_orderstatus <> 'F'").join(first, "o_custkey", "left").select("o_orderkey", "parent", _C("parent").isNull().alias("orphan"))


_EITHER = (
    "SELECT l_orderkey, l_linenumber, min(o_orderkey) AS attached FROM (SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem JOIN orders ON o_custkey = l_suppkey) GROUP BY 1, 2"
)


def _either(spark, d):
    """Every request to at most one contract, by one key or another: the least of each contract key first, then two equi-joins.
    Contracts are hashed and requests pass by them unsorted; what is found is dealt by request in even shares, so that a task's share is the same at any size."""
    req, con = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    first = con.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    both = req.join(con.select("o_orderkey").hint("shuffle_hash"), _C("l_orderkey") == _C("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", _C("l_orderkey").alias("o_orderkey"))
    both = both.union(req.join(first.hint("shuffle_hash"), _C("l_suppkey") == _C("o_custkey")).select("l_orderkey", "l_linenumber", "o_orderkey"))
    return dealt(both, 2 * req.count(), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.min("o_orderkey").alias("attached"))


query("joi_06_either_key", _EITHER)(_either)


@query("joi_07_without_contract", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), _C("c_custkey") == _C("o_custkey"), "left_anti").select("c_custkey")


@query("joi_08_orphans_counted", "SELECT count(*) AS orphans FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


@query("joi_11_set_intersections", "SELECT a.p_partkey, list_sort(list_intersect(string_split(a.p_name, ' '), ['red', 'small', 'ring'])) AS common, list_sort(list_filter(['red', 'small', 'ring'], lambda x: NOT list_contains(string_split(a.p_name, ' '), x))) AS missing FROM part a")
def _(spark, d):
    has, asked = F.split("p_name", " "), F.array(*map(F.lit, ("red", "small", "ring")))
    return table(spark, d, "part").select("p_partkey", F.array_sort(F.array_intersect(asked, has)).alias("common"), F.array_sort(F.array_except(asked, has)).alias("missing"))


@query("joi_12_version_variants", "SELECT a.p_brand AS short, b.p_brand AS long FROM (SELECT DISTINCT p_brand FROM part) a JOIN (SELECT DISTINCT p_brand FROM part) b ON starts_with(lower(b.p_brand), lower(a.p_brand)) AND length(b.p_brand) > length(a.p_brand) AND regexp_matches(trim(substr(b.p_brand, length(a.p_brand) + 1)), '^[vV]?[0-9]')")
def _(spark, d):
    """Names of a dictionary of which one goes on with a version number: each name meets its own prefixes by equality."""
    names = table(spark, d, "part").select("p_brand").distinct()
    cut = names.select(_C("p_brand").alias("long"), F.explode(F.sequence(F.lit(1), F.greatest(F.length("p_brand") - 1, F.lit(1)))).alias("n")).where("n < length(long)")
    ok = F.trim(F.expr("substr(long, n + 1)")).rlike("^[vV]?[0-9]")
    cut = cut.where(ok).select("long", F.lower(F.expr("substr(long, 1, n)")).alias("k"))
    return names.select(_C("p_brand").alias("short"), F.lower("p_brand").alias("k")).join(cut, "k").select("short", "long")


@query("joi_13_known_ids", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def _(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").where("lang = 'fr'"), "doc_id", "left_semi").select("doc_id", "quality")


@query("joi_14_blended_score", "SELECT doc_id, CASE WHEN quality IS NULL THEN n_chars % 100 ELSE floor((0.6 * (n_chars % 100) + 0.4 * quality * 100) * 100 + 0.5) / 100 END AS total FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, d):
    """0.6 of the rules and 0.4 of the opinion; the rules alone where there is no opinion."""
    rules, opinion = _C("n_chars") % 100, _C("quality") * 100
    total = F.when(_C("quality").isNull(), rules).otherwise(F.floor((0.6 * rules + 0.4 * opinion) * 100 + 0.5) / 100)
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", total.alias("total"))


@query("joi_15_provenance_carried", "SELECT n.n_nationkey, coalesce(o.r_name, 'new') AS origin FROM nation n LEFT JOIN region o ON lower(trim(n.n_name)) = lower(trim(o.r_name))")
def _(spark, d):
    key = lambda c: F.lower(F.trim(c))
    return table(spark, d, "nation").join(table(spark, d, "region"), key("n_name") == key("r_name"), "left").select("n_nationkey", F.coalesce("r_name", F.lit("new")).alias("origin"))


@query("joi_16_changed_only", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 10 = 1")
def _(spark, d):
    """To embed anew: no stored hash of this model, or another one."""
    now = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    stored = now.where("doc_id % 3 <> 0").select("doc_id", F.when(_C("doc_id") % 10 == 1, "old").otherwise(_C("h")).alias("was"))
    return now.join(stored, "doc_id", "left").where("was is null or was <> h").select("doc_id")


@query("joi_17_guarded_overrides", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 AND l_returnflag = 'N' THEN 'changed' ELSE l_returnflag END AS text FROM lineitem")
def _(spark, d):
    """An override of a block holds only while the block's original text is the one it was made for."""
    blocks = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    changes = blocks.where("l_linenumber % 2 = 0").select(_C("l_orderkey").alias("k"), _C("l_linenumber").alias("i"), F.lit("N").alias("base"), F.lit("changed").alias("to")).distinct()
    on = (_C("l_orderkey") == _C("k")) & (_C("l_linenumber") == _C("i")) & (_C("l_returnflag") == _C("base"))
    return blocks.join(changes, on, "left").select("l_orderkey", "l_linenumber", F.coalesce("to", "l_returnflag").alias("text"))


@query(
    "joi_18_field_verdicts",
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right only' WHEN b.doc_id IS NULL THEN 'left only' WHEN a.lang = b.lang THEN 'agree' ELSE 'differ' END AS verdict
    FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 4 <> 0) b USING (doc_id)""",
)
def _(spark, d):
    return _verdicts(spark, d)


def _verdicts(spark, d):
    df = table(spark, d, "documents").select("doc_id", "lang")
    a, b = df.where("doc_id % 3 <> 0").alias("a"), df.where("doc_id % 4 <> 0").withColumn("lang", F.when(_C("doc_id") % 5 == 0, "xx").otherwise(_C("lang"))).alias("b")
    verdict = F.when(_C("a.doc_id").isNull(), "right only").when(_C("b.doc_id").isNull(), "left only").when(_C("a.lang") == _C("b.lang"), "agree").otherwise("differ")
    return a.join(b, _C("a.doc_id") == _C("b.doc_id"), "full").select(F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), verdict.alias("verdict"))


# --- aggregates --------------------------------------------------------------------------------------------------


@query("agg_02_frequency", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word ORDER BY n DESC, lower(word)")
def _(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.lower("word"))


@query("agg_03_status_counts", f"SELECT count(*) FILTER (o_orderstatus = 'O' AND o_orderdate >= timestamp '2001-01-01') AS pending, count(*) FILTER (o_orderpriority = '1-URGENT') AS my_turn, count(*) FILTER (o_orderstatus = 'O' AND o_orderdate < timestamp '2001-01-01') AS expired, count(*) FILTER (o_orderstatus = 'F') AS complete FROM orders -- {NOW}")
def _(spark, d):
    sent, late = _C("o_orderstatus") == "O", _C("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz")
    counts = {"pending": sent & ~late, "my_turn": _C("o_orderpriority") == "1-URGENT", "expired": sent & late, "complete": _C("o_orderstatus") == "F"}
    return table(spark, d, "orders").agg(*[F.count_if(c).alias(name) for name, c in counts.items()])


@query("agg_04_company_groups", "SELECT o_custkey, count(*) AS n, count(*) FILTER (o_totalprice > 400000) AS alerts, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderpriority <> '5-LOW') AS first_filled, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1")
def _(spark, d):
    first = F.min_by(F.when(_C("o_orderpriority") != "5-LOW", _C("o_orderpriority")), F.when(_C("o_orderpriority") != "5-LOW", _C("o_orderkey")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(_C("o_totalprice") > 400000).alias("alerts"), first.alias("first_filled"), F.count_if(_C("o_orderstatus") == "P").alias("pending"))


@query(
    "agg_05_interval_union",
    """WITH m AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS s, year(o_orderdate) * 12 + month(o_orderdate) - 1 + (o_orderkey % 9) - 1 AS e FROM orders),
    covered AS (SELECT o_custkey, count(DISTINCT x) AS m FROM (SELECT o_custkey, unnest(range(s, e + 1)) AS x FROM m WHERE e >= s) GROUP BY 1), bad AS (SELECT o_custkey, 12 * count(*) AS b FROM m WHERE e < s GROUP BY 1)
    SELECT o_custkey, CAST(coalesce(m, 0) + coalesce(b, 0) AS BIGINT) AS months, CAST(floor((coalesce(m, 0) + coalesce(b, 0)) / 12.0 + 0.5) AS BIGINT) AS years FROM covered FULL JOIN bad USING (o_custkey)""",
)
def _(spark, d):
    """Months covered by possibly overlapping missions; the oracle counts distinct months instead."""
    start = intervals.month_index(_C("o_orderdate"))
    missions = table(spark, d, "orders").select("o_custkey", start.alias("s"), (start + _C("o_orderkey") % 9 - 1).alias("e"))
    return intervals.covered_months(missions, "o_custkey", "s", "e")


@query(
    "agg_06_consensus",
    """WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS score, avg(l_quantity) OVER (PARTITION BY l_orderkey) AS mean FROM lineitem)
    SELECT l_orderkey, floor(avg(score) * 100 + 0.5) / 100 AS mean, min(score) AS low, max(score) AS high, count(*) AS votes, list(l_linenumber ORDER BY l_linenumber) AS voters, arg_min(l_linenumber, abs(score - mean) * 100 + l_linenumber / 1000.0) AS nearest FROM v GROUP BY 1""",
)
def _(spark, d):
    """Mean, range and voters; the opinion kept is the one nearest to the mean, the first on ties."""
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _C("l_quantity").cast("double").alias("score"))
    v = v.withColumn("mean", F.avg("score").over(Window.partitionBy("l_orderkey")))
    key = F.abs(_C("score") - _C("mean")) * 100 + _C("l_linenumber") / 1000.0
    return v.groupBy("l_orderkey").agg((F.floor(F.avg("score") * 100 + 0.5) / 100).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.count(F.lit(1)).alias("votes"), F.array_sort(F.collect_list("l_linenumber")).alias("voters"), F.min_by("l_linenumber", key).alias("nearest"))


@query("agg_07_roll_up", "SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN 3 ELSE 1 END) AS occurrences, max(year(l_shipdate)) AS last_used FROM lineitem GROUP BY 1")
def _(spark, d):
    """Occurrences, two more for an explicit mention, and the latest year."""
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.when(_C("l_returnflag") == "R", 3).otherwise(1)).alias("occurrences"), F.max(F.year("l_shipdate")).cast("long").alias("last_used"))


@query("agg_08_weighted_mode", "SELECT source, arg_max(lang, w * 100 + CASE lang WHEN 'de' THEN 3 WHEN 'en' THEN 2 WHEN 'es' THEN 1 ELSE 0 END) AS lang FROM (SELECT source, lang, sum(n_chars) AS w FROM documents GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    """The value with most text behind it; ties go by a fixed order."""
    order = F.when(_C("lang") == "de", 3).when(_C("lang") == "en", 2).when(_C("lang") == "es", 1).otherwise(0)
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("w")).groupBy("source").agg(F.max_by("lang", _C("w") * 100 + order).alias("lang"))


@query(
    "agg_09_verdict_counts",
    """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN a.doc_id IS NULL THEN 'right only' WHEN b.doc_id IS NULL THEN 'left only' WHEN a.lang = b.lang THEN 'agree' ELSE 'differ' END AS verdict
    FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 4 <> 0) b USING (doc_id)) GROUP BY 1""",
)
def _(spark, d):
    return _verdicts(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("agg_10_fill_report", "SELECT doc_id, (n_chars > 500)::INT + (lang <> 'en')::INT + 1 AS filled, list_filter([CASE WHEN n_chars <= 500 THEN 'text' END, CASE WHEN lang = 'en' THEN 'lang' END], lambda x: x IS NOT NULL) AS missing, n_chars > 500 AS usable FROM documents")
def _(spark, d):
    have = {"text": _C("n_chars") > 500, "lang": _C("lang") != "en"}
    filled = reduce(lambda a, b: a + b, [c.cast("int") for c in have.values()]) + 1
    return table(spark, d, "documents").select("doc_id", filled.alias("filled"), F.array_compact(F.array(*[F.when(~c, k) for k, c in have.items()])).alias("missing"), have["text"].alias("usable"))


_TESTS = ("p_size > 10", "p_retailprice > 1000", "length(p_name) > 8", "p_name LIKE '% %'", "p_brand <> ''", "p_type <> 'SMALL'", "p_size < 45", "p_partkey % 3 = 0", "p_name NOT LIKE '%rod'", "p_retailprice < 1900")


@query("agg_11_completeness", f"SELECT p_partkey, len(list_filter([{', '.join(_TESTS)}], lambda x: x)) / 10.0 AS ratio FROM part")
def _(spark, d):
    """The share of ten tests that a record passes, to two places."""
    passed = reduce(lambda a, b: a + b, [F.coalesce(F.expr(t), F.lit(False)).cast("int") for t in _TESTS])
    return table(spark, d, "part").select("p_partkey", (F.floor(passed / len(_TESTS) * 100 + 0.5) / 100).alias("ratio"))


@query("agg_12_next_amendment", "SELECT o_custkey, count(*) + 1 AS next FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderstatus <> 'F'").groupBy("o_custkey").agg((F.count(F.lit(1)) + 1).alias("next"))


@query("agg_13_merged_sections", "SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1, 2")
def _(spark, d):
    """Repeated sections of a kind made one, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


@query("agg_14_by_category", "SELECT coalesce(cat, 'other') AS category, list(p_type ORDER BY p_type) AS items FROM (SELECT DISTINCT p_type FROM part) LEFT JOIN (VALUES ('ECONOMY', 'cheap'), ('PROMO', 'cheap'), ('LARGE', 'size'), ('MEDIUM', 'size')) t(name, cat) ON p_type = name GROUP BY 1")
def _(spark, d):
    """Items under canonical categories, unknown ones in the last."""
    known = spark.createDataFrame([("ECONOMY", "cheap"), ("PROMO", "cheap"), ("LARGE", "size"), ("MEDIUM", "size")], "p_type string, cat string")
    return table(spark, d, "part").select("p_type").distinct().join(F.broadcast(known), "p_type", "left").groupBy(F.coalesce("cat", F.lit("other")).alias("category")).agg(F.array_sort(F.collect_list("p_type")).alias("items"))


@query("agg_15_distinct_by_key", "SELECT arg_min(p_name, p_partkey) AS kept, min(p_partkey) AS p_partkey FROM part GROUP BY lower(strip_accents(p_name))")
def _(spark, d):
    from talweg.functions.text import fold

    keyed = table(spark, d, "part").select("p_partkey", _C("p_name").alias("kept"), F.lower(fold(_C("p_name"))).alias("k"))
    return store.latest_by(keyed, ["k"], [_C("p_partkey")]).drop("k")


@query("agg_16_best_filled", "SELECT p_name, arg_min(p_partkey, CASE WHEN p_size > 25 THEN 0 ELSE 1000000000 END + p_partkey) AS p_partkey FROM part GROUP BY 1")
def _(spark, d):
    return store.latest_by(table(spark, d, "part"), ["p_name"], [F.desc(_C("p_size") > 25), _C("p_partkey")]).select("p_name", "p_partkey")


@query("agg_17_keyword_weight", "SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3)::BIGINT + CASE WHEN starts_with(lower(text), 'the') THEN 10 ELSE 0 END - CASE WHEN n_chars > 5000 THEN 2 ELSE 0 END AS weight FROM documents")
def _(spark, d):
    """Occurrences of a keyword, more at the head, less in a long text."""
    low = F.lower("text")
    times = ((F.length(low) - F.length(F.replace(low, F.lit("the"), F.lit("")))) / 3).cast("long")
    return table(spark, d, "documents").select("doc_id", (times + F.when(low.startswith("the"), 10).otherwise(0) - F.when(_C("n_chars") > 5000, 2).otherwise(0)).alias("weight"))


@query("agg_18_next_sequence", "SELECT coalesce(max(o_orderkey), 0) + 1 AS next FROM orders")
def _(spark, d):
    return table(spark, d, "orders").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next"))


# --- windows -----------------------------------------------------------------------------------------------------


def _per(key, *order):
    return Window.partitionBy(key).orderBy(*order)


@query("win_01_rank", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(_per("o_custkey", F.desc("o_totalprice"), "o_orderkey")).alias("rank"))


@query("win_02_conditional_rank", "SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice >= 200000 THEN row_number() OVER (PARTITION BY o_custkey, o_totalprice >= 200000 ORDER BY o_totalprice DESC, o_orderkey) END AS rank FROM orders")
def _(spark, d):
    """Only what is retained has a rank."""
    kept = _C("o_totalprice") >= 200000
    w = Window.partitionBy("o_custkey", kept).orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(kept, F.row_number().over(w)).alias("rank"))


@query("win_03_running_max", "SELECT o_custkey, o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM orders")
def _(spark, d):
    w = _per("o_custkey", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.max("o_totalprice").over(w).alias("before"))


@query("win_04_carried_heading", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations")
def _(spark, d):
    """Lines inherit the last heading before them."""
    w = _per("conv_id", "turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(_C("role") == "user", _C("turn")), ignorenulls=True).over(w).alias("heading"))


@query("win_05_next_line", "SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def _(spark, d):
    w = _per("conv_id", "turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lead("role").over(w).alias("next"), F.lag("role").over(w).alias("previous"))


@query("win_06_first_of_key", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, d):
    return store.latest_by(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [_C("o_orderkey")])


@query("win_07_turn", "SELECT l_orderkey, min(l_linenumber) FILTER (l_linestatus <> 'F') AS turn FROM lineitem GROUP BY 1")
def _(spark, d):
    """The first signer who has not signed."""
    signers = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_linestatus")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(signers.alias("s")).select("l_orderkey", F.get(F.filter("s", lambda x: x["l_linestatus"] != "F"), 0)["l_linenumber"].alias("turn"))


@query("win_09_queue_position", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE event_type = 'signup'")
def _(spark, d):
    return table(spark, d, "events").where("event_type = 'signup'").select("event_id", F.row_number().over(_per("user_id", "ts", "event_id")).alias("position"))


@query("win_10_sliding_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS calls, calls <= 20 AS allowed FROM events")
def _(spark, d):
    """Calls of a user within the minute up to each one (in whole seconds), and whether the cap of 20 allows it."""
    seconds = F.unix_timestamp(_C("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-60, 0)
    return table(spark, d, "events").select("event_id", F.count(F.lit(1)).over(w).alias("calls")).withColumn("allowed", _C("calls") <= 20)


# --- orders and limits -------------------------------------------------------------------------------------------


@query("srt_01_top_scores", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 500")
def _(spark, d):
    limit = max(1, min(500, 5000))
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(limit)


@query("srt_02_three_keys", "SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey DESC, c_acctbal DESC, c_name) AS position FROM customer ORDER BY position LIMIT 100")
def _(spark, d):
    top = table(spark, d, "customer").orderBy(F.desc("c_nationkey"), F.desc("c_acctbal"), "c_name").limit(100)
    return top.select("c_custkey", F.row_number().over(Window.orderBy(F.desc("c_nationkey"), F.desc("c_acctbal"), "c_name")).cast("long").alias("position"))


_FRENCH = "CASE c_custkey % 5 WHEN 0 THEN 'Élan ' WHEN 1 THEN 'eau ' WHEN 2 THEN 'Zoé ' WHEN 3 THEN 'côte ' ELSE 'Coté ' END || CAST(c_custkey % 13 AS STRING)"


@query("srt_02_french_names", f"SELECT c_custkey, name, row_number() OVER (ORDER BY c_nationkey DESC, name COLLATE fr, c_custkey) AS position FROM (SELECT *, {_FRENCH} AS name FROM customer) ORDER BY position LIMIT 200")
def _(spark, d):
    """By a number downwards, then names in French order: accents and case count last."""
    order = [F.desc("c_nationkey"), F.collate("name", "fr"), _C("c_custkey")]
    top = table(spark, d, "customer").selectExpr("c_custkey", "c_nationkey", f"{_FRENCH} AS name").orderBy(*order).limit(200)
    return top.select("c_custkey", "name", F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"))


@query("srt_03_newest_undated_last", "SELECT o_custkey, list(o_orderkey ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey) AS missions FROM orders GROUP BY 1")
def _(spark, d):
    """Missions newest first, those without a date last, else as they came."""
    day = F.when(_C("o_orderkey") % 5 == 0, None).otherwise(F.unix_date(F.to_date("o_orderdate")))
    key = F.struct(F.coalesce(-day, F.lit(1 << 30)).alias("k"), _C("o_orderkey").alias("o"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["o"]).alias("missions"))


@query("srt_04_weight_order", "SELECT p_type, count(*) AS n, sum(p_size) AS weight FROM part GROUP BY 1 ORDER BY weight DESC, n DESC, p_type")
def _(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("weight")).orderBy(F.desc("weight"), F.desc("n"), "p_type")


@query("srt_05_listings", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey DESC LIMIT 50")
def _(spark, d):
    return table(spark, d, "orders").orderBy("o_orderdate", F.desc("o_orderkey")).select("o_orderkey").limit(50)


@query("srt_06_recent_events", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def _(spark, d):
    return table(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)


@query("srt_07_alerts_by_days", f"SELECT o_orderkey, date_diff('day', date '{NOW}', CAST(o_orderdate AS DATE)) AS days FROM orders WHERE o_orderstatus = 'O' ORDER BY days, o_orderkey LIMIT 100")
def _(spark, d):
    days = F.datediff(F.to_date("o_orderdate"), F.lit(NOW).cast("date"))
    return table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", days.cast("long").alias("days")).orderBy("days", "o_orderkey").limit(100)


@query("srt_07_groups_by_name", "SELECT word, n, row_number() OVER (ORDER BY word COLLATE fr, word) AS position FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS word FROM conversations) GROUP BY 1) ORDER BY position LIMIT 500")
def _(spark, d):
    """The first 500 words of all turns in French order, with how often each stands there."""
    words = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-zÀ-ÖØ-öø-ÿ]+)"), F.lit(1))).alias("word"))
    order = [F.collate("word", "fr"), _C("word")]
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(*order).limit(500)
    return top.select("word", "n", F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"))


@query("srt_08_merged_by_year", "SELECT kind, id, y FROM (SELECT 'order' AS kind, o_orderkey AS id, year(o_orderdate) AS y FROM orders UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, year(l_shipdate) FROM lineitem) ORDER BY y DESC, kind, id LIMIT 100")
def _(spark, d):
    a = table(spark, d, "orders").select(F.lit("order").alias("kind"), _C("o_orderkey").alias("id"), F.year("o_orderdate").cast("long").alias("y"))
    b = table(spark, d, "lineitem").select(F.lit("line").alias("kind"), (_C("l_orderkey") * 10 + _C("l_linenumber")).alias("id"), F.year("l_shipdate").cast("long").alias("y"))
    return a.union(b).orderBy(F.desc("y"), "kind", "id").limit(100)


@query("srt_10_bounded_registry", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def _(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(5000).select("event_id")


# --- sets --------------------------------------------------------------------------------------------------------


@query("set_01_differences", "SELECT side, word FROM ((SELECT 'left' AS side, unnest(string_split(lower(p_name), ' ')) AS word FROM part EXCEPT SELECT 'left', unnest(string_split(lower(p_type), ' ')) FROM part) UNION ALL (SELECT 'right', unnest(string_split(lower(p_type), ' ')) FROM part EXCEPT SELECT 'right', unnest(string_split(lower(p_name), ' ')) FROM part))")
def _(spark, d):
    """The words of all names against those of all types, both ways."""
    words = lambda c: table(spark, d, "part").select(F.explode(F.split(F.lower(c), " ")).alias("word"))
    a, b = words("p_name"), words("p_type")
    return a.subtract(b).select(F.lit("left").alias("side"), "word").union(b.subtract(a).select(F.lit("right"), "word"))


@query(
    "set_01_all_differences",
    """WITH w AS (SELECT word, max(l) AS l, max(r) AS r FROM (SELECT unnest(string_split(text, ' ')) AS word, 1 AS l, 0 AS r FROM documents UNION ALL SELECT unnest(string_split(text, ' ')), 0, 1 FROM benchmark) GROUP BY 1)
    SELECT CASE WHEN l = 1 THEN 'left' ELSE 'right' END AS side, word FROM w WHERE l <> r
    UNION ALL SELECT 'verdict', CASE WHEN count(*) = 0 THEN 'both_empty' WHEN count(*) FILTER (l <> r) = 0 THEN 'agree' WHEN max(l) = 0 THEN 'right_only' WHEN max(r) = 0 THEN 'left_only' ELSE 'disagree' END FROM w""",
)
def _(spark, d):
    """The words of all documents against those of all benchmark items, both ways, and the verdict."""
    words = lambda t, a, b: table(spark, d, t).select(F.explode(F.split("text", " ")).alias("word"), F.lit(a).alias("l"), F.lit(b).alias("r"))
    w = words("documents", 1, 0).union(words("benchmark", 0, 1)).groupBy("word").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    apart = w.where(_C("l") != _C("r")).select(F.when(_C("l") == 1, "left").otherwise("right").alias("side"), "word")
    n = F.count(F.lit(1))
    verdict = F.when(n == 0, "both_empty").when(F.count_if(_C("l") != _C("r")) == 0, "agree").when(F.max("l") == 0, "right_only").when(F.max("r") == 0, "left_only").otherwise("disagree")
    return apart.union(w.agg(verdict.alias("word")).select(F.lit("verdict"), "word"))


@query("set_02_union_seen", "SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT lower(p_type) FROM part UNION ALL SELECT lower(p_brand) FROM part)")
def _(spark, d):
    df = table(spark, d, "part")
    first, second, third = df.select(F.explode(F.split("p_name", " ")).alias("word")), df.select(F.lower("p_type").alias("word")), df.select(F.lower("p_brand").alias("word"))
    out = first.distinct()
    for more in (second, third):
        out = out.union(more.distinct().join(out, "word", "left_anti"))
    return out


@query("set_03_unique_in_order", "SELECT conv_id, list(role ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    """Unique values in order of first sight."""
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_distinct(roles).alias("roles"))


@query("set_04_roots", f"{_TREE} SELECT o_orderkey FROM orders LEFT JOIN parent USING (o_custkey) WHERE o_orderstatus = 'F' OR parent IS NULL")
def _(spark, d):
    """Parents, and children without one."""
    df = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    parents = df.where("o_orderstatus = 'F'")
    return parents.select("o_orderkey").union(df.where("o_orderstatus <> 'F'").join(parents, "o_custkey", "left_anti").select("o_orderkey"))


@query("set_05_essential_missing", "SELECT p_partkey, list_has_any(list_filter(['red', 'ring'], lambda x: NOT list_contains(string_split(p_name, ' '), x)), ['red']) AS lacks FROM part")
def _(spark, d):
    missing = F.array_except(F.array(F.lit("red"), F.lit("ring")), F.split("p_name", " "))
    return table(spark, d, "part").select("p_partkey", F.arrays_overlap(missing, F.array(F.lit("red"))).alias("lacks"))
