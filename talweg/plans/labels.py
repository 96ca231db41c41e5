"""Labels, levels, sections and other text rules over documents, pages, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.functions import analysis, labels
from talweg.plans.registry import query
from talweg.sources.tables import table

C = F.col


@query("src_14b_page_entities", "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS digest FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(labels.decoded_entities(C("html")).cast("binary")).alias("digest"))


@query("str_16_sentences", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1\x01', 'g'), '\\n+', '\x01', 'g'), '\x01')) AS s FROM documents) WHERE trim(s) <> '' GROUP BY 1")
def _(spark, d):
    """Sentences end at a mark before white space, or with their line."""
    return table(spark, d, "documents").select("doc_id", F.explode(labels.sentences(C("text")))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "str_19_boilerplate",
    """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents),
    k AS (SELECT * FROM l WHERE line <> '' AND line NOT IN ('<!-- image -->', '---', '===', '***', '___') AND NOT (len(list_distinct(regexp_extract_all(line, '(?s).'))) <= 2 AND length(line) > 5)),
    s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS seen FROM k) SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY k)) AS digest FROM s WHERE seen = 1 OR length(line) >= 12 GROUP BY 1""",
)
def _(spark, d):
    return labels.cleaned_lines(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.md5(C("text").cast("binary")).alias("digest"))


@query("joi_10_dictionary_search", "SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM documents) WHERE name IN ('idiot', 'moron', 'clown', 'licensed') GROUP BY 1, 2")
def _(spark, d):
    """A plain count of single words, which meet a list by equality; not the whole dictionary search (see README)."""
    known = spark.createDataFrame([("idiot",), ("moron",), ("clown",), ("licensed",)], "name string")
    words = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("name"))
    return words.join(F.broadcast(known), "name").groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("arr_03_stack_from_missions", "SELECT p_type, len(list_distinct(flatten(list(string_split(p_name, ' '))))) AS n FROM part GROUP BY 1")
def _(spark, d):
    """Distinct technologies out of mission texts, 45 at most."""
    found = F.slice(F.array_distinct(F.flatten(F.collect_set(F.split("p_name", " ")))), 1, 45)
    return table(spark, d, "part").groupBy("p_type").agg(F.size(found).cast("long").alias("n"))


@query("arr_04_know_how", "SELECT doc_id, least(count(DISTINCT lower(substr(line, 1, 60))), 10) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE length(line) BETWEEN 12 AND 200 GROUP BY 1")
def _(spark, d):
    """Lines of 12 to 200 characters, distinct in their first 60, ten at most."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).between(12, 200))
    heads = F.array_distinct(F.transform(lines, lambda x: F.lower(F.substring(x, 1, 60))))
    return table(spark, d, "documents").select("doc_id", F.least(F.size(heads), F.lit(10)).cast("long").alias("n")).where("n > 0")


@query("arr_07_truncated_lists", "SELECT l_orderkey, count(*) = 4 AS suspicious FROM lineitem GROUP BY 1")
def _(spark, d):
    """A list as long as the cap may have been cut."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("x")).select("l_orderkey", (F.size("x") == 4).alias("suspicious"))


@query("prj_06_unwrapped", "SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS INT) AS value, 0.9 AS confidence FROM events")
def _(spark, d):
    """Leaves of an envelope {value, confidence} as dotted paths."""
    leaf = F.struct(F.get_json_object("props", "$.k").cast("int").alias("value"), F.lit(0.9).alias("confidence"))
    return table(spark, d, "events").select("event_id", F.explode(F.create_map(F.lit("k"), leaf)).alias("path", "x")).select("event_id", "path", "x.value", "x.confidence")


@query("prj_07_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS value FROM events")
def _(spark, d):
    """Navigation by path in a variant."""
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"a":['), C("props"), F.lit("]}"))), "$.a[0].k", "int").alias("value"))


@query("sup_17_document_analysis")
def _(spark, d):
    """Kind, company, day of issue and findings of every document's whole text, against its source as the company expected."""
    return analysis.with_analysis(table(spark, d, "documents").select("doc_id", "text", "source"), "text", C("source"), "2026-01-15").select("doc_id", "analysis.*")
