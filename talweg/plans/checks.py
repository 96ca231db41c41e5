"""Texts, digests, vectors and arrays over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.functions import labels, text
from talweg.plans.registry import query
from talweg.sources.tables import table

C = F.col


@query("str_01b_fold_documents", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold(C("text")).cast("binary")).alias("folded"))


@query("str_17_significant_words", "SELECT lang, word, count(*) AS n FROM (SELECT DISTINCT lang, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents) GROUP BY 1, 2")
def _(spark, d):
    """Distinct words of four letters or more, by language."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)))
    return table(spark, d, "documents").select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query("str_26_line_count", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INT) AS lines FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("lines"))


@query("str_13_word_boundary", "SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(substr(text, 1, 60), '[ \\n][^ \\n]*$', '') END AS cut FROM documents")
def _(spark, d):
    cut = F.regexp_replace(F.substring("text", 1, 60), r"[ \n][^ \n]*\z", "")
    return table(spark, d, "documents").select("doc_id", F.when(F.length("text") <= 60, C("text")).otherwise(cut).alias("cut"))


@query("str_14_initials", "SELECT p_partkey, upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: substr(w, 1, 1)), '')) AS initials FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 1)), "")).alias("initials"))


@query("str_11_contacts", "SELECT doc_id, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]{2,}') AS email FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]{2,}')")
def _(spark, d):
    p = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]{2,}"
    return table(spark, d, "documents").where(C("text").rlike(p)).select("doc_id", F.regexp_extract("text", p, 0).alias("email"))


@query(
    "pii_04_counts",
    """SELECT * FROM (SELECT doc_id,
        len(list_filter(regexp_extract_all(text, '\\b[0-9]{13,19}\\b'), lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN (length(x) - i) % 2 = 0 THEN CAST(x[i] AS INT) ELSE CAST(x[i] AS INT) * 2 // 10 + CAST(x[i] AS INT) * 2 % 10 END)) % 10 = 0)) AS cards,
        len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,24}')) AS emails
        FROM documents) WHERE cards > 0 OR emails > 0""",
)
def _(spark, d):
    """Cards (13 to 19 digits together that pass Luhn's check) and e-mail addresses of each document that has any."""
    cards = F.filter(F.regexp_extract_all("text", F.lit(r"(\b[0-9]{13,19}\b)"), F.lit(1)), lambda x: F.call_function("luhn_check", x))
    emails = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"), F.lit(0))
    counted = table(spark, d, "documents").where(C("text").rlike("@|[0-9]{13}")).select("doc_id", F.size(cards).cast("long").alias("cards"), F.size(emails).cast("long").alias("emails"))
    return counted.where("cards > 0 or emails > 0")


@query("cry_01_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("cry_02_envelope", "SELECT doc_id, true AS same, strlen(text) + 28 AS sealed_bytes FROM documents")
def _(spark, d):
    """AES-GCM with associated data, there and back; the nonce is a keyed digest of id and text, since GCM must never use one for two texts: only equal rows share it, and then seal to equal bytes."""
    nonce = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.lit("0123456789abcdef"), C("doc_id").cast("string"), F.sha2("text", 256)), 256), 1, 24))
    key, aad = F.lit("0123456789abcdef0123456789abcdef").cast("binary"), F.lit("registry").cast("binary")
    sealed = F.aes_encrypt(C("text").cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce, aad)
    same = F.aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string") == C("text")
    return table(spark, d, "documents").select("doc_id", same.alias("same"), F.octet_length(sealed).cast("long").alias("sealed_bytes"))


@query("vec_01_cosine", "SELECT b.vec_id, floor(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 10000 + 0.5) / 10000 AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND len(a.embedding) = len(b.embedding)")
def _(spark, d):
    """Cosine similarity of one vector to all of its dimension."""
    return _similar(spark, d)


def _similar(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", C("embedding").cast("array<double>").alias("v"))
    one = df.where("vec_id = 0").select(C("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q"))
    return df.join(F.broadcast(one), F.size("v") == F.size("q")).select("vec_id", (F.floor(cosine * 10000 + 0.5) / 10000).alias("similarity"))


@query("srt_09_nearest", "SELECT vec_id FROM (SELECT b.vec_id, floor(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 10000 + 0.5) / 10000 AS s FROM embeddings a, embeddings b WHERE a.vec_id = 0) ORDER BY s DESC, vec_id LIMIT 20")
def _(spark, d):
    return _similar(spark, d).orderBy(F.desc("similarity"), "vec_id").select("vec_id").limit(20)


@query("arr_05_json_path", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INT), 0) AS k, 0 AS n FROM events")
def _(spark, d):
    v = F.try_parse_json("props")
    n = F.coalesce(F.size(F.try_variant_get(v, "$.list", "array<string>")), F.lit(0))
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "int"), F.lit(0)).alias("k"), F.greatest(n, F.lit(0)).alias("n"))


@query("arr_06_double_encoded", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract(props, '$.k') AS INT) END AS k, CASE WHEN event_id % 4 < 3 THEN CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END END AS layers FROM events")
def _(spark, d):
    """JSON as it stands, encoded once more or twice more, and broken: what was encoded again is opened, what can't be read is null."""
    wrapped = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    k = C("event_id") % 4
    stored = F.when(k == 0, C("props")).when(k == 1, wrapped(C("props"))).when(k == 2, wrapped(wrapped(C("props")))).otherwise(F.concat(F.lit('"{'), "props"))
    repaired = labels.decoded_json(C("stored"))
    return table(spark, d, "events").select("event_id", stored.alias("stored")).select("event_id", repaired.alias("x")).select("event_id", F.try_variant_get("x.json", "$.k", "int").alias("k"), "x.layers")


@query("arr_02_flatten_distinct", "SELECT p_type, list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))) AS items FROM part GROUP BY 1")
def _(spark, d):
    words = table(spark, d, "part").select("p_type", F.explode(F.split("p_name", " ")).alias("item")).distinct()
    return words.groupBy("p_type").agg(F.array_sort(F.collect_list("item")).alias("items"))
