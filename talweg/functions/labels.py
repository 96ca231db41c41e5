"""Labels, names, levels and small texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.text import fold, squashed


def label_key(c: Column) -> Column:
    """A label without accents, case, quotes, dashes, underscores, doubled spaces and punctuation at its ends."""
    s = F.lower(fold(c))
    s = F.regexp_replace(s, "[’‘`´]", "'")
    s = F.regexp_replace(s, "[‐-―_-]", " ")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.regexp_replace(s, r"^[\s.,;:!?()\[\]]+|[\s.,;:!?()\[\]]+\z", "")


def compact_key(c: Column) -> Column:
    """The key with letters and digits alone, plus signs and hashes kept."""
    return F.regexp_replace(label_key(c), "[^a-z0-9+#]", "")


def canonical(terms: DataFrame, term: str, aliases: DataFrame, alias: str, name: str) -> DataFrame:
    """`terms` with column canonical: by exact key, else by compact key of three characters or more, else null. The dictionary side is the small one; the planner measures it."""
    known = aliases.select(label_key(F.col(alias)).alias("_k"), F.col(name).alias("_n"))
    short = aliases.select(compact_key(F.col(alias)).alias("_c"), F.col(name).alias("_m")).where("length(_c) >= 3")
    first = lambda df, k, v: df.groupBy(k).agg(F.min(v).alias(v))
    keyed = terms.withColumns({"_tk": label_key(F.col(term)), "_tc": compact_key(F.col(term))})
    joined = keyed.join(first(known, "_k", "_n"), F.col("_tk") == F.col("_k"), "left").join(first(short, "_c", "_m"), F.col("_tc") == F.col("_c"), "left")
    return joined.withColumn("canonical", F.coalesce("_n", "_m")).drop("_tk", "_tc", "_k", "_n", "_c", "_m")


#: Legal forms, which are no part of a company's name.
LEGAL_FORMS = ("SARL", "SAS", "SASU", "EURL", "SA", "SCI", "GROUPE", "EI")


def name_matches(expected: Column, candidate: Column) -> Column:
    """Whether 0.6 of a company's words (three letters or more, legal forms aside) are in the candidate; null if there is none to look for."""
    def norm(c: Column) -> Column:
        s = c
        for a, b in (("Œ", "OE"), ("œ", "oe"), ("Æ", "AE"), ("æ", "ae")):
            s = F.replace(s, F.lit(a), F.lit(b))
        return F.trim(F.regexp_replace(F.regexp_replace(fold(F.upper(s)), "[^A-Z0-9 ]", " "), " +", " "))

    words = F.filter(F.split(norm(expected), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*LEGAL_FORMS))
    has = F.split(norm(candidate), " ")
    found = F.size(F.filter(words, lambda w: F.array_contains(has, w)))
    return F.when(F.coalesce(F.size(words), F.lit(0)) > 0, found >= F.ceil(F.size(words) * 0.6))


#: The kinds of documents in the order in which they are looked for, and the phrases of which one marks them.
DOCUMENT_PHRASES = {
    "kbis": ("EXTRAIT KBIS", "K BIS", "GREFFE DU TRIBUNAL DE COMMERCE"),
    "urssaf": ("ATTESTATION DE VIGILANCE", "URSSAF"),
    "fiscale": ("REGULARITE FISCALE", "DECLARATIONS FISCALES", "ATTESTATION FISCALE"),
    "rib": ("RELEVE D IDENTITE BANCAIRE", " IBAN ", " BIC "),
    "cni": ("CARTE NATIONALE D IDENTITE", "PIECE D IDENTITE", "PASSEPORT", "TITRE DE SEJOUR"),
}


def document_type(text: Column) -> Column:
    """The first kind of which a phrase is in the text in capitals without accents, whatever signs stand between its words; empty if none."""
    return document_type_in(squashed(fold(F.upper(text))))


def document_type_in(plain: Column) -> Column:
    """`document_type` of a text in its plain form. That is a lambda's argument, so that a text is made plain once, not for every phrase."""
    def kind_of(padded: Column) -> Column:
        kind = F.lit("")
        for name, phrases in reversed(DOCUMENT_PHRASES.items()):
            there = F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(padded, p))
            kind = F.when(there, name).otherwise(kind)
        return kind

    return F.get(F.transform(F.array(F.concat(F.lit(" "), plain, F.lit(" "))), kind_of), 0)


def phone_e164(c: Column) -> Column:
    d = F.regexp_replace(F.regexp_replace(c, r"\(0\)", ""), "[^0-9+]", "")
    return F.when(d.rlike(r"^0[1-9]\d{8}\z"), F.concat(F.lit("+33"), F.substr(d, F.lit(2)))).when(d.rlike(r"^0033[1-9]\d{8}\z"), F.concat(F.lit("+"), F.substr(d, F.lit(3)))).when(d.rlike(r"^\+[1-9]\d{6,14}\z"), d)


#: Test scores and what they stand for, from the highest, and the level below the last.
LANGUAGE_TESTS = ((r"toeic\D{0,8}(\d{3,4})", ((945, "C1"), (785, "B2"), (550, "B1")), "A2"), (r"toefl\D{0,8}(\d{2,3})", ((95, "C1"), (72, "B2")), "B1"), (r"tcf\D{0,8}(\d{3})", ((600, "C1"), (500, "B2"), (400, "B1")), "A2"))
#: The levels and the words that name them, in the order in which they are looked for.
LANGUAGE_WORDS = (
    (r"(?U)\b(c2|bilingue|langue\s+maternelle|maternelle|nati[fv]e?s?|courant\s*\/?\s*bilingue)\b", "C2"),
    (r"(?U)\b(c1|courant|fluent|avance|professionnel\s+complet|full\s+professional)\b", "C1"),
    (r"(?U)\b(b2|intermediaire\s+avance|professionnel|upper[\s-]intermediate|bon\s+niveau)\b", "B2"),
    (r"(?U)\b(b1|intermediaire|intermediate|niveau\s+scolaire\s+solide)\b", "B1"),
    (r"(?U)\b(a2|elementaire|elementary|scolaire)\b", "A2"),
    (r"(?U)\b(a1|debutant|notions?|beginner)\b", "A1"),
)


def language_level(c: Column) -> Column:
    """The best of what tests and words say, null if nothing."""
    s, found = F.lower(fold(c)), []
    for pattern, steps, below in LANGUAGE_TESTS:
        points = F.regexp_extract(s, pattern, 1).try_cast("int")
        level = F.lit(below)
        for least, name in reversed(steps):
            level = F.when(points >= least, name).otherwise(level)
        found.append(F.when(s.rlike(pattern), level))
    word = F.lit(None).cast("string")
    for pattern, name in reversed(LANGUAGE_WORDS):
        word = F.when(s.rlike(pattern), name).otherwise(word)
    return F.array_max(F.array(*found, word))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda s: s != "")


def filled(template: Column, values: Column) -> Column:
    """{{key}} replaced from a map; what is missing becomes dots, and a missing *Clause nothing."""
    done = F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))
    return F.regexp_replace(F.regexp_replace(done, r"\{\{\w*Clause\}\}", ""), r"\{\{\w+\}\}", "........")


def decoded_entities(c: Column) -> Column:
    """The five XML entities and the usual spaces; ampersands last."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def json_part(c: Column) -> Column:
    """The JSON object in a model's answer, fenced or in prose, null if it can't be read."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(F.nullif(inner, F.lit(""))).isNotNull(), inner)


def decoded_json(c: Column, most: int = 3) -> Column:
    """json (a variant) of a text that may hold JSON encoded as a text again, up to `most` times, and how many layers were opened; both null for a text that isn't JSON, or whose innermost text isn't."""
    state = F.struct(F.try_parse_json(c).alias("json"), F.lit(0).alias("layers"))

    def opened(s: Column, _: Column) -> Column:
        inner = F.try_variant_get(s["json"], "$", "string")
        again = F.schema_of_variant(s["json"]) == "STRING"
        return F.when(again, F.struct(F.try_parse_json(inner).alias("json"), (s["layers"] + 1).alias("layers"))).otherwise(s)

    done = F.aggregate(F.array_repeat(F.lit(0), most), state, opened)
    readable = done["json"].isNotNull()
    return F.struct(F.when(readable, done["json"]).alias("json"), F.when(readable, done["layers"]).alias("layers"))


def cleaned_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text: without blank lines, markers, lines of at most two distinct characters, and repeated short lines."""
    rows = df.select(key, F.posexplode(F.split(text, "\n")).alias("_at", "_raw")).withColumn("_line", F.trim("_raw"))
    few = F.size(F.array_distinct(F.filter(F.split("_line", ""), lambda x: x != ""))) <= 2
    kept = rows.where((F.col("_line") != "") & ~F.col("_line").isin("<!-- image -->", "---", "===", "***", "___") & ~(few & (F.length("_line") > 5)))
    seen = F.row_number().over(Window.partitionBy(key, "_line").orderBy("_at"))
    kept = kept.withColumn("_seen", seen).where("_seen = 1 or length(_line) >= 12")
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_line")))
    return kept.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["_line"]), "\n").alias(text))


def sectioned(df: DataFrame, key: str, text: str, sections: dict[str, str]) -> DataFrame:
    """key, line_no, section, line: lines under the last heading (# or ##) that a section's pattern knows."""
    rows = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    head = F.lower(F.regexp_extract("line", r"^#{1,2}\s+(.+)\z", 1))
    name = F.lit(None).cast("string")
    for section, pattern in reversed(sections.items()):
        name = F.when((head != "") & head.rlike(pattern), section).otherwise(name)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_own", name).withColumn("section", F.coalesce(F.last("_own", ignorenulls=True).over(w), F.lit("intro")))
    return marked.where("_own is null").select(key, "line_no", "section", "line")
