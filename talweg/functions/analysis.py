"""A document's analysis out of its text alone: kind, company, day of issue, and what a reader is told."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.dates import issued_date
from talweg.functions.labels import LEGAL_FORMS, document_type, document_type_in
from talweg.functions.text import fold, squashed

#: What a kind is called, and what a company's name stands behind.
KINDS = {"kbis": "Extrait Kbis", "urssaf": "Document URSSAF", "fiscale": "Attestation de régularité fiscale", "rib": "RIB", "cni": "Pièce d'identité"}
VIGILANCE = "Attestation de vigilance URSSAF"
NAMED = r"(?i)(?:D[ée]nomination(?:\s+sociale)?|Raison\s+sociale|Soci[ée]t[ée])\s*:?\s*([^\n]{2,80})"
SHORTEST = 15
LIGATURES = (("Œ", "OE"), ("œ", "oe"), ("Æ", "AE"), ("æ", "ae"))


def _plain(c: Column) -> Column:
    for a, b in LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(squashed(fold(F.upper(c))))


def _key(text: Column, plain: Column) -> Column:
    """`document_type`, out of the plain form where that is the same: a text without ligatures."""
    joined = reduce(or_, (F.contains(text, F.lit(a)) for a, _ in LIGATURES))
    return F.when(joined, document_type(text)).otherwise(document_type_in(plain))


def named_in(plain: Column, expected: Column) -> Column:
    """Whether a whole text, in its plain form, holds 0.6 of the expected name's words (three letters or more, legal forms aside), within words too; null without any."""
    words = F.filter(F.split(_plain(expected), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*LEGAL_FORMS))
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    return once(words, lambda ws: F.when(F.coalesce(F.size(ws), F.lit(0)) > 0, F.size(F.filter(ws, lambda w: F.contains(plain, w))) >= F.ceil(F.size(ws) * 0.6)))


def with_analysis(df: DataFrame, text: str, expected: Column, today: str, out: str = "analysis") -> DataFrame:
    """`df` with struct `out`: readable, kind, key, company, name_matches, issued, issues and summary. Null and short texts
    aren't readable; a company that the text doesn't name is the expected one if its words are there. The steps are columns
    of their own beside the packed row, so that a text is read once for each and no name of the input clashes."""
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), F.trim(F.coalesce(df[text], F.lit("")), F.lit(" \t\r\n")).alias("t"), expected.alias("expected"))
    company = F.nullif(F.regexp_replace(F.trim(F.regexp_extract("t", NAMED, 1)), r"\s+", " "), F.lit(""))
    rows = rows.withColumns({"plain": _plain(F.col("t")), "issued": issued_date(F.col("t"), today), "company": company})
    rows = rows.withColumns({"key": _key(F.col("t"), F.col("plain")), "there": named_in(F.col("plain"), F.col("expected")), "readable": F.length("t") >= SHORTEST})
    key, issued, there, readable = map(F.col, ("key", "issued", "there", "readable"))
    kind = F.lit("Document non identifié")
    for k, name in KINDS.items():
        kind = F.when(key == k, name).otherwise(kind)
    kind = F.when((key == "urssaf") & F.contains("plain", F.lit("VIGILANCE")), VIGILANCE).otherwise(kind)
    told = F.array_compact(F.array(F.when(~there, "the company is not the expected one"), F.when(issued == "", "no issue date found")))
    only = lambda c: F.when(readable, c)
    found = F.struct(
        readable.alias("readable"), only(kind).otherwise("Document").alias("kind"), only(key).otherwise("").alias("key"), only(F.coalesce("company", F.when(there, F.col("expected")))).alias("company"),
        only(there).alias("name_matches"), only(issued).otherwise("").alias("issued"), only(told).otherwise(F.array(F.lit("no text could be read"))).alias("issues"),
        F.when(~readable, "Document illisible.").when(issued == "", kind).otherwise(F.concat(kind, F.lit(" — délivré le "), issued)).alias("summary"),
    )
    return rows.select(*(F.col("row")[c].alias(c) for c in df.columns if c != out), found.alias(out))
