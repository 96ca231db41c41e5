"""Rules that make records out of short texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions import dates
from talweg.functions.checks import digits_status
from talweg.functions.scores import ratio
from talweg.functions.text import fold

# Words that stand between the two dates of a period, signs that part the items of a list, the words for `and`,
# and the parts of words that name degrees by level, the highest first; a blank is the edge of a word.
BETWEEN = ("-", "--", "a", "au", "to", "until", "jusqu", "jusqua", "jusquau", "jusquen")
PARTING = (",", ";", "•", "·", "|")
AND = ("/", "&", "et")
DEGREES = {
    "bac+8": (" doctorat", "phd "),
    "bac+5": (" master", "mba", "msc", "ingenieur", "dess", "bac+5 "),
    "bac+3": (" licence", "bachelor", "bac+3 "),
    "bac+2": (" bts", "dut", "but", "bac+2 "),
}


def _tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def with_period(df: DataFrame, text: str) -> DataFrame:
    """`df` with begin, finish, running: two dates around the first word that may stand between dates, itself between spaces. A mark of a running mission counts in the end alone; without such a word the whole is one date, which is both ends unless it runs.

    The steps are columns of their own: written as one expression they would not fit into one generated method.
    """
    words = _tokens(fold(F.coalesce(text, F.lit(""))))
    bare = F.transform("_words", lambda w: F.lower(F.translate(w, "–—−’'`", "---")))
    inner = F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("_words") - 1))
    at = F.get(F.filter(inner, lambda k: (k < F.size("_words")) & F.get("_bare", k - 1).isin(*BETWEEN)), 0)
    joined = lambda w: F.array_join(w, " ")
    out = df.withColumn("_words", words).withColumn("_bare", bare).withColumn("_at", at)
    parted = F.col("_at").isNotNull()
    out = out.withColumns({"_s": joined("_words"), "_left": F.when(parted, joined(F.slice("_words", F.lit(1), F.greatest(F.col("_at") - 1, F.lit(0))))), "_right": F.when(parted, joined(F.slice("_words", F.coalesce(F.col("_at") + 1, F.lit(1)), F.size("_words"))))})
    out = out.withColumn("_dates", F.explode(F.array(F.transform(F.array("_left", "_right", "_s"), lambda x: dates.month_of(x)))))
    left, right, whole = (F.get("_dates", k) for k in range(3))
    two = parted & left.isNotNull()
    running = F.when(F.col("_s") == "", False).when(two, dates.still_running(F.col("_right"))).otherwise(dates.still_running(F.col("_s")))
    out = out.withColumns({"begin": F.when(two, left).otherwise(whole), "running": running})
    out = out.withColumn("finish", F.when(~F.col("running"), F.when(two, right).otherwise(whole)))
    return out.drop("_words", "_bare", "_at", "_s", "_left", "_right", "_dates")


def period_label(start: Column, end: Column, running: Column) -> Column:
    """MM/YYYY – MM/YYYY, `depuis MM/YYYY` while it runs, one date if both are the same."""
    one = lambda v: F.when(F.contains(v, F.lit("-")), F.concat(F.substring(v, 6, 2), F.lit("/"), F.substring(v, 1, 4))).otherwise(v)
    same = end.isNull() | (end == "") | (end == start)
    return F.when(start.isNull() | (start == ""), "").when(running, F.concat(F.lit("depuis "), one(start))).when(same, one(start)).otherwise(F.concat(one(start), F.lit(" – "), one(end)))


def last_year(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit("((?:19|20)[0-9]{2})"), F.lit(1)), F.lit(-1)).cast("int")


def split_list(text: Column) -> Column:
    """Items of 2 to 44 characters; a slash, an ampersand or a word for `and` parts only where it stands alone between spaces. Dashes and colons before an item and full stops after it go."""
    alone = rf"(?i)(?<=\s)(?:{'|'.join(AND)})(?=\s)"
    bars = F.regexp_replace(F.translate(text, "".join(PARTING), "\u0001" * len(PARTING)), alone, "\u0001")
    items = F.split(bars, "\u0001")
    cut = F.transform(items, lambda x: F.rtrim(F.ltrim(x, F.lit("-–—: \n\t")), F.lit(". \n\t")))
    return F.filter(cut, lambda x: F.length(x).between(2, 44))


def degree_level(text: Column) -> Column:
    """The highest level of which a name is in the text; blanks around a plus don't count. Empty if none."""
    words = F.regexp_replace(F.regexp_replace(F.lower(fold(text)), r"\s*\+\s*", "+"), "[^a-z0-9+]+", " ")
    padded, level = F.concat(F.lit(" "), words, F.lit(" ")), F.lit("")
    for name, degrees in reversed(DEGREES.items()):
        level = F.when(F.exists(F.array(*map(F.lit, degrees)), lambda d: F.contains(padded, d)), name).otherwise(level)
    return level


def need_of_text(text: Column) -> Column:
    """title (first line, 80 characters), least (years asked for) and level, without any model."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    years = F.regexp_extract(text, r"(?i)(\d{1,2})\s*(?:ans|années)", 1).try_cast("int")
    level = F.when(years <= 2, "junior").when(years <= 5, "confirmé").when(years <= 9, "senior").when(years > 9, "expert").otherwise("")
    return F.struct(F.coalesce(F.substring(F.get(lines, 0), 1, 80), F.lit("")).alias("title"), F.coalesce(years, F.lit(0)).alias("least"), level.alias("level"))


def years_source(months_years: Column, readable: Column, announced: Column) -> Column:
    """years and where they come from: periods, what was announced, a lump for unreadable periods, or nothing."""
    told = F.floor(F.trim(announced).try_cast("double") + 0.5).cast("int")
    return F.when(readable, F.struct(months_years.alias("years"), F.lit("periods").alias("source"))).when(told > 0, F.struct(told.alias("years"), F.lit("announced").alias("source"))).when(months_years > 0, F.struct(months_years.alias("years"), F.lit("lump").alias("source"))).otherwise(F.struct(F.lit(0).alias("years"), F.lit("none").alias("source")))


def lookup_number(text: Column) -> Column:
    """The company number to look up, of 9 or 14 digits whose first 9 pass their check; else null."""
    d = F.regexp_replace(text, "[^0-9]", "")
    nine = F.when(F.length(d).isin(9, 14), F.substring(d, 1, 9))
    return F.when(digits_status(nine, 9) == "valide", nine)


def skill_similar(a: Column, b: Column) -> Column:
    """Equal, one within the other, or matching blocks over 0.82."""
    return F.contains(a, b) | F.contains(b, a) | (ratio(a, b) > 0.82)


def opinion(reply: Column) -> Column:
    """score (0 to 100) and strengths (four at most) of a model's reply, nulls if it can't be read."""
    r = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "score string, strengths array<string>")
    return F.struct(F.when(r["score"].try_cast("double").isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), r["score"].try_cast("double")))).alias("score"), F.slice(r["strengths"], 1, 4).alias("strengths"))


def title_axis(strong_shared: Column, in_missions: Column, family: Column, weak_shared: Column, lexical: Column) -> Column:
    """Ordered: the same strong role, met in missions, the same family, a weak role; else what words share."""
    return F.when(strong_shared, 1.0).when(in_missions, 0.85).when(family, 0.6).when(weak_shared, 0.45).otherwise(0.1 + lexical * 0.3)
