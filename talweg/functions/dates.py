"""Dates out of text as column expressions. The current day is a parameter, never the clock."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from talweg.functions.text import fold

#: Month names, without accents, in French and English.
MONTHS = {
    "janvier": 1, "janv": 1, "jan": 1, "january": 1, "fevrier": 2, "fevr": 2, "fev": 2, "feb": 2, "february": 2, "mars": 3, "mar": 3, "march": 3,
    "avril": 4, "avr": 4, "apr": 4, "april": 4, "mai": 5, "may": 5, "juin": 6, "jun": 6, "june": 6, "juillet": 7, "juil": 7, "jul": 7, "july": 7,
    "aout": 8, "aou": 8, "aug": 8, "august": 8, "septembre": 9, "sept": 9, "sep": 9, "september": 9, "octobre": 10, "oct": 10, "october": 10,
    "novembre": 11, "nov": 11, "november": 11, "decembre": 12, "dec": 12, "december": 12,
}
FIRST_YEAR, LAST_YEAR = 1950, 2100


def _month_number(name: Column) -> Column:
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in MONTHS.items())), name)


def _shown(year: Column, month: Column) -> Column:
    """YYYY-MM, the year alone where the month is none, null for a year out of bounds."""
    bounded = year.between(FIRST_YEAR, LAST_YEAR)
    return F.when(bounded, F.concat_ws("-", year.cast("string"), F.when(month.between(1, 12), F.lpad(month.cast("string"), 2, "0"))))


def month_of(text: Column) -> Column:
    """YYYY-MM or YYYY of free text, else null.

    The text is cut into figures, words and the signs between them, each with the two that follow. The first pair of
    figures decides in this order of kinds, even if its year is out of bounds: two figures or fewer before four, four
    before two or fewer, three figures of which the middle is the month, a word before four figures (one full stop and
    blanks may part them) if it is a month's name, and at last four figures alone.
    """
    none = F.lit(None).cast("int")
    number = lambda v: v.try_cast("int")
    figures = lambda v, low, high: F.coalesce(v.rlike("^[0-9]+$") & F.length(v).between(low, high), F.lit(False))
    sign = lambda v: F.coalesce(v.isin("/", ".", "-"), F.lit(False))

    def judged(r: Column, k: Column) -> Column:
        """kind, place, year and month of a piece; null if it begins none."""
        a, x, b, y, c = (r[str(i)] for i in range(5))
        told = lambda kind, year, month: F.struct(F.lit(kind).alias("kind"), k.alias("place"), year.alias("y"), month.alias("m"))
        century = F.when(F.length(c) == 2, number(c) + 2000).otherwise(number(c))
        word = F.coalesce(a.rlike("^[a-z]{3,10}$") & x.rlike(r"(?U)^\.?\s+$"), F.lit(False)) & figures(b, 4, 4)
        return (
            F.when(figures(a, 1, 2) & sign(x) & figures(b, 4, 4), told(1, number(b), number(a)))
            .when(figures(a, 4, 4) & sign(x) & figures(b, 1, 2), told(2, number(a), number(b)))
            .when(figures(a, 1, 2) & sign(x) & figures(b, 1, 2) & sign(y) & figures(c, 2, 4), told(3, century, number(b)))
            .when(word, told(4, number(b), _month_number(a)))
            .when(figures(a, 4, 4), told(5, number(a), none))
        )

    def decided(found: Column) -> Column:
        best = F.array_min(found)
        year = F.array_min(F.filter(found, lambda f: f["kind"] == 5))
        return F.when((best["kind"] == 4) & best["m"].isNull(), _shown(year["y"], none)).otherwise(_shown(best["y"], best["m"]))

    # Each step is a lambda's argument, so that it is computed once.
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    pieces = F.regexp_extract_all(F.lower(fold(text)), F.lit(r"(?U)(\w+|\W+)"), F.lit(1))
    rows = lambda p: F.arrays_zip(*(F.slice(p, k, F.greatest(F.size(p), F.lit(1))) for k in range(1, 6)))
    return once(pieces, lambda p: once(F.transform(rows(p), judged), decided))


def month_number(iso: Column) -> Column:
    """Absolute month of YYYY-MM; a year alone is its January, and what is no number counts 0."""
    part = lambda k, other: F.coalesce(F.regexp_extract(iso, r"^([^-]*)(?:-([^-]*))?", k).try_cast("int"), F.lit(other))
    return part(1, 0) * 12 + part(2, 1)


def months_between(start: Column, end: Column) -> Column:
    """Both ends included, 0 if reversed."""
    return F.greatest(F.lit(0), month_number(end) - month_number(start) + 1)


def strict_date(text: Column) -> Column:
    """date (YYYY-MM-DD, empty unless real and in the years allowed) and status: absent, unreadable, impossible, read."""
    s = F.coalesce(F.trim(text), F.lit(""))
    iso, fr = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    plain = F.lower(fold(s))
    written = r"^(?:le[ \t\n\r ]+)?([0-9]{1,2})[ \t\n\r ]+([a-z]{3,10})\.?[ \t\n\r ]+([0-9]{4})$"
    word = _month_number(F.regexp_extract(plain, written, 2)).cast("string")
    pick = lambda i, f, w: F.when(s.rlike(iso), F.regexp_extract(s, iso, i)).when(s.rlike(fr), F.regexp_extract(s, fr, f)).when(word.isNotNull(), w)
    y, m, d = (pick(i, f, w).try_cast("int") for i, f, w in ((1, 3, F.regexp_extract(plain, written, 3)), (2, 2, word), (3, 1, F.regexp_extract(plain, written, 1))))
    made = F.format_string("%04d-%02d-%02d", y, m, d)
    real = F.try_to_date(made, "yyyy-MM-dd").isNotNull() & y.between(FIRST_YEAR, LAST_YEAR)
    status = F.when(s == "", "absent").when(y.isNull(), "unreadable").when(real, "read").otherwise("impossible")
    return F.struct(F.when(F.coalesce(real, F.lit(False)), made).otherwise("").alias("date"), status.alias("status"))


def plausibility(first: Column, second: Column, today: str) -> Column:
    """Statuses of two dates of one document, of which the first can't follow the second: absent, unreadable, impossible, future, inconsistent, plausible."""
    def one(x: Column) -> Column:
        return F.when(x["status"] != "read", x["status"]).when(x["date"] > today, "future").otherwise("plausible")

    a, b = strict_date(first), strict_date(second)
    wrong = (one(a) == "plausible") & (one(b) == "plausible") & (a["date"] > b["date"])
    return F.struct(*[F.when(wrong, "inconsistent").otherwise(one(x)).alias(n) for n, x in (("first", a), ("second", b))])


def still_running(end: Column) -> Column:
    """An end that is missing, or says so."""
    s = F.lower(fold(F.coalesce(end, F.lit(""))))
    return (F.trim(s) == "") | s.rlike(r"(?U)\b(en cours|actuel(le)?|actuellement|present|aujourd.?hui|ce jour|now|current|today|ongoing)\b")


#: What stands before a document's day of issue, in capitals without accents and signs; the months in full; how many characters before a date count.
ISSUED = r"DELIVR|A JOUR AU|EDITE? LE|ETABLI LE|EMISE? LE|FAIT A? ?[A-Z ]*LE|EN DATE DU|DATE DE DELIVRANCE"
FULL_MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")
BEFORE = 55


def issued_date(text: Column, today: str) -> Column:
    """The day on which a document was issued, out of its whole text: the latest date with a word of ISSUED in the BEFORE
    characters before it, else the latest that isn't to come, else the earliest; empty without any. Years count from 2000 to
    the one after `today`'s. Null counts as empty.

    A date is eight characters or more, so its context lies in the seven dates and pieces before it.
    """
    t = F.coalesce(text, F.lit(""))
    last = int(today[:4]) + 1

    def plain(c: Column) -> Column:
        for a, b in (("Œ", "OE"), ("œ", "oe"), ("Æ", "AE"), ("æ", "ae")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return F.regexp_replace(F.regexp_replace(fold(F.upper(c)), "[^A-Z0-9 ]", " "), " +", " ")

    # Each step is a lambda's argument, so that a text is read once for each pattern.
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)

    def candidates(pattern: str, in_words: bool) -> Column:
        def judged(one: Column, i: Column, found: Column, pieces: Column) -> Column:
            behind = F.transform(F.sequence(F.greatest(i - 7, F.lit(0)), i), lambda j: F.concat(F.get(pieces, j), F.when(j == i, "").otherwise(F.get(found, j))))
            part = lambda k: F.regexp_extract(one, pattern, k)
            m = F.array_position(F.array(*map(F.lit, FULL_MONTHS)), F.lower(F.trim(plain(part(2))))).cast("int") if in_words else part(2).try_cast("int")
            d, y = part(1).try_cast("int"), part(3).try_cast("int")
            near = plain(F.right(F.array_join(behind, ""), F.lit(BEFORE))).rlike(ISSUED)
            return once(
                F.struct(d.alias("d"), m.alias("m"), y.alias("y")),
                lambda x: F.when(x["m"].between(1, 12) & x["y"].between(2000, last) & (F.lit(True) if in_words else x["d"].between(1, 31)), F.struct(F.format_string("%04d-%02d-%02d", x["y"], x["m"], x["d"]).alias("iso"), near.alias("near"))),
            )

        pieces_of = lambda found: once(F.split(t, pattern, -1), lambda pieces: F.transform(found, lambda one, i: judged(one, i, found, pieces)))
        return once(F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)), lambda found: F.when(F.size(found) > 0, F.array_compact(pieces_of(found))).otherwise(F.array().cast("array<struct<iso:string,near:boolean>>")))

    signs = candidates(r"([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4})", False)
    words = candidates(r"([0-9]{1,2})\s+([A-Za-zûéèàêôä]+)\s+([0-9]{4})", True)
    days = lambda every, keep: F.transform(F.filter(every, keep), lambda x: x["iso"])
    chosen = lambda e: F.coalesce(F.array_max(days(e, lambda x: x["near"])), F.array_max(days(e, lambda x: x["iso"] <= today)), F.array_min(days(e, lambda x: F.lit(True))))
    return F.coalesce(once(F.concat(signs, words), chosen), F.lit(""))
