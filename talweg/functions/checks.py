"""Identifier and number checks as column expressions. A value that fails is kept; its status says why.

Statuses: absent, format_invalide, cle_invalide, discordant, pays_discordant, valide. Null and blank values are absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _or_absent(compact: Column, status: Column) -> Column:
    return F.when(compact.isNull() | (compact == ""), "absent").otherwise(status)


def digits_status(value: Column, length: int) -> Column:
    """Luhn check of a number of 9 or 14 digits; of 14, the first 9 must pass too."""
    c = F.regexp_replace(value, "[ \\t\\n\\r\\u00a0\\u202f.\\-]", "")
    ok = _luhn(c) & _luhn(F.substring(c, 1, 9)) if length == 14 else _luhn(c)
    return _or_absent(c, F.when(~c.rlike(f"^[0-9]{{{length}}}\\z"), "format_invalide").when(ok, "valide").otherwise("cle_invalide"))


def company_numbers(siren: Column, siret: Column) -> Column:
    """Both statuses; two valid numbers of different companies are both discordant."""
    a, b = digits_status(siren, 9), digits_status(siret, 14)
    only = lambda v: F.regexp_replace(v, "[^0-9]", "")
    apart = (a == "valide") & (b == "valide") & (F.substring(only(siret), 1, 9) != only(siren))
    return F.struct(F.when(apart, "discordant").otherwise(a).alias("siren"), F.when(apart, "discordant").otherwise(b).alias("siret"))


def _compact(value: Column, seps: str) -> Column:
    return F.translate(F.regexp_replace(value, seps, ""), _UPPER.lower(), _UPPER)


def mod97(compact: Column) -> Column:
    """Remainder of the rearranged account number, character by character."""
    moved = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    step = lambda acc, ch: F.when(ch.between("0", "9"), (acc * 10 + F.ascii(ch) - 48) % 97).otherwise((acc * 100 + F.ascii(ch) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(step(acc, ch)))


def iban_bic(iban: Column, bic: Column) -> Column:
    seps = "[ \\t\\n\\r\\u00a0\\u202f\\-]"
    i, b = _compact(iban, seps), _compact(bic, seps)
    shape = i.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}\\z") & ((F.substring(i, 1, 2) != "FR") | (F.length(i) == 27))
    si = _or_absent(i, F.when(~shape, "format_invalide").when(mod97(i) == 1, "valide").otherwise("cle_invalide"))
    sb = _or_absent(b, F.when(b.rlike("^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\\z"), "valide").otherwise("format_invalide"))
    apart = (si == "valide") & (sb == "valide") & (F.substring(i, 1, 2) != F.substring(b, 5, 2))
    return F.struct(si.alias("iban"), F.when(apart, "pays_discordant").otherwise(sb).alias("bic"))


def weighted_check_digit(value: Column) -> Column:
    """Machine-readable zone: values (digits, A = 10 ..., < = 0) weighted 7, 3, 1, modulo 10."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    number = lambda c: F.when(c == "<", 0).when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    weighted = F.transform(chars, lambda c, k: number(c) * F.get(F.array(F.lit(7), F.lit(3), F.lit(1)), k % 3))
    return (F.aggregate(weighted, F.lit(0), lambda a, x: a + x) % 10).cast("string")


def social_security_valid(value: Column) -> Column:
    """15 digits with key; 2A and 2B count as 19 and 18."""
    c = F.upper(F.regexp_replace(value, "[ .]", ""))
    number = F.replace(F.replace(F.substring(c, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    return F.coalesce((F.length(c) == 15) & number.rlike("^[0-9]{13}$") & (97 - number.try_cast("long") % 97 == F.substring(c, 14, 2).try_cast("int")), F.lit(False))


def vat_valid(value: Column) -> Column:
    c = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    siren = F.substring(c, 5, 9)
    return F.coalesce(c.rlike("^FR[0-9]{11}$") & _luhn(siren) & ((12 + 3 * (siren.try_cast("long") % 97)) % 97 == F.substring(c, 3, 2).try_cast("int")), F.lit(False))


def phone_valid(value: Column) -> Column:
    c = F.regexp_replace(value, "[^0-9]", "")
    return F.when(c.startswith("33"), (F.length(c) == 11) | ((F.length(c) == 12) & (F.substring(c, 3, 1) == "0"))).otherwise(F.length(c) == 10)


def number_form(value: Column) -> Column:
    """A number's lexical normal form; other texts as they are, blank ones empty."""
    s = F.coalesce(F.trim(value), F.lit(""))
    body = F.regexp_replace(s, "^[+-]", "")
    whole = F.regexp_replace(F.regexp_extract(body, r"^([0-9]*)", 1), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(body, r"\.([0-9]*)$", 1), "0+$", "")
    out = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    return F.when(~s.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\z"), s).otherwise(F.when(s.startswith("-") & (out != "0"), F.concat(F.lit("-"), out)).otherwise(out))
