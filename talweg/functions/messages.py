"""What a reader is told of values that fail a check: one text for each kind of failure, in a fixed order. Values stay as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEPT = "; the value is kept"


def _told(status: Column, value: Column, name: str, texts: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for kind, why in texts.items():
        out = F.when(status == kind, F.concat(F.lit(f"{name} '"), value, F.lit(f"': {why}{KEPT}"))).otherwise(out)
    return out


def company_messages(status: Column, siren: Column, siret: Column) -> Column:
    """Of checks.company_numbers(): the shorter number first, and once for both if they are of two companies."""
    length = {"siren": (siren, "9"), "siret": (siret, "14")}
    one = [_told(status[n], v, n.upper(), {"format_invalide": f"{k} digits are expected", "cle_invalide": "its check digit is wrong"}) for n, (v, k) in length.items()]
    both = F.when(status["siret"] == "discordant", F.concat(F.lit("SIRET '"), siret, F.lit("' is not of the company SIREN '"), siren, F.lit(f"'{KEPT}")))
    return F.array_compact(F.array(*one, both))


def account_messages(status: Column, iban: Column, bic: Column) -> Column:
    """Of checks.iban_bic()."""
    first = _told(status["iban"], iban, "IBAN", {"format_invalide": "not an account number's form", "cle_invalide": "its check digits are wrong"})
    second = _told(status["bic"], bic, "BIC", {"format_invalide": "8 or 11 characters are expected", "pays_discordant": "its country is not the account's"})
    return F.array_compact(F.array(first, second))


def date_messages(status: Column, first: tuple[str, Column], second: tuple[str, Column]) -> Column:
    """Of dates.plausibility(), with the names and values of both dates. An absent date has no message."""
    kinds = {"unreadable": "not a date's form", "impossible": "no day of the calendar", "future": "a day to come"}
    one = [_told(status[k], v, name, kinds) for k, (name, v) in (("first", first), ("second", second))]
    both = F.when(status["first"] == "inconsistent", F.concat(F.lit(f"{first[0]} '"), first[1], F.lit(f"' is after {second[0]} '"), second[1], F.lit(f"'{KEPT}")))
    return F.array_compact(F.array(*one, both))
