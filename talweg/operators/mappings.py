"""Extraction envelopes to the values of a form, by tables of fields: source key, target key, normaliser.

An envelope is JSON text: schema_name, result (an object whose fields are {value} or {amount, currency}) and validation
(valid, warnings, errors). A mapping is data, the plan is generated from it; a normaliser that isn't known is an error when
the plan is made. Everything is one struct column, so that no name of the input clashes:

* refused: why the envelope is none of this mapping (`json`, `schema`, `result`), else null; then the rest is null.
* values: map of target key to text, empty where nothing was read. Numbers and codes that fail their check stay.
* issues: what the reader is told; warnings: what was lost or doubtful on the way, the envelope's own ones last.
* name, name_matches (null without an expected name), issued (a day, or empty), readable, valid, kind, summary.

An envelope of which no identifying value was read isn't readable; one that its validation rejects is readable, not valid.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions import checks, dates, labels, messages

Field = tuple[str, str, str]


@dataclass(frozen=True)
class Mapping:
    kind: str
    name: str
    fields: tuple[Field, ...]
    identifying: tuple[str, ...]
    issued: str | None = "issued_date"
    company: tuple[str, str] | None = None
    account: tuple[str, str] | None = None
    ordered: tuple[str, str] | None = None


#: The fields of each schema and their keys in the form.
MAPPINGS = {
    "kbis": Mapping("Extrait Kbis", "company_name", (
        ("siren", "siren", "text"), ("siret_siege", "siret", "text"), ("legal_form", "formeJuridique", "text"), ("registration_date", "dateImmatriculation", "date"),
        ("rcs_number", "rcsNumber", "text"), ("registered_address", "adresseSiege", "text"), ("activity_code", "codeActivite", "text"),
        ("legal_representative", "representantLegal", "text"), ("share_capital", "capitalSocial", "money"),
    ), ("company_name", "siren", "siret_siege"), company=("siren", "siret_siege")),
    "urssaf": Mapping("Attestation de vigilance URSSAF", "company_name", (
        ("siren", "siren", "text"), ("siret", "siret", "text"), ("registered_address", "adresseSiege", "text"), ("valid_until", "dateValidite", "date"),
        ("security_code", "codeSecurite", "text"), ("urssaf_agency", "organismeUrssaf", "text"), ("employee_count", "nombreSalaries", "number"),
    ), ("company_name", "siren", "siret"), company=("siren", "siret")),
    "fiscale": Mapping("Attestation de régularité fiscale", "company_name", (
        ("siren", "siren", "text"), ("siret", "siret", "text"), ("tax_office", "serviceImpots", "text"), ("situation_date", "dateSituation", "date"),
        ("regularity_statement", "mentionRegularite", "text"),
    ), ("company_name", "siren", "siret"), company=("siren", "siret"), ordered=("situation_date", "issued_date")),
    "rib": Mapping("RIB", "account_holder", (
        ("account_holder", "titulaireCompte", "text"), ("iban", "iban", "text"), ("bic", "bic", "text"), ("bank_name", "nomBanque", "text"),
    ), ("account_holder", "iban", "bic"), issued=None, account=("iban", "bic")),
}


class _Reader:
    """The columns that a plan needs of an envelope, each named once: texts first, then what is read out of them."""

    def __init__(self) -> None:
        self.texts: dict[str, Column] = {}
        self.read: dict[str, Column] = {}

    def get(self, key: str, part: str = "value") -> Column:
        name = f"{part} {key}"
        self.texts[name] = F.try_variant_get("v", f"$.result.{key}.{part}", "string")
        return F.col(f"`{name}`")

    def once(self, name: str, value: Column) -> Column:
        self.read[name] = value
        return F.col(f"`{name}`")

    def date(self, key: str) -> Column:
        return self.once(f"date {key}", dates.strict_date(self.get(key)))


def _lost_date(key: str, r: _Reader) -> Column:
    status = r.date(key)["status"]
    return F.when(status.isin("unreadable", "impossible"), F.concat(F.lit(f"{key}: "), status, F.lit(" date '"), F.trim(r.get(key)), F.lit("' left out")))


def _date(key: str, target: str, r: _Reader) -> tuple[dict[str, Column], list[Column]]:
    return {target: r.date(key)["date"]}, [_lost_date(key, r)]


def _numeric(key: str, target: str, r: _Reader, part: str = "value") -> tuple[dict[str, Column], list[Column]]:
    form = r.once(f"number {key}", checks.number_form(r.get(key, part)))
    ok = form.rlike(r"^-?[0-9]+(\.[0-9]+)?\z")
    return {target: F.when(ok, form).otherwise("")}, [F.when((form != "") & ~ok, F.concat(F.lit(f"{key}: no number '"), form, F.lit("' left out")))]


def _money(key: str, target: str, r: _Reader) -> tuple[dict[str, Column], list[Column]]:
    values, lost = _numeric(key, target, r, "amount")
    currency = F.upper(F.coalesce(r.get(key, "currency"), F.lit("")))
    return values | {f"{target}Devise": currency}, [*lost, F.when(~currency.isin("", "EUR"), F.concat(F.lit(f"{key}: the amount is in "), currency))]


NORMALISERS: dict[str, Callable] = {
    "text": lambda key, target, r: ({target: F.coalesce(r.get(key), F.lit(""))}, []),
    "date": _date,
    "number": _numeric,
    "money": _money,
}


def mapped(df: DataFrame, envelope: str, schema: str, today: str, expected: Column | None = None, out: str = "mapped", mapping: Mapping | None = None) -> DataFrame:
    """`df` with struct `out`: the envelope of each row by the mapping of its schema, against the name expected."""
    m = mapping or MAPPINGS[schema]
    if unknown := {rule for _, _, rule in m.fields} - NORMALISERS.keys():
        raise ValueError(f"unknown normalisers: {sorted(unknown)}")
    v, r = F.col("v"), _Reader()
    raw = r.get
    values: dict[str, Column] = {}
    told: list[Column] = []
    for key, target, rule in m.fields:
        made, lost = NORMALISERS[rule](key, target, r)
        values |= made
        told += lost
    name = F.nullif(raw(m.name), F.lit(""))
    readable = F.exists(F.array(*(F.coalesce(raw(k), F.lit("")) for k in m.identifying)), lambda x: x != "")
    found = [F.array().cast("array<string>")]
    if m.company:
        a, b = map(raw, m.company)
        found.append(messages.company_messages(r.once("company", checks.company_numbers(a, b)), a, b))
    if m.account:
        a, b = map(raw, m.account)
        found.append(messages.account_messages(r.once("account", checks.iban_bic(a, b)), a, b))
        found.append(F.array_compact(F.array(F.when(F.coalesce(a, F.lit("")) == "", "no account number found"))))
    if m.ordered:
        a, b = map(raw, m.ordered)
        found.append(messages.date_messages(r.once("order", dates.plausibility(a, b, today)), (m.ordered[0], a), (m.ordered[1], b)))
    issued, missing = F.lit(""), F.lit(None).cast("string")
    if m.issued:
        read = r.date(m.issued)
        issued = read["date"]
        told.append(_lost_date(m.issued, r))
        missing = F.when(read["status"].isin("absent", *([] if m.ordered else ["unreadable", "impossible"])), "no issue date found")
    failed = r.once("failed", F.concat(*found))
    rejected = F.coalesce(F.try_variant_get(v, "$.validation.valid", "boolean") == F.lit(False), F.lit(False))
    matches = r.once("matches", labels.name_matches(F.col("sought"), F.coalesce(name, F.lit(""))))
    doubtful = F.array_compact(F.array(F.when(rejected, "the extraction was not validated"), F.when(~matches, "the name is not the expected one")))
    issues = F.when(readable, F.concat(doubtful, failed, F.array_compact(F.array(missing)))).otherwise(F.array(F.lit("no text could be read")))
    listed = lambda path, what: F.transform(F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>")), lambda x: F.concat(F.lit(what), x))
    own = F.concat(listed("$.result.extraction_notes", "note: "), listed("$.validation.warnings", "validation: "), listed("$.validation.errors", "validation: "))
    is_object = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.result", "variant")).startswith("OBJECT"), F.lit(False))
    right = F.coalesce(F.try_variant_get(v, "$.schema_name", "string") == schema, F.lit(False))
    refused = F.when(v.isNull(), "json").when(~right, "schema").when(~is_object, "result")
    shown = F.when(readable, issued).otherwise("")
    parts = {
        "values": F.create_map(*(x for k, c in values.items() for x in (F.lit(k), c))),
        "name": F.when(readable, name),
        "name_matches": F.when(readable, matches),
        "issued": shown,
        "readable": readable,
        "valid": readable & ~rejected,
        "kind": F.when(readable, m.kind).otherwise("Document"),
        "summary": F.when(~readable, "Document illisible.").when(shown == "", m.kind).otherwise(F.concat(F.lit(f"{m.kind} — délivré le "), shown)),
        "issues": issues,
        "warnings": F.concat(F.array_compact(F.array(F.lit(None).cast("string"), *told)), failed, own),
    }
    whole = F.struct(refused.alias("refused"), *(F.when(refused.isNull(), c).alias(k) for k, c in parts.items()))
    sought = F.lit(None).cast("string") if expected is None else expected
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), F.try_parse_json(F.col(envelope)).alias("v"), sought.alias("sought"))
    rows = rows.withColumns(r.texts)
    first = {k: c for k, c in r.read.items() if k != "failed"}
    rows = rows.withColumns(first).withColumn("failed", r.read["failed"])
    return rows.select(*(F.col("row")[c].alias(c) for c in df.columns if c != out), whole.alias(out))
