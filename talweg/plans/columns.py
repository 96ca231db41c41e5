"""Rules of identifiers, dates, labels, records and scores over columns of the given tables.

The values that a rule reads are made of a row's own columns in one of several spellings, chosen by its id, in SQL that
Spark and DuckDB read alike; so an oracle states what must come out by construction, or computes it another way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import functions as F

from talweg.functions import checks, dates, labels, records, scores, text
from talweg.operators import mappings
from talweg.plans.registry import query
from talweg.sources.tables import table

C = F.col
Made = Sequence[dict[str, str]]


def _over(name: str, source: str, keys: str, made: Made, outputs: dict[str, Callable], expected: dict[str, str], shown: str = "", step: Callable | None = None) -> None:
    """Registers a rule over every row of `source`: `made` are the columns it reads, level by level; `shown` are those that the result keeps."""
    kept = [*keys.split(), *shown.split()]
    inner = source
    for level in made:
        inner = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in level.items())} FROM {inner})"

    @query(name, f"SELECT {', '.join([*kept, *(f'{e} AS {chr(34)}{n}{chr(34)}' for n, e in expected.items())])} FROM {inner}")
    def _(spark, d):
        df = table(spark, d, source)
        for level in made:
            df = df.selectExpr("*", *(f"{e} AS {n}" for n, e in level.items()))
        return (step(df) if step else df).select(*kept, *(make().alias(n) for n, make in outputs.items()))


def _case(choice: str, *values: str, other: str = "NULL") -> str:
    """The value of a row's spelling; choices are numbered from 0."""
    return f"CASE {choice} {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(values))} ELSE {other} END"


def _status(choice: str, *values: str | None) -> str:
    return _case(choice, *("NULL" if v is None else f"'{v}'" for v in values))


def _luhn_digit(payload: str, length: int) -> str:
    """The digit that a payload of digits lacks for Luhn's check."""
    digit = lambda k: f"CAST(substr({payload}, {k}, 1) AS INT)"
    term = lambda k: f"(CASE WHEN {digit(k)} > 4 THEN 2 * {digit(k)} - 9 ELSE 2 * {digit(k)} END)" if (length - k) % 2 == 0 else digit(k)
    return f"CAST((10 - ({' + '.join(term(k) for k in range(1, length + 1))}) % 10) % 10 AS STRING)"


# Numbers and identifiers out of order keys.
_K = {"n": "CAST(o_orderkey AS STRING)", "n8": "lpad(CAST(o_orderkey % 100000000 AS STRING), 8, '0')"}
_SIREN = ({**_K, "k": "o_orderkey % 6"}, {"luhn": _luhn_digit("n8", 8)}, {"good": "n8 || luhn", "bad": "n8 || CAST((CAST(luhn AS INT) + 1) % 10 AS STRING)"}, {"p13": "good || '0007'"}, {"end14": _luhn_digit("p13", 13)}, {"long14": "p13 || end14", "wrong14": "p13 || CAST((CAST(end14 AS INT) + 1) % 10 AS STRING)"})
_over(
    "num_01_number_form", "orders", "o_orderkey",
    ({**_K, "k": "o_orderkey % 8"}, {"v": _case("k", "'00' || n || '.50'", "'+' || n", "'-' || n || '.0'", "n || 'e5'", "'.' || n8 || '00'", "CAST(NULL AS STRING)", "' '", "n || ' 000'")}),
    {"form": lambda: checks.number_form(C("v"))},
    {"form": _case("k", "n || '.5'", "n", "'-' || n", "n || 'e5'", "'0.' || rtrim(n8, '0')", "''", "''", "n || ' 000'")}, "v",
)
_numbers = lambda: checks.company_numbers(C("siren"), C("siret"))
_over(
    "num_02_company_numbers", "orders", "o_orderkey",
    (*_SIREN, {"siren": _case("k", "substr(good, 1, 3) || ' ' || substr(good, 4, 3) || '.' || substr(good, 7)", "bad", "n8 || 'O'", "'404833048'", "good", "CAST(NULL AS STRING)"), "siret": _case("k", "long14", "''", "'123'", "long14", "CAST(NULL AS STRING)", "wrong14")}),
    {"siren_status": lambda: _numbers()["siren"], "siret_status": lambda: _numbers()["siret"]},
    {"siren_status": _status("k", "valide", "cle_invalide", "format_invalide", "discordant", "valide", "absent"), "siret_status": _status("k", "valide", "absent", "format_invalide", "discordant", "absent", "cle_invalide")}, "siren siret",
)
_accounts = lambda: checks.iban_bic(C("iban"), C("bic"))
_over(
    "num_03_iban_bic", "orders", "o_orderkey",
    ({**_K, "k": "o_orderkey % 5", "bban": "lpad(CAST(o_orderkey AS STRING), 23, '0')", "control": "98 - ((o_orderkey % 97) * 27 + 22) % 97"},
     {"iban": _case("k", "'FR' || lpad(CAST(control AS STRING), 2, '0') || ' ' || substr(bban, 1, 4) || ' ' || substr(bban, 5)", "'fr' || lpad(CAST(control AS STRING), 2, '0') || bban", "'FR' || lpad(CAST(control + 1 AS STRING), 2, '0') || bban", "'FR' || lpad(CAST(control AS STRING), 2, '0') || n", "CAST(NULL AS STRING)"),
      "bic": _case("k", "'PSSTFRPPPAR'", "'DEUTDEFF'", "CAST(NULL AS STRING)", "'PSSTFRP'", "'PSSTFRPP'")}),
    {"iban_status": lambda: _accounts()["iban"], "bic_status": lambda: _accounts()["bic"]},
    {"iban_status": _status("k", "valide", "valide", "cle_invalide", "format_invalide", "absent"), "bic_status": _status("k", "valide", "pays_discordant", "absent", "format_invalide", "valide")}, "iban bic",
)
_over(
    "num_04_check_digit", "orders", "o_orderkey", (_K, {"v": "'L' || n8 || '<'"}), {"digit": lambda: checks.weighted_check_digit(C("v"))},
    {"digit": "CAST((21 * 7 + " + " + ".join(f"CAST(substr(n8, {k}, 1) AS INT) * {(7, 3, 1)[k % 3]}" for k in range(1, 9)) + ") % 10 AS STRING)"}, "v",
)
_over(
    "num_05_social_and_vat", "orders", "o_orderkey",
    (*_SIREN, {"w": "o_orderkey % 4", "born": "1000000000000 + o_orderkey", "island": "1841219000000 + o_orderkey % 1000000", "share": "(12 + 3 * (CAST(good AS BIGINT) % 97)) % 97"},
     {"nir": _case("w", "'1 ' || substr(CAST(born AS STRING), 2) || ' ' || lpad(CAST(97 - born % 97 AS STRING), 2, '0')", "CAST(born AS STRING) || lpad(CAST(97 - (born + 1) % 97 AS STRING), 2, '0')", "CAST(NULL AS STRING)", "'184122a' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') || lpad(CAST(97 - island % 97 AS STRING), 2, '0')"),
      "vat": _case("w", "'FR ' || lpad(CAST(share AS STRING), 2, '0') || ' ' || good", "'FR' || lpad(CAST((share + 1) % 97 AS STRING), 2, '0') || good", "CAST(NULL AS STRING)", "'DE' || good")}),
    {"nir_ok": lambda: checks.social_security_valid(C("nir")), "vat_ok": lambda: checks.vat_valid(C("vat"))}, {"nir_ok": "w IN (0, 3)", "vat_ok": "w = 0"}, "nir vat",
)
_DIALLED = ({**_K, "k": "o_orderkey % 5"}, {"v": _case("k", "'06 ' || substr(n8, 1, 2) || ' ' || substr(n8, 3)", "'+33 (0)6 ' || n8", "'+33 6' || n8", "'06 ' || substr(n8, 1, 4)", "CAST(NULL AS STRING)")})
_over("num_06_phones", "orders", "o_orderkey", _DIALLED, {"ok": lambda: checks.phone_valid(C("v"))}, {"ok": _case("k", "true", "true", "true", "false", "NULL")}, "v")
_over("str_12_phone", "orders", "o_orderkey", _DIALLED, {"e164": lambda: labels.phone_e164(C("v"))}, {"e164": _case("k", "'+336' || n8", "'+336' || n8", "'+336' || n8", "NULL", "NULL")}, "v")
_over(
    "sup_19_lookup_number", "orders", "o_orderkey", (*_SIREN, {"v": _case("k", "substr(good, 1, 3) || ' ' || substr(good, 4)", "bad", "n", "long14", "CAST(NULL AS STRING)", "'no. ' || good")}),
    {"siren": lambda: records.lookup_number(C("v"))}, {"siren": _case("k", "good", "NULL", "NULL", "good", "NULL", "good")}, "v",
)

# Dates out of order dates.
_DAY = {"y": "CAST(extract(year FROM o_orderdate) AS INT)", "m": "CAST(extract(month FROM o_orderdate) AS INT)", "dd": "CAST(extract(day FROM o_orderdate) AS INT)", "iso": "CAST(CAST(o_orderdate AS DATE) AS STRING)"}
_SPELT = {"ym": "substr(iso, 1, 7)", "m2": "substr(iso, 6, 2)", "d2": "substr(iso, 9, 2)", "word": _case("m - 1", *(f"'{w}'" for w in "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split())), "ys": "substr(iso, 1, 4)"}
_over(
    "dat_01_month_of_text", "orders", "o_orderkey",
    ({**_DAY, "k": "o_orderkey % 9"}, _SPELT, {"v": _case("k", "m2 || '/' || ys", "ym", "d2 || '/' || m2 || '/' || ys", "upper(word) || ' ' || ys", "'depuis ' || ys", "'13/' || ys", "'réf 9999'", "CAST(NULL AS STRING)", "'promo ' || ys || ', ' || word || ' 2019'")}),
    {"iso_month": lambda: dates.month_of(C("v"))}, {"iso_month": _case("k", "ym", "ym", "ym", "ym", "ys", "ys", "NULL", "NULL", "ys")}, "v",
)
_LATER = {"later": "y * 12 + m - 1 + o_orderkey % 30"}
_END = {"yl": "CAST(floor(later / 12) AS INT)", "ym_end": "CAST(CAST(floor(later / 12) AS INT) AS STRING) || '-' || lpad(CAST(later % 12 + 1 AS STRING), 2, '0')"}
_over(
    "dat_02_durations", "orders", "o_orderkey",
    ({**_DAY, "k": "o_orderkey % 4"}, {**_SPELT, **_LATER}, _END, {"a": _case("k", "ym", "ym", "ym_end", "ys"), "b": _case("k", "ym_end", "ym", "ym", "CAST(y + 1 AS STRING)")}),
    {"months": lambda: dates.months_between(C("a"), C("b"))}, {"months": _case("k", "CAST(o_orderkey % 30 + 1 AS INT)", "1", "CASE WHEN o_orderkey % 30 = 0 THEN 1 ELSE 0 END", "13")}, "a b",
)
_over(
    "dat_03_periods", "orders", "o_orderkey",
    ({**_DAY, "k": "o_orderkey % 6"}, {**_SPELT, **_LATER}, _END, {"v": _case("k", "upper(word) || ' ' || ys || ' - ' || ym_end", "word || ' ' || ys || ' – Aujourd' || chr(39) || 'hui'", "ys || ' à ' || CAST(yl AS STRING)", "m2 || '/' || ys", "''", "CAST(NULL AS STRING)")}),
    {"begin": lambda: C("begin"), "finish": lambda: C("finish"), "running": lambda: C("running")},
    {"begin": _case("k", "ym", "ym", "ys", "ym"), "finish": _case("k", "ym_end", "NULL", "CAST(yl AS STRING)", "ym"), "running": "k = 1"}, "v",
    step=lambda df: records.with_period(df, "v"),
)
_over(
    "dat_04_still_running", "orders", "o_orderkey", ({**_DAY, "k": "o_orderkey % 6"}, _SPELT, {"v": _case("k", "''", "CAST(NULL AS STRING)", "'depuis ' || ys || ', poste actuel'", "'Aujourd' || chr(39) || 'hui'", "word || ' ' || ys", "ym || ', EN COURS'")}),
    {"running": lambda: dates.still_running(C("v"))}, {"running": "k <> 4"}, "v",
)
_date = lambda: dates.strict_date(C("v"))
_over(
    "dat_05_strict_date", "orders", "o_orderkey",
    ({**_DAY, "k": "o_orderkey % 9"}, _SPELT, {"v": _case("k", "iso", "d2 || '/' || m2 || '/' || ys", "CAST(dd AS STRING) || '/' || CAST(m AS STRING) || '/' || ys", "'le ' || CAST(dd AS STRING) || ' ' || word || ' ' || ys", "'31/02/' || ys", "'vers ' || ys", "'  '", "CAST(NULL AS STRING)", "'1890-' || m2 || '-01'")}),
    {"date": lambda: _date()["date"], "status": lambda: _date()["status"]},
    {"date": "CASE WHEN k < 4 THEN iso ELSE '' END", "status": _status("k", "read", "read", "read", "read", "impossible", "unreadable", "absent", "absent", "impossible")}, "v",
)
_both = lambda: dates.plausibility(C("a"), C("b"), "2026-01-15")
_over(
    "dat_06_plausibility", "orders", "o_orderkey",
    ({**_DAY, "k": "o_orderkey % 4"}, _SPELT, {"a": _case("k", "iso", "'01/' || m2 || '/' || CAST(y + 1 AS STRING)", "CAST(y + 60 AS STRING) || '-' || m2 || '-01'", "'31/02/' || ys"), "b": _case("k", "CAST(y + 1 AS STRING) || '-' || m2 || '-01'", "iso", "CAST(NULL AS STRING)", "'x' || ys")}),
    {"first": lambda: _both()["first"], "second": lambda: _both()["second"]},
    {"first": _status("k", "plausible", "inconsistent", "future", "impossible"), "second": _status("k", "plausible", "inconsistent", "absent", "unreadable")}, "a b",
)
_over(
    "dat_07_period_label", "orders", "o_orderkey",
    ({**_DAY, "k": "o_orderkey % 5"}, {**_SPELT, **_LATER}, _END, {"a": _case("k", "ym", "ym", "ys", "''", "ym"), "b": _case("k", "ym_end", "CAST(NULL AS STRING)", "ys", "ym", "ym"), "r": "k = 1"}),
    {"label": lambda: records.period_label(C("a"), C("b"), C("r"))},
    {"label": _case("k", "m2 || '/' || ys || CASE WHEN ym = ym_end THEN '' ELSE ' – ' || strftime(make_date(CAST(yl AS BIGINT), CAST(later % 12 + 1 AS BIGINT), 1), '%m/%Y') END", "'depuis ' || m2 || '/' || ys", "ys", "''", "m2 || '/' || ys")}, "a b",
)
_over("dat_08_last_year", "orders", "o_orderkey", ({**_DAY, "k": "o_orderkey % 3"}, _SPELT, {"v": _case("k", "'2010-2014, promo ' || ys", "'no. ' || CAST(o_custkey % 1000 AS STRING)", "CAST(NULL AS STRING)")}), {"y_last": lambda: records.last_year(C("v"))}, {"y_last": _case("k", "y", "NULL", "NULL")}, "v")

# Labels and texts out of part names, pages, documents, turns and events.
_P = {"k": "p_partkey % 5", "one": "split_part(p_name, ' ', 1)", "two": "split_part(p_name, ' ', 2)"}
_over("str_01_fold", "conversations", "conv_id turn", (), {"folded": lambda: F.md5(text.fold(C("text")).cast("binary"))}, {"folded": "md5(strip_accents(text))"})
_over(
    "str_03_label_key", "part", "p_partkey",
    (_P, {"v": _case("k", "'  ' || upper(one) || '_' || two || ' '", "'(' || p_name || ').'", "one || '++'", "'L’' || replace(one, 'e', 'é') || '—' || two || '-IT'", "CAST(NULL AS STRING)")}),
    {"label": lambda: labels.label_key(C("v")), "compact": lambda: labels.compact_key(C("v"))},
    {"label": _case("k", "p_name", "p_name", "one || '++'", "'l' || chr(39) || p_name || ' it'", "NULL"), "compact": _case("k", "one || two", "one || two", "one || '++'", "'l' || one || two || 'it'", "NULL")}, "v",
)
_over(
    "str_08_company_names", "part", "p_partkey",
    (_P, {"a": _case("k", "replace(p_name, 'e', 'é') || ' SAS'", "p_name || ' & ' || p_type || ' coeur'", "'SAS'", "CAST(NULL AS STRING)", "p_name || ' sarl'"), "b": _case("k", "'Société ' || upper(p_name)", "'x ' || lower(p_type) || ' Cœur, ' || two", "p_name", "p_name", "'alpha ' || two")}),
    {"same": lambda: labels.name_matches(C("a"), C("b"))},
    {"same": _case("k", "true", "true", "NULL", "NULL", "false")}, "a b",
)
_over(
    "str_09_document_type", "documents", "doc_id",
    ({"t": "text || ' ' || " + _case("doc_id % 8", "'Extrait Kbis du 3'", "'Attestation de vigilance'", "'Relevé d' || chr(39) || 'identité bancaire'", "'déclarations fiscales'", "'code BIC : X'", "'Titre de séjour, Urssaf'", "'vigilance, cubic'", "'passe port'")},),
    {"kind": lambda: labels.document_type(C("t"))},
    {"kind": "(SELECT CASE WHEN regexp_matches(q, 'EXTRAIT KBIS|K BIS|GREFFE DU TRIBUNAL DE COMMERCE') THEN 'kbis' WHEN regexp_matches(q, 'ATTESTATION DE VIGILANCE|URSSAF') THEN 'urssaf' WHEN regexp_matches(q, 'REGULARITE FISCALE|DECLARATIONS FISCALES|ATTESTATION FISCALE') THEN 'fiscale' WHEN regexp_matches(q, 'RELEVE D IDENTITE BANCAIRE| IBAN | BIC ') THEN 'rib' WHEN regexp_matches(q, 'CARTE NATIONALE D IDENTITE|PIECE D IDENTITE|PASSEPORT|TITRE DE SEJOUR') THEN 'cni' ELSE '' END FROM (SELECT ' ' || regexp_replace(strip_accents(upper(t)), '[^A-Z0-9]+', ' ', 'g') || ' ' AS q))"},
)
_over(
    "str_27_language_level", "part", "p_partkey",
    ({"k": "p_partkey % 8", "toeic": "400 + p_partkey % 590", "toefl": "60 + p_partkey % 60", "tcf": "300 + p_partkey % 400"},
     {"v": _case("k", "'TOEIC ' || CAST(toeic AS STRING)", "'toefl ibt ' || CAST(toefl AS STRING)", "'TCF : ' || CAST(tcf AS STRING)", "'Débutant en ' || p_name", "'courant, TOEIC : ' || CAST(toeic AS STRING)", "'lu, écrit, ' || p_name", "'bon niveau'", "CAST(NULL AS STRING)")}),
    {"level": lambda: labels.language_level(C("v"))},
    {"level": _case("k", "CASE WHEN toeic >= 945 THEN 'C1' WHEN toeic >= 785 THEN 'B2' WHEN toeic >= 550 THEN 'B1' ELSE 'A2' END", "CASE WHEN toefl >= 95 THEN 'C1' WHEN toefl >= 72 THEN 'B2' ELSE 'B1' END", "CASE WHEN tcf >= 600 THEN 'C1' WHEN tcf >= 500 THEN 'B2' WHEN tcf >= 400 THEN 'B1' ELSE 'A2' END", "'A1'", "'C1'", "NULL", "'B2'", "NULL")}, "v",
)
_over(
    "str_23_template", "customer", "c_custkey", ({"t": "'Contrat {{numero}} de {{nom}}, {{ville}}{{finClause}}' || CASE WHEN c_custkey % 2 = 0 THEN ' ({{numero}}).' ELSE '.' END"},),
    {"filled": lambda: labels.filled(C("t"), F.create_map(F.lit("numero"), C("c_custkey").cast("string"), F.lit("nom"), C("c_name")))},
    {"filled": "'Contrat ' || c_custkey || ' de ' || c_name || ', ........' || CASE WHEN c_custkey % 2 = 0 THEN ' (' || c_custkey || ').' ELSE '.' END"},
)
_over(
    "str_28_json_recovery", "events", "event_id", ({"k": "event_id % 4"}, {"v": _case("k", "'Voici : ' || props || ' fin'", "'```json' || chr(10) || props || chr(10) || '```'", "'{cassé} ' || props", "event_type")}),
    {"json": lambda: labels.json_part(C("v"))}, {"json": _case("k", "props", "props", "NULL", "NULL")},
)
_over(
    "src_14_entities", "part", "p_partkey", ({"k": "p_partkey % 3"}, {"v": _case("k", "p_name || ' &lt; ' || p_type || ' &amp;&amp; c'", "'&quot;' || p_name || '&quot;'", "p_name || '&amp;lt;'")}),
    {"decoded": lambda: labels.decoded_entities(C("v"))}, {"decoded": _case("k", "p_name || ' < ' || p_type || ' && c'", "chr(34) || p_name || chr(34)", "p_name || '&lt;'")},
)
_over("str_15_list_split", "part", "p_partkey", (_P, {"v": "one || ', CI/CD ; ' || two || ' / ' || p_type || ' ET – ' || p_brand || '..|x'"}), {"items": lambda: F.array_join(records.split_list(C("v")), "|")}, {"items": "one || '|CI/CD|' || two || '|' || p_type || '|' || p_brand"}, "v")
_over(
    "str_29_degree_level", "part", "p_partkey", ({"k": "p_partkey % 8"}, {"v": _case("k", "'Master 2, ' || p_name", "p_name || ', Doctorat'", "'Ingénieur ' || p_name", "p_name || ', licence pro et BTS'", "'BTS ' || p_name", "'bac + 3 ' || p_name", "p_name", "CAST(NULL AS STRING)")}),
    {"level": lambda: records.degree_level(C("v"))}, {"level": _status("k", "bac+5", "bac+8", "bac+5", "bac+3", "bac+2", "bac+3", "", "")}, "v",
)
_n = lambda: records.need_of_text(C("v"))
_over(
    "sup_05_need_of_text", "part", "p_partkey", ({"asked": "p_partkey % 14"}, {"v": "CASE p_partkey % 3 WHEN 0 THEN ' ' || chr(10) || p_name || chr(10) || CAST(asked AS STRING) || ' ans d' || chr(39) || 'expérience' WHEN 1 THEN p_name ELSE NULL END"}),
    {"title": lambda: _n()["title"], "least": lambda: _n()["least"], "level": lambda: _n()["level"]},
    {"title": "CASE WHEN v IS NULL THEN '' ELSE p_name END", "least": "CASE WHEN p_partkey % 3 = 0 THEN CAST(asked AS INT) ELSE 0 END", "level": "CASE WHEN p_partkey % 3 <> 0 THEN '' WHEN asked <= 2 THEN 'junior' WHEN asked <= 5 THEN 'confirmé' WHEN asked <= 9 THEN 'senior' ELSE 'expert' END"}, "v",
)
_y = lambda: records.years_source(C("y"), C("ok"), C("told"))
_over(
    "sup_08_years_source", "part", "p_partkey", ({"k": "p_partkey % 4", "y": "CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE p_size END", "ok": "p_partkey % 4 = 0", "told": _case("p_partkey % 4", "'9'", "CAST(p_size AS STRING) || '.5'", "'x'", "CAST(NULL AS STRING)")},),
    {"years": lambda: _y()["years"], "source": lambda: _y()["source"]},
    {"years": _case("k", "p_size", "p_size + 1", "p_size", "0"), "source": "CASE WHEN k = 2 AND p_size = 0 THEN 'none' ELSE " + _status("k", "periods", "announced", "lump", "none") + " END"}, "y ok told",
)
_SIMILAR = {"a": _case("k", "p_name", "two", "one", "p_name", "''"), "b": _case("k", "substr(p_name, 1, length(p_name) - 1) || '_'", "'pl/' || two", "substr(one, 1, length(one) - 1) || '_'", "upper(p_name)", "p_name")}
_over("joi_02_fuzzy_skill", "part", "p_partkey", (_P, _SIMILAR), {"met": lambda: records.skill_similar(C("a"), C("b"))}, {"met": _case("k", "(length(p_name) - 1.0) / length(p_name) > 0.82", "true", "(length(one) - 1.0) / length(one) > 0.82", "true", "true")}, "a b")
_over("str_07_ratio", "part", "p_partkey", (_P, _SIMILAR), {"share": lambda: scores.ratio(C("a"), C("b"))}, {"share": _case("k", "(length(a) - 1.0::DOUBLE) / length(a)", "2.0::DOUBLE * length(two) / (2 * length(two) + 3)", "(length(a) - 1.0::DOUBLE) / length(a)", "1.0", "0.0")}, "a b")
_o = lambda: records.opinion(C("v"))
_over(
    "sup_04_opinion", "part", "p_partkey",
    ({"k": "p_partkey % 4", "told": "p_size * 4 - 20"}, {"v": _case("k", "'ok {\"score\": \"' || CAST(told AS STRING) || '\", \"strengths\": [\"' || p_name || '\",\"b\",\"c\",\"d\",\"e\"]}'", "'{\"score\": ' || CAST(told AS STRING) || '}'", "p_name", "CAST(NULL AS STRING)")}),
    {"score": lambda: _o()["score"], "n": lambda: F.coalesce(F.size(_o()["strengths"]), F.lit(-1)), "best": lambda: F.get(_o()["strengths"], 0)},
    {"score": "CASE WHEN k < 2 THEN CAST(greatest(0, least(100, told)) AS DOUBLE) END", "n": "CASE WHEN k = 0 THEN 4 ELSE -1 END", "best": "CASE WHEN k = 0 THEN p_name END"}, "v",
)
_over(
    "arr_08_stale_marks", "orders", "o_orderkey",
    ({"k": "o_orderkey % 3", "raw": "'experience[' || CAST(o_custkey % 7 AS STRING) || '].title,skills[0],experience[2],identity'"}, {"marks": "split(raw, ',')", "rewritten": "split(" + _case("k", "'experience'", "'skills,identity'", "'languages'") + ", ',')"}),
    {"kept": lambda: F.array_join(F.filter("marks", lambda m: ~F.array_contains(C("rewritten"), F.regexp_extract(m, r"^(\w+)", 1))), ",")},
    {"kept": _case("k", "'skills[0],identity'", "split_part(raw, ',', 1) || ',experience[2]'", "raw")}, "raw",
)


@query(
    "joi_09_dictionary",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 2 THEN 'un' || one ELSE CASE p_partkey % 4 WHEN 0 THEN upper(one) ELSE '(' || one || ')' END END AS term,
    CASE WHEN p_partkey % 4 < 2 THEN upper(substr(one, 1, 1)) || substr(one, 2) END AS canonical FROM (SELECT *, split_part(p_name, ' ', 1) AS one FROM part)""",
)
def _(spark, d):
    """Terms to canonical names, by exact key, else by compact key: the dictionary is made of the first words of all part names, the terms are spellings of them, words with another beginning, and nothing."""
    part = table(spark, d, "part").withColumn("one", F.split_part("p_name", F.lit(" "), F.lit(1)))
    known = part.select(C("one").alias("alias"), F.initcap("one").alias("name")).distinct()
    spelt = part.selectExpr("p_partkey", _case("p_partkey % 4", "upper(one)", "'(' || one || ')'", "'un' || one", "CAST(NULL AS STRING)") + " AS term")
    return labels.canonical(spelt, "term", known, "alias", "name").select("p_partkey", "term", "canonical")


@query(
    "ext_01_sections",
    """WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text || chr(10) || '## Expérience' || chr(10) || source || chr(10) || '## 2019' || chr(10) || '# Compétences' || chr(10) || lang, chr(10)) AS x FROM documents)),
    n AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS final FROM l) SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE WHEN line_no = final THEN 'skills' WHEN line_no IN (final - 2, final - 3) THEN 'experience' ELSE 'intro' END AS section, md5(line) AS digest FROM n WHERE line_no NOT IN (final - 1, final - 4)""",
)
def _(spark, d):
    """Lines of every document, with two sections after its text, under the last heading that names one; other headings are lines."""
    body = F.concat_ws("\n", "text", F.lit("## Expérience"), "source", F.lit("## 2019"), F.lit("# Compétences"), "lang")
    df = table(spark, d, "documents").where("text is not null and source is not null and lang is not null").select("doc_id", body.alias("text"))
    rows = labels.sectioned(df, "doc_id", "text", {"experience": "exp[ée]rience|mission", "skills": "comp[ée]tence|skill", "education": "formation|dipl"})
    return rows.select("doc_id", "line_no", "section", F.md5(C("line").cast("binary")).alias("digest"))


# Scores out of part sizes, keys and names; the oracles compute them by other expressions.
_over(
    "sco_03_seniority", "part", "p_partkey", ({"level": _case("p_partkey % 6", "''", "'junior'", "'confirmé'", "'senior'", "'expert'", "'unknown'"), "least": "CAST(p_partkey % 11 AS INT)", "years": "CAST(floor(p_partkey / 11) % 20 AS INT)"},),
    {"points": lambda: scores.seniority_score(C("level"), C("least"), C("years"))},
    {"points": """(SELECT floor(15 * 100 * least(1.0, CASE WHEN least = 0 AND level = '' THEN 0.6 ELSE (CASE WHEN least = 0 THEN 0.0 WHEN years >= least THEN 0.5 WHEN years * 10 >= least * 8 THEN 0.3 ELSE 0.0 END)
        + (CASE WHEN low IS NULL THEN 0.0 WHEN years > high THEN 0.35 WHEN years >= low THEN 0.5 WHEN years = low - 1 THEN 0.25 ELSE 0.0 END) END) + 0.5) / 100
        FROM (SELECT CASE level WHEN 'junior' THEN 0 WHEN 'confirmé' THEN 3 WHEN 'senior' THEN 6 WHEN 'expert' THEN 10 END AS low, CASE level WHEN 'junior' THEN 2 WHEN 'confirmé' THEN 5 WHEN 'senior' THEN 9 WHEN 'expert' THEN 99 END AS high))"""}, "level least years",
)
_over(
    "sco_04_availability", "part", "p_partkey", ({"k": "p_partkey % 8"}, {"status": _case("k", "'Disponible, ' || p_name", "'non disponible'", "'sous 30 jours'", "p_name || ' dans 2 mois'", "'3 MOIS'", "''", "'préavis de ' || p_name", "'Immédiatement'")}),
    {"points": lambda: scores.availability_score(C("status"))}, {"points": _case("k", "10.0", "10.0", "7.0", "4.0", "2.0", "5.0", "5.0", "10.0")}, "status",
)
_over(
    "sco_05_missions", "part", "p_partkey", ({"a": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 64 END", "b": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey % 32 AS DOUBLE) / 32 END"},),
    {"points": lambda: scores.missions_score(C("a"), C("b"))}, {"points": "CASE WHEN a IS NULL AND b IS NULL THEN 4.0 ELSE floor(list_avg([a, b]) * 1000 + 0.5) / 100 END"}, "a b",
)
_over(
    "sco_06_bonus", "part", "p_partkey", ({"l": "p_size % 2 = 0", "z": "p_size % 3 = 0", "cl": "p_name LIKE 'red%'", "p": "p_type = 'ECONOMY'", "r": "p_partkey % 5 = 0", "ct": "p_partkey % 7 < 3"},),
    {"points": lambda: scores.bonus_score(C("l"), C("z"), C("cl"), C("p"), C("r"), C("ct"))},
    {"points": "least(10, 2 * (l::INT + z::INT + cl::INT + p::INT + ct::INT) + (r AND NOT p)::INT)"},
)
_over(
    "sco_08_keyword_overlap", "conversations", "conv_id turn", ({"q": "CASE conv_id % 3 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN 'le la de' ELSE 'the ' || coalesce(role, '') || ' que ' || coalesce(substr(text, 1, 40), '') END", "t": "lower(coalesce(text, '')) || ' user'"},),
    {"share": lambda: scores.two_places(scores.keyword_overlap(C("q"), C("t")))},
    {"share": r"""(SELECT CASE WHEN len(w) = 0 THEN 0.5 ELSE floor(len(list_filter(w, lambda x: contains(t, x)))::DOUBLE / len(w) * 100 + 0.5) / 100 END FROM (SELECT list_filter(regexp_extract_all(lower(q), '[\p{L}\p{M}\p{N}_]+'), lambda x: length(x) > 2 AND x NOT IN ('le', 'la', 'les', 'de', 'du', 'des', 'un', 'une', 'et', 'en', 'ou', 'au', 'aux', 'avec', 'pour', 'sur', 'dans', 'par', 'est', 'sont', 'the', 'a', 'of', 'and', 'or')) AS w))"""},
)
_over("sco_12_recency", "part", "p_partkey", ({"gap": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END"},), {"value": lambda: scores.two_places(scores.recency(C("gap")))}, {"value": "CASE WHEN gap IS NULL THEN 0.7 WHEN gap < 3 THEN 1.0 WHEN gap > 8 THEN 0.4 ELSE floor(100 / exp((gap - 2) / 7.0) + 0.5) / 100 END"}, "gap")
_over(
    "sco_14_seniority_axis", "part", "p_partkey", ({"years": "p_size", "asked": "CAST(p_partkey % 13 AS INT)"},), {"value": lambda: scores.two_places(scores.seniority_axis(C("years"), C("asked")))},
    {"value": "floor((CASE WHEN asked = 0 THEN 0.5 WHEN years >= asked + 15 THEN 0.5 WHEN years > asked + 5 THEN 1 - (years - asked - 5) * 0.05 WHEN years >= asked THEN 1.0 WHEN years = 0 THEN 0.0 ELSE exp(1.4 * ln(years / asked)) END)::DOUBLE * 100 + 0.5) / 100"}, "years asked",
)
_over(
    "sco_15_title_axis", "part", "p_partkey", ({"s": "p_name LIKE 'red%'", "u": "p_name LIKE '%ring'", "f": "p_type = 'PROMO'", "w": "p_size % 2 = 0", "x": "CAST(p_size AS DOUBLE) / 64"},),
    {"v": lambda: scores.two_places(records.title_axis(C("s"), C("u"), C("f"), C("w"), C("x")))},
    {"v": "CASE WHEN split_part(p_name, ' ', 1) = 'red' THEN 1.0 WHEN split_part(p_name, ' ', 2) = 'ring' THEN 0.85 WHEN f THEN 0.6 WHEN w THEN 0.45 ELSE floor((0.1 + x * 0.3) * 100 + 0.5) / 100 END"},
)
_over(
    "sco_18_highlights", "part", "p_partkey",
    ({"k": "p_partkey % 6", "ps": "CAST(p_size AS STRING)"}, {"t": _case("k", "'Réduit les coûts de ' || ps || ' % sur ' || ps || ' sites en Europe'", "'Participation'", "'Suivi régulier des travaux de la maîtrise, ' || p_name", "'Industrialisation de ' || ps || ' hopitaux et de leurs services'", "CAST(NULL AS STRING)", "p_name || ' est sous pression à ' || ps || ' bar'")}),
    {"score": lambda: scores.highlight_score(C("t"), F.array(F.lit("ring"), F.lit("pression"), F.lit("red")))},
    {"score": _case("k", "10.5", "-1.5", "CASE WHEN p_name LIKE '%ring%' THEN 3.7 ELSE 3.0 END", "7.5", "1.5", "CASE WHEN p_name LIKE '%ring%' THEN 5.4 ELSE 4.7 END")}, "t",
)


# Envelopes of orders: numbers with and without their check digits, dates in several spellings, names that match or don't.
def _envelope(schema: str, fields: dict[str, str], validation: str = "'{\"valid\":true}'") -> str:
    """SQL of an envelope's JSON; a field is SQL of its inner text, null for none."""
    inner = " || ".join(f"coalesce('\"{k}\":{{\"value\":\"' || {e} || '\"}},', '')" for k, e in fields.items())
    return f"'{{\"schema_name\":\"{schema}\",\"result\":{{' || {inner} || '\"extraction_notes\":[\"n' || CAST(o_orderkey % 2 AS STRING) || '\"]}},\"validation\":' || {validation} || '}}'"


_TO_COME = {"ys": "CAST(y + 12 AS STRING)"}  # leap years stay so
_KBIS = (
    *_SIREN, {**_DAY, "w": "o_orderkey % 7"}, {"m2": "substr(iso, 6, 2)", "d2": "substr(iso, 9, 2)", **_TO_COME},
    {"siren": _case("w", "good", "bad", "good", "good", "CAST(NULL AS STRING)", "good", "good"), "siret": _case("w", "long14", "CAST(NULL AS STRING)", "'40483304800022'", "'123'", "CAST(NULL AS STRING)", "long14", "long14"),
     "day": _case("w", "d2 || '/' || m2 || '/' || ys", "ys || '-' || m2 || '-' || d2", "'le jour'", "'31/02/' || ys", "ys || '-' || m2 || '-' || d2", "CAST(NULL AS STRING)", "ys || '-' || m2 || '-' || d2"),
     "holder": "CASE WHEN w = 4 THEN NULL ELSE 'Client ' || CAST(o_custkey AS STRING) || ' SAS' END", "sought": "CASE WHEN o_orderkey % 2 = 0 THEN 'Client ' || CAST(o_custkey AS STRING) ELSE 'Autre maison' END"},
    {"envelope": "CASE WHEN w = 6 THEN '{' ELSE '' END || " + _envelope("kbis", {"company_name": "holder", "siren": "siren", "siret_siege": "siret", "issued_date": "day", "legal_form": "o_orderpriority"}, "CASE WHEN w = 5 THEN '{\"valid\":false,\"errors\":[\"e\"]}' ELSE '{\"valid\":true}' END") },
)
_listed = lambda *parts: f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '|')"
_KBIS_FAILED = ["CASE WHEN w = 1 THEN 'SIREN ''' || siren || ''': its check digit is wrong; the value is kept' END", "CASE WHEN w = 3 THEN 'SIRET ''123'': 14 digits are expected; the value is kept' WHEN w = 2 AND siret_ok AND substr(siret, 1, 9) <> siren THEN 'SIRET ''' || siret || ''' is not of the company SIREN ''' || siren || '''; the value is kept' WHEN w = 2 AND NOT siret_ok THEN 'SIRET ''' || siret || ''': its check digit is wrong; the value is kept' END"]


def _kbis(df):
    df = mappings.mapped(df, "envelope", "kbis", "2026-01-15", C("sought"))
    return df.select("o_orderkey", "mapped.*")


_over(
    "prj_09_kbis", "orders", "o_orderkey", (*_KBIS, {"siret_ok": _luhn_digit("'4048330480002'", 13) + " = '2'"}),
    {"refused": lambda: C("refused"), "siren_read": lambda: C("values")["siren"], "form": lambda: C("values")["formeJuridique"], "capital": lambda: C("values")["capitalSocial"], "who": lambda: C("name"), "same": lambda: C("name_matches"),
     "issued": lambda: C("issued"), "ok": lambda: C("valid"), "summary": lambda: C("summary"), "told": lambda: F.array_join("issues", "|"), "lost": lambda: F.array_join("warnings", "|")},
    {"refused": "CASE WHEN w = 6 THEN 'json' END", "siren_read": "CASE WHEN w <> 6 THEN coalesce(siren, '') END", "form": "CASE WHEN w <> 6 THEN o_orderpriority END", "capital": "CASE WHEN w <> 6 THEN '' END", "who": "CASE WHEN w <> 6 THEN holder END",
     "same": "CASE WHEN w NOT IN (4, 6) THEN o_orderkey % 2 = 0 END", "issued": "CASE WHEN w < 2 THEN ys || '-' || m2 || '-' || d2 WHEN w < 6 THEN '' END", "ok": "CASE WHEN w <> 6 THEN w < 4 END",
     "summary": "CASE WHEN w < 2 THEN 'Extrait Kbis — délivré le ' || ys || '-' || m2 || '-' || d2 WHEN w = 4 THEN 'Document illisible.' WHEN w < 6 THEN 'Extrait Kbis' END",
     "told": "CASE WHEN w = 4 THEN 'no text could be read' WHEN w <> 6 THEN " + _listed("CASE WHEN w = 5 THEN 'the extraction was not validated' END", "CASE WHEN o_orderkey % 2 = 1 THEN 'the name is not the expected one' END", *_KBIS_FAILED, "CASE WHEN w IN (2, 3, 5) THEN 'no issue date found' END") + " END",
     "lost": "CASE WHEN w <> 6 THEN " + _listed("CASE w WHEN 2 THEN 'issued_date: unreadable date ''le jour'' left out' WHEN 3 THEN 'issued_date: impossible date ''31/02/' || ys || ''' left out' END", *_KBIS_FAILED, "'note: n' || (o_orderkey % 2)", "CASE WHEN w = 5 THEN 'validation: e' END") + " END"},
    step=_kbis,
)
_over(
    "str_10_issue_date", "orders", "o_orderkey",
    ({**_DAY, "k": "o_orderkey % 6"}, {**_SPELT, "ys": "CAST(y + 10 AS STRING)", "old": "CAST(y + 9 AS STRING)", "new": "CAST(y + 11 AS STRING)"},
     {"v": _case("k", "'Édité le ' || d2 || '/' || m2 || '/' || ys || ', valable au 01/01/2026'", "'né le 01/02/' || old || ' puis ' || CAST(dd AS STRING) || ' ' || word || ' ' || ys || ' fin'", "'au 01/02/2027 et au 03/04/2026'", "'Délivré à Paris, ' || repeat('x', 60) || ' 01/01/' || old || '. Fait à Lyon le ' || d2 || '-' || m2 || '-' || ys || ' et ' || repeat('y', 60) || ' 01/01/' || new", "'le 45/02/2010, le 01/13/2011, le 01/01/1999'", "CAST(NULL AS STRING)")}),
    {"issued": lambda: dates.issued_date(C("v"), "2026-01-15")},
    {"issued": _case("k", "'2026-01-01'", "ys || '-' || m2 || '-' || d2", "'2026-04-03'", "ys || '-' || m2 || '-' || d2", "''", "''")}, "v",
)
