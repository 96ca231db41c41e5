"""Rules against stated results, on rows of our own."""

import pytest
from pyspark.sql import functions as F

from talweg.functions import checks, dates, labels, records, scores, text

C = F.col
CASES = {}


def _cases(name, inputs, rows, outputs):
    CASES[name] = (inputs, rows, outputs)


_cases("num_01_number_form", {"v": "string"}, [("007.50", "7.5"), ("+3", "3"), ("-0.0", "0"), ("-12.30", "-12.3"), (".5", "0.5"), ("1e5", "1e5"), ("12 000", "12 000"), (" ", ""), (None, ""), ("10000000000000000", "10000000000000000")], {"form": lambda: checks.number_form(C("v"))})
_numbers = lambda: checks.company_numbers(C("siren"), C("siret"))
_cases(
    "num_02_company_numbers", {"siren": "string", "siret": "string"},
    [("732829320", "73282932000074", "valide", "valide"), ("732 829 320", None, "valide", "absent"), ("732829321", "", "cle_invalide", "absent"), ("73282932O", "123", "format_invalide", "format_invalide"), ("404833048", "73282932000074", "discordant", "discordant"), (None, "73282932000075", "absent", "cle_invalide")],
    {"siren_status": lambda: _numbers()["siren"], "siret_status": lambda: _numbers()["siret"]},
)
_accounts = lambda: checks.iban_bic(C("iban"), C("bic"))
_cases(
    "num_03_iban_bic", {"iban": "string", "bic": "string"},
    [("FR14 2004 1010 0505 0001 3M02 606", "PSSTFRPPPAR", "valide", "valide"), ("fr1420041010050500013m02606", "DEUTDEFF", "valide", "pays_discordant"), ("GB82 WEST 1234 5698 7654 32", None, "valide", "absent"), ("FR1420041010050500013M02607", "PSSTFRP", "cle_invalide", "format_invalide"), ("FR14 2004", "", "format_invalide", "absent"), (None, "PSSTFRPP", "absent", "valide")],
    {"iban_status": lambda: _accounts()["iban"], "bic_status": lambda: _accounts()["bic"]},
)
_cases("num_04_check_digit", {"v": "string"}, [("D23145890", "7"), ("740812", "2"), ("120415", "9"), ("<<<", "0"), ("L898902C3", "6")], {"digit": lambda: checks.weighted_check_digit(C("v"))})
_cases("num_05_social_and_vat", {"nir": "string", "vat": "string"}, [("1 84 12 76 451 089 46", "FR 40 303 265 045", True, True), ("184127645108947", "FR41303265045", False, False), (None, None, False, False), ("12", "DE303265045", False, False)], {"nir_ok": lambda: checks.social_security_valid(C("nir")), "vat_ok": lambda: checks.vat_valid(C("vat"))})
_cases("num_06_phones", {"v": "string"}, [("06 12 34 56 78", True), ("+33 (0)6 12 34 56 78", True), ("+33 612345678", True), ("06 12 34", False)], {"ok": lambda: checks.phone_valid(C("v"))})
_cases(
    "dat_01_month_of_text", {"v": "string"},
    [("04/2025", "2025-04"), ("2025-04", "2025-04"), ("12/04/2025", "2025-04"), ("Août 2019", "2019-08"), ("févr. 2020", "2020-02"), ("depuis 2015", "2015"), ("13/2020", "2020"), ("réf 9999", None), ("bientôt", None), (None, None), ("1/2/19", "2019-02"), ("promo 2015, mars 2019", "2015"), ("le 3 mars 1890 ou 2001", None), ("x2019 et 2018a 2017", "2017"), ("2020-04-15", "2020-04"), ("", None)],
    {"iso": lambda: dates.month_of(C("v"))},
)
_cases("dat_02_durations", {"a": "string", "b": "string"}, [("2020-01", "2020-12", 12), ("2020-03", "2020-03", 1), ("2021", "2020-12", 0), ("2019", "2020", 13)], {"months": lambda: dates.months_between(C("a"), C("b"))})
_cases("dat_04_still_running", {"v": "string"}, [("", True), (None, True), ("Poste actuel", True), ("Aujourd'hui", True), ("Juin 2021", False), ("en cours", True)], {"running": lambda: dates.still_running(C("v"))})
_date = lambda: dates.strict_date(C("v"))
_cases(
    "dat_05_strict_date", {"v": "string"},
    [("2026-02-28", "2026-02-28", "read"), ("01/13/2026", "", "impossible"), ("5/3/2019", "2019-03-05", "read"), ("le 12 mars 2019", "2019-03-12", "read"), ("30 février 2020", "", "impossible"), ("hier", "", "unreadable"), ("  ", "", "absent"), (None, "", "absent"), ("1900-01-01", "", "impossible"), ("1er mai 2020", "", "unreadable")],
    {"date": lambda: _date()["date"], "status": lambda: _date()["status"]},
)
_both = lambda: dates.plausibility(C("a"), C("b"), "2026-01-15")
_cases("dat_06_plausibility", {"a": "string", "b": "string"}, [("2020-01-01", "2021-01-01", "plausible", "plausible"), ("2022-01-01", "2021-01-01", "inconsistent", "inconsistent"), ("2026-02-01", "", "future", "absent"), ("31/02/2020", "x", "impossible", "unreadable")], {"first": lambda: _both()["first"], "second": lambda: _both()["second"]})
_cases("str_01_fold", {"v": "string"}, [("Éléphant", "Elephant"), ("cœur", "cœur"), ("ça Ñandú", "ca Nandu"), (None, None), ("ǆ", "ǆ")], {"folded": lambda: text.fold(C("v"))})
_cases("str_03_label_key", {"v": "string"}, [("  Développeur_Java ", "developpeur java", "developpeurjava"), ("C++", "c++", "c++"), ("(Node.js)", "node.js", "nodejs"), ("L’équipe—IT", "l'equipe it", "lequipeit"), (None, None, None)], {"label": lambda: labels.label_key(C("v")), "compact": lambda: labels.compact_key(C("v"))})
_cases("str_08_company_names", {"a": "string", "b": "string"}, [("Cœur de Ville SAS", "Société COEUR DE VILLE", True), ("Alpha Beta Gamma", "alpha sarl", False), ("SAS", "x", None), (None, "x", None), ("Été & Fils", "ETE FILS", True)], {"same": lambda: labels.name_matches(C("a"), C("b"))})
_cases("str_09_document_type", {"t": "string"}, [("Extrait Kbis du 3", "kbis"), ("Attestation de vigilance Urssaf", "urssaf"), ("vigilance seule", ""), ("Relevé d'identité bancaire", "rib"), ("Attestation de régularité fiscale", "fiscale"), ("Passeport", "cni"), ("Urssaf", "urssaf"), ("attestation fiscale", "fiscale"), ("code BIC : X", "rib"), ("Titre de séjour", "cni"), ("cubic", ""), ("", "")], {"kind": lambda: labels.document_type(C("t"))})
_cases("str_12_phone", {"v": "string"}, [("06 12 34 56 78", "+33612345678"), ("0033 6 12 34 56 78", "+33612345678"), ("+33 (0)6 12 34 56 78", "+33612345678"), ("+44 20 7946 0958", "+442079460958"), ("123", None)], {"e164": lambda: labels.phone_e164(C("v"))})
_cases("str_27_language_level", {"v": "string"}, [("natif", "C2"), ("TOEIC 880", "B2"), ("courant, TOEIC : 600", "C1"), ("lu, écrit", None), ("Débutant", "A1"), ("TCF 350", "A2"), ("toefl ibt 95", "C1"), (None, None)], {"level": lambda: labels.language_level(C("v"))})
_cases("str_23_template", {"t": "string", "n": "string"}, [("Contrat {{numero}} de {{nom}}{{finClause}}.", "A1", "Contrat A1 de .........")], {"text": lambda: labels.filled(C("t"), F.create_map(F.lit("numero"), C("n")))})
_cases("str_28_json_recovery", {"v": "string"}, [('Voici : {"a": 1} fin', '{"a": 1}'), ("rien", None), ("{cassé}", None)], {"json": lambda: labels.json_part(C("v"))})
_cases("src_14_entities", {"v": "string"}, [("a &lt; b &amp;&amp; c", "a < b && c"), ("&quot;x&quot;", '"x"'), ("&amp;lt;", "&lt;")], {"text": lambda: labels.decoded_entities(C("v"))})
_PERIODS = [("Septembre 2019 - Février 2022", "2019-09", "2022-02", False), ("Mars 2019 – Aujourd'hui", "2019-03", None, True), ("2015 à 2018", "2015", "2018", False), ("2019-03", "2019-03", "2019-03", False), ("", None, None, False), (None, None, None, False), ("juin 2020 to présent", "2020-06", None, True), ("mars 2018 jusqu’au 04/2019", "2018-03", "2019-04", False), ("03/2018 jusqu'en juin 2019", "2018-03", "2019-06", False), ("mai 2016 -- mai 2017", "2016-05", "2017-05", False)]
_cases("dat_07_period_label", {"a": "string", "b": "string", "r": "boolean"}, [("2025-04", "2026-07", False, "04/2025 – 07/2026"), ("2019", None, True, "depuis 2019"), ("2019", "2019", False, "2019"), ("", "2020", False, ""), (None, None, False, "")], {"label": lambda: records.period_label(C("a"), C("b"), C("r"))})
_cases("dat_08_last_year", {"v": "string"}, [("2010-2014, promo 2015", 2015), ("sans", None), (None, None)], {"y": lambda: records.last_year(C("v"))})
_cases("str_15_list_split", {"v": "string"}, [("Java, CI/CD ; SAP / Oracle et - Git.", "Java|CI/CD|SAP|Oracle|Git"), ("a", ""), ("", ""), ("Power BI & Excel ET – Word..", "Power BI|Excel|Word")], {"items": lambda: F.array_join(records.split_list(C("v")), "|")})
_cases("str_29_degree_level", {"v": "string"}, [("Master 2", "bac+5"), ("Doctorat", "bac+8"), ("Ingénieur", "bac+5"), ("Licence pro", "bac+3"), ("BTS SIO", "bac+2"), ("Lycée", ""), ("Mastère", "bac+5"), ("bac + 3", "bac+3"), ("", "")], {"level": lambda: records.degree_level(C("v"))})
_n = lambda: records.need_of_text(C("v"))
_cases("sup_05_need_of_text", {"v": "string"}, [("Développeur\n8 ans d'expérience", "Développeur", 8, "senior"), ("\n  ", "", 0, ""), (None, "", 0, ""), ("Chef\n12 années", "Chef", 12, "expert")], {"title": lambda: _n()["title"], "least": lambda: _n()["least"], "level": lambda: _n()["level"]})
_y = lambda: records.years_source(C("y"), C("ok"), C("told"))
_cases("sup_08_years_source", {"y": "int", "ok": "boolean", "told": "string"}, [(5, True, "9", 5, "periods"), (2, False, "7.5", 8, "announced"), (2, False, "x", 2, "lump"), (0, False, None, 0, "none")], {"years": lambda: _y()["years"], "source": lambda: _y()["source"]})
_cases("sup_19_lookup_number", {"v": "string"}, [("732 829 320 00074", "732829320"), ("732829320", "732829320"), ("732829321", None), ("12", None), (None, None)], {"siren": lambda: records.lookup_number(C("v"))})
_cases("joi_02_fuzzy_skill", {"a": "string", "b": "string"}, [("sql", "pl/sql", True), ("kubernetes", "kubernetis", True), ("java", "python", False), ("", "x", True)], {"met": lambda: records.skill_similar(C("a"), C("b"))})
_cases("str_07_ratio", {"a": "string", "b": "string"}, [("abcd", "bcde", 0.75), ("Java", "java", 1.0), ("", "x", 0.0), (None, None, 1.0)], {"share": lambda: scores.ratio(C("a"), C("b"))})
_o = lambda: records.opinion(C("v"))
_cases("sup_04_opinion", {"v": "string"}, [('ok {"score": "140", "strengths": ["a","b","c","d","e"]}', 100.0, 4), ('{"score": -3}', 0.0, -1), ("rien", None, -1)], {"score": lambda: _o()["score"], "n": lambda: F.coalesce(F.size(F.coalesce(_o()["strengths"], F.lit(None))), F.lit(-1))})
_cases("sco_05_missions", {"a": "double", "b": "double"}, [(0.5, 1.0, 7.5), (None, 0.2, 2.0), (None, None, 4.0)], {"points": lambda: scores.missions_score(C("a"), C("b"))})
_cases("sco_06_bonus", {"l": "boolean", "p": "boolean", "r": "boolean"}, [(True, True, True, 8), (False, False, True, 5), (False, False, False, 4)], {"points": lambda: scores.bonus_score(C("l"), F.lit(True), F.lit(True), C("p"), C("r"), F.lit(False))})
_cases("sco_15_title_axis", {"s": "boolean", "m": "boolean", "f": "boolean", "w": "boolean"}, [(True, True, True, True, 1.0), (False, True, True, True, 0.85), (False, False, True, True, 0.6), (False, False, False, True, 0.45), (False, False, False, False, 0.25)], {"v": lambda: scores.two_places(records.title_axis(C("s"), C("m"), C("f"), C("w"), F.lit(0.5)))})
_cases("sco_03_seniority", {"level": "string", "least": "int", "years": "int"}, [("", 0, 4, 9.0), ("senior", 5, 7, 15.0), ("senior", 5, 4, 4.5), ("junior", 0, 9, 5.25), ("expert", 0, 9, 3.75), ("unknown", 0, 3, 0.0)], {"points": lambda: scores.seniority_score(C("level"), C("least"), C("years"))})
_cases("sco_04_availability", {"status": "string"}, [("Disponible", 10.0), ("non disponible", 10.0), ("sous 30 jours", 7.0), ("2 mois", 4.0), ("3 mois", 2.0), ("", 5.0), ("préavis", 5.0)], {"points": lambda: scores.availability_score(C("status"))})
_cases("sco_08_keyword_overlap", {"q": "string", "t": "string"}, [("développeur java senior", "un développeur python senior", 0.67), ("le la de", "x", 0.5), ("", "x", 0.5), ("abc def", "zzz", 0.0)], {"share": lambda: scores.two_places(scores.keyword_overlap(C("q"), C("t")))})
_cases("sco_12_recency", {"gap": "int"}, [(None, 0.7), (0, 1.0), (2, 1.0), (5, 0.65), (30, 0.4)], {"value": lambda: scores.two_places(scores.recency(C("gap")))})
_cases("sco_14_seniority_axis", {"years": "int", "asked": "int"}, [(3, 0, 0.5), (10, 5, 1.0), (14, 5, 0.8), (40, 5, 0.5), (5, 10, 0.38), (0, 4, 0.0)], {"value": lambda: scores.two_places(scores.seniority_axis(C("years"), C("asked")))})
_cases("sco_18_highlights", {"t": "string"}, [("Réduit les coûts de 30 % sur 12 sites en Europe", 10.5), ("Participation", -1.5), ("Suivi régulier des travaux de la maîtrise", 3.0), ("Industrialisation de 3 hôpitaux et de leurs services", 7.5), (None, 1.5)], {"score": lambda: scores.highlight_score(C("t"))})


@pytest.mark.parametrize("name", sorted(CASES))
def test_stated(spark, name):
    inputs, rows, outputs = CASES[name]
    df = spark.createDataFrame([r[: len(inputs)] for r in rows], ", ".join(f"{k} {t}" for k, t in inputs.items()))
    assert [tuple(r) for r in df.select(*inputs, *(make().alias(k) for k, make in outputs.items())).collect()] == rows


def test_periods(spark):
    df = spark.createDataFrame([p[:1] for p in _PERIODS], "v string")
    assert [tuple(r) for r in records.with_period(df, "v").select("v", "begin", "finish", "running").collect()] == _PERIODS


def test_canonical(spark):
    """Exact key, else a compact key of three characters or more; an alias without a name is none."""
    known = spark.createDataFrame([("js", "JavaScript"), ("node.js", "Node.js"), ("postgres", "PostgreSQL"), ("c", None)], "alias string, name string").where("name is not null")
    want = [("JS", "JavaScript"), ("node js", "Node.js"), ("NodeJS", "Node.js"), ("C", None), ("Postgrès", "PostgreSQL"), (None, None)]
    terms = spark.createDataFrame([w[:1] for w in want], "term string")
    got = labels.canonical(terms, "term", known, "alias", "name").select("term", "canonical").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_sections(spark):
    df = spark.createDataFrame([(1, "# Jean\n## Expérience\nAlpha\n## 2019\n# Compétences\nJava"), (2, "rien")], "id int, text string")
    got = labels.sectioned(df, "id", "text", {"experience": "exp[ée]rience|mission", "skills": "comp[ée]tence|skill", "education": "formation|dipl"})
    want = [(1, 0, "intro", "# Jean"), (1, 2, "experience", "Alpha"), (1, 3, "experience", "## 2019"), (1, 5, "skills", "Java"), (2, 0, "intro", "rien")]
    assert sorted(map(tuple, got.collect())) == want
