"""Mappings, issue dates, document analysis and repaired JSON against stated results and plain versions that share no code with them."""

import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from talweg.functions import analysis, dates, labels
from talweg.functions.text import ACCENTED, BASE
from talweg.operators import mappings
from talweg.sources.tables import table

TODAY = "2026-01-15"
MONTHS = "JANVIER FEVRIER MARS AVRIL MAI JUIN JUILLET AOUT SEPTEMBRE OCTOBRE NOVEMBRE DECEMBRE".split()
NEAR = re.compile("DELIVR|A JOUR AU|EDITE? LE|ETABLI LE|EMISE? LE|FAIT A? ?[A-Z ]*LE|EN DATE DU|DATE DE DELIVRANCE")


def flat(s):
    for a, b in (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE")):
        s = s.replace(a, b)
    s = "".join(c for c in unicodedata.normalize("NFD", s.upper()) if not unicodedata.combining(c))
    return " ".join(re.sub("[^A-Z0-9 ]", " ", s).split())


def issued(text):
    found = []
    for pattern, words in ((r"([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4})", False), (r"([0-9]{1,2})[ \t\n\x0b\f\r]+([A-Za-zûéèàêôä]+)[ \t\n\x0b\f\r]+([0-9]{4})", True)):
        for m in re.finditer(pattern, text):
            month = (MONTHS.index(flat(m[2])) + 1 if flat(m[2]) in MONTHS else 0) if words else int(m[2])
            if 1 <= month <= 12 and 2000 <= int(m[3]) <= 2027 and (words or 1 <= int(m[1]) <= 31):
                found.append((f"{int(m[3]):04d}-{month:02d}-{int(m[1]):02d}", bool(NEAR.search(flat(text[max(0, m.start() - 55) : m.start()])))))
    near, past = [d for d, n in found if n], [d for d, _ in found if d <= TODAY]
    return max(near) if near else max(past) if past else min((d for d, _ in found), default="")


TEXTS = [
    None, "", "rien", "né le 01/02/2003, délivré le 5 mars 2010", "01/01/2001 02/02/2002 03/03/2003 délivré 04/04/2004", "Fait à Paris le 12.05.2011 puis 13-06-2012", "99/12/2010 31/13/2010 1/1/1999 1/1/2028",
    "12 août 2015, 3 floréal 2016, 45 mai 2017", "à jour au\n03/03/2030", "1/1/20100 12/3/2011/4/2012", "Édité le " + "z" * 60 + " 01/01/2005 et 02/01/2005", "établi le 1er mai 2019 et 2 mai 2018", "émis le " + "1/1/2001 " * 12 + "2/2/2002", "12/03/2019 mars 2020 émise le 7\tjuin 2021",
]


def test_issue_dates(spark, sf_dir):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    got = {r.id: r.x for r in df.select("id", dates.issued_date(F.col("t"), TODAY).alias("x")).collect()}
    assert got == {i: issued(t or "") for i, t in enumerate(TEXTS)}
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", F.lit("Délivré à X le 03/04/2011,"), "text", F.lit("édité le 5 mai 2012")).alias("t"))
    for r in docs.select("t", dates.issued_date(F.col("t"), TODAY).alias("x")).collect():
        assert r.x == issued(r.t)
    long = "x 01/02/2003 " * 5000 + "délivré le 4 mai 2002 "
    assert spark.createDataFrame([(long,)], "t string").select(dates.issued_date(F.col("t"), TODAY)).first()[0] == issued(long)


def test_analysis(spark):
    rows = [
        ("Extrait Kbis\nDénomination sociale :  Alpha   Conseil\ndélivré le 03/04/2020", "ALPHA conseil SAS"), ("Attestation Urssaf de vigilance, société Bêta", "Gamma"), ("URSSAF, un document quelconque", "SAS"),
        ("court", "x"), (None, None), ("Relevé d'identité bancaire de la maison Deltaville du 1 mai 2010", "delta"), ("un texte sans rien de connu", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key int, t string, issued string")  # names that the steps use
    got = [tuple(r) for r in analysis.with_analysis(df, "t", F.col("issued"), TODAY).orderBy("key").select("analysis.*").collect()]
    none, other = "no issue date found", "the company is not the expected one"
    assert got == [
        (True, "Extrait Kbis", "kbis", "Alpha Conseil", True, "2020-04-03", [], "Extrait Kbis — délivré le 2020-04-03"),
        (True, "Attestation de vigilance URSSAF", "urssaf", "Bêta", False, "", [other, none], "Attestation de vigilance URSSAF"),
        (True, "Document URSSAF", "urssaf", None, None, "", [none], "Document URSSAF"),
        (False, "Document", "", None, None, "", ["no text could be read"], "Document illisible."),
        (False, "Document", "", None, None, "", ["no text could be read"], "Document illisible."),
        (True, "RIB", "rib", "delta", True, "2010-05-01", [], "RIB — délivré le 2010-05-01"),
        (True, "Document non identifié", "", None, None, "", [none], "Document non identifié"),
    ]
    assert analysis.with_analysis(df.where("false"), "t", F.col("issued"), TODAY).count() == 0


def test_a_text_is_made_plain_once(spark):
    """For all phrases together, and with the kinds and plain forms of before."""
    texts = ["extrait  K-bis", "ŒIBAN x", "Iban", "x IBAN, œuvre", "ǼIBAN y", "æ BIC", " - Relevé_d'identité: bancaire", "Pièce  d’identité", "urssaf\nIBAN 1", "", "  ", None, "a", "É", "𝒳 passeport ﬁ", "ééé, -- x.y  Z "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    once = df.select(labels.document_type(F.col("t")).alias("x"))
    assert once._jdf.queryExecution().analyzed().toString().count("upper(") == 1

    bare = lambda t: "".join(labels_bare.get(c, c) for c in t.upper() if not "\u0300" <= c <= "\u036f")
    labels_bare = dict(zip(ACCENTED, BASE, strict=True))
    want = []
    for t in texts:
        padded = " " + re.sub("[^A-Z0-9]+", " ", bare(t or "")) + " "
        kind = next((k for k, phrases in labels.DOCUMENT_PHRASES.items() if any(p in padded for p in phrases)), "")
        wide = t
        for a, b in analysis.LIGATURES:
            wide = wide and wide.replace(a, b)
        want.append((kind, None if t is None else re.sub(" +", " ", re.sub("[^A-Z0-9 ]", " ", bare(wide))).strip(" ")))
    plain = analysis._plain(F.col("t"))
    got = df.select("id", labels.document_type(F.col("t")), analysis._key(F.coalesce("t", F.lit("")), F.coalesce(plain, F.lit(""))), plain).orderBy("id").collect()
    assert [(r[1], r[3]) for r in got] == want and all(r[1] == r[2] for r in got)


def envelope(schema, fields, **validation):
    return json.dumps({"schema_name": schema, "result": {k: v if isinstance(v, dict) else {"value": v} for k, v in fields.items()}, "validation": validation})


def test_mappings(spark):
    def one(schema, text, expected=None):
        df = spark.createDataFrame([(text, expected, "kept")], "v string, sought string, row string")
        r = mappings.mapped(df, "v", schema, TODAY, F.col("sought")).first()
        assert r.row == "kept" and r.sought == expected
        return r.mapped

    kbis = one("kbis", envelope("kbis", {"company_name": "Alpha", "siren": "732829320", "siret_siege": "73282932000074", "share_capital": {"amount": "1000.50", "currency": "usd"}, "registration_date": "5 mars 2001", "issued_date": "2025-02-30"}))
    assert (kbis.valid, kbis.issued, kbis["values"]["capitalSocial"], kbis["values"]["capitalSocialDevise"], kbis["values"]["dateImmatriculation"], kbis.name_matches) == (True, "", "1000.5", "USD", "2001-03-05", None)
    assert kbis.issues == ["no issue date found"] and kbis.warnings == ["share_capital: the amount is in USD", "issued_date: impossible date '2025-02-30' left out"]
    urssaf = one("urssaf", envelope("urssaf", {"siren": "732829320", "siret": "40483304800022", "employee_count": "une douzaine", "valid_until": "soon"}, valid=False, warnings=["w"], errors=["e"]))
    assert urssaf.readable and not urssaf.valid and urssaf.issues == ["the extraction was not validated", "SIRET '40483304800022' is not of the company SIREN '732829320'; the value is kept", "no issue date found"]
    assert urssaf.warnings == ["valid_until: unreadable date 'soon' left out", "employee_count: no number 'une douzaine' left out", "SIRET '40483304800022' is not of the company SIREN '732829320'; the value is kept", "validation: w", "validation: e"]
    fiscale = one("fiscale", envelope("fiscale", {"company_name": "Alpha", "situation_date": "2025-05-01", "issued_date": "2025-04-01"}), "Alpha SAS")
    assert fiscale.issues == ["situation_date '2025-05-01' is after issued_date '2025-04-01'; the value is kept"] and fiscale.issued == "2025-04-01" and fiscale.name_matches
    assert one("fiscale", envelope("fiscale", {"siren": "x", "issued_date": "2027-04-01"})).issues == ["SIREN 'x': 9 digits are expected; the value is kept", "issued_date '2027-04-01': a day to come; the value is kept"]
    rib = one("rib", envelope("rib", {"account_holder": "Alpha", "iban": "FR1420041010050500013M02606", "bic": "DEUTDEFF"}), "Beta")
    assert rib.issues == ["the name is not the expected one", "BIC 'DEUTDEFF': its country is not the account's; the value is kept"] and rib.summary == "RIB"
    assert one("rib", envelope("rib", {"bank_name": "B"})).issues == ["no text could be read"]
    assert [one("rib", t).refused for t in (None, "", "{", envelope("kbis", {}), '{"schema_name": "rib", "result": []}')] == ["json", "json", "json", "schema", "result"]
    assert one("rib", "{").issues is None
    with pytest.raises(ValueError, match="unknown normalisers"):
        mappings.mapped(spark.createDataFrame([("{}",)], "v string"), "v", "odd", TODAY, mapping=mappings.Mapping("odd", "n", (("a", "b", "guess"),), ("a",)))


def test_repaired_json(spark):
    one = '{"k": "a\\"b\\\\", "n": [1]}'
    rows = [one, json.dumps(one), json.dumps(json.dumps(one)), json.dumps(json.dumps(json.dumps(json.dumps(one)))), '"text"', "{", "", None, "3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, t string").select("id", labels.decoded_json(F.col("t")).alias("x"))
    got = {r.id: (r.k, r.layers) for r in df.select("id", F.try_variant_get("x.json", "$.k", "string").alias("k"), "x.layers").collect()}
    assert [got[i][0] for i in range(3)] == ['a"b\\'] * 3 and [got[i][1] for i in range(9)] == [0, 1, 2, 3, None, None, None, None, 0]
