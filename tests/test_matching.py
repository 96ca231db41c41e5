"""Engine A against a plain version that shares no code with it."""

import difflib
import math
import re

from talweg.operators import matching

NEED = "need_title string, required array<string>, least int, level string, client string, sector string, context string, languages array<string>, place string, remote string, contract string"
CANDIDATE = "title string, skills array<string>, years int, status string, text string, done string, spoken string, certificates int, home string"
NEEDS = [
    ("Développeur Java senior", ["java", "kubernetes", "postgresql"], 5, "senior", "Banque Postale", "finance", "", ["anglais"], "Paris", "remote partiel", "freelance"),
    ("", [], 0, "", None, None, None, None, None, None, None),
    ("data", ["Java", None], 10, "expert", "", "", "le la", [], "Lyon", "", "Tous"),
]
CANDIDATES = [
    ("Développeur Java", ["Java", "kubernets", "docker"], 7, "Non disponible", "développeur java finance freelance", "java, kubernetes", "Anglais courant", 2, "Paris 11e"),
    (None, None, None, None, None, None, None, None, None),
    ("Chef de projet", ["javascript", None], 4, "sous 2 mois", "lyon banque", "", "", 0, "Nantes"),
    ("Développeur Java", ["Java", "kubernets", "docker"], 7, "Non disponible", "développeur java finance freelance", "java, kubernetes", "Anglais courant", 2, "Paris 11e"),
    ("", [], 12, "", "", "", "", 0, "lyom"),
]
STOP = "le la les de du des un une et en ou au aux avec pour sur dans par est sont the a of and or".split()


def half_up(x):
    return math.floor(x * 100 + 0.5) / 100


def overlap(query, text):
    words = [w for w in re.findall(r"\w+", query.lower()) if len(w) > 2 and w not in STOP]
    return sum(w in text for w in words) / len(words) if words else 0.5


def plain(need, cand):
    nt, req, least, level, client, sector, context, langs, place, remote, contract = need
    title, skills, years, status, text, done, spoken, certs, home = ((x or "") if i not in (1, 2, 7) else x for i, x in enumerate(cand))
    req, skills, years, text = [r for r in req or [] if r], [s.lower() for s in skills or [] if s], years or 0, text.lower()
    same = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
    missing = [r for r in req if not any(r.lower() in s or s in r.lower() or same(r, s) > 0.82 for s in skills)]
    p = [half_up((len(req) - len(missing)) / len(req) * 35) if req else 35.0]
    p.append(half_up((0.6 * same(nt, title) + 0.4 * overlap(nt, text)) * 20) if nt else 10.0)
    bands = {"junior": (0, 2), "confirmé": (3, 5), "senior": (6, 9), "expert": (10, 99)}
    s = (0.5 if years >= least else 0.3 if years >= 0.8 * least else 0) if least else 0
    if level in bands:
        low, high = bands[level]
        s += 0.5 if low <= years <= high else 0.35 if years > high else 0.25 if years >= low - 1 else 0
    p.append(half_up(min(0.6 if not least and not level else s, 1) * 15))
    table = (("disponible", 10), ("immédiat", 10), ("30 jours", 7), ("1 mois", 7), ("60 jours", 4), ("2 mois", 4), ("3 mois", 2))
    p.append(next((v for k, v in table if k in status.lower()), 5))
    signals = [overlap(x, text) for x in (client, sector, context) if x and x.strip()] + ([sum(r.lower() in done.lower() for r in req) / len(req)] if req else [])
    p.append(half_up(sum(signals) / len(signals) * 10) if signals else 4.0)
    b = 2 * any(x.lower() in spoken.lower() for x in langs or []) + 2 * bool(certs) + 2 * any(k in " ".join(skills) for k in "aws azure gcp cloud databricks snowflake kubernetes docker".split())
    if place and home:
        near = place.lower() in home.lower() or home.lower() in place.lower() or same(place, home) > 0.7
        b += 2 if near else 1 if re.search("remote|flex", (remote or "").lower()) else 0
    b += 2 * ((contract or "").lower() not in ("", "all", "tous") and contract.lower() in text)
    p.append(min(b, 10))
    return [*p, missing, min(100.0, half_up(sum(p)))]


def test_whole_engine(spark):
    needs = spark.createDataFrame([(i, *n) for i, n in enumerate(NEEDS)], "need long, " + NEED)
    cands = spark.createDataFrame([(i, *c) for i, c in enumerate(CANDIDATES)], "cand long, " + CANDIDATE)
    rows = matching.ranked(matching.scored(cands.crossJoin(needs)), "need", "cand", 50).collect()
    assert len(rows) == len(NEEDS) * len(CANDIDATES)
    for r in rows:
        got = [*(round(float(r[f"{p}_points"]), 2) for p in matching.PARTS), r.missing, r.total]
        assert got == [round(x, 2) if not isinstance(x, list) else x for x in plain(NEEDS[r.need], CANDIDATES[r.cand])], (r.need, r.cand)
    for n in range(len(NEEDS)):
        kept = sorted((r for r in rows if r.need == n and r.total >= 50), key=lambda r: (-r.total, r.cand))
        assert [r["rank"] for r in kept] == list(range(1, len(kept) + 1)) and all(r["rank"] is None for r in rows if r.need == n and r.total < 50)
    assert matching.scored(cands.where("false").crossJoin(needs)).count() == 0
