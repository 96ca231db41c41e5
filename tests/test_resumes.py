"""Sections, entries and categories against a plain version that collects whole sections first."""

import random
import re

from talweg.operators import resumes

KEYWORDS = {"experience": ["expérience", "mission"], "skills": ["compétence", "skill"], "education": ["formation"]}


def plain(text):
    """{section: [(kind, title, subtitle, period, items)]}"""
    lines, now = {}, "intro"
    for line in (text or "").split("\n"):
        m = re.match(r"^(#{1,2})\s+(.+)$", line)
        known = m and next((s for s, k in KEYWORDS.items() if any(w in m[2].lower() for w in k)), None)
        if known:
            now = known
        elif line.strip() and line.strip() != "<!-- image -->":
            lines.setdefault(now, []).append(line)
    out = {}
    for section, own in lines.items():
        found = out.setdefault(section, [])
        for line in own:
            bare = line.strip()
            m = re.match(r"^#{1,3}\s+(.+)$", line)
            if section == "skills":
                bold, named = re.match(r"^\*\*([^*]{1,40})\*\*\s*:?\s*(.*)$", bare), re.match(r"^([A-ZÀ-Üa-zà-ü][^:]{1,35})\s*:\s*(.{3,})$", bare)
                cut = lambda x, signs: [y.strip() for y in re.split(signs, x) if y.strip()]
                if m:
                    found.append(["category", m[1].strip(), "", "", [], True])
                elif bold:
                    found.append(["category", bold[1].strip(), "", "", cut(bold[2], "[,;|]"), True])
                elif named:
                    if cut(named[2], "[,;|/]"):
                        found.append(["category", named[1].strip(), "", "", cut(named[2], "[,;|/]"), False])
                else:
                    if not found or not found[-1][5]:
                        found.append(["category", "Compétences", "", "", [], True])
                    found[-1][4] += cut(re.sub(r"^[-•*]\s+", "", bare), "[,;|/]")
                continue
            if m or (section != "intro" and re.match(r"^\*\*(.+?)\*\*", line) and re.search(r"\d{4}", line)):
                raw = m[1] if m else bare.replace("*", "")
                period, p = "", re.search(r"\(([^)]*\d{4}[^)]*)\)|(\d{4}\s*[-–]\s*(?:\d{4}|présent|en cours))", raw, re.IGNORECASE)
                if p:
                    period, raw = p[1] or p[2], raw[: p.start()].rstrip("( ") + raw[p.end() :].lstrip(") ")
                two = re.split(r"\s+[-–|@]\s+|\s+chez\s+|\s+at\s+|\s+pour\s+", raw.strip(), maxsplit=1, flags=re.IGNORECASE)
                found.append(["entry", two[0].strip(), two[1].strip() if len(two) > 1 else "", period.strip(), [], not period])
            else:
                if not found and section == "intro":
                    found.append(["entry", "", "", "", [], False])
                if found:
                    e = found[-1]
                    if e[5] and re.fullmatch(r"(?:(?:jan|mars?|sep)\.?\s+)?\d{4}\s*[-–]\s*(?:\d{4}|présent|en cours)", bare, re.IGNORECASE):
                        e[3] = bare
                    elif x := re.sub(r"^[-•*]\s+", "", bare):
                        e[4].append(x)
                    e[5] = False
        out[section] = [tuple(e[:5]) for e in found if e[0] == "entry" or e[4]]
    return {s: v for s, v in out.items() if v}


LINES = ["# Jean Dupont", "## Expérience professionnelle", "## Compétences", "# Formation", "## Chef - Alpha (2019-2021)", "### Dev chez Beta", "2019 - présent", "sep. 2020 - 2021", "**Lead** 2018 - 2020", "**Langages** : Java, C++; Go", "Outils : git/svn", "- item one", "• item two, three", "", "   ", "<!-- image -->", "#### deep", "plain text", "A: b"]


def test_parts(spark):
    rng = random.Random(5)
    texts = [(k, "\n".join(rng.choice(LINES) for _ in range(rng.randrange(25)))) for k in range(300)] + [(900, None), (901, ""), (902, "## Mission\n" + "## A chez B\n- x\n" * 5000)]
    df = spark.createDataFrame([(*t, 1, "z") for t in texts], "id int, text string, part int, kind string")
    got = {}
    for r in resumes.parts(df, "id", "text", KEYWORDS).collect():
        got.setdefault(r.id, {}).setdefault(r.section, []).append((r.part, (r.kind, r.title, r.subtitle, r.period, list(r["items"]))))
    got = {k: {s: [x for _, x in sorted(v, key=lambda y: y[0])] for s, v in own.items()} for k, own in got.items()}
    want = {k: v for k, t in texts if (v := plain(t))}
    for k in want:
        assert got.get(k) == want[k], (k, texts[k] if k < 300 else k)
    assert set(got) == set(want)


def test_headings_without_letters(spark, tmp_path):
    """A heading that begins with `chez` has no separator, in the query and in its oracle; one with a year in brackets is as before."""
    import duckdb

    from talweg.plans import catalogue

    texts = ["a\n2024 !\nb\nc\nd\ne\n12\nf", "a\nShop\n5\n6", "\n".join(str(i) for i in range(70))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalogue.QUERIES["ext_02_entries"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert (0, "experience", 0, "chez Maison 1", "", "", 4) in got
    assert got == sorted(con.execute(catalogue.ORACLES["ext_02_entries"]).fetchall())
