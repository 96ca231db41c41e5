import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talweg.functions import report
from talweg.operators import skills

DICTIONARY = [("plsql", "PL/SQL"), ("ci/cd", "CI/CD"), ("C/C++", "C/C++"), ("pub/sub", "Pub/Sub"), ("aws", "AWS"), ("gcp", "GCP"), ("google cloud", "GCP"), ("ssis", "SSIS"), ("ssrs", "SSRS"), ("SQL", "SQL"), ("nosql", "NoSQL"), ("ml", "Machine Learning"), ("dl", "Deep Learning"), ("j2ee", "J2EE"), ("java", "Java")]
WHOLE = ["PL/SQL", "CI/CD", "TCP/IP", "I/O", "UX/UI", "A/B testing", "MOA/MOE", "S/4HANA", "C/C++", "Pub/Sub", "Oracle PL/SQL", "GitLab CI/CD", "HTML/CSS"]
CUT = {
    "Python/Java": ["Python", "Java"], "AWS / Azure": ["AWS", "Azure"], "aws/Azure": ["AWS", "Azure"], "AWS/GCP": ["AWS", "GCP"], "SSIS/SSRS": ["SSIS", "SSRS"],
    "SQL/NoSQL": ["SQL", "NoSQL"], "ML/DL": ["Machine Learning", "Deep Learning"], "Java/J2EE": ["Java", "J2EE"], "R/Python": ["Python"], "CI/CD/DevOps": ["CI/CD", "DevOps"],
    "Python, Pandas;Modélisation,modelisation": ["Python", "Pandas", "Modélisation"], "TCP / IP": ["TCP", "IP"], "/Java": ["Java"], "Java/": ["Java"], "SQL//NoSQL": ["SQL", "NoSQL"],
    "Google  Cloud, gcp": ["GCP"], "": [], "/": [], "UX/UI/AB": ["UX/UI/AB"], "UX/UI/ABC/D": ["UX/UI/ABC"],
}


def flat(spark, lists, dictionary=DICTIONARY):
    df = spark.createDataFrame([(i, x, "x") for i, x in enumerate(lists)], "id long, items array<string>, name string")
    rows = skills.flat_skills(df, "items", spark.createDataFrame(dictionary, "alias string, name string")).collect()
    assert [f for f in rows[0].__fields__] == ["id", "items", "name", "skills"] if rows else True
    return [r.skills for r in sorted(rows)]


def test_slashes_and_names(spark):
    lists = [*([x] for x in WHOLE), *([x] for x in CUT), None, [], [None, ""], ["Oracle PL/SQL", "CI/CD", None, "Docker/Kubernetes", "TCP/IP", "ci/cd"], ["AWS/GCP"], ["A/" * 5000 + "Java"]]
    got = flat(spark, lists)
    n = len(WHOLE)
    assert got[:n] == [[x] for x in WHOLE]
    assert dict(zip(CUT, got[n:], strict=False)) == CUT
    assert got[n + len(CUT) :] == [[], [], [], ["Oracle PL/SQL", "CI/CD", "Docker", "Kubernetes", "TCP/IP"], ["AWS", "GCP"], ["A/A/A/A", "Java"]]
    assert flat(spark, []) == [] and flat(spark, [["SQL/NoSQL", "AWS/GCP"]], []) == [["SQL", "NoSQL", "AWS/GCP"]]


def plainly(segment, known):
    """One slash after the other, over the whole of what stands left of it."""
    out, *rest = [[x] for x in segment.split("/")]
    for (right,) in rest:
        left = out[-1]
        if not left.strip() or not right.strip() or left[-1].isspace() or right[0].isspace():
            out.append(right)
            continue
        a, b = left.split()[-1], right.split()[0]
        keep = f"{a}/{b}" in known or (not (a in known and b in known) and skills.acronym(a) and skills.acronym(b))
        if keep:
            out[-1] = f"{left}/{right}"
        else:
            out.append(right)
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("AbC1/ /\t", max_size=24), st.sets(st.text("AbC1/", min_size=1, max_size=6), max_size=12))
def test_cut_is_the_plain_rule(segment, known):
    assert skills.cut(segment, known) == plainly(segment, known)
    assert skills.cut(segment, known & skills.asked_words(segment, 30)) == plainly(segment, known)


def test_categories_in_their_order(spark):
    rows = [(1, 3, "aws"), (1, 1, "Python"), (1, 2, "python "), (1, 0, "Zumba"), (1, 9, "ZUMBA"), (1, 4, None), (1, 5, "  "), (1, 6, "Google Cloud"), (1, 7, "odd"), (None, 1, "AWS"), (2, 1, "")]
    known = spark.createDataFrame([("aws", "AWS", "cloud"), ("google-cloud", "GCP", "cloud"), ("python", "Python", "code"), ("odd", "Odd", "elsewhere")], "alias string, name string, category string")
    df = spark.createDataFrame(rows, "id long, at int, term string").selectExpr("id", "at", "term", "'x' AS name", "1 AS rank")
    got = {r.id: [(g.category, g["items"]) for g in r.groups] for r in skills.by_category(df, "id", "at", "term", known, ["code", "data", "cloud"], "other").collect()}
    assert got == {1: [("code", ["Python"]), ("cloud", ["AWS", "GCP"]), ("other", ["Zumba", "odd"])], None: [("cloud", ["AWS"])]}
    assert skills.by_category(df.where("false"), "id", "at", "term", known, ["code"], "other").count() == 0


def test_fill_report(spark):
    df = spark.createDataFrame([(["a", ""], {"x": " ", "y": "1"}, ("a", None), 2.9, " ", None), (None, None, None, None, None, "b")], "a array<string>, m map<string,string>, s struct<p: string, q: int>, n double, t string, u string")
    counts, missing, usable = report.fill_report(df, {k.upper(): k for k in df.columns}, ["A", "U"])
    got = [(r[0], r[1], r[2]) for r in df.select(counts, missing, usable).collect()]
    assert got[0] == ({"A": 2, "M": 1, "S": 1, "N": 2, "T": 0, "U": 0}, ["T", "U"], False)
    assert got[1] == ({"A": 0, "M": 0, "S": 0, "N": 0, "T": 0, "U": 1}, ["A", "M", "S", "N", "T"], False)
    with pytest.raises(ValueError):
        report.fill_report(df, {"A": "a"}, ["B"])
