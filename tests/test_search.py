"""Dictionary search and offers against plain versions."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from talweg.operators import offers, search
from talweg.plans import texts
from talweg.plans.registry import QUERIES
from talweg.sources.tables import table

LETTER = "a-z0-9_" + "".join(chr(c) for c in range(0xC0, 0x250))


def plain(text, terms, overlaps=False):
    """(start, end, name) by one pattern a term, over the text without case and accents; doubled white space is any."""
    flat = ""
    for c in text or "":
        base = unicodedata.normalize("NFD", c.lower())
        c = base[0] if all(map(unicodedata.combining, base[1:])) else c
        flat += " " if c.isspace() or c == "_" else "'" if c in "‘’′" else "-" if c in "‐‑‒–—―" else c
    found = []
    for key, name, vetoes in terms:
        short = "+#." if len(key) <= 2 else ""
        after = short or (key[-1] if key[-1] in "+#" else "")
        pattern = rf"(?<![{LETTER}{re.escape(short)}]){re.escape(key).replace(chr(92) + ' ', ' +')}(?![{LETTER}{re.escape(after)}])"
        for m in re.finditer(f"(?=({pattern}))", flat):
            a, b = m.span(1)
            squeezed, left = re.sub(" +", " ", flat), len(re.sub(" +", " ", flat[:a]))
            around = squeezed[max(0, left - 18) : left + len(key) + 18]
            if not any(re.search(v, around) for v in vetoes):
                found.append((len(key), key, a, b, name))
    if overlaps:
        return sorted(x[2:] for x in found)
    out, taken = [], set()
    for _, _, a, b, name in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        if not taken & set(range(a, b)):
            taken |= set(range(a, b))
            out.append((a, b, name))
    return sorted(out)


TERMS = [("go", "Go", [r"\bno\s*[-/]?\s*go\b"]), ("r", "R", [r"\br\s*&\s*d\b"]), ("c", "C", [r"\bc\s*\+\s*\+", r"\bc\s*#"]), ("c++", "C++", []), ("c#", "C#", []), ("node.js", "Node.js", []), ("power bi", "Power BI", []), ("talend", "Talend", []), ("talend cloud", "Talend Cloud", []), ("ete", "Été", []), ("l'ia", "IA", []), ("cloud native", "Cloud native", [])]
TEXTS = ["Go, go/no-go: R&D en R. C++ et C# puis C", "Power   BI\n\nPOWER_BI power-bi Talend  Cloud native, Node.js.", "Talend cloud Talendx étéx ÉTÉ l’IA", None, "", "talend " * 3000 + "end", "İstanbul go ß power\tbi", "c++ c+++ c## node.jsx .r r. go# go"]


@pytest.mark.parametrize(("block", "overlaps"), [(1 << 20, False), (12, False), (12, True)])
def test_terms_in_texts(spark, monkeypatch, block, overlaps):
    monkeypatch.setattr(search, "BLOCK", block)
    terms = spark.createDataFrame([(f" {k.upper()}, ", n, "t", 2.0, v) for k, n, v in TERMS] + [("..", "nothing", "t", 1.0, []), (None, "none", "t", 1.0, [])], "alias string, name string, category string, weight double, vetoes array<string>")
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x", 1)], "id int, text string, found string, start int")
    got = {}
    for r in search.find_terms(docs, ["id"], "text", terms, overlaps).collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.name))
    want = {i: h for i, t in [*enumerate(TEXTS), (None, TEXTS[0])] if (h := plain(t, TERMS, overlaps))}
    assert {i: sorted(h) for i, h in got.items()} == want
    assert search.find_terms(docs.where("false"), ["id"], "text", terms).count() == 0
    assert search.find_terms(docs, ["id"], "text", terms.where("false")).count() == 0
    assert search.with_hits(docs, docs["text"], terms).select("row.found", "row.start").distinct().count() == 1


def test_a_block_is_bounded(spark):
    """An automaton of BLOCK bytes of terms holds some tens of megabytes."""
    import random

    rng, terms, size = random.Random(2), [], 0
    while size < search.BLOCK:
        terms.append("".join(rng.choice("abcdefghij klmnopqrstuvwxyz") for _ in range(rng.randrange(3, 25))).strip() or "x")
        size += len(terms[-1])
    assert search._Dictionary([(t, t, t, None, None, None) for t in terms]).automaton.get_stats()["total_size"] < 64 << 20


def test_spans_of_a_table(spark, sf_dir):
    veto = [r"\b(?:de|in)\s+(?:la|the|der)\b"]
    terms = [(r.alias, r.name, veto if r.alias in ("de", "in") else []) for r in texts.dictionary(spark, sf_dir).collect()]
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect() if len(r.text or "") < 3000][::4]
    got = {}
    for r in QUERIES["joi_10_dictionary_spans"](spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.name))
    assert terms and all(sorted(got.get(i, [])) == plain(t, terms) for i, t in docs)


def test_demands_and_versions(spark):
    terms = spark.createDataFrame([("dbt", "dbt", "technology", 3.0), ("terraform", "Terraform", "technology", 2.0), ("itil", "ITIL", "technology", 1.0), ("itil v4", "ITIL v4", "technology", 1.0), ("azure devops", "Azure DevOps", "technology", 2.0), ("azure", "Azure", "technology", 0.0)], "alias string, name string, category string, weight double")
    docs = spark.createDataFrame([(1, "Maîtrise impérative de dbt. Terraform est un plus\nITIL v4; Azure"), (2, "Terraform serait un atout. Terraform indispensable"), (3, None), (4, "rien")], "id int, text string")
    asked = offers.demands(docs, ["id"], terms)
    assert {(r.id, r.name): r.weight for r in asked.collect()} == {(1, "dbt"): 4.5, (1, "Terraform"): 1.2, (1, "ITIL v4"): 1.0, (1, "Azure"): 0.0, (2, "Terraform"): 3.0}
    missions = spark.createDataFrame([("p", 2024, "dbt et ITIL"), ("p", 2010, "dbt"), ("q", 2016, "Azure DevOps, Terraform"), ("r", None, "Terraform"), ("s", 2020, None)], "profile string, year int, text string")
    has = offers.skills(search.find_terms(missions, ["profile", "year"], "text", terms), "profile", "year")
    got = {(r.id, r.profile): (round(r.obtained, 6), r.matched) for r in offers.technology_matches(asked, has, "id", "profile", 2025).collect()}
    old = max(0.4, 2.718281828459045 ** (-(9 - 2) / 7))
    assert got == {(1, "p"): (round(4.5 + 0.85, 6), 2), (1, "q"): (round(1.2 * old, 6), 1), (2, "q"): (round(3 * old, 6), 1), (1, "r"): (round(1.2 * 0.7, 6), 1), (2, "r"): (round(3 * 0.7, 6), 1)}
    assert {(r.name, r.other) for r in offers.versions(spark.createDataFrame([("ITIL",), ("itil v4",), ("Java 8",), ("Java",), ("Azure",), ("Azure DevOps",), ("x",)], "name string")).collect()} == {("ITIL", "itil v4"), ("itil v4", "ITIL"), ("Java", "Java 8"), ("Java 8", "Java")}


def test_years_asked(spark):
    cases = [("5 ans d'expérience, 8 ans sur X", 5), ("minimum 3 années", 3), ("au moins 12 ans", 12), ("7+ ans", 7), ("de 5 à 7 ans", 5), ("il y a 40 ans", None), ("depuis 4 ans et 6 ans", 6), ("", None), (None, None)]
    df = spark.createDataFrame(cases, "t string, n int")
    assert [r.got for r in df.select(offers.years_asked(F.col("t")).alias("got")).collect()] == [n for _, n in cases]


def test_pairs_are_not_shuffled(spark):
    """Sums over shared names of all pairs, in blocks: as a plain double loop has them, and no join or exchange of pairs."""
    import random

    rng, kind = random.Random(4), "array<struct<sum int, name string, value double>>"
    some = lambda: [(k, n, rng.choice([0.5, 1.0, 2.5])) for k in range(2) for n in rng.sample("abcdefgh", rng.randrange(5))]
    has, asks = [(i, rng.choice([None, some()])) for i in range(600)], [(-i, f"t{i}", some()) for i in range(30)] + [(None, None, None)]
    rows, queries = spark.createDataFrame(has, f"p long, has {kind}"), spark.createDataFrame(asks, f"q long, t string, asks {kind}")
    pairs = offers.shared_sums(rows, queries, ["x", "y"])
    want = set()
    for p, own in has:
        for q, t, theirs in asks:
            asked = {(k, n): v for k, n, v in theirs or ()}
            want.add((p, q, t, *(sum(v * asked[k, n] for k, n, v in own or () if k == axis and (k, n) in asked) for axis in (0, 1))))
    got = pairs.collect()
    assert len(got) == 600 * 31 and {tuple(r) for r in got} == want
    assert offers.shared_sums(rows, queries.where("false"), ["x"]).count() == 0


def test_all_profiles_meet_all_offers_in_blocks(spark, sf_dir):
    """Exchanges of the plan come before the pairs are made."""
    plan = QUERIES["sco_16_offers_profiles"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and not any(x in plan[: plan.index("MapInArrow")] for x in ("Exchange", "Join"))


def test_letters_within_words_cost_nothing(spark):
    """Terms of words are looked for from word to word, not at each letter, and their tree is bounded like the automaton."""
    import random
    import tracemalloc

    known = search._Dictionary([(w, w, w, None, None, None) for w in ("a", "e", "a b", "a b c", "b c d", "c++")])
    assert sorted((h[0], h[1], h[2]) for h in known.hits("banane a b  c d a b c++ eae -e.a")) == [(7, 8, "a"), (7, 10, "a b"), (16, 17, "a"), (16, 19, "a b"), (16, 21, "a b c"), (20, 23, "c++")] and not list(known.automaton.iter("banane a b c d a e"))
    rng = random.Random(2)
    terms = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(2)) for _ in range(search.BLOCK // 13)]
    tracemalloc.start()
    try:
        kept = search._Dictionary([(t, t, t, None, None, None) for t in terms])
        assert kept.words and tracemalloc.get_traced_memory()[0] < 96 << 20
    finally:
        tracemalloc.stop()
