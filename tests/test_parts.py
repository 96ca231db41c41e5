from pyspark.sql import functions as F

from talweg.operators import parts, pii
from talweg.plans import catalogue
from talweg.sources.tables import table

SCHEMA = "conv long, turn long, text string"


def brute(rows, first_names=(), header=4):
    """{row: (spans, masked)}: the parts of each whole one after the other, with one memory of words."""
    wholes, once, out = {}, {}, {}
    for conv, turn, text in set(rows):
        once[conv, turn, text] = pii.shown(text, first_names, turn is not None and turn < header) if text else pii.Taken()
        wholes.setdefault(conv, []).append((turn, text))
    for conv, turns in wholes.items():
        memory = set()
        for turn in sorted({t for t, _ in turns}, key=lambda t: (t is not None, t or 0)):
            alike = [x for t, x in turns if t == turn]
            own = {x: pii.known_words(x, once[conv, turn, x].spans) if x else set() for x in alike}
            alone = conv is None or turn is None
            memory |= set() if alone else set().union(*own.values())
            for x in alike:
                taken = once[conv, turn, x]
                for a, b in places(pii.plain(x or ""), own[x] if alone else memory):
                    taken.put("identite", a, b)
                out[conv, turn, x] = taken.spans, x and pii.mask(x, taken.spans)
    return out


def places(low, words):
    at, free = 0, lambda i: not 0 <= i < len(low) or low[i] not in "abcdefghijklmnopqrstuvwxyz0123456789"
    while at < len(low) and words:
        ends = [at + len(w) for w in words if low.startswith(w, at) and free(at - 1) and free(at + len(w))]
        if ends:
            yield at, max(ends)
        at = max(ends, default=at + 1)


def compare(spark, rows, names=None, header=4):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("g", F.lit("extra")).withColumn("words", F.lit(1))
    table_of_names = None if names is None else spark.createDataFrame([(n,) for n in names], "n string")
    got = parts.detected(df, "conv", "turn", "text", table_of_names, header).collect()
    want = brute(rows, {pii.plain(n) for n in names or () if n}, header)
    shown = sorted(repr((r.conv, r.turn, [(d.type, d.start, d.end) for d in r.detections], r.masked)) for r in got)
    assert shown == sorted(repr((c, t, *want[c, t, x])) for c, t, x in rows)
    return got


ROWS = [
    (1, 0, "Marie Curie"),
    (1, 5, "La physique de curie, CURIE; Curies"),
    (1, 2, "M. Jean-Paul O'Brien écrit à karim.benali@example.org"),
    (1, 7, "BÉNALI, jean-paul et o'brien, jean, Karim."),
    (1, 1, "benali avant le courriel"),
    (2, 5, "curie ailleurs, Lina parle"),
    (2, None, "Mme Grace Hopper"),
    (2, 6, "hopper"),
    (None, 0, "Ada Byron"),
    (None, 1, "byron"),
    (3, 0, None),
    (3, 1, ""),
    (1, 5, "La physique de curie, CURIE; Curies"),
    (1, 2, "benali au même tour"),
    (4, 9, "İ M. İlker Dupont " + "x " * 30000 + "dupont"),
]


def test_known_words_reach_later_parts(spark):
    got = compare(spark, ROWS)
    said = {(r.conv, r.turn): r for r in got}
    assert [d.context for d in said[1, 7].detections][:2] == ["…❰BÉNALI❱, jean-paul et o'brien, jean…", "…BÉNALI, ❰jean-paul❱ et o'brien, jean, Karim.…"]
    assert said[1, 1].detections == [] == said[2, 6].detections and said[3, 0].masked is None


def test_header_and_first_names(spark):
    got = compare(spark, ROWS, ["LINA", "lina", None, "", "Jean"], header=0)
    assert {(r.conv, r.turn): len(r.detections) for r in got}[2, 5] == 1
    assert compare(spark, []) == []


def test_one_whole_of_many_parts(spark):
    compare(spark, [(7, i, f"M. Nom{chr(97 + i % 20)}{chr(97 + i % 7)} et toma, nomab, nomcd" if i % 3 else "Dr Toma") for i in range(300)])


def test_all_lines_of_all_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").collect()
    rows = [(d.doc_id, i, x) for d in docs for i, x in enumerate(d.text.split("\n"))]
    names = {pii.plain(r.name) for r in catalogue.stateful.first_names(spark, sf_dir).collect()}
    want = brute(rows, names)
    got = catalogue.QUERIES["pii_06_lines"](spark, sf_dir).collect()
    assert got and len(got) == sum(bool(spans) for spans, _ in want.values())
    by_place = {(i, n): v for (i, n, _), v in want.items()}
    assert all([(d.type, d.start, d.end) for d in r.detections] == by_place[r.doc_id, r.line][0] for r in got)


def test_texts_meet_small_tables_unshuffled(spark, sf_dir):
    """Few words are known: no text is shuffled or sorted for them, and only texts with something in them go to Python."""
    plan = catalogue.QUERIES["pii_06_lines"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert plan.count("MapInArrow") == 1 and "Filter (isnotnull(words" in plan


def test_what_is_skipped_shows_nothing():
    """Labels, titles and sites in any case, without accents, and with signs that count as other letters: what the searches themselves find."""
    found = lambda t: {(k, t[a:b]) for k, a, b in pii.shown(t, (), False).spans}
    for label in pii.LABELS:
        for spelt in (label, label.upper(), label.capitalize(), label.replace("é", "e"), label.replace("s", "ſ"), label.upper().replace("I", "İ"), label.replace("i", "ı"), label.replace(" par", "e par")):
            assert found(f"le {spelt} : Ada") == ({("identite", "Ada")} if pii._LABELLED.search(f"le {spelt} : Ada") else set())
        assert found(f"le {label.upper()} Ada") == {("identite", "Ada")}
    for title in pii.TITLES:
        assert found(f"à {title}  Ada") == {("identite", "Ada")}
    for site in pii.PROFILES:
        assert found(f"voir WWW.{site.upper()}/ada") == {("lien", f"WWW.{site.upper()}/ada")}
    for t in ("x +33 6 12 34 56 78", "le 1er mai 2012", "12 €", "ada@x.org", "ada(AT)x.org", "12 rue Ada", "x.com/", "ada MARTINET Bo", "Ada MARTINET"):
        want = pii.Taken()
        for kind, stretches in (*pii.KINDS, ("identite", lambda r: pii._identity(r, (), False))):
            for a, b in stretches(pii.read(t)):
                want.put(kind, a, b)
        assert pii.shown(t, (), False).spans == want.spans
