"""Dictionary search and offers over whole tables: the dictionary is made of the words, pairs and triples of `benchmark`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions import records, report, scores
from talweg.functions.text import fold
from talweg.operators import envelopes, offers, resumes, search, skills
from talweg.operators.blocks import spread
from talweg.plans.registry import query
from talweg.sources.tables import stored, table

C = F.col
_LETTER = "a-z0-9\u00c0-\u024f"
KINDS = ("technology", "technology", "functional", "sector", "role")
AXES = ("technology", "functional", "sector", "role", "role")


def dictionary(spark: SparkSession, d: str, words: int = 3, least: int = 1) -> DataFrame:
    """alias, name, category, weight: folded runs of one to `words` words (a space between), of `least` letters or more, that at least two benchmark items have."""
    flat = F.lower(fold(C("text")))
    grams = [F.regexp_extract_all(flat, F.lit(rf"(?=(?<![{_LETTER}])([a-z]+(?: [a-z]+){{{n}}})(?![{_LETTER}]))(?<![{_LETTER}])[a-z]+"), F.lit(1)) for n in range(words)]
    found = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.concat(*grams))).alias("alias"))
    kinds = F.array(*map(F.lit, KINDS))
    known = found.groupBy("alias").agg(F.count(F.lit(1)).alias("items")).where((C("items") >= 2) & (F.length("alias") >= least))
    return known.select("alias", C("alias").alias("name"), F.get(kinds, (F.ascii("alias") + F.length("alias")) % len(KINDS)).alias("category"), (C("items") % 4 + 1).cast("double").alias("weight"))


# DuckDB: the same dictionary; and words with their places, as terms stand in texts (letters that have no base letter join words)
_FLAT = "translate(strip_accents(lower(text)), 'ßœæø', '1111')"
_GRAMS = """SELECT {id}, array_to_string(w[b : b + n - 1], ' ') AS alias FROM (SELECT {id}, w, n, unnest(range(1, len(w) - n + 2)) AS b FROM {words}, range(1, 4) a(n))"""
_KNOWN = f"""
    bpieces AS (SELECT item_id, unnest(regexp_split_to_array({_FLAT}, '[^a-z0-9 ]|  +')) AS piece FROM benchmark),
    bwords AS (SELECT item_id, string_split(trim(piece), ' ') AS w FROM bpieces),
    bgrams AS ({_GRAMS.format(id="item_id", words="bwords")}),
    known AS (SELECT alias, count(DISTINCT item_id) AS items FROM bgrams WHERE regexp_full_match(alias, '[a-z]+( [a-z]+)*') GROUP BY 1 HAVING items >= 2)"""


@query(
    "joi_10_all_hits",
    f"""WITH {_KNOWN},
    dpieces AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace({_FLAT}, '[\\s_]+', ' ', 'g'), '[^a-z0-9 ]')) AS piece FROM documents),
    dwords AS (SELECT doc_id, list_filter(string_split(piece, ' '), lambda x: x != '') AS w FROM dpieces),
    dgrams AS ({_GRAMS.format(id="doc_id", words="dwords")})
    SELECT doc_id, alias, count(*) AS n FROM dgrams JOIN known USING (alias) WHERE length(alias) > 2 GROUP BY 1, 2""",
)
def _(spark, d):
    """All places of all terms of over two characters in all documents, overlapping ones too."""
    terms = dictionary(spark, d, least=3)
    return search.find_terms(table(spark, d, "documents"), ["doc_id"], "text", terms, overlaps=True).groupBy("doc_id", "alias").agg(F.count(F.lit(1)).alias("n"))


@query("joi_10_dictionary_spans")
def _(spark, d):
    """The hits that count in all documents, longest first, as spans; `de` and `in` are void before an article."""
    veto = F.when(C("alias").isin("de", "in"), F.array(F.lit(r"\b(?:de|in)\s+(?:la|the|der)\b"))).otherwise(F.array().cast("array<string>"))
    terms = dictionary(spark, d).withColumn("vetoes", veto)
    return search.find_terms(table(spark, d, "documents"), ["doc_id"], "text", terms)


def _offers(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: documents whose id is divisible by 50."""
    return table(spark, d, "documents").where("doc_id % 50 = 0").select(C("doc_id").alias("offer"), "text")


MUST, PLUS = offers.MUST + r"|\bthe\b|\bder\b", offers.PLUS + r"|\bof\b|\bla\b"
_WORDS = lambda text: "unnest(regexp_split_to_array(" + _FLAT.replace("text", text) + ", '[^a-z0-9]+'))"
_WEIGHED = f"""{_KNOWN},
    terms AS (SELECT alias AS name, ({list(KINDS)})[(ascii(alias) + length(alias)) % 5 + 1] AS category, items % 4 + 1.0 AS weight FROM known WHERE length(alias) > 2 AND NOT contains(alias, ' ')),
    told AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\n\r]+|[.;]\\s+')) AS s FROM documents),
    factors AS (SELECT doc_id, s, CASE WHEN regexp_matches(strip_accents(lower(s)), '{MUST}') THEN 1.5 WHEN regexp_matches(strip_accents(lower(s)), '{PLUS}') THEN 0.6 ELSE 1.0 END AS factor FROM told),
    said AS (SELECT doc_id, factor, {_WORDS("s")} AS name FROM factors),
    asked AS (SELECT doc_id, name, category, CASE WHEN max(factor) = 1 THEN weight ELSE floor(weight * max(factor) * 10 + 0.5) / 10 END AS weight FROM said JOIN terms USING (name) GROUP BY doc_id, name, category, weight)"""


@query("sco_10_offer_demands", f"WITH {_WEIGHED} SELECT doc_id, name, category, CAST(weight AS DOUBLE) AS weight FROM asked")
def _(spark, d):
    """What all documents ask for, with weights by the sentences they ask in; `the` and `of` stand for the phrases that invented texts lack."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return offers.demands(docs, ["doc_id"], dictionary(spark, d, 1, 3), must=MUST, plus=PLUS)


def _axes(spark: SparkSession, d: str) -> DataFrame:
    """offer, profile and the five axes of all pairs of an offer and a conversation (the profile; its turns are missions, the first its title)."""
    terms, now = stored(dictionary(spark, d, 1, 3), "terms"), 2025
    asked = stored(offers.demands(_offers(spark, d), ["offer"], terms, must=MUST, plus=PLUS), "asked")
    turns = table(spark, d, "conversations").where("turn is not null").select(C("conv_id").alias("profile"), (2010 + C("turn")).cast("int").alias("year"), "turn", "text")
    hits = stored(search.find_terms(turns, ["profile", "turn", "year"], "text", terms).select("profile", "turn", "year", "name", "category").distinct(), "hits")
    of = lambda df, kind: df.where(C("category") == kind)
    entry = lambda k, value: F.struct(F.lit(k).alias("sum"), "name", value.alias("value"))
    own = [offers.credits(of(asked, "technology"), offers.skills(of(hits, "technology"), "profile", "year"), "profile", now).select("profile", entry(0, C("credit")).alias("has"))]
    shared = (of(hits, "functional"), of(hits, "sector"), of(hits, "role").where("turn = 0"), of(hits, "role").where("turn > 0"))
    own += [df.select("profile", "name").distinct().select("profile", entry(k, F.lit(1.0)).alias("has")) for k, df in enumerate(shared, 1)]
    has = reduce(DataFrame.union, own).groupBy("profile").agg(F.collect_list("has").alias("has"))
    profiles = turns.groupBy("profile").agg(F.count(F.lit(1)).cast("int").alias("years")).join(has, "profile", "left")
    weight = F.when(C("category") == "technology", offers.full_weight(C("weight"))).otherwise(1.0)
    entries = F.explode(F.transform(F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(j).alias("sum")) for j, k in enumerate(AXES)]), lambda x: x["kind"] == C("category")), lambda x: x["sum"]))
    asks = asked.select("offer", "name", weight.alias("value"), entries.alias("sum")).groupBy("offer").agg(F.collect_list(F.struct("sum", "name", "value")).alias("asks"))
    in_order = F.aggregate(F.transform(F.array_sort(F.collect_list(F.when(C("category") == "technology", F.struct("name", "weight")))), lambda x: x["weight"]), F.lit(0.0), lambda a, x: a + x)
    counts = asked.groupBy("offer").agg(*[F.count_if(C("category") == k).alias(f"n_{k}") for k in sorted(set(KINDS))], in_order.alias("total"))
    wanted = _offers(spark, d).select("offer", offers.years_asked(C("text")).alias("asked")).join(counts, "offer", "left").join(asks, "offer", "left")
    both = offers.shared_sums(profiles, wanted, ["obtained", "functional", "sector", "in_title", "in_missions"])
    zero = lambda c: F.coalesce(C(c), F.lit(0)).cast("double")
    title = title_axis_of(zero("in_title"), zero("in_missions"), zero("n_role"))
    return both.select("offer", "profile", scores.technology_axis(zero("obtained"), zero("total")).alias("technology"), scores.set_axis(zero("functional"), zero("n_functional")).alias("functional"), scores.seniority_axis(C("years"), F.coalesce("asked", F.lit(0))).alias("seniority"), scores.set_axis(zero("sector"), zero("n_sector")).alias("sector"), title.alias("title"))


def title_axis_of(in_title, in_missions, asked):
    """Neutral without a role asked for; else by where a role is shared, and without any the least."""
    return F.when(asked == 0, 0.5).otherwise(records.title_axis(in_title > 0, in_missions > 0, F.lit(False), F.lit(False), F.lit(0.0)))


_EXTRACTED = lambda ways: " || ".join("regexp_extract_all(strip_accents(lower(text)), '" + w.replace("'", "''") + "', 1)" for w in ways)
_MOST = lambda ways: f"list_max(list_filter(list_transform({_EXTRACTED(ways)}, lambda x: CAST(x AS INT)), lambda x: x BETWEEN 1 AND 30))"
_COMMON = lambda kind, where: f"(SELECT doc_id, profile, count(DISTINCT name) AS n FROM asked JOIN hits USING (name) WHERE category = '{kind}' AND {where} GROUP BY 1, 2)"
_SET = lambda t, kind: f"CASE WHEN n_{kind} = 0 THEN 0.5 ELSE pow(coalesce({t}.n, 0) / n_{kind}, 0.8) END"


@query(
    "sco_16_offers_profiles",
    f"""WITH {_WEIGHED},
    hits AS (SELECT DISTINCT conv_id AS profile, turn, {_WORDS("text")} AS name FROM conversations WHERE turn IS NOT NULL),
    offers AS (SELECT doc_id, coalesce({_MOST(offers.YEARS_FIRM)}, {_MOST([offers.YEARS_NAMED])}, 0) AS want FROM documents WHERE doc_id % 50 = 0),
    sums AS (SELECT o.doc_id, want, {", ".join(f"count(*) FILTER (category = '{k}') AS n_{k}" for k in sorted(set(KINDS)))}, coalesce(sum(weight) FILTER (category = 'technology'), 0) AS total FROM offers o LEFT JOIN asked USING (doc_id) GROUP BY 1, 2),
    profiles AS (SELECT conv_id AS profile, CAST(count(*) AS DOUBLE) AS years FROM conversations WHERE turn IS NOT NULL GROUP BY 1),
    used AS (SELECT profile, name, 2025 - (2010 + max(turn)) AS gap FROM hits GROUP BY 1, 2),
    tech AS (SELECT doc_id, profile, sum(weight * CASE WHEN gap <= 2 THEN 1.0 ELSE greatest(0.4, exp(-(gap - 2) / 7)) END) AS n FROM asked JOIN used USING (name) WHERE category = 'technology' GROUP BY 1, 2),
    axes AS (SELECT doc_id, profile, CASE WHEN total = 0 THEN 0.5 ELSE pow(least(1.0, coalesce(t.n, 0) / total), 0.8) END AS technology, {_SET("f", "functional")} AS functional, {_SET("s", "sector")} AS sector,
        CASE WHEN want = 0 THEN 0.5 WHEN years - want > 5 THEN greatest(0.5, 1 - (years - want - 5) * 0.05) WHEN years >= want THEN 1 ELSE pow(years / want, 1.4) END AS seniority,
        CASE WHEN n_role = 0 THEN 0.5 WHEN a.n > 0 THEN 1 WHEN b.n > 0 THEN 0.85 ELSE 0.1 END AS title
        FROM sums CROSS JOIN profiles LEFT JOIN tech t USING (doc_id, profile) LEFT JOIN {_COMMON("functional", "true")} f USING (doc_id, profile) LEFT JOIN {_COMMON("sector", "true")} s USING (doc_id, profile)
        LEFT JOIN {_COMMON("role", "turn = 0")} a USING (doc_id, profile) LEFT JOIN {_COMMON("role", "turn > 0")} b USING (doc_id, profile)),
    totals AS (SELECT doc_id AS offer, profile, CAST(floor(40 * technology + 20 * functional + 15 * seniority + 15 * sector + 10 * title + 0.5) AS BIGINT) AS total FROM axes)
    SELECT *, CASE WHEN total >= 75 THEN 'strong' WHEN total >= 55 THEN 'good' WHEN total >= 35 THEN 'partial' ELSE 'weak' END AS band FROM totals""",
)
def _(spark, d):
    """The second engine's total for offers (ids divisible by 50) and all profiles, all five axes from texts."""
    axes = _axes(spark, d)
    total = scores.profile_total(*[C(x) for x in ("technology", "functional", "seniority", "sector", "title")])
    return axes.select("offer", "profile", total.cast("long").alias("total"), scores.band_a(total).alias("band"))


# --- envelopes built from the events: a name, three things done (one without a title), a list of plain values ---------------
_ENVELOPE = (
    "concat('{\"name\": {\"value\": \"', event_type, '\", \"confidence\": 0.', lpad(k, 2, '0'), ', \"evidence_ids\": [\"e', k, '\", \"\", 5]}, \"done\": [',"
    " '{\"title\": {\"value\": \"', event_type, k, '\", \"confidence\": 0.5, \"evidence_ids\": []}, \"year\": ', y0, '}, ',"
    " '{\"title\": {\"value\": null, \"confidence\": \"high\", \"evidence_ids\": [\"t', k, '\"]}, \"year\": ', y1, ', \"items\": [{\"item\": {\"value\": [1, {\"deep\": {\"value\": true, \"model_confidence\": 1}}], \"confidence\": 1}}]}, ',"
    " '{\"year\": ', y2, ', \"extra\": {}}], \"tags\": [\"x\", ', k, ']}')"
)
_BUILT = f"SELECT event_id, y0, y1, y2, {_ENVELOPE} AS doc FROM (SELECT event_id, event_type, k, CAST(2000 + n % 7 AS STRING) AS y0, CAST(2000 + n % 5 AS STRING) AS y1, CAST(2000 + n % 3 AS STRING) AS y2 FROM (SELECT event_id, event_type, k, CAST(k AS INT) AS n FROM (SELECT event_id, event_type, @k AS k FROM events)))"
_TREE = f"""built AS ({_BUILT.replace("@k", "json_extract_string(props, '$.k')")}),
    tree AS (SELECT event_id, regexp_replace(substr(t.fullkey, 3), '\\.value\\b', '', 'g') AS path, t.type, t.atom, t.value, t.key FROM built, json_tree(doc) t)"""


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    """event_id, y0 to y2, doc: a nested record for each event, over all cores: a record is many times as large as its event."""
    events = spread(table(spark, d, "events").select("event_id", "event_type", "props")).select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    years = events.withColumns({f"y{j}": (2000 + C("k").cast("int") % n).cast("string") for j, n in ((0, 7), (1, 5), (2, 3))})
    return years.select("event_id", "y0", "y1", "y2", F.expr(_ENVELOPE).alias("doc"))


def _record():
    return F.try_parse_json("doc")


@query(
    "prj_06_plain_values",
    f"""WITH {_TREE} SELECT event_id, path, CASE WHEN type IN ('OBJECT', 'ARRAY') THEN CAST(value AS VARCHAR) WHEN type <> 'NULL' THEN json_extract_string(atom, '$') END AS value
    FROM tree WHERE (type NOT IN ('OBJECT', 'ARRAY') OR CAST(value AS VARCHAR) IN ('[]', '{{}}')) AND NOT regexp_matches(path, 'confidence$|evidence_ids')""",
)
def _(spark, d):
    """The values of all records by dotted path, at any depth."""
    return envelopes.flattened(_envelopes(spark, d), "event_id", _record())[0]


_MARKS = f"""{_TREE},
    sure AS (SELECT event_id, regexp_replace(path, '\\.confidence$', '') AS path, CAST(atom AS DOUBLE) AS confidence FROM tree WHERE key = 'confidence' AND type NOT IN ('VARCHAR', 'NULL')),
    seen AS (SELECT event_id, regexp_replace(path, '\\.evidence_ids\\[\\d+\\]$', '') AS path, list(json_extract_string(atom, '$') ORDER BY path) AS evidence FROM tree WHERE regexp_matches(path, 'evidence_ids\\[') AND type = 'VARCHAR' AND json_extract_string(atom, '$') <> '' GROUP BY 1, 2),
    marks AS (SELECT event_id, path, confidence, evidence FROM sure FULL JOIN seen USING (event_id, path))"""


@query("prj_06_marks", f"WITH {_MARKS} SELECT * FROM marks")
def _(spark, d):
    """Confidences and evidence of all records by dotted path."""
    return envelopes.flattened(_envelopes(spark, d), "event_id", _record())[1]


_NEWEST = "row_number() OVER (PARTITION BY event_id ORDER BY year DESC, old) - 1"


@query(
    "prj_07_moved_marks",
    f"""WITH {_MARKS}, items AS (SELECT event_id, unnest([0, 1, 2]) AS old, unnest([y0, y1, y2]) AS year FROM built),
    places AS (SELECT event_id, old, {_NEWEST} AS new FROM items)
    SELECT m.event_id, path, CASE WHEN p.new IS NULL THEN path ELSE 'done[' || p.new || ']' || substr(path, 8) END AS moved FROM marks m
    LEFT JOIN places p ON p.event_id = m.event_id AND starts_with(path, 'done[') AND TRY_CAST(path[6] AS INT) = p.old""",
)
def _(spark, d):
    """The marks of all records after `done` was put in the order of its years, the newest first."""
    docs = stored(_envelopes(spark, d), "records")
    items = docs.select("event_id", F.posexplode(F.array("y0", "y1", "y2")).alias("old", "year"))
    moves = envelopes.positions(items, "event_id", "done", "old", [F.desc("year")])
    return envelopes.moved(envelopes.flattened(docs, "event_id", _record())[1].select("event_id", "path"), "event_id", "path", moves).select("row.event_id", "row.path", C("to").alias("moved"))


# --- Markdown made of the documents' lines: three headings of sections in turn, headings of entries, periods, bullets --------
_PLACED = "CASE WHEN i % 20 = 0 THEN {head} WHEN i % 5 = 1 THEN concat('## ', {first}, CASE WHEN i % 10 = 1 THEN ' chez ' ELSE ' (2019) ' END, 'Maison ', i) WHEN i % 5 = 2 AND i % 3 = 0 THEN '2001 - 2005' ELSE concat('- ', line) END"
_HEADS = ("# Expérience", "## Skills", "# Formation")
SECTIONS = {"experience": ["expérience"], "skills": ["skill"], "education": ["formation"]}


@query(
    "ext_02_entries",
    f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
    placed AS (SELECT doc_id, i, trim(line) AS line, trim(regexp_replace(line, '[^A-Za-z]', '', 'g')[1:12]) AS first, (i // 20) % 3 AS s, i // 20 AS chunk FROM lines),
    heads AS (SELECT *, count(*) FILTER (i % 5 = 1) OVER (PARTITION BY doc_id, s ORDER BY i) - 1 AS part FROM placed WHERE s <> 1 AND i % 20 <> 0),
    told AS (SELECT doc_id, CASE s WHEN 0 THEN 'experience' ELSE 'education' END AS section, part, CASE WHEN i % 10 <> 1 THEN first || 'Maison ' || i WHEN first = '' THEN 'chez Maison ' || i ELSE first END AS title, CASE WHEN i % 10 = 1 AND first <> '' THEN 'Maison ' || i ELSE '' END AS subtitle, i, s FROM heads WHERE i % 5 = 1),
    periods AS (SELECT doc_id, s, part, max(CASE WHEN i % 5 = 2 AND i % 3 = 0 THEN 1 END) AS alone, count(*) FILTER (i % 5 <> 1 AND NOT (i % 5 = 2 AND i % 3 = 0) AND line <> '') AS bullets FROM heads WHERE part >= 0 GROUP BY 1, 2, 3)
    SELECT t.doc_id, section, CAST(part AS INT) AS part, title, subtitle, CASE WHEN i % 10 <> 1 THEN '2019' WHEN alone = 1 THEN '2001 - 2005' ELSE '' END AS period,
           CAST(bullets + CASE WHEN alone = 1 AND i % 10 <> 1 THEN 1 ELSE 0 END AS INT) AS bullets
    FROM told t JOIN periods p USING (doc_id, s, part)""",
)
def _(spark, d):
    """Entries of experience and education of all documents, whose lines are put as Markdown; a heading is stripped before it is cut, so that one without a letter before `chez` is all title."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    head = "element_at(array('" + "', '".join(_HEADS) + "'), cast(floor(i / 20) % 3 + 1 as int))"
    made = F.expr(f"transform(lines, (line, i) -> {_PLACED.format(head=head, first='''substring(regexp_replace(line, '[^A-Za-z]', ''), 1, 12)''')})")
    docs = table(spark, d, "documents").select("doc_id", lines.alias("lines")).select("doc_id", F.array_join(made, "\n").alias("text"))
    found = resumes.parts(docs, "doc_id", "text", SECTIONS).where("kind = 'entry' and section != 'intro'")
    return found.select("doc_id", "section", "part", "title", "subtitle", "period", F.size("items").alias("bullets"))


# Skills of parts: the two words of a name around a slash, spelt in eight ways; the dictionary knows words with a `t`, and pairs from `blue` and `red`
_WORDS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part"
_SLASHES = f"""WITH known AS ({_WORDS}), two AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey % 8 AS way, p_brand FROM part),
 spelt AS (SELECT *, CASE way WHEN 2 THEN upper(left(a, 3)) WHEN 3 THEN upper(a) ELSE a END AS x, CASE way WHEN 2 THEN upper(left(b, 3)) WHEN 3 THEN upper(b) ELSE b END AS y FROM two),
 ruled AS (SELECT *, way NOT IN (4, 5, 6, 7) AND (((a = 'blue' OR a = 'red') AND way <> 2) OR (NOT ((contains(a, 't') AND contains(b, 't')) AND way <> 2) AND length(x) <= 5 AND length(y) <= 5 AND way IN (2, 3))) AS whole FROM spelt),
 cells AS (SELECT p_partkey, unnest(CASE WHEN whole THEN [x || '/' || y] ELSE [x, y] END || [p_brand]) AS piece, generate_subscripts(CASE WHEN whole THEN [x || '/' || y] ELSE [x, y] END || [p_brand], 1) AS k FROM ruled),
 named AS (SELECT p_partkey, k, CASE WHEN lower(piece) IN (SELECT w FROM known WHERE contains(w, 't')) THEN upper(piece) WHEN regexp_matches(lower(piece), '^(blue|red)/') AND lower(split_part(piece, '/', 2)) IN (SELECT w FROM known) THEN upper(piece) ELSE piece END AS skill FROM cells),
 firsts AS (SELECT p_partkey, min(k) AS k, arg_min(skill, k) AS skill FROM named GROUP BY p_partkey, lower(skill))
SELECT p_partkey, string_agg(skill, '|' ORDER BY k) AS skills FROM firsts GROUP BY 1"""


@query("str_05_slash_lists", _SLASHES)
def _(spark, d):
    """The skills of all parts: slashes between their words part or join, by the dictionary and by acronyms; one name each."""
    parts = table(spark, d, "part").select("p_partkey", F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b"), "p_brand")
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    pairs = words.select(F.explode(F.transform(F.array(F.lit("blue"), F.lit("red")), lambda x: F.concat(x, F.lit("/"), F.col("w")))).alias("alias"))
    known = words.where("contains(w, 't')").select(C("w").alias("alias")).unionAll(pairs).select("alias", F.upper("alias").alias("name"))
    way = C("p_partkey") % 8
    short = lambda c: F.when(way == 2, F.upper(F.left(c, F.lit(3)))).when(way == 3, F.upper(c)).otherwise(C(c))
    between = F.when(way == 4, " / ").when(way == 5, ", ").when(way == 6, "/ ").when(way == 7, ";").otherwise("/")
    lists = parts.select("p_partkey", F.array(F.concat(short("a"), between, short("b")), "p_brand").alias("items"))
    return skills.flat_skills(lists, "items", known).select("p_partkey", F.array_join("skills", "|").alias("skills"))


@query(
    "agg_14_category_order",
    """WITH w AS (SELECT p_brand, p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part),
 c AS (SELECT p_brand, p_partkey, word, CASE left(word, 1) WHEN 'b' THEN 2 WHEN 'r' THEN 1 WHEN 's' THEN 1 ELSE 4 END AS rank FROM w),
 f AS (SELECT p_brand, rank, word, min(p_partkey) AS seen FROM c GROUP BY 1, 2, 3),
 g AS (SELECT p_brand, rank, string_agg(CASE rank WHEN 4 THEN word ELSE upper(word) END, ',' ORDER BY seen, word) AS items FROM f GROUP BY 1, 2)
 SELECT p_brand, string_agg(CASE rank WHEN 1 THEN 'tools' WHEN 2 THEN 'bases' ELSE 'other' END || ':' || items, ';' ORDER BY rank) AS groups FROM g GROUP BY 1""",
)
def _(spark, d):
    """The words of each brand's parts under categories in a fixed order, by their first part; unknown ones last."""
    words = table(spark, d, "part").select("p_brand", "p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    first = F.left("word", F.lit(1))
    known = words.select("word").distinct().select(C("word").alias("alias"), F.upper("word").alias("name"), F.when(first == "b", "bases").when(first.isin("r", "s"), "tools").when(first == "t", "unlisted").alias("category")).where("category IS NOT NULL")
    found = skills.by_category(words, "p_brand", "p_partkey", "word", known, ["tools", "bases", "clouds"], "other")
    return found.select("p_brand", F.array_join(F.transform("groups", lambda g: F.concat(g["category"], F.lit(":"), F.array_join(g["items"], ","))), ";").alias("groups"))


@query(
    "agg_10_rubrics",
    """WITH r AS (SELECT doc_id, regexp_matches(coalesce(string_split(text, chr(10))[2], ''), '[^\\s]')::INT AS name, coalesce(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 80)), 0) AS entries,
 (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT AS contact, coalesce(n_chars // 1000, 0) AS years FROM documents)
 SELECT doc_id, name, entries, contact, years, list_filter([CASE WHEN name = 0 THEN 'name' END, CASE WHEN entries = 0 THEN 'entries' END, CASE WHEN contact = 0 THEN 'contact' END, CASE WHEN years = 0 THEN 'years' END], lambda x: x IS NOT NULL) AS missing, name > 0 AND entries > 0 AS usable FROM r""",
)
def _(spark, d):
    """What each document holds as a record (second line, long lines, source, length), what is missing, and whether it can be used."""
    lines = F.split("text", "\n")
    docs = table(spark, d, "documents").select("doc_id", F.get(lines, F.lit(1)).alias("name"), F.filter(lines, lambda x: F.length(x) > 80).alias("entries"), F.struct("lang", "source").alias("contact"), F.expr("n_chars div 1000").alias("years"))
    rubrics = {c: c for c in ("name", "entries", "contact", "years")}
    counts, missing, usable = report.fill_report(docs, rubrics, ["name", "entries"])
    return docs.select("doc_id", *[counts[c].alias(c) for c in rubrics], missing.alias("missing"), usable.alias("usable"))


@query("arr_02_first_of_key", "WITH w AS (SELECT p_type, p_partkey, unnest(string_split(p_brand || ' ' || upper(p_name) || ' ' || p_name, ' ')) AS item, unnest(range(5)) AS nth FROM part), f AS (SELECT p_type, min(p_partkey * 8 + nth) AS seen, arg_min(item, p_partkey * 8 + nth) AS item FROM w GROUP BY p_type, lower(item)) SELECT p_type, list(item ORDER BY seen) AS items FROM f GROUP BY 1")
def _(spark, d):
    """The items of each type's parts, flattened in order; of those alike but for case the first stays."""
    items = F.split(F.concat_ws(" ", "p_brand", F.upper("p_name"), "p_name"), " ")
    flat = table(spark, d, "part").select("p_type", "p_partkey", F.posexplode(items).alias("nth", "item"))
    first = flat.groupBy("p_type", F.lower("item").alias("alike")).agg(F.min(F.struct("p_partkey", "nth", "item")).alias("one"))
    return first.groupBy("p_type").agg(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["item"]).alias("items"))
