"""Envelopes and moved paths against plain recursion."""

import json

from pyspark.sql import functions as F

from talweg.operators import envelopes

MARKERS = ("confidence", "evidence_ids", "model_confidence", "model_logprob")


def walk(x, path, values, marks):
    if isinstance(x, dict) and x and "value" in x and any(m in x for m in MARKERS):
        own = marks.setdefault(path, [None, None])
        if isinstance(x.get("confidence"), int | float) and not isinstance(x["confidence"], bool):
            own[0] = float(x["confidence"])
        if isinstance(x.get("evidence_ids"), list) and (e := [v for v in x["evidence_ids"] if isinstance(v, str) and v]):
            own[1] = e
        walk(x["value"], path, values, marks)
    elif isinstance(x, dict) and x:
        for k, v in x.items():
            walk(v, f"{path}.{k}" if path else k, values, marks)
    elif isinstance(x, list) and x:
        for k, v in enumerate(x):
            walk(v, f"{path}[{k}]", values, marks)
    else:
        values.append((path, None if x is None else x if isinstance(x, str) else json.dumps(x)))


RECORDS = [
    {"a": {"value": {"value": "in", "confidence": 0.2}, "confidence": 0.9, "evidence_ids": ["x", "", 1]}, "b": [], "c": {}, "d": None, "value": 3},
    {"value": [1, [2, {"z": {"value": None, "model_logprob": -1}}], True], "confidence": 1},
    {"list": [{"t": {"value": "v", "confidence": True, "evidence_ids": "no"}}, {"t": {"value": False, "confidence": "0.5", "evidence_ids": ["p", "q"]}}], "deep": {"e": {"e": {"e": {"e": [[["w"]]]}}}}},
    [], {}, None, "text", 5,
]


def test_flattened(spark):
    rows = [(k, json.dumps(r)) for k, r in enumerate(RECORDS)] + [(90, None), (91, "{no json")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "id int, doc string, depth int, path string")
    values, marks = envelopes.flattened(df, "id", F.try_parse_json("doc"))
    want_values, want_marks = [], {}
    for k, r in enumerate(RECORDS):
        v, m = [], {}
        walk(r, "", v, m)
        want_values += [(k, *x) for x in v]
        want_marks |= {(k, p): tuple(x) for p, x in m.items() if p and any(y is not None for y in x)}
    key = lambda x: (x[0], x[1], str(x[2]))
    assert sorted(map(tuple, values.collect()), key=key) == sorted(want_values, key=key)
    assert {(r.id, r.path): (r.confidence, r.evidence) for r in marks.collect()} == want_marks
    assert envelopes.flattened(df.where("false"), "id", F.try_parse_json("doc"))[0].count() == 0


def test_moved_paths(spark):
    items = spark.createDataFrame([(1, 0, "2001"), (1, 1, "2020"), (1, 2, None), (2, 0, "x")], "id int, old int, y string")
    moves = envelopes.positions(items, "id", "job", "old", [F.desc_nulls_last("y")])
    assert sorted((r.id, r.old, r.new) for r in moves.collect()) == [(1, 0, 1), (1, 1, 0), (1, 2, 2), (2, 0, 0)]
    more = spark.createDataFrame([(1, "job[0].items", 0, 5)], "id int, list string, old int, new int")
    paths = [(1, "job[0].t"), (1, "job[1].items[3].x"), (1, "job[0].items[0]"), (1, "job[0].items[1].x"), (1, "job[7].t"), (1, "other[4]"), (1, "name"), (3, "job[7].t"), (1, "job[0].t"), (None, "a[0][2].b")]
    df = spark.createDataFrame([(*p, n) for n, p in enumerate(paths)], "id int, path string, n int")
    got = sorted((r.row.n, r.to) for r in envelopes.moved(df, "id", "path", moves.unionByName(more)).collect())
    assert got == [(0, "job[1].t"), (1, "job[0].items[3].x"), (2, "job[1].items[5]"), (5, "other[4]"), (6, "name"), (7, "job[7].t"), (8, "job[1].t"), (9, "a[0][2].b")]


def test_records_of_one_file_are_spread(spark, sf_dir):
    """One file of events is read by one task; what is made of it is made by all cores."""
    from talweg.plans import texts

    assert texts._envelopes(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
