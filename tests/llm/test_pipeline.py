"""The pipeline, stage by stage, against plain versions that share nothing with it."""

from collections import Counter

import base64

import brute
import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from talweg.llm import queries, secrets
from talweg.llm.common import table


def expected(docs, labels, items):
    """The rows (doc_id, ids) that the pipeline should give for docs (doc_id, text), labels (doc_id, quality), items (item_id, text)."""
    by = {}
    for i, t in docs:
        by.setdefault(i, []).append(t or "")
    known = [(t, y) for i, y in labels if y in (0, 1) and i is not None and brute.crc_mod(i, 5) != 0 for t in by.get(i, [])]
    few = {y: sum(k == y for _, k in known) for y in (0, 1)}
    scores = brute.discriminant(known, [t or "" for _, t in docs]) if min(few.values()) > 1 else [few[1] / len(known) if known else 0.5] * len(docs)
    kept = [r for r, s in zip(docs, scores, strict=True) if s >= 0.3]
    sets, members = brute.classes([t for _, t in kept], 5)
    first = {}
    for k, (i, t) in enumerate(kept):
        group = members[k][0] if sets[k] else (i, t)
        if group not in first or (first[group][0] is None, first[group][0] or 0) > (i is None, i or 0):
            first[group] = (i, t)
    out = []
    v = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v, special_tokens={})
    for i, t in first.values():
        n, hit, _ = brute.contamination(t, items)
        if hit and 20 * hit >= n:
            continue
        text = t or ""
        spans = brute.base_secrets(text) + brute.novel_secrets(text, secrets.CONTEXT, secrets.IDENTIFIERS)
        out.append((i, tuple(enc.encode_ordinary(brute.redacted(text, spans)))))
    return Counter(out)


def outcome(spark, d):
    return Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in corpus_pipeline.run(spark, d).collect())


def test_pipeline(spark, sf_dir):
    rows = lambda name, *columns: [tuple(r) for r in table(spark, sf_dir, name).select(*columns).collect()]
    want = expected(rows("documents", "doc_id", "text"), rows("labels", "doc_id", "quality"), rows("benchmark", "item_id", "text"))
    assert outcome(spark, sf_dir) == want and len(want) > 50


TEXT = "Some ordinary sentence of words, which is long enough to be a document of its own, and says nothing. "
EDGES = [
    (1, TEXT), (2, TEXT), (2, TEXT + "But this one goes on, and is another text by far, with a lot more to say than that one has, as all can see."), (None, TEXT), (None, None), (None, ""), (3, None), (4, ""), (4, ""), (5, "x " * 60_000), (6, 'token = "' + "9f" * 20 + '" é漢🙂'),
    (7, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (None, TEXT.upper() + "x"), (1, TEXT),
]


@pytest.mark.parametrize("docs", [EDGES, []])
def test_pipeline_edges(spark, tmp_path, docs):
    labels, items = [(1, 1, 0), (None, 1, 1), (2, None, None), (9, 0, 0)], [(None, "two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (1, None)]
    spark.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id long, text string, row string, node int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert outcome(spark, str(tmp_path)) == expected(docs, [x[:2] for x in labels], items)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).columns == (["doc_id", "n_tokens", "ids", "decoded_sha256"] if name == "tokens" else docs.columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    """The queries that SQL can express, against DuckDB."""
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLES[name]).fetch_df()
    rows = lambda df: Counter(tuple(None if x is None or x != x else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
