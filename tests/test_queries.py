"""Every query of the library that has an oracle against DuckDB, the others for rows alone."""

import math

import duckdb
import pandas as pd
import pytest

from talweg.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return plain(float(v)) if isinstance(v, (int,)) and not isinstance(v, bool) and abs(v) < 2**53 else v


def rows(df):
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalogue.ORACLES:
        return
    want = duck.execute(catalogue.ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_without_extra_operators():
    """Nothing but the entry point knows the training-data operators."""
    import pathlib

    root = pathlib.Path(catalogue.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "talweg.llm" not in path.read_text()
