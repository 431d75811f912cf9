"""Every query against its SQL on the smallest driver tables, where they are at hand."""

import difflib
import glob
import os
import random

import duckdb
import pandas as pd
import pytest

from playlog.plans import artefacts, catalogue, leading, oracle

DATA = "/root/testdata/sf0.001"
QUERIES = catalogue.queries() | leading.queries()


def canonical(df):
    columns = sorted(df.columns)
    out = []
    for r in df[columns].itertuples(index=False):
        out.append(tuple(None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r))
    return columns, sorted(map(repr, out))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = canonical(QUERIES[name](spark, DATA).toPandas())
    assert got == canonical(duck.sql(oracle.ORACLES[name]).df())


def test_all_have_sql():
    assert set(QUERIES) == set(oracle.ORACLES)
    assert set(leading.NAMED) == set(artefacts.ORDER)


def test_similarity_in_sql():
    """The SQL's similarity against the standard library's, ties and empty texts included."""
    draw = random.Random(5)
    texts = ["".join(draw.choices("aab c1", k=draw.randrange(1, 25))) for _ in range(600)]
    pairs = [*zip(texts[::2], texts[1::2], strict=True), ("same", "same"), ("abcd", "wxyz"), ("ab ab", "ba ba ab")]
    frame = pd.DataFrame(pairs, columns=["a", "b"]).reset_index(names="id")
    con = duckdb.connect()
    con.register("pairs", frame)
    got = dict(con.sql(f"WITH RECURSIVE{oracle.similarity('pairs')} SELECT id, ratio FROM alike").fetchall())
    assert got == {i: difflib.SequenceMatcher(None, a, b).ratio() for i, (a, b) in enumerate(pairs)}
