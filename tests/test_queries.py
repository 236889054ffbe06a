"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from trackloom.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(pdf):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT") else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    names = sorted(pdf.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in pdf[names].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    names, got = rows(QUERIES[name](spark, DATA).toPandas())
    if name in SQL:
        said, want = rows(duck.execute(SQL[name]).df())
        assert names == said
        assert got == want
