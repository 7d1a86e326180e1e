"""Each catalogue query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from millrace.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def tidy(rows, columns):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in catalogue.SQL:
        assert rows
        return
    got = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert tidy(rows, df.columns) == tidy(got.fetchall(), columns)
