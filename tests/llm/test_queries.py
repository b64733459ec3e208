import os
import re

import duckdb
import pytest

from tesserae.llm import queries


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in os.listdir(sf_dir):
        if table.endswith(".parquet"):
            con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{table}'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLES[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    pick = [names.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r[i] for i in pick)) for r in want.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
