import os

import duckdb
import pytest

from tidemark.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(FOLDER):
        duck.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    df = queries()[name](spark, FOLDER)
    found = duck.sql(oracle_sql()[name])
    assert sorted(found.columns) == sorted(df.columns)
    want = sorted(found.select(*(f'"{c}"' for c in df.columns)).fetchall())
    assert want and sorted(map(tuple, df.collect())) == want
