"""Text queries with SQL give the SQL's rows on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        path = f"{DATA}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def rows(pdf):
    plain = lambda v: None if pd.isna(v) else bool(v) if isinstance(v, (bool, np.bool_)) else round(float(v), 6) if isinstance(v, float) else int(v) if hasattr(v, "item") else v
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in pdf[cols].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("n", [1, 3, 5, 8, 9, 10, 12, 13])
def test_same_rows_as_sql(spark, duck, n):
    from paintgraph.llm import queries

    name = next(q for q in queries.oracle_sql() if q.startswith(f"op{n}_"))
    assert rows(queries.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(queries.oracle_sql()[name]).df())
