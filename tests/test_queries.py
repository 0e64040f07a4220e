"""Every query with SQL gives the SQL's rows on the smallest tables; the others keep their invariants."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from paintgraph import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def rows(pdf):
    cols = sorted(pdf.columns)
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, float) else int(v) if hasattr(v, "item") and not isinstance(v, (bool, np.bool_)) else bool(v) if isinstance(v, np.bool_) else v
    return cols, sorted((tuple(plain(v) for v in r) for r in pdf[cols].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    assert rows(catalogue.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(catalogue.oracle_sql()[name]).df())


def test_numbers_repair_never_adds_collisions(spark):
    from paintgraph.operators import graph
    from paintgraph.sources.views import zones

    z = zones(spark, "/root/testdata/sf0.01")
    e = graph.adjacency(z).cache()
    found = []
    for passes in (0, 4):
        n = graph.assign_numbers(z, e, 4, passes).cache()
        assert n.count() == z.count() and n.where("num < 1 OR num > 4").count() == 0
        found.append(graph.collisions(n, e).groupBy().sum("collisions").first()[0])
    assert found[1] <= found[0]


def test_duplicate_suppression_keeps_the_largest(spark):
    from paintgraph.operators import raster

    z = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 100), (1, 2, 0, 0, 10, 9, 90), (1, 3, 50, 50, 9, 9, 81)], "image_id long, zone_id long, x0 long, y0 long, w long, h long, area_px long")
    left = raster.suppress_duplicates(z, raster.duplicates(z)).collect()
    assert sorted(r.zone_id for r in left) == [1, 3]


def test_components_of_runs(spark):
    from paintgraph.operators import raster

    picture = ["##..#", "..#.#", "#...#"]
    p = spark.createDataFrame([(1, x, y) for y, line in enumerate(picture) for x, c in enumerate(line) if c == "#"], "image_id long, x long, y long")
    stats = raster.component_stats(raster.run_components(raster.runs(p))).collect()
    assert sorted(r.area for r in stats) == [1, 3, 3]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
