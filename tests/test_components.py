"""Components against a plain union-find, and their rounds on chains."""

import random

import pytest
from pyspark.sql import functions as F

from paintgraph import scratch


def brute(edges):
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def graphs():
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(1000)]
    mixed = list(range(600))
    rng.shuffle(mixed)
    yield "sorted path", path
    yield "mixed path", list(zip(mixed, mixed[1:]))
    yield "star and loop", [(0, i) for i in range(1, 300)] + [(7, 7), (500, 501), (501, 502), (502, 500)]
    yield "random", [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)]


@pytest.mark.parametrize("name,edges", list(graphs()))
def test_components(spark, name, edges, monkeypatch):
    written = []
    made = scratch.Table.__init__
    monkeypatch.setattr(scratch.Table, "__init__", lambda self, df, name="t": (written.append(name), made(self, df, name))[1])
    got = {r.node: r.label for r in scratch.components(spark.createDataFrame(edges, "u long, v long")).df.collect()}
    want = {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert got == want
    assert len(written) <= 14, written  # about log2(1000) rounds, the first table and the last


def test_components_with_hubs(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10_000), 600)
    stars = [(ids[100 * k], i) for k in range(6) for i in ids[100 * k + 1 : 100 * k + 100]]  # hubs of any rank
    edges = stars + [(ids[99], ids[101]), (ids[100], ids[200]), (ids[399], ids[400])]
    got = {r.node: r.label for r in scratch.components(spark.createDataFrame(edges, "u long, v long"), share=40).df.collect()}
    assert got == brute(edges)


def test_tables_of_rounds_are_freed(spark):
    before = set(scratch._left)
    done = scratch.components(spark.createDataFrame([(0, i) for i in range(1, 60)] + [(i, 200) for i in range(40, 60)], "u long, v long"), share=8)
    assert set(scratch._left) - before == {done.path}
    done.free()


def test_hubs_stay_out_of_shuffles(spark):
    # a star whose centre is neither the smallest nor the largest node, beside as many other edges
    n, share = 200_000, 2_000
    star = spark.range(n).selectExpr("id + if(id < 100000, 0, 1) as u", "100000L as v")
    path = spark.range(2 * n, 3 * n).selectExpr("id as u", "id + 1 as v").where("u % 10 > 0")
    edges = star.union(path).selectExpr("greatest(u, v) as u", "least(u, v) as v")
    both = edges.union(edges.selectExpr("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = scratch.met(both, least, [], share)
    rest = joined.join(F.broadcast(least.where(F.col("n") > share).select("u")), "u", "left_anti").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("rows"))
    rows = sorted(r.rows for r in rest.collect())
    assert joined.count() == both.count()
    assert rows[-1] <= 4 * rows[len(rows) // 2]
    sizes = scratch.components(edges, share=share).df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("times")).collect()
    assert {r.n: r.times for r in sizes} == {n + 1: 1, 10: n // 10}
    plan = joined._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_components_apart(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (1, 5, 4)], "image_id long, u long, v long")
    got = sorted(map(tuple, scratch.components(edges, ["image_id"]).df.collect()))
    assert got == [(1, 1, 1), (1, 2, 1), (1, 4, 4), (1, 5, 4), (2, 2, 2), (2, 3, 2)]
    assert scratch.components(edges.limit(0)).df.count() == 0


def test_no_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        scratch.folder(Session())
