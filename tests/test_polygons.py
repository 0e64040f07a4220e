"""Measures of rings that aren't boxes, against values found by hand."""

import math

from pyspark.sql import functions as F

from paintgraph.functions import scalars as S
from paintgraph.operators import polygons

RING = "array<struct<x:double,y:double>>"


def one(spark, schema, *row):
    return spark.createDataFrame([row], schema)


def test_boundary_distance(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    cases = [
        ([(13.0, 14.0), (20.0, 14.0), (20.0, 20.0)], 5.0),  # corner to corner
        ([(4.0, 4.0), (6.0, 4.0), (5.0, 6.0)], 4.0),  # deep inside
        ([(5.0, -5.0), (6.0, 5.0), (4.0, 5.0)], 0.0),  # crossing
        ([(10.0, 2.0), (14.0, 2.0), (14.0, 6.0)], 0.0),  # touching
    ]
    df = spark.createDataFrame([(i, square, r, want) for i, (r, want) in enumerate(cases)], f"i int, p {RING}, q {RING}, want double")
    for r in df.select("want", polygons.boundary_distance("p", "q").alias("got")).collect():
        assert math.isclose(r.got, r.want, abs_tol=1e-9)


def test_clearance_in_a_bent_ring(spark):
    bent = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (6.0, 10.0), (6.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(bent, 8.0, 7.0, 2.0), (bent, 2.0, 7.0, 0.0), (bent, 2.0, 2.0, 2.0)], f"p {RING}, x double, y double, want double")
    for r in df.select("want", polygons.clearance("p", F.col("x"), F.col("y")).alias("got")).collect():
        assert math.isclose(r.got, r.want, abs_tol=1e-9)


def test_compactness_bounds(spark):
    circle = [(100 * math.cos(i / 50 * math.pi), 100 * math.sin(i / 50 * math.pi)) for i in range(100)]
    r = one(spark, f"p {RING}, e {RING}", circle, []).select(polygons.compactness("p").alias("c"), polygons.compactness("e").alias("e")).first()
    assert 0.99 < r.c <= 1 and r.e == 0


def test_simplified_rings(spark):
    bumpy = [(0.0, 0.0), (50.0, 0.5), (100.0, 0.0), (100.0, 50.0), (100.0, 100.0), (50.0, 80.0), (0.0, 100.0)]
    z = spark.createDataFrame([(1, bumpy), (2, bumpy[:3]), (3, []), (4, None)], f"zone_id int, polygon {RING}")
    got = {r.zone_id: r.polygon for r in polygons.simplified(z, 0.003).collect()}
    assert [tuple(p) for p in got[1]] == [bumpy[i] for i in (0, 2, 4, 5, 6)]
    assert len(got[2]) == 3 and got[3] == [] and not got[4]


def test_lab_of_known_colours(spark):
    df = spark.createDataFrame([(255, 255, 255, 100.0, 0.0, 0.0), (0, 0, 0, 0.0, 0.0, 0.0), (0, 0, 255, 53.24, 80.09, 67.2)], "b int, g int, r int, l double, a double, bb double")
    for r in df.select("l", "a", "bb", *[c.alias(n) for n, c in zip(("gl", "ga", "gb"), S.lab("b", "g", "r"), strict=True)]).collect():
        assert max(abs(r.l - r.gl), abs(r.a - r.ga), abs(r.bb - r.gb)) < 0.1


def test_extended_line(spark):
    r = one(spark, f"line {RING}", [(0.0, 0.0), (3.0, 4.0), (3.0, 10.0)]).select(polygons.extended_line("line", F.lit(10.0)).alias("line")).first()
    assert [tuple(p) for p in r.line] == [(-6.0, -8.0), (3.0, 4.0), (3.0, 20.0)]
