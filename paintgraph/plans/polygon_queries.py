"""Queries over rings: distances, clearance, compactness, simplification, lines; and Lab colours of zones. On boxes,
general measures have short closed forms, which are the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, polygons, raster, render
from ..sources.views import PIXELS, ZONES, pixels, zones
from .zone_queries import _BOX, _GX, _GY, _INSET

QUERIES: dict = {}
SQL: dict = {}
_Z = f"z AS {ZONES}"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"WITH {_Z} SELECT a.image_id, a.zone_id AS src, b.zone_id AS dst, round(sqrt({_GX}*{_GX}+{_GY}*{_GY})+{_INSET}, 6) AS distance FROM z a JOIN z b ON a.image_id=b.image_id AND a.zone_id<b.zone_id AND {_BOX}")
def boundary_distance(spark, d):
    near, gap = graph.ring_pairs(render.rings(zones(spark, d)))
    return near.select("a.image_id", F.col("a.zone_id").alias("src"), F.col("b.zone_id").alias("dst"), F.round(gap, 6).alias("distance"))


_PX, _PY = "(x0+w*((zone_id%5)-0.5::DOUBLE)/3.0::DOUBLE)", "(y0+h*0.3::DOUBLE)"


@query(f"WITH {_Z} SELECT image_id, zone_id, round(greatest(0.0, least({_PX}-x0, x0+w-{_PX}, {_PY}-y0, y0+h-{_PY})), 6) AS clearance FROM z")
def point_clearance(spark, d):
    x, y = F.col("x0") + F.col("w") * (F.col("zone_id") % 5 - 0.5) / 3.0, F.col("y0") + F.col("h") * 0.3
    return render.rings(zones(spark, d)).select("image_id", "zone_id", F.round(polygons.clearance("polygon", x, y), 6).alias("clearance"))


@query(f"WITH {_Z} SELECT image_id, zone_id, round(2.0*(w+h), 6) AS perimeter, round(least(1.0, pi()*w*h/((w+h)*(w+h))), 6) AS compactness FROM z")
def ring_compactness(spark, d):
    return render.rings(zones(spark, d)).select("image_id", "zone_id", F.round(polygons.perimeter("polygon"), 6).alias("perimeter"), F.round(polygons.compactness("polygon"), 6).alias("compactness"))


@query(f"WITH {_Z} SELECT image_id, zone_id, 'M '||x0||' '||y0||' L '||(x0+w)||' '||y0||' L '||(x0+w)||' '||(y0+h)||' L '||x0||' '||(y0+h)||' Z' AS path FROM z")
def simplified_path(spark, d):
    """Rings with a spare corner on each side lose it."""
    spare = lambda a, b: F.struct(F.floor((a["x"] + b["x"]) / 2).alias("x"), F.floor((a["y"] + b["y"]) / 2).alias("y"))
    r = F.col("polygon")
    crowded = F.flatten(F.zip_with(r, F.concat(F.slice(r, 2, 4), F.slice(r, 1, 1)), lambda a, b: F.array(a, spare(a, b))))
    z = render.rings(zones(spark, d)).withColumn("polygon", crowded)
    return polygons.simplified(z, 0.003).select("image_id", "zone_id", S.svg_path("polygon").alias("path"))


@query(f"WITH {_Z} SELECT image_id, zone_id, round(x0-3.0*greatest(w,h), 6) AS ax, round(y0+h/2.0, 6) AS ay, round(x0+w+3.0*greatest(w,h), 6) AS bx, round(y0+h/2.0, 6) AS by FROM z")
def extended_cut(spark, d):
    p = lambda x: F.struct(x.cast("double").alias("x"), (F.col("y0") + F.col("h") / 2).alias("y"))
    z = zones(spark, d).withColumn("line", F.array(p(F.col("x0")), p(F.col("x0") + F.col("w"))))
    e = z.withColumn("line", polygons.extended_line("line", 3.0 * F.greatest("w", "h")))
    return e.select("image_id", "zone_id", *[F.round(F.col("line")[i][k], 6).alias(n) for n, i, k in (("ax", 0, "x"), ("ay", 0, "y"), ("bx", 1, "x"), ("by", 1, "y"))])


_LIN = "CASE WHEN {c}/255.0::DOUBLE>0.04045::DOUBLE THEN power(({c}/255.0::DOUBLE+0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) ELSE {c}/255.0::DOUBLE/12.92::DOUBLE END"
_F = "CASE WHEN {t}>0.008856::DOUBLE THEN power({t}, 1/3.0::DOUBLE) ELSE 7.787::DOUBLE*{t}+16/116.0::DOUBLE END"


@query(
    f"WITH {_Z}, p AS {PIXELS}, m AS (SELECT z.image_id, z.zone_id, floor(avg(b)) AS b, floor(avg(g)) AS g, floor(avg(r)) AS r FROM p JOIN z ON z.image_id=p.image_id AND x>=x0 AND x<x0+w AND y>=y0 AND y<y0+h GROUP BY 1, 2), "
    f"n AS (SELECT image_id, zone_id, {_LIN.format(c='b')} AS b, {_LIN.format(c='g')} AS g, {_LIN.format(c='r')} AS r FROM m), "
    "t AS (SELECT image_id, zone_id, (0.412453::DOUBLE*r+0.357580::DOUBLE*g+0.180423::DOUBLE*b)/0.950456::DOUBLE AS x, 0.212671::DOUBLE*r+0.715160::DOUBLE*g+0.072169::DOUBLE*b AS y, (0.019334::DOUBLE*r+0.119193::DOUBLE*g+0.950227::DOUBLE*b)/1.088754::DOUBLE AS z FROM n), "
    f"f AS (SELECT image_id, zone_id, {_F.format(t='x')} AS x, {_F.format(t='y')} AS y, {_F.format(t='z')} AS z FROM t) "
    "SELECT image_id, zone_id, round(116*y-16, 4) AS l, round(500*(x-y), 4) AS a, round(200*(y-z), 4) AS b, CAST(greatest(0, least(round_even(round((116*y-16)*255/100, 6), 0), 255)) AS BIGINT) AS l8, CAST(greatest(0, least(round_even(round(500*(x-y)+128, 6), 0), 255)) AS BIGINT) AS a8, CAST(greatest(0, least(round_even(round(200*(y-z)+128, 6), 0), 255)) AS BIGINT) AS b8 FROM f"
)
def zone_lab(spark, d):
    m = raster.mean_colours(pixels(spark, d), raster.box_runs(zones(spark, d)))
    return m.select("image_id", "zone_id", *[F.round(c, 4).alias(n) for n, c in zip("lab", S.lab("b", "g", "r"), strict=True)], *[c.alias(n) for n, c in zip(("l8", "a8", "b8"), S.lab8("b", "g", "r"), strict=True)])
