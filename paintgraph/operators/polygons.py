"""Measures of general rings (arrays of corners x, y that aren't closed) as Column functions, and their simplification."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import scalars as S


def sides(ring: str) -> Column:
    """The ring's segments ax, ay, bx, by, the closing one last."""
    r = F.col(ring)
    d = lambda p, k: p[k].cast("double")
    step = lambda a, b: F.struct(d(a, "x").alias("ax"), d(a, "y").alias("ay"), d(b, "x").alias("bx"), d(b, "y").alias("by"))
    return F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), step)


def to_side(x: Column, y: Column, s: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    span = dx * dx + dy * dy
    along = F.when(span == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["ax"]) * dx + (y - s["ay"]) * dy) / span)))
    return F.hypot(x - s["ax"] - along * dx, y - s["ay"] - along * dy)


@F.arrow_udf(DoubleType())
def _gaps(ax: pa.Array, ay: pa.Array, bx: pa.Array, by: pa.Array) -> pa.Array:
    import numpy as np
    import pyarrow.compute as pc

    from .rings import gaps_of_many

    sizes = lambda c: np.asarray(pc.fill_null(pc.list_value_length(c), 0), np.int64)
    corners = lambda x, y: np.stack([np.asarray(k.flatten(), float) for k in (x, y)], 1)
    gaps = gaps_of_many(corners(ax, ay), sizes(ax), corners(bx, by), sizes(bx))
    return pa.array(gaps, mask=np.isnan(gaps))


def places(ring: str) -> list[Column]:
    """A ring's corners as two arrays of numbers, x and y."""
    of = lambda k: F.transform(F.col(ring), lambda p: p[k].cast("double"))
    return [of("x"), of("y")]


def gap(first: list, second: list) -> Column:
    """`boundary_distance` of rings whose `places` are columns, so that they aren't made anew for each pair."""
    return _gaps(*first, *second)


def boundary_distance(first: str, second: str) -> Column:
    """Distance of two boundaries: a ring deep inside another is as far from it as from its sides. Null for an empty ring.
    Pairs of a batch are measured together, in blocks."""
    return gap(places(first), places(second))


def inside(ring: str, x: Column, y: Column) -> Column:
    """Whether a ray from the point meets the ring an odd number of times."""

    def meets(s: Column) -> Column:
        apart = (s["ay"] > y) != (s["by"] > y)
        return apart & (x < (s["bx"] - s["ax"]) * (y - s["ay"]) / F.nullif(s["by"] - s["ay"], F.lit(0.0)) + s["ax"])

    return F.size(F.filter(sides(ring), lambda s: F.coalesce(meets(s), F.lit(False)))) % 2 == 1


def clearance(ring: str, x: Column, y: Column) -> Column:
    """Distance of an inner point to the boundary; 0 outside."""
    return F.when(inside(ring, x, y), F.array_min(F.transform(sides(ring), lambda s: to_side(x, y, s)))).otherwise(0.0)


def ring_distance(first: str, second: str) -> Column:
    """Distance of two filled rings: 0 where they overlap or one lies in the other."""
    corner = lambda r, k: F.get(F.col(r), F.lit(0))[k].cast("double")
    within = inside(first, corner(second, "x"), corner(second, "y")) | inside(second, corner(first, "x"), corner(first, "y"))
    return F.when(within, 0.0).otherwise(boundary_distance(first, second))


def perimeter(ring: str) -> Column:
    return F.aggregate(sides(ring), F.lit(0.0), lambda n, s: n + F.hypot(s["bx"] - s["ax"], s["by"] - s["ay"]))


def compactness(ring: str) -> Column:
    """1 for a circle, less for other shapes; 0 without a perimeter."""
    p = perimeter(ring)
    return F.when(p > 0, F.least(F.lit(1.0), 4 * math.pi * F.abs(S.shoelace(ring)) / 2 / (p * p))).otherwise(0.0)


def simplified(zones: DataFrame, ratio: float, ring: str = "polygon") -> DataFrame:
    """Zones whose ring keeps the corners that matter: those farther than max(1, ratio * perimeter) from the chord of
    the kept ones around them. Rings of three corners or fewer stay."""
    @F.pandas_udf("array<int>")
    def kept(xs: pd.Series, ys: pd.Series, epsilon: pd.Series) -> pd.Series:
        import numpy as np

        def corners(x, y, e: float) -> list[int]:
            n = len(x)
            if n <= 3:
                return list(range(n))
            px, py = np.append(x, x[0]), np.append(y, y[0])
            far = int(np.argmax(np.hypot(x - x[0], y - y[0])))
            keep, stack = {0, far}, [(0, far), (far, n)]
            while stack:
                a, b = stack.pop()
                if b - a < 2:
                    continue
                qx, qy, dx, dy = px[a + 1 : b] - px[a], py[a + 1 : b] - py[a], px[b] - px[a], py[b] - py[a]
                chord = np.hypot(dx, dy)
                off = np.abs(dx * qy - dy * qx) / chord if chord else np.hypot(qx, qy)
                i = int(np.argmax(off))
                if off[i] > e:
                    m = a + 1 + i
                    keep.add(m)
                    stack += [(a, m), (m, b)]
            return sorted(keep)

        return pd.Series([corners(np.asarray(x, float), np.asarray(y, float), e) for x, y, e in zip(xs, ys, epsilon, strict=True)])

    of = lambda k: F.transform(F.coalesce(ring, F.array().cast(zones.schema[ring].dataType)), lambda p: p[k].cast("double"))
    epsilon = F.greatest(F.lit(1.0), F.coalesce(perimeter(ring), F.lit(0.0)) * ratio)
    spare = next(n for n in (f"kept{i}" for i in range(len(zones.columns) + 1)) if n not in zones.columns)
    z = zones.withColumn(spare, kept(of("x"), of("y"), epsilon))
    return z.withColumn(ring, F.transform(spare, lambda i: F.element_at(ring, i + 1))).drop(spare)


def extended_line(line: str, reach: Column) -> Column:
    """A line whose two ends go on by `reach`, each along its own last segment; an end of no length stays."""
    p = F.col(line)

    def end(tip: Column, back: Column) -> Column:
        dx, dy = tip["x"] - back["x"], tip["y"] - back["y"]
        span = F.hypot(dx, dy)
        grow = F.when(span > 0, reach / span).otherwise(0.0)
        return F.struct((tip["x"] + dx * grow).alias("x"), (tip["y"] + dy * grow).alias("y"))

    n = F.size(p)
    middle = F.slice(p, 2, F.greatest(n - 2, F.lit(0)))
    return F.when(n < 2, p).otherwise(F.concat(F.array(end(F.get(p, F.lit(0)), F.get(p, F.lit(1)))), middle, F.array(end(F.get(p, n - 1), F.get(p, n - 2)))))
