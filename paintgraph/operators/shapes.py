"""Zones from pixels and rings: contours, filled runs, interior points, poles, union, cuts, subdivision, fragments.

Columns and joins carry the relations; a kernel of `rings` sees one ring, one component or one parent's pieces at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from ..functions import scalars as S
from . import contours as borders
from . import patches, polygons, raster
from .contours import contours

POINT, FILL_ROWS = "struct<x:double,y:double>", 1 << 20
_RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
_PLACE = T.StructType([T.StructField(k, T.DoubleType()) for k in ("x", "y", "d")])
#: Gates of masks (pixels, share of the page), the smallest ratio and share of simplification of line art.
MASK_MIN, MASK_MIN_RATIO, MASK_MAX_RATIO, MASK_EPSILON = 350, 0.001, 0.92, 0.003
CONTOUR_FLOOR, CONTOUR_SHARE = 0.0008, 0.35
SUBZONES = ["lineart_slic_subzone", "lineart_curved_subzone"]
UNMERGED = "lineart_slic_unmerged_small_fragment"
#: Least area of a subzone and its share of the zone's minimum; simplification of superpixels (floor, share); snapping of fragments.
SUBZONE_LEAST, SUBZONE_SHARE, PATCH_FLOOR, PATCH_SHARE, SNAP = 8, 0.15, 0.0014, 0.8, 2.0


def _pairs(ring) -> list[tuple[float, float]]:
    return [(float(p["x"]), float(p["y"])) for p in ring] if ring is not None else []


def _points(ring) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def _doubles(ring: str) -> Column:
    return F.transform(F.coalesce(F.col(ring), F.array()), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))


# --- interior points and poles


def interior_point(ring: str) -> Column:
    """A point inside: the middle of the widest inner stretch of the scan line halfway between the corners' heights around the middle."""
    r, s = F.col(ring), polygons.sides(ring)
    heights = F.array_sort(F.array_distinct(F.transform(r, lambda p: p["y"].cast("double"))))

    def at(h: Column) -> Column:
        middle = (F.element_at(h, 1) + F.element_at(h, -1)) / 2
        low = F.array_max(F.filter(h, lambda y: (y < middle) | (y == F.element_at(h, 1))))
        return (low + F.array_min(F.filter(h, lambda y: y > low))) / 2

    def widest(y: Column) -> Column:
        cross = F.array_sort(F.transform(F.filter(s, lambda t: (t["ay"] > y) != (t["by"] > y)), lambda t: (t["bx"] - t["ax"]) * (y - t["ay"]) / (t["by"] - t["ay"]) + t["ax"]))
        spans = F.transform(F.sequence(F.lit(0), F.floor(F.size(cross) / 2).cast("int") - 1), lambda i: F.struct((F.get(cross, 2 * i + 1) - F.get(cross, 2 * i)).alias("size"), (-i).alias("first"), ((F.get(cross, 2 * i + 1) + F.get(cross, 2 * i)) / 2).alias("x"), y.alias("y")))
        return F.array_max(spans)

    one = F.get(F.transform(F.array(heights), lambda h: F.when(F.size(h) > 1, widest(at(h)))), F.lit(0))
    first = F.get(r, F.lit(0))
    return F.struct(F.coalesce(one["x"], first["x"].cast("double")).alias("x"), F.coalesce(one["y"], first["y"].cast("double")).alias("y"))


def fits(ring: str, x: Column, y: Column, radius: Column) -> Column:
    """Whether a circle about the point lies inside the ring."""
    return polygons.clearance(ring, x, y) >= radius


def _flat(xs: pd.Series, ys: pd.Series):
    """Corners (n, 2) of all rings one after another, and how many each has."""
    import numpy as np

    sizes = np.array([len(x) for x in xs], np.int64)
    return np.stack([np.concatenate([*k, np.zeros(0)]).astype(float) for k in (xs, ys)], 1), sizes


def _xy(ring: str) -> list[Column]:
    """Places of a ring's corners along both axes, which batches hold without an object for each corner."""
    of = lambda k: F.transform(F.coalesce(F.col(ring), F.array()), lambda p: p[k].cast("double"))
    return [of("x"), of("y")]


@F.pandas_udf(_PLACE)
def _pole(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    from .rings import poles

    return pd.DataFrame(poles(*_flat(xs, ys)), columns=["x", "y", "d"])


def pole(ring: str) -> Column:
    """The pole of inaccessibility: x, y, and the distance d to the nearest pixel outside. Rings of a batch are measured together."""
    return _pole(*_xy(ring))


@F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in ("x", "y", "own", "px", "py", "pole")]))
def _label_places(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    from .rings import label_places

    return pd.DataFrame(label_places(*_flat(xs, ys)), columns=["x", "y", "own", "px", "py", "pole"])


def label_places(ring: str) -> Column:
    """Interior point x, y with its clearance `own`, and the pole px, py with its distance `pole`, of all rings of a batch."""
    return _label_places(*_xy(ring))


def with_pole(zones: DataFrame, ring: str, name: str) -> DataFrame:
    """Adds the pole of inaccessibility as `name`. Zones are dealt out first: the pole is much work for few bytes."""
    return scratch.dealt(zones, "image_id", "zone_id").withColumn(name, pole(ring))


# --- pixels


def filled_runs(zones: DataFrame, ring: str = "polygon") -> DataFrame:
    """image_id, zone_id, y, x0, x1: the pixels of filled rings as unbroken runs: those whose centres lie inside, and those
    on the sides, drawn as lines between whole pixels.

    Rings are filled where they lie, many of a batch in one pass and without a shuffle; the work is that of their borders'
    rows, and a pass takes about FILL_ROWS of them.
    """
    of = lambda k: F.transform(ring, lambda p: p[k].cast("double")).alias(k)
    z = zones.where(F.size(ring) > 0).select("image_id", "zone_id", of("x"), of("y"))

    def fill(batches):
        import numpy as np
        import pyarrow as pa

        from .rings import filled_spans

        for batch in batches:
            ends = np.concatenate(([0], np.cumsum(batch.column(2).value_lengths().to_numpy())))
            p = np.stack([batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3)], 1)
            after = np.arange(1, len(p) + 1)
            after[ends[1:] - 1] = ends[:-1]
            s = np.hstack([p, p[after]])
            passed = np.concatenate(([0], np.cumsum(np.abs(s[:, 3] - s[:, 1]) + 2)))[ends]  # rows of the rings before
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(passed, passed[at] + FILL_ROWS, side="right")) - 1)
                owner = np.repeat(np.arange(at, to), np.diff(ends[at : to + 1]))
                own, y, x0, x1 = filled_spans(s[ends[at] : ends[to]], owner)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(y), pa.array(x0), pa.array(x1)], names=["image_id", "zone_id", "y", "x0", "x1"])
                at = to

    kinds = [f"{k} {zones.schema[k].dataType.simpleString()}" for k in ("image_id", "zone_id")]
    return z.mapInArrow(fill, ", ".join([*kinds, "y long", "x0 long", "x1 long"]))


def lineart_zones(labelled: DataFrame, min_area: float, max_area: float, epsilon: float) -> DataFrame:
    """Zones of the components of the paper between lines: gates by pixels and by the contour's area, simplified rings,
    ids in reading order. labelled: image_id, y, x0, x1, component."""
    stats = raster.component_stats(labelled).where(F.col("area").between(min_area, max_area))
    kept = labelled.join(stats.select("image_id", "component"), ["image_id", "component"], "left_semi")
    keys = ["image_id", "component"]
    firsts, moves = borders.moves(kept, keys)
    wide = scratch.materialize(borders.measures(firsts, moves, keys).where(F.col("area") >= min_area), "contours")  # rings of these alone are gathered
    z = borders.rings(firsts.join(wide, keys, "left_semi"), moves.join(wide.hint("merge"), keys, "left_semi"), keys)
    z = z.join(wide.select(*keys, F.round("area", 2).alias("area_px")), keys)
    z = polygons.simplified(z, max(CONTOUR_FLOOR, epsilon * CONTOUR_SHARE)).where(F.size("polygon") >= 3)
    z = z.join(stats.select("image_id", "component", F.col("x").alias("x0"), F.col("y").alias("y0"), "w", "h"), ["image_id", "component"])
    order = Window.partitionBy("image_id").orderBy("y0", "x0", F.desc("area_px"), "component")
    return z.select("image_id", F.row_number().over(order).cast("long").alias("zone_id"), "component", "area_px", "x0", "y0", "w", "h", "polygon", F.lit("lineart_connected_component").alias("source"))


def mask_zones(masks: DataFrame, width: int, height: int, min_area: float = MASK_MIN, overlap: float = 0.82, ratio: float = 0.65) -> DataFrame:
    """Zones of masks (image_id, mask, y, x0, x1): contours between the gates, largest first, without those that an
    accepted one of like size covers nearly."""
    low, high = max(float(min_area), width * height * MASK_MIN_RATIO), width * height * MASK_MAX_RATIO
    z = contours(raster.run_components(masks, ["image_id", "mask"]), ["image_id", "mask", "component"])
    z = z.withColumn("area_px", F.round(F.abs(S.shoelace("polygon")) / 2, 2)).where(F.col("area_px").between(low, high))
    side = lambda k: [f(F.transform("polygon", lambda p: p[k])) for f in (F.array_min, F.array_max)]
    (x0, x1), (y0, y1) = side("x"), side("y")
    z = z.withColumns({"x0": x0, "y0": y0, "w": x1 - x0 + 1, "h": y1 - y0 + 1})
    z = polygons.simplified(z, MASK_EPSILON).where(F.size("polygon") >= 3)
    order = Window.partitionBy("image_id").orderBy(F.desc("area_px"), "mask", "component")
    z = scratch.materialize(z.withColumn("zone_id", F.row_number().over(order).cast("long")), "masks")
    runs = scratch.materialize(filled_runs(z), "filled")
    sizes = runs.groupBy("image_id", "zone_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"))
    pairs = raster.overlaps(runs.withColumnRenamed("zone_id", "mask"))
    of = lambda m, n: sizes.withColumnsRenamed({"zone_id": m, "pixels": n})
    pairs = pairs.join(of("m1", "p1"), ["image_id", "m1"]).join(of("m2", "p2"), ["image_id", "m2"])
    least = F.least("p1", "p2")
    pairs = pairs.where((least >= ratio * F.greatest("p1", "p2")) & (F.col("shared") >= overlap * least)).select("image_id", F.col("m1").alias("first"), F.col("m2").alias("second"), "shared")
    # zones are numbered by area, so that the first of a pair is the larger one
    left = raster.suppress_duplicates(z.join(sizes, ["image_id", "zone_id"], "left_semi"), pairs)
    z = z.join(left, ["image_id", "zone_id"], "left_semi")
    again = F.row_number().over(Window.partitionBy("image_id").orderBy("zone_id")).cast("long")
    return z.select("image_id", again.alias("zone_id"), F.col("mask").alias("mask_index"), "area_px", "x0", "y0", "w", "h", "polygon")


# --- repair, union, cuts


def _corners(rings) -> tuple:
    """Corners (n, 2) of an Arrow column of rings one after another, how many each has, and the ring's row."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.list_value_length(rings), 0), np.int64)
    values = rings.flatten()
    return np.stack([np.asarray(pc.struct_field(values, k), float) for k in "xy"], 1), sizes, np.arange(len(sizes))


def _polygon_corners(polygons) -> tuple:
    """Of a column of polygons: corners, sizes of rings, and the row of each ring."""
    import numpy as np
    import pyarrow.compute as pc

    many = np.asarray(pc.fill_null(pc.list_value_length(polygons), 0), np.int64)
    p, sizes, _ = _corners(polygons.flatten())
    return p, sizes, np.repeat(np.arange(len(many)), many)


def _as_arrow(found: list, depth: int):
    """An Arrow column of lists of rings (depth 1) or of lists of lists of them (depth 2)."""
    import numpy as np
    import pyarrow as pa

    offsets = []
    for _ in range(depth):
        offsets.append(np.cumsum([0, *map(len, found)]))
        found = [x for f in found for x in f]
    offsets.append(np.cumsum([0, *map(len, found)]))
    p = np.concatenate([np.zeros((0, 2)), *[np.asarray(r, float).reshape(-1, 2) for r in found]])
    out = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(p[:, k])) for k in (0, 1)], ["x", "y"])
    for ends in reversed(offsets):
        out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), out)
    return out


@F.arrow_udf(_RINGS)
def _valid(found: pa.Array) -> pa.Array:
    from .rings import valid_parts_of_many

    return _as_arrow(valid_parts_of_many(*_corners(found)[:2]), 1)


@F.arrow_udf(_RINGS)
def _united(first: pa.Array, second: pa.Array) -> pa.Array:
    from .rings import united_of_many

    return _as_arrow(united_of_many(*_corners(first)[:2], *_corners(second)[:2]), 1)


@F.pandas_udf(_RINGS)
def _united_near(first: pd.Series, second: pd.Series, tolerance: pd.Series) -> pd.Series:
    from .rings import snapped, united

    def one(a, b, t):
        a, b = _pairs(a), _pairs(b)
        b = snapped(b, a, t)
        a = snapped(a, b, t)
        return [_points(p) for p in united(a, b)] if len(a) > 2 and len(b) > 2 else []

    return pd.Series([one(a, b, t) for a, b, t in zip(first, second, tolerance, strict=True)])


@F.arrow_udf(_RINGS)
def _cut(found: pa.Array, lines: pa.Array) -> pa.Array:
    from .rings import cut_of_many

    return _as_arrow(cut_of_many(*_corners(found)[:2], *_corners(lines)[:2]), 1)


def parts(ring: str) -> Column:
    """What a ring encloses, as simple rings above one square pixel, largest first; a simple ring is its own part."""
    return _valid(_doubles(ring))


def single(ring: str) -> Column:
    """The one part of a ring; null where it has none or more."""
    p = parts(ring)
    return F.when(F.size(p) == 1, F.get(p, F.lit(0)))


def largest(ring: str) -> Column:
    return F.get(parts(ring), F.lit(0))


def union_parts(first: str, second: str, tolerance: float = 0.0) -> Column:
    """Parts of the union; corners within the tolerance are snapped together before."""
    return _united_near(_doubles(first), _doubles(second), F.lit(float(tolerance))) if tolerance > 0 else _united(_doubles(first), _doubles(second))


def cut_parts(ring: str, line: str) -> Column:
    return _cut(_doubles(ring), _doubles(line))


def border_score(first: str, second: str, tolerance: float = 1.5) -> Column:
    """Length of the shared border of two rings, or of the stretch that runs within the tolerance. Pairs of a batch go together."""
    @F.pandas_udf(T.DoubleType())
    def score(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        from .rings import border_scores

        return pd.Series(border_scores(*_flat(ax, ay), *_flat(bx, by), float(tolerance)), dtype=float)

    return score(*_xy(first), *_xy(second))


def ring_area(ring: Column) -> Column:
    return F.abs(S.shoelace(ring)) / 2


def from_ring(ring: Column) -> dict[str, Column]:
    """A zone's own columns from a ring: whole corners without repeats, area of the ring as given, box."""
    whole = S.deduped(F.transform(ring, lambda p: F.struct(F.rint(p["x"]).cast("long").alias("x"), F.rint(p["y"]).cast("long").alias("y"))))
    low = lambda k: F.array_min(F.transform(ring, lambda p: p[k]))
    high = lambda k: F.array_max(F.transform(ring, lambda p: p[k]))
    up = lambda c: F.ceil(F.round(c, 6)).cast("long")
    return {"polygon": whole, "area_px": F.round(ring_area(ring), 2), "x0": F.floor(low("x")).cast("long"), "y0": F.floor(low("y")).cast("long"), "w": up(high("x") - low("x")), "h": up(high("y") - low("y"))}


# --- polygons with holes: arrays of rings, the outer one first


_POLYGONS = T.ArrayType(_RINGS)


@F.arrow_udf(_POLYGONS)
def _repaired(polygon: pa.Array) -> pa.Array:
    from . import overlay

    return _as_arrow(overlay.valid_many(*_polygon_corners(polygon), len(polygon)), 2)


@F.arrow_udf(_POLYGONS)
def _merged(first: pa.Array, second: pa.Array) -> pa.Array:
    from . import overlay

    return _as_arrow(overlay.union_many(_polygon_corners(first), _polygon_corners(second), len(first)), 2)


@F.arrow_udf(_POLYGONS)
def _split(polygon: pa.Array, line: pa.Array) -> pa.Array:
    from . import overlay

    return _as_arrow(overlay.cut_many(_polygon_corners(polygon), _corners(line), len(polygon)), 2)


def _rings_of(polygon: str) -> Column:
    return F.transform(F.coalesce(F.col(polygon), F.array()), lambda r: F.transform(r, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))


def repaired(polygon: str) -> Column:
    """What the rings of a polygon enclose by the even-odd rule, as polygons with holes above one square pixel, largest first."""
    return _repaired(_rings_of(polygon))


def merged(first: str, second: str) -> Column:
    """Parts of the union of two polygons with holes."""
    return _merged(_rings_of(first), _rings_of(second))


def split(polygon: str, line: str) -> Column:
    """Pieces of a polygon with holes that a line leaves."""
    return _split(_rings_of(polygon), _doubles(line))


def polygon_area(polygon: Column) -> Column:
    """Area of the outer ring without its holes."""
    return F.when(F.size(polygon) > 0, F.aggregate(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), ring_area(F.get(polygon, F.lit(0))), lambda a, r: a - ring_area(r))).otherwise(0.0)


# --- subdivision and fragments


def targets(zones: DataFrame, min_area: float, target_factor: float, large_factor: float) -> DataFrame:
    """image_id, target, threshold: the area that pieces should have, and from which area on a zone is cut."""
    m = zones.groupBy("image_id").agg(F.median("area_px").alias("m"))
    target = F.greatest(F.lit(float(min_area)), F.col("m")) * target_factor
    return m.select("image_id", target.alias("target"), F.greatest(target * large_factor, F.lit(2.0 * min_area * large_factor)).alias("threshold"))


def subdivide(zones: DataFrame, min_area: float, target_factor: float, large_factor: float, most: int = S.MAX_SEGMENTS) -> DataFrame:
    """Large zones as pieces along random curves, the others as they are; ids are dealt anew in order. Zones are cut
    independently of each other, so a crowded image spreads over all tasks."""
    t = targets(zones, min_area, target_factor, large_factor)
    z = zones.join(t, "image_id")
    cols = ["image_id", "zone_id", "area_px", "x0", "y0", "w", "h", "num", "polygon", "source", "parent"]
    own = z.withColumns({"source": F.col("source") if "source" in zones.columns else F.lit(None).cast("string"), "parent": F.lit(None).cast("string"), "num": F.col("num") if "num" in zones.columns else F.lit(None).cast("long")})
    large = F.col("area_px") >= F.col("threshold")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .rings import subdivided

        for pdf in batches:
            out = []
            for image, zone, ring, target in zip(pdf.image_id, pdf.zone_id, pdf.polygon, pdf.target, strict=True):
                found = subdivided(_pairs(ring), zone, target, min_area, most)
                out += [(image, zone, i, _points(p)) for i, p in enumerate(found)] if len(found) > 1 else []
            yield pd.DataFrame(out, columns=["image_id", "zone_id", "piece", "ring"])

    pieces = scratch.dealt(own.where(large), "image_id", "zone_id").select("image_id", "zone_id", largest("polygon").alias("polygon"), "target").where(F.col("polygon").isNotNull())
    pieces = pieces.mapInPandas(cut, f"image_id long, zone_id long, piece long, ring array<{POINT}>")
    new = pieces.select("image_id", "zone_id", "piece", "ring").withColumns(from_ring(F.col("ring")))
    new = new.where((F.col("area_px") >= max(SUBZONE_LEAST, int(min_area * SUBZONE_SHARE))) & (F.size("polygon") >= 3))
    enough = F.count(F.lit(1)).over(Window.partitionBy("image_id", "zone_id")) > 1
    new = scratch.materialize(new.withColumn("enough", enough).where("enough"), "pieces")
    made = new.select("image_id", "zone_id", "piece", "area_px", "x0", "y0", "w", "h", F.lit(None).cast("long").alias("num"), F.transform("polygon", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("polygon"), F.lit(SUBZONES[1]).alias("source"), F.col("zone_id").cast("string").alias("parent"))
    kept = own.join(new.select("image_id", "zone_id").distinct(), ["image_id", "zone_id"], "left_anti").withColumn("piece", F.lit(0).cast("long"))
    point = "array<struct<x:bigint,y:bigint>>"
    both = kept.select("image_id", "zone_id", "piece", *[F.col(c).cast(k).alias(c) for c, k in (("area_px", "double"), ("x0", "long"), ("y0", "long"), ("w", "long"), ("h", "long"), ("num", "long"), ("polygon", point))], "source", "parent").union(made.select("image_id", "zone_id", "piece", *cols[2:]))
    order = Window.partitionBy("image_id").orderBy("zone_id", "piece")
    return both.select("image_id", F.row_number().over(order).cast("long").alias("zone_id"), F.col("zone_id").alias("was"), *cols[2:])


def noise(inside: DataFrame) -> DataFrame:
    """Adds `noise` (0 to 1) to the pixels of zones (image_id, zone_id, x, y): a smooth field whose seed is the zone's id. A
    group is one zone."""
    cols = {f.name: f.dataType.simpleString() for f in inside.schema.fields}

    def field(pdf: pd.DataFrame) -> pd.DataFrame:
        from .rings import NOISE_SEED, noise_field

        x, y = pdf.x.to_numpy(), pdf.y.to_numpy()
        made = noise_field(int(y.max() - y.min()) + 7, int(x.max() - x.min()) + 7, int(pdf.zone_id.iloc[0]) * NOISE_SEED)
        return pdf.assign(noise=made[y - y.min() + 3, x - x.min() + 3])

    return inside.groupBy("image_id", "zone_id").applyInPandas(field, ", ".join(f"{n} {t}" for n, t in cols.items()) + ", noise double")


def superpixels(pixels: DataFrame, zones: DataFrame, target: float, compactness: float, min_area: float, epsilon: float, most: int = S.MAX_SEGMENTS, rounds: int = 10) -> DataFrame:
    """Large zones (all of `zones`) as patches of like place, gray, noise and blurred gray: image_id, zone_id, piece, area_px, box, polygon.

    The other way to subdivide. Pixels gather round centres no more than two steps away (`patches`), by place, gray, noise
    and blurred gray; small pieces join a neighbour. Patches are smoothed and cut to the zone, and the largest part of each
    is traced. Zones with fewer than two patches give none.
    """
    c = F.col
    gray = pixels.select("image_id", "x", "y", (S.gray("b", "g", "r") / 255.0).alias("v"))
    hinted = patches.edge_hint(raster.crop(gray, zones, patches.MARGIN))
    on = (c("r.image_id") == c("p.image_id")) & (c("r.zone_id") == c("p.zone_id")) & (c("r.y") == c("p.y")) & c("p.x").between(c("r.x0"), c("r.x1"))
    inside = hinted.alias("p").join(filled_runs(zones).alias("r"), on).select("p.*")
    inside = scratch.materialize(noise(inside), "inside")
    parts = patches.steps(zones, target, most)
    feature = F.array(*[F.round(k, 6) for k in ("v", "noise", "edge")])
    points = scratch.materialize(inside.join(parts, ["image_id", "zone_id"]).select("image_id", "zone_id", "x", "y", "step", feature.alias("f")), "points")
    keys = ["image_id", "zone_id", "c"]
    mask = patches.gathered(points, parts, compactness, rounds).withColumnRenamed("patch", "c")
    mask = scratch.materialize(raster.smoothed(mask, inside, keys), "patches")
    labelled = raster.run_components(raster.merged_runs(mask.select(*keys, "y", c("x").alias("x0"), c("x").alias("x1")), keys), keys)
    labelled = scratch.materialize(labelled, "labelled")
    biggest = labelled.groupBy(*keys, "component").agg(F.sum(c("x1") - c("x0") + 1).alias("n")).groupBy(*keys).agg(F.max_by("component", F.struct("n", -c("component"))).alias("component"))
    z = contours(labelled.join(biggest, [*keys, "component"], "left_semi"), keys).withColumn("area_px", F.round(F.abs(S.shoelace("polygon")) / 2, 2)).where(c("area_px") >= max(SUBZONE_LEAST, int(min_area * SUBZONE_SHARE)))
    side = lambda k: [f(F.transform("polygon", lambda p: p[k])) for f in (F.array_min, F.array_max)]
    (x0, x1), (y0, y1) = side("x"), side("y")
    z = z.withColumns({"x0": x0, "y0": y0, "w": x1 - x0 + 1, "h": y1 - y0 + 1})
    z = polygons.simplified(z, max(PATCH_FLOOR, epsilon * PATCH_SHARE)).where(F.size("polygon") >= 3)
    enough = F.count(F.lit(1)).over(Window.partitionBy("image_id", "zone_id")) > 1
    return z.withColumn("enough", enough).where("enough").select("image_id", "zone_id", c("c").alias("piece"), "area_px", "x0", "y0", "w", "h", "polygon", F.lit(SUBZONES[0]).alias("source"))


def subdivision_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """image_id, input zones, zones that were cut, pieces made."""
    made = after.where(F.col("parent").isNotNull()).groupBy("image_id").agg(F.count_distinct("parent").alias("subdivided_zones"), F.count(F.lit(1)).alias("created_zones"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return before.groupBy("image_id").agg(F.count(F.lit(1)).alias("input_zones")).join(made, "image_id", "left").select("image_id", "input_zones", zero("subdivided_zones"), zero("created_zones"))


def is_small_fragment(min_area: float) -> Column:
    return F.col("source").isin(*SUBZONES) & (F.col("area_px") < min_area)


def fragment_neighbours(zones: DataFrame, min_area: float, tolerance: float = 1.5) -> DataFrame:
    """image_id, zone_id, neighbours: for each small fragment the zones of its parent (of any, if it has none) that share
    a border with it, by area and length of border, largest first."""
    from .graph import candidates

    a = candidates(zones, int(tolerance) + 1)
    c = F.col
    names = ("zone_id", "area_px", "source", "parent", "polygon")
    pair = lambda i, j: a.select(c("a.image_id").alias("image_id"), *[c(f"{i}.{n}").alias(n) for n in names], *[c(f"{j}.{n}").alias(f"other_{n}") for n in names])
    near = pair("a", "b").union(pair("b", "a")).where(is_small_fragment(min_area)).where(c("parent").isNull() | (c("parent") == c("other_parent")))
    near = near.withColumn("border", F.round(border_score("polygon", "other_polygon", tolerance), 6)).where("border > 0")
    listed = near.groupBy("image_id", "zone_id").agg(F.sort_array(F.collect_list(F.struct(c("other_area_px").alias("area_px"), c("border"), c("other_zone_id").alias("zone_id"))), asc=False).alias("neighbours"))
    return listed


def merge_fragments(zones: DataFrame, min_area: float, rounds: int = 3) -> DataFrame:
    """Small pieces of a subdivided zone join the best neighbour of the same parent, smallest first, as long as their
    union is one part; those that can't are marked. A parent's pieces are one group (at most a few dozen); a batch's groups
    go together, step by step."""
    cols = "image_id long, zone_id long, area_px double, x0 long, y0 long, w long, h long, num long, polygon array<struct<x:bigint,y:bigint>>, source string, parent string"
    names = [c.split(" ")[0] for c in cols.split(", ")]
    z = zones.select(*[F.col(n) for n in names])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .rings import merged_pieces

        small = lambda r: r["source"] in SUBZONES and r["area_px"] < min_area

        def done(rows: list[dict]) -> pd.DataFrame:
            groups: dict[tuple, list] = {}
            for r in rows:
                r["ring"] = _pairs(r["polygon"])
                groups.setdefault((r["image_id"], r["parent"]), []).append(r)
            out = [r for g in merged_pieces(list(groups.values()), small, UNMERGED, SNAP, rounds) for r in g]
            for r in out:
                r["polygon"] = [{"x": int(x), "y": int(y)} for x, y in r.pop("ring")]
            return pd.DataFrame(out, columns=names)

        held: list[dict] = []  # the last parent's pieces may go on in the next batch
        for pdf in batches:
            held += pdf.to_dict("records")
            last = len(held)
            while last and (held[last - 1]["image_id"], held[last - 1]["parent"]) == (held[-1]["image_id"], held[-1]["parent"]):
                last -= 1
            if last:
                yield done(held[:last])
                held = held[last:]
        if held:
            yield done(held)

    # rows in order of their parents, few bytes for much work
    own = scratch.dealt(z.where(F.col("parent").isNotNull()), "image_id", "parent").sortWithinPartitions("image_id", "parent", "zone_id")
    merged = own.mapInPandas(merge, cols)
    alone = z.where(F.col("parent").isNull()).withColumn("source", F.when(is_small_fragment(min_area), UNMERGED).otherwise(F.col("source")))
    both = alone.union(merged)
    order = Window.partitionBy("image_id").orderBy("zone_id")
    return both.withColumns({"was": F.col("zone_id"), "zone_id": F.row_number().over(order).cast("long")})


def fragment_metrics(before: DataFrame, after: DataFrame, min_area: float) -> DataFrame:
    """image_id, merges, unmerged, and at most 20 of the fragments that stay small: those that failed first."""
    after = scratch.materialize(after.select("image_id", "zone_id", "area_px", "source"), "merged")  # read twice
    left = after.where((F.col("source") == UNMERGED) | is_small_fragment(min_area))
    detail = F.struct(F.when(F.col("source") == UNMERGED, 0).otherwise(1).alias("kind"), F.col("zone_id"), F.col("area_px"), F.col("source"))
    listed = left.groupBy("image_id").agg(F.count(F.lit(1)).alias("unmerged"), F.slice(F.array_sort(F.collect_list(detail)), 1, 20).alias("details"))
    counts = before.groupBy("image_id").agg(F.count(F.lit(1)).alias("b")).join(after.groupBy("image_id").agg(F.count(F.lit(1)).alias("a")), "image_id")
    return counts.join(listed, "image_id", "left").select("image_id", (F.col("b") - F.col("a")).alias("merges"), F.coalesce("unmerged", F.lit(0)).cast("long").alias("unmerged"), F.coalesce("details", F.array().cast(listed.schema["details"].dataType)).alias("details"))
