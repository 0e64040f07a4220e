"""Raster steps over pixel relations: frame, morphology, runs, components, colour means, grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars as S
from .graph import candidates


def frame(pixels: DataFrame, w: int, h: int) -> DataFrame:
    """A line of one pixel round the page: v is 255 there."""
    edge = F.col("x").isin(0, w - 1) | F.col("y").isin(0, h - 1)
    return pixels.withColumn("v", F.when(edge, F.lit(255).cast("long")).otherwise(F.col("v")))


def dilate_rows(pixels: DataFrame, radius: int) -> DataFrame:
    """Largest v within the radius on the same row."""
    w = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-radius, radius)
    return pixels.select("image_id", "x", "y", F.max("v").over(w).alias("v"))


def invert(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", (255 - F.col("v")).cast("long"))


def line_pixels(pixels: DataFrame) -> DataFrame:
    """image_id, line_pixels: how many pixels aren't 0."""
    return pixels.groupBy("image_id").agg(F.count_if(F.col("v") != 0).alias("line_pixels"))


def ellipse(radius: int) -> list[int]:
    """Half the width of an elliptic kernel on each row from the middle up to the radius."""
    return [round(math.sqrt(radius * radius - dy * dy)) if radius else 0 for dy in range(radius + 1)]


def _spread(pixels: DataFrame, widths: list[int], f) -> DataFrame:
    """Largest or smallest v under a kernel that narrows away from its middle row: along rows for each width, then along
    columns as far as that width reaches."""
    row = lambda k: Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-k, k)
    column = lambda k: Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-k, k)
    each = sorted(set(widths))
    wide = pixels.withColumns({f"_m{k}": f("v").over(row(k)) for k in each})
    reach = {k: max(dy for dy, w in enumerate(widths) if w >= k) for k in each}
    tall = [f(f"_m{k}").over(column(reach[k])) for k in each]
    pick = F.greatest if f is F.max else F.least
    return wide.withColumn("v", pick(*tall) if len(tall) > 1 else tall[0]).drop(*[f"_m{k}" for k in each])


def close_mask(pixels: DataFrame, radius: int) -> DataFrame:
    """Morphological closing with an elliptic kernel: maxima, then minima. Pixels outside the page don't count."""
    return _spread(_spread(pixels, ellipse(radius), F.max), ellipse(radius), F.min)


def _offsets(radius: int) -> list[tuple[int, int]]:
    wide = ellipse(radius)
    return [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-wide[abs(dy)], wide[abs(dy)] + 1)]


#: Side of the tiles that sets of pixels are smoothed in, and tiles that go together.
TILE, TILES = 64, 256


def smoothed(mask: DataFrame, within: DataFrame, keys: list[str], radius: int = 2) -> DataFrame:
    """Sets of pixels (keys, x, y) closed, then opened with an elliptic kernel, and cut to those of `within` (the keys
    that both have, x, y). A pixel lies in a grown set if a kernel about it meets the set, in a shrunk one if the whole
    kernel does.

    The four steps reach 4 * radius pixels, so a set falls into tiles that take the pixels about them along; a row is one
    tile, and no task holds a set.
    """
    k, reach = _offsets(radius), 4 * radius
    wide = TILE + 2 * reach
    homes = lambda c: F.sequence(F.floor((F.col(c) - reach) / TILE), F.floor((F.col(c) + reach) / TILE))
    p = mask.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    p = p.withColumn("_tx", F.explode(homes("x"))).withColumn("_ty", F.explode(homes("y")))
    place = (F.col("y") - F.col("_ty") * TILE + reach) * wide + F.col("x") - F.col("_tx") * TILE + reach
    tiles = p.groupBy(*keys, "_tx", "_ty").agg(F.collect_list(place.cast("int")).alias("_at"))

    def smooth(batches):
        import numpy as np
        import pyarrow as pa

        def spread(m, whole: bool):
            out = np.full(m.shape, whole)
            r = max(max(abs(dx), abs(dy)) for dx, dy in k)
            big = np.zeros((len(m), wide + 2 * r, wide + 2 * r), bool)
            big[:, r : r + wide, r : r + wide] = m
            for dx, dy in k:
                part = big[:, r + dy : r + dy + wide, r + dx : r + dx + wide]
                out = out & part if whole else out | part
            return out

        for batch in batches:
            n = len(keys)
            tx, ty = (np.asarray(batch.column(n + i)) for i in (0, 1))
            for at in range(0, batch.num_rows, TILES):
                own = batch.column(n + 2).slice(at, TILES)
                sizes = own.value_lengths().to_numpy()
                m = np.zeros((len(own), wide * wide), bool)
                m[np.repeat(np.arange(len(own)), sizes), own.flatten().to_numpy()] = True
                m = m.reshape(-1, wide, wide)
                for whole in (False, True, True, False):  # grow, shrink; shrink, grow
                    m = spread(m, whole)
                i, y, x = np.nonzero(m[:, reach : reach + TILE, reach : reach + TILE])
                i += at
                yield pa.RecordBatch.from_arrays([*[batch.column(j).take(pa.array(i)) for j in range(n)], pa.array(x + tx[i] * TILE), pa.array(y + ty[i] * TILE)], names=[*keys, "x", "y"])

    kinds = [f"{c} {mask.schema[c].dataType.simpleString()}" for c in keys]
    done = tiles.mapInArrow(smooth, ", ".join([*kinds, "x long", "y long"]))
    on = [c for c in keys if c in within.columns] + ["x", "y"]
    return done.join(within.select(*on), on, "left_semi")


def gaussian(block: int) -> list[float]:
    """Weights of a Gaussian over `block` pixels, from the middle outwards; sigma follows the size."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    w = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(block // 2 + 1)]
    total = w[0] + 2 * sum(w[1:])
    return [x / total for x in w]


def _blurred(pixels: DataFrame, part: str, along: str, source: str, name: str, weights: list[float]) -> DataFrame:
    """Weighted mean along rows or columns; beyond the first and last pixel their values go on. Weights of gaps are shared out."""
    r = len(weights) - 1
    near = F.collect_list(F.struct(along, F.col(source).cast("double").alias("v"))).over(Window.partitionBy("image_id", part).orderBy(along).rangeBetween(-r, r))
    table = F.array(*[F.lit(x) for x in weights])
    beyond = F.array(*[F.lit(sum(weights[d + 1 :])) for d in range(r + 1)])  # weight farther out than d on one side
    at = lambda t, p: F.element_at(t, (F.abs(p[along] - F.col(along)) + 1).cast("int"))
    first, last = F.element_at("_near", 1), F.element_at("_near", -1)
    ends = F.array(F.struct(at(beyond, first).alias("w"), first["v"].alias("v")), F.struct(at(beyond, last).alias("w"), last["v"].alias("v")))
    every = F.concat(F.transform("_near", lambda p: F.struct(at(table, p).alias("w"), p["v"].alias("v"))), ends)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    mean = F.aggregate(every, zero, lambda a, p: F.struct((a["s"] + p["w"] * p["v"]).alias("s"), (a["w"] + p["w"]).alias("w")), lambda a: a["s"] / a["w"])
    return pixels.withColumn("_near", near).withColumn(name, mean).drop("_near")


def adaptive_threshold(pixels: DataFrame, block: int = S.BLOCK_SIZE, c: float = S.BLOCK_C) -> DataFrame:
    """255 where v lies c or more under the whole-number Gaussian mean of the block around it (inverted threshold)."""
    w = gaussian(block)
    p = _blurred(_blurred(pixels, "y", "x", "v", "_m0", w), "x", "y", "_m0", "_m", w)
    return p.select("image_id", "x", "y", F.when(F.col("v") <= F.rint(F.round("_m", 6)) - c, F.lit(255)).otherwise(F.lit(0)).cast("long").alias("v"))


def resize_mask(pixels: DataFrame, w: int, h: int, to_w: int, to_h: int) -> DataFrame:
    """Nearest pixel of a smaller or larger mask: each target pixel takes floor(place * size / target size)."""
    span = lambda k, n, m: F.sequence(F.ceil(F.col(k) * F.lit(m / n) - 1e-9).cast("long"), F.ceil((F.col(k) + 1) * F.lit(m / n) - 1e-9).cast("long") - 1, F.lit(1).cast("long"))
    some = lambda k, n, m: F.ceil(F.col(k) * F.lit(m / n) - 1e-9) <= F.ceil((F.col(k) + 1) * F.lit(m / n) - 1e-9) - 1
    p = pixels.where(some("x", w, to_w) & some("y", h, to_h)).withColumn("_x", F.explode(span("x", w, to_w))).withColumn("_y", F.explode(span("y", h, to_h)))
    return p.select("image_id", F.col("_x").alias("x"), F.col("_y").alias("y"), "v")


def crop(pixels: DataFrame, zones: DataFrame, margin: int = 3) -> DataFrame:
    """image_id, zone_id and the pixels in each zone's box widened by the margin; boxes and pixels meet row by row."""
    z = zones.select("image_id", "zone_id", "x0", "w", F.explode(F.sequence(F.col("y0") - margin, F.col("y0") + F.col("h") - 1 + margin)).alias("y"))
    p = pixels.alias("p")
    on = (F.col("p.image_id") == F.col("z.image_id")) & (F.col("p.y") == F.col("z.y")) & F.col("p.x").between(F.col("z.x0") - margin, F.col("z.x0") + F.col("z.w") - 1 + margin)
    return p.join(z.alias("z"), on).select("p.image_id", "z.zone_id", "p.x", "p.y", *[f"p.{k}" for k in pixels.columns if k not in ("image_id", "x", "y")])


def median3(pixels: DataFrame) -> DataFrame:
    """Median of the 3 x 3 pixels around each; beyond the page's edges their values go on. Pixels missing inside are left out."""
    shift = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    ends = pixels.groupBy("image_id").agg(*[f(k).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in "xy"])
    held = lambda k: F.greatest(F.col(f"min_{k}"), F.least(F.col(f"max_{k}"), F.col(k) + F.col(f"s.d{k}")))
    around = pixels.select("image_id", "x", "y", shift.alias("s")).join(ends, "image_id").select("image_id", F.col("x").alias("to_x"), F.col("y").alias("to_y"), held("x").alias("x"), held("y").alias("y"))
    m = around.join(pixels, ["image_id", "x", "y"]).groupBy("image_id", "to_x", "to_y").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    return m.select("image_id", F.col("to_x").alias("x"), F.col("to_y").alias("y"), F.floor("m").cast("long").alias("v"))


def runs(pixels: DataFrame) -> DataFrame:
    """Gaps and islands: image_id, y, x0, x1 of unbroken pixels on a row."""
    g = F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x"))
    return pixels.withColumn("g", g).groupBy("image_id", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")


def merged_runs(r: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs (keys, y, x0, x1) of which those that touch or overlap on a row are one."""
    keys = keys or ["image_id"]
    w = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    n = r.withColumn("_new", F.when(F.col("x0") <= reach + 1, 0).otherwise(1)).withColumn("_n", F.sum("_new").over(w))
    return n.groupBy(*keys, "y", "_n").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_n")


#: Width of the cells by which runs of neighbouring rows meet; runs are named by their row and first column, ROW apart.
CELL, ROW = 256, 1 << 32


def run_components(r: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """8-connected components of runs, apart for each value of the keys (image_id): keys, y, x0, x1, component, which is
    the smallest of its nodes y * 2^32 + x0. Runs, not pixels, are the graph's nodes; places from 2^31 on raise an error.

    Runs of neighbouring rows meet by cells of columns, so a row of many runs isn't held against all of the next.
    """
    keys = keys or ["image_id"]
    c = F.col
    held = lambda k: F.when(F.abs(c(k)) < ROW // 2, c(k).cast("long")).otherwise(F.raise_error(F.concat(F.lit(f"{k} is beyond 2^31: "), c(k).cast("string"))))
    nodes = r.withColumn("node", held("y") * ROW + held("x0"))
    cell = lambda low, high: F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))
    own = nodes.select(*keys, "y", "x0", "x1", "node")
    a, b = own.withColumn("cell", cell(c("x0") - 1, c("x1") + 1)).alias("a"), own.withColumn("cell", cell(c("x0"), c("x1"))).alias("b")
    on = (c("b.y") == c("a.y") + 1) & (c("a.cell") == c("b.cell")) & (c("a.x0") <= c("b.x1") + 1) & (c("b.x0") <= c("a.x1") + 1)
    on &= c("a.cell") == F.floor(F.greatest(c("a.x0") - 1, c("b.x0")) / CELL)  # a pair counts in the cell where it begins
    for k in keys:
        on &= c(f"a.{k}") == c(f"b.{k}")
    edges = a.join(b, on).select(*[c(f"a.{k}").alias(k) for k in keys], c("a.node").alias("u"), c("b.node").alias("v"))
    linked = scratch.components(edges, keys).df
    return nodes.join(linked, [*keys, "node"], "left").select(*keys, "y", "x0", "x1", F.coalesce("label", "node").alias("component"))


def component_stats(labelled: DataFrame) -> DataFrame:
    """Box and pixel count of each component, from its runs."""
    return labelled.groupBy("image_id", "component").agg(F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))


def overlaps(masks: DataFrame) -> DataFrame:
    """Pixels that pairs of masks (image_id, mask, y, x0, x1) share, by intervals of the same row."""
    a, b = masks.alias("a"), masks.alias("b")
    c = F.col
    on = (c("a.image_id") == c("b.image_id")) & (c("a.y") == c("b.y")) & (c("a.mask") < c("b.mask")) & (c("a.x0") <= c("b.x1")) & (c("b.x0") <= c("a.x1"))
    shared = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0") + 1
    return a.join(b, on).groupBy(c("a.image_id").alias("image_id"), c("a.mask").alias("m1"), c("b.mask").alias("m2")).agg(F.sum(shared).alias("shared"))


def duplicates(zones: DataFrame, overlap: float = 0.82, ratio: float = 0.65) -> DataFrame:
    """Pairs of boxes of like size that cover each other nearly: image_id, first (larger), second, shared. Boxes meet by grid cells."""
    c = F.col
    side = lambda lo, size: F.least(c(f"a.{lo}") + c(f"a.{size}"), c(f"b.{lo}") + c(f"b.{size}")) - F.greatest(c(f"a.{lo}"), c(f"b.{lo}"))
    small, large = F.least("a.area_px", "b.area_px"), F.greatest("a.area_px", "b.area_px")
    shared = side("x0", "w") * side("y0", "h")
    j = candidates(zones, 0).where((side("x0", "w") > 0) & (side("y0", "h") > 0) & (small >= ratio * large) & (shared >= overlap * small))
    a_first = (c("a.area_px") > c("b.area_px")) | ((c("a.area_px") == c("b.area_px")) & (c("a.zone_id") < c("b.zone_id")))
    return j.select("a.image_id", F.when(a_first, c("a.zone_id")).otherwise(c("b.zone_id")).alias("first"), F.when(a_first, c("b.zone_id")).otherwise(c("a.zone_id")).alias("second"), shared.alias("shared"))


def suppress_duplicates(zones: DataFrame, pairs: DataFrame) -> DataFrame:
    """Zones that stay when each, largest first, goes if a zone that stayed covers it.

    Zones in no pair stay as they are. The others are decided by rounds: a zone whose coverers are all decided is
    decided. Chains of coverings are short, for sizes must be alike; each round is a written table.
    """
    pairs = scratch.Table(pairs.select("image_id", "first", "second").distinct(), "pairs").df
    open_ = scratch.Table(pairs.select("image_id", F.col("second").alias("zone_id")).distinct(), "open")
    gone = scratch.Table(open_.df.limit(0), "gone")
    while open_.df.limit(1).count():
        over = pairs.withColumn("zone_id", F.col("second")).join(open_.df, ["image_id", "zone_id"], "left_semi").withColumn("over", F.col("first"))
        lost = gone.df.withColumnRenamed("zone_id", "over").withColumn("lost", F.lit(True))
        waits = open_.df.withColumnRenamed("zone_id", "over").withColumn("waits", F.lit(True))
        known = over.join(lost, ["image_id", "over"], "left").join(waits, ["image_id", "over"], "left")
        state = known.groupBy("image_id", "zone_id").agg(F.bool_or(F.col("lost").isNull() & F.col("waits").isNull()).alias("goes"), F.bool_or(F.col("waits").isNotNull()).alias("waits"))
        state = scratch.Table(state, "state")
        more = scratch.Table(gone.df.union(state.df.where("goes").select("image_id", "zone_id")), "gone")
        rest = scratch.Table(state.df.where("NOT goes AND waits").select("image_id", "zone_id"), "open")
        for t in (gone, open_, state):
            t.free()
        gone, open_ = more, rest
    return zones.select("image_id", "zone_id").join(gone.df, ["image_id", "zone_id"], "left_anti")


def box_runs(zones: DataFrame) -> DataFrame:
    """image_id, zone_id, y, x0, x1: the pixels of boxes, right and lower edges left out."""
    y = F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("h") - 1))
    return zones.where("w > 0 AND h > 0").select("image_id", "zone_id", y.alias("y"), "x0", (F.col("x0") + F.col("w") - 1).alias("x1"))


def mean_colours(pixels: DataFrame, runs: DataFrame) -> DataFrame:
    """Mean BGR of the pixels in each zone's runs, truncated to whole numbers. Runs and pixels meet row by row."""
    c = F.col
    on = (c("z.image_id") == c("p.image_id")) & (c("z.y") == c("p.y")) & c("p.x").between(c("z.x0"), c("z.x1"))
    return pixels.alias("p").join(runs.alias("z"), on).groupBy("z.image_id", "z.zone_id").agg(*[F.floor(F.avg(f"p.{k}")).cast("long").alias(k) for k in "bgr"], F.count(F.lit(1)).alias("n"))


def shrink(pixels: DataFrame, factor: int) -> DataFrame:
    """Means over squares of factor pixels."""
    at = [F.floor(F.col(k) / factor).cast("long").alias(k) for k in ("x", "y")]
    return pixels.groupBy("image_id", *at).agg(*[F.rint(F.avg(k)).cast("long").alias(k) for k in "bgr"])


def area_shrink(pixels: DataFrame, w: int, h: int, most: int = 360) -> DataFrame:
    """A page shrunk so that its longer side has at most `most` pixels: means by the shares that target pixels cover."""
    scale = min(1.0, most / max(w, h))
    if scale == 1.0:
        return pixels
    p, share = pixels, F.lit(1.0)
    for k, size in (("x", w), ("y", h)):
        step = size / round(size * scale)
        n = round(size * scale)
        first = F.floor(F.col(k) / step + 1e-9)
        ends = F.least(F.ceil((F.col(k) + 1) / step - 1e-9) - 1, F.lit(n - 1))
        p = p.withColumn(f"_{k}", F.explode(F.sequence(first.cast("long"), F.greatest(first, ends).cast("long"))))
        share = share * (F.least(F.col(k) + 1, (F.col(f"_{k}") + 1) * step) - F.greatest(F.col(k), F.col(f"_{k}") * step))
    p = p.withColumn("_s", share)
    return p.groupBy("image_id", F.col("_x").alias("x"), F.col("_y").alias("y")).agg(*[F.rint(F.round(F.sum(F.col(k) * F.col("_s")) / F.sum("_s"), 6)).cast("long").alias(k) for k in "bgr"])


def gray_pixels(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "x", "y", S.gray("b", "g", "r").alias("v"))
