"""Adjacency of zones, components, collisions, numbering of the graph, labels of small zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars as S
from . import polygons

TOLERANCE, CELL = 10, 64


def candidates(zones: DataFrame, tolerance: int = TOLERANCE, deal: bool = False) -> DataFrame:
    """Pairs src < dst of one image whose boxes, widened by the tolerance, overlap.

    Zones meet by grid cells, so a crowded image spreads over many tasks; a pair counts only in the cell where the
    overlap of its widened boxes begins, which makes a distinct unnecessary. With `deal`, for pairs that are much work
    each, cells are dealt out to as many tasks as shuffles have, however few bytes they hold.
    """
    span = lambda lo, size: F.sequence(F.floor((F.col(lo) - tolerance) / CELL), F.floor((F.col(lo) + F.col(size) + tolerance) / CELL))
    cells = zones.withColumn("cx", F.explode(span("x0", "w"))).withColumn("cy", F.explode(span("y0", "h")))
    if deal:
        cells = scratch.dealt(cells, "image_id", "cx", "cy")
    a, b = cells.alias("a"), cells.alias("b")
    c = F.col
    near = lambda lo, size: (c(f"a.{lo}") <= c(f"b.{lo}") + c(f"b.{size}") + tolerance) & (c(f"b.{lo}") <= c(f"a.{lo}") + c(f"a.{size}") + tolerance)
    begins = lambda lo: F.floor((F.greatest(f"a.{lo}", f"b.{lo}") - tolerance) / CELL)
    on = (c("a.image_id") == c("b.image_id")) & (c("a.cx") == c("b.cx")) & (c("a.cy") == c("b.cy")) & (c("a.zone_id") < c("b.zone_id")) & near("x0", "w") & near("y0", "h") & (c("a.cx") == begins("x0")) & (c("a.cy") == begins("y0"))
    return a.join(b, on)


def box_gap(lo: str, size: str) -> Column:
    c = F.col
    return F.greatest(F.lit(0), c(f"b.{lo}") - c(f"a.{lo}") - c(f"a.{size}"), c(f"a.{lo}") - c(f"b.{lo}") - c(f"b.{size}"))


def inset() -> Column:
    """How deep one box lies strictly inside the other; 0 if it doesn't."""

    def depth(i: str, o: str) -> tuple[Column, Column]:
        c = F.col
        sides = [c(f"{i}.x0") - c(f"{o}.x0"), c(f"{o}.x0") + c(f"{o}.w") - c(f"{i}.x0") - c(f"{i}.w"), c(f"{i}.y0") - c(f"{o}.y0"), c(f"{o}.y0") + c(f"{o}.h") - c(f"{i}.y0") - c(f"{i}.h")]
        return F.least(*sides), F.least(*sides) > 0

    (ab, a_in), (ba, b_in) = depth("a", "b"), depth("b", "a")
    return F.when(a_in, ab).when(b_in, ba).otherwise(0)


def adjacency(zones: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """image_id, src, dst: zones whose boundaries come within the tolerance."""
    gx, gy = box_gap("x0", "w"), box_gap("y0", "h")
    near = candidates(zones, tolerance).where((gx * gx + gy * gy <= tolerance * tolerance) & (inset() <= tolerance))
    return near.select("a.image_id", F.col("a.zone_id").alias("src"), F.col("b.zone_id").alias("dst"))


def ring_pairs(zones: DataFrame, tolerance: int = TOLERANCE, ring: str = "polygon", *also: str) -> tuple[DataFrame, Column]:
    """Candidates a and b of general rings, with zone_id and the columns `also`, and the distance of their boundaries. Places
    of corners are made once a zone; cells are dealt out, for few bytes are much work."""
    x, y = polygons.places(ring)
    z = zones.select("image_id", "zone_id", "x0", "y0", "w", "h", *also, x.alias("_xs"), y.alias("_ys"))
    of = lambda i: [F.col(f"{i}._xs"), F.col(f"{i}._ys")]
    return candidates(z, tolerance, deal=True), polygons.gap(of("a"), of("b"))


def _near_boxes(pairs: DataFrame, tolerance: int) -> DataFrame:
    gx, gy = box_gap("x0", "w"), box_gap("y0", "h")
    return pairs.where(gx * gx + gy * gy <= tolerance * tolerance)


def ring_adjacency(zones: DataFrame, tolerance: int = TOLERANCE, ring: str = "polygon") -> DataFrame:
    """image_id, src, dst of general rings: boxes meet by grid cells, then the distance of the boundaries decides."""
    pairs, gap = ring_pairs(zones, tolerance, ring)
    return _near_boxes(pairs, tolerance).where(gap <= tolerance).select("a.image_id", F.col("a.zone_id").alias("src"), F.col("b.zone_id").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    """image_id, zone_id, other: each edge and its reverse, from one pass over the edges."""
    way = lambda a, b: F.struct(F.col(a).alias("zone_id"), F.col(b).alias("other"))
    return edges.select("image_id", F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("_e")).select("image_id", "_e.zone_id", "_e.other")


def degrees(zones: DataFrame, edges: DataFrame) -> DataFrame:
    """Every zone with its number of neighbours; isolated zones have 0."""
    d = both_ways(edges).groupBy("image_id", "zone_id").agg(F.count(F.lit(1)).alias("degree"))
    return zones.select("image_id", "zone_id").join(d, ["image_id", "zone_id"], "left").select("image_id", "zone_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def collisions(zones: DataFrame, edges: DataFrame) -> DataFrame:
    """image_id, collisions: edges whose ends share a number."""
    n = zones.select("image_id", "zone_id", "num")
    j = edges.join(n.withColumnsRenamed({"zone_id": "src", "num": "n1"}), ["image_id", "src"]).join(n.withColumnsRenamed({"zone_id": "dst", "num": "n2"}), ["image_id", "dst"])
    return j.groupBy("image_id").agg(F.count_if(F.col("n1") == F.col("n2")).alias("collisions"), F.count(F.lit(1)).alias("edges"))


def components(zones: DataFrame, edges: DataFrame) -> DataFrame:
    """image_id, zone_id, component (its smallest zone), in a logarithmic number of rounds."""
    linked = scratch.components(edges.select("image_id", F.col("src").alias("u"), F.col("dst").alias("v")), ["image_id"]).df
    j = zones.select("image_id", "zone_id").join(linked.withColumnRenamed("node", "zone_id"), ["image_id", "zone_id"], "left")
    return j.select("image_id", "zone_id", F.coalesce("label", "zone_id").alias("component"))


def graph_metrics(zones: DataFrame, edges: DataFrame) -> DataFrame:
    """image_id, edges, isolated zones, components and the largest one's size: one row for each image."""
    d = degrees(zones, edges).groupBy("image_id").agg((F.sum("degree") / 2).cast("long").alias("edges"), F.count_if(F.col("degree") == 0).alias("isolated"))
    sizes = components(zones, edges).groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("image_id").agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))
    return d.join(sizes, "image_id")


def _nearest(alone: DataFrame, big: DataFrame) -> DataFrame:
    """image_id, zone_id, near_num: the nearest large zone (then the larger, then the smaller id) of each zone of `alone`.

    Zones meet by grid cells as wide as the distance looked at, which grows fourfold each round for those that have
    found nothing, so that no zone is held against all others of a crowded image.
    """
    ends = big.agg(F.max(F.greatest(F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))).alias("hi"), F.min(F.least("x0", "y0")).alias("lo")).first()
    own = alone.agg(F.max(F.greatest(F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))).alias("hi"), F.min(F.least("x0", "y0")).alias("lo")).first()
    reach, found = CELL, None
    most = 0 if ends["hi"] is None or own["hi"] is None else max(ends["hi"], own["hi"]) - min(ends["lo"], own["lo"])
    gx, gy = box_gap("x0", "w"), box_gap("y0", "h")
    rings = "polygon" in alone.columns
    left = scratch.Table(alone, "alone").df
    while most and left.limit(1).count():
        cell = lambda lo, size, more, r=reach: F.explode(F.sequence(F.floor((F.col(lo) - more) / r), F.floor((F.col(lo) + F.col(size) + more) / r)))
        a = left.withColumn("cx", cell("x0", "w", reach)).withColumn("cy", cell("y0", "h", reach)).alias("a")
        b = big.withColumn("cx", cell("x0", "w", 0)).withColumn("cy", cell("y0", "h", 0)).alias("b")
        c = F.col
        apart = F.when(inset() > 0, F.lit(0)).otherwise(gx * gx + gy * gy)  # of boxes: rings are as far or farther, if not nested
        j = a.join(b, (c("a.image_id") == c("b.image_id")) & (c("a.cx") == c("b.cx")) & (c("a.cy") == c("b.cy")) & (apart <= reach * reach))
        j = j.select(c("a.image_id").alias("image_id"), c("a.zone_id").alias("zone_id"), apart.alias("apart"), c("b.area_px").alias("area"), c("b.zone_id").alias("other"), c("b.num").alias("num"), *[c(f"{i}.polygon").alias(f"ring_{i}") for i in "ab" if rings])
        if rings:
            j = j.withColumn("apart", F.round(polygons.ring_distance("ring_a", "ring_b"), 9)).where(F.col("apart") <= reach)
        best = j.groupBy("image_id", "zone_id").agg(F.min_by("num", F.struct("apart", -F.col("area"), "other")).alias("near_num"))
        best = scratch.Table(best, "nearest").df
        found = best if found is None else found.union(best)
        if reach > most:
            break
        reach *= 4
        left = scratch.Table(left.join(best, ["image_id", "zone_id"], "left_anti"), "alone").df
    return found if found is not None else alone.select("image_id", "zone_id", F.col("num").alias("near_num")).limit(0)


def inherit_labels(zones: DataFrame, edges: DataFrame | None, min_area: float) -> DataFrame:
    """Zones too small for a label take the number of a labelled neighbour, the largest; without one, of the nearest
    labelled zone of the image (then the larger, then the smaller id), by rings if the zones have a polygon, else by
    boxes. image_id, zone_id, num, suppressed, method. Without edges, zones whose rings come within TOLERANCE are neighbours;
    then only pairs of a small and a labelled zone are measured, and none is kept."""
    z = zones.withColumn("small", S.label_too_small("area_px", "w", "h", F.lit(min_area)))
    big = z.where("NOT small").select("image_id", F.col("zone_id").alias("other"), "area_px", "num")
    beside = _labelled_beside(z) if edges is None else both_ways(edges).join(big, ["image_id", "other"])
    by_edge = beside.groupBy("image_id", "zone_id").agg(F.max_by("num", F.struct("area_px", -F.col("other"))).alias("edge_num"))
    if edges is None:
        by_edge = scratch.materialize(by_edge, "beside")  # read twice
    base = z.join(by_edge, ["image_id", "zone_id"], "left")
    boxes = ["image_id", "zone_id", "x0", "y0", "w", "h", "area_px", "num", *[c for c in ("polygon",) if c in zones.columns]]
    near = _nearest(base.where("small AND edge_num IS NULL").select(*boxes), z.where("NOT small").select(*boxes))
    j = base.join(near, ["image_id", "zone_id"], "left")
    method = F.when(~F.col("small"), "own").when(F.col("edge_num").isNotNull(), "neighbour").when(F.col("near_num").isNotNull(), "nearest").otherwise("none")
    return j.select("image_id", "zone_id", F.when(F.col("small"), F.coalesce("edge_num", "near_num", "num")).otherwise(F.col("num")).alias("num"), F.col("small").alias("suppressed"), method.alias("method"))


def _labelled_beside(zones: DataFrame) -> DataFrame:
    """image_id, zone_id of small zones, other, area_px and num of labelled ones beside them, by rings."""
    pairs, gap = ring_pairs(zones, TOLERANCE, "polygon", "area_px", "num", "small")
    near = _near_boxes(pairs, TOLERANCE).where("a.small <> b.small").where(gap <= TOLERANCE)
    of = lambda name, small: F.when(F.col("a.small") == small, F.col(f"a.{name}")).otherwise(F.col(f"b.{name}"))
    return near.select("a.image_id", of("zone_id", True).alias("zone_id"), of("zone_id", False).alias("other"), of("area_px", False).alias("area_px"), of("num", False).alias("num"))


def label_metrics(zones: DataFrame, inherited: DataFrame) -> DataFrame:
    """image_id, suppressed labels, how many of them took another number, visible ones."""
    j = inherited.join(zones.select("image_id", "zone_id", F.col("num").alias("was")), ["image_id", "zone_id"])
    return j.groupBy("image_id").agg(F.count_if("suppressed").alias("suppressed_labels"), F.count_if(F.col("suppressed") & (F.col("num") != F.col("was"))).alias("inherited_labels"), F.count_if(~F.col("suppressed")).alias("visible_labels"))


def assign_numbers(zones: DataFrame, edges: DataFrame, n: int, passes: int = 4) -> DataFrame:
    """image_id, zone_id, num: saturation-first colouring of each image's graph, then passes that move colliding zones.

    The choice of every step depends on the ones before it, so an image is one group; its graph, not its pixels,
    is what a task holds.
    """
    import pandas as pd

    near = both_ways(edges).groupBy("image_id", "zone_id").agg(F.collect_list("other").alias("near"))
    graph = zones.select("image_id", "zone_id", F.col("area_px").cast("double").alias("area_px")).join(near, ["image_id", "zone_id"], "left")

    def colour(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        area = dict(zip(pdf.zone_id, pdf.area_px, strict=True))
        near = {z: set() if x is None else {int(y) for y in x} for z, x in zip(pdf.zone_id, pdf.near, strict=True)}
        usage, got, seen = dict.fromkeys(range(1, n + 1), 0), {}, {z: set() for z in area}
        # a heap with stale entries: a zone is pushed again when its neighbours' colours grow
        heap = [(0, -len(near[z]), -area[z], z) for z in area]
        heapq.heapify(heap)
        clashes = lambda z, c: sum(got.get(o) == c for o in near[z])
        while heap:
            s, _, _, z = heapq.heappop(heap)
            if z in got or -s != len(seen[z]):
                continue
            free = [c for c in usage if c not in seen[z]]
            c = min(free, key=lambda c: (usage[c], c)) if free else min(usage, key=lambda c: (clashes(z, c), usage[c], c))
            got[z] = c
            usage[c] += 1
            for o in near[z]:
                if o not in got and c not in seen[o]:
                    seen[o].add(c)
                    heapq.heappush(heap, (-len(seen[o]), -len(near[o]), -area[o], o))
        for _ in range(passes):
            bad = sorted((z for z in got if clashes(z, got[z])), key=lambda z: (-clashes(z, got[z]), -len(near[z]), -area[z], z))
            moved = False
            for z in bad:
                old = got[z]
                if usage[old] == 1 and len(got) >= n:
                    continue
                best = min(usage, key=lambda c: (clashes(z, c), usage[c], c))
                if clashes(z, best) < clashes(z, old):
                    usage[old] -= 1
                    usage[best] += 1
                    got[z] = best
                    moved = True
            if not moved:
                break
        return pd.DataFrame({"image_id": pdf.image_id, "zone_id": pdf.zone_id, "num": [got[z] for z in pdf.zone_id]})

    return graph.groupBy("image_id").applyInPandas(colour, "image_id long, zone_id long, num long")
