"""Ring kernels against plain forms: pixels, grids, sorted cuts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paintgraph.operators import rings as R

rng = random.Random(9)
SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
BENT = [(0, 0), (20, 0), (20, 6), (8, 6), (8, 14), (20, 14), (20, 20), (0, 20)]  # a C


def star(n=9, r=40.0, x=50.0, y=50.0):
    return [(x + d * math.cos(a), y + d * math.sin(a)) for i in range(n) for a, d in [(2 * math.pi * i / n, r * rng.uniform(0.4, 1.0))]]


def share(ring_list, x, y):
    return any(R.contains(r, x, y) for r in ring_list)


def test_union_by_points():
    for _ in range(12):
        a, b = star(), star(7, 35.0, 50 + rng.uniform(-40, 40), 50 + rng.uniform(-40, 40))
        parts = R.united(a, b)
        hits = [(x, y) for x, y in ((rng.uniform(0, 130), rng.uniform(0, 130)) for _ in range(400))]
        inner = [p for p in hits if R.contains(a, *p) or R.contains(b, *p)]
        assert all(share(parts, *p) for p in inner)
        outer = [p for p in hits if not (R.contains(a, *p) or R.contains(b, *p))]
        wrong = [p for p in outer if share(parts, *p)]  # holes between both are filled
        assert len(wrong) <= 0.1 * len(hits) and max(R.area(a), R.area(b)) - 1e-6 <= sum(map(R.area, parts))


def test_touching_and_apart():
    assert len(R.united(SQUARE, [(10, 2), (20, 2), (20, 8), (10, 8)])) == 1  # a shared edge
    assert len(R.united(SQUARE, [(10, 10), (20, 10), (20, 20), (10, 20)])) == 2  # a shared corner
    assert len(R.united(SQUARE, [(11, 0), (20, 0), (20, 10), (11, 10)])) == 2
    (merged,) = R.united(R.snapped(SQUARE, [(11, 0), (20, 0), (20, 10), (11, 10)], 2.0), [(11, 0), (20, 0), (20, 10), (11, 10)])
    assert R.area(merged) == 200
    assert [R.area(r) for r in R.united(SQUARE, [(2, 2), (4, 2), (4, 4), (2, 4)])] == [100]


def test_cuts_keep_the_area():
    for _ in range(12):
        s = star(11)
        line = [(-10, rng.uniform(30, 70)), (50, rng.uniform(30, 70)), (110, rng.uniform(30, 70))]
        pieces = R.cut_by(s, line, 0.0)
        assert math.isclose(sum(map(R.area, pieces)), R.area(s), rel_tol=1e-6) and len(pieces) >= 2
    assert len(R.cut_by(BENT, [(15, -5), (15, 25)])) == 3 and len(R.cut_by(SQUARE, [(-5, 3), (5, 3)])) == 1


def test_repair():
    bow = [(0, 0), (10, 10), (10, 0), (0, 10)]
    assert [R.area(p) for p in R.valid_parts(bow)] == [25, 25] and [R.area(p) for p in R.valid_parts(BENT)] == [R.area(BENT)]
    assert R.valid_parts([(0, 0), (5, 5)]) == [] and R.valid_parts([(0, 0), (1, 0), (1, 1), (0, 1)]) == []


def test_points_and_poles():
    for ring in (SQUARE, BENT, star(), star(13)):
        assert R.contains(ring, *R.inner_point(ring))
        x, y, d = R.pole(ring)
        mask, x0, y0 = R.filled(ring)
        off = np.argwhere(~mask)
        best = max((np.hypot(*(off - p).T).min(), p) for p in map(tuple, np.argwhere(mask)))[0]
        assert math.isclose(d, best)


def test_distances():
    mask = np.array([[rng.random() < 0.8 for _ in range(23)] for _ in range(17)])
    mask[0] = mask[-1] = mask[:, 0] = mask[:, -1] = False
    got, off = R.distances(mask), np.argwhere(~mask)
    for p in map(tuple, np.argwhere(mask)):
        assert math.isclose(got[p], np.hypot(*(off - p).T).min())


def test_borders():
    right = [(10, 2), (20, 2), (20, 8), (10, 8)]
    assert R.border_score(SQUARE, right) == 6 and R.border_score(SQUARE, [(13, 2), (20, 2), (20, 8), (13, 8)]) == 0
    near = R.near_border(SQUARE, [(11, 2), (20, 2), (20, 8), (11, 8)], 1.5)
    assert math.isclose(near, 6 + 2 * 0.5)
    for _ in range(6):  # against many points on the second boundary
        a, b = star(), star(8, 30.0, 80.0, 55.0)
        pts = np.concatenate([np.linspace(p, q, 2000, endpoint=False) for p, q in zip(b, [*b[1:], b[0]], strict=True)])
        step = np.concatenate([np.full(2000, math.dist(p, q) / 2000) for p, q in zip(b, [*b[1:], b[0]], strict=True)])
        s = R.sides_of(a)
        d = s[:, 2:] - s[:, :2]
        t = np.clip(((pts[:, None] - s[:, :2]) * d).sum(2) / (d**2).sum(1), 0, 1)
        far = np.hypot(*(pts[:, None] - s[:, :2] - t[..., None] * d).transpose(2, 0, 1)).min(1)
        assert math.isclose(R.near_border(a, b, 5.0), step[far < 5].sum(), rel_tol=0.02, abs_tol=0.1)


def test_subdivision_is_repeatable_and_whole():
    ring = [(0, 0), (160, 0), (160, 90), (0, 90)]
    a, b = R.subdivided(ring, 5, 3000, 300, 64), R.subdivided(ring, 5, 3000, 300, 64)
    assert a == b and len(a) >= round(R.area(ring) / 3000) and math.isclose(sum(map(R.area, a)), R.area(ring), rel_tol=0.09)
    assert R.subdivided(ring, 6, 3000, 300, 64) != a


def test_noise_is_repeatable_and_smooth():
    a = R.noise_field(60, 80, 7919)
    assert (a == R.noise_field(60, 80, 7919)).all() and (a.min(), a.max()) == (0.0, 1.0) and a.shape == (60, 80)
    assert np.abs(np.diff(a, axis=1)).mean() < 0.05 and not np.allclose(a, R.noise_field(60, 80, 7920))
    assert R.noise_field(3, 3, 1).shape == (3, 3)



SQUARE_WITH_HOLE = [[(0, 0), (30, 0), (30, 30), (0, 30)], [(10, 10), (20, 10), (20, 20), (10, 20)]]


def in_polygon(polygon, x, y):
    return sum(R.contains(r, x, y) for r in polygon) % 2 == 1


def test_holes_survive_repair_union_and_cuts():
    from paintgraph.operators import overlay as O

    (p,) = O.valid(SQUARE_WITH_HOLE)
    assert len(p) == 2 and O.polygon_area(p) == 800
    (u,) = O.union(SQUARE_WITH_HOLE, [[(25, 5), (40, 5), (40, 8), (25, 8)]])
    assert len(u) == 2 and O.polygon_area(u) == 830
    (u,) = O.union(SQUARE_WITH_HOLE, [[(12, 12), (18, 12), (18, 18), (12, 18)]])[:1]
    assert O.polygon_area(u) == 800  # an island in the hole is a part of its own
    assert len(O.union(SQUARE_WITH_HOLE, [[(12, 12), (18, 12), (18, 18), (12, 18)]])) == 2
    (u,) = O.union(SQUARE_WITH_HOLE, [[(5, 5), (25, 5), (25, 15), (5, 15)]])
    assert O.polygon_area(u) == 850 and len(u) == 2
    (u,) = O.union(SQUARE_WITH_HOLE, [[(10, 10), (20, 10), (20, 20), (10, 20)]])
    assert len(u) == 1 and O.polygon_area(u) == 900
    pieces = O.cut(SQUARE_WITH_HOLE, [(5, -1), (5, 31)])
    assert [O.polygon_area(x) for x in pieces] == [650, 150] and [len(x) for x in pieces] == [2, 1]
    assert [O.polygon_area(x) for x in O.cut(SQUARE_WITH_HOLE, [(-1, 15), (31, 15)])] == [400, 400]
    deep = [*SQUARE_WITH_HOLE, [(12, 12), (18, 12), (18, 18), (12, 18)], [(14, 14), (16, 14), (16, 16), (14, 16)]]
    assert [(O.polygon_area(x), len(x)) for x in O.valid(deep)] == [(800, 2), (32, 2)]


@pytest.mark.parametrize("seed", range(10))
def test_overlays_agree_with_points(seed):
    from paintgraph.operators import overlay as O

    r = random.Random(seed)
    shape = lambda: [[(60 + x, 60 + y) for x, y in ((d * math.cos(a), d * math.sin(a)) for a, d in ((2 * math.pi * i / n, r.uniform(15, 55)) for i in range(n)))] for n in (r.randint(4, 30), r.randint(3, 9))]
    a, b = shape(), shape()
    found, own = O.union(a, b, 0.0), O.valid(a, 0.0)
    pieces = [x for p in own for x in O.cut(p, [(0, r.uniform(30, 90)), (60, r.uniform(30, 90)), (130, r.uniform(30, 90))], 0.0)]
    assert math.isclose(sum(map(O.polygon_area, pieces)), sum(map(O.polygon_area, own)), rel_tol=1e-6)
    for _ in range(300):
        x, y = r.uniform(0, 120), r.uniform(0, 120)
        inside = in_polygon(a, x, y)
        assert any(in_polygon(p, x, y) for p in found) == (inside or in_polygon(b, x, y))
        assert sum(in_polygon(p, x, y) for p in own) == sum(in_polygon(p, x, y) for p in pieces) == inside


def test_rings_of_many_sides_take_bounded_memory():
    import tracemalloc

    from paintgraph.operators import overlay as O

    wave = lambda n, x, k: [(x + (400 + 20 * math.sin(k * a)) * math.cos(a), 500 + (400 + 20 * math.sin(k * a)) * math.sin(a)) for a in (math.tau * i / n for i in range(n))]
    a, b = wave(20_000, 500, 60), wave(20_000, 620, 50)
    tracemalloc.start()
    parts = O.union([a], [b])
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used < 200e6 and max(R.area(a), R.area(b)) < O.polygon_area(parts[0]) < R.area(a) + R.area(b)


def test_snapping_moves_corners_and_sides():
    right = [(11, 3), (20, 3), (20, 7), (11, 7)]
    assert R.snapped(SQUARE, right, 2.0) == [(0, 0), (10, 0), (11, 3), (11, 7), (10, 10), (0, 10)]  # its side takes the other's corners
    assert R.snapped(SQUARE, right, 0.5) == [tuple(map(float, p)) for p in SQUARE]
    assert R.snapped(SQUARE, [(10.5, 0.5), (11, 9), (20, 4)], 1.5)[1:3] == [(10.5, 0.5), (11, 9)]
    for _ in range(30):
        a, b, tol = star(12), star(9, 40.0, 60.0), rng.uniform(1, 9)
        got = R.snapped(a, b, tol)
        moved = []
        for p in a:  # plain form: nearest corner, then nearest side for the others
            d, q = min((math.dist(p, q), i) for i, q in enumerate(b))
            moved.append(tuple(b[q]) if d < tol else p)
        moved = [p for i, p in enumerate(moved) if i == 0 or p != moved[i - 1]]
        moved = moved[:-1] if len(moved) > 1 and moved[0] == moved[-1] else moved
        put = {}
        for q in b:
            if q in moved:
                continue
            best = None
            for k, (p, n) in enumerate(zip(moved, [*moved[1:], moved[0]], strict=True)):
                d2 = math.dist(p, n) ** 2
                t = ((q[0] - p[0]) * (n[0] - p[0]) + (q[1] - p[1]) * (n[1] - p[1])) / max(d2, 1e-12)
                off = math.dist(q, (p[0] + t * (n[0] - p[0]), p[1] + t * (n[1] - p[1])))
                if 0 < t < 1 and off < tol and (best is None or off < best[0]):
                    best = (off, k, t)
            if best:
                put.setdefault(best[1], []).append((best[2], q))
        assert got == [x for k, p in enumerate(moved) for x in (p, *[q for _, q in sorted(put.get(k, ()))])]


def plain_distances(mask):
    off = np.argwhere(~mask)
    return {tuple(p): np.hypot(*(off - p).T).min() for p in np.argwhere(mask)}


@pytest.mark.parametrize("density", [0.3, 0.9, 0.995])
def test_distances_in_slabs(density):
    mask = np.array([[rng.random() < density for _ in range(61)] for _ in range(45)])
    mask[3, 5] = False
    got = np.concatenate([d for _, d in R.squared_distances(mask, 7)])
    assert all(math.isclose(math.sqrt(got[p]), d) for p, d in plain_distances(mask).items()) and (got[~mask] == 0).all()
    y, x, d = R.farthest(mask)
    assert math.isclose(d, max(plain_distances(mask).values())) and math.isclose(math.sqrt(got[y, x]), d)


def test_a_large_mask_takes_bounded_memory():
    import tracemalloc

    y, x = np.mgrid[-2500:2500, -2500:2500]
    mask = (x * x + y * y < 2400**2) & (x * x + y * y > 200**2)
    del x, y
    tracemalloc.start()
    _, _, d = R.farthest(mask)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(d - 1100) < 1.5 and used < 300e6


def test_gaps_of_boundaries():
    a = [star(n, 20.0, 30 + 9 * i, 40) for i, n in enumerate((3, 5, 5, 9, 40))]
    b = [star(n, 15.0, 60, 40 + 8 * i) for i, n in enumerate((4, 7, 7, 3, 55))]
    pts = lambda r: np.concatenate([np.linspace(p, q, 300) for p, q in zip(r, [*r[1:], r[0]], strict=True)])
    for g, p, q in zip(R.boundary_gaps(a, b), a, b, strict=True):
        near = min(np.hypot(*(pts(q) - x).T).min() for x in pts(p))
        assert near - 0.35 <= g <= near + 1e-9
    assert np.isnan(R.boundary_gaps([[]], [SQUARE])[0]) and R.boundary_gaps([SQUARE], [[(2, 2), (4, 2), (4, 4)]])[0] == 2


def line_pixels(a, b):
    """An integer line, step by step with an error term, from the left end."""
    (x, y), (ex, ey) = sorted((a, b), key=lambda p: p[0]) if a[0] != b[0] else (a, b)
    dx, dy, up = ex - x, abs(ey - y), 1 if ey > y else -1
    steep, out = dy > dx, []
    long, short = (dy, dx) if steep else (dx, dy)
    err = long - 2 * short
    for _ in range(long + 1):
        out.append((x, y))
        over = err < 0
        err += 2 * (long if over else 0) - 2 * short
        x, y = x + (over if steep else 1), y + (up if steep or over else 0)
    return out


def test_filling_draws_the_sides(spark):
    from paintgraph.operators import shapes

    r = random.Random(8)
    rings = [[(r.randint(0, 40), r.randint(0, 40)) for _ in range(r.choice((3, 4, 5, 8)))] for _ in range(40)]
    rings += [[(0, 0), (7, 0), (7, 3), (0, 3)], [(5, 5)], [(1, 1), (9, 4)], [(0, 0), (10, 5), (0, 5)], [(3, 3), (3, 9), (3, 5)]]
    z = spark.createDataFrame([(1, i, [{"x": x, "y": y} for x, y in ring]) for i, ring in enumerate(rings)] + [(1, 99, [])], "image_id long, zone_id long, polygon array<struct<x:bigint,y:bigint>>")
    got = {i: set() for i in range(len(rings))}
    for q in shapes.filled_runs(z).collect():
        assert not got[q.zone_id] & {(x, q.y) for x in range(q.x0 - 1, q.x1 + 2)}
        got[q.zone_id] |= {(x, q.y) for x in range(q.x0, q.x1 + 1)}
    for i, ring in enumerate(rings):
        want = {p for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) for p in line_pixels(a, b)}
        want |= {(x, y) for x in range(41) for y in range(41) if R.contains(ring, x, y)}
        mask, x0, y0 = R.filled(ring)
        assert got[i] == want == {(int(x) + x0, int(y) + y0) for y, x in np.argwhere(mask)}, ring


def test_poles_and_label_places_of_many_rings():
    g = np.random.default_rng(5)
    many = [g.uniform(-20, 60, 2) + g.normal(0, g.uniform(0, 30), (int(g.integers(0, 11)), 2)) for _ in range(400)]
    many += [np.round(r) for r in many[:200]] + [g.normal(0, 300, (7, 2)), np.array(BENT, float), np.zeros((0, 2))]
    places = R.label_places(np.concatenate(many), np.array([len(r) for r in many]))
    for r, (x, y, own, *found) in zip(many, places, strict=True):
        assert tuple(found) == R.pole(r)
        if len(np.unique(r[:, 1])) > 1:
            assert (x, y) == R.inner_point(r) and (own > 0 or len(r) < 3 or not R.contains(r, x, y))
    assert R.poles(np.zeros((0, 2)), np.zeros(0, np.int64)).shape == (0, 3)


def test_poles_are_dealt_out(spark):
    from paintgraph.operators import layout, shapes

    box = "array(struct(0D AS x, 0D AS y), struct(30D AS x, 0D AS y), struct(30D AS x, 20D AS y), struct(0D AS x, 20D AS y))"
    z = spark.range(0, 400, 1, 1).selectExpr("id div 200 AS image_id", "id AS zone_id", "0L AS x0", "0L AS y0", "30L AS w", "20L AS h", "600L AS area_px", "7 AS num", f"{box} AS polygon")
    for found in (shapes.with_pole(z, "polygon", "p"), layout.ring_placements(z)):
        tasks = found.select(F.spark_partition_id().alias("t")).distinct().count()
        assert found.count() == 400 and tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.p.d for r in shapes.with_pole(z, "polygon", "p").collect()} == {11.0}


def test_border_scores_of_many_pairs(spark):
    from paintgraph.operators import graph

    g = np.random.default_rng(6)

    def box():
        x, y, w, h = g.integers((0, 0, 4, 4), (20, 20, 16, 16))
        return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)

    pairs = [(box(), box()) for _ in range(300)] + [(g.normal(0, 9, (int(n), 2)), g.normal(0, 9, (int(m), 2))) for n, m in g.integers(0, 9, (200, 2))] + [(g.normal(0, 50, (90, 2)), g.normal(0, 50, (90, 2)))]
    a, b = zip(*pairs, strict=True)
    got = R.border_scores(np.concatenate(a), np.array([len(r) for r in a]), np.concatenate(b), np.array([len(r) for r in b]))
    assert np.allclose(got, [R.border_score(p, q) for p, q in pairs], rtol=0, atol=1e-9) and (got > 0).sum() > 50
    z = spark.range(0, 300, 1, 1).selectExpr("1L AS image_id", "id AS zone_id", "id % 20 * 40 AS x0", "id div 20 * 40 AS y0", "40L AS w", "30L AS h")
    tasks = lambda deal: graph.candidates(z, deal=deal).select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks(True) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert graph.candidates(z, deal=True).count() == graph.candidates(z).count()


def test_overlays_of_many_jobs_equal_single_ones():
    from paintgraph.operators import overlay as O

    g = np.random.default_rng(8)
    rect = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)
    boxes = lambda n: [rect(*g.integers(0, 6, 2), *g.integers(1, 5, 2)) for _ in range(n)]
    first = [boxes(int(n)) for n in g.integers(0, 4, 60)] + [[g.normal(0, 20, (int(n), 2))] for n in g.integers(0, 9, 60)] + [[rect(0, 0, 9, 9), rect(3, 3, 3, 3)], [np.array(star(120))]]
    second = [boxes(int(n)) for n in g.integers(1, 3, 60)] + [[g.normal(5, 20, (7, 2))] for _ in range(60)] + [[rect(3, 4, 9, 1)], [np.array(star(120))]]
    lines = [np.array([(-3.0, y), (2.5, 3.1), (30.0, y + 2)]) for y in g.uniform(0, 6, len(first))]
    flat = lambda rings: (np.concatenate([np.zeros((0, 2)), *[r for q in rings for r in q]]), np.array([len(r) for q in rings for r in q], np.int64), np.repeat(np.arange(len(rings)), [len(q) for q in rings]))
    plain = lambda found: [[[tuple(map(tuple, np.asarray(r).tolist())) for r in p] for p in f] for f in found]
    n, a, b, c = len(first), flat(first), flat(second), flat([[line] for line in lines])
    assert plain(O.valid_many(*a, n)) == plain([O.valid(p) for p in first])
    assert plain(O.union_many(a, b, n)) == plain([O.union(p, q) for p, q in zip(first, second, strict=True)])
    assert plain(O.cut_many(a, c, n)) == plain([O.cut(p, line) for p, line in zip(first, lines, strict=True)])
    assert O.valid_many(np.zeros((0, 2)), np.zeros(0, np.int64), np.zeros(0, np.int64), 2) == [[], []]


def test_cut_zones_are_dealt_out(spark):
    from paintgraph.operators import shapes

    box = "array(struct(0L AS x, 0L AS y), struct(w AS x, 0L AS y), struct(w AS x, 40L AS y), struct(0L AS x, 40L AS y))"
    z = spark.range(0, 60, 1, 1).selectExpr("1L AS image_id", "id AS zone_id", "0L AS x0", "0L AS y0", "if(id % 3 = 0, 90L, 10L) AS w", "40L AS h").selectExpr("*", "w * h AS area_px", f"{box} AS polygon")
    cut = shapes.subdivide(z, 100, 1.2, 1.5)
    assert cut.where("source IS NOT NULL").select("was").distinct().count() == 20 and abs(cut.agg({"area_px": "sum"}).first()[0] - z.agg({"area_px": "sum"}).first()[0]) < 100


def test_holed_polygons_of_a_batch(spark):
    from paintgraph.operators import shapes

    ring = lambda x, w: f"array(struct({x}D AS x, {x}D AS y), struct({x + w}D AS x, {x}D AS y), struct({x + w}D AS x, {x + w}D AS y), struct({x}D AS x, {x + w}D AS y))"
    z = spark.range(0, 9, 1, 2).selectExpr("id", f"if(id % 3 = 0, NULL, array({ring(0, 12)}, {ring(4, 4)})) AS p", f"array({ring(10, 12)}) AS q", "array(struct(6D AS x, -1D AS y), struct(6D AS x, 99D AS y)) AS l")
    rows = z.select("id", shapes.polygon_area(F.get(shapes.repaired("p"), F.lit(0))).alias("a"), F.size(shapes.repaired("p")).alias("n"), F.size(shapes.merged("p", "q")).alias("u"), F.size(shapes.split("p", "l")).alias("c")).collect()
    assert sorted((r.id % 3 == 0, r.a, r.n, r.u, r.c) for r in rows) == sorted([(True, 0.0, 0, 1, 0)] * 3 + [(False, 128.0, 1, 1, 2)] * 6)


def test_label_pairs_without_edges_and_gaps_of_many(spark):
    from paintgraph.operators import graph, render
    from paintgraph.sources.views import zones

    g = np.random.default_rng(3)
    a, b = ([g.normal(0, 20, (int(n), 2)) for n in g.integers(0, 7, 200)] for _ in range(2))
    flat = lambda rings: (np.concatenate(rings), np.array([len(r) for r in rings]))
    one = [R.boundary_gaps([p], [q])[0] for p, q in zip(a, b, strict=True)]
    assert np.array_equal(R.gaps_of_many(*flat(a), *flat(b)), one, equal_nan=True)
    z = render.rings(zones(spark, "/root/testdata/sf0.001"))
    assert sorted(map(tuple, graph.inherit_labels(z, None, 450.0).collect())) == sorted(map(tuple, graph.inherit_labels(z, graph.ring_adjacency(z), 450.0).collect()))
    plan = graph.ring_adjacency(z)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "src" not in "".join(x for x in plan.splitlines() if "Exchange" in x)  # cells are dealt out, pairs aren't
