"""The line-art path, starts of clusterings, and writes that happen once."""

import json
import math
import random

import numpy as np
import pytest

DRAWN = "image_id long, x long, y long, v long"


def drawing(image):
    """Strokes three pixels wide: a frame of cells, a diagonal, a box inside a cell."""
    dark = set()
    for k in range(0, 96, 31):
        dark |= {(x, y) for x in range(k, min(k + 3, 96)) for y in range(96)} | {(x, y) for x in range(96) for y in range(k, min(k + 3, 96))}
    dark |= {(i + d, i) for i in range(3, 31) for d in (-1, 0, 1)}
    dark |= {(x, y) for x in range(40, 56) for y in range(40, 56) if not (43 <= x < 53 and 43 <= y < 53)}
    return [(image, x, y, 0) for x, y in sorted(dark)]


@pytest.fixture(scope="module")
def sheet(spark):
    from paintgraph.operators import lineart

    rows = drawing(1) + [(2, 5, 5, 0)] + [(1, 500, 3, 0), (1, 10, 10, None)]
    return lineart.sheet(spark.createDataFrame(rows, DRAWN).repartition(4), 96, 96, 1.0, 5)


def test_sheet_from_pixels_to_labels(sheet):
    from paintgraph.operators import rings as R

    zones = {r.zone_id: r for r in sheet.zones.where("image_id = 1").collect()}
    found = sheet.found.where("image_id = 1").collect()
    assert len(found) >= 10 and sorted(zones) == list(range(1, len(zones) + 1))
    ring = lambda z: [(p.x, p.y) for p in zones[z].polygon]
    near = {(a, b) for a in zones for b in zones if a < b and R.boundary_gaps([ring(a)], [ring(b)])[0] <= 10}
    edges = {(r.src, r.dst) for r in sheet.edges.where("image_id = 1").collect()}
    assert edges == near and len(edges) > len(zones) / 2
    shown = {z for z in zones if not zones[z].suppress_label}
    assert all(zones[a].num != zones[b].num for a, b in edges if a in shown and b in shown)
    labels = {r.zone_id: r for r in sheet.labels.where("image_id = 1").collect()}
    assert set(labels) == shown and all(R.contains(ring(z), labels[z].x, labels[z].y) for z in labels)
    m = {r.image_id: r for r in sheet.metrics.collect()}
    assert set(m) == {1, 2} and m[1].zones == len(zones) == m[1].pre_subdivision_zones - m[1].subdivided_zones + m[1].created_zones - m[1].fragment_merges
    assert m[1].adjacency_edges == len(edges) and m[1].collisions == 0 and m[1].suppressed_labels == len(zones) - len(shown)


def test_components_of_the_sheet_are_those_of_a_flood(sheet):
    lines = {(r.x, r.y) for r in sheet.lines.where("image_id = 1 AND v = 255").collect()}
    todo, sizes = {(x, y) for x in range(96) for y in range(96)} - lines, []
    while todo:
        heap, n = [todo.pop()], 0
        while heap:
            x, y = heap.pop()
            n += 1
            for p in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if p in todo:
                    todo.discard(p)
                    heap.append(p)
        sizes.append(n)
    from paintgraph.operators import raster

    assert sorted(r.area for r in raster.component_stats(sheet.labelled.where("image_id = 1")).collect()) == sorted(sizes)


def test_nothing_drawn_gives_nothing(spark):
    from paintgraph.operators import lineart

    p = lineart.params(spark, 8, 8, 0.5)
    assert lineart.paper(lineart.lines(lineart.pages(spark.createDataFrame([], DRAWN), 8, 8), p)).count() == 0


def test_best_of_several_tries(spark):
    from paintgraph.operators import palette

    rng = random.Random(6)
    rows = [(i, 100 * i + n, rng.gauss(c, 3), rng.gauss(2 * c, 3), rng.gauss(-c, 3), rng.randint(1, 4)) for i in range(3) for n, c in enumerate(rng.choice([0, 20, 45, 90]) for _ in range(60))]
    rows += [(9, 900 + n, 1.0, 1.0, 1.0, 1) for n in range(5)]
    s = spark.createDataFrame(rows, "image_id long, id long, x double, y double, z double, weight long")
    starts = palette.plus_starts(s, 4, 3).collect()
    assert {(r.image_id, r.attempt): 0 for r in starts}.keys() == {(i, t) for i in (0, 1, 2, 9) for t in range(3)}
    assert sum(r.image_id == 9 for r in starts) == 3  # equal samples give one centre a try
    kept, centres, inertia = palette.best_of_tries(s, 4, 15, 3)
    of = {i: {r.attempt: r.inertia for r in inertia.where(f"image_id = {i}").collect()} for i in (0, 1, 2, 9)}
    at = {(r.image_id, r.c): (r.cx, r.cy, r.cz) for r in centres.collect()}
    got = dict.fromkeys(of, 0.0)
    for r in kept.collect():
        got[r.image_id] += r.weight * math.dist((r.x, r.y, r.z), at[r.image_id, r.c]) ** 2
        assert math.dist((r.x, r.y, r.z), at[r.image_id, r.c]) <= min(math.dist((r.x, r.y, r.z), p) for (i, _), p in at.items() if i == r.image_id) + 1e-3
    assert kept.count() == len(rows) and all(abs(got[i] - min(of[i].values())) < 0.01 and min(of[i].values()) <= of[i][-1] for i in of)


def test_draws_follow_weight_and_distance(spark):
    from paintgraph.operators import palette

    rows = [(i, n, float(n == 2) * 3 + float(n == 1), 0.0, 0.0, w) for i in range(1500) for n, w in ((0, 1), (1, 2), (2, 1))]
    s = spark.createDataFrame(rows, "image_id long, id long, x double, y double, z double, weight long")
    c = {(r.image_id, r.c): r.cx for r in palette.plus_starts(s, 2, 1).collect()}
    first = np.bincount([int(c[i, 0]) for i in range(1500)], minlength=4) / 1500
    assert abs(first[1] - 0.5) < 0.05 and abs(first[0] - 0.25) < 0.05
    second = [c[i, 1] for i in range(1500) if c[i, 0] == 0]  # 2 x 1 against 1 x 9
    assert abs(second.count(3.0) / len(second) - 9 / 11) < 0.07


def test_a_job_adds_its_rows_once(spark, tmp_path):
    from paintgraph.sources import committed as C

    path, df = str(tmp_path / "t"), spark.range(5)
    assert C.committed(spark, path, df.schema).count() == 0
    assert C.commit(df, path, "a") and not C.commit(df, path, "a") and C.commit(spark.range(2), path, "b")
    assert C.committed(spark, path, df.schema).count() == 7
    with pytest.raises(Exception, match="half way"):  # a job that fails after some of its tasks have written
        C.commit(spark.range(0, 40, 1, 4).selectExpr("IF(id = 35, CAST(raise_error('half way') AS BIGINT), id) AS id"), path, "c")
    df.write.parquet(f"{path}/data/c-left")  # and one that ended before its manifest
    assert C.committed(spark, path, df.schema).count() == 7
    assert C.commit(spark.range(3), path, "c") and C.committed(spark, path, df.schema).count() == 10
    assert C.vacuum(spark, path) and C.committed(spark, path, df.schema).count() == 10 and len(list((tmp_path / "t" / "data").iterdir())) == 3
    with pytest.raises(ValueError):
        C.commit(df, path, "../x")


def test_of_two_tries_at_once_one_counts(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from paintgraph.sources import committed as C

    path = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda n: C.commit(spark.range(100 + n), path, "same"), range(4)))
    assert sum(done) == 1 and C.committed(spark, path, spark.range(1).schema).count() == 100 + done.index(True)


def test_stored_palettes_and_results(spark, sheet, tmp_path):
    from pyspark.sql import functions as F

    from paintgraph.operators import edits, render
    from paintgraph.sources import committed as C

    p = spark.createDataFrame([("p", " Mia ", 3, {"1": "#112233"})], "palette_id string, name string, num_colors int, colors map<string,string>")
    for _ in range(2):
        edits.append_palettes(p, str(tmp_path / "p"), F.lit("2024-01-01").cast("timestamp"), job="save-1")
    assert [r.name for r in C.committed(spark, str(tmp_path / "p"), "palette_id string, name string").collect()] == ["Mia"]
    made = render.results(sheet.zones.select("image_id", "zone_id", "num", "polygon"), sheet.metrics, {"detail": 1.0, "mode": "bw"}, {"svg": "zones-{image_id}.svg"})
    assert render.write_results(made, str(tmp_path / "r"), "run") and not render.write_results(made, str(tmp_path / "r"), "run")
    got = {r.image_id: json.loads(r.value) for r in C.committed(spark, str(tmp_path / "r"), "value string, image_id long", "text").collect()}
    assert set(got) == {1, 2} and got[1]["parameters"] == {"detail": 1.0, "mode": "bw"} and got[1]["outputs"] == {"svg": "zones-1.svg"}
    assert [z["zone_id"] for z in got[1]["zones"]] == list(range(1, len(got[1]["zones"]) + 1)) and got[1]["metrics"]["zones"] == len(got[1]["zones"])
