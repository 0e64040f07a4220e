"""Documents, edits and stored projects on small tables."""

import datetime
import json
import re

from pyspark.sql import functions as F

from paintgraph.functions import scalars as S
from paintgraph.operators import edits, layout, palette, raster, render, shapes

BOXES = "image_id long, zone_id long, x0 long, y0 long, w long, h long, area_px long, num long"


def boxes(spark, *rows):
    return render.rings(spark.createDataFrame([(i, z, x, y, w, h, w * h, n) for i, z, x, y, w, h, n in rows], BOXES))


def test_pdf_has_true_offsets(spark):
    z, page = boxes(spark, (1, 1, 10, 10, 200, 100, 3), (1, 2, 300, 50, 80, 80, 12)), layout.PAGES["Letter"]
    labels = layout.drawing_labels(z, layout.placements(z), 640, 480, *page)
    legend = layout.legend(z.select("image_id", "num").distinct(), *page).withColumn("hex", F.lit("#3F8F87"))
    (row,) = render.pdf_documents(render.drawing_commands(z, labels, 640, 480, *page), render.legend_commands(legend, page[1]), *page).collect()
    pdf = bytes(row.pdf)
    start = int(re.search(rb"startxref\n(\d+)", pdf)[1])
    assert pdf[start:].startswith(b"xref\n0 9")
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", pdf)]
    assert len(places) == 8 and all(pdf[p:].startswith(b"%d 0 obj" % (i + 1)) for i, p in enumerate(places))
    for length, body in re.findall(rb"/Length (\d+) >>\nstream\n(.*?)\nendstream", pdf, re.S):
        assert int(length) == len(body)
    assert b"(12) Tj" in pdf and b"(#3F8F87) Tj" in pdf


def test_features_are_json(spark):
    z = boxes(spark, (1, 1, 0, 0, 20, 10, 3), (1, 2, 30, 0, 20, 10, 4)).withColumn("suppress_label", F.col("zone_id") == 2)
    (row,) = render.feature_collections(z, 100, 50, "bw", detail_level=0.5).collect()
    doc = json.loads(row.geojson)
    assert doc["properties"] == {"width": 100, "height": 50, "mode": "bw", "zone_count": 2, "num_colors": None, "detail_level": 0.5}
    assert doc["features"][0]["geometry"]["coordinates"] == [[[0, 0], [20, 0], [20, 10], [0, 10], [0, 0]]]
    assert "suppress_label" not in doc["features"][0]["properties"] and doc["features"][1]["properties"]["suppress_label"] is True


def test_images_are_written_apart(spark, tmp_path):
    render.write_images(boxes(spark, (1, 1, 0, 0, 20, 10, 3), (2, 1, 30, 0, 20, 10, 4)), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("image_id=*")) == ["image_id=1", "image_id=2"]


def test_merges_of_bent_rings(spark):
    p = lambda *xy: [{"x": x, "y": y} for x, y in xy]
    bent, plug = p((0, 0), (20, 0), (20, 6), (8, 6), (8, 14), (20, 14), (20, 20), (0, 20)), p((8, 6), (20, 6), (20, 14), (8, 14))
    rows = [(1, 1, bent, 304.0, 0, 0, 20, 20, 1), (1, 2, plug, 96.0, 8, 6, 12, 8, 2), (1, 3, p((50, 50), (60, 50), (60, 60), (50, 60)), 100.0, 50, 50, 10, 10, 3)]
    z = spark.createDataFrame(rows, "image_id long, zone_id long, polygon array<struct<x:bigint,y:bigint>>, area_px double, x0 long, y0 long, w long, h long, num long")
    ask = lambda ids, keep=None: edits.merge_answers(z, spark.createDataFrame([(1, ids, keep)], "image_id long, ids array<bigint>, keep long"))
    good = ask([1, 2])
    (a,) = good.collect()
    assert (a.status, a.error, a.kept_from_id) == (200, None, 1)
    after = edits.merged_rings(z, good).orderBy("zone_id").collect()
    assert [(r.zone_id, r.was, r.area_px, r.num) for r in after] == [(1, 1, 400.0, 1), (2, 3, 100.0, 3)]
    assert [ask(i).first().error for i in ([1, 3], [1, 1], [1, 9], [1])] == [edits.NOT_CONTIGUOUS, edits.TWO_ZONES, edits.UNKNOWN_MERGE, edits.TWO_ZONES]


def test_merges_that_need_a_choice(spark):
    z = boxes(spark, (1, 1, 0, 0, 10, 10, 1), (1, 2, 10, 0, 9, 10, 2))
    ask = lambda keep: edits.merge_answers(z, spark.createDataFrame([(1, [1, 2], keep)], "image_id long, ids array<bigint>, keep long")).first()
    assert ask(None).requires_confirmation and ask(None).ring is None and not ask(2).requires_confirmation
    assert ask(2).kept_from_id == 2 and ask(7).error == edits.WRONG_CHOICE


def test_cuts_of_a_bent_ring(spark):
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    rows = [(1, 1, [{"x": x, "y": y} for x, y in ((0, 0), (20, 0), (20, 6), (8, 6), (8, 14), (20, 14), (20, 20), (0, 20))], 304.0, 0, 0, 20, 20, 1)]
    z = spark.createDataFrame(rows, "image_id long, zone_id long, polygon array<struct<x:bigint,y:bigint>>, area_px double, x0 long, y0 long, w long, h long, num long")
    ask = lambda line: edits.split_answers(z, spark.createDataFrame([(1, 1, line)], "image_id long, zone_id long, line array<struct<x:double,y:double>>"))
    assert ask(p((15, 0), (15, 20))).first().error == edits.MANY_CUTS and ask(p((-9, 0), (-9, 5))).first().error == edits.NO_CUT
    after = edits.split_rings(z, ask(p((4, 0), (4, 20)))).orderBy("zone_id").collect()
    assert [(r.zone_id, r.area_px, r.num) for r in after] == [(1, 224.0, 1), (2, 80.0, 1)]


def test_labels_of_a_bent_ring_go_to_its_pole(spark):
    p = [{"x": x, "y": y} for x, y in ((0, 0), (100, 0), (100, 8), (60, 8), (60, 60), (0, 60))]
    z = spark.createDataFrame([(1, 1, p, 3920, 0, 0, 100, 60, 7)], "image_id long, zone_id long, polygon array<struct<x:bigint,y:bigint>>, area_px long, x0 long, y0 long, w long, h long, num long")
    (r,) = layout.ring_placements(z).collect()
    assert r.method in ("representative_point", "pole_of_inaccessibility") and r.clearance_px >= r.required_radius_px
    thin = [{"x": x, "y": y} for x, y in ((0, 0), (200, 0), (200, 4), (4, 4), (4, 200), (0, 200))]
    z = spark.createDataFrame([(1, 1, thin, 1584, 0, 0, 200, 200, 7)], z.schema)
    assert layout.ring_placements(z).first().method.startswith("pole_of_inaccessibility_")


def test_fragments_join_their_parents_pieces(spark):
    rows = [(1, 1, 0, 0, 40, 20, 1), (1, 2, 40, 0, 2, 20, 1), (1, 3, 42, 0, 50, 20, 1), (1, 4, 300, 0, 2, 20, 1)]
    z = boxes(spark, *rows).withColumns({"source": F.lit("lineart_curved_subzone"), "parent": F.when(F.col("zone_id") < 4, "9").otherwise("8"), "area_px": F.col("area_px").cast("double")})
    after = shapes.merge_fragments(z, 90).orderBy("zone_id").collect()
    assert [(r.zone_id, r.was, r.area_px, r.source) for r in after] == [(1, 1, 800.0, "lineart_curved_subzone"), (2, 2, 1040.0, "lineart_curved_subzone"), (3, 4, 40.0, shapes.UNMERGED)]


def test_filled_runs_are_the_kernels_pixels(spark):
    from paintgraph.operators.rings import filled

    p = [(0, 0), (30, 5), (25, 22), (12, 9), (3, 28)]
    z = spark.createDataFrame([(1, 1, [{"x": x, "y": y} for x, y in p])], "image_id long, zone_id long, polygon array<struct<x:bigint,y:bigint>>")
    mask, x0, y0 = filled(p)
    got = {(x, r.y) for r in shapes.filled_runs(z).collect() for x in range(r.x0, r.x1 + 1)}
    assert got == {(int(x) + x0, int(y) + y0) for y, x in zip(*mask.nonzero(), strict=True)}


def test_duplicates_are_decided_in_order(spark):
    z = spark.createDataFrame([(1, i, 100 - i) for i in range(1, 6)], "image_id long, zone_id long, area_px long")
    pairs = spark.createDataFrame([(1, 1, 2, 0), (1, 2, 3, 0), (1, 3, 4, 0), (1, 1, 4, 0)], "image_id long, first long, second long, shared long")
    assert sorted(r.zone_id for r in raster.suppress_duplicates(z, pairs).collect()) == [1, 3, 5]


def test_colour_numbers_use_all_of_them(spark):
    rows = [(1, i, 100 + i, (i * 37) % 256, (i * 11) % 256, (i * 91) % 256) for i in range(1, 30)] + [(2, 1, 5, 9, 9, 9), (2, 2, 9, 9, 9, 9)]
    z = spark.createDataFrame(rows, "image_id long, zone_id long, area_px long, l8 long, a8 long, b8 long")
    got = palette.zone_numbers(z.union(spark.createDataFrame([(3, 1, 5, None, None, None)], z.schema)), 6).collect()
    assert len(got) == 32 and {r.num for r in got if r.image_id == 1} == set(range(1, 7))
    assert {r.num for r in got if r.image_id == 2} == {1, 2} and [r.num for r in got if r.image_id == 3] == [1]


def test_saved_palettes_and_times(spark, tmp_path):
    at = F.lit(datetime.datetime(2024, 5, 6, 7, 8, 9)).cast("timestamp")
    p = spark.createDataFrame([("a", " Sol ", 3, {"1": "#000000"}), ("b", "  ", 3, {"1": "#000000"}), ("c", "x", 31, None)], "palette_id string, name string, num_colors int, colors map<string,string>")
    for _ in range(2):
        edits.append_palettes(p, str(tmp_path / "p"), at)
    got = spark.read.parquet(str(tmp_path / "p")).collect()
    assert [(r.name, r.num_zones, r.colors_json) for r in got] == [("Sol", 3, '{"1":"#000000"}')] * 2 and got[0].created_at == "2024-05-06T07:08:09.000Z"


def test_slow_runs_can_be_an_error(spark):
    import pytest

    runs = spark.createDataFrame([(1, 9.5), (2, 10.0)], "run long, seconds double")
    assert [r.run for r in edits.slow_runs(runs).collect()] == [2]
    with pytest.raises(Exception, match="a run took"):
        edits.slow_runs(runs, fail=True).collect()


def test_parameters_of_a_page(spark):
    want = {0.0: (655, 39, 5, 0.0050), 0.5: (374, 30, 5, 0.0034), 1.0: (92, 30, 3, 0.0018)}
    for detail, (low, part, kernel, epsilon) in want.items():
        p = S.line_params(F.lit(512), F.lit(512), F.lit(detail))
        r = spark.range(1).select(*[p[k].alias(k) for k in ("min_area_px", "component_min_area_px", "close_kernel", "epsilon_ratio")]).first()
        assert (r[0], r[1], r[2]) == (low, part, kernel) and abs(r[3] - epsilon) < 1e-9


def test_kernels():
    assert raster.ellipse(1) == [1, 0] and raster.ellipse(2) == [2, 2, 0]
    w = raster.gaussian(35)
    assert len(w) == 18 and abs(w[0] + 2 * sum(w[1:]) - 1) < 1e-12


def png(path, w, h, pixel):
    import struct
    import zlib

    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(w)) for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b""))


def test_picture_files_become_pixels(spark, tmp_path):
    from paintgraph.sources import views

    for name in ("a.png", "b.PNG"):
        png(tmp_path / name, 3, 2, lambda x, y: (10 * x, 20 * y, 7))
    (tmp_path / "c.txt").write_text("no picture")
    images = views.image_files(spark, [str(tmp_path / n) for n in ("a.png", "b.PNG", "c.txt")])
    assert images.count() == 2 and {(r.width, r.height, r.n_channels) for r in images.collect()} == {(3, 2, 3)}
    got = {(r.x, r.y): (r.b, r.g, r.r) for r in views.image_pixels(images.where("image_id LIKE '%a.png'")).collect()}
    assert got == {(x, y): (7, 20 * y, 10 * x) for x in range(3) for y in range(2)}


def test_pieces_of_parents_across_batches(spark):
    from paintgraph.operators import shapes

    ring = "array(struct(x0 AS x, 0L AS y), struct(x0 + w AS x, 0L AS y), struct(x0 + w AS x, h AS y), struct(x0 AS x, h AS y))"
    p = spark.range(0, 400, 1, 1).selectExpr("1L AS image_id", "id AS zone_id", "id div 4 AS g", "id % 4 AS k").selectExpr("image_id", "zone_id", "if(k = 0, 0L, k * 10 - 8) AS x0", "0L AS y0", "if(k = 0, 2L, 10L) AS w", "20L AS h", "7L AS num", "CAST(g AS STRING) AS parent")
    z = p.selectExpr("*", "CAST(w * h AS DOUBLE) AS area_px", f"{ring} AS polygon", "'lineart_curved_subzone' AS source")
    merged = shapes.merge_fragments(z, 90)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = merged.collect()
        stages = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == 300 and sorted({(r.area_px, r.w) for r in found}) == [(200.0, 10), (240.0, 12)] and sum(r.area_px for r in found) == 400 * 160
    assert "FlatMapGroupsInPandas" not in stages  # not a call for each parent
