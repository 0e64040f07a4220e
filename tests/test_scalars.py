"""Hand-made cases of the scalar rules."""

from pyspark.sql import functions as F

from paintgraph.functions import scalars as S
from paintgraph.operators import edits, layout


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()[0]


def test_limits_at_three_details(spark):
    for detail, line, component, kernel, area, zones in ((0.0, 655, 39, 5, 3146, 35), (0.5, 374, 30, 5, 1730, 108), (1.0, 92, 30, 3, 315, 180)):
        p, c = S.line_params(F.lit(512.0), F.lit(512.0), F.lit(detail)), S.color_limits(F.lit(512.0), F.lit(512.0), F.lit(detail))
        got = spark.range(1).select(p["min_area_px"], p["component_min_area_px"], p["close_kernel"], c["min_area_px"], c["max_zones"]).first()
        assert tuple(got) == (line, component, kernel, area, zones)


def test_hex(spark):
    assert [one(spark, S.valid_hex(F.lit(v))) for v in ("#12g456", " #abcdef ", "", None)] == ["#B8B8B8", "#ABCDEF", "#B8B8B8", "#B8B8B8"]


def test_clamps(spark):
    assert [one(spark, S.detail_level(F.lit(v).cast("double"))) for v in (-1, 0.5, 2, None)] == [0, 0.5, 1, 0.5]
    assert [one(spark, S.num_colors(F.lit(a).cast("int"), F.lit(b).cast("int"))) for a, b in ((None, None), (40, 3), (None, 0))] == [12, 30, 1]


def test_merge_rules(spark):
    rows = [(1, 1, 2, 100, 1, 50, 2), (1, 1, 2, 100, 1, 81, 2), (1, 1, 2, 100, 1, 80, 2), (1, 1, 2, 100, 1, 99, 1), (1, 1, 2, 70, 3, 70, 3)]
    got = edits.merge_rules(spark.createDataFrame(rows, "image_id long, src long, dst long, area1 long, num1 long, area2 long, num2 long")).collect()
    assert [(r.needs_confirmation, r.kept_from_id) for r in got] == [(False, 1), (True, None), (False, 1), (False, 1), (False, 1)]


def test_split(spark):
    z = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 5, 3), (1, 2, 0, 0, 10, 10, 5, 50)], "image_id long, zone_id long, x0 long, y0 long, w long, h long, num long, cut_x long")
    got = {r.zone_id: r for r in edits.split_boxes(z).collect()}
    assert (got[1].kept_area, got[1].new_area, got[1].new_id, got[2].status) == (70, 30, 3, "not_split")


def test_label_shrinks(spark):
    font, step = layout.shrunk_font(F.lit(28.0), F.lit("1"), F.lit(10.0))
    f, k = spark.range(1).select(font, step).first()
    assert k == 5 and abs(f - 28 * 0.9**5) < 1e-9  # at step 4 the radius is 18.37 * hypot(0.31, 0.48) = 10.50


def test_base64(spark):
    from paintgraph.sources.views import decode_base64

    got = decode_base64(spark.createDataFrame([("data:image/png;base64,aGk=",), ("aGk=",), ("%%",)], "image_base64 string")).collect()
    assert [None if r.content is None else bytes(r.content) for r in got] == [b"hi", b"hi", None]
