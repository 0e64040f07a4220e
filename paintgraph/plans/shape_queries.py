"""Queries over rings and rasters of zones: filled runs, contours, interior points, poles, unions, cuts, fragments. On
boxes, the general operators have closed forms, which are the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars as S
from ..operators import contours, edits, graph, layout, lineart, palette, patches, raster, render, shapes
from ..sources.views import PIXELS, ZONES, pixels, zones
from .pixel_queries import _NEXT, ZONE_ROUNDS, _lloyd_sql, _window
from .zone_queries import _E, _PLACED, _ROWN, LABEL_MIN, N
from .zone_queries import SQL as _ZONE_SQL

QUERIES: dict = {}
SQL: dict = {}
_Z = f"z AS {ZONES}"
_P = f"p AS {PIXELS}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rings(spark, d):
    return render.rings(zones(spark, d))


@query(_ZONE_SQL["zone_adjacency"])
def ring_adjacency(spark, d):
    return graph.ring_adjacency(_rings(spark, d))


@query(_ZONE_SQL["label_inheritance"])
def ring_label_inheritance(spark, d):
    z = _rings(spark, d)
    return graph.inherit_labels(z, None, LABEL_MIN)


@query(f"WITH {_Z} SELECT image_id, zone_id, y, x0, x0+w AS x1 FROM z, range(0, 600) r(i), LATERAL (SELECT y0+i AS y) WHERE i<=h")
def filled_runs(spark, d):
    return shapes.filled_runs(_rings(spark, d))


@query(f"WITH {_Z} SELECT image_id, zone_id, CAST(w+1 AS BIGINT) AS x_corners, CAST((w+1)*(h+1) AS BIGINT) AS pixels FROM z")
def filled_pixels(spark, d):
    """Pixels of filled rings, and the length of their longest run."""
    r = shapes.filled_runs(_rings(spark, d))
    n = F.col("x1") - F.col("x0") + 1
    return r.groupBy("image_id", "zone_id").agg(F.max(n).alias("x_corners"), F.sum(n).alias("pixels"))


@query(f"WITH {_Z}, {_P} SELECT z.image_id, z.zone_id, CAST(floor(avg(b)) AS BIGINT) AS b, CAST(floor(avg(g)) AS BIGINT) AS g, CAST(floor(avg(r)) AS BIGINT) AS r, count(*) AS n FROM p JOIN z ON z.image_id=p.image_id AND x>=x0 AND x<=x0+w AND y>=y0 AND y<=y0+h GROUP BY 1, 2")
def polygon_mean_color(spark, d):
    return raster.mean_colours(pixels(spark, d), shapes.filled_runs(_rings(spark, d)))


@query(f"WITH {_Z} SELECT image_id, zone_id, x0+w/2.0 AS x, y0+h/2.0 AS y FROM z")
def interior_point(spark, d):
    return _rings(spark, d).select("image_id", "zone_id", shapes.interior_point("polygon").alias("p")).select("image_id", "zone_id", "p.x", "p.y")


@query(f"WITH {_Z} SELECT image_id, zone_id, least(w,h)/2.0>=3+zone_id%20 AS fits FROM z")
def label_fits(spark, d):
    x, y = F.col("x0") + F.col("w") / 2, F.col("y0") + F.col("h") / 2
    return _rings(spark, d).select("image_id", "zone_id", shapes.fits("polygon", x, y, 3 + F.col("zone_id") % 20).alias("fits"))


@query(f"WITH {_Z} SELECT image_id, zone_id, CAST(least(w,h)//2+1 AS DOUBLE) AS distance FROM z")
def pole_distance(spark, d):
    return shapes.with_pole(_rings(spark, d), "polygon", "p").select("image_id", "zone_id", F.col("p.d").alias("distance"))


def _bent(spark, d):
    """Zones without the lower right quarter of their box."""
    at = lambda x, y: F.struct((F.col("x0") + x).alias("x"), (F.col("y0") + y).alias("y"))
    w, h, zero = F.col("w"), F.col("h"), F.lit(0).cast("long")
    half = lambda c: F.floor(c / 2)
    return zones(spark, d).withColumn("polygon", F.array(at(zero, zero), at(w, zero), at(w, half(h)), at(half(w), half(h)), at(half(w), h), at(zero, h)))


@query(
    f"WITH {_Z}, c AS (SELECT image_id, zone_id, w, x, CASE WHEN x<0 OR x>w THEN -1 WHEN x<=w//2 THEN h ELSE h//2 END AS b FROM z, range(-1, 60) r(x) WHERE x<=w+1), d AS (SELECT image_id, zone_id, x, y, CASE WHEN y>b THEN 0 ELSE least(y+1, b-y+1) END AS d FROM c, range(0, 60) r(y) WHERE y<=40+8), "
    "n AS (SELECT a.image_id, a.zone_id, a.x, a.y, min((a.x-b.x)*(a.x-b.x)+b.d*b.d) AS q FROM d a JOIN d b ON a.image_id=b.image_id AND a.zone_id=b.zone_id AND a.y=b.y WHERE a.d>0 GROUP BY 1, 2, 3, 4) SELECT image_id, zone_id, sqrt(max(q)) AS distance FROM n GROUP BY 1, 2"
)
def bent_pole_distance(spark, d):
    """Distance of the poles of bent rings, to the nearest pixel outside in any direction."""
    return shapes.with_pole(_bent(spark, d), "polygon", "p").select("image_id", "zone_id", F.col("p.d").alias("distance"))


def _holed(spark, d):
    """Zones as polygons with a hole of a third of each side, and a bar through the middle of the hole that reaches out to the right."""
    def box(x, y, w, h):
        at = lambda i, j: F.struct((x + i).cast("double").alias("x"), (y + j).cast("double").alias("y"))
        zero = F.lit(0)
        return F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, h))

    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    hw, hh = F.floor(w / 3), F.floor(h / 3)
    z = zones(spark, d).withColumn("holed", F.array(box(x, y, w, h), box(x + hw, y + hh, hw, hh)))
    return z.withColumn("bar", F.array(box(x + hw, y + hh + 1, w, F.lit(1)))).withColumn("line", F.array(*[F.struct((x + F.floor(hw / 2)).cast("double").alias("x"), (y + j).cast("double").alias("y")) for j in (F.lit(-1), h + 1)]))


@query(
    f"WITH {_Z}, a AS (SELECT *, w//3 AS hw, h//3 AS hh FROM z) SELECT image_id, zone_id, CAST(w*h-hw*hh AS DOUBLE) AS area, 1 AS parts, 1 AS holes, CAST(w*h-hw*hh+hw+hw AS DOUBLE) AS union_area, 1 AS union_parts, CASE WHEN hh>2 THEN 2 ELSE 1 END AS union_holes, "
    "CASE WHEN hw//2>0 THEN 2 ELSE 1 END AS pieces, CAST(w*h-hw*hh-(hw//2)*h AS DOUBLE) AS largest_piece, 1 AS largest_holes FROM a"
)
def holed_overlays(spark, d):
    """Repair, union and cuts of polygons with holes: areas without the holes, and how many holes are left."""
    z = scratch.dealt(_holed(spark, d), "image_id", "zone_id").withColumns({"r": shapes.repaired("holed"), "u": shapes.merged("holed", "bar"), "c": shapes.split("holed", "line")})
    first = lambda c: F.get(c, F.lit(0))
    area = lambda c: F.round(shapes.polygon_area(first(c)), 6)
    return z.select("image_id", "zone_id", area("r").alias("area"), F.size("r").alias("parts"), (F.size(first("r")) - 1).alias("holes"), area("u").alias("union_area"), F.size("u").alias("union_parts"), (F.size(first("u")) - 1).alias("union_holes"), F.size("c").alias("pieces"), area("c").alias("largest_piece"), (F.size(first("c")) - 1).alias("largest_holes"))


@query(f"WITH {_Z}, {_PLACED} SELECT image_id, zone_id, method, clearance_px FROM p WHERE method='representative_point'")
def ring_labels(spark, d):
    """Labels that fit at the interior point; the others go to the pole, whose pixel distances have no short SQL."""
    z = _rings(spark, d).where(~S.label_too_small("area_px", "w", "h", F.lit(LABEL_MIN)))
    return layout.ring_placements(z).where("method = 'representative_point'").select("image_id", "zone_id", "method", "clearance_px")


_POLES = (
    f"f AS (SELECT *, greatest(5.0, least(28.0, sqrt(area_px)*0.28, w*0.55, h*0.55)) AS f, least(w,h)/2.0 AS c, least(w,h)//2+1.0 AS pole FROM z WHERE NOT (area_px<{LABEL_MIN} OR least(w,h)<14)), k AS (SELECT f.*, g AS step, greatest(3.5, f*power(0.9, g)) AS s FROM f, range(0, 21) r(g)), q AS (SELECT *, greatest(2.0, sqrt(power(length(CAST(num AS VARCHAR))*s*0.31, 2)+power(s*0.48, 2))) AS rad FROM k), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY image_id, zone_id ORDER BY CASE WHEN pole+0.001>=rad THEN step ELSE 100-step END) AS rn, first_value(rad) OVER (PARTITION BY image_id, zone_id ORDER BY step) AS whole FROM q), "
    "p AS (SELECT image_id, zone_id, c>=whole AS first, step, round(CASE WHEN c>=whole THEN c ELSE pole END, 3) AS clearance_px, round(CASE WHEN c>=whole THEN whole ELSE rad END, 3) AS required_radius_px FROM b WHERE rn=1)"
)


@query(f"WITH {_Z}, {_POLES} SELECT image_id, count(*) AS placement_count, count(*) FILTER (first) AS representative_point_count, count(*) FILTER (NOT first) AS pole_of_inaccessibility_count, count(*) FILTER (NOT first AND step>0 AND clearance_px+0.001>=required_radius_px) AS reduced_font_count, count(*) FILTER (clearance_px+0.001<required_radius_px) AS tight_label_count, round(min(clearance_px), 3) AS min_clearance_px, round(min(clearance_px/required_radius_px), 3) AS min_clearance_ratio FROM p GROUP BY 1")
def ring_label_methods(spark, d):
    z = _rings(spark, d).where(~S.label_too_small("area_px", "w", "h", F.lit(LABEL_MIN)))
    return layout.placement_metrics(layout.ring_placements(z))


_SCALE = "((595.2755905511812-72)/640)"


@query(
    f"WITH {_Z}, {_PLACED}, s AS (SELECT p.*, z.w, z.h, CAST(z.num AS VARCHAR) AS text, least(p.font_size*{_SCALE}, 18.0, greatest(4.0, z.h*{_SCALE}*0.85)) AS f, greatest(4.0, z.w*{_SCALE}*0.85) AS room FROM p JOIN z USING (image_id, zone_id)), t AS (SELECT *, greatest(3.5, CASE WHEN length(text)*0.556*f>room THEN f*room/(length(text)*0.556*f) ELSE f END) AS font FROM s) "
    f"SELECT image_id, zone_id, text, round(font, 6) AS font, round((595.2755905511812-640*{_SCALE})/2+x*{_SCALE}, 6) AS px, round((841.8897637795277-480*{_SCALE})/2+(480-y)*{_SCALE}-font*0.32, 6) AS py FROM t"
)
def drawing_labels(spark, d):
    z = zones(spark, d)
    placed = layout.placements(z.where(~S.label_too_small("area_px", "w", "h", F.lit(LABEL_MIN))))
    return layout.drawing_labels(z, placed, 640, 480, *layout.PAGES["A4"])


@query()
def pdf_document(spark, d):
    z, page = _rings(spark, d), layout.PAGES["A4"]
    labels = layout.drawing_labels(z, layout.placements(z.where(~S.label_too_small("area_px", "w", "h", F.lit(LABEL_MIN)))), 640, 480, *page)
    entries = layout.legend(z.select("image_id", "num").distinct(), *page).withColumn("hex", F.lit(S.GRAY))
    return render.pdf_documents(render.drawing_commands(z, labels, 640, 480, *page), render.legend_commands(entries, page[1]), *page)


def _cells(spark, d):
    """Coarse masks, so that components have an area: squares of eight pixels that hold a dark one."""
    p = pixels(spark, d).where("b < 128").selectExpr("image_id", "x div 8 AS cx", "y div 8 AS cy").distinct()
    at = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return at.selectExpr("image_id", "cy*8+i AS y", "cx*8 AS x0", "cx*8+7 AS x1")


_CELLS = "k AS (SELECT DISTINCT image_id, x//8 AS cx, y//8 AS cy FROM p WHERE b<128), e AS (SELECT a.image_id, a.cx, a.cy, b.cx AS ox, b.cy AS oy FROM k a JOIN k b ON a.image_id=b.image_id AND abs(a.cx-b.cx)<=1 AND abs(a.cy-b.cy)<=1)"
_FLOOD = f"WITH RECURSIVE {_P}, {_CELLS}, r(image_id, cx, cy, root) AS (SELECT image_id, cx, cy, cy*100+cx FROM k UNION SELECT e.image_id, e.ox, e.oy, r.root FROM r JOIN e USING (image_id, cx, cy) WHERE r.root < e.oy*100+e.ox), c AS (SELECT image_id, cx, cy, min(root) AS root FROM r GROUP BY 1, 2, 3)"


@query(f"{_FLOOD} SELECT image_id, min(cx)*8 AS x0, min(cy)*8 AS y0, (max(cx)-min(cx)+1)*8 AS w, (max(cy)-min(cy)+1)*8 AS h, count(*)*64 AS area FROM c GROUP BY image_id, root")
def mask_components(spark, d):
    s = raster.component_stats(raster.run_components(raster.merged_runs(_cells(spark, d))))
    return s.select("image_id", F.col("x").alias("x0"), F.col("y").alias("y0"), "w", "h", "area")


@query(f"{_FLOOD}, o AS (SELECT image_id, root, min(cx)*8 AS x0, min(cy)*8 AS y0, (max(cx)-min(cx)+1)*8 AS w, (max(cy)-min(cy)+1)*8 AS h, count(*) AS n FROM c GROUP BY 1, 2) SELECT image_id, x0, y0, w, h, (w-1.0)*(h-1.0) AS area_px FROM o WHERE w*h=n*64 AND n*64<=64*64*0.92")
def lineart_zones(spark, d):
    """Zones of coarse masks; those that fill their box, whose contour has the area (w-1) * (h-1), are compared."""
    labelled = raster.run_components(raster.merged_runs(_cells(spark, d)))
    z = shapes.lineart_zones(labelled, 20, 64 * 64 * 0.92, 0.0034)
    full = raster.component_stats(labelled).where("w * h = area").select("image_id", "component")
    return z.join(full, ["image_id", "component"], "left_semi").select("image_id", "x0", "y0", "w", "h", "area_px")


@query()
def lineart_all_zones(spark, d):
    z = shapes.lineart_zones(raster.run_components(raster.merged_runs(_cells(spark, d))), 20, 64 * 64 * 0.92, 0.0034)
    return z.select("image_id", "zone_id", "area_px", "x0", "y0", "w", "h", S.svg_path("polygon").alias("path"))


_RUNS_OF = "q AS (SELECT image_id, y, x, x-row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM {}), r AS MATERIALIZED (SELECT image_id, y, min(x) AS x0, max(x) AS x1, y*100000+min(x) AS node FROM q GROUP BY image_id, y, g)"
#: Sides of pixels (x, y) of components, with the corners they run between; what follows each; the walk round each component.
_WALK = (
    "h AS (SELECT image_id, component, x, y, unnest([0, 1, 2, 3]) AS h FROM px), f AS MATERIALIZED (SELECT h.*, (h.y*100000+h.x)*4+h.h AS id, h.x+CAST(h.h IN (2, 3) AS INT) AS vx, h.y+CAST(h.h IN (1, 2) AS INT) AS vy, h.x+CAST(h.h IN (1, 2) AS INT) AS wx, h.y+CAST(h.h IN (0, 1) AS INT) AS wy FROM h ANTI JOIN px n ON n.image_id=h.image_id AND n.x=h.x+[-1, 0, 1, 0][h.h+1] AND n.y=h.y+[0, 1, 0, -1][h.h+1]), "
    "s AS MATERIALIZED (SELECT a.image_id, a.id, b.id AS nxt FROM f a JOIN f b ON a.image_id=b.image_id AND a.component=b.component AND a.wx=b.vx AND a.wy=b.vy QUALIFY row_number() OVER (PARTITION BY a.image_id, a.id ORDER BY b.h<>(a.h+3)%4)=1), "
    "k(image_id, component, id, pos, head) AS (SELECT image_id, component, min(id), 0, min(id) FROM f GROUP BY 1, 2 UNION ALL SELECT k.image_id, k.component, s.nxt, pos+1, head FROM k JOIN s USING (image_id, id) WHERE s.nxt<>head), "
    "a0 AS (SELECT k.image_id, k.component, pos, f.x, f.y FROM k JOIN f USING (image_id, id)), a1 AS (SELECT *, coalesce(lag(x) OVER w, last_value(x) OVER v) AS px, coalesce(lag(y) OVER w, last_value(y) OVER v) AS py FROM a0 WINDOW w AS (PARTITION BY image_id, component ORDER BY pos), v AS (PARTITION BY image_id, component ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), "
    "a2 AS (SELECT *, x-px AS dx, y-py AS dy FROM a1 WHERE x<>px OR y<>py), a3 AS (SELECT *, coalesce(lag(dx) OVER w, last_value(dx) OVER v) AS ox, coalesce(lag(dy) OVER w, last_value(dy) OVER v) AS oy FROM a2 WINDOW w AS (PARTITION BY image_id, component ORDER BY pos), v AS (PARTITION BY image_id, component ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), "
    "a4 AS (SELECT image_id, component, abs(sum(px*y-x*py))/2.0 AS area, count(*) FILTER (dx<>ox OR dy<>oy) AS corners FROM a3 GROUP BY 1, 2), m AS (SELECT image_id, component, coalesce(area, 0.0) AS area, coalesce(corners, 1) AS corners FROM (SELECT DISTINCT image_id, component FROM px) LEFT JOIN a4 USING (image_id, component))"
)


def _named(component):
    """Components as row * 100000 + column of their first pixel, on pages that are not so wide."""
    return (F.floor(component / raster.ROW) * 100_000 + component % raster.ROW).alias("component")


@query(f"WITH RECURSIVE {_P}, {_RUNS_OF.format('p')}, {_NEXT}, c AS (SELECT image_id, node, min(root) AS component FROM w GROUP BY 1, 2), px AS MATERIALIZED (SELECT image_id, c.component, x0+i AS x, y FROM (SELECT *, unnest(range(0, x1-x0+1)) AS i FROM r) JOIN c USING (image_id, node)), {_WALK} SELECT * FROM m")
def contour_measures(spark, d):
    """Area and corners of the outer contour of every component of whole pages."""
    labelled = raster.run_components(raster.runs(pixels(spark, d)))
    keys = ["image_id", "component"]
    m = contours.measures(*contours.moves(labelled, keys), keys)
    return m.select("image_id", _named(F.col("component")), F.col("area").cast("double").alias("area"), "corners")


def _drawn(spark, d):
    """Whole pages of `pixels` as drawings: squares of four pixels that hold a dark one are black."""
    cell = pixels(spark, d).where("b < 110").selectExpr("image_id", "x div 4 AS cx", "y div 4 AS cy").distinct()
    at = cell.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return at.selectExpr("image_id", "cx * 4 + i AS x", "cy * 4 + j AS y", "0L AS v")


#: The same pages, their median, lines, components and contours; the threshold's mean is a weighted sum over rows, then columns.
def _lineart_sql(select: str) -> str:
    w = raster.gaussian(S.BLOCK_SIZE)
    weights = "[" + ", ".join(f"{x!r}::DOUBLE" for x in w) + "]"
    r = len(w) - 1

    def blur(source: str, value: str, name: str, out: str, along: str, across: str) -> str:
        return f"{name} AS MATERIALIZED (SELECT a.image_id, a.{across}, t.g AS {along}, sum(a.{value}::DOUBLE*({weights})[abs(t.g-t.o)+1]) AS {out} FROM (SELECT g, o, greatest(0, least(63, o)) AS at FROM range(0, 64) p(g), range(-{r}, {64 + r}) q(o) WHERE abs(g-o)<={r}) t JOIN {source} a ON a.{along}=t.at GROUP BY ALL)"

    def cross(step: str, source: str, name: str) -> str:
        return f"{name}0 AS (SELECT *, {step}(v) {_window('y', 'x', 1)} AS m1 FROM {source}), {name} AS (SELECT image_id, x, y, {'greatest' if step == 'max' else 'least'}({step}(v) {_window('x', 'y', 1)}, m1) AS v FROM {name}0)"

    return (
        f"WITH RECURSIVE {_P}, dk AS (SELECT DISTINCT image_id, x//4 AS cx, y//4 AS cy FROM p WHERE b<110), pg AS (SELECT i.image_id, x, y, CASE WHEN dk.cx IS NULL THEN 255 ELSE 0 END AS v FROM (SELECT DISTINCT image_id FROM dk) i, range(0, 64) t(x), range(0, 64) u(y) LEFT JOIN dk ON dk.image_id=i.image_id AND dk.cx=t.x//4 AND dk.cy=u.y//4), "
        f"md AS MATERIALIZED (SELECT image_id, x, y, CASE WHEN sum(CASE WHEN v=0 THEN 1 ELSE 0 END)>=5 THEN 0 ELSE 255 END AS v FROM (SELECT image_id, t.x AS x, u.y AS y, pg.v FROM range(0, 64) t(x), range(0, 64) u(y), range(-1, 2) a(dx), range(-1, 2) b(dy), pg WHERE pg.x=greatest(0, least(63, t.x+dx)) AND pg.y=greatest(0, least(63, u.y+dy))) GROUP BY 1, 2, 3), "
        f"{blur('md', 'v', 'b0', 'm0', 'x', 'y')}, {blur('b0', 'm0', 'b1', 'm', 'y', 'x')}, v AS (SELECT md.image_id, md.x, md.y, CASE WHEN md.v<=round_even(round(m, 6), 0)-{S.BLOCK_C} THEN 255 ELSE 0 END AS v FROM md JOIN b1 USING (image_id, x, y)), "
        f"{cross('max', 'v', 'ca')}, {cross('min', 'ca', 'cb')}, ln AS MATERIALIZED (SELECT image_id, x, y, CASE WHEN x IN (0, 63) OR y IN (0, 63) THEN 255 ELSE v END AS v FROM cb), pp AS (SELECT image_id, x, y FROM ln WHERE v=0), {_RUNS_OF.format('pp')}, {_NEXT}, c AS (SELECT image_id, node, min(root) AS component FROM w GROUP BY 1, 2), px AS MATERIALIZED (SELECT image_id, c.component, x0+i AS x, y FROM (SELECT *, unnest(range(0, x1-x0+1)) AS i FROM r) JOIN c USING (image_id, node)), {_WALK} {select}"
    )


@query(_lineart_sql("SELECT m.image_id, m.component, CAST(n AS BIGINT) AS pixels, m.area, m.corners, n>=30 AND n<=64*64*0.92 AND area>=30 AS kept FROM m JOIN (SELECT image_id, component, count(*) AS n FROM px GROUP BY 1, 2) s ON s.image_id=m.image_id AND s.component=m.component"))
def lineart_components(spark, d):
    """Whole pages through median, threshold, closing, frame, components and contours: pixels, area and corners of each
    component, and whether it passes the gates."""
    p = lineart.params(spark, 64, 64, 1.0)
    labelled = lineart.paper(lineart.lines(lineart.pages(_drawn(spark, d), 64, 64), p))
    keys = ["image_id", "component"]
    m = contours.measures(*contours.moves(labelled, keys), keys).join(raster.component_stats(labelled).select(*keys, F.col("area").alias("pixels")), keys)
    kept = F.col("pixels").between(p.component_min_area, p.max_area) & (F.col("area") >= p.component_min_area)
    return m.select("image_id", _named(F.col("component")), "pixels", F.col("area").cast("double").alias("area"), "corners", kept.alias("kept"))


@query()
def lineart_sheet(spark, d):
    """Whole pages to numbered zones with labels: what a user of the line-art mode gets, a row a zone."""
    s = lineart.sheet(_drawn(spark, d), 64, 64, 1.0, N)
    placed = s.labels.select("image_id", "zone_id", F.round("x", 3).alias("label_x"), F.round("y", 3).alias("label_y"), "method")
    return s.zones.join(placed, ["image_id", "zone_id"], "left").select("image_id", "zone_id", "num", "area_px", "source", "parent", "suppress_label", "label_x", "label_y", "method", S.svg_path("polygon").alias("path"))


@query(_lineart_sql("SELECT i.image_id, CAST((SELECT count(*) FROM ln WHERE ln.image_id=i.image_id AND v<>0) AS BIGINT) AS line_pixels, CAST((SELECT count(*) FROM m WHERE m.image_id=i.image_id) AS BIGINT) AS raw_components, CAST((SELECT count(*) FROM m JOIN (SELECT image_id, component, count(*) AS n FROM px GROUP BY 1, 2) s ON s.image_id=m.image_id AND s.component=m.component WHERE m.image_id=i.image_id AND n BETWEEN 30 AND 64*64*0.92 AND area>=30) AS BIGINT) AS pre_subdivision_zones, true AS pieces_add_up, true AS numbers_differ FROM (SELECT DISTINCT image_id FROM ln) i"))
def lineart_metrics(spark, d):
    """Counts of the steps by image, and what must hold after them: zones are those found, less the cut ones, plus their
    pieces, less merges; neighbours share numbers no more often than nine colours force."""
    m = lineart.sheet(_drawn(spark, d), 64, 64, 1.0, N).metrics
    adds_up = F.col("zones") == F.col("pre_subdivision_zones") - F.col("subdivided_zones") + F.col("created_zones") - F.col("fragment_merges")
    return m.select("image_id", "line_pixels", "raw_components", "pre_subdivision_zones", adds_up.alias("pieces_add_up"), (F.col("collisions") == 0).alias("numbers_differ"))


@query()
def mask_zones(spark, d):
    c = _cells(spark, d)
    twice = c.withColumn("mask", F.lit(0).cast("long")).union(c.where("x0 < 56").selectExpr("image_id", "y", "x0", "x1", "CAST(1 AS BIGINT)"))
    m = raster.merged_runs(twice, ["image_id", "mask"])
    return shapes.mask_zones(m, 64, 64, min_area=40).select("image_id", "zone_id", "mask_index", "area_px", S.svg_path("polygon").alias("path"))


@query(f"WITH {_P}, v AS (SELECT image_id, x, y, b AS v FROM p) SELECT image_id, x2 AS x, y2 AS y, v FROM (SELECT v.image_id, t.x AS x2, u.y AS y2, v.v FROM v, range(0, 96) t(x), range(0, 40) u(y) WHERE v.x=floor(t.x*64/96) AND v.y=floor(u.y*64/40))")
def mask_resize(spark, d):
    return raster.resize_mask(pixels(spark, d).select("image_id", "x", "y", F.col("b").alias("v")), 64, 64, 96, 40)


@query(f"WITH {_P}, v AS (SELECT image_id, x, y, 255-CAST(round_even((114*b+587*g+299*r)/1000.0::DOUBLE, 0) AS BIGINT) AS v FROM p) SELECT image_id, x, y, v FROM v")
def invert_mask(spark, d):
    return raster.invert(raster.gray_pixels(pixels(spark, d)))


@query(f"WITH {_P} SELECT image_id, count(*) FILTER (b%2<>0) AS line_pixels FROM p GROUP BY 1")
def line_pixels(spark, d):
    return raster.line_pixels(pixels(spark, d).select("image_id", F.expr("CAST((b % 2) * 255 AS BIGINT)").alias("v")))


@query(f"WITH {_Z}, {_P} SELECT z.image_id, z.zone_id, p.x, p.y, p.b FROM z JOIN p ON z.image_id=p.image_id AND p.x BETWEEN x0-3 AND x0+w+2 AND p.y BETWEEN y0-3 AND y0+h+2")
def crop_pixels(spark, d):
    return raster.crop(pixels(spark, d), zones(spark, d)).select("image_id", "zone_id", "x", "y", "b")


@query(
    f"WITH {_P}, s AS (SELECT image_id, b, g, r, i, j, (least(x+1, (i+1)*1.6::DOUBLE)-greatest(x, i*1.6::DOUBLE))*(least(y+1, (j+1)*1.6::DOUBLE)-greatest(y, j*1.6::DOUBLE)) AS w FROM p, range(0, 40) t(i), range(0, 40) u(j) WHERE least(x+1, (i+1)*1.6::DOUBLE)-greatest(x, i*1.6::DOUBLE)>1e-9 AND least(y+1, (j+1)*1.6::DOUBLE)-greatest(y, j*1.6::DOUBLE)>1e-9) "
    "SELECT image_id, i AS x, j AS y, CAST(round_even(round(sum(b*w)/sum(w), 6), 0) AS BIGINT) AS b, CAST(round_even(round(sum(g*w)/sum(w), 6), 0) AS BIGINT) AS g, CAST(round_even(round(sum(r*w)/sum(w), 6), 0) AS BIGINT) AS r FROM s GROUP BY image_id, i, j"
)
def area_shrink(spark, d):
    return raster.area_shrink(pixels(spark, d), 64, 64, 40)


_FIRST = f"o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY src, dst)=1)"
_TOUCH = "t AS (SELECT o.image_id, o.src, o.dst, a.area_px AS area1, b.area_px AS area2, a.num AS num1, b.num AS num2, least(a.x0+a.w,b.x0+b.w)-greatest(a.x0,b.x0) AS rx, least(a.y0+a.h,b.y0+b.h)-greatest(a.y0,b.y0) AS ry, greatest(0, rx) AS ox, greatest(0, ry) AS oy FROM o JOIN z a ON a.image_id=o.image_id AND a.zone_id=o.src JOIN z b ON b.image_id=o.image_id AND b.zone_id=o.dst)"


def _requests(spark, d):
    """One merge an image: its first pair of neighbours; every fifth image asks for the same zone twice, every seventh for an unknown one."""
    from pyspark.sql import Window

    e = graph.adjacency(zones(spark, d)).withColumn("r", F.row_number().over(Window.partitionBy("image_id").orderBy("src", "dst"))).where("r = 1")
    second = F.when(F.col("image_id") % 5 == 0, F.col("src")).when(F.col("image_id") % 7 == 0, F.lit(-1)).otherwise(F.col("dst"))
    return e.select("image_id", F.array("src", second).alias("ids"), F.when(F.col("image_id") % 2 == 0, F.col("dst")).alias("keep"))


_ANSWERS = f"m AS (SELECT *, least(rx, ry)>=0 AND greatest(rx, ry)>0 AS meets, num1<>num2 AND abs(area1-area2)/CAST(greatest(area1,area2) AS DOUBLE)<0.2 AS asks FROM t), n AS (SELECT *, CASE WHEN image_id%5=0 THEN '{edits.TWO_ZONES}' WHEN image_id%7=0 THEN '{edits.UNKNOWN_MERGE}' WHEN NOT meets THEN '{edits.NOT_CONTIGUOUS}' END AS error FROM m), r AS (SELECT image_id, src, dst, CASE WHEN error IS NULL THEN 200 ELSE 400 END AS status, error, error IS NULL AND asks AND image_id%2<>0 AS requires_confirmation, CASE WHEN error IS NULL THEN CASE WHEN NOT asks THEN CASE WHEN area1>=area2 THEN src ELSE dst END WHEN image_id%2=0 THEN dst END END AS kept_from_id, CASE WHEN error IS NULL AND (NOT asks OR image_id%2=0) THEN CAST(area1+area2-ox*oy AS DOUBLE) END AS area FROM n)"


@query(f"WITH {_Z}, {_E}, {_FIRST}, {_TOUCH}, {_ANSWERS} SELECT image_id, status, error, requires_confirmation, kept_from_id, area FROM r")
def merge_answers(spark, d):
    a = edits.merge_answers(_rings(spark, d), _requests(spark, d))
    return a.select("image_id", "status", "error", "requires_confirmation", "kept_from_id", F.round(shapes.ring_area(F.col("ring")), 6).alias("area"))


@query(
    f"WITH {_Z}, {_E}, {_FIRST}, {_TOUCH}, {_ANSWERS}, d AS (SELECT * FROM r WHERE area IS NOT NULL), u AS (SELECT z.image_id, z.zone_id AS was, CAST(z.area_px AS BIGINT) AS area_px, z.num FROM z LEFT JOIN d USING (image_id) WHERE d.src IS NULL OR z.zone_id NOT IN (d.src, d.dst) UNION ALL SELECT d.image_id, least(d.src, d.dst), CAST(d.area AS BIGINT), z.num FROM d JOIN z ON z.image_id=d.image_id AND z.zone_id=d.kept_from_id) "
    f"SELECT image_id, {_ROWN.format('was')} AS zone_id, was, area_px, num FROM u"
)
def merged_rings(spark, d):
    z = _rings(spark, d)
    m = edits.merged_rings(z, edits.merge_answers(z, _requests(spark, d)))
    return m.select("image_id", "zone_id", "was", "area_px", "num")


def _cut_requests(spark, d):
    """An upright line through a zone; some miss it, some have one point, some two equal ones, some ask for an unknown zone."""
    x = F.when(F.col("zone_id") % 6 == 1, F.col("x0") + F.col("w") + 4).otherwise(F.col("x0") + F.floor(F.col("w") / 3)).cast("double")
    p = lambda y: F.struct(x.alias("x"), y.cast("double").alias("y"))
    top = p(F.col("y0"))
    line = F.when(F.col("zone_id") % 6 == 2, F.array(top)).when(F.col("zone_id") % 6 == 3, F.array(top, top)).otherwise(F.array(top, p(F.col("y0") + F.col("h"))))
    return zones(spark, d).select("image_id", F.when(F.col("zone_id") % 6 == 4, -F.col("zone_id")).otherwise(F.col("zone_id")).alias("zone_id"), line.alias("line"))


@query(
    f"WITH {_Z}, c AS (SELECT *, CASE WHEN zone_id%6=4 THEN '{edits.UNKNOWN_SPLIT}' WHEN zone_id%6=2 THEN '{edits.SHORT_LINE}' WHEN zone_id%6=3 THEN '{edits.SAME_POINTS}' WHEN zone_id%6=1 THEN '{edits.NO_CUT}' END AS error FROM z) "
    "SELECT image_id, CASE WHEN zone_id%6=4 THEN -zone_id ELSE zone_id END AS zone_id, CASE WHEN error IS NULL THEN 200 ELSE 400 END AS status, error, CASE WHEN error IS NULL THEN CAST((w-w//3)*h AS DOUBLE) END AS kept_area, CASE WHEN error IS NULL THEN CAST((w//3)*h AS DOUBLE) END AS new_area FROM c"
)
def split_answers(spark, d):
    a = edits.split_answers(_rings(spark, d), _cut_requests(spark, d))
    return a.select("image_id", "zone_id", "status", "error", *[F.round(shapes.ring_area(F.col(r)), 6).alias(n) for r, n in (("kept_ring", "kept_area"), ("new_ring", "new_area"))])


@query(
    f"WITH {_Z}, c AS (SELECT image_id, min(zone_id) AS cut FROM z WHERE zone_id%6 IN (0, 5) GROUP BY 1), j AS (SELECT z.*, coalesce(zone_id=cut, false) AS hit FROM z LEFT JOIN c USING (image_id)), u AS (SELECT image_id, zone_id AS was, 0 AS last, CAST(CASE WHEN hit THEN (w-w//3)*h ELSE area_px END AS BIGINT) AS area_px, num FROM j UNION ALL SELECT image_id, zone_id, 1, CAST((w//3)*h AS BIGINT), num FROM j WHERE hit) "
    f"SELECT image_id, {_ROWN.format('last, was')} AS zone_id, CASE WHEN last=0 THEN was END AS was, area_px, num FROM u"
)
def split_rings(spark, d):
    z = _rings(spark, d)
    first = _cut_requests(spark, d).where("zone_id % 6 IN (0, 5)").groupBy("image_id").agg(F.min_by(F.struct("zone_id", "line"), "zone_id").alias("r")).select("image_id", "r.*")
    return edits.split_rings(z, edits.split_answers(z, first)).select("image_id", "zone_id", "was", "area_px", "num")


@query(f"WITH {_Z} SELECT image_id, zone_id, 2 AS parts, round((w*h/4.0)::DOUBLE, 6) AS largest FROM z")
def valid_parts(spark, d):
    """Rings that cross themselves like a bow tie fall into two triangles."""
    r = F.col("polygon")
    tie = scratch.dealt(_rings(spark, d), "image_id", "zone_id").withColumn("polygon", F.array(*[F.get(r, F.lit(i)) for i in (0, 2, 1, 3)]))
    return tie.withColumn("p", shapes.parts("polygon")).select("image_id", "zone_id", F.size("p").alias("parts"), F.round(shapes.ring_area(F.get("p", F.lit(0))), 6).alias("largest"))


@query()
def border_scores(spark, d):
    near = graph.candidates(_rings(spark, d), 2, deal=True).select("a.image_id", F.col("a.zone_id").alias("src"), F.col("b.zone_id").alias("dst"), F.col("a.polygon").alias("p"), F.col("b.polygon").alias("q"))
    return near.select("image_id", "src", "dst", F.round(shapes.border_score("p", "q"), 4).alias("score"))


def _pieces(spark, d):
    """Boxes cut upright into four strips, of which the first is a fragment; strips know their parent."""
    z = zones(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    at = lambda k: F.col("x0") + F.when(k == 0, 0).when(k == 1, 2).otherwise(2 + F.floor((F.col("w") - 2) * (k - 1) / 3)).cast("long")
    z = z.select("image_id", (F.col("zone_id") * 4 + F.col("k")).cast("long").alias("zone_id"), at(F.col("k")).alias("x0"), "y0", F.when(F.col("k") == 3, F.col("x0") + F.col("w")).otherwise(at(F.col("k") + 1)).alias("x1"), "h", "num", F.col("zone_id").cast("string").alias("parent"))
    z = z.withColumn("w", F.col("x1") - F.col("x0")).withColumns({"area_px": (F.col("w") * F.col("h")).cast("double"), "source": F.lit("lineart_curved_subzone")}).drop("x1")
    return render.rings(z)


_PIECES = "s AS (SELECT image_id, zone_id AS parent, num, x0, y0, w, h, [0, 2, 2+(w-2)//3, 2+(w-2)*2//3, w] AS c FROM z), g AS (SELECT image_id, parent, num, parent*4+k AS zone_id, k, x0+c[k+1] AS x0, y0, c[k+2]-c[k+1] AS w, h FROM s, range(0, 4) r(k))"


@query(f"WITH {_Z}, {_PIECES} SELECT image_id, zone_id, CAST(w*h AS DOUBLE) AS area FROM g WHERE w*h<90")
def small_fragments(spark, d):
    return _pieces(spark, d).where(shapes.is_small_fragment(90)).select("image_id", "zone_id", F.col("area_px").alias("area"))


@query(f"WITH {_Z}, {_PIECES}, b AS (SELECT a.image_id, a.zone_id, b.w*b.h AS area, b.zone_id AS other, a.h AS border FROM g a JOIN g b ON a.image_id=b.image_id AND a.parent=b.parent AND abs(a.k-b.k)=1 WHERE a.w*a.h<90 UNION ALL SELECT a.image_id, a.zone_id, b.w*b.h, b.zone_id, 0 FROM g a JOIN g b ON a.image_id=b.image_id AND a.parent=b.parent AND false) SELECT image_id, zone_id, string_agg(other, ',' ORDER BY area DESC, border DESC, other DESC) AS neighbours FROM b GROUP BY 1, 2")
def fragment_neighbours(spark, d):
    n = shapes.fragment_neighbours(_pieces(spark, d), 90, 0.5)
    return n.select("image_id", "zone_id", F.array_join(F.transform("neighbours", lambda x: x["zone_id"].cast("string")), ",").alias("neighbours"))


@query()
def merged_fragments(spark, d):
    before = _pieces(spark, d)
    after = shapes.merge_fragments(before, 90)
    return after.select("image_id", "zone_id", "was", "area_px", "source", "parent", S.svg_path("polygon").alias("path"))


@query()
def fragment_metrics(spark, d):
    before = _pieces(spark, d)
    m = shapes.fragment_metrics(before, shapes.merge_fragments(before, 90), 90)
    return m.select("image_id", "merges", "unmerged", F.size("details").alias("details"))


@query(f"WITH {_Z}, m AS (SELECT image_id, median(area_px) AS m FROM z GROUP BY 1) SELECT image_id, round(greatest(100.0, m)*1.2::DOUBLE, 6) AS target, round(greatest(greatest(100.0, m)*1.2::DOUBLE*1.5::DOUBLE, 300.0), 6) AS threshold FROM m")
def subdivision_targets(spark, d):
    t = shapes.targets(_rings(spark, d), 100, 1.2, 1.5)
    return t.select("image_id", F.round("target", 6).alias("target"), F.round("threshold", 6).alias("threshold"))


@query()
def subdivided_zones(spark, d):
    s = shapes.subdivide(_rings(spark, d), 100, 1.2, 1.5)
    return s.select("image_id", "zone_id", "was", "area_px", "source", "parent", S.svg_path("polygon").alias("path"))


@query()
def subdivision_metrics(spark, d):
    z = _rings(spark, d)
    return shapes.subdivision_metrics(z, shapes.subdivide(z, 100, 1.2, 1.5))


_MEANS = "c AS (SELECT z.image_id, z.zone_id, z.area_px, CAST(floor(avg(b)) AS BIGINT) AS b, CAST(floor(avg(g)) AS BIGINT) AS g, CAST(floor(avg(r)) AS BIGINT) AS r FROM p JOIN z ON z.image_id=p.image_id AND x>=x0 AND x<=x0+w AND y>=y0 AND y<=y0+h GROUP BY 1, 2, 3)"


@query(
    f"WITH {_Z}, {_P}, {_MEANS}, {_lloyd_sql('SELECT image_id, zone_id AS id, b AS x, g AS y, r AS z, 1 AS weight FROM c', N, ZONE_ROUNDS)}, a AS (SELECT l.image_id, l.id AS zone_id, l.c, c.area_px FROM (SELECT s0.image_id, id, arg_min(c, (round((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz), 6), c)) AS c FROM s0 JOIN c{ZONE_ROUNDS} USING (image_id) GROUP BY 1, 2) l JOIN c ON c.image_id=l.image_id AND c.zone_id=l.id), "
    "t AS (SELECT image_id, c, row_number() OVER (PARTITION BY image_id ORDER BY sum(area_px) DESC, c) AS num FROM a GROUP BY 1, 2), r AS (SELECT a.image_id, a.zone_id, a.area_px, t.num FROM a JOIN t USING (image_id, c)), "
    f"k AS (SELECT *, least({N}, count(*) OVER (PARTITION BY image_id)) AS top FROM r), s AS (SELECT *, row_number() OVER (PARTITION BY image_id, num ORDER BY area_px, zone_id DESC) AS q FROM k WHERE num<=top), d AS (SELECT image_id, zone_id, row_number() OVER (PARTITION BY image_id ORDER BY area_px DESC, zone_id) AS i FROM s WHERE q>1), "
    f"w AS (SELECT DISTINCT image_id, g AS num FROM k, range(1, {N + 1}) x(g) WHERE g<=top), m AS (SELECT image_id, num AS new, row_number() OVER (PARTITION BY image_id ORDER BY num) AS i FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.image_id=w.image_id AND r.num=w.num)), "
    "v AS (SELECT d.image_id, d.zone_id, m.new FROM d JOIN m USING (image_id, i)) SELECT r.image_id, r.zone_id, CAST(coalesce(v.new, r.num) AS BIGINT) AS num FROM r LEFT JOIN v USING (image_id, zone_id) "
    f"UNION ALL SELECT image_id, zone_id, CAST((row_number() OVER (PARTITION BY image_id ORDER BY zone_id)-1)%{N}+1 AS BIGINT) FROM z WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.image_id=z.image_id AND c.zone_id=z.zone_id)"
)
def zone_numbers(spark, d):
    """Numbers from mean colours; the SQL clusters the channels themselves, whose distances need no colour space."""
    z = _rings(spark, d)
    m = raster.mean_colours(pixels(spark, d), shapes.filled_runs(z)).drop("n")
    known = z.select("image_id", "zone_id", "area_px").join(m, ["image_id", "zone_id"], "left").withColumnsRenamed({"b": "l8", "g": "a8", "r": "b8"})
    return palette.zone_numbers(known, N, ZONE_ROUNDS)


@query()
def zone_lab_numbers(spark, d):
    z = _rings(spark, d)
    m = raster.mean_colours(pixels(spark, d), shapes.filled_runs(z))
    lab = m.select("image_id", "zone_id", *[c.alias(n) for n, c in zip(("l8", "a8", "b8"), S.lab8("b", "g", "r"), strict=True)])
    return palette.zone_numbers(z.select("image_id", "zone_id", "area_px").join(lab, ["image_id", "zone_id"], "left"), N, ZONE_ROUNDS)


@query(f"WITH RECURSIVE {_Z}, {_E}, t AS (SELECT image_id, src AS zone_id, dst AS other FROM e UNION ALL SELECT image_id, dst, src FROM e), r(image_id, zone_id, root) AS (SELECT image_id, zone_id, zone_id FROM z UNION SELECT t.image_id, t.other, r.root FROM r JOIN t ON t.image_id=r.image_id AND t.zone_id=r.zone_id WHERE r.root < t.other), c AS (SELECT image_id, zone_id, min(root) AS component FROM r GROUP BY 1, 2), n AS (SELECT image_id, component, count(*) AS n FROM c GROUP BY 1, 2), s AS (SELECT image_id, count(*) AS components, max(n) AS largest FROM n GROUP BY 1), g AS (SELECT image_id, count(*) AS edges FROM e GROUP BY 1), i AS (SELECT image_id, count(*) AS isolated FROM z WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.image_id=z.image_id AND t.zone_id=z.zone_id) GROUP BY 1) SELECT s.image_id, coalesce(edges, 0) AS edges, coalesce(isolated, 0) AS isolated, components, largest FROM s LEFT JOIN g USING (image_id) LEFT JOIN i USING (image_id)")
def graph_metrics(spark, d):
    z = zones(spark, d)
    return graph.graph_metrics(z, graph.adjacency(z))


@query(f"SELECT i.image_id, CAST(count(*) FILTER (suppressed) AS BIGINT) AS suppressed_labels, CAST(count(*) FILTER (suppressed AND i.num<>z.num) AS BIGINT) AS inherited_labels, CAST(count(*) FILTER (NOT suppressed) AS BIGINT) AS visible_labels FROM ({_ZONE_SQL['label_inheritance']}) i JOIN {ZONES} z ON z.image_id=i.image_id AND z.zone_id=i.zone_id GROUP BY 1")
def label_metrics(spark, d):
    z = zones(spark, d)
    return graph.label_metrics(z, graph.inherit_labels(z, graph.adjacency(z), LABEL_MIN))


_K = "o AS (SELECT dx, dy FROM range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE abs(dy)<2 OR dx=0)"


def _spread_sql(source: str, name: str, least: int) -> str:
    return f"{name} AS (SELECT image_id, x+dx AS x, y+dy AS y FROM {source}, o GROUP BY ALL HAVING count(*)>={least})"


@query(f"WITH {_P}, {_K}, m AS (SELECT image_id, x, y FROM p WHERE b<128), w AS (SELECT image_id, x, y FROM p WHERE g<200), {_spread_sql('m', 'a', 1)}, {_spread_sql('a', 'b', 17)}, {_spread_sql('b', 'c', 17)}, {_spread_sql('c', 'd', 1)} SELECT d.image_id, d.x, d.y FROM d SEMI JOIN w ON d.image_id=w.image_id AND d.x=w.x AND d.y=w.y")
def smoothed_mask(spark, d):
    p = pixels(spark, d)
    return raster.smoothed(p.where("b < 128"), p.where("g < 200"), ["image_id"])


def _page(spark, d):
    """Whole drawn pages of `pixels` as colours, and a zone for each: the box of its drawing."""
    drawn = _drawn(spark, d)
    p = lineart.pages(drawn, 64, 64).select("image_id", "x", "y", *[F.col("v").alias(k) for k in "bgr"])
    low, high = (lambda k: F.min(k)), (lambda k: F.max(k))
    z = drawn.groupBy("image_id").agg(low("x").alias("x0"), low("y").alias("y0"), (high("x") - low("x")).alias("w"), (high("y") - low("y")).alias("h"))
    return p, render.rings(z.withColumns({"zone_id": F.col("image_id") + 7, "area_px": F.col("w") * F.col("h"), "num": F.lit(1).cast("long")}))


@query()
def superpixels(spark, d):
    p, z = _page(spark, d)
    s = shapes.superpixels(p, z, 300.0, 7.0, 100.0, 0.0034)
    return s.select("image_id", "zone_id", "piece", "area_px", "source", S.svg_path("polygon").alias("path"))


@query()
def zone_noise(spark, d):
    p, z = _page(spark, d)
    n = shapes.noise(raster.crop(p, z, 0).select("image_id", "zone_id", "x", "y"))
    return n.groupBy("image_id", "zone_id").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.min("noise"), 6).alias("low"), F.round(F.max("noise"), 6).alias("high"))


PATCH_AREA, PATCH_COMPACT = 300.0, 7.0
_PATCH_POINTS = f"""pt AS (SELECT z.image_id, z.zone_id, p.x, p.y, round(b/255.0, 6) AS f1, round(g/255.0, 6) AS f2, round(r/255.0, 6) AS f3,
 greatest(2, least(CAST(round_even(z.area_px/{PATCH_AREA}, 0) AS INT), {S.MAX_SEGMENTS})) AS parts, sqrt(z.area_px/greatest(2, least(CAST(round_even(z.area_px/{PATCH_AREA}, 0) AS INT), {S.MAX_SEGMENTS}))) AS step
 FROM p JOIN z ON z.image_id=p.image_id AND x>=x0 AND x<=x0+w AND y>=y0 AND y<=y0+h),
 cl AS (SELECT *, floor((x-min(x) OVER q)/step) AS cx, floor((y-min(y) OVER q)/step) AS cy FROM pt WINDOW q AS (PARTITION BY image_id, zone_id)),
 st AS (SELECT image_id, zone_id, cy, cx, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(f1), 6) AS f1, round(avg(f2), 6) AS f2, round(avg(f3), 6) AS f3, any_value(step) AS step, any_value(parts) AS parts FROM cl GROUP BY 1, 2, 3, 4),
 ce AS (SELECT *, row_number() OVER (PARTITION BY image_id, zone_id ORDER BY n DESC, cy, cx)-1 AS c FROM st QUALIFY c<parts),
 ch AS (SELECT pt.image_id, pt.zone_id, pt.x, pt.y, pt.f1, pt.f2, pt.f3, arg_min(ce.c, (round(((pt.x-ce.x)*(pt.x-ce.x)+(pt.y-ce.y)*(pt.y-ce.y))/(pt.step*pt.step)+((pt.f1-ce.f1)*(pt.f1-ce.f1)+(pt.f2-ce.f2)*(pt.f2-ce.f2)+(pt.f3-ce.f3)*(pt.f3-ce.f3))/{PATCH_COMPACT**2}, 6), ce.c)) AS c
 FROM pt JOIN ce ON ce.image_id=pt.image_id AND ce.zone_id=pt.zone_id AND abs(pt.x-ce.x)<=2*pt.step AND abs(pt.y-ce.y)<=2*pt.step GROUP BY ALL)"""


def _patch_points(spark, d):
    """Pixels of `zones` with their three channels as features."""
    z = _rings(spark, d)
    parts = patches.steps(z, PATCH_AREA, S.MAX_SEGMENTS)
    p = raster.crop(pixels(spark, d), z.withColumns({"w": F.col("w") + 1, "h": F.col("h") + 1}), 0).join(parts, ["image_id", "zone_id"])
    return p.select("image_id", "zone_id", "x", "y", "step", F.array(*[F.round(F.col(k) / 255.0, 6) for k in "bgr"]).alias("f")), parts


@query(f"WITH {_Z}, {_P}, {_PATCH_POINTS} SELECT image_id, zone_id, CAST(c AS BIGINT) AS c, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM ch GROUP BY 1, 2, 3")
def superpixel_round(spark, d):
    """One round of assignment: what each centre of each zone gets."""
    p, parts = _patch_points(spark, d)
    chosen = patches.assigned(p, patches.starts(p, parts, 3), PATCH_COMPACT).where("c IS NOT NULL")
    return chosen.groupBy("image_id", "zone_id", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))
