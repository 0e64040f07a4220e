"""Queries over requests, projects, palettes and the small rules of the client, each with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import edits, graph, layout, numbering, palette, render
from ..sources import pictures, views
from ..sources.views import PIXELS, ZONES, palettes, pixels, projects, read, zones
from .zone_queries import _E, _PLACED, LABEL_MIN

QUERIES: dict = {}
SQL: dict = {}
_Z = f"z AS {ZONES}"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_NAMED = f"i AS (SELECT *, CASE WHEN zone_id%3<>0 THEN 'z'||zone_id END AS own, CASE WHEN zone_id%2=0 THEN zone_id END AS feature, CASE WHEN zone_id%4=0 THEN '' WHEN zone_id%4=1 THEN NULL ELSE CAST(num AS VARCHAR) END AS paint, row_number() OVER (PARTITION BY image_id ORDER BY zone_id)-1 AS pos FROM z)"


@query(f"WITH {_Z}, {_NAMED} SELECT image_id, pos, coalesce(own, CAST(feature AS VARCHAR), CAST(pos+1 AS VARCHAR)) AS id, coalesce(nullif(paint, ''), CAST(zone_id AS VARCHAR)) AS number FROM i")
def zone_names(spark, d):
    z = F.col("zone_id")
    own, feature = F.when(z % 3 != 0, F.concat(F.lit("z"), z.cast("string"))), F.when(z % 2 == 0, z)
    paint = F.when(z % 4 == 0, "").when(z % 4 == 1, None).otherwise(F.col("num").cast("string"))
    pos = F.row_number().over(Window.partitionBy("image_id").orderBy("zone_id")) - 1
    return zones(spark, d).withColumn("pos", pos.cast("long")).select("image_id", "pos", S.zone_key(own, feature, "pos").alias("id"), S.paint_number(paint, "zone_id").alias("number"))


_REQ = "q AS (SELECT event_id AS version, CASE event_id%5 WHEN 0 THEN 'color' WHEN 1 THEN 'bw' WHEN 2 THEN 'sepia' WHEN 3 THEN NULL ELSE 'color' END AS mode, CASE WHEN event_id%3=0 THEN NULL ELSE event_id%37 END AS num_colors, CASE WHEN event_id%4=0 THEN NULL ELSE (event_id%14)/10.0::DOUBLE END AS detail_level, CASE WHEN event_id%6=0 THEN event_id%300 END AS num_zones, event_id%3 AS min_zone_area_px FROM events)"


def _requests(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("version"))
    v = F.col("version")
    return e.select(
        "version", F.element_at(F.array(*[F.lit(x).cast("string") for x in ("color", "bw", "sepia", None, "color")]), (v % 5 + 1).cast("int")).alias("mode"),
        F.when(v % 3 != 0, v % 37).alias("num_colors"), F.when(v % 4 != 0, v % 14 / 10.0).alias("detail_level"), F.when(v % 6 == 0, v % 300).alias("num_zones"), (v % 3).alias("min_zone_area_px"),
    )


@query(
    f"WITH {_REQ} SELECT version, CAST(least(greatest(coalesce(num_colors, num_zones, 12), 1), 30) AS BIGINT) AS num_colors, greatest(0.0, least(coalesce(detail_level, 0.5), 1.0))::DOUBLE AS detail_level, CASE WHEN greatest(0.0, least(coalesce(detail_level, 0.5), 1.0))<0.34 THEN 'Bajo' WHEN greatest(0.0, least(coalesce(detail_level, 0.5), 1.0))<0.67 THEN 'Medio' ELSE 'Alto' END AS detail_name, CAST(CASE WHEN greatest(3, version%20)%2=0 THEN greatest(3, version%20)+1 ELSE greatest(3, version%20) END AS BIGINT) AS odd FROM q"
)
def request_defaults(spark, d):
    level = S.detail_level("detail_level")
    return _requests(spark, d).select("version", S.num_colors("num_colors", "num_zones").cast("long").alias("num_colors"), level.alias("detail_level"), S.detail_name(level).alias("detail_name"), S.odd(F.col("version") % 20).cast("long").alias("odd"))


@query(
    f"WITH {_REQ}, w AS (SELECT version, concat_ws(',', CASE WHEN mode IS NULL OR mode NOT IN ('color', 'bw') THEN 'mode' END, CASE WHEN num_colors NOT BETWEEN 1 AND 30 THEN 'num_colors' END, CASE WHEN detail_level NOT BETWEEN 0 AND 1 THEN 'detail_level' END, CASE WHEN num_zones NOT BETWEEN 1 AND 256 THEN 'num_zones' END, CASE WHEN min_zone_area_px<1 THEN 'min_zone_area_px' END) AS errors FROM q) "
    "SELECT version, errors, CASE WHEN errors='' THEN 200 ELSE 422 END AS status FROM w"
)
def request_errors(spark, d):
    r = _requests(spark, d).withColumn("e", edits.request_errors())
    return r.select("version", F.array_join("e", ",").alias("errors"), F.when(F.size("e") == 0, 200).otherwise(422).alias("status"))


@query("SELECT event_id AS version, base64(encode(props)) AS image_base64, props IS NOT NULL AS read_back FROM events")
def base64_roundtrip(spark, d):
    e = views.encode_base64(read(spark, d, "events").select(F.col("event_id").alias("version"), F.col("props").cast("binary").alias("content")))
    back = views.decode_base64(e.withColumn("image_base64", F.concat(F.lit("data:text/plain;base64,"), "image_base64")).withColumnRenamed("content", "was"))
    return back.select("version", F.regexp_replace("image_base64", "^data:[^,]*,", "").alias("image_base64"), (F.col("content") == F.col("was")).alias("read_back"))


@query("SELECT page_id, regexp_matches(lower(url), '\\.(jpe?g|png)$') OR page_id%7=0 AS accepted FROM pages")
def accepted_files(spark, d):
    """A file is taken by its name's ending or by its media type."""
    p = read(spark, d, "pages").withColumn("mime", F.when(F.col("page_id") % 7 == 0, "image/png").otherwise("text/html"))
    return p.select("page_id", views.accepted("url", "mime").alias("accepted"))


@query(f"WITH {_Z}, k AS (SELECT image_id, CAST(num AS VARCHAR) AS number FROM z UNION SELECT image_id, CASE zone_id%3 WHEN 0 THEN 'x'||num ELSE CAST(zone_id AS VARCHAR) END FROM z WHERE zone_id%4=0) SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY NOT regexp_matches(number, '^[0-9]+$'), TRY_CAST(number AS BIGINT), number) AS BIGINT) AS pos, number FROM k")
def numeric_keys(spark, d):
    z = zones(spark, d)
    other = z.where("zone_id % 4 = 0").select("image_id", F.when(F.col("zone_id") % 3 == 0, F.concat(F.lit("x"), F.col("num").cast("string"))).otherwise(F.col("zone_id").cast("string")).alias("number"))
    return palette.numeric_order(z.select("image_id", F.col("num").cast("string").alias("number")).union(other).distinct())


@query(f"WITH {_Z}, k AS (SELECT image_id, CAST(g AS VARCHAR) AS number FROM (SELECT DISTINCT image_id FROM z), range(1, 5) r(g) UNION SELECT image_id, CAST(num AS VARCHAR) FROM z UNION SELECT image_id, CAST(zone_id%50 AS VARCHAR) FROM z) SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY CAST(number AS BIGINT)) AS BIGINT) AS pos, number FROM k")
def color_ids(spark, d):
    z = zones(spark, d)
    return palette.colour_ids(z, z.select("image_id", (F.col("zone_id") % 50).alias("num")), 4)


@query(f"WITH {_Z}, k AS (SELECT DISTINCT image_id, num FROM z WHERE zone_id%11=0) SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY num) AS BIGINT) AS pos, CAST(num AS VARCHAR) AS number FROM k")
def manual_numbers(spark, d):
    return palette.manual_numbers(zones(spark, d).withColumn("requires_manual_color", F.col("zone_id") % 11 == 0))


@query(f"WITH {_Z} SELECT image_id, count(*) AS zones, count(DISTINCT num) AS numbers FROM z GROUP BY 1")
def zone_counts(spark, d):
    return numbering.zone_counts(zones(spark, d))


@query(f"WITH {_Z}, c AS (SELECT DISTINCT image_id, num, printf('#%02X%02X%02X', (num*29)%256, image_id%256, 7) AS hex FROM z WHERE num%3<>0) SELECT z.image_id, z.zone_id, z.num, coalesce(hex, '#ffffff') AS hex FROM z LEFT JOIN c USING (image_id, num)")
def zone_colors(spark, d):
    z = zones(spark, d)
    c = z.where("num % 3 <> 0").select("image_id", "num").distinct().withColumn("hex", S.rgb_hex(F.col("num") * 29 % 256, F.col("image_id") % 256, F.lit(7)))
    return palette.zone_colours(z, c)


@query(f"WITH {_Z}, {_PLACED} SELECT z.image_id, z.zone_id, z.num, p.x, p.y FROM z JOIN p USING (image_id, zone_id)")
def placed_zones(spark, d):
    z = zones(spark, d)
    placed = layout.placements(z.where(~S.label_too_small("area_px", "w", "h", F.lit(LABEL_MIN))))
    return z.select("image_id", "zone_id", "num").join(placed.select("image_id", "zone_id", "x", "y"), ["image_id", "zone_id"])


@query(f"WITH {_Z}, {_E}, t AS (SELECT image_id, src AS zone_id, dst AS other FROM e UNION ALL SELECT image_id, dst, src FROM e), s AS (SELECT *, CASE WHEN zone_id%5>0 THEN zone_id%5 END AS parent FROM z) SELECT a.image_id, a.zone_id, string_agg(b.zone_id, ',' ORDER BY b.area_px DESC, b.zone_id DESC) AS others FROM t JOIN s a ON a.image_id=t.image_id AND a.zone_id=t.zone_id JOIN s b ON b.image_id=t.image_id AND b.zone_id=t.other WHERE a.parent IS NULL OR a.parent=b.parent GROUP BY 1, 2")
def same_parent_neighbours(spark, d):
    """Neighbours of one parent (of any, for zones without one), largest first."""
    z = zones(spark, d).select("image_id", "zone_id", "area_px", F.when(F.col("zone_id") % 5 > 0, F.col("zone_id") % 5).alias("parent"))
    t = graph.both_ways(graph.adjacency(zones(spark, d))).join(z.drop("area_px"), ["image_id", "zone_id"])
    j = t.join(z.withColumnsRenamed({"zone_id": "other", "parent": "p2"}), ["image_id", "other"]).where("parent IS NULL OR parent = p2")
    listed = F.sort_array(F.collect_list(F.struct("area_px", "other")), asc=False)
    return j.groupBy("image_id", "zone_id").agg(F.array_join(F.transform(listed, lambda x: x["other"].cast("string")), ",").alias("others"))


@query("SELECT event_id AS run, value AS seconds FROM events WHERE value>=10")
def slow_runs(spark, d):
    return edits.slow_runs(read(spark, d, "events").select(F.col("event_id").alias("run"), F.col("value").alias("seconds")))


_VERS = "v AS (SELECT user_id AS project_id, event_id AS version, event_type AS mode, ts AS updated_at FROM events)"


@query(f"WITH {_VERS}, n AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, version DESC)=1) SELECT c_custkey AS project_id, n.mode, CASE WHEN n.version IS NULL THEN 404 ELSE 200 END AS status, CASE WHEN n.version IS NULL THEN 'project_id not found' END AS error FROM customer LEFT JOIN n ON n.project_id=c_custkey")
def project_lookup(spark, d):
    r = read(spark, d, "customer").select(F.col("c_custkey").alias("project_id"))
    return edits.looked_up(r, projects(spark, d)).select("project_id", "mode", "status", "error")


def _states(spark, d):
    k = F.col("palette_id")
    one = lambda c: F.create_map(F.lit("1"), S.rgb_hex(k % 256, F.lit(c), F.lit(0)))
    none = F.create_map().cast("map<string,string>")
    active = F.when(k % 3 == 0, one(1)).when(k % 3 == 1, none)
    originals = F.when(k % 4 < 3, F.array(F.struct(F.lit("Análoga").alias("name"), one(2).alias("colors")), F.struct(F.lit("Triádica").alias("name"), one(3).alias("colors"))))
    return palettes(spark, d).select(k.alias("project_id"), active.alias("active"), originals.alias("originals"))


@query("SELECT c_custkey AS project_id, CASE WHEN c_custkey%3=0 THEN printf('#%02X0100', c_custkey%256) WHEN c_custkey%4<3 THEN printf('#%02X0200', c_custkey%256) END AS hex FROM customer")
def palette_chain(spark, d):
    return _states(spark, d).select("project_id", F.try_element_at(edits.palette_chain("active", "originals"), F.lit("1")).alias("hex"))


@query("SELECT c_custkey AS project_id, CASE WHEN c_custkey%4<3 THEN 'Paleta actual,Análoga,Triádica' ELSE 'Paleta actual' END AS names FROM customer")
def palettes_after_edit(spark, d):
    return _states(spark, d).select("project_id", F.array_join(F.transform(edits.palettes_after_edit("active", "originals"), lambda p: p["name"]), ",").alias("names"))


@query(f"WITH {_Z} SELECT image_id AS project_id, CAST(8 AS BIGINT) AS version, '2024-02-03T04:05:06.000Z' AS updated_at, count(*) AS paths, 'Paleta actual,Análoga' AS names FROM z GROUP BY 1")
def project_rebuild(spark, d):
    z = render.rings(zones(spark, d))
    colours = F.create_map(F.lit("1"), F.lit(S.GRAY))
    v = z.select(F.col("image_id").alias("project_id")).distinct().select("project_id", F.lit(7).cast("long").alias("version"), F.lit("color").alias("mode"), F.lit("2024-01-01").alias("updated_at"), colours.alias("palette"), F.array(F.struct(F.lit("Análoga").alias("name"), colours.alias("colors"))).alias("originals"))
    r = edits.rebuilt(v, z, 640, 480, F.lit("2024-02-03 04:05:06").cast("timestamp"))
    return r.select("project_id", "version", "updated_at", (F.size(F.split("zones_svg", "<path ")) - 1).cast("long").alias("paths"), F.array_join(F.transform("palettes", lambda p: p["name"]), ",").alias("names"))


@query(f"WITH {_VERS}, n AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, version DESC)=1) SELECT project_id, version, mode FROM v UNION ALL SELECT project_id, version+1, 'edited' FROM n WHERE project_id%2=0")
def project_snapshot(spark, d):
    v = projects(spark, d).select("project_id", "version", "mode", "updated_at")
    e = v.where("project_id % 2 = 0").select("project_id").distinct().withColumn("mode", F.lit("edited"))
    return edits.with_snapshot(v, e).select("project_id", "version", "mode")


@query(f"WITH {_VERS} SELECT project_id, version FROM v QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, version DESC)>1 OR count(*) OVER (PARTITION BY project_id)=1")
def undone_projects(spark, d):
    return edits.undone(projects(spark, d)).select("project_id", "version")


@query(f"WITH {_VERS} SELECT project_id, mode, CAST(version%37 AS INT) AS num_colors FROM v ORDER BY updated_at DESC, version DESC LIMIT 1")
def restored_project(spark, d):
    return edits.restored(projects(spark, d)).select("project_id", "mode", "num_colors")


@query("SELECT c_custkey AS palette_id, c_name AS name, 12 AS num_colors, 0.5::DOUBLE AS detail_level FROM customer")
def added_columns(spark, d):
    old = palettes(spark, d).select("palette_id", "name")
    return edits.with_columns(old, {"num_colors": ("int", 12), "detail_level": ("double", 0.5), "name": ("string", "")})


@query("SELECT c_custkey AS project_id, 'attachment; filename=\"paint-'||substr('p'||c_custkey||'0000000', 1, 8)||'.pdf\"' AS content_disposition, CAST(round(c_custkey/8.0, 4)::DOUBLE AS VARCHAR) AS generation_seconds FROM customer")
def export_headers(spark, d):
    p = palettes(spark, d).select(F.col("palette_id").alias("project_id"), F.concat(F.lit("p"), F.col("palette_id").cast("string"), F.lit("0000000")).alias("key"), (F.col("palette_id") / 8.0).alias("seconds"))
    return p.select("project_id", *[c.alias(n) for n, c in edits.export_headers("key", "seconds").items()])


@query("SELECT c_custkey AS palette_id, c_name AS name, 5-c_custkey%3 AS shown FROM customer WHERE c_custkey%7=0")
def saved_palette(spark, d):
    """Palettes picked by id, with the swatches that a list shows: the first five of its colours."""
    p = palettes(spark, d).withColumn("colours", F.transform(F.sequence(F.lit(1), (5 - F.col("palette_id") % 3 + F.when(F.col("palette_id") % 3 == 0, 4).otherwise(0)).cast("int")), lambda i: i))
    wanted = p.where("palette_id % 7 = 0").select("palette_id")
    return p.join(wanted, "palette_id").select("palette_id", "name", F.size(F.slice("colours", 1, 5)).alias("shown"))


@query(f"WITH {_Z} SELECT image_id, zone_id, 'M '||x0||' '||y0||' L '||(x0+w)||' '||y0||' L '||(x0+w)||' '||(y0+h)||' L '||x0||' '||(y0+h)||' Z' AS path FROM z")
def deduped_ring(spark, d):
    """Rings whose corners come twice in a row lose the repeats."""
    r = F.col("polygon")
    z = render.rings(zones(spark, d)).withColumn("polygon", F.flatten(F.transform(r, lambda p: F.array(p, p))))
    return z.withColumn("polygon", S.deduped("polygon")).select("image_id", "zone_id", S.svg_path("polygon").alias("path"))


@query(f"WITH {_Z} SELECT image_id, string_agg(zone_id, ',' ORDER BY y0, x0, area_px DESC, zone_id) AS pieces FROM z GROUP BY 1")
def pieces_order(spark, d):
    """Pieces of a zone by upper, then left edge, then area, largest first."""
    key = F.struct("y0", "x0", (-F.col("area_px")).alias("a"), "zone_id")
    g = zones(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list(key)).alias("l"))
    return g.select("image_id", F.array_join(F.transform("l", lambda x: x["zone_id"].cast("string")), ",").alias("pieces"))


@query(f"WITH p AS {PIXELS} SELECT image_id, CAST(i AS BIGINT) AS i, CASE i WHEN 0 THEN 'arcs' WHEN 1 THEN 'grid' ELSE 'rings' END AS name, n FROM (SELECT DISTINCT image_id FROM p WHERE image_id<=3), (VALUES (0), (1), (2)) t(i), LATERAL (SELECT 64*64 AS n)")
def synthetic_images(spark, d):
    """Made-up pages: how many pixels each has."""
    s = views.synthetic_pixels(spark, 64, 64)
    n = s.groupBy("i", "name").agg(F.count(F.lit(1)).alias("n"))
    i = pixels(spark, d).where("image_id <= 3").select("image_id").distinct()
    return i.join(F.broadcast(n)).select("image_id", "i", "name", "n")  # three rows are joined


@query("SELECT c_custkey AS project_id, '1='||printf('#%02X0100', c_custkey%256)||',2='||printf('#%02XFF00', (c_custkey*3)%256) AS before, CASE WHEN c_custkey%2=0 THEN '1=#ABCDEF,2='||printf('#%02XFF00', (c_custkey*3)%256) ELSE '1='||printf('#%02X0100', c_custkey%256)||',2='||printf('#%02XFF00', (c_custkey*3)%256)||',3=#ABCDEF' END AS after FROM customer")
def edited_colour(spark, d):
    k = F.col("palette_id")
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    p = palettes(spark, d).select(k.alias("project_id"), F.create_map(F.lit("1"), S.rgb_hex(k % 256, F.lit(1), F.lit(0)), F.lit("2"), S.rgb_hex(k * 3 % 256, F.lit(255), F.lit(0))).alias("colors"))
    number = F.when(F.col("project_id") % 2 == 0, "1").otherwise("3")
    return p.select("project_id", shown(F.col("colors")).alias("before"), shown(palette.with_colour("colors", number, F.lit(" #abcdef "))).alias("after"))


@query("SELECT c_custkey AS project_id, '1=#000001,2='||CASE WHEN c_custkey%3=0 THEN '#B8B8B8' ELSE '#000002' END||',10=#00000A,x=#B8B8B8' AS colors FROM customer")
def palette_map(spark, d):
    k = F.col("palette_id")
    none = F.create_map().cast("map<string,string>")
    p = palettes(spark, d).select(k.alias("project_id"), F.create_map(F.lit("1"), F.lit("#000001"), F.lit("10"), F.lit("#00000A")).alias("current"), F.when(k % 3 == 0, none).otherwise(F.create_map(F.lit("2"), F.lit("#000002"), F.lit("1"), F.lit("#FFFFFF"))).alias("fallback"))
    done = palette.map_defaults(F.array(*[F.lit(x) for x in ("x", "2", "1")]), "current", "fallback")
    return p.select("project_id", F.array_join(F.transform(F.map_entries(done), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("colors"))


@query(f"WITH p AS {PIXELS}, e AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM p GROUP BY 1), g AS (SELECT image_id, x, y FROM e, range(0, 64) i(x), range(0, 64) j(y) WHERE x<=mx AND y<=my) SELECT g.image_id, g.y, g.x, CAST(coalesce(b, 0) AS BIGINT) AS b, CAST(coalesce(p.g, 0) AS BIGINT) AS g, CAST(coalesce(r, 0) AS BIGINT) AS r, CAST(CASE WHEN b IS NULL THEN 0 ELSE 255 END AS BIGINT) AS a FROM g LEFT JOIN p ON p.image_id=g.image_id AND p.x=g.x AND p.y=g.y")
def picture_pixels(spark, d):
    """Pixels to PNG pictures, to base64 requests, and back to pixels; places without a pixel are transparent."""
    sent = views.encode_base64(pictures.encoded(pixels(spark, d))).select("image_id", F.concat(F.lit("data:image/png;base64,"), "image_base64").alias("image_base64"))
    return pictures.decoded(views.decode_base64(sent).select("image_id", "content"))
