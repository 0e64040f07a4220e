"""Queries over zones: adjacency, components, numbers, edits, labels, texts. Each with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars as S
from ..operators import colouring, edits, graph, layout, numbering, raster, render
from ..sources.views import PIXELS, ZONES, pixels, projects, zones

N = 12
LABEL_MIN = 450.0
_GX = "greatest(0, b.x0-a.x0-a.w, a.x0-b.x0-b.w)"
_GY = "greatest(0, b.y0-a.y0-a.h, a.y0-b.y0-b.h)"
_IN = "least({i}.x0-{o}.x0, {o}.x0+{o}.w-{i}.x0-{i}.w, {i}.y0-{o}.y0, {o}.y0+{o}.h-{i}.y0-{i}.h)"
_AB, _BA = _IN.format(i="a", o="b"), _IN.format(i="b", o="a")
_INSET = f"(CASE WHEN {_AB}>0 THEN {_AB} WHEN {_BA}>0 THEN {_BA} ELSE 0 END)"
_BOX = "a.x0<=b.x0+b.w+10 AND b.x0<=a.x0+a.w+10 AND a.y0<=b.y0+b.h+10 AND b.y0<=a.y0+a.h+10"
_Z = f"z AS {ZONES}"
_E = f"e AS (SELECT a.image_id, a.zone_id AS src, b.zone_id AS dst FROM z a JOIN z b ON a.image_id=b.image_id AND a.zone_id<b.zone_id AND {_BOX} WHERE {_GX}*{_GX}+{_GY}*{_GY}<=100 AND {_INSET}<=10)"
_BOTH = "t AS (SELECT image_id, src AS zone_id, dst AS other FROM e UNION ALL SELECT image_id, dst, src FROM e)"
_ROWN = "CAST(row_number() OVER (PARTITION BY image_id ORDER BY {}) AS BIGINT)"

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _edges(spark, d):
    return graph.adjacency(zones(spark, d))


@query(f"WITH {_Z}, {_E} SELECT * FROM e")
def zone_adjacency(spark, d):
    return _edges(spark, d)


@query(f"WITH {_Z} SELECT a.image_id, a.zone_id AS src, b.zone_id AS dst FROM z a JOIN z b ON a.image_id=b.image_id AND a.zone_id<b.zone_id AND {_BOX}")
def bbox_candidates(spark, d):
    return graph.candidates(zones(spark, d)).select("a.image_id", F.col("a.zone_id").alias("src"), F.col("b.zone_id").alias("dst"))


@query(f"WITH {_Z}, {_E}, {_BOTH} SELECT z.image_id, z.zone_id, count(t.other) AS degree FROM z LEFT JOIN t USING (image_id, zone_id) GROUP BY ALL")
def adjacency_degree(spark, d):
    return graph.degrees(zones(spark, d), _edges(spark, d))


@query(f"WITH {_Z}, {_E}, {_BOTH} SELECT z.image_id, count(*) AS isolated FROM z WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.image_id=z.image_id AND t.zone_id=z.zone_id) GROUP BY z.image_id")
def isolated_zones(spark, d):
    return graph.degrees(zones(spark, d), _edges(spark, d)).where("degree = 0").groupBy("image_id").agg(F.count(F.lit(1)).alias("isolated"))


@query(f"WITH {_Z}, {_E} SELECT e.image_id, CAST(count(*) FILTER (a.num=b.num) AS BIGINT) AS collisions, count(*) AS edges FROM e JOIN z a ON a.image_id=e.image_id AND a.zone_id=e.src JOIN z b ON b.image_id=e.image_id AND b.zone_id=e.dst GROUP BY 1")
def adjacency_collisions(spark, d):
    return graph.collisions(zones(spark, d), _edges(spark, d))


@query(f"WITH RECURSIVE {_Z}, {_E}, {_BOTH}, r(image_id, zone_id, root) AS (SELECT image_id, zone_id, zone_id FROM z UNION SELECT t.image_id, t.other, r.root FROM r JOIN t ON t.image_id=r.image_id AND t.zone_id=r.zone_id WHERE r.root < t.other), c AS (SELECT image_id, zone_id, min(root) AS component FROM r GROUP BY 1, 2) SELECT image_id, component, count(*) AS size FROM c GROUP BY 1, 2")
def component_sizes(spark, d):
    z = zones(spark, d)
    return graph.components(z, graph.adjacency(z)).groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("size"))


@query(
    f"WITH {_Z}, {_E}, {_BOTH}, s AS (SELECT *, (area_px<{LABEL_MIN} OR least(w,h)<14) AS small FROM z), n AS (SELECT s.image_id, s.zone_id, arg_max(b.num, (b.area_px, -b.zone_id)) AS num FROM s JOIN t USING (image_id, zone_id) JOIN s b ON b.image_id=t.image_id AND b.zone_id=t.other AND NOT b.small WHERE s.small GROUP BY 1, 2), "
    f"f AS (SELECT a.image_id, a.zone_id, arg_min(b.num, (CASE WHEN {_INSET}>0 THEN 0 ELSE {_GX}*{_GX}+{_GY}*{_GY} END, -b.area_px, b.zone_id)) AS num FROM s a JOIN s b ON a.image_id=b.image_id AND NOT b.small WHERE a.small GROUP BY 1, 2) "
    "SELECT s.image_id, s.zone_id, CASE WHEN s.small THEN coalesce(n.num, f.num, s.num) ELSE s.num END AS num, s.small AS suppressed, CASE WHEN NOT s.small THEN 'own' WHEN n.num IS NOT NULL THEN 'neighbour' WHEN f.num IS NOT NULL THEN 'nearest' ELSE 'none' END AS method FROM s LEFT JOIN n USING (image_id, zone_id) LEFT JOIN f USING (image_id, zone_id)"
)
def label_inheritance(spark, d):
    z = zones(spark, d)
    return graph.inherit_labels(z, graph.adjacency(z), LABEL_MIN)


@query()
def graph_numbers(spark, d):
    z = zones(spark, d)
    return graph.assign_numbers(z, graph.adjacency(z), N, passes=0)


@query()
def graph_numbers_repaired(spark, d):
    z = zones(spark, d)
    return graph.assign_numbers(z, graph.adjacency(z), N)


_OX = "(least(a.x0+a.w,b.x0+b.w)-greatest(a.x0,b.x0))"
_OY = "(least(a.y0+a.h,b.y0+b.h)-greatest(a.y0,b.y0))"


@query(
    f"WITH {_Z} SELECT a.image_id, CASE WHEN a.area_px>b.area_px OR (a.area_px=b.area_px AND a.zone_id<b.zone_id) THEN a.zone_id ELSE b.zone_id END AS first, CASE WHEN a.area_px>b.area_px OR (a.area_px=b.area_px AND a.zone_id<b.zone_id) THEN b.zone_id ELSE a.zone_id END AS second, {_OX}*{_OY} AS shared "
    f"FROM z a JOIN z b ON a.image_id=b.image_id AND a.zone_id<b.zone_id AND {_OX}>0 AND {_OY}>0 WHERE least(a.area_px,b.area_px)>=0.4*greatest(a.area_px,b.area_px) AND {_OX}*{_OY}>=0.5*least(a.area_px,b.area_px)"
)
def duplicate_pairs(spark, d):
    return raster.duplicates(zones(spark, d), 0.5, 0.4)


@query(
    f"WITH RECURSIVE {_Z}, p AS ({SQL['duplicate_pairs'].removeprefix(f'WITH {_Z} ').replace('0.4*', '0.2*').replace('0.5*', '0.2*')}), o AS (SELECT image_id, second AS zone_id, list(first) AS over FROM p GROUP BY 1, 2), q AS (SELECT z.image_id, z.zone_id, row_number() OVER (PARTITION BY z.image_id ORDER BY z.area_px DESC, z.zone_id) AS r, coalesce(over, []) AS over FROM z LEFT JOIN o ON o.image_id=z.image_id AND o.zone_id=z.zone_id), "
    "k(image_id, r, kept) AS (SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[] FROM z UNION ALL SELECT k.image_id, q.r, CASE WHEN len(list_intersect(over, kept))=0 THEN list_append(kept, zone_id) ELSE kept END FROM k JOIN q ON q.image_id=k.image_id AND q.r=k.r+1), l AS (SELECT image_id, kept FROM k QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY r DESC)=1) SELECT image_id, unnest(kept) AS zone_id FROM l"
)
def duplicate_suppression(spark, d):
    """With looser bounds than masks have, so that boxes suppress each other."""
    z = zones(spark, d)
    return raster.suppress_duplicates(z, raster.duplicates(z, 0.2, 0.2))


@query(f"WITH {_Z} SELECT image_id, count(*) AS zones, count(*) AS numbered, 0::BIGINT AS outside, 0::BIGINT AS collisions FROM z GROUP BY 1")
def graph_numbers_valid(spark, d):
    """Every zone has a number from 1 to n, and with n this large no two neighbours share one."""
    z = zones(spark, d)
    e = graph.adjacency(z)
    n = graph.assign_numbers(z, e, N)
    c = graph.collisions(n, e).select("image_id", "collisions")
    g = z.join(n.select("image_id", "zone_id", F.col("num").alias("new")), ["image_id", "zone_id"], "left").groupBy("image_id").agg(F.count(F.lit(1)).alias("zones"), F.count("new").alias("numbered"), F.count_if((F.col("new") < 1) | (F.col("new") > N)).alias("outside"))
    return g.join(c, "image_id", "left").select("image_id", "zones", "numbered", "outside", F.coalesce("collisions", F.lit(0)).cast("long").alias("collisions"))


@query()
def graph_numbers_rounds(spark, d):
    z = zones(spark, d)
    return colouring.numbers(z, scratch.materialize(graph.adjacency(z), "adjacent"), N)


@query(f"WITH {_Z} SELECT image_id, count(*) AS zones, count(*) AS numbered, 0::BIGINT AS outside, 0::BIGINT AS collisions FROM z GROUP BY 1")
def graph_rounds_valid(spark, d):
    """Of the numbering in rounds: every zone has a number from 1 to n, and with n this large no two neighbours share one."""
    z = zones(spark, d)
    e = scratch.materialize(graph.adjacency(z), "adjacent")
    n = colouring.numbers(z, e, N)
    c = graph.collisions(n, e).select("image_id", "collisions")
    g = z.join(n.select("image_id", "zone_id", F.col("num").alias("new")), ["image_id", "zone_id"], "left").groupBy("image_id").agg(F.count(F.lit(1)).alias("zones"), F.count("new").alias("numbered"), F.count_if((F.col("new") < 1) | (F.col("new") > N)).alias("outside"))
    return g.join(c, "image_id", "left").select("image_id", "zones", "numbered", "outside", F.coalesce("collisions", F.lit(0)).cast("long").alias("collisions"))


@query(f"WITH {_Z}, m AS (SELECT image_id, median(area_px) AS median_area FROM z GROUP BY 1) SELECT image_id, zone_id, area_px, median_area FROM z JOIN m USING (image_id) WHERE area_px>=2.0*median_area")
def large_zone_threshold(spark, d):
    return numbering.large_zones(zones(spark, d), 2.0)


@query(f"WITH {_Z} SELECT image_id, zone_id, {_ROWN.format('zone_id')} AS new_id FROM z")
def renumber(spark, d):
    return numbering.renumber(zones(spark, d))


@query(f"WITH {_Z} SELECT * FROM (SELECT image_id, zone_id, {_ROWN.format('area_px DESC, zone_id')} AS rank FROM z) WHERE rank<=8")
def truncate_max_zones(spark, d):
    return numbering.truncate(zones(spark, d), 8)


@query(f"WITH {_Z} SELECT image_id, zone_id, {_ROWN.format('y0, x0, area_px DESC, zone_id')} AS pos FROM z")
def reading_order(spark, d):
    return numbering.reading_order(zones(spark, d))


@query(f"WITH {_Z}, t AS (SELECT image_id, num AS cluster, CAST(sum(area_px) AS BIGINT) AS area FROM z GROUP BY 1, 2) SELECT image_id, cluster, area, {_ROWN.format('area DESC, cluster')} AS num FROM t")
def cluster_rank(spark, d):
    return numbering.cluster_rank(zones(spark, d))


#: Numbers 1 to N or to the image's number of zones, whichever is less, that no zone has.
_WANTED = f"u AS (SELECT DISTINCT image_id, num FROM z), w AS (SELECT i.image_id, CAST(g AS BIGINT) AS num FROM (SELECT image_id, least({N}, count(*)) AS top FROM z GROUP BY 1) i, range(1, {N + 1}) r(g) WHERE g <= top), m AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.image_id=w.image_id AND u.num=w.num))"
_MISSING = f"u AS (SELECT DISTINCT image_id, num FROM z), w AS (SELECT i.image_id, CAST(g AS BIGINT) AS num FROM (SELECT DISTINCT image_id FROM z) i, range(1, {N + 1}) r(g)), m AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.image_id=w.image_id AND u.num=w.num))"


@query(f"WITH {_Z}, {_WANTED}, k0 AS (SELECT *, least({N}, count(*) OVER (PARTITION BY image_id)) AS top FROM z), s AS (SELECT *, row_number() OVER (PARTITION BY image_id, num ORDER BY area_px, zone_id DESC) AS r FROM k0 WHERE num BETWEEN 1 AND top), a AS (SELECT image_id, zone_id, num AS old, row_number() OVER (PARTITION BY image_id ORDER BY area_px DESC, zone_id) AS k FROM s WHERE r>1), b AS (SELECT image_id, num AS new, row_number() OVER (PARTITION BY image_id ORDER BY num) AS k FROM m) SELECT a.image_id, a.zone_id, a.old, b.new FROM a JOIN b USING (image_id, k)")
def donor_rebalance(spark, d):
    return numbering.donors(zones(spark, d), N)


@query(f"WITH {_Z}, {_MISSING}, c AS (SELECT image_id, num, count(*) AS n FROM z GROUP BY 1, 2) SELECT coalesce(w.image_id, c.image_id) AS image_id, coalesce(w.num, c.num) AS num, coalesce(n, 0) AS n FROM w FULL JOIN c ON w.image_id=c.image_id AND w.num=c.num")
def number_distribution(spark, d):
    return numbering.distribution(zones(spark, d), N)


@query(f"WITH {_Z}, {_MISSING} SELECT * FROM m")
def unused_numbers(spark, d):
    return numbering.unused(zones(spark, d), N)


_PAIRS = "p AS (SELECT e.*, a.area_px AS area1, a.num AS num1, b.area_px AS area2, b.num AS num2 FROM e JOIN z a ON a.image_id=e.image_id AND a.zone_id=e.src JOIN z b ON b.image_id=e.image_id AND b.zone_id=e.dst), q AS (SELECT *, (num1<>num2 AND abs(area1-area2)/CAST(greatest(area1,area2) AS DOUBLE)<0.2) AS asks FROM p)"


def _pairs(spark, d):
    z = zones(spark, d).select("image_id", "zone_id", "area_px", "num")
    e = _edges(spark, d)
    return e.join(z.withColumnsRenamed({"zone_id": "src", "area_px": "area1", "num": "num1"}), ["image_id", "src"]).join(z.withColumnsRenamed({"zone_id": "dst", "area_px": "area2", "num": "num2"}), ["image_id", "dst"])


@query(f"WITH {_Z}, {_E}, {_PAIRS} SELECT image_id, src, dst, asks AS needs_confirmation FROM q")
def merge_confirmation(spark, d):
    return edits.merge_rules(_pairs(spark, d)).select("image_id", "src", "dst", "needs_confirmation")


@query(f"WITH {_Z}, {_E}, {_PAIRS} SELECT image_id, src, dst, CASE WHEN asks THEN dst WHEN area1>=area2 THEN src ELSE dst END AS kept_from_id FROM q")
def merge_keep_rule(spark, d):
    return edits.merge_rules(_pairs(spark, d), F.col("dst")).select("image_id", "src", "dst", "kept_from_id")


@query(
    f"WITH {_Z}, {_E}, {_PAIRS}, o AS (SELECT *, CASE WHEN asks THEN dst WHEN area1>=area2 THEN src ELSE dst END AS kept FROM q QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY src, dst)=1), "
    "j AS (SELECT z.*, o.src, o.dst, o.kept, coalesce(z.zone_id IN (o.src, o.dst), false) AS part FROM z LEFT JOIN o USING (image_id)), g AS (SELECT image_id, CASE WHEN part THEN least(src,dst) ELSE zone_id END AS pos, CAST(sum(area_px) AS BIGINT) AS area_px, max(CASE WHEN NOT part OR zone_id=kept THEN num END) AS num, count(*) AS parts FROM j GROUP BY 1, 2) "
    f"SELECT image_id, {_ROWN.format('pos')} AS zone_id, pos AS was, area_px, num, parts FROM g"
)
def merge_first_pair(spark, d):
    from pyspark.sql import Window

    rules = edits.merge_rules(_pairs(spark, d), F.col("dst"))
    first = rules.withColumn("r", F.row_number().over(Window.partitionBy("image_id").orderBy("src", "dst"))).where("r = 1")
    return edits.merged_zones(zones(spark, d), first)


_LEFT = "greatest(0, least(w, x0+w//3+zone_id%7-x0))*h"


@query(f"WITH {_Z}, s AS (SELECT *, {_LEFT} AS l, w*h-{_LEFT} AS r, max(zone_id) OVER (PARTITION BY image_id)+1 AS nid FROM z) SELECT image_id, zone_id, num, CASE WHEN l>1 AND r>1 THEN 'split' ELSE 'not_split' END AS status, CASE WHEN l>1 AND r>1 THEN greatest(l,r) END AS kept_area, CASE WHEN l>1 AND r>1 THEN least(l,r) END AS new_area, CASE WHEN l>1 AND r>1 THEN nid END AS new_id FROM s")
def split_keep_rule(spark, d):
    return edits.split_boxes(zones(spark, d).withColumn("cut_x", F.expr("x0 + w div 3 + zone_id % 7")))


_FONT = "greatest(5.0, least(28.0, sqrt(area_px)*0.28, w*0.55, h*0.55))"


@query(f"WITH {_Z} SELECT image_id, zone_id, round({_FONT}, 6) AS font FROM z")
def label_font(spark, d):
    return zones(spark, d).select("image_id", "zone_id", F.round(S.label_font("area_px", "w", "h"), 6).alias("font"))


@query(f"WITH {_Z}, f AS (SELECT *, {_FONT} AS f FROM z) SELECT image_id, zone_id, round(greatest(2.0, sqrt(power(length(CAST(num AS VARCHAR))*f*0.31, 2)+power(f*0.48, 2))), 6) AS radius FROM f")
def label_radius(spark, d):
    return zones(spark, d).select("image_id", "zone_id", F.round(S.label_radius(F.col("num").cast("string"), S.label_font("area_px", "w", "h")), 6).alias("radius"))


_PLACED = (
    f"f AS (SELECT *, {_FONT} AS f, least(w,h)/2.0 AS c FROM z WHERE NOT (area_px<{LABEL_MIN} OR least(w,h)<14)), k AS (SELECT f.*, g AS step, greatest(3.5, f*power(0.9, g)) AS s FROM f, range(0, 21) r(g)), q AS (SELECT *, greatest(2.0, sqrt(power(length(CAST(num AS VARCHAR))*s*0.31, 2)+power(s*0.48, 2))) AS rad FROM k), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY image_id, zone_id ORDER BY CASE WHEN c+0.001>=rad THEN step ELSE 100-step END) AS rn FROM q), "
    "p AS (SELECT image_id, zone_id, x0+w/2.0 AS x, y0+h/2.0 AS y, round(s, 6) AS font_size, CASE WHEN c+0.001<rad THEN 'pole_of_inaccessibility_tight' WHEN step=0 THEN 'representative_point' ELSE 'pole_of_inaccessibility_reduced_font' END AS method, round(c, 3) AS clearance_px, round(rad, 3) AS required_radius_px FROM b WHERE rn=1)"
)


def _placements(spark, d):
    return layout.placements(zones(spark, d).where(~S.label_too_small("area_px", "w", "h", F.lit(LABEL_MIN))))


@query(f"WITH {_Z}, {_PLACED} SELECT * FROM p")
def label_shrink(spark, d):
    return _placements(spark, d)


@query(
    f"WITH {_Z}, {_PLACED} SELECT image_id, count(*) AS placement_count, count(*) FILTER (method='representative_point') AS representative_point_count, count(*) FILTER (method<>'representative_point') AS pole_of_inaccessibility_count, count(*) FILTER (method='pole_of_inaccessibility_reduced_font') AS reduced_font_count, "
    "count(*) FILTER (clearance_px+0.001<required_radius_px) AS tight_label_count, round(min(clearance_px), 3) AS min_clearance_px, round(min(clearance_px/required_radius_px), 3) AS min_clearance_ratio FROM p GROUP BY 1"
)
def placement_metrics(spark, d):
    return layout.placement_metrics(_placements(spark, d))


@query(f"WITH {_Z}, u AS (SELECT DISTINCT image_id, num FROM z), i AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY num)-1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM u) SELECT image_id, num, CAST(i//30 AS BIGINT) AS col, CAST(i%30 AS BIGINT) AS row, round(42.0+(i//30)*((595.2755905511812-84.0)/greatest(1, ceil(n/30.0))), 4) AS x, round((841.8897637795277-76.0)-(i%30)*24.0, 4) AS y FROM i")
def legend_layout(spark, d):
    return layout.legend(zones(spark, d).select("image_id", "num").distinct(), *layout.PAGES["A4"])


@query("SELECT e.user_id AS project_id, e.event_id AS version, paper, orientation, width, height FROM events e JOIN (VALUES ('A4','portrait',595.2755905511812::DOUBLE,841.8897637795277::DOUBLE),('A4','landscape',841.8897637795277,595.2755905511812),('Letter','portrait',612.0,792.0),('Letter','landscape',792.0,612.0)) t(paper, orientation, width, height) ON paper=CASE WHEN event_id%37%2=0 THEN 'A4' ELSE 'Letter' END AND orientation=CASE WHEN event_id%37%3=0 THEN 'landscape' ELSE 'portrait' END")
def page_size(spark, d):
    """The page of every version of every project, by its paper and orientation."""
    k = F.col("num_colors")
    p = projects(spark, d).select("project_id", "version", F.when(k % 2 == 0, "A4").otherwise("Letter").alias("paper"), F.when(k % 3 == 0, "landscape").otherwise("portrait").alias("orientation"))
    return p.join(F.broadcast(layout.page_sizes(spark)), ["paper", "orientation"]).select("project_id", "version", "paper", "orientation", "width", "height")  # four rows are broadcast


@query(f"WITH {_Z} SELECT image_id, zone_id, round((595.2755905511812-640*((595.2755905511812-72)/640))/2+x0*((595.2755905511812-72)/640), 6) AS px, round((841.8897637795277-480*((595.2755905511812-72)/640))/2+(480-y0)*((595.2755905511812-72)/640), 6) AS py FROM z")
def page_transform(spark, d):
    x, y = layout.on_page("x0", "y0", 640, 480, *layout.PAGES["A4"])
    return zones(spark, d).select("image_id", "zone_id", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


_DETAIL = "(zone_id%21)/10.0-0.5"
_LERP = f"({{a}}+({{b}}-{{a}})*greatest(0.0, least({_DETAIL}, 1.0)))"


@query(f"WITH {_Z} SELECT image_id, zone_id, CAST(greatest(50, round_even(500.0*400.0*{_LERP.format(a='0.012', b='0.0012')}, 0)) AS BIGINT) AS min_area_px, CAST(round_even({_LERP.format(a='35.0', b='180.0')}, 0) AS BIGINT) AS max_zones FROM (SELECT image_id, zone_id::DOUBLE AS zone_id FROM z)")
def color_limits(spark, d):
    z = zones(spark, d).select("image_id", F.col("zone_id").cast("double").alias("zone_id"))
    lim = S.color_limits(F.lit(500.0), F.lit(400.0), F.col("zone_id") % 21 / 10.0 - 0.5)
    return z.select("image_id", "zone_id", *[c.alias(n) for n, c in lim.items()])


@query(
    f"WITH {_Z}, d AS (SELECT image_id, zone_id, w*16 AS pw, h*16 AS ph, (zone_id % 5)*70 AS wish FROM (SELECT image_id, zone_id::DOUBLE AS zone_id, w::DOUBLE AS w, h::DOUBLE AS h FROM z)), a AS (SELECT *, CAST(greatest(20, coalesce(nullif(wish, 0), round_even(pw*ph*{_LERP.format(a='0.0025', b='0.00035')}, 0))) AS BIGINT) AS min_area_px, CAST(greatest(3, round_even({_LERP.format(a='5.0', b='3.0')}, 0)) AS BIGINT) AS k FROM d) "
    f"SELECT image_id, zone_id, round(greatest(0.0, least({_DETAIL}, 1.0)), 9) AS detail_level, min_area_px, CAST(greatest(30, round_even(min_area_px*0.06, 0)) AS BIGINT) AS component_min_area_px, k + (k+1)%2 AS close_kernel, 35::BIGINT AS adaptive_block_size, 9::BIGINT AS adaptive_c, round({_LERP.format(a='0.005', b='0.0018')}, 9) AS epsilon_ratio, round(pw*ph*0.92, 6) AS max_area_px, round({_LERP.format(a='3.2', b='2.0')}, 9) AS slic_large_zone_multiplier, "
    f"round({_LERP.format(a='3.4', b='1.2')}, 9) AS slic_target_area_multiplier, round({_LERP.format(a='10.0', b='4.0')}, 9) AS slic_compactness, 64::BIGINT AS slic_max_segments_per_zone, 'curved' AS subdivision_strategy, true AS merge_small_slic_fragments, 3::BIGINT AS small_fragment_max_iterations_multiplier FROM a"
)
def derived_params(spark, d):
    z = zones(spark, d).select("image_id", *[F.col(c).cast("double").alias(c) for c in ("zone_id", "w", "h")])
    p = S.line_params(F.col("w") * 16, F.col("h") * 16, F.col("zone_id") % 21 / 10.0 - 0.5, F.col("zone_id") % 5 * 70)
    real = {"detail_level", "epsilon_ratio", "slic_large_zone_multiplier", "slic_target_area_multiplier", "slic_compactness"}
    return z.select("image_id", "zone_id", *[(F.round(c, 9) if n in real else F.round(c, 6) if n == "max_area_px" else c).alias(n) for n, c in p.items()])


@query(f"WITH {_Z} SELECT image_id, zone_id, (area_px<{LABEL_MIN} OR least(w,h)<14) AS too_small, (area_px>0 AND (area_px<0.0017*640*480 OR least(w,h)<14)) AS client_hidden FROM z")
def label_predicates(spark, d):
    return zones(spark, d).select("image_id", "zone_id", S.label_too_small("area_px", "w", "h", F.lit(LABEL_MIN)).alias("too_small"), S.client_label_hidden(F.lit(None).cast("boolean"), "area_px", "w", "h", 640, 480).alias("client_hidden"))


@query(f"WITH {_Z} SELECT image_id, zone_id, 'M '||x0||' '||y0||' L '||(x0+w)||' '||y0||' L '||(x0+w)||' '||(y0+h)||' L '||x0||' '||(y0+h)||' Z' AS path FROM z")
def svg_path(spark, d):
    return render.rings(zones(spark, d)).select("image_id", "zone_id", S.svg_path("polygon").alias("path"))


_D = "'M '||x0||' '||y0||' L '||(x0+w)||' '||y0||' L '||(x0+w)||' '||(y0+h)||' L '||x0||' '||(y0+h)||' Z'"
_STROKE = 'fill="none" stroke="#000000" stroke-width="2" vector-effect="non-scaling-stroke"'
_PATH = f"'<path id=\"zone-'||zone_id||'\" data-zone-id=\"'||zone_id||'\" data-paint-number=\"'||num||'\" d=\"'||{_D}||'\" {_STROKE}/>'"
_OPEN = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 640 480" width="640" height="480">'


@query(f"WITH {_Z} SELECT image_id, '{_OPEN}'||chr(10)||'  '||string_agg({_PATH}, chr(10)||'  ' ORDER BY zone_id)||chr(10)||'</svg>' AS svg FROM z GROUP BY 1")
def svg_document(spark, d):
    return render.svg_documents(render.rings(zones(spark, d)), 640, 480)


@query(
    f"WITH {_Z}, {_PLACED}, l AS (SELECT z.image_id, string_agg({_PATH}, chr(10)||'  ' ORDER BY zone_id) AS paths FROM z GROUP BY 1), t AS (SELECT p.image_id, string_agg(printf('<text x=\"%.2f\" y=\"%.2f\" text-anchor=\"middle\" dominant-baseline=\"central\" font-size=\"%.2f\" font-weight=\"700\" fill=\"#000000\">', p.x, p.y, p.font_size)||num||'</text>', chr(10)||'  ' ORDER BY p.zone_id) AS texts FROM p JOIN z ON z.image_id=p.image_id AND z.zone_id=p.zone_id GROUP BY 1) "
    f"SELECT l.image_id, '{_OPEN}'||chr(10)||'  '||paths||coalesce(chr(10)||'  '||texts, '')||chr(10)||'</svg>' AS svg FROM l LEFT JOIN t USING (image_id)"
)
def numbered_svg(spark, d):
    return render.numbered_svg(render.rings(zones(spark, d)), _placements(spark, d), 640, 480)


def _flagged(spark, d):
    return render.rings(zones(spark, d)).withColumns({"requires_manual_color": F.col("zone_id") % 11 == 0, "suppress_label": F.when(F.col("zone_id") % 7 == 0, True)})


_JSON_RING = "'[['||x0||','||y0||'],['||(x0+w)||','||y0||'],['||(x0+w)||','||(y0+h)||'],['||x0||','||(y0+h)||'],['||x0||','||y0||']]'"
_FEATURE = (
    f"'{{\"type\":\"Feature\",\"id\":\"'||zone_id||'\",\"properties\":{{\"zone_id\":\"'||zone_id||'\",\"paint_number\":\"'||num||'\",\"area_px\":'||area_px||',\"bbox\":['||x0||','||y0||','||w||','||h||']'||CASE WHEN zone_id%11=0 THEN ',\"requires_manual_color\":true' ELSE '' END||CASE WHEN zone_id%7=0 THEN ',\"suppress_label\":true' ELSE '' END||"
    f"'}},\"geometry\":{{\"type\":\"Polygon\",\"coordinates\":['||{_JSON_RING}||']}}}}'"
)


@query(f"WITH {_Z} SELECT image_id, zone_id, {_FEATURE} AS feature FROM z")
def geojson_feature(spark, d):
    return render.features(_flagged(spark, d))


@query(f"WITH {_Z} SELECT image_id, '{{\"type\":\"FeatureCollection\",\"properties\":{{\"width\":640,\"height\":480,\"mode\":\"bw\",\"zone_count\":'||count(*)||',\"num_colors\":12,\"detail_level\":null}},\"features\":['||string_agg({_FEATURE}, ',' ORDER BY zone_id)||']}}' AS geojson FROM z GROUP BY 1")
def feature_collection(spark, d):
    return render.feature_collections(_flagged(spark, d), 640, 480, "bw", num_colors=12)


@query(f"WITH {_Z} SELECT image_id, zone_id, CAST(area_px AS DOUBLE) AS area, round(x0+w/2.0, 6) AS cx, round(y0+h/2.0, 6) AS cy FROM z")
def shoelace_area(spark, d):
    r = render.rings(zones(spark, d))
    return r.select("image_id", "zone_id", (F.abs(S.shoelace("polygon")) / 2).alias("area"), F.round(S.centroid("polygon", "x"), 6).alias("cx"), F.round(S.centroid("polygon", "y"), 6).alias("cy"))


@query(f"WITH {_Z}, p AS {PIXELS} SELECT z.image_id, z.zone_id, CAST(floor(avg(b)) AS BIGINT) AS b, CAST(floor(avg(g)) AS BIGINT) AS g, CAST(floor(avg(r)) AS BIGINT) AS r, count(*) AS n FROM p JOIN z ON z.image_id=p.image_id AND x>=x0 AND x<x0+w AND y>=y0 AND y<y0+h GROUP BY 1, 2")
def zone_mean_color(spark, d):
    return raster.mean_colours(pixels(spark, d), raster.box_runs(zones(spark, d)))
