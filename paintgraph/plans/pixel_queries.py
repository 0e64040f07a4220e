"""Queries over pixels, colour samples, palettes and projects, each with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import edits, palette, raster
from ..sources.views import PIXELS, palettes, pixels, projects, read

QUERIES: dict = {}
SQL: dict = {}
_P = f"p AS {PIXELS}"
_GRAY = "CAST(round_even((114*b+587*g+299*r)/1000.0::DOUBLE, 0) AS BIGINT)"
_V = f"v AS (SELECT image_id, x, y, {_GRAY} AS v FROM p)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {_P}, {_V} SELECT * FROM v")
def pixel_gray(spark, d):
    return raster.gray_pixels(pixels(spark, d))


@query(f"WITH {_P}, q AS (SELECT *, greatest(b,g,r) AS v, CASE WHEN greatest(b,g,r)>0 THEN CAST(round_even(255.0*(greatest(b,g,r)-least(b,g,r))/greatest(b,g,r), 0) AS BIGINT) ELSE 0 END AS s FROM p) SELECT image_id, x, y, s, v FROM q WHERE s>35 AND v>35 AND v<245")
def pixel_hsv_filter(spark, d):
    return palette.colourful(pixels(spark, d)).select("image_id", "x", "y", "s", "v")


@query(f"WITH {_P}, {_V}, m AS (SELECT image_id, avg(v) AS gray FROM v GROUP BY 1) SELECT image_id, CAST(i AS INT) AS i, round((0.58+gray/255*0.22+o)%1.0, 6) AS hue FROM m, (VALUES (0,0.0::DOUBLE),(1,0.08),(2,0.17),(3,0.33),(4,0.5),(5,0.67)) t(i, o)")
def mean_gray_seed(spark, d):
    return palette.seed_hues(pixels(spark, d)).withColumn("hue", F.round("hue", 6))


@query(f"WITH {_P}, q AS (SELECT image_id, y, x, x-row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM p) SELECT image_id, y, min(x) AS x0, max(x) AS x1 FROM q GROUP BY image_id, y, g")
def pixel_runs(spark, d):
    return raster.runs(pixels(spark, d))


_RUNS = "q AS (SELECT image_id, y, x, x-row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM p), r AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1, y*100000+min(x) AS node FROM q GROUP BY image_id, y, g)"
_NEXT = "e AS MATERIALIZED (SELECT a.image_id, a.node AS u, b.node AS v FROM r a JOIN r b ON a.image_id=b.image_id AND b.y=a.y+1 AND a.x0<=b.x1+1 AND b.x0<=a.x1+1), t AS MATERIALIZED (SELECT * FROM e UNION ALL SELECT image_id, v, u FROM e), w(image_id, node, root) AS (SELECT image_id, node, node FROM r UNION SELECT t.image_id, t.v, w.root FROM w JOIN t ON t.image_id=w.image_id AND t.u=w.node WHERE w.root < t.v)"


@query(f"WITH RECURSIVE {_P}, {_RUNS}, {_NEXT}, c AS (SELECT image_id, node, min(root) AS component FROM w GROUP BY 1, 2) SELECT image_id, component, min(x0) AS x, min(y) AS y, max(x1)-min(x0)+1 AS w, max(y)-min(y)+1 AS h, CAST(sum(x1-x0+1) AS BIGINT) AS area FROM r JOIN c USING (image_id, node) GROUP BY 1, 2")
def run_components(spark, d):
    s = raster.component_stats(raster.run_components(raster.runs(pixels(spark, d))))
    number = F.floor(F.col("component") / raster.ROW) * 100_000 + F.col("component") % raster.ROW  # pages are 64 wide
    return s.withColumn("component", number)


@query(f"WITH {_P}, {_V} SELECT image_id, x, y, CAST(CASE WHEN x IN (0,63) OR y IN (0,63) THEN 255 ELSE v END AS BIGINT) AS v FROM v")
def line_frame(spark, d):
    return raster.frame(raster.gray_pixels(pixels(spark, d)), 64, 64).select("image_id", "x", "y", "v")


@query(f"WITH {_P}, {_V} SELECT image_id, x, y, max(v) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM v")
def dilate_row(spark, d):
    return raster.dilate_rows(raster.gray_pixels(pixels(spark, d)), 2)


def _window(part: str, along: str, k: int) -> str:
    return f"OVER (PARTITION BY image_id, {part} ORDER BY {along} RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING)"


def _ellipse_sql(step: str, source: str, name: str) -> str:
    """A kernel of radius 2: five rows, of widths 0, 2, 2, 2, 0 to each side."""
    pick = "greatest" if step == "max" else "least"
    return f"{name}0 AS (SELECT *, {step}(v) {_window('y', 'x', 0)} AS m0, {step}(v) {_window('y', 'x', 2)} AS m2 FROM {source}), {name} AS (SELECT image_id, x, y, {pick}({step}(m0) {_window('x', 'y', 2)}, {step}(m2) {_window('x', 'y', 1)}) AS v FROM {name}0)"


@query(f"WITH {_P}, {_V}, {_ellipse_sql('max', 'v', 'a')}, {_ellipse_sql('min', 'a', 'b')} SELECT * FROM b")
def close_mask(spark, d):
    return raster.close_mask(raster.gray_pixels(pixels(spark, d)), 2).select("image_id", "x", "y", "v")


_BLOCK, _SIGMA = 35, 5.6


def _gauss_sql() -> str:
    r = _BLOCK // 2
    weights = f"k AS (SELECT d, exp(-d*d/(2*{_SIGMA}::DOUBLE*{_SIGMA}::DOUBLE)) / (SELECT sum(exp(-e*e/(2*{_SIGMA}::DOUBLE*{_SIGMA}::DOUBLE))) FROM range(-{r}, {r + 1}) t(e)) AS w FROM range(0, {r + 1}) t(d)), f AS (SELECT d, coalesce(sum(w) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS w FROM k)"

    def blur(source: str, value: str, name: str, part: str, along: str) -> str:
        near = f"{name}n AS (SELECT a.image_id, a.x, a.y, a.v AS own, b.{value}::DOUBLE AS v, abs(a.{along}-b.{along}) AS d, b.{along}=min(b.{along}) OVER g AS lo, b.{along}=max(b.{along}) OVER g AS hi FROM {source} a JOIN {source} b ON a.image_id=b.image_id AND a.{part}=b.{part} AND abs(a.{along}-b.{along})<={r} WINDOW g AS (PARTITION BY a.image_id, a.x, a.y))"
        return f"{near}, {name} AS (SELECT image_id, x, y, any_value(own) AS v, sum(n.v*(k.w + CASE WHEN lo THEN f.w ELSE 0 END + CASE WHEN hi THEN f.w ELSE 0 END))/sum(k.w + CASE WHEN lo THEN f.w ELSE 0 END + CASE WHEN hi THEN f.w ELSE 0 END) AS m FROM {name}n n JOIN k USING (d) JOIN f USING (d) GROUP BY 1, 2, 3)"

    return f"WITH {_P}, {_V}, {weights}, {blur('v', 'v', 'a', 'y', 'x')}, {blur('a', 'm', 'b', 'x', 'y')} SELECT image_id, x, y, CAST(CASE WHEN v<=round_even(round(m, 6), 0)-9 THEN 255 ELSE 0 END AS BIGINT) AS v FROM b"


@query(_gauss_sql())
def adaptive_threshold(spark, d):
    return raster.adaptive_threshold(raster.gray_pixels(pixels(spark, d)), _BLOCK, 9)


@query(f"WITH {_P}, {_V}, e AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY 1), o AS (SELECT v.image_id, v.x AS tx, v.y AS ty, greatest(x0, least(x1, v.x+dx)) AS x, greatest(y0, least(y1, v.y+dy)) AS y FROM v JOIN e USING (image_id), range(-1,2) a(dx), range(-1,2) b(dy)), m AS (SELECT o.image_id, tx, ty, median(v.v) AS m FROM o JOIN v ON o.image_id=v.image_id AND o.x=v.x AND o.y=v.y GROUP BY 1,2,3) SELECT image_id, tx AS x, ty AS y, CAST(floor(m) AS BIGINT) AS v FROM m")
def median_blur(spark, d):
    return raster.median3(raster.gray_pixels(pixels(spark, d)))


@query(f"WITH {_P} SELECT image_id, CAST(x//4 AS BIGINT) AS x, CAST(y//4 AS BIGINT) AS y, CAST(round_even(avg(b),0) AS BIGINT) AS b, CAST(round_even(avg(g),0) AS BIGINT) AS g, CAST(round_even(avg(r),0) AS BIGINT) AS r FROM p GROUP BY 1,2,3")
def shrink_pixels(spark, d):
    return raster.shrink(pixels(spark, d), 4)


@query(f"WITH {_P}, m AS (SELECT image_id, CAST((y//8)%3 AS BIGINT) AS mask, y//2 AS y, min(x) AS x0, max(x) AS x1 FROM p GROUP BY 1,2,3) SELECT a.image_id, a.mask AS m1, b.mask AS m2, CAST(sum(least(a.x1,b.x1)-greatest(a.x0,b.x0)+1) AS BIGINT) AS shared FROM m a JOIN m b ON a.image_id=b.image_id AND a.y%4=b.y%4 AND a.mask<b.mask AND a.x0<=b.x1 AND b.x0<=a.x1 GROUP BY 1,2,3")
def mask_overlap(spark, d):
    p = pixels(spark, d)
    m = p.groupBy("image_id", F.expr("(y div 8) % 3").alias("mask"), F.expr("(y div 2)").alias("y")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return raster.overlaps(m.withColumn("y", F.col("y") % 4))


def _samples(spark, d):
    v = lambda i: F.round((F.col("embedding")[i].cast("double") + 1) * 100, 3)
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), v(0).alias("x"), v(1).alias("y"), v(2).alias("z"))


def _lloyd_sql(samples: str, k: int, rounds: int) -> str:
    """CTEs c0 to c{rounds} of centres over samples s0 (image_id, id, x, y, z, weight)."""
    parts = [
        f"s0 AS MATERIALIZED ({samples}), s1 AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x, y, z, id)-1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM s0), s2 AS (SELECT *, least({k}, n) AS kk, i*least({k}, n)//n AS c FROM s1), c0 AS MATERIALIZED (SELECT image_id, c, x::DOUBLE AS cx, y::DOUBLE AS cy, z::DOUBLE AS cz, 0 AS n FROM s2 WHERE i=((2*c+1)*n)//(2*kk))"
    ]
    for r in range(rounds):
        parts.append(f"l{r} AS (SELECT s0.image_id, id, x, y, z, weight, arg_min(c, (round((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz), 6), c)) AS c FROM s0 JOIN c{r} USING (image_id) GROUP BY ALL)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT image_id, c, round(sum(x*weight)/sum(weight)::DOUBLE, 6) AS cx, round(sum(y*weight)/sum(weight)::DOUBLE, 6) AS cy, round(sum(z*weight)/sum(weight)::DOUBLE, 6) AS cz, sum(weight) AS n FROM l{r} GROUP BY 1, 2)")
    return ", ".join(parts)


_COLOURFUL = "q AS (SELECT *, greatest(b,g,r) AS vv, CASE WHEN greatest(b,g,r)>0 THEN CAST(round_even(255.0*(greatest(b,g,r)-least(b,g,r))/greatest(b,g,r), 0) AS BIGINT) ELSE 0 END AS ss FROM p), f AS (SELECT * FROM q WHERE ss>35 AND vv>35 AND vv<245), enough AS (SELECT image_id FROM f GROUP BY 1 HAVING count(*)>=50)"
#: Rounds of the two clusterings; a round changes nothing once centres rest, and then the loop ends.
PALETTE_ROUNDS, ZONE_ROUNDS = 20, 30


@query(
    f"WITH {_P}, {_V}, {_COLOURFUL}, {_lloyd_sql('SELECT image_id, (b*256+g)*256+r AS id, b AS x, g AS y, r AS z, count(*) AS weight FROM f WHERE image_id IN (SELECT image_id FROM enough) GROUP BY ALL', 6, PALETTE_ROUNDS)}, "
    f"a AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, c)-1 AS i, printf('#%02X%02X%02X', CAST(round_even(cz, 0) AS INT), CAST(round_even(cy, 0) AS INT), CAST(round_even(cx, 0) AS INT)) AS hex FROM c{PALETTE_ROUNDS}), m AS (SELECT image_id, avg(v) AS gray FROM v WHERE image_id NOT IN (SELECT image_id FROM enough) GROUP BY 1), "
    "h AS (SELECT image_id, i, (0.58+gray/255*0.22+o)%1.0 AS h FROM m, (VALUES (0,0.0::DOUBLE),(1,0.08),(2,0.17),(3,0.33),(4,0.5),(5,0.67)) t(i, o)), w AS (SELECT *, CAST(floor(h*6) AS BIGINT)%6 AS s, h*6-floor(h*6) AS fr, 0.82::DOUBLE AS v, 0.55::DOUBLE AS sat FROM h), "
    "y AS (SELECT *, v*(1-sat) AS p, v*(1-sat*fr) AS q, v*(1-sat*(1-fr)) AS t FROM w) SELECT image_id, CAST(i AS INT) AS i, hex FROM a UNION ALL SELECT image_id, CAST(i AS INT), printf('#%02X%02X%02X', CAST(round_even(([v,q,p,p,t,v])[s+1]*255, 0) AS INT), CAST(round_even(([t,v,v,q,p,p])[s+1]*255, 0) AS INT), CAST(round_even(([p,p,t,v,v,q])[s+1]*255, 0) AS INT)) FROM y"
)
def dominant_colors(spark, d):
    return palette.dominant(pixels(spark, d), 6, PALETTE_ROUNDS)


def _coloured(spark, d):
    own = palette.colourful(pixels(spark, d)).groupBy("image_id", "b", "g", "r").agg(F.count(F.lit(1)).alias("weight"))
    return own.select("image_id", ((F.col("b") * 256 + F.col("g")) * 256 + F.col("r")).cast("long").alias("id"), F.col("b").alias("x"), F.col("g").alias("y"), F.col("r").alias("z"), "weight")


def _starts_sql(k: int, tries: int) -> str:
    """Weighted sampling by squared distances with hashed draws, a step after another."""
    draw = "-ln((CAST('0x' || substr(md5(concat_ws('-', s0.image_id, id, t, {step})), 1, 8) AS BIGINT)+0.5::DOUBLE)/4294967296.0::DOUBLE)/{rate}"
    steps = [f"s0 AS MATERIALIZED (SELECT image_id, (b*256+g)*256+r AS id, b AS x, g AS y, r AS z, count(*) AS weight FROM f GROUP BY ALL)", f"t0 AS (SELECT s0.*, t, {draw.format(step=0, rate='weight')} AS p FROM s0, range(0, {tries}) u(t))", "k0 AS MATERIALIZED (SELECT image_id, t, 0 AS c, x, y, z FROM t0 QUALIFY row_number() OVER (PARTITION BY image_id, t ORDER BY p, id)=1)"]
    for i in range(1, k):
        steps.append(f"d{i} AS (SELECT s0.image_id, t, id, s0.x, s0.y, s0.z, weight, min((s0.x-k.x)*(s0.x-k.x)+(s0.y-k.y)*(s0.y-k.y)+(s0.z-k.z)*(s0.z-k.z)) AS far FROM s0 JOIN k{i - 1} k USING (image_id) GROUP BY ALL)")
        steps.append(f"k{i} AS MATERIALIZED (SELECT * FROM k{i - 1} UNION ALL SELECT image_id, t, {i}, x, y, z FROM (SELECT *, {draw.format(step=i, rate='(weight*far)').replace('s0.', '')} AS p FROM d{i} WHERE far>0) QUALIFY row_number() OVER (PARTITION BY image_id, t ORDER BY p, id)=1)")
    return ", ".join(steps) + f" SELECT image_id, t AS attempt, c, x::DOUBLE AS cx, y::DOUBLE AS cy, z::DOUBLE AS cz FROM k{k - 1}"


@query(f"WITH {_P}, {_COLOURFUL}, {_starts_sql(6, 5)}")
def palette_starts(spark, d):
    """First centres of five tries for the dominant colours of every image."""
    return palette.plus_starts(_coloured(spark, d), 6, 5).select("image_id", F.col("attempt").cast("long").alias("attempt"), "c", "cx", "cy", "cz")


@query(f"WITH {_P}, {_COLOURFUL} SELECT image_id, true AS no_worse FROM f GROUP BY 1")
def palette_tries(spark, d):
    """Whether the best of five tries is no worse than from spread starts, for every image."""
    _, _, inertia = palette.best_of_tries(_coloured(spark, d), 6, PALETTE_ROUNDS)
    spread = F.min(F.when(F.col("attempt") == -1, F.col("inertia")))
    return inertia.groupBy("image_id").agg((F.min("inertia") <= spread).alias("no_worse"))


@query()
def dominant_colors_kmeans(spark, d):
    return palette.kmeans(_samples(spark, d))


_HEX = "printf('#%02X%02X%02X', {}, {}, {})"


@query(f"SELECT c_custkey AS palette_id, {_HEX.format('(c_custkey*7)%256', '(c_custkey*13)%256', '(c_custkey*29)%256')} AS hex, {_HEX.format('(c_custkey*7)%256', '(c_custkey*13)%256', '(c_custkey*29)%256')} AS back FROM customer")
def hex_roundtrip(spark, d):
    p = palettes(spark, d).withColumn("hex", S.rgb_hex((F.col("palette_id") * 7) % 256, (F.col("palette_id") * 13) % 256, (F.col("palette_id") * 29) % 256))
    return p.select("palette_id", "hex", S.hsv_hex(*S.hsv(*[S.channel("hex", i) for i in range(3)])).alias("back"))


_B = "palettes0 AS (SELECT c_custkey AS project_id, [{}] AS hexes FROM customer)"


def _bases(spark, d):
    k = F.col("palette_id")
    hexes = F.array(*[S.rgb_hex((k * a) % 256, (k * b) % 256, (k * c) % 256) for a, b, c in ((7, 13, 29), (3, 31, 17), (11, 5, 23))])
    return palettes(spark, d).select(k.alias("project_id"), hexes.alias("hexes"))


def _suggested_sql() -> str:
    ks = ((7, 13, 29), (3, 31, 17), (11, 5, 23))
    base = "WITH b AS (" + " UNION ALL ".join(f"SELECT c_custkey AS project_id, {i} AS bi, (c_custkey*{a})%256/255.0::DOUBLE AS r, (c_custkey*{b})%256/255.0::DOUBLE AS g, (c_custkey*{c})%256/255.0::DOUBLE AS bl FROM customer" for i, (a, b, c) in enumerate(ks)) + ")"
    hsv = "h AS (SELECT *, greatest(r,g,bl) AS mx, greatest(r,g,bl)-least(r,g,bl) AS sp FROM b), k AS (SELECT project_id, bi, mx AS v, CASE WHEN mx=0 THEN 0.0 ELSE sp/mx END AS s, (CASE WHEN sp=0 THEN 0.0::DOUBLE WHEN mx=r THEN (g-bl)/sp WHEN mx=g THEN 2.0+(bl-r)/sp ELSE 4.0+(r-g)/sp END)/6.0 AS h6 FROM h), kk AS (SELECT *, h6-floor(h6) AS hh FROM k)"
    rules = "u(name, shifts, sat, val) AS (VALUES ('Análoga', [-1/24.0::DOUBLE, 0.0::DOUBLE, 1/24.0::DOUBLE], 0.9::DOUBLE, 1.05::DOUBLE), ('Complementaria', [0.0::DOUBLE, 0.5::DOUBLE], 1.0::DOUBLE, 1.0::DOUBLE), ('Triádica', [0.0::DOUBLE, 1/3.0::DOUBLE, 2/3.0::DOUBLE], 0.95::DOUBLE, 1.0::DOUBLE))"
    mix = "j0 AS (SELECT *, hh+shifts[i%len(shifts)+1] AS hs FROM kk, u, range(0, 12) r(i) WHERE bi=i%3), j AS (SELECT project_id, name, i+1 AS number, hs-floor(hs) AS h, greatest(0.0, least(s*sat, 1.0)) AS s, greatest(0.0, least(v*val, 1.0)) AS v FROM j0), w AS (SELECT *, CAST(floor(h*6) AS BIGINT)%6 AS o, h*6-floor(h*6) AS f FROM j), x AS (SELECT *, v*(1-s) AS p, v*(1-s*f) AS q, v*(1-s*(1-f)) AS t FROM w)"
    pick = lambda *x: f"CAST(round_even(([{','.join(x)}])[o+1]*255, 0) AS INT)"
    return f"{base}, {hsv}, {rules}, {mix} SELECT project_id, name, number, printf('#%02X%02X%02X', {pick('v', 'q', 'p', 'p', 't', 'v')}, {pick('t', 'v', 'v', 'q', 'p', 'p')}, {pick('p', 'p', 't', 'v', 'v', 'q')}) AS hex FROM x"


@query(_suggested_sql())
def palette_suggested(spark, d):
    return palette.suggested(_bases(spark, d), 12)


_CUR = "cur AS (SELECT c_custkey AS project_id, CAST(g AS BIGINT) AS number, printf('#%02X%02X%02X', (c_custkey*g)%256, (c_custkey*7+g)%256, (g*31)%256) AS hex FROM customer, range(1, 6) r(g) WHERE (c_custkey+g)%3>0), fb AS (SELECT c_custkey AS project_id, CAST(g AS BIGINT) AS number, printf('#%02X%02X%02X', (g*50)%256, c_custkey%256, 9) AS hex FROM customer, range(3, 8) r(g) WHERE (c_custkey*g)%4>0), wt AS (SELECT c_custkey AS project_id, CAST(g AS BIGINT) AS number FROM customer, range(1, 7) r(g))"


def _palette_parts(spark, d):
    p, k = palettes(spark, d).select(F.col("palette_id").alias("project_id")), F.col("project_id")
    g = lambda a, b: p.withColumn("number", F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"))))
    n = F.col("number")
    current = g(1, 5).where((k + n) % 3 > 0).withColumn("hex", S.rgb_hex((k * n) % 256, (k * 7 + n) % 256, (n * 31) % 256))
    fallback = g(3, 7).where((k * n) % 4 > 0).withColumn("hex", S.rgb_hex((n * 50) % 256, k % 256, F.lit(9)))
    return g(1, 6), current, fallback


@query(f"WITH {_CUR}, k AS (SELECT project_id, number FROM wt UNION SELECT project_id, number FROM cur UNION SELECT project_id, number FROM fb) SELECT k.project_id, k.number, coalesce(cur.hex, fb.hex, '#B8B8B8') AS hex FROM k LEFT JOIN cur USING (project_id, number) LEFT JOIN fb USING (project_id, number)")
def palette_defaults(spark, d):
    return palette.with_defaults(*_palette_parts(spark, d))


@query(f"WITH {_CUR} SELECT wt.project_id, wt.number, coalesce(cur.hex, (['#d86f45','#3f8f87','#f2bd4b','#8f6cc9','#4d86c6','#7fb069','#d95d8c','#52615a'])[(wt.number-1)%8+1]) AS hex FROM wt LEFT JOIN cur USING (project_id, number)")
def palette_complete(spark, d):
    wanted, current, _ = _palette_parts(spark, d)
    return palette.completed(wanted.withColumn("i", F.col("number") - 1), current)


@query("SELECT c_custkey AS palette_id, CASE WHEN c_custkey%13=0 OR c_custkey%33=c_custkey%13 THEN '' WHEN c_custkey%33<c_custkey%13 THEN 'La paleta tiene '||(c_custkey%33)||' colores y este proyecto usa '||(c_custkey%13)||' numeros. Se aplica igual; los numeros sin color conservan el color actual.' ELSE 'La paleta tiene '||(c_custkey%33)||' colores y este proyecto usa '||(c_custkey%13)||' numeros. Se aplica igual; los colores sobrantes no se usan.' END AS message FROM customer")
def palette_mismatch(spark, d):
    return palettes(spark, d).withColumn("used", F.col("palette_id") % 13).select("palette_id", palette.mismatch("num_colors", "used").alias("message"))


@query("SELECT c_custkey AS palette_id, CASE WHEN regexp_matches(trim(v), '^#[0-9A-Fa-f]{6}$') THEN upper(trim(v)) ELSE '#B8B8B8' END AS hex FROM (SELECT c_custkey, CASE c_custkey%4 WHEN 0 THEN '#12g456' WHEN 1 THEN ' #abcdef ' WHEN 2 THEN '' ELSE printf('#%06x', c_custkey*977) END AS v FROM customer)")
def hex_validation(spark, d):
    k = F.col("palette_id")
    v = F.when(k % 4 == 0, "#12g456").when(k % 4 == 1, " #abcdef ").when(k % 4 == 2, "").otherwise(F.format_string("#%06x", k * 977))
    return palettes(spark, d).select("palette_id", S.valid_hex(v).alias("hex"))


@query("SELECT c_custkey AS palette_id, c_name AS name, '2024-01-'||printf('%02d', 1+c_custkey%28)||'T00:00:00.000Z' AS created_at FROM customer ORDER BY 3 DESC, 1")
def palette_list(spark, d):
    """All saved palettes, newest first; their times are texts that sort like times."""
    day = F.format_string("2024-01-%02dT00:00:00.000Z", 1 + F.col("palette_id") % 28)
    return palettes(spark, d).select("palette_id", "name", day.alias("created_at")).orderBy(F.desc("created_at"), "palette_id")


@query("SELECT c_custkey AS palette_id, coalesce(trim(c_name)<>'' AND c_custkey%33 BETWEEN 1 AND 30, false) AND c_custkey%5<>0 AS valid FROM customer")
def palette_validate(spark, d):
    colors = F.when(F.col("palette_id") % 5 != 0, F.create_map(F.lit("1"), F.lit("#000000")))
    return palettes(spark, d).withColumn("colors", colors).select("palette_id", edits.valid_palette().alias("valid"))


_VERS = "v AS (SELECT user_id AS project_id, event_id AS version, event_type AS mode, ts AS updated_at, props AS palette_json, value AS detail, event_id%37 AS num_colors FROM events)"


@query(f"WITH {_VERS} SELECT project_id, version, mode FROM v ORDER BY updated_at DESC, version DESC LIMIT 1")
def latest_project(spark, d):
    return edits.latest(projects(spark, d)).select("project_id", "version", "mode")


@query(f"WITH {_VERS} SELECT project_id, version, mode FROM v QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, version DESC)=2")
def project_undo(spark, d):
    return edits.newest(projects(spark, d), 2).select("project_id", "version", "mode")


@query(f"WITH {_VERS}, s AS (SELECT project_id, arg_min(mode, version) AS mode, min(updated_at) AS created_at, min(updated_at) AS updated_at FROM v WHERE version%3=0 GROUP BY 1), i AS (SELECT project_id, arg_max(mode, version) AS mode, max(updated_at) AS updated_at FROM v WHERE version%3=1 GROUP BY 1) SELECT coalesce(i.project_id, s.project_id) AS project_id, CASE WHEN i.project_id IS NOT NULL THEN i.mode ELSE s.mode END AS mode, coalesce(s.created_at, i.updated_at) AS created_at, coalesce(i.updated_at, s.updated_at) AS updated_at, CASE WHEN s.project_id IS NULL THEN 'insert' WHEN i.project_id IS NULL THEN 'keep' ELSE 'update' END AS action FROM s FULL JOIN i ON s.project_id=i.project_id")
def project_upsert(spark, d):
    v = projects(spark, d)
    stored = v.where("version % 3 = 0").groupBy("project_id").agg(F.min_by("mode", "version").alias("mode"), F.min("updated_at").alias("created_at"), F.min("updated_at").alias("updated_at"))
    incoming = v.where("version % 3 = 1").groupBy("project_id").agg(F.max_by("mode", "version").alias("mode"), F.max("updated_at").alias("updated_at"))
    return edits.upsert(stored, incoming)


@query("SELECT event_id AS version, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS VARCHAR), '') AS k FROM events")
def project_json(spark, d):
    return projects(spark, d).select("version", F.coalesce(edits.json_map("palette_json")["k"], F.lit("")).alias("k"))


@query(f"WITH {_VERS} SELECT version, coalesce(mode<>'' AND num_colors BETWEEN 1 AND 30 AND detail BETWEEN 0.0 AND 1.0 AND palette_json IS NOT NULL AND version%6<>0, false) AS valid FROM v")
def project_validate(spark, d):
    p = projects(spark, d).withColumn("geojson", F.when(F.col("version") % 6 != 0, F.lit("{}")))
    return p.select("version", edits.valid_project().alias("valid"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark, d):
    return read(spark, d, "pages").select("page_id", S.html_escape("html").alias("escaped"))
