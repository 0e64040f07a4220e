"""Dominant colours, suggested palettes, completion of palettes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars as S
from . import numbering

#: Name, hue shifts, saturation and value factors of the suggested palettes; the cycle of stand-in colours.
SUGGESTED = [("Análoga", [-1 / 24, 0.0, 1 / 24], 0.9, 1.05), ("Complementaria", [0.0, 0.5], 1.0, 1.0), ("Triádica", [0.0, 1 / 3, 2 / 3], 0.95, 1.0)]
STAND_INS = ["#d86f45", "#3f8f87", "#f2bd4b", "#8f6cc9", "#4d86c6", "#7fb069", "#d95d8c", "#52615a"]
#: What is said of a palette of another size.
FEWER = "La paleta tiene %d colores y este proyecto usa %d numeros. Se aplica igual; los numeros sin color conservan el color actual."
MORE = "La paleta tiene %d colores y este proyecto usa %d numeros. Se aplica igual; los colores sobrantes no se usan."
#: Most dominant colours, pixels that they take, saturation and value of stand-ins.
CENTRES, LEAST_PIXELS, SEED_SV = 8, 50, (0.55, 0.82)
#: Names and colours that are shown.
PLAIN, WHITE, CURRENT = "Paleta editada", "#ffffff", "Paleta actual"


def kmeans(samples: DataFrame, k: int = CENTRES, rounds: int = 20, seed: int = 7) -> DataFrame:
    """Spark's distributed k-means on the same samples: c, cx, cy, cz, n."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=["x", "y", "z"], outputCol="v").transform(samples)
    model = KMeans(k=k, maxIter=rounds, seed=seed, featuresCol="v", predictionCol="c").fit(v)
    found = samples.sparkSession.createDataFrame([(i, *map(float, m)) for i, m in enumerate(model.clusterCenters())], "c int, cx double, cy double, cz double")  # k rows
    return found.join(model.transform(v).groupBy("c").agg(F.count(F.lit(1)).alias("n")), "c", "left")


def _centre(c: Column | str, n: Column) -> list[Column]:
    as_double = lambda k: F.col(k).cast("double").alias(f"c{k}")
    return [(F.col(c) if isinstance(c, str) else c).cast("int").alias("c"), *[as_double(k) for k in "xyz"], n.cast("long").alias("n")]


def spread_starts(samples: DataFrame, k: int | str) -> DataFrame:
    """First centres (image_id, c, cx, cy, cz, n): the samples at the middle of k equal parts in order of (x, y, z, id), or
    all where there are fewer than k."""
    w = Window.partitionBy("image_id")
    s = samples.withColumns({"_i": F.row_number().over(w.orderBy("x", "y", "z", "id")) - 1, "_n": F.count(F.lit(1)).over(w)})
    part = F.least(F.col(k) if isinstance(k, str) else F.lit(k), F.col("_n"))
    c = F.floor(F.col("_i") * part / F.col("_n"))
    middle = F.col("_i") == F.floor((2 * c + 1) * F.col("_n") / (2 * part))
    return s.where(middle).select("image_id", *_centre(c, F.lit(0)))


def _squared(p: Column) -> Column:
    return (F.col("x") - p["cx"]) ** 2 + (F.col("y") - p["cy"]) ** 2 + (F.col("z") - p["cz"]) ** 2


def _priority(step: int, attempt: int, chance: Column) -> Column:
    """A hashed exponential of the given rate: the least of an image is a draw in proportion to the rates."""
    digits = F.substring(F.md5(F.concat_ws("-", "image_id", "id", F.lit(attempt), F.lit(step))), 1, 8)
    return -F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0) / chance


def plus_starts(samples: DataFrame, k: int, tries: int = 5) -> DataFrame:
    """First centres by weighted D-squared sampling, `tries` times apart: image_id, attempt, c, cx, cy, cz, n.

    The first centre of a try is drawn in proportion to the weights, each further one in proportion to weight times the
    squared distance to the nearest centre so far. Draws are hashed by image, sample, try and step, so they depend on
    nothing else. A step is one pass with one partial aggregate for all tries and images; samples aren't copied. Where all
    distances are 0 an image has fewer centres.
    """
    point = F.struct(*[F.col(c).cast("double").alias(f"c{c}") for c in "xyz"])
    chosen = None
    for step in range(k):
        picks = []
        s = samples if chosen is None else samples.join(chosen, "image_id")
        for t in range(tries):
            far = F.lit(1.0) if chosen is None else F.round(F.array_min(F.transform(f"_s{t}", _squared)), 6)
            rate = F.col("weight") * far
            picks.append(F.min_by(F.when(rate > 0, point), F.when(rate > 0, F.struct(_priority(step, t, rate).alias("p"), F.col("id").alias("i")))).alias(f"_p{t}"))
        drawn = s.groupBy("image_id").agg(*picks)
        if chosen is not None:
            drawn = drawn.join(chosen, "image_id")
        before = lambda t, first=chosen is None: F.array().cast("array<struct<cx:double,cy:double,cz:double>>") if first else F.col(f"_s{t}")
        new = drawn.select("image_id", *[F.when(F.col(f"_p{t}").isNull(), before(t)).otherwise(F.array_append(before(t), F.col(f"_p{t}"))).alias(f"_s{t}") for t in range(tries)])
        chosen = scratch.materialize(new, "starts")
    every = F.explode(F.array(*[F.struct(F.lit(t).alias("attempt"), F.col(f"_s{t}").alias("s")) for t in range(tries)])).alias("a")
    return chosen.select("image_id", every).select("image_id", "a.attempt", F.posexplode("a.s").alias("c", "p")).select("image_id", "attempt", "c", "p.cx", "p.cy", "p.cz", F.lit(0).cast("long").alias("n"))


def lloyd_by_image(samples: DataFrame, k: int | str, rounds: int, starts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """k-means apart for each image over samples (image_id, id, x, y, z, weight): the labelled samples (c) and the
    centres (image_id, c, cx, cy, cz, n: weight). k is a number, or the name of a column that is alike in an image.

    First centres are `starts` or, without it, spread_starts. A round joins an image's centres to its samples and adds up
    partial sums; it is a written table that also says which centres moved. The loop ends early only when none does any
    more, so results are those of all rounds.
    """
    s = scratch.Table(samples, "samples").df
    now = scratch.Table(spread_starts(s, k) if starts is None else starts.select("image_id", "c", "cx", "cy", "cz", "n"), "centres")

    def labelled(of: DataFrame) -> DataFrame:
        listed = of.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("c", "cx", "cy", "cz", "n"))).alias("_c"))
        best = F.array_min(F.transform("_c", lambda p: F.struct(F.round(_squared(p), 6).alias("d"), p["c"].alias("c"), p.alias("was"))))
        return s.join(listed, "image_id").withColumn("_b", best).drop("_c")

    mean = lambda v: F.round(F.sum(F.col(v) * F.col("weight")) / F.sum("weight"), 6).alias(f"c{v}")
    for _ in range(rounds):
        sums = labelled(now.df).groupBy("image_id", F.col("_b.c").alias("c")).agg(mean("x"), mean("y"), mean("z"), F.sum("weight").cast("long").alias("n"), F.any_value("_b.was").alias("_was"))
        moved = F.lit(False)
        for c in ("cx", "cy", "cz", "n"):
            moved = moved | (F.col(c) != F.col(f"_was.{c}"))
        new = scratch.Table(sums.withColumn("moved", moved).drop("_was"), "centres")
        now.free()
        now = new
        if now.df.where("moved").isEmpty():
            break
    return labelled(now.df).withColumn("c", F.col("_b.c")).drop("_b"), now.df.select("image_id", "c", "cx", "cy", "cz", "n")


def best_of_tries(samples: DataFrame, k: int, rounds: int, tries: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """k-means from several starts, the one of least inertia kept for each image: labelled samples, centres, and
    inertias (image_id, attempt, inertia). Attempt -1 starts from spread_starts, so no image ends worse than from there.

    All tries are one relation, keyed by image and attempt, and go through the same rounds.
    """
    s = scratch.materialize(samples, "samples")
    first = plus_starts(s, k, tries).unionByName(spread_starts(s, k).withColumn("attempt", F.lit(-1)))
    key = F.concat_ws("/", "image_id", "attempt")
    many = s.withColumn("attempt", F.explode(F.sequence(F.lit(-1), F.lit(tries - 1)))).withColumnRenamed("image_id", "_image").withColumn("image_id", F.concat_ws("/", "_image", "attempt"))
    found, centres = lloyd_by_image(many, k, rounds, first.withColumn("image_id", key))
    at = centres.withColumnsRenamed({"cx": "_x", "cy": "_y", "cz": "_z"}).drop("n")
    off = (F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2 + (F.col("z") - F.col("_z")) ** 2
    inertia = found.join(at, ["image_id", "c"]).groupBy(F.col("_image").alias("image_id"), "attempt").agg(F.round(F.sum(off * F.col("weight")), 3).alias("inertia"))
    inertia = scratch.materialize(inertia, "inertia")
    best = inertia.groupBy("image_id").agg(F.min_by("attempt", F.struct("inertia", "attempt")).alias("attempt"))
    best = scratch.materialize(best.withColumn("_key", key), "best")
    kept = found.drop("attempt").withColumnRenamed("image_id", "_key").join(best.select("_key"), "_key").drop("_key").withColumnRenamed("_image", "image_id")
    return kept, centres.withColumnRenamed("image_id", "_key").join(best.select("_key", "image_id"), "_key").drop("_key"), inertia


def dominant(pixels: DataFrame, count: int, rounds: int = 20) -> DataFrame:
    """image_id, i (from 0), hex: an image's dominant colours, most frequent first; images of fewer than LEAST_PIXELS
    colourful pixels get colours from their mean gray. At most CENTRES colours."""
    k = max(1, min(count, CENTRES))
    p = colourful(pixels)
    enough = p.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PIXELS).select("image_id")
    own = p.join(enough, "image_id").groupBy("image_id", "b", "g", "r").agg(F.count(F.lit(1)).alias("weight"))
    own = own.select("image_id", ((F.col("b") * 256 + F.col("g")) * 256 + F.col("r")).cast("long").alias("id"), F.col("b").alias("x"), F.col("g").alias("y"), F.col("r").alias("z"), "weight")
    _, centres = lloyd_by_image(own, k, rounds)
    ranked = centres.select("image_id", (F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "c")) - 1).alias("i"), S.rgb_hex(*[F.rint(c) for c in ("cz", "cy", "cx")]).alias("hex"))
    seeds = seed_hues(pixels).join(enough, "image_id", "left_anti").where(F.col("i") < k)
    return ranked.union(seeds.select("image_id", "i", S.hsv_hex("hue", F.lit(SEED_SV[0]), F.lit(SEED_SV[1])).alias("hex")))


def zone_numbers(zones: DataFrame, n: int, rounds: int = 30) -> DataFrame:
    """image_id, zone_id, num: numbers from the zones' colours (l8, a8, b8): clusters ranked by area, missing numbers
    dealt to large zones of numbers used more than once; zones of images without colours are numbered in turn."""
    known = zones.where(F.col("l8").isNotNull())
    s = known.select("image_id", F.col("zone_id").alias("id"), F.col("l8").alias("x"), F.col("a8").alias("y"), F.col("b8").alias("z"), F.lit(1).cast("long").alias("weight"), "area_px")
    found, _ = lloyd_by_image(s, n, rounds)
    found = scratch.materialize(found.select("image_id", F.col("id").alias("zone_id"), F.col("c").cast("long").alias("num"), F.greatest("area_px", F.lit(1)).alias("area_px")), "clusters")
    ranks = numbering.cluster_rank(found).select("image_id", "cluster", F.col("num").alias("new"))
    ranked = found.withColumnRenamed("num", "cluster").join(ranks, ["image_id", "cluster"]).select("image_id", "zone_id", F.col("new").alias("num"), "area_px")
    ranked = scratch.materialize(ranked, "ranked")
    moved = numbering.donors(ranked, n).select("image_id", "zone_id", "new")
    done = ranked.join(moved, ["image_id", "zone_id"], "left").select("image_id", "zone_id", F.coalesce("new", "num").alias("num"))
    turn = numbering.in_turn(zones.where(F.col("l8").isNull()), n)
    return done.union(turn)


def colourful(pixels: DataFrame) -> DataFrame:
    """Pixels with enough colour for a palette, by 8-bit saturation and value."""
    v, low = F.greatest("b", "g", "r"), F.least("b", "g", "r")
    p = pixels.withColumns({"v": v, "s": F.when(v > 0, F.rint(255 * (v - low) / v)).otherwise(0).cast("long")})
    return p.where((F.col("s") > 35) & (F.col("v") > 35) & (F.col("v") < 245))


def seed_hues(pixels: DataFrame) -> DataFrame:
    """Stand-in hues of each image from its mean gray: image_id, i, hue."""
    mean = pixels.groupBy("image_id").agg(F.avg(S.gray("b", "g", "r")).alias("gray"))
    offsets = F.posexplode(F.array(*[F.lit(x) for x in S.HUE_OFFSETS]))
    return mean.select("image_id", "gray", offsets.alias("i", "offset")).select("image_id", "i", F.pmod(0.58 + F.col("gray") / 255 * 0.22 + F.col("offset"), F.lit(1.0)).alias("hue"))


def suggested(bases: DataFrame, n: int) -> DataFrame:
    """From base colours (project_id, hexes ARRAY): project_id, name, number, hex for numbers 1..n of each palette."""
    spark = bases.sparkSession
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(SUGGESTED)], "p int, name string, shifts array<double>, sat double, val double")
    j = bases.join(F.broadcast(rules)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))  # three rows are joined
    base = F.element_at("hexes", F.col("i") % F.size("hexes") + 1)
    h, s, v = S.hsv(*[S.channel(base, c) for c in range(3)])
    shift = F.element_at("shifts", F.col("i") % F.size("shifts") + 1)
    return j.select("project_id", "name", (F.col("i") + 1).cast("long").alias("number"), S.hsv_hex(h + shift, s * F.col("sat"), v * F.col("val")).alias("hex"))


def with_defaults(wanted: DataFrame, current: DataFrame, fallback: DataFrame) -> DataFrame:
    """Every wanted, current or fallback number with its colour: current, else fallback, else gray. All: project_id, number, hex."""
    keys = reduce(DataFrame.union, [d.select("project_id", "number") for d in (wanted, current, fallback)]).distinct()
    on = ["project_id", "number"]
    j = keys.join(current.withColumnRenamed("hex", "h1"), on, "left").join(fallback.withColumnRenamed("hex", "h2"), on, "left")
    return j.select(*on, F.coalesce("h1", "h2", F.lit(S.GRAY)).alias("hex"))


def completed(numbers: DataFrame, current: DataFrame) -> DataFrame:
    """Numbers (project_id, number, i) with the current colour or one of a cycle of eight."""
    cycle = F.element_at(F.array(*[F.lit(x) for x in STAND_INS]), (F.col("i") % len(STAND_INS) + 1).cast("int"))
    return numbers.join(current, ["project_id", "number"], "left").select("project_id", "number", F.coalesce("hex", cycle).alias("hex"))


def mismatch(palette: str, used: str) -> Column:
    """What to say of a palette with another number of colours than a project uses."""
    p, c = F.col(palette), F.col(used)
    fewer = F.format_string(FEWER, p, c)
    more = F.format_string(MORE, p, c)
    return F.when((c == 0) | (p == c), "").when(p < c, fewer).otherwise(more)


def zone_colours(zones: DataFrame, palette: DataFrame) -> DataFrame:
    """Zones with the colour of their number (palette: image_id, num, hex); white where the palette lacks it."""
    return zones.join(palette, ["image_id", "num"], "left").select("image_id", "zone_id", "num", F.coalesce("hex", F.lit(WHITE)).alias("hex"))


def colour_ids(zones: DataFrame, palette: DataFrame, n: int) -> DataFrame:
    """image_id, pos, number (text): numbers 1..n, those of zones and of the palette, once each, in numeric order."""
    wanted = zones.select("image_id").distinct().withColumn("number", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("string"))))
    own = zones.select("image_id", F.col("num").cast("string").alias("number")).union(palette.select("image_id", F.col("num").cast("string")))
    return numeric_order(wanted.union(own).distinct())


def numeric_order(keys: DataFrame) -> DataFrame:
    """image_id, pos, number: keys of digits as numbers first, then the others as text."""
    w = Window.partitionBy("image_id").orderBy(S.sort_key("number"))
    return keys.select("image_id", F.row_number().over(w).cast("long").alias("pos"), "number")


def manual_numbers(zones: DataFrame) -> DataFrame:
    """image_id, pos, number: the distinct numbers of zones that need a colour by hand, in numeric order."""
    return numeric_order(zones.where("requires_manual_color").select("image_id", S.paint_number("num", "zone_id").alias("number")).distinct())


def with_colour(colors: str, number: Column, hex_color: Column) -> Column:
    """A palette (map) with one colour changed or added."""
    others = F.map_filter(colors, lambda k, _: k != number)
    return F.map_concat(others, F.create_map(number, S.valid_hex(hex_color)))


def map_defaults(wanted: Column, current: str, fallback: str) -> Column:
    """A palette (map) for all wanted numbers and those of both palettes, in numeric order: current, else fallback, else gray."""
    keys = F.array_distinct(F.concat(wanted, F.map_keys(current), F.map_keys(fallback)))
    ordered = F.transform(F.array_sort(F.transform(keys, lambda k: F.struct(S.sort_key(k).alias("s"), k.alias("k")))), lambda x: x["k"])
    return F.map_from_entries(F.transform(ordered, lambda k: F.struct(k.alias("key"), F.coalesce(F.try_element_at(F.col(current), k), F.try_element_at(F.col(fallback), k), F.lit(S.GRAY)).alias("value"))))
