"""Edits of zones (merge, split) and of projects (versions, newest, upsert, undo, validation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars as S
from ..sources.committed import commit
from . import palette, polygons, shapes

CONFIRM_BELOW, MIN_PART = 0.2, 1.0


def merge_rules(pairs: DataFrame, keep: Column | None = None) -> DataFrame:
    """For pairs (image_id, src, dst, area1, num1, area2, num2): does the merge need an answer, and which zone stays.

    A clear difference of areas, or one number on both, lets the larger zone win (the first if equal); otherwise the
    wanted zone stays, and without a wish there is nothing to keep yet.
    """
    larger = F.greatest("area1", "area2")
    apart = F.when(larger > 0, F.abs(F.col("area1") - F.col("area2")) / larger).otherwise(0.0)
    asks = (F.col("num1") != F.col("num2")) & (apart < CONFIRM_BELOW)
    winner = F.when(F.col("area1") >= F.col("area2"), F.col("src")).otherwise(F.col("dst"))
    wish = keep if keep is not None else F.lit(None).cast("long")
    return pairs.withColumns({"needs_confirmation": asks, "kept_from_id": F.when(~asks, winner).when(wish.isin(F.col("src"), F.col("dst")), wish)})


def merged_zones(zones: DataFrame, pairs: DataFrame) -> DataFrame:
    """Zones after one merge an image (pairs: image_id, src, dst, kept_from_id): the result stands where the first of
    both stood, has the kept zone's number and both areas, and ids are dealt anew."""
    j = zones.join(pairs.select("image_id", "src", "dst", "kept_from_id"), "image_id", "left")
    part = F.col("zone_id").isin(F.col("src"), F.col("dst")) & F.col("src").isNotNull()
    key = F.when(F.coalesce(part, F.lit(False)), F.least("src", "dst")).otherwise(F.col("zone_id"))
    own = (~F.coalesce(part, F.lit(False))) | (F.col("zone_id") == F.col("kept_from_id"))
    g = j.groupBy("image_id", key.alias("pos")).agg(F.sum("area_px").alias("area_px"), F.max(F.when(own, F.col("num"))).alias("num"), F.count(F.lit(1)).alias("parts"))
    return g.select("image_id", F.row_number().over(Window.partitionBy("image_id").orderBy("pos")).cast("long").alias("zone_id"), F.col("pos").alias("was"), "area_px", "num", "parts")


def split_boxes(cuts: DataFrame) -> DataFrame:
    """Boxes cut by an upright line x = cut_x: status, and the areas of the larger part (keeps its place) and the
    smaller (comes last, id max + 1). Parts of one pixel or less don't count."""
    left = F.greatest(F.lit(0), F.least(F.col("w"), F.col("cut_x") - F.col("x0"))) * F.col("h")
    right = F.col("w") * F.col("h") - left
    good = (left > MIN_PART) & (right > MIN_PART)
    new_id = F.max("zone_id").over(Window.partitionBy("image_id")) + 1
    return cuts.select("image_id", "zone_id", "num", F.when(good, "split").otherwise("not_split").alias("status"), F.when(good, F.greatest(left, right)).alias("kept_area"), F.when(good, F.least(left, right)).alias("new_area"), F.when(good, new_id).alias("new_id"))


def newest(versions: DataFrame, n: int = 1) -> DataFrame:
    """The n-th newest version of each project; 2 is what an undo goes back to."""
    order = Window.partitionBy("project_id").orderBy(F.desc("updated_at"), F.desc("version"))
    return versions.withColumn("rn", F.row_number().over(order)).where(F.col("rn") == n).drop("rn")


def latest(versions: DataFrame) -> DataFrame:
    return versions.orderBy(F.desc("updated_at"), F.desc("version")).limit(1)


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace stored ones of the same project but keep their created_at; others are inserted."""
    s, i = stored.alias("s"), incoming.alias("i")
    c = F.col
    return s.join(i, c("s.project_id") == c("i.project_id"), "full").select(
        F.coalesce("i.project_id", "s.project_id").alias("project_id"), F.when(c("i.project_id").isNotNull(), c("i.mode")).otherwise(c("s.mode")).alias("mode"),
        F.coalesce("s.created_at", "i.updated_at").alias("created_at"), F.coalesce("i.updated_at", "s.updated_at").alias("updated_at"),
        F.when(c("s.project_id").isNull(), "insert").when(c("i.project_id").isNull(), "keep").otherwise("update").alias("action"),
    )


def valid_project() -> Column:
    """A project can be saved: id, mode, 1 to 30 colours, detail 0 to 1, zones and palette present."""
    return F.coalesce((F.col("project_id").cast("string") != "") & F.col("geojson").isNotNull() & (F.col("mode") != "") & F.col("num_colors").between(1, 30) & F.col("detail").between(0.0, 1.0) & F.col("palette_json").isNotNull(), F.lit(False))


def valid_palette() -> Column:
    """A palette can be saved: a name, 1 to 30 colours, and colours that are an object (map, or JSON text of one)."""
    return F.coalesce((F.trim("name") != "") & F.col("num_colors").between(1, 30) & F.col("colors").isNotNull(), F.lit(False))


def json_map(text: str) -> Column:
    """A map from JSON text; empty where it can't be read."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


# --- edits of rings, with what can be wrong about them

#: What a refused edit says.
TWO_ZONES = "Se deben fusionar exactamente dos zonas distintas."
UNKNOWN_MERGE, UNKNOWN_SPLIT = "Zona inexistente para fusionar.", "Zona inexistente para dividir."
NO_GEOMETRY = "Zona %s no tiene geometria valida."
NOT_CONTIGUOUS = "Las zonas elegidas no forman una region continua. Elegi dos zonas vecinas."
NEEDS_CHOICE = "La fusion requiere confirmar que color conservar."
WRONG_CHOICE = "keep_zone_id debe ser una de las zonas a fusionar."
SHORT_LINE, SAME_POINTS = "La linea de division necesita al menos dos puntos.", "La linea de division necesita puntos distintos."
NO_CUT, MANY_CUTS = "La linea no dividio la zona. Traza una linea que cruce la region.", "La linea genero mas de dos piezas. Traza una linea simple."
TOO_SMALL = "La geometria resultante es demasiado pequena."
NO_PROJECT = "project_id not found"


def _first(*rules: tuple[Column, Column | str]) -> Column:
    """The message of the first rule that holds; null if none does."""
    out = None
    for when, text in rules:
        out = F.when(when, text) if out is None else out.when(when, text)
    return out


def merge_answers(zones: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers to merges (image_id, ids, keep): status 200 and the merged ring, or `requires_confirmation`, or status 400
    and the reason. Ids are a list; two different ones that exist are wanted, whose union must be one part."""
    asked = requests.select("image_id", F.explode("ids").alias("zone_id")).distinct()  # rings of these alone are repaired
    z = zones.join(asked, ["image_id", "zone_id"], "left_semi").select("image_id", "zone_id", "num", shapes.single("polygon").alias("ring"))
    z = scratch.materialize(z, "asked")
    r = requests.withColumns({"id1": F.get("ids", F.lit(0)), "id2": F.get("ids", F.lit(1)), "two": F.coalesce((F.size("ids") == 2) & (F.size(F.array_distinct("ids")) == 2), F.lit(False))})
    for i in ("1", "2"):
        r = r.join(z.withColumnsRenamed({"zone_id": f"id{i}", "num": f"num{i}", "ring": f"ring{i}"}).withColumn(f"has{i}", F.lit(True)), ["image_id", f"id{i}"], "left")
    r = r.withColumn("parts", F.when(F.col("two"), shapes.union_parts("ring1", "ring2")))
    r = scratch.materialize(r, "merges")
    area1, area2 = shapes.ring_area(F.col("ring1")), shapes.ring_area(F.col("ring2"))
    larger = F.greatest(area1, area2)
    apart = F.when(larger > 0, F.abs(area1 - area2) / larger).otherwise(0.0)
    asks = (F.col("num1") != F.col("num2")) & (apart < CONFIRM_BELOW)
    wish = F.col("keep").isin(F.col("id1"), F.col("id2"))
    error = _first(
        (~F.col("two"), TWO_ZONES), (F.col("has1").isNull() | F.col("has2").isNull(), UNKNOWN_MERGE),
        (F.col("ring1").isNull(), F.format_string(NO_GEOMETRY, F.col("id1").cast("string"))), (F.col("ring2").isNull(), F.format_string(NO_GEOMETRY, F.col("id2").cast("string"))),
        (F.size("parts") != 1, NOT_CONTIGUOUS), (asks & F.col("keep").isNotNull() & ~wish, WRONG_CHOICE),
    )
    kept = F.when(~asks, F.when(area1 >= area2, F.col("id1")).otherwise(F.col("id2"))).when(wish, F.col("keep"))
    r = r.withColumns({"error": error, "asks": asks & F.col("keep").isNull(), "kept": kept})
    good = F.col("error").isNull()
    return r.select("image_id", "ids", F.when(good, 200).otherwise(400).alias("status"), "error", F.coalesce(good & F.col("asks"), F.lit(False)).alias("requires_confirmation"), F.when(good, F.col("kept")).alias("kept_from_id"), F.when(good & F.col("kept").isNotNull(), F.get("parts", F.lit(0))).alias("ring"))


def merged_rings(zones: DataFrame, answers: DataFrame) -> DataFrame:
    """Zones after the merges that were answered with a ring, one an image: it stands where the first of both stood, with
    the kept zone's number; ids are dealt anew."""
    a = answers.where(F.col("ring").isNotNull()).select("image_id", "ids", "kept_from_id", "ring")
    j = zones.join(a, "image_id", "left")
    part = F.coalesce(F.array_contains("ids", F.col("zone_id")), F.lit(False))
    own = shapes.from_ring(F.col("ring"))
    carried = [c for c in ("num", "source", "parent", "mask_index", "requires_manual_color") if c in zones.columns]
    plain = ["polygon", "area_px", "x0", "y0", "w", "h"]
    new = j.where(part & (F.col("zone_id") == F.col("kept_from_id"))).select("image_id", F.array_min("ids").alias("was"), *[own[c].cast(zones.schema[c].dataType).alias(c) for c in plain], *carried)
    old = j.where(~part).select("image_id", F.col("zone_id").alias("was"), *plain, *carried)
    order = Window.partitionBy("image_id").orderBy("was")
    return old.union(new).select("image_id", F.row_number().over(order).cast("long").alias("zone_id"), "was", *plain, *carried)


def split_answers(zones: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers to splits (image_id, zone_id, line: array of points): status 200 and two rings, the larger first, or 400
    and the reason. The line goes on at both ends by three times the zone's longer side."""
    asked = requests.select("image_id", "zone_id").distinct()
    z = zones.join(asked, ["image_id", "zone_id"], "left_semi").select("image_id", "zone_id", shapes.single("polygon").alias("own"))
    r = requests.join(z.withColumn("has", F.lit(True)), ["image_id", "zone_id"], "left")
    span = lambda k: F.array_max(F.transform("own", lambda p: p[k])) - F.array_min(F.transform("own", lambda p: p[k]))
    r = r.withColumn("long", polygons.extended_line("line", 3.0 * F.greatest(span("x"), span("y"), F.lit(1.0))))
    n = F.size("line")
    apart = lambda a, b: F.hypot(F.get("line", a)["x"] - F.get("line", b)["x"], F.get("line", a)["y"] - F.get("line", b)["y"])
    same = (apart(F.lit(0), F.lit(1)) < 0.001) | (apart(n - 1, n - 2) < 0.001)
    r = r.withColumn("pieces", F.when(F.col("own").isNotNull() & (n >= 2), shapes.cut_parts("own", "long")))
    r = scratch.materialize(r.withColumns({"n": n, "same": same}), "splits")
    whole = lambda i: F.size(S.deduped(F.transform(F.get("pieces", F.lit(i)), lambda p: F.struct(F.rint(p["x"]).alias("x"), F.rint(p["y"]).alias("y")))))
    error = _first(
        (F.col("has").isNull(), UNKNOWN_SPLIT), (F.col("own").isNull(), F.format_string(NO_GEOMETRY, F.col("zone_id").cast("string"))), (F.coalesce(F.col("n"), F.lit(0)) < 2, SHORT_LINE), (F.col("same"), SAME_POINTS),
        (F.size("pieces") < 2, NO_CUT), (F.size("pieces") > 2, MANY_CUTS), ((whole(0) < 3) | (whole(1) < 3), TOO_SMALL),
    )
    r = r.withColumn("error", error)
    good = F.col("error").isNull()
    return r.select("image_id", "zone_id", F.when(good, 200).otherwise(400).alias("status"), "error", *[F.when(good, F.get("pieces", F.lit(i))).alias(name) for i, name in enumerate(("kept_ring", "new_ring"))])


def split_rings(zones: DataFrame, answers: DataFrame) -> DataFrame:
    """Zones after the splits that went well, one an image: the larger piece keeps its place, the smaller comes last."""
    a = answers.where("status = 200").select("image_id", F.col("zone_id").alias("cut"), "kept_ring", "new_ring")
    j = zones.join(a, "image_id", "left")
    carried = [c for c in ("num", "source", "parent", "mask_index", "requires_manual_color") if c in zones.columns]
    plain = ["polygon", "area_px", "x0", "y0", "w", "h"]
    hit = F.coalesce(F.col("zone_id") == F.col("cut"), F.lit(False))
    made = lambda ring: [shapes.from_ring(F.col(ring))[c].cast(zones.schema[c].dataType).alias(c) for c in plain]
    rows = j.where(~hit).select("image_id", F.col("zone_id").alias("was"), F.lit(0).alias("last"), *plain, *carried)
    for i, ring in enumerate(("kept_ring", "new_ring")):
        rows = rows.union(j.where(hit).select("image_id", F.col("zone_id").alias("was"), F.lit(i).alias("last"), *made(ring), *carried))
    order = Window.partitionBy("image_id").orderBy("last", "was")
    return rows.select("image_id", F.row_number().over(order).cast("long").alias("zone_id"), F.when(F.col("last") == 0, F.col("was")).alias("was"), *plain, *carried)


# --- requests, projects and palettes


def request_errors() -> Column:
    """What is wrong with a segmentation request (mode, num_colors, detail_level, num_zones, min_zone_area_px), as a list."""
    outside = lambda c, low, high: F.when(F.col(c).isNotNull() & ~F.col(c).between(low, high), c)
    found = F.array(F.when(~F.coalesce(F.col("mode").isin("color", "bw"), F.lit(False)), "mode"), outside("num_colors", 1, 30), outside("detail_level", 0.0, 1.0), outside("num_zones", 1, 256), F.when(F.col("min_zone_area_px") < 1, "min_zone_area_px"))
    return F.array_compact(found)


def looked_up(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Requests (project_id) with the newest version of their project: status 404 and a reason where there is none."""
    own = newest(projects).withColumn("known", F.lit(True))
    j = requests.join(own, "project_id", "left")
    return j.withColumns({"status": F.when(F.col("known"), 200).otherwise(404), "error": F.when(F.col("known").isNull(), NO_PROJECT)}).drop("known")


def palette_chain(active: str, originals: str) -> Column:
    """The active palette (map) unless it is missing or empty, else the first original one (array of name, colors), else an empty one."""
    none = F.create_map().cast("map<string,string>")
    filled = F.when(F.size(active) > 0, F.col(active))
    return F.coalesce(filled, F.get(originals, F.lit(0))["colors"], none)


def palettes_after_edit(active: str, originals: str) -> Column:
    """The palettes that an edited project offers: the active one, then the originals."""
    own = F.array(F.struct(F.lit(palette.CURRENT).alias("name"), F.col(active).alias("colors")))
    return F.concat(own, F.coalesce(originals, F.array().cast("array<struct<name:string,colors:map<string,string>>>")))


def rebuilt(versions: DataFrame, zones: DataFrame, width: int, height: int, at: Column) -> DataFrame:
    """The next version of each project whose zones (image_id is its project_id) were edited: texts and palettes made
    anew, the time given by `at`."""
    from . import render

    now = newest(versions)
    svg = render.svg_documents(zones, width, height).withColumnRenamed("image_id", "project_id")
    geo = render.feature_collections(zones, width, height, "color").withColumnRenamed("image_id", "project_id")
    j = now.join(svg, "project_id").join(geo, "project_id")
    return j.select("project_id", (F.col("version") + 1).alias("version"), "mode", S.iso_time(at).alias("updated_at"), F.col("svg").alias("zones_svg"), F.col("geojson").alias("zones_geojson"), palettes_after_edit("palette", "originals").alias("palettes"))


def with_snapshot(versions: DataFrame, edits: DataFrame) -> DataFrame:
    """All versions with an edit (project_id and the columns that change) as the newest: what was newest is its snapshot."""
    now = newest(versions)
    changed = [c for c in edits.columns if c != "project_id"]
    j = now.drop(*changed).join(edits, "project_id").withColumn("version", F.col("version") + 1)
    return versions.unionByName(j.select(*versions.columns))


def undone(versions: DataFrame) -> DataFrame:
    """All versions without the newest of each project that has an older one."""
    w = Window.partitionBy("project_id")
    v = versions.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("updated_at"), F.desc("version"))), "n": F.count(F.lit(1)).over(w)})
    return v.where("rn > 1 OR n = 1").drop("rn", "n")


def with_columns(table: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """A stored table with the columns that older ones lack: name to (type, default)."""
    return table.withColumns({n: F.lit(v).cast(t) for n, (t, v) in wanted.items() if n not in table.columns})


def restored(versions: DataFrame) -> DataFrame:
    """The project that a page shows again: the newest of all, with its palette as a map, defaults for what it lacks, and no suggestions."""
    p = latest(versions).withColumn("palette", json_map("palette_json"))
    return p.select("project_id", "mode", F.coalesce("num_colors", F.nullif(F.size("palette"), F.lit(0)), F.lit(S.DEFAULT_COLORS)).alias("num_colors"), F.coalesce("detail", F.lit(S.DEFAULT_DETAIL)).alias("detail_level"), "palette")


def append_palettes(palettes: DataFrame, path: str, at: Column, job: str | None = None) -> None:
    """Stores valid palettes (palette_id, name, num_colors, colors: map) beside those that are there. With a job's name they
    are stored once, however often it is tried (read them by `committed`); without one each call adds rows."""
    rows = palettes.where(valid_palette()).select("palette_id", F.trim("name").alias("name"), "num_colors", F.col("num_colors").alias("num_zones"), F.to_json("colors").alias("colors_json"), S.iso_time(at).alias("created_at"))
    if job is None:
        rows.write.mode("append").parquet(path)
    else:
        commit(rows, path, job)


def export_headers(project_id: str, seconds: str) -> dict[str, Column]:
    """Names of an exported document: the file after the first eight characters of the project, and how long it took."""
    name = F.concat(F.lit("paint-"), F.substring(F.col(project_id).cast("string"), 1, 8), F.lit(".pdf"))
    return {"content_disposition": F.concat(F.lit('attachment; filename="'), name, F.lit('"')), "generation_seconds": F.round(seconds, 4).cast("string")}


def slow_runs(runs: DataFrame, limit: float = 10.0, fail: bool = False) -> DataFrame:
    """Runs (seconds) at or over the limit; with `fail` reading them is an error."""
    slow = runs.where(F.col("seconds") >= limit)
    return slow.withColumn("seconds", F.when(F.lit(fail), F.raise_error(F.format_string("a run took %.1f seconds", "seconds")).cast("double")).otherwise(F.col("seconds"))) if fail else slow
