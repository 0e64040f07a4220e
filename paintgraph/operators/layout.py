"""Labels on the drawing, the legend and the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars as S
from . import shapes

#: Points of a page, margins, rows and swatches of the legend.
PAGES = {"A4": (595.2755905511812, 841.8897637795277), "Letter": (612.0, 792.0)}
MARGIN, LEGEND_MARGIN, HEADER, ROW, SWATCH, SMALLEST_FONT, SHRINK = 36.0, 42.0, 34.0, 24.0, 14.0, 3.5, 0.9


def page_sizes(spark) -> DataFrame:
    rows = [(p, o, *(s if o == "portrait" else s[::-1])) for p, s in PAGES.items() for o in ("portrait", "landscape")]
    return spark.createDataFrame(rows, "paper string, orientation string, width double, height double")


def shrunk_font(font, text, clearance) -> tuple[Column, Column]:
    """The first of font, font * 0.9, ... down to 3.5 whose label fits the clearance, and the step; -1 if none does.

    The steps are a closed form, so no loop runs: their number is bounded by 28 * 0.9^20 < 3.5.
    """
    steps = F.sequence(F.lit(0), F.lit(20))
    size = lambda k: F.greatest(F.lit(SMALLEST_FONT), S._c(font) * F.pow(F.lit(SHRINK), k))
    fits = F.filter(steps, lambda k: S._c(clearance) + 0.001 >= S.label_radius(text, size(k)))
    step = F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(-1))
    return F.when(step >= 0, size(step)).otherwise(F.lit(SMALLEST_FONT)), step


def placements(zones: DataFrame) -> DataFrame:
    """Labels of boxes that aren't too small: the centre has the largest clearance, half the shorter side."""
    half = F.least("w", "h") / 2
    return labelled(zones.withColumns({"_x": F.col("x0") + F.col("w") / 2, "_y": F.col("y0") + F.col("h") / 2, "_own": half, "_px": F.col("x0") + F.col("w") / 2, "_py": F.col("y0") + F.col("h") / 2, "_pole": half}))


def ring_placements(zones: DataFrame, ring: str = "polygon") -> DataFrame:
    """Labels of general rings: at the interior point if the text fits there, else at the pole of inaccessibility.

    Zones are dealt out first: the pole is much work for few bytes."""
    z = scratch.dealt(zones, "image_id", "zone_id").withColumn("_p", shapes.label_places(ring))
    return labelled(z.withColumns({f"_{k}": F.col(f"_p.{k}") for k in ("x", "y", "own", "px", "py", "pole")}))


def labelled(z: DataFrame) -> DataFrame:
    """The cascade of places: the first point (_x, _y, clearance _own), then the pole (_px, _py, _pole) with the whole
    font, then with smaller ones, and at last the smallest font, too tight."""
    z = z.withColumns({"_text": F.col("num").cast("string"), "_font": S.label_font("area_px", "w", "h")})
    z = z.withColumn("_need", S.label_radius("_text", "_font"))
    shrunk, step = shrunk_font("_font", "_text", "_pole")
    first = F.col("_own") >= F.col("_need")
    method = F.when(first, "representative_point").when(step == 0, "pole_of_inaccessibility").when(step > 0, "pole_of_inaccessibility_reduced_font").otherwise("pole_of_inaccessibility_tight")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    font = F.when(first, F.col("_font")).otherwise(shrunk)
    return z.select("image_id", "zone_id", pick("_x", "_px").alias("x"), pick("_y", "_py").alias("y"), F.round(font, 6).alias("font_size"), method.alias("method"), F.round(pick("_own", "_pole"), 3).alias("clearance_px"), F.round(S.label_radius("_text", font), 3).alias("required_radius_px"))


def placement_metrics(placed: DataFrame) -> DataFrame:
    """One row an image: how labels were placed, and the least clearance, alone and against the radius it should have."""
    pole = F.col("method").startswith("pole_of_inaccessibility")
    none = F.lit(0.0)
    return placed.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("placement_count"), F.count_if(~pole).alias("representative_point_count"), F.count_if(pole).alias("pole_of_inaccessibility_count"),
        F.count_if(F.col("method") == "pole_of_inaccessibility_reduced_font").alias("reduced_font_count"), F.count_if(F.col("clearance_px") + 0.001 < F.col("required_radius_px")).alias("tight_label_count"),
        F.coalesce(F.round(F.min("clearance_px"), 3), none).alias("min_clearance_px"), F.coalesce(F.round(F.min(F.when(F.col("required_radius_px") > 0, F.col("clearance_px") / F.col("required_radius_px"))), 3), none).alias("min_clearance_ratio"),
    )


#: The drawing page's largest font, the share of a box that a number may fill, the width of a bold digit of size 1, the drop of a centred text.
PAGE_FONT, FILL, DIGIT_WIDTH, DROP = 18.0, 0.85, 0.556, 0.32


def drawing_labels(zones: DataFrame, placed: DataFrame, image_w: int, image_h: int, page_w: float, page_h: float) -> DataFrame:
    """Numbers on the drawing page: place of the text's middle and its font, fitted to the zone's box."""
    scale = min((page_w - 2 * MARGIN) / image_w, (page_h - 2 * MARGIN) / image_h)
    j = placed.join(zones.select("image_id", "zone_id", "w", "h", F.col("num").cast("string").alias("text")), ["image_id", "zone_id"])
    room = lambda side: F.greatest(F.lit(4.0), F.col(side) * scale * FILL)
    font = F.least(F.col("font_size") * scale, F.lit(PAGE_FONT), room("h"))
    width = F.length("text") * DIGIT_WIDTH * font
    font = F.greatest(F.lit(SMALLEST_FONT), F.when(width > room("w"), font * room("w") / width).otherwise(font))
    x, y = on_page("x", "y", image_w, image_h, page_w, page_h)
    return j.select("image_id", "zone_id", "text", F.round(font, 6).alias("font"), F.round(x, 6).alias("px"), F.round(y - font * DROP, 6).alias("py"))


def legend(entries: DataFrame, width: float, height: float) -> DataFrame:
    """Places of legend entries (image_id, num): column, row and corner of the swatch."""
    rows = max(1, int((height - 2 * LEGEND_MARGIN - HEADER) // ROW))
    w = Window.partitionBy("image_id")
    e = entries.withColumns({"i": F.row_number().over(w.orderBy("num")) - 1, "n": F.count(F.lit(1)).over(w)})
    columns = F.greatest(F.lit(1), F.ceil(F.col("n") / rows))
    col, row = F.floor(F.col("i") / rows), F.col("i") % rows
    return e.select("image_id", "num", col.cast("long").alias("col"), row.cast("long").alias("row"), F.round(LEGEND_MARGIN + col * ((width - 2 * LEGEND_MARGIN) / columns), 4).alias("x"), F.round(F.lit(height - LEGEND_MARGIN - HEADER) - row * ROW, 4).alias("y"))


def on_page(x, y, image_w: int, image_h: int, page_w: float, page_h: float) -> tuple[Column, Column]:
    """Image places to page places: fitted, centred, upside down."""
    scale = min((page_w - 2 * MARGIN) / image_w, (page_h - 2 * MARGIN) / image_h)
    return (page_w - image_w * scale) / 2 + S._c(x) * scale, (page_h - image_h * scale) / 2 + (F.lit(image_h) - S._c(y)) * scale
