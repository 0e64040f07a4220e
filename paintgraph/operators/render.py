"""Texts of zones: rings, SVG, GeoJSON, PDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.committed import commit

#: Attributes of a path and of a text, and the root element.
STROKE = 'fill="none" stroke="#000000" stroke-width="2" vector-effect="non-scaling-stroke"'
TEXT = '<text x="%.2f" y="%.2f" text-anchor="middle" dominant-baseline="central" font-size="%.2f" font-weight="700" fill="#000000">%s</text>'
ROOT = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {w} {h}" width="{w}" height="{h}">\n  '


def rings(zones: DataFrame) -> DataFrame:
    """Boxes with their polygon, an array of corners that isn't closed."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    return zones.withColumn("polygon", F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1)))


def _path() -> Column:
    key, number = S.html_escape(F.col("zone_id").cast("string")), S.html_escape(S.paint_number("num", "zone_id"))
    return F.concat(F.lit('<path id="zone-'), key, F.lit('" data-zone-id="'), key, F.lit('" data-paint-number="'), number, F.lit('" d="'), S.svg_path("polygon"), F.lit(f'" {STROKE}/>'))


def _joined(parts: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, svg from parts (image_id, kind, zone_id, p): by kind, then zone. An image's parts make one text."""
    listed = parts.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("kind", "zone_id", "p"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["p"]), "\n  ")
    return listed.select("image_id", F.concat(F.lit(ROOT.format(w=width, h=height)), body, F.lit("\n</svg>")).alias("svg"))


def svg_documents(zones: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, svg: the outlines of an image in order of zones."""
    return _joined(zones.select("image_id", F.lit(0).alias("kind"), "zone_id", _path().alias("p")), width, height)


def numbered_svg(zones: DataFrame, placed: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, svg: all outlines first, then the numbers of the zones that have a place for one."""
    numbers = zones.select("image_id", "zone_id", S.paint_number("num", "zone_id").alias("number"))
    texts = placed.join(numbers, ["image_id", "zone_id"]).select("image_id", F.lit(1).alias("kind"), "zone_id", F.format_string(TEXT, F.col("x").cast("double"), F.col("y").cast("double"), "font_size", S.html_escape("number")).alias("p"))
    return _joined(zones.select("image_id", F.lit(0).alias("kind"), "zone_id", _path().alias("p")).union(texts), width, height)


def feature(zones: DataFrame) -> Column:
    """A zone as a GeoJSON feature: one closed ring; flags only where they are set."""
    r = F.col("polygon")
    closed = F.when((F.size(r) > 0) & (F.get(r, F.lit(0)) != F.get(r, F.size(r) - 1)), F.concat(r, F.slice(r, 1, 1))).otherwise(r)
    ring = F.transform(closed, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    flags = [F.when(F.col(c), True).alias(c) for c in ("requires_manual_color", "suppress_label") if c in zones.columns]
    key = F.col("zone_id").cast("string")
    props = F.struct(key.alias("zone_id"), S.paint_number("num", "zone_id").alias("paint_number"), F.col("area_px").alias("area_px"), F.array("x0", "y0", "w", "h").alias("bbox"), *flags)
    return F.struct(F.lit("Feature").alias("type"), key.alias("id"), props.alias("properties"), geometry.alias("geometry"))


def features(zones: DataFrame) -> DataFrame:
    """image_id, zone_id, feature (JSON text)."""
    return zones.select("image_id", "zone_id", F.to_json(feature(zones)).alias("feature"))


def feature_collections(zones: DataFrame, width: int, height: int, mode: str, num_colors: int | None = None, detail_level: float | None = None) -> DataFrame:
    """image_id, geojson: an image's features in order of zones, after properties that are written even where null."""
    own = features(zones).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("zone_id", "feature"))).alias("l"))
    props = F.struct(F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(mode).alias("mode"), F.size("l").alias("zone_count"), F.lit(num_colors).cast("int").alias("num_colors"), F.lit(detail_level).cast("double").alias("detail_level"))
    head = F.concat(F.lit('{"type":"FeatureCollection","properties":'), F.to_json(props, {"ignoreNullFields": "false"}), F.lit(',"features":['))
    return own.select("image_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["feature"]), ","), F.lit("]}")).alias("geojson"))


def write_images(zones: DataFrame, path: str) -> None:
    """JSON files of zones, a folder for each image."""
    zones.repartition("image_id").write.partitionBy("image_id").mode("overwrite").json(path)


def results(zones: DataFrame, metrics: DataFrame, parameters: dict[str, object], outputs: dict[str, str]) -> DataFrame:
    """image_id, result: an image's result as JSON with its parameters, metrics (a row an image), the names of its outputs
    (patterns with {image_id}) and its zones in order. Images without zones have an empty list."""
    drop = [c for c in ("image_id",) if c in zones.columns]
    listed = zones.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("zone_id", F.struct(*[c for c in zones.columns if c not in drop]).alias("z")))).alias("l"))
    own = metrics.select("image_id", F.struct(*[c for c in metrics.columns if c != "image_id"]).alias("metrics")).join(listed, "image_id", "left")
    given = F.struct(*[F.lit(v).alias(k) for k, v in parameters.items()])
    named = F.struct(*[F.regexp_replace(F.lit(v), r"\{image_id\}", F.col("image_id").cast("string")).alias(k) for k, v in outputs.items()])
    body = F.struct("image_id", given.alias("parameters"), "metrics", named.alias("outputs"), F.coalesce(F.transform("l", lambda x: x["z"]), F.array()).alias("zones"))
    return own.select("image_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("result"))


def write_results(rows: DataFrame, path: str, job: str) -> bool:
    """Files of results, a folder for each image, committed once for all tries of a job."""
    return commit(rows.select("image_id", F.col("result").alias("value")).repartition("image_id"), path, job, by=["image_id"], kind="text")


#: Head of the legend page.
LEGEND_TITLE = "Leyenda de colores"


def drawing_commands(zones: DataFrame, labels: DataFrame, image_w: int, image_h: int, page_w: float, page_h: float) -> DataFrame:
    """image_id, page 1's drawing commands: outlines, then numbers (of `drawing_labels`), as lines of a PDF content stream."""
    from . import layout

    scale = min((page_w - 2 * layout.MARGIN) / image_w, (page_h - 2 * layout.MARGIN) / image_h)
    point = lambda p: F.format_string("%.3f %.3f", *[c.cast("double") for c in layout.on_page(p["x"], p["y"], image_w, image_h, page_w, page_h)])
    r = F.col("polygon")
    lines = F.transform(r, lambda p, i: F.concat(point(p), F.when(i == 0, F.lit(" m")).otherwise(F.lit(" l"))))
    paths = zones.where(F.size("polygon") > 0).select("image_id", F.lit(0).alias("kind"), "zone_id", F.concat(F.array_join(lines, "\n"), F.lit("\ns")).alias("p"))
    width = F.length("text") * layout.DIGIT_WIDTH * F.col("font")
    texts = labels.select("image_id", F.lit(1).alias("kind"), "zone_id", F.format_string("BT /F1 %.3f Tf %.3f %.3f Td (%s) Tj ET", "font", F.col("px") - width / 2, "py", _pdf_text("text")).alias("p"))
    listed = paths.union(texts).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("kind", "zone_id", "p"))).alias("l"))
    return listed.select("image_id", F.concat(F.lit(f"{max(1.0, 2 * scale):.3f} w 0 0 0 RG 0 0 0 rg\n"), F.array_join(F.transform("l", lambda x: x["p"]), "\n")).alias("drawing"))


def _pdf_text(text: str) -> Column:
    return F.regexp_replace(text, r"([\\()])", r"\\$1")


def legend_commands(entries: DataFrame, page_h: float) -> DataFrame:
    """image_id, page 2's drawing commands: a title, and swatch, number and colour of each entry (of `legend`, with hex)."""
    from . import layout

    s = layout.SWATCH
    part = lambda i: F.conv(F.substring("hex", 2 + 2 * i, 2), 16, 10).cast("double") / 255
    low = F.col("y") - s + 3
    line = F.format_string(f"%.4f %.4f %.4f rg 0 0 0 RG %.3f %.3f {s} {s} re B 0 0 0 rg BT /F1 10 Tf %.3f %.3f Td (%s) Tj ET BT /F2 10 Tf %.3f %.3f Td (%s) Tj ET", part(0), part(1), part(2), "x", low, F.col("x") + s + 8, F.col("y") - 8, F.col("num").cast("string"), F.col("x") + s + 36, F.col("y") - 8, "hex")
    listed = entries.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("num", line.alias("p")))).alias("l"))
    title = f"BT /F1 18 Tf {layout.LEGEND_MARGIN} {page_h - layout.LEGEND_MARGIN} Td ({LEGEND_TITLE}) Tj ET\n"
    return listed.select("image_id", F.concat(F.lit(title), F.array_join(F.transform("l", lambda x: x["p"]), "\n")).alias("legend"))


def pdf_documents(drawings: DataFrame, legends: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """image_id, pdf (bytes): two pages. The cross-reference table holds the places of the objects in the file."""
    stream = lambda c: F.concat(F.lit("<< /Length "), F.octet_length(F.encode(c, "ISO-8859-1")).cast("string"), F.lit(" >>\nstream\n"), F.col(c), F.lit("\nendstream"))
    page = lambda n: F.lit(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {page_w:.3f} {page_h:.3f}] /Contents {n} 0 R /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>")
    font = lambda name: F.lit(f"<< /Type /Font /Subtype /Type1 /BaseFont /{name} >>")
    objects = F.array(F.lit("<< /Type /Catalog /Pages 2 0 R >>"), F.lit("<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>"), page(5), page(6), stream("drawing"), stream("legend"), font("Helvetica-Bold"), font("Helvetica"))
    numbered = F.transform(objects, lambda o, i: F.concat((i + 1).cast("string"), F.lit(" 0 obj\n"), o, F.lit("\nendobj\n")))
    d = drawings.join(legends, "image_id").select("image_id", numbered.alias("o")).withColumn("head", F.lit("%PDF-1.4\n"))
    size = lambda c: F.octet_length(F.encode(c, "ISO-8859-1"))
    places = F.transform(F.sequence(F.lit(0), F.size("o") - 1), lambda i: size("head") + F.aggregate(F.slice("o", 1, i), F.lit(0), lambda a, x: a + size(x)))
    end = size("head") + F.aggregate("o", F.lit(0), lambda a, x: a + size(x))
    table = F.concat(F.lit("xref\n0 9\n0000000000 65535 f \n"), F.array_join(F.transform(places, lambda p: F.concat(F.lpad(p.cast("string"), 10, "0"), F.lit(" 00000 n \n"))), ""))
    tail = F.concat(table, F.lit("trailer\n<< /Size 9 /Root 1 0 R >>\nstartxref\n"), end.cast("string"), F.lit("\n%%EOF\n"))
    return d.select("image_id", F.encode(F.concat("head", F.array_join("o", ""), tail), "ISO-8859-1").alias("pdf"))
