"""Scalar rules as Column functions: parameters, colours, labels, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits and ratios that results depend on.
DEFAULT_COLORS, DEFAULT_DETAIL, GRAY = 12, 0.5, "#B8B8B8"
MIN_AREA_RATIO, MAX_ZONES, MIN_AREA_FLOOR = (0.012, 0.0012), (35, 180), 50
LINE_MIN_AREA_RATIO, LINE_EPSILON, LINE_KERNEL, BLOCK_SIZE, BLOCK_C = (0.0025, 0.00035), (0.005, 0.0018), (5, 3), 35, 9
LARGE_FACTOR, TARGET_FACTOR, COMPACTNESS, MAX_SEGMENTS, MAX_AREA_RATIO = (3.2, 2.0), (3.4, 1.2), (10.0, 4.0), 64, 0.92
DETAIL_NAMES = ["Bajo", "Medio", "Alto"]
HUE_OFFSETS = [0.0, 0.08, 0.17, 0.33, 0.5, 0.67]


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(v)


def interpolate(low: float, high: float, detail) -> Column:
    return F.lit(float(low)) + F.lit(float(high) - float(low)) * F.greatest(F.lit(0.0), F.least(_c(detail), F.lit(1.0)))


def odd(v) -> Column:
    n = F.greatest(F.lit(3), _c(v))
    return F.when(n % 2 == 0, n + 1).otherwise(n)


def num_colors(new, legacy) -> Column:
    return F.least(F.greatest(F.coalesce(_c(new), _c(legacy), F.lit(DEFAULT_COLORS)), F.lit(1)), F.lit(30))


def detail_level(v) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.coalesce(_c(v), F.lit(DEFAULT_DETAIL)), F.lit(1.0)))


def whole(v: Column) -> Column:
    """Rounds half to even, as results must."""
    return F.rint(v).cast("long")


def color_limits(w, h, detail, legacy_area=None) -> dict[str, Column]:
    area = whole(_c(w) * _c(h) * interpolate(*MIN_AREA_RATIO, detail))
    return {"min_area_px": F.greatest(F.lit(MIN_AREA_FLOOR), F.coalesce(_c(legacy_area), area) if legacy_area is not None else area).cast("long"), "max_zones": whole(interpolate(*MAX_ZONES, detail))}


def line_params(w, h, detail, min_area=None) -> dict[str, Column]:
    """Parameters of line-art segmentation from size and detail; a wanted minimum area (not 0) goes before the derived one."""
    area, own = _c(w) * _c(h), whole(_c(w) * _c(h) * interpolate(*LINE_MIN_AREA_RATIO, detail))
    minimum = F.greatest(F.lit(20), own if min_area is None else F.coalesce(F.nullif(_c(min_area), F.lit(0)), own)).cast("long")
    return {
        "detail_level": F.greatest(F.lit(0.0), F.least(_c(detail), F.lit(1.0))),
        "min_area_px": minimum,
        "component_min_area_px": F.greatest(F.lit(30), whole(minimum * 0.06)).cast("long"),
        "close_kernel": odd(F.rint(interpolate(*LINE_KERNEL, detail)).cast("int")).cast("long"),
        "adaptive_block_size": odd(F.lit(BLOCK_SIZE)).cast("long"),
        "adaptive_c": F.lit(BLOCK_C).cast("long"),
        "epsilon_ratio": interpolate(*LINE_EPSILON, detail),
        "max_area_px": area * F.lit(MAX_AREA_RATIO),
        "slic_large_zone_multiplier": interpolate(*LARGE_FACTOR, detail),
        "slic_target_area_multiplier": interpolate(*TARGET_FACTOR, detail),
        "slic_compactness": interpolate(*COMPACTNESS, detail),
        "slic_max_segments_per_zone": F.lit(MAX_SEGMENTS).cast("long"),
        "subdivision_strategy": F.lit("curved"),
        "merge_small_slic_fragments": F.lit(True),
        "small_fragment_max_iterations_multiplier": F.lit(3).cast("long"),
    }


def gray(b, g, r) -> Column:
    return F.rint((114 * _c(b) + 587 * _c(g) + 299 * _c(r)) / F.lit(1000.0)).cast("long")


#: Linear sRGB to XYZ (rows X, Y, Z; columns r, g, b), and the white point's X and Z.
TO_XYZ = [(0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227)]
WHITE_X, WHITE_Z = 0.950456, 1.088754


def lab(b, g, r) -> tuple[Column, Column, Column]:
    """CIELAB of channels 0 to 255."""

    def linear(v) -> Column:
        c = _c(v) / 255.0
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)

    own = [linear(v) for v in (r, g, b)]
    x, y, z = (sum((w * c for w, c in zip(row, own, strict=True)), F.lit(0.0)) for row in TO_XYZ)
    root = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    x, y, z = root(x / WHITE_X), root(y), root(z / WHITE_Z)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def lab8(b, g, r) -> tuple[Column, Column, Column]:
    """CIELAB in 8-bit planes: lightness over 255, a and b around 128."""
    light, a, b = lab(b, g, r)
    clip = lambda v: F.greatest(F.lit(0), F.least(whole(F.round(v, 6)), F.lit(255)))
    return clip(light * 255 / 100), clip(a + 128), clip(b + 128)


def rgb_hex(r, g, b) -> Column:
    return F.format_string("#%02X%02X%02X", *[_c(x).cast("int") for x in (r, g, b)])


def channel(hex_color, i: int) -> Column:
    return F.conv(F.substring(_c(hex_color), 2 + 2 * i, 2), 16, 10).cast("int")


def hsv(r, g, b) -> tuple[Column, Column, Column]:
    """Hue, saturation and value, 0 to 1, of channels 0 to 255."""
    r, g, b = (_c(x) / 255.0 for x in (r, g, b))
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    span = v - low
    h = F.when(span == 0, 0.0).when(v == r, (g - b) / span).when(v == g, 2.0 + (b - r) / span).otherwise(4.0 + (r - g) / span)
    return F.pmod(h / 6.0, F.lit(1.0)), F.when(v == 0, 0.0).otherwise(span / v), v


def hsv_hex(h, s, v) -> Column:
    """Hue turns round; saturation and value are clipped."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))
    h, s, v = F.pmod(_c(h), F.lit(1.0)), clip(_c(s)), clip(_c(v))
    sector, part = F.floor(h * 6).cast("int"), h * 6 - F.floor(h * 6)
    p, q, t = v * (1 - s), v * (1 - s * part), v * (1 - s * (1 - part))
    pick = lambda *x: F.element_at(F.array(*x), sector % 6 + 1)
    return rgb_hex(*[F.rint(c * 255) for c in (pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q))])


def valid_hex(v, fallback=GRAY) -> Column:
    t = F.trim(F.coalesce(_c(v), F.lit("")))
    return F.when(t.rlike("^#[0-9A-Fa-f]{6}$"), F.upper(t)).otherwise(fallback)


def paint_number(number, zone_id) -> Column:
    return F.coalesce(F.nullif(_c(number).cast("string"), F.lit("")), _c(zone_id).cast("string"))


def zone_key(own, feature_id, place) -> Column:
    """A zone's id: its own, else the feature's, else its place (from 0) plus 1."""
    return F.coalesce(_c(own).cast("string"), _c(feature_id).cast("string"), (_c(place) + 1).cast("string"))


def sort_key(text) -> Column:
    """Keys of digits sort as numbers, before the others, which sort as text."""
    t = _c(text).cast("string")
    digits = t.rlike("^[0-9]+$")
    return F.struct((~digits).alias("other"), F.when(digits, t.cast("decimal(38,0)")).alias("number"), t.alias("text"))


def iso_time(at) -> Column:
    """UTC time as ISO 8601 text of fixed width, so that texts sort like times (the session's time zone is UTC)."""
    return F.date_format(_c(at), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def label_font(area, w, h) -> Column:
    return F.greatest(F.lit(5.0), F.least(F.lit(28.0), F.sqrt(_c(area)) * 0.28, _c(w) * 0.55, _c(h) * 0.55))


def label_radius(text, font) -> Column:
    return F.greatest(F.lit(2.0), F.hypot(F.length(_c(text)) * _c(font) * 0.31, _c(font) * 0.48))


def label_too_small(area, w, h, minimum) -> Column:
    return (_c(area) < _c(minimum)) | (F.least(_c(w), _c(h)) < 14)


def client_label_hidden(flag, area, w, h, width: int, height: int) -> Column:
    """The looser rule for restored projects: flagged, or small against the page."""
    return F.coalesce(_c(flag), F.lit(False)) | ((_c(area) > 0) & ((_c(area) < 0.0017 * width * height) | (F.least(_c(w), _c(h)) < 14)))


def detail_name(level) -> Column:
    return F.when(_c(level) < 0.34, DETAIL_NAMES[0]).when(_c(level) < 0.67, DETAIL_NAMES[1]).otherwise(DETAIL_NAMES[2])


def svg_path(ring) -> Column:
    """M x y L x y ... Z; empty for an empty ring."""
    step = lambda p: F.concat(F.lit("L "), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))
    r = _c(ring)
    return F.when(F.size(r) == 0, "").otherwise(F.concat(F.lit("M "), F.substring(F.array_join(F.transform(r, step), " "), 3, 1 << 30), F.lit(" Z")))


def deduped(ring) -> Column:
    """A ring without corners that equal the one before."""
    r = _c(ring)
    return F.filter(r, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(r, i - 1)))


def shoelace(ring) -> Column:
    """Twice the signed area of a ring that isn't closed."""
    r = _c(ring)
    nxt = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    return F.aggregate(F.zip_with(r, nxt, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double")), F.lit(0.0), lambda s, x: s + x)


def centroid(ring, axis: str) -> Column:
    """Area centroid; the mean of the corners where twice the area is under 0.001."""
    r = _c(ring)
    nxt = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    total = F.aggregate(F.zip_with(r, nxt, lambda a, b: ((a[axis] + b[axis]) * (a["x"] * b["y"] - b["x"] * a["y"])).cast("double")), F.lit(0.0), lambda s, x: s + x)
    mean = F.aggregate(r, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(r)
    twice = shoelace(r)
    return F.when(F.abs(twice) < 0.001, mean).otherwise(total / (3 * twice))


def html_escape(text) -> Column:
    out = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
