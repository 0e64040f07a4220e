"""Zones, pixels, colour samples, projects and palettes as views of the test tables; and image files as pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same views for an SQL engine that has the tables.
ZONES = """(SELECT CAST(p_size AS BIGINT) AS image_id, CAST(p_partkey AS BIGINT) AS zone_id, (p_partkey*37)%600 AS x0, (p_partkey*53)%440 AS y0,
 8+(p_partkey*7)%48 AS w, 8+(p_partkey*11)%40 AS h, (8+(p_partkey*7)%48)*(8+(p_partkey*11)%40) AS area_px, 1+(p_partkey*p_partkey)%9 AS num FROM part)"""
PIXELS = """(SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS image_id, l_orderkey%64 AS x, l_partkey%64 AS y,
 ((l_orderkey%64)*7+(l_partkey%64)*3+l_suppkey*11)%256 AS b, ((l_orderkey%64)*5+(l_partkey%64)*13+l_suppkey*17)%256 AS g, ((l_orderkey%64)*19+(l_partkey%64)*2+l_suppkey*5)%256 AS r FROM lineitem)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        "CAST(p_size AS BIGINT) AS image_id", "p_partkey AS zone_id", "(p_partkey*37)%600 AS x0", "(p_partkey*53)%440 AS y0", "8+(p_partkey*7)%48 AS w", "8+(p_partkey*11)%40 AS h", "(8+(p_partkey*7)%48)*(8+(p_partkey*11)%40) AS area_px", "1+(p_partkey*p_partkey)%9 AS num"
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS image_id", "l_orderkey%64 AS x", "l_partkey%64 AS y").distinct()
    return at.selectExpr("image_id", "x", "y", "(x*7+y*3+image_id*11)%256 AS b", "(x*5+y*13+image_id*17)%256 AS g", "(x*19+y*2+image_id*5)%256 AS r")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of projects: the newest row of a user is its state."""
    return read(spark, sf_dir, "events").selectExpr("user_id AS project_id", "event_id AS version", "event_type AS mode", "ts AS updated_at", "props AS palette_json", "value AS detail", "CAST(event_id % 37 AS INT) AS num_colors")


def palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr("c_custkey AS palette_id", "c_name AS name", "CAST(c_custkey % 33 AS INT) AS num_colors", "c_acctbal AS balance")


def decode_base64(requests: DataFrame) -> DataFrame:
    """Adds `content` (bytes) to rows with image_base64; a data: prefix is cut off; null where it isn't base64."""
    return requests.withColumn("content", F.try_to_binary(F.regexp_replace("image_base64", r"^data:[^,]*,", ""), F.lit("base64")))


def image_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Decoded JPEG and PNG files: image_id (origin), width, height, n_channels, data (rows of BGR bytes)."""
    i = spark.read.format("image").option("dropInvalid", True).load(paths).select("image.*")
    return i.where(F.lower("origin").rlike(r"\.(jpe?g|png)$")).select(F.col("origin").alias("image_id"), "width", "height", F.col("nChannels").alias("n_channels"), "data")


def image_pixels(images: DataFrame) -> DataFrame:
    """One row for each pixel: image_id, y, x, b, g, r; gray images repeat their one channel."""
    place = F.posexplode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1))
    p = images.select("image_id", "width", "n_channels", "data", place.alias("_", "i"))
    at = lambda c: F.conv(F.hex(F.substring("data", F.col("i") * F.col("n_channels") + F.least(F.lit(c), F.col("n_channels") - 1) + 1, F.lit(1))), 16, 10).cast("int")
    return p.select("image_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), at(0).alias("b"), at(1).alias("g"), at(2).alias("r"))


def encode_base64(files: DataFrame) -> DataFrame:
    """Adds `image_base64` to rows with content (bytes), without a prefix."""
    return files.withColumn("image_base64", F.base64("content"))


def accepted(name: str, mime: str) -> Column:
    """Whether a file is a picture by its media type or by the ending of its name."""
    return F.coalesce(F.col(mime).isin("image/jpeg", "image/png"), F.lit(False)) | F.coalesce(F.lower(name).rlike(r"\.(jpe?g|png)$"), F.lit(False))


def synthetic_pixels(spark: SparkSession, width: int, height: int) -> DataFrame:
    """Three made-up pages of coloured shapes as pixels: i, name, x, y, b, g, r. For trying things without pictures."""
    p = spark.range(3 * width * height).selectExpr("id div {0} AS i".format(width * height), f"id % {width} AS x", f"id % {width * height} div {width} AS y")
    cx, cy = F.col("x") - width / 2, F.col("y") - height / 2
    far = F.hypot(cx, cy)
    kinds = [("arcs", F.floor((far + F.col("x")) / (width / 6))), ("grid", F.floor(F.col("x") * 4 / width) + 4 * F.floor(F.col("y") * 4 / height)), ("rings", F.floor(far / (width / 10)))]
    part = F.element_at(F.array(*[k.cast("long") for _, k in kinds]), (F.col("i") + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(n) for n, _ in kinds]), (F.col("i") + 1).cast("int"))
    return p.select("i", name.alias("name"), "x", "y", *[((part * a + b) % 256).alias(k) for k, a, b in (("b", 67, 40), ("g", 101, 90), ("r", 29, 200))])
