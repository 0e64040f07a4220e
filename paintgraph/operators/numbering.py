"""Renumbering, ranks, missing numbers and their donors, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_number(*order):
    return F.row_number().over(Window.partitionBy("image_id").orderBy(*order)).cast("long")


def renumber(zones: DataFrame) -> DataFrame:
    """New ids 1..n in list order."""
    return zones.select("image_id", "zone_id", row_number("zone_id").alias("new_id"))


def reading_order(zones: DataFrame) -> DataFrame:
    return zones.select("image_id", "zone_id", row_number("y0", "x0", F.desc("area_px"), "zone_id").alias("pos"))


def truncate(zones: DataFrame, most: int) -> DataFrame:
    """The `most` largest zones of each image, renumbered; Spark keeps a group's first rows before it shuffles."""
    return zones.withColumn("rank", row_number(F.desc("area_px"), "zone_id")).where(F.col("rank") <= most).select("image_id", "zone_id", "rank")


def cluster_rank(zones: DataFrame) -> DataFrame:
    """Numbers of clusters by total area, largest first."""
    totals = zones.groupBy("image_id", F.col("num").alias("cluster")).agg(F.sum("area_px").alias("area"))
    return totals.select("image_id", "cluster", "area", row_number(F.desc("area"), "cluster").alias("num"))


def distribution(zones: DataFrame, n: int) -> DataFrame:
    """Zones of each number 1..n, zeros included, and of any other number that occurs."""
    counts = zones.groupBy("image_id", "num").agg(F.count(F.lit(1)).alias("n"))
    wanted = zones.select("image_id").distinct().withColumn("num", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    return wanted.join(counts, ["image_id", "num"], "full").select("image_id", "num", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def unused(zones: DataFrame, n: int) -> DataFrame:
    wanted = zones.select("image_id").distinct().withColumn("num", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    return wanted.join(zones.select("image_id", "num").distinct(), ["image_id", "num"], "left_anti")


def missing(zones: DataFrame, n: int) -> DataFrame:
    """Numbers from 1 to n, or to the image's number of zones if that is less, that no zone has."""
    top = zones.groupBy("image_id").agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("top"))
    wanted = top.select("image_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top"))).alias("num"))
    return wanted.join(zones.select("image_id", "num").distinct(), ["image_id", "num"], "left_anti")


def donors(zones: DataFrame, n: int) -> DataFrame:
    """Missing numbers, ascending, each take the largest zone left whose number is used more than once.

    Numbers beyond n or the image's number of zones give nothing.
    """
    top = F.least(F.count(F.lit(1)).over(Window.partitionBy("image_id")), F.lit(n))
    known = zones.withColumn("top", top).where((F.col("num") >= 1) & (F.col("num") <= F.col("top")))
    spare = known.withColumn("r", F.row_number().over(Window.partitionBy("image_id", "num").orderBy("area_px", F.desc("zone_id")))).where("r > 1")
    ranked = spare.select("image_id", "zone_id", F.col("num").alias("old"), row_number(F.desc("area_px"), "zone_id").alias("k"))
    wanted = missing(zones, n).select("image_id", F.col("num").alias("new"), row_number("num").alias("k"))
    return ranked.join(wanted, ["image_id", "k"]).select("image_id", "zone_id", "old", "new")


def large_zones(zones: DataFrame, factor: float) -> DataFrame:
    """Zones of `factor` times their image's median area or more."""
    median = zones.groupBy("image_id").agg(F.median("area_px").alias("median_area"))
    return zones.join(median, "image_id").where(F.col("area_px") >= factor * F.col("median_area")).select("image_id", "zone_id", "area_px", "median_area")


def in_turn(zones: DataFrame, n: int) -> DataFrame:
    """Numbers 1..n dealt round in order of zones, for images whose colours can't be clustered."""
    return zones.select("image_id", "zone_id", ((row_number("zone_id") - 1) % n + 1).alias("num"))


def zone_counts(zones: DataFrame) -> DataFrame:
    return zones.groupBy("image_id").agg(F.count(F.lit(1)).alias("zones"), F.count_distinct("num").alias("numbers"))
