"""Rasters made of ordinary tables. Each returns a pixel table and what is known of the image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.model import RasterInfo

WIDTH = 50  # of the rasters that are cut from a sequence of rows


def _whole(x):
    return F.floor(x).cast("int")


def embedding_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, RasterInfo]:
    """E: one row of 64 gray samples for each embedding."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    long = table.select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "f"))
    v = _whole(F.least(F.greatest(F.floor((F.col("f").cast("double") + 1.0) * 128.0), F.lit(0)), F.lit(255)))
    pixels = long.select(F.lit("E").alias("image_id"), "y", "x", F.lit(0).alias("c"), v.alias("v"))
    return pixels, RasterInfo("E", 64, table.count())


def event_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, RasterInfo]:
    """V: gray, from the values of events in order of their ids."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    place = [F.expr(f"cast(event_id div {WIDTH} as int)").alias("y"), (F.col("event_id") % WIDTH).cast("int").alias("x")]
    pixels = table.select(F.lit("V").alias("image_id"), *place, F.lit(0).alias("c"), _whole(F.floor("value") % 256).alias("v"))
    return pixels, RasterInfo("V", WIDTH, table.count() // WIDTH)


def order_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, RasterInfo]:
    """O: RGB, from price, customer and day of orders in order of their keys."""
    table = spark.read.parquet(f"{sf_dir}/orders.parquet")
    place = [F.expr(f"cast(o_orderkey div {WIDTH} as int)").alias("y"), (F.col("o_orderkey") % WIDTH).cast("int").alias("x")]
    samples = F.array(_whole(F.floor("o_totalprice") % 256), (F.col("o_custkey") % 256).cast("int"), F.dayofmonth("o_orderdate") * 8)
    pixels = table.select(F.lit("O").alias("image_id"), *place, F.posexplode(samples).alias("c", "v"))
    return pixels, RasterInfo("O", WIDTH, table.count() // WIDTH, "RGB8")
