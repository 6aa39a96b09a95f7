"""Parquet as the native store of rasters: pixels or tiles, in folders by band of rows, so that a crop reads only its bands."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAND_ROWS = 512


def write_pixels(pixels: DataFrame, path: str, band_rows: int = BAND_ROWS) -> None:
    """Rows are dealt by band and sorted within it, so files hold whole ranges of y and x."""
    banded = pixels.withColumn("band", F.expr(f"cast(y div {band_rows} as int)"))
    banded.repartition("image_id", "band").sortWithinPartitions("image_id", "band", "y", "x", "c").write.mode("overwrite").partitionBy("image_id", "band").parquet(path)


def read_pixels(spark: SparkSession, path: str, image_id: str, rows: tuple[int, int] | None = None, band_rows: int = BAND_ROWS) -> DataFrame:
    """An image, or its rows from rows[0] up to rows[1]; other bands are pruned before they are opened."""
    found = spark.read.parquet(path).where(F.col("image_id") == image_id)
    if rows is not None:
        found = found.where((F.col("band") >= rows[0] // band_rows) & (F.col("band") <= (rows[1] - 1) // band_rows) & (F.col("y") >= rows[0]) & (F.col("y") < rows[1]))
    return found.select("image_id", "y", "x", "c", "v")


def write_tiles(tiles: DataFrame, path: str) -> None:
    tiles.repartition("image_id", "tile_row").write.mode("overwrite").partitionBy("image_id", "tile_row").parquet(path)


def read_tiles(spark: SparkSession, path: str, image_id: str) -> DataFrame:
    names = ["image_id", "tile_row", "tile_col", "global_x", "global_y", "core_w", "core_h", "halo", "fmt", "data"]
    return spark.read.parquet(path).where(F.col("image_id") == image_id).select(*names)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only where that is unset and all runs on one machine,
    the local one for temporary files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}"


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have a file deleted when the driver ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
