"""The grid of tiles over an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.model import RasterInfo

KEY = ("tile_row", "tile_col")
BOX = ("gx", "gy", "cw", "ch")


def grid_size(width: int, height: int, tile_size: int) -> tuple[int, int]:
    """(columns, rows)."""
    return -(-width // tile_size), -(-height // tile_size)


def tile_grid(spark: SparkSession, info: RasterInfo, tile_size: int) -> DataFrame:
    """(tile_row, tile_col, gx, gy, cw, ch) of each tile: its corner and the size of its core, smaller at the far edges."""
    columns, rows = grid_size(info.width, info.height, tile_size)
    place = spark.range(columns * rows).select(F.expr(f"cast(id div {columns} as int)").alias("tile_row"), (F.col("id") % columns).cast("int").alias("tile_col"))
    corner = place.select("*", (F.col("tile_col") * tile_size).alias("gx"), (F.col("tile_row") * tile_size).alias("gy"))
    return corner.select(*KEY, "gx", "gy", F.least(F.lit(tile_size), F.lit(info.width) - F.col("gx")).alias("cw"), F.least(F.lit(tile_size), F.lit(info.height) - F.col("gy")).alias("ch"))


def tiled(pixels: DataFrame, info: RasterInfo, tile_size: int) -> DataFrame:
    """Pixels with the tile that holds them: tile_row, tile_col, gx, gy, cw, ch, ly, lx, c, v. No shuffle."""
    key = pixels.select("c", "v", "y", "x", F.expr(f"cast(y div {tile_size} as int)").alias("tile_row"), F.expr(f"cast(x div {tile_size} as int)").alias("tile_col"))
    box = key.select("*", (F.col("tile_col") * tile_size).alias("gx"), (F.col("tile_row") * tile_size).alias("gy"))
    size = [F.least(F.lit(tile_size), F.lit(info.width) - F.col("gx")).alias("cw"), F.least(F.lit(tile_size), F.lit(info.height) - F.col("gy")).alias("ch")]
    return box.select(*KEY, "gx", "gy", *size, (F.col("y") - F.col("gy")).alias("ly"), (F.col("x") - F.col("gx")).alias("lx"), "c", "v")


def canvas_grid(spark: SparkSession, info: RasterInfo) -> DataFrame:
    """(y, x, c) of every sample of an image."""
    n = info.channels
    cell = spark.range(info.width * info.height * n)
    return cell.select(F.expr(f"cast(id div {info.width * n} as int)").alias("y"), F.expr(f"cast(id div {n} % {info.width} as int)").alias("x"), (F.col("id") % n).cast("int").alias("c"))
