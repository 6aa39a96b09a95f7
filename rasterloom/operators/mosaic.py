"""Tiles put together on a canvas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.model import RasterInfo
from rasterloom.operators.grid import canvas_grid
from rasterloom.operators.transforms import Tiles


def check_bounds(tiles: Tiles, canvas: RasterInfo) -> None:
    """Tiles must lie inside the canvas. Reads one row: the furthest corners."""
    right, bottom = tiles.boxes.agg(F.max(F.col("gx") + F.col("cw")), F.max(F.col("gy") + F.col("ch"))).first()
    if right is not None and (right > canvas.width or bottom > canvas.height):
        raise ValueError(f"tiles reach {right} x {bottom}, beyond the canvas of {canvas.width} x {canvas.height}")


def mosaic(tiles: Tiles) -> DataFrame:
    """(y, x, c, v). Where tiles overlap, the last one in raster order wins; only chains with a resize can overlap, so
    others need no aggregation."""
    placed = tiles.samples.select((F.col("gy") + F.col("ly")).alias("y"), (F.col("gx") + F.col("lx")).alias("x"), "c", "v", "tile_row", "tile_col")
    if not tiles.overlapping:
        return placed.select("y", "x", "c", "v")
    last = F.max(F.struct("tile_row", "tile_col", "v"))
    return placed.groupBy("y", "x", "c").agg(last.alias("last")).select("y", "x", "c", F.col("last.v").alias("v"))


def on_canvas(samples: DataFrame, canvas: RasterInfo) -> DataFrame:
    """Every sample of the canvas, zero where no tile lies."""
    grid = canvas_grid(samples.sparkSession, canvas)
    found = grid.join(samples, ["y", "x", "c"], "left")
    return found.select(F.lit(canvas.image_id).alias("image_id"), "y", "x", "c", F.coalesce("v", F.lit(0)).alias("v"))
