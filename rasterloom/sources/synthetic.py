"""Checkerboard test images, generated in parallel. Gradients are computed in single precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.model import RasterInfo


def _single(x: Column, n: int, scale: int) -> Column:
    """Single-precision x / n * scale."""
    return ((x.cast("float") / F.lit(n).cast("float")).cast("float") * F.lit(scale).cast("float")).cast("float")


def checkerboard(spark: SparkSession, width: int, height: int, gray: bool = False, block: int = 128) -> tuple[DataFrame, RasterInfo]:
    """RGB: gradients along x and y in red and green, the board in blue. Gray: board plus gradient, which wraps at 256."""
    info = RasterInfo("G", width, height, "GRAY8" if gray else "RGB8")
    cell = spark.range(width * height).select(F.expr(f"cast(id div {width} as int)").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    board = F.expr(f"cast(((y div {block}) ^ (x div {block})) & 1 as int)")
    whole = lambda v: F.floor(v).cast("int")
    if gray:
        slope = whole((_single(F.col("y"), height, 50) + _single(F.col("x"), width, 50)).cast("float"))
        samples = [F.pmod(board * 180 + 30 + slope, F.lit(256))]
    else:
        thirty = F.lit(30).cast("float")
        samples = [whole(_single(F.col("x"), width, 200) + thirty), whole(_single(F.col("y"), height, 200) + thirty), board * 200 + 20]
    return cell.select(F.lit("G").alias("image_id"), "y", "x", F.posexplode(F.array(*samples)).alias("c", "v")), info
