"""Bilinear sampling in single precision, over whole images and with explicit origins.

Every product, sum and quotient is rounded to FLOAT, in the order of the definitions. Dividing two FLOAT columns goes
through DOUBLE in Spark; casting its result back rounds as a single-precision division does.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.model import RasterInfo

Box = tuple[int, int, int, int]


def single(value: Column | float) -> Column:
    return (F.lit(float(np.float32(value))) if isinstance(value, int | float) else value).cast("float")


def rows_of_pixels(pixels: DataFrame, channels: int) -> DataFrame:
    """(sy, sx, p0, p1, ...): a row for each pixel, with its samples beside each other; absent samples are 0."""
    held = [F.coalesce(F.max(F.when(F.col("c") == k, F.col("v"))), F.lit(0)).alias(f"p{k}") for k in range(channels)]
    return pixels.groupBy(F.col("y").alias("sy"), F.col("x").alias("sx")).agg(*held)


def sample_points(points: DataFrame, keys: list[str], pixels: DataFrame, info: RasterInfo) -> DataFrame:
    """keys, c, v for each row of points (keys, fx, fy), which keys tell apart: the image's value there, blended along x and
    then along y. Coordinates beyond the image are held to its edge; values are truncated."""
    held = lambda v, n: F.greatest(single(0.0), F.least(single(F.col(v)), single(float(n - 1))))
    at = points.select(*keys, held("fx", info.width).alias("fx"), held("fy", info.height).alias("fy"))
    at = at.select("*", F.floor("fx").cast("int").alias("left"), F.floor("fy").cast("int").alias("top"))
    at = at.select(*keys, "left", "top", (F.col("fx") - single(F.col("left"))).alias("dx"), (F.col("fy") - single(F.col("top"))).alias("dy"), F.least(F.col("left") + 1, F.lit(info.width - 1)).alias("right"), F.least(F.col("top") + 1, F.lit(info.height - 1)).alias("bottom"))
    corners = [("left", "top"), ("right", "top"), ("left", "bottom"), ("right", "bottom")]
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(x).alias("sx"), F.col(y).alias("sy")) for k, (x, y) in enumerate(corners)]))
    wanted = at.select(*keys, "dx", "dy", corner.alias("s")).select(*keys, "dx", "dy", "s.k", "s.sx", "s.sy")
    found = wanted.join(rows_of_pixels(pixels, info.channels), ["sy", "sx"], "left")
    sample = lambda k, c: single(F.coalesce(F.max(F.when(F.col("k") == k, F.col(f"p{c}"))), F.lit(0)))
    picked = [sample(k, c).alias(f"s{k}_{c}") for k in range(4) for c in range(info.channels)]
    one = found.groupBy(*keys).agg(F.max("dx").alias("dx"), F.max("dy").alias("dy"), *picked)
    dx, dy = F.col("dx"), F.col("dy")
    rest_x, rest_y = single(1.0) - dx, single(1.0) - dy
    blend = lambda c: rest_y * (rest_x * F.col(f"s0_{c}") + dx * F.col(f"s1_{c}")) + dy * (rest_x * F.col(f"s2_{c}") + dx * F.col(f"s3_{c}"))
    kept = lambda v: F.floor(F.greatest(single(0.0), F.least(v, single(255.0)))).cast("int")
    values = F.array(*[F.struct(F.lit(c).alias("c"), kept(blend(c)).alias("v")) for c in range(info.channels)])
    return one.select(*keys, F.explode(values).alias("s")).select(*keys, "s.c", "s.v")


def _cells(pixels: DataFrame, width: int, height: int) -> DataFrame:
    cell = pixels.sparkSession.range(width * height)
    return cell.select(F.expr(f"cast(id div {max(width, 1)} as int)").alias("y"), F.expr(f"cast(id % {max(width, 1)} as int)").alias("x"))


def resize_single(pixels: DataFrame, info: RasterInfo, width: int, height: int, scale_x: float, scale_y: float) -> DataFrame:
    """(y, x, c, v) of a whole image resized to width x height. A new sample reads at (place + 0.5) / scale - 0.5."""
    if min(width, height) < 0 or not (scale_x > 0 and scale_y > 0):
        raise ValueError("a size must not be negative, and a scale must be positive")
    source = lambda o, scale: (single((single(F.col(o)) + single(0.5)) / single(scale)) - single(0.5))
    points = _cells(pixels, width, height).select("y", "x", source("x", scale_x).alias("fx"), source("y", scale_y).alias("fy"))
    return sample_points(points, ["y", "x"], pixels, info)


def rotate_single(pixels: DataFrame, info: RasterInfo, degrees: float, core: Box, buffer: Box, centre: tuple[float, float]) -> DataFrame:
    """(y, x, c, v) of the core, places counted from its corner, rotated about a centre of the image. Only the buffer is
    read, a rectangle inside the image; what would read beyond it is black. Boxes are (corner x, corner y, width, height)."""
    angle = float(np.float32(degrees)) * math.pi / 180.0
    cos, sin, minus = single(math.cos(angle)), single(math.sin(angle)), single(-math.sin(angle))
    mid_x, mid_y = single(centre[0]), single(centre[1])
    left, top, width, height = buffer
    dx = single(float(core[0])) + single(F.col("x")) - mid_x
    dy = single(float(core[1])) + single(F.col("y")) - mid_y
    cells = _cells(pixels, core[2], core[3])
    turned = cells.select("y", "x", (mid_x + (cos * dx + sin * dy)).alias("rx"), (mid_y + (minus * dx + cos * dy)).alias("ry"))
    points = turned.select("y", "x", (F.col("rx") - single(float(left))).alias("fx"), (F.col("ry") - single(float(top))).alias("fy"))
    seen = (F.col("fx") >= 0) & (F.col("fx") < single(float(width - 1))) & (F.col("fy") >= 0) & (F.col("fy") < single(float(height - 1)))
    inside = pixels.where((F.col("x") >= left) & (F.col("x") < left + width) & (F.col("y") >= top) & (F.col("y") < top + height))
    inside = inside.select((F.col("y") - top).alias("y"), (F.col("x") - left).alias("x"), "c", "v")
    found = sample_points(points.where(seen), ["y", "x"], inside, RasterInfo(info.image_id, width, height, info.fmt))
    black = points.where(~seen).select("y", "x", F.explode(F.array(*[F.lit(c) for c in range(info.channels)])).alias("c"), F.lit(0).alias("v"))
    return found.unionByName(black)
